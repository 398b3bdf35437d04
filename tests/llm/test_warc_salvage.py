"""The salvage reader over odd but sound records, false lengths and damaged bytes."""

import base64
import gzip
import hashlib
import io
import random

import pytest

from fathomline.llm import warc


def record(block=b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody", kind="response", version="WARC/1.0", line="\r\n", content="application/http", tail=b"\r\n\r\n", **fields):
    head = [version, f"WARC-Type: {kind}", f"Content-Type: {content}", *(f"{k.replace('_', '-')}: {v}" for k, v in fields.items())]
    if "Content_Length" not in fields:
        head.append(f"Content-Length: {len(block)}")
    return (line.join(head) + line * 2).encode() + block + tail


def sha1(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def read(data, hold=4 << 20):
    return list(warc.salvage(warc.Source(io.BytesIO(data), len(data), hold)))


SOUND = [
    (record(kind="revisit", WARC_Payload_Digest="md5:d41d8cd98f00b204e9800998ecf8427e"), "", b"body"),
    (record(kind="revisit", WARC_Payload_Digest="sha1:" + "8" * 32), "", b"body"),
    (record(kind="revisit", WARC_Payload_Digest="A" * 32), "0" * 40, b"body"),
    (record(WARC_Payload_Digest="md5:" + hashlib.md5(b"body").hexdigest()), hashlib.sha1(b"body").hexdigest(), b"body"),
    (record(WARC_Payload_Digest="sha256:" + hashlib.sha256(b"body").hexdigest(), WARC_Block_Digest="blake2:zz"), hashlib.sha1(b"body").hexdigest(), b"body"),
    (record(b"HTTP/1.1 200 OK\nA: b\n\nbo\r\n\r\ndy"), hashlib.sha1(b"bo\r\n\r\ndy").hexdigest(), b"bo\r\n\r\ndy"),
    (record(b"HTTP/1.1 200 OK\r\nno colon here\r\nA: b\r\n\r\nx"), hashlib.sha1(b"x").hexdigest(), b"x"),
    (record(b"", kind="revisit", WARC_Payload_Digest=sha1(b"q")), hashlib.sha1(b"q").hexdigest(), b""),
    (record(b"HTTP/1.1 204 No Content\r\nA: b"), hashlib.sha1(b"").hexdigest(), b""),
    (record(b"no http at all", WARC_Payload_Digest=sha1(b"no http at all")), hashlib.sha1(b"no http at all").hexdigest(), b"no http at all"),
    (record(version="WARC/0.18"), hashlib.sha1(b"body").hexdigest(), b"body"),
    (record(line="\n", tail=b"\n\n"), hashlib.sha1(b"body").hexdigest(), b"body"),
    (record(b"plain", content="text/plain", odd="é \u0000"), hashlib.sha1(b"plain").hexdigest(), b"plain"),
    (record(b"WARC/1.0\r\nnested\r\n\r\n", content="text/plain"), hashlib.sha1(b"WARC/1.0\r\nnested\r\n\r\n").hexdigest(), b"WARC/1.0\r\nnested\r\n\r\n"),
]


@pytest.mark.parametrize("number", range(len(SOUND)))
@pytest.mark.parametrize("squeezed", [False, True])
def test_sound_records_are_returned(number, squeezed):
    data, digest, payload = SOUND[number]
    good = record(b"HTTP/1.1 200 OK\r\n\r\nnext")
    found = read(gzip.compress(data) + gzip.compress(good) if squeezed else data + good)
    assert [r.reason for r in found] == ["", ""] and found[0].digest == digest and found[0].payload == payload and found[1].payload == b"next"


def test_what_is_odd_is_noted():
    notes = [read(data)[0].notes for data, *_ in SOUND]
    assert notes[6] == ["HTTP head has a line without a colon"] and notes[8] == ["HTTP head has no end"] and notes[0] == [] and notes[5] == []


@pytest.mark.parametrize("length", ["9" * 5000, "99999999999999999999", "1" * 18, "-1", "٣", "", "1e3", "10000000"])
def test_false_lengths_are_gaps(length):
    bad = record(Content_Length=length)
    found = read(bad + record())
    assert [bool(r.reason) for r in found] == [True, False] and found[0].end == len(bad) == found[1].start


def test_a_false_length_holds_little():
    class Counted(io.BytesIO):
        most = 0

        def read(self, n=-1):
            Counted.most = max(Counted.most, n)
            return super().read(n)

    body = record(b"x" * 5000, content="text/plain")
    data = record(Content_Length=str(2_000_000)) + body * 1000
    found = list(warc.salvage(warc.Source(Counted(data), len(data), 1 << 16)))
    assert [bool(r.reason) for r in found] == [True] + [False] * 1000 and Counted.most <= (1 << 16) + 16


def test_no_bytes_make_the_reader_fail():
    """Bytes changed, cut out and put in, plain and in members; every place of the archive is in one record or gap."""
    rng = random.Random(9)
    plain = b"".join(d for d, *_ in SOUND)
    packed = b"".join(gzip.compress(d) for d, *_ in SOUND) + gzip.compress(plain)
    pieces = [b"WARC/1.0\r\n", b"\x1f\x8b\x08", b"\r\n\r\n", b"Content-Length: 99999999999\r\n", b":", b"\n", b"sha1:" + b"7" * 32, b"HTTP/1.1", b"\x00", b"\xff\xfe"]
    for k in range(400):
        data = bytearray(packed if k % 2 else plain)
        for _ in range(rng.randint(1, 6)):
            at = rng.randrange(len(data) + 1)
            match rng.randrange(4):
                case 0:
                    data[at : at + 1] = bytes([rng.randrange(256)])
                case 1:
                    del data[at : at + rng.randint(1, 200)]
                case 2:
                    data[at:at] = rng.choice(pieces)
                case _:
                    data[at : at + 8] = rng.randbytes(rng.randint(0, 16))
        whole = bytes(data)
        found = read(whole, rng.choice([64, 1 << 20]))
        spans = sorted({(r.start, r.end) for r in found})
        assert not whole or (spans[0][0] == 0 and spans[-1][1] == len(whole) and all(a[1] == b[0] for a, b in zip(spans[:-1], spans[1:], strict=True)))
    for k in range(200):
        list(warc.salvage(rng.randbytes(rng.randint(0, 300))))


def test_notes_reach_the_table(spark, tmp_path):
    for k, (data, *_) in enumerate(SOUND):
        (tmp_path / f"{k}.warc").write_bytes(data)
    (tmp_path / "bad.warc.gz").write_bytes(gzip.compress(b"x"))
    rows = warc.read_warc(spark, f"file://{tmp_path}").collect()
    assert len(rows) == len(SOUND) + 1 and sum(r.reason is not None for r in rows) == 1
    assert sum(r.notes is not None for r in rows) == 3
