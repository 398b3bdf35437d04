"""WARC: a writer with revisit records, and a salvage reader that recovers what follows damage.

Each record is a gzip member of its own. The writer rolls archives at a size, so a reader's task holds a few of them.
Tasks write under names of their own attempt; only the files of the attempts that Spark kept are moved to the archive
folder, so a lost executor or a second attempt leaves no record twice.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._work import HOT, P, cut, fresh_path, sifting, sole, table

GZIP = b"\x1f\x8b\x08"
_VERSION = re.compile(rb"WARC/[01]\.\d{1,3}[ \t]*\r?\n")
_START = re.compile(rb"\x1f\x8b\x08|(?:(?<=\n)|\A)WARC/[01]\.")
_LINE = re.compile(rb"(?<=\n)WARC/[01]\.")
_BLANK = re.compile(rb"\n\r?\n")
#: Bytes that a record's own header may have.
HEADER = 1 << 20
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def _base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def format_record(kind: str, record_id: str, block: bytes, fields: dict[str, str | None]) -> bytes:
    """One record, compressed as a member. Control characters and spaces in a field's value are percent-encoded."""
    head = {
        "WARC-Type": kind, "WARC-Record-ID": record_id, **fields,
        "WARC-Block-Digest": f"sha1:{_base32(hashlib.sha1(block).digest())}", "Content-Length": str(len(block)),
    }
    clean = lambda v: _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", v)
    lines = [f"{k}: {v if k == 'Content-Type' else clean(v)}" for k, v in head.items() if v is not None]
    squeeze = zlib.compressobj(4, zlib.DEFLATED, 31)
    return squeeze.compress(("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n") + squeeze.flush()


def _page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = {
        "WARC-Date": date, "WARC-Target-URI": url,
        "WARC-Payload-Digest": f"sha1:{_base32(hashlib.sha1(payload).digest())}",
        "Content-Type": "application/http; msgtype=response", "X-Page-ID": None if page_id is None else str(page_id),
    }
    if revisit:
        fields |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<urn:x-page:{refers_to}>"}
    name = f"<urn:x-page:{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid4()}>"
    return format_record("revisit" if revisit else "response", name, http if revisit else http + payload, fields)


def plan_records(pages: DataFrame, id_col: str, url_col: str, payload_col: str, min_revisit: int = 1000) -> DataFrame:
    """page_id, url, payload, refers_to, revisit: which rows become revisits of which.

    Of rows with equal payloads (SHA-1) of min_revisit bytes or more, those with the largest id are responses, the
    others revisit it. Rows without an id never are the one revisited, unless no row of the group has one: then all are
    responses. Only payloads that repeat are shuffled (and few others, by a bit map of the groups), and of these not
    those that are repeated most: fewer than HOT groups are broadcast to them."""
    rows = sole(pages, {"page_id": id_col, "url": url_col, "payload": payload_col}).withColumn(
        "payload", F.coalesce(F.col("payload").cast("string"), F.lit("")).cast("binary"),
    )
    d, n = P + "d", P + "n"
    rows = rows.withColumn(d, F.when(F.length("payload") >= min_revisit, F.unhex(F.sha1("payload"))))
    groups = rows.where(F.col(d).isNotNull()).groupBy(d).agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias(n)).where(F.col(n) > 1)
    groups = cut(groups.where(F.col("refers_to").isNotNull()), "repeated-payloads")
    total = groups.agg(F.sum(n)).first()[0] or 0
    hot, cold = groups.where(F.col(n) * HOT > total).drop(n), groups.where(F.col(n) * HOT <= total).drop(n)
    named = sifting(rows, groups, [d], P + "repeats").join(F.broadcast(hot), d, "left")
    asks = F.col(P + "repeats") & F.col("refers_to").isNull()
    columns = ["page_id", "url", "payload", "refers_to"]
    joined = named.where(~asks).select(*columns).union(named.where(asks).drop("refers_to").join(cold, d, "left").select(*columns))
    revisit = F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    return joined.select("page_id", "url", "payload", F.when(revisit, F.col("refers_to")).alias("refers_to"), revisit.alias("revisit"))


def write_warc(records: DataFrame, folder: str, roll_bytes: int = 8 << 20, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write plan_records' rows as archives under folder (a URI that pyarrow's file systems open).

    Returns the manifest: name, records, bytes of each archive. An empty table writes no archive."""
    spark = records.sparkSession
    staging, final = f"{folder}/staging", f"{folder}/archives"
    for at in (staging, final):
        fs, path = pa.fs.FileSystem.from_uri(at)
        fs.create_dir(path, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pa.fs.FileSystem.from_uri(staging)
        done, out, name, n, size = [], None, "", 0, 0
        try:
            for batch in batches:
                for row in zip(*(c for c in batch.columns), strict=True):
                    page_id, url, payload, refers_to, revisit = (v.as_py() for v in row)
                    if out is None:
                        name, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = fs.open_output_stream(f"{path}/{name}", compression=None)
                        out.write(info := format_record("warcinfo", f"<urn:uuid:{uuid.uuid4()}>", b"format: WARC File Format 1.1\r\n", {"WARC-Date": date, "WARC-Filename": name, "Content-Type": "application/warc-fields"}))
                        size += len(info)
                    out.write(record := _page_record(page_id, url, payload, refers_to, revisit, date))
                    n, size = n + 1, size + len(record)
                    if size >= roll_bytes:
                        out.close()
                        done.append((name, n, size))
                        out = None
        finally:
            if out is not None:
                out.close()
        if out is not None:
            done.append((name, n, size))
        yield pa.record_batch({"name": pa.array([d[0] for d in done], pa.string()), "records": pa.array([d[1] for d in done], pa.int64()), "bytes": pa.array([d[2] for d in done], pa.int64())})

    def commit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pa.fs.FileSystem.from_uri(staging)
        _, to = pa.fs.FileSystem.from_uri(final)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                if fs.get_file_info(f"{path}/{name}").type != pa.fs.FileType.NotFound:  # else an earlier attempt has moved it
                    fs.move(f"{path}/{name}", f"{to}/{name}")
            yield batch

    kind = "name string, records long, bytes long"
    manifest = cut(records.select("page_id", "url", "payload", "refers_to", "revisit").mapInArrow(write, kind), "warc-manifest")
    return cut(manifest.mapInArrow(commit, kind), "warc-committed")


class Source:
    """An archive's bytes, of which a few MB are held: slices, find and search as of a bytes object."""

    def __init__(self, file: BinaryIO, size: int, hold: int = 4 << 20) -> None:
        self.file, self.size, self.hold = file, size, hold
        self.start, self.held = 0, b""

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, s: slice) -> bytes:
        a, b = s.start or 0, self.size if s.stop is None else min(s.stop, self.size)
        if not self.start <= a <= b <= self.start + len(self.held):
            self.file.seek(a)
            self.start, self.held = a, self.file.read(max(b - a, min(self.hold, self.size - a)))
        return self.held[a - self.start : b - self.start]

    def search(self, pattern: re.Pattern, start: int, stop: int | None = None) -> int:
        """Where the first match from start on begins that begins before stop, or -1; of matches of up to 16 bytes that may look one byte back."""
        stop = self.size if stop is None else min(stop, self.size)
        while start < stop:
            back = min(1, start)
            part = self[start - back : min(start + self.hold, stop + 16)]
            if m := pattern.search(part, back):
                return start - back + m.start() if start - back + m.start() < stop else -1
            start += max(1, self.hold - 16)
        return -1


def _source(data: bytes) -> Source:
    return Source(io.BytesIO(data), len(data))


@dataclass
class Record:
    start: int
    end: int
    fields: dict[str, str] = field(default_factory=dict)
    http: dict[str, str] = field(default_factory=dict)
    payload: bytes = b""
    digest: str = ""
    reason: str = ""
    notes: list[str] = field(default_factory=list)


class _Bad(Exception):
    pass


def _fields(head: bytes, notes: list[str], what: str) -> dict[str, str]:
    """The fields below a head's first line, whatever ends its lines; a line that is none is noted and left out."""
    found: dict[str, str] = {}
    last = ""
    for line in head.split(b"\n")[1:]:
        line = line.removesuffix(b"\r")
        if line[:1] in (b" ", b"\t") and last:
            found[last] += " " + line.strip().decode("utf-8", "replace")
            continue
        name, colon, value = line.partition(b":")
        if colon:
            last = name.strip().decode("utf-8", "replace").lower()
            found[last] = value.strip().decode("utf-8", "replace")
        elif line:
            notes.append(f"{what} has a line without a colon")
    return found


def _number(text: str) -> int | None:
    return int(text) if text.isascii() and text.isdecimal() and len(text) <= 18 else None


#: Digests that can be checked here, by their names in records.
_DIGESTS = {"sha1": hashlib.sha1, "md5": hashlib.md5, "sha256": hashlib.sha256, "sha-1": hashlib.sha1, "sha-256": hashlib.sha256}


def _same_digest(said: str, data: bytes) -> bool:
    """Whether data has the digest said, in hexadecimal or base32; a digest by another function can't be checked and passes."""
    name, _, value = said.partition(":")
    if name.lower() not in _DIGESTS:
        return True
    digest = _DIGESTS[name.lower()](data).digest()
    return value.lower() == digest.hex() or value.upper().rstrip("=") == _base32(digest).rstrip("=")


def _sha1_hex(said: str) -> str:
    """The hexadecimal form of a stated SHA-1, "" for what is none."""
    name, _, value = said.rpartition(":")
    if name.lower() not in ("", "sha1", "sha-1"):
        return ""
    if re.fullmatch("[0-9a-fA-F]{40}", value):
        return value.lower()
    return base64.b32decode(value.upper()).hex() if re.fullmatch("[A-Za-z2-7]{32}", value) else ""


def _split(block: bytes) -> tuple[bytes, bytes | None]:
    """The head of an HTTP message, and what follows its empty line; None where there is no such line."""
    m = _BLANK.search(block)
    return (block[: m.start()], block[m.end() :]) if m else (block, None)


def _parse(data: Source, start: int) -> Record:
    """The plain record at start; _Bad if its length or a digest doesn't hold. What is odd else is noted."""
    if not _VERSION.match(data[start : start + 16]):
        raise _Bad("no version line")
    if (split := data.search(_BLANK, start, start + HEADER)) < 0:
        raise _Bad("no end of header")
    begin = split + (3 if data[split : split + 3] == b"\n\r\n" else 2)
    notes: list[str] = []
    fields = _fields(data[start:split], notes, "header")
    if (length := _number(fields.get("content-length", ""))) is None:
        raise _Bad("no length")
    end = begin + length
    # what follows is looked at first: a false length reads no more than that
    tail = data[end : end + 4] if end <= len(data) else b""
    after = 4 if tail == b"\r\n\r\n" else 2 if tail[:2] == b"\n\n" else 0
    if not after:
        raise _Bad("length does not fit")
    block = data[begin:end]
    if not _same_digest(fields.get("warc-block-digest", ""), block):
        raise _Bad("block digest differs")
    record = Record(start, end + after, fields, payload=block, notes=notes)
    revisit = fields.get("warc-type") == "revisit"
    if fields.get("content-type", "").lower().startswith("application/http"):
        head, body = _split(block)
        if body is None and block and not revisit:
            notes.append("HTTP head has no end")
        record.http = _fields(head, notes, "HTTP head")
        record.payload = body if body is not None else b"" if revisit or block.startswith(b"HTTP/") else block
    said = fields.get("warc-payload-digest", "")
    if revisit:
        record.digest = _sha1_hex(said)
        return record
    if not _same_digest(said, record.payload):
        if record.payload is block or not _same_digest(said, block):
            raise _Bad("payload digest differs")
        notes.append("payload digest is that of the block")
    record.digest = hashlib.sha1(record.payload).hexdigest()
    return record


def _member(data: Source, start: int) -> tuple[bytes, int, str]:
    """What the member at start holds, or held before its damage; its length; what ails it ("" for a sound one)."""
    unzip, parts, at = zlib.decompressobj(31), [], start
    while at < len(data) and not unzip.eof:
        chunk, before = data[at : at + (1 << 16)], unzip.copy()
        try:
            parts.append(unzip.decompress(chunk))
        except zlib.error:
            for k in range(len(chunk)):
                try:
                    parts.append(before.decompress(chunk[k : k + 1]))
                except zlib.error:
                    break
            return b"".join(parts), 0, "damaged member"
        at += len(chunk)
    return b"".join(parts), at - start - len(unzip.unused_data), "" if unzip.eof else "cut member"


def _inside(plain: Source) -> Iterator[Record]:
    """The records of a member's bytes and the gaps between them, with their places there."""
    at = 0
    while at < len(plain):
        probe, reason, record = at, "", None
        while record is None:
            try:
                record = _parse(plain, probe)
            except _Bad as e:
                reason = reason or str(e)
                if (probe := plain.search(_LINE, probe + 1)) < 0:
                    yield Record(at, len(plain), reason=reason)
                    return
        if reason:
            yield Record(at, probe, reason=reason)
        yield record
        at = record.end


def _read_for(data: Source, start: int, plain: int) -> int:
    """How many bytes of the member at start it takes to get so many plain ones."""
    unzip, at = zlib.decompressobj(31), start
    while plain > 0:
        chunk = data[at : at + (1 << 16)]
        plain -= len(unzip.decompress(chunk, plain))
        at += len(chunk) - len(unzip.unconsumed_tail)
    return at - start


def _checked(record: Record) -> bool:
    """Whether a digest held the record's bytes to what was written; a revisit's payload digest is of another record."""
    names = ("warc-block-digest",) if record.fields.get("warc-type") == "revisit" else ("warc-block-digest", "warc-payload-digest")
    return any(record.fields.get(f, "").partition(":")[0].lower() in _DIGESTS for f in names)


def _at(data: Source, start: int) -> tuple[list[Record], int, str]:
    """The records and inner gaps of the member, or the plain record, at start; where the next begins; what ails the rest of the member.

    Of a member that fails after some bytes, the records before are kept; where it is damaged, not just cut, what came
    out may be wrong some way before it fails: then only those whose digest holds."""
    if data[start : start + 3] != GZIP:
        record = _parse(data, start)
        return [record], record.end, ""
    plain, used, reason = _member(data, start)
    found = list(_inside(_source(plain)))
    doubtful = lambda r: bool(r.reason) or (reason == "damaged member" and not _checked(r))
    while found and doubtful(found[-1]) and (reason or len(found) == 1):
        last = found.pop()
        reason = reason or last.reason
    if not found:
        raise _Bad(reason or "empty member")
    if reason:
        found = [Record(r.start, r.end, reason=r.reason or reason) if doubtful(r) else r for r in found]
        used = _read_for(data, start, found[-1].end - 1)  # without the last byte, so that a bad trailer isn't read
    for r in found:
        r.start, r.end = start, start + used
    return found, start + used, reason


def salvage(data: bytes | Source) -> Iterator[Record]:
    """Records of an archive in order; for each stretch that fails a check, a Record with only start, end and reason.

    After a failure the search goes on at the next member or version line that itself passes all checks, in a member of
    several records at its next version line. Records and gaps inside a member have the member's start and end."""
    data = _source(data) if isinstance(data, bytes) else data
    at, reason = 0, ""
    while at < len(data):
        probe, found = at, []
        while not found:
            if not reason or probe > at or data[probe : probe + 3] == GZIP:
                try:
                    found, end, ails = _at(data, probe)
                    break
                except _Bad as e:
                    reason = reason or str(e)
            if (probe := data.search(_START, probe + 1)) < 0:
                yield Record(at, len(data), reason=reason)
                return
        if probe > at:
            yield Record(at, probe, reason=reason)
        yield from found
        at, reason = end, ails


SCHEMA = "path string, start long, end long, reason string, record_type string, record_id string, target_uri string, refers_to string, fields map<string,string>, http map<string,string>, payload binary, payload_digest string, payload_bytes long, notes string"


def read_warc(spark: SparkSession, path: str, with_payload: bool = True, stream: bool = False) -> DataFrame:
    """A row for each record under path (*.warc, *.warc.gz) and for each quarantined gap (reason is not null).

    payload_digest is the SHA-1 of the payload read, for a revisit the one it states; payload_bytes is the payload's
    length, for a revisit the length that its HTTP header states. A record whose length and digests hold is returned whatever
    its heads are like; what is odd about them is in notes. No bytes make the reader fail. An empty folder gives no row. Archives are read by
    Spark, whole, from any store that it reads, up to its limit of 2 GB; with stream they are opened through pyarrow's
    file systems instead and read a few MB and a member at a time, whatever their length."""

    def records(name: pa.Scalar, data: bytes | Source) -> Iterator[pa.RecordBatch]:
        text = pa.map_(pa.string(), pa.string())
        rows: list[tuple] = []
        for r in salvage(data):
            if r.reason:
                rows.append((name.as_py(), r.start, r.end, r.reason, *[None] * 10))
            else:
                kind = r.fields.get("warc-type")
                stated = _number(r.http.get("content-length", ""))
                n = stated if kind == "revisit" and stated is not None else len(r.payload)
                known = (r.fields.get(k) for k in ("warc-record-id", "warc-target-uri", "warc-refers-to"))
                rows.append((name.as_py(), r.start, r.end, None, kind, *known, list(r.fields.items()), list(r.http.items()), r.payload if with_payload else None, r.digest, n, "; ".join(dict.fromkeys(r.notes)) or None))
            if len(rows) >= 500:
                yield _batch(rows, text)
                rows = []
        yield _batch(rows, text)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                if not stream:
                    yield from records(name, content.as_py())
                    continue
                fs, at = pa.fs.FileSystem.from_uri(name.as_py())
                with fs.open_input_file(at) as file:
                    yield from records(name, Source(file, content.as_py()))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc{,.gz}").option("recursiveFileLookup", "true").load(path)
    if stream:
        return files.select(
            F.regexp_replace("path", r"^file:/(?!/)", "file:///").alias("path"), "length",
        ).repartition("path").mapInArrow(read, SCHEMA)
    return files.select("path", "content").mapInArrow(read, SCHEMA)


def _batch(rows: list[tuple], text: pa.DataType) -> pa.RecordBatch:
    names = [part.split()[0] for part in re.split(r", (?=\w+ )", SCHEMA)]
    kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 5, text, text, pa.binary(), pa.string(), pa.int64(), pa.string()]
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _page(urn: Column) -> Column:
    return F.regexp_extract(urn, r"^<urn:x-page:(-?\d+)>$", 1).cast("long")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "warc")
    write_warc(plan_records(table(spark, sf_dir, "pages"), "page_id", "url", "html"), folder)
    back = read_warc(spark, f"{folder}/archives", with_payload=False).where(F.col("record_type").isin("response", "revisit"))
    return back.select(
        F.col("fields")["x-page-id"].cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.when(F.col("refers_to").isNotNull(), _page(F.col("refers_to"))).alias("refers_to"),
    )


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT html, max(page_id) AS m FROM p WHERE octet_length(encode(html)) >= 1000 GROUP BY html)
SELECT p.page_id, octet_length(encode(p.html))::BIGINT AS payload_bytes, sha1(p.html) AS payload_digest,
       CASE WHEN g.m <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN g.m <> p.page_id THEN g.m END AS refers_to
FROM p LEFT JOIN g ON p.html = g.html
"""
