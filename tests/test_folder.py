"""The folder source: unreadable files are rows, filters choose files, partitions are packed by bytes."""

import os

from fathomline.operators.corpus import validate_corpus
from fathomline.operators.validate import Contract
from fathomline.sources.documents import decode_files
from fathomline.sources.folder import Reader, read_folder


def folder(tmp_path):
    (tmp_path / "sub.md").mkdir()
    (tmp_path / "a.md").write_text("---\nfathom: a:One\nv: {n: 1}\n---\nbody")
    (tmp_path / "sub.md" / "b.md").write_bytes(b"\xff")
    (tmp_path / "big.md").write_text("x" * 5000)
    (tmp_path / "c.txt").write_text("not asked for")
    (tmp_path / "empty.md").write_text("")
    os.symlink(tmp_path / "nowhere", tmp_path / "gone.md")
    return str(tmp_path)


def test_unreadable_files_are_rows(spark, tmp_path):
    files = read_folder(spark, folder(tmp_path), "*.md", maxbytes="1000")
    got = {os.path.basename(r.path): r for r in files.collect()}
    assert sorted(got) == ["a.md", "b.md", "big.md", "empty.md", "gone.md"]
    assert {k for k, r in got.items() if r.kind == "artifact_unreadable"} == {"big.md", "gone.md"} and got["big.md"].content is None
    found = validate_corpus(decode_files(files), [Contract("a:One")], {})
    outcome = {os.path.basename(r.path): (r.outcome, r.errors[0]["kind"] if r.errors else None) for r in found.collect()}
    assert outcome == {
        "a.md": ("valid", None), "b.md": ("input_error", "artifact_invalid_utf8"), "big.md": ("input_error", "artifact_unreadable"), "gone.md": ("input_error", "artifact_unreadable"), "empty.md": ("invalid", "no_frontmatter"),
    }


def test_a_file_that_goes_after_the_listing_is_a_row(tmp_path):
    at = folder(tmp_path)
    reader = Reader({"path": at, "glob": "a.md"})
    (part,) = reader.partitions()
    os.remove(tmp_path / "a.md")
    ((path, _, _, content, kind, message),) = reader.read(part)
    assert path.endswith("/a.md") and content is None and kind == "artifact_unreadable" and path in message


def test_filters_choose_files(spark, tmp_path):
    files = read_folder(spark, folder(tmp_path))
    assert [os.path.basename(r.path) for r in files.where("length > 4000").collect()] == ["big.md"]
    assert files.where(files.path.startswith(f"file://{tmp_path}/sub.md")).count() == 1
    plan = files.where("length > 4000")._jdf.queryExecution().executedPlan().toString()
    assert "length" in plan and "Filter (" not in plan.split("BatchScan")[0].replace("Filter (isnotnull", "")


def test_partitions_are_packed_by_bytes(tmp_path):
    for k in range(40):
        (tmp_path / f"{k}.md").write_text("x" * 100)
    parts = Reader({"path": str(tmp_path), "packbytes": "1000"}).partitions()
    assert [len(p.files) for p in parts] == [10, 10, 10, 10]
    assert Reader({"path": str(tmp_path), "glob": "none"}).partitions()[0].files == []
