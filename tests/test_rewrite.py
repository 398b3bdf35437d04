"""Files are rewritten all or not at all, only where they still hold what was read; and the shell's verbs over files."""

import json
import os

import pydantic
import pytest
from pyspark.sql import functions as F

from fathomline.__main__ import main
from fathomline.sources.rewrite import STAGING, commit, finish, rewrite, stage, undo

ROWS = "path string, text string, old string"


def staged(folder):
    return [x for x in os.listdir(folder) if x.startswith(STAGING)]


def put(folder, **texts):
    for name, text in texts.items():
        (folder / f"{name}.md").write_text(text)
    return lambda name: f"file://{folder}/{name}.md"


def test_changed_files_are_replaced(spark, tmp_path):
    at = put(tmp_path, a="old a", b="old b", c="other")
    rows = [(at("a"), "new a", "old a"), (at("b"), "old b", "old b"), (at("c"), "new c", "old c"), (f"file://{tmp_path}/sub/d.md", "new d", None), (at("e"), None, None)]
    assert rewrite(spark.createDataFrame(rows, ROWS).repartition(3), f"file://{tmp_path}") == {"replaced": 2, "conflict": 1}
    assert [(tmp_path / f).read_text() for f in ("a.md", "b.md", "c.md", "sub/d.md")] == ["new a", "old b", "other", "new d"]
    assert not staged(tmp_path) and not (tmp_path / "e.md").exists()


def test_a_failure_leaves_every_file_as_it_was(spark, tmp_path):
    at = put(tmp_path, **{f"f{k}": "old" for k in range(20)})
    rows = spark.createDataFrame([(at(f"f{k}"), "new", "old") for k in range(20)] + [("file:///elsewhere/x.md", "new", None)], ROWS).coalesce(1)
    with pytest.raises(Exception, match="not below"):
        rewrite(rows, f"file://{tmp_path}")
    assert {(tmp_path / f"f{k}.md").read_text() for k in range(20)} == {"old"} and not staged(tmp_path)


def test_half_a_commit_is_finished_by_another(spark, tmp_path):
    at = put(tmp_path, **{f"f{k}": "old" for k in range(6)})
    staging = stage(spark.createDataFrame([(at(f"f{k}"), f"new {k}", "old") for k in range(6)], ROWS), f"file://{tmp_path}")
    assert {(tmp_path / f"f{k}.md").read_text() for k in range(6)} == {"old"}
    manifest = spark.read.parquet(f"{staging}/manifest").collect()
    for r in manifest[:3]:  # as a job that was killed has left it
        os.replace(r.staged, r.path.removeprefix("file://"))
    for _ in range(2):
        assert [r.status for r in commit(spark, staging).collect()] == ["replaced"] * 6
    assert [(tmp_path / f"f{k}.md").read_text() for k in range(6)] == [f"new {k}" for k in range(6)]
    finish(staging)
    assert not staged(tmp_path)


def test_two_texts_for_a_file_are_refused(spark, tmp_path):
    at = put(tmp_path, a="old")
    staging = stage(spark.createDataFrame([(at("a"), "x", "old"), (at("a"), "y", "old")], ROWS), f"file://{tmp_path}")
    with pytest.raises(ValueError, match="two texts"):
        commit(spark, staging)
    undo(staging)
    assert (tmp_path / "a.md").read_text() == "old" and not staged(tmp_path)


# ---- shell ----------------------------------------------------------------------------------------------------------


class Boat(pydantic.BaseModel):
    name: str
    oars: int = 2


def printed(capsys):
    out = capsys.readouterr().out
    rows, at, read = [], 0, json.JSONDecoder()
    while at < len(out.rstrip()):
        row, at = read.raw_decode(out, at)
        rows.append(row)
        at += len(out[at:]) - len(out[at:].lstrip())
    return rows


def test_compile_check_and_validate(spark, tmp_path, capsys):
    schema, docs = tmp_path / "boat.yaml", tmp_path / "docs"
    docs.mkdir()
    assert main(["compile", "test_rewrite:Boat", "--contract", "harbour:Boat/v1", "--out", str(schema), "--check"]) == 1
    assert printed(capsys)[0]["drift_diff"] == f"missing committed compiled schema at {schema}"
    assert main(["compile", "test_rewrite:Boat", "--contract", "harbour:Boat/v1", "--out", str(schema)]) == 0
    assert main(["compile", "test_rewrite:Boat", "--contract", "harbour:Boat/v1", "--out", str(schema), "--check"]) == 0
    schema.write_text(schema.read_text().replace("oars", "ears"))
    capsys.readouterr()
    assert main(["compile", "test_rewrite:Boat", "--contract", "harbour:Boat/v1", "--out", str(schema), "--check"]) == 1
    assert printed(capsys)[0]["drift_diff"] == f"committed schema at {schema} differs from compile output"
    assert main(["compile", "test_rewrite:Boat", "--contract", "harbour:Boat/v1", "--out", str(schema)]) == 0
    put(docs, good="---\nfathom: harbour:Boat/v1\nboat: {name: Ada}\nmore: {}\n---\n")
    capsys.readouterr()
    # --schema and --envelope hold for contracts that documents name
    assert main(["validate", str(docs), "--schema", str(schema), "--envelope", "boat"]) == 0
    assert printed(capsys)[0]["schema_source"] == "host"
    put(docs, bad="---\nfathom: harbour:Boat/v1\nboat: {oars: many}\nmore: {}\n---\n")
    assert main(["validate", str(docs), "--schema", str(schema), "--envelope", "boat"]) == 1
    assert main(["validate", str(docs), "--contract", "harbour:Boat/v1", "--model", "test_rewrite:Boat", "--envelope", "boat"]) == 1
    assert main(["validate", str(docs)]) == 1 and main(["validate", str(docs), "--model", "test_rewrite:Boat"]) == 2
    assert main(["validate", str(docs), "--contract", "harbour:Boat/v1", "--model", "test_rewrite:Nothing"]) == 2
    os.symlink(docs / "nowhere", docs / "gone.md")
    assert main(["validate", str(docs), "--schema", str(schema), "--envelope", "boat"]) == 2


def test_inspect_and_generate(spark, tmp_path, capsys):
    docs, schema = tmp_path / "docs", tmp_path / "s.yaml"
    docs.mkdir()
    schema.write_text("properties:\n  rig: {enum: [bark, yawl]}\n")
    mark = f'<!-- fathom:generated kind="vocab" schema="{schema}" pointer="/properties/rig" -->'
    put(docs, a=f"---\nfathom: a:One\nz: 1\ny: 2\n---\n{mark}old<!-- /fathom:generated -->\r\n", b="nothing to do")
    assert main(["inspect", str(docs)]) == 0
    assert {tuple(r["envelope_keys"] or []) for r in printed(capsys)} == {("z", "y"), ()}
    assert main(["generate", str(docs), "--schema", str(schema), "--check"]) == 1
    assert printed(capsys)[0]["drift_details"] == [f"file://{docs}/a.md: section vocab drifted"]
    assert main(["generate", str(docs), "--schema", str(schema), "--out", str(tmp_path / "new.parquet")]) == 0
    assert spark.read.parquet(str(tmp_path / "new.parquet")).where(F.col("regenerated").contains("- `yawl`")).count() == 1
    assert "old" in (docs / "a.md").read_text()
    assert main(["generate", str(docs), "--schema", str(schema)]) == 0
    assert (docs / "a.md").read_bytes().decode() == f"---\nfathom: a:One\nz: 1\ny: 2\n---\n{mark}\n- `bark`\n- `yawl`\n<!-- /fathom:generated -->\n"
    assert main(["generate", str(docs), "--schema", str(schema), "--check"]) == 0 and not staged(docs)
