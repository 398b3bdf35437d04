import json

import pydantic
import pytest
from pyspark.sql import functions as F

from fathomline.__main__ import main
from fathomline.operators.validate import Contract
from fathomline.operators.values import results_json, validate_values

SCHEMA = Contract("a:V/v1", {"properties": {"delta": {"minimum": 0}}, "required": ["direction"]})


class Move(pydantic.BaseModel):
    direction: str
    delta: float


def test_both_engines(spark):
    rows = [(1, '{"direction": "up", "delta": 1}'), (2, '{"delta": -1}'), (3, '{"direction": 3, "delta": 1}'), (4, None)]
    df = spark.createDataFrame(rows, "id int, j string").withColumn("v", F.parse_json("j"))
    got = {r.id: (r.structural_ok, r.semantic_ok, r.ok) for r in validate_values(df, SCHEMA, Move, "v").collect()}
    assert got == {1: (True, True, True), 2: (False, False, False), 3: (True, False, False), 4: (True, True, True)}
    assert [r.ok for r in validate_values(df, model=Move, column="v").orderBy("id").collect()] == [True, False, False, True]
    assert [r.ok for r in validate_values(df, SCHEMA, column="v").orderBy("id").collect()] == [True, False, True, True]
    typed = spark.createDataFrame([("up", 1.0), (None, -2.0)], "direction string, delta double")
    assert [r.ok for r in validate_values(typed, SCHEMA, Move).collect()] == [True, False]
    with pytest.raises(ValueError):
        validate_values(df)


def test_results_as_json(spark):
    row = (None, 1, 2.0, [0.5, 3.0, None, 1e20], {"k": (4.0, "x")}, None)
    text = results_json(spark.createDataFrame([row], "b string, a int, `d.e` double, list array<double>, m map<string,struct<q:double,s:string>>, n struct<q:double>")).first()["json"]
    assert text == '{"a":1,"b":null,"d.e":2,"list":[0.5,3,null,100000000000000000000],"m":{"k":{"q":4,"s":"x"}},"n":null}'


def test_shell(spark, tmp_path, capsys, monkeypatch):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/a.md").write_text("---\nfathom: a:V/v1\nv: {direction: up, delta: 1}\n---\n")
    out = str(tmp_path / "s.yaml")
    assert main(["compile", "test_values:Move", "--contract", "a:V/v1", "--out", out]) == 0
    assert main(["compile", "test_values:Move", "--contract", "a:V/v1", "--out", out, "--check"]) == 0
    assert main(["compile", "test_values:Move", "--contract", "bad id", "--out", out]) == 2
    assert main(["inspect", str(tmp_path / "docs")]) == 0
    capsys.readouterr()
    assert main(["validate", str(tmp_path / "docs"), "--contract", "a:V/v1", "--schema", out, "--model", "test_values:Move"]) == 0
    assert json.loads(capsys.readouterr().out)["outcome"] == "valid"
    (tmp_path / "docs/b.md").write_text("---\nfathom: a:V/v1\nv: {delta: x}\n---\n")
    assert main(["validate", str(tmp_path / "docs"), "--contract", "a:V/v1", "--schema", out]) == 1
    (tmp_path / "docs/c.md").write_text(f'<!-- fathom:generated kind="field_list" schema="{out}" -->\nold\n<!-- /fathom:generated -->')
    assert main(["generate", str(tmp_path / "docs"), "--schema", out, "--check"]) == 1
    assert main(["generate", str(tmp_path / "docs"), "--schema", out, "--out", str(tmp_path / "new")]) == 0
    new = {r.path.rsplit("/", 1)[1]: r.regenerated for r in spark.read.parquet(str(tmp_path / "new")).collect()}
    assert "- `direction` (string, required)" in new["c.md"] and set(new) == {"c.md"}  # only what has drifted
    (tmp_path / "docs/c.md").write_bytes(new["c.md"].replace("\n", "\r\n").encode())
    assert main(["generate", str(tmp_path / "docs"), "--schema", out, "--check"]) == 0


def test_shell_infers_what_is_not_given(spark, tmp_path, capsys):
    for name, text in {"a": "---\nfathom: {contract: a:V/v1, status: permissive}\nv: {delta: 1.0}\n---\n", "b": "---\nfathom: b:W\nv: {}\n---\n"}.items():
        (tmp_path / f"{name}.md").write_text(text)
    assert main(["validate", str(tmp_path)]) == 0
    shown = capsys.readouterr().out
    assert '"status": "permissive"' in shown and '"contract_id": "b:W"' in shown
    (tmp_path / "c.md").write_text("---\nv: {}\n---\n")
    assert main(["validate", str(tmp_path)]) == 2 and main(["validate", str(tmp_path), "--envelope", "v"]) == 2
    assert main(["validate", str(tmp_path), "--contract", "c:X", "--status", "soft", "--glob", "c.md"]) == 0
