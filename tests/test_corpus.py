import pydantic
import pytest

from fathomline.functions.vocab import Dialect
from fathomline.operators import models, sections
from fathomline.operators.corpus import error_rows, inspect_corpus, validate_corpus
from fathomline.operators.schemas import catalogue, schema_drift
from fathomline.operators.validate import Contract
from fathomline.sources.documents import decode_files, decode_table, read_files

SHIP = {"type": "object", "properties": {"name": {"type": "string", "minLength": 3}, "built": {"type": "integer", "minimum": 1800}, "rig": {"anyOf": [{"type": "string", "enum": ["bark", "s|oop"]}, {"type": "null"}]}}, "required": ["name", "built"]}


class Sample(pydantic.BaseModel):
    direction: str
    delta: float

    @pydantic.model_validator(mode="after")
    def agrees(self):
        if (self.direction == "up") != (self.delta >= 0):
            raise ValueError("direction and delta disagree")
        return self


def corpus(spark, texts, contracts, **more):
    docs = decode_table(spark.createDataFrame(list(texts.items()), "path string, text string"), "text", more.get("profile", "frontmatter-md"))
    return {r["path"]: r for r in validate_corpus(docs, contracts, {"m.yaml": SHIP}, **more).collect()}


def test_outcomes(spark):
    texts = {
        "ok": "---\nfathom: a:M/v1\nship: {name: Fram, built: 1892}\n---\n", "bad": "---\nfathom: {contract: a:M/v1, status: enforced}\nship: {name: x, more: 1}\n---\n", "plain": "text", "unknown": "---\nfathom: a:Z/v1\nx: {}\n---\n",
        "two": "---\nfathom: a:M/v1\nsails: {}\nanchors: {}\n---\n", "none": "---\nfathom: a:M/v1\n---\n", "scalar": "---\nfathom: a:M/v1\nship: 3\n---\n", "dup": "---\na: 1\na: 2\n---\n", "own": "---\nfathom: {contract: a:Free/v1, schema: m.yaml}\nm: {name: abc, built: 1}\n---\n",
        "absolute": "---\nfathom: {contract: a:Free/v1, schema: /m.yaml}\nm: {}\n---\n", "leaves": "---\nfathom: {contract: a:Free/v1, schema: x/../../m.yaml}\nm: {}\n---\n", "lost": "---\nfathom: {contract: a:Free/v1, schema: n.yaml}\nm: {}\n---\n", "absent": "---\nfathom: {contract: a:Free/v1, envelope: q}\nm: {}\n---\n",
    }
    got = corpus(spark, texts, [Contract("a:M/v1", schema_ref="m.yaml"), Contract("a:Free/v1")])
    kinds = {k: [e["kind"] for e in r["errors"]] for k, r in got.items()}
    assert kinds == {
        "ok": [], "bad": ["schema_violation"] * 2, "plain": ["no_frontmatter"], "unknown": ["contract_unknown"], "two": ["envelope_ambiguous"], "none": ["envelope_missing"], "scalar": ["envelope_not_mapping"], "dup": ["yaml_duplicate_key"], "own": ["schema_violation"],
        "absolute": ["schema_missing"], "leaves": ["schema_missing"], "lost": ["schema_missing"], "absent": ["envelope_mismatch"],
    }
    assert got["ok"]["outcome"] == "valid" and got["ok"]["semantic_skipped"] == "no_semantic_model" and got["bad"]["outcome"] == "invalid"
    assert "sails, anchors" in got["two"]["errors"][0]["message"]
    assert [w["code"] for w in got["bad"]["warnings"]] == ["document-status-mismatch"]
    assert got["lost"]["semantic_ok"] and got["lost"]["payload_json"] == "{}" and got["absent"]["payload_json"] is None
    assert got["absent"]["errors"][0]["expected_key"] == "q" and got["absent"]["errors"][0]["actual_keys"] == ["m"]


def test_enforced_and_semantic(spark):
    texts = {"x": "---\nfathom: a:M/v1\nship: {name: Fram, built: 1892, more: 1}\n---\n", "up": "---\nfathom: a:S/v1\ns: {direction: up, delta: 1}\n---\n", "odd": "---\nfathom: a:S/v1\ns: {direction: up, delta: -1}\n---\n"}
    got = corpus(spark, texts, [Contract("a:M/v1", schema_ref="m.yaml", status="enforced"), Contract("a:S/v1")], models={"a:S/v1": Sample})
    assert [e["validator"] for e in got["x"]["errors"]] == ["additionalProperties"]
    assert got["up"]["ok"] and got["up"]["structural_skipped"] == "inferred_via_model"
    assert not got["odd"]["semantic_ok"] and got["odd"]["structural_ok"] and "disagree" in got["odd"]["semantic_errors"][0]


def test_mismatch_modes(spark):
    texts = {"d": "---\nfathom: a:Other/v1\nship: {name: Fram, built: 1892}\n---\n"}
    docs = lambda: decode_table(spark.createDataFrame([(k, v, "a:M/v1") for k, v in texts.items()], "path string, text string, host string"), "text")
    run = lambda mode: validate_corpus(docs(), [Contract("a:M/v1", schema_ref="m.yaml")], {"m.yaml": SHIP}, contract_col="host", metadata_mode=mode).first()
    assert run("enforced")["errors"][0]["kind"] == "document_contract_mismatch"
    advised = run("advisory")
    assert advised["ok"] and advised["warnings"][0]["code"] == "document-contract-mismatch"


def test_pure_yaml(spark):
    texts = {"root": "fathom: a:M/v1\nname: Fram\nbuilt: 1892", "list": "- 1", "named": "fathom: {contract: a:M/v1, envelope: ship}\nship: {name: x, built: 1892}"}
    got = corpus(spark, texts, [Contract("a:M/v1", schema_ref="m.yaml")], profile="pure-yaml")
    assert got["root"]["outcome"] == "valid" and got["list"]["errors"][0]["kind"] == "yaml_not_mapping" and got["named"]["errors"][0]["validator"] == "minLength"


def test_other_dialect(spark):
    texts = {"d": "---\nspec: a:M/v1\nship: {name: Fram, built: 1892}\n---\n"}
    docs = decode_table(spark.createDataFrame(list(texts.items()), "path string, text string"), "text")
    assert validate_corpus(docs, [Contract("a:M/v1", schema_ref="m.yaml")], {"m.yaml": SHIP}, dialect=Dialect("spec")).first()["ok"]
    assert inspect_corpus(docs, Dialect("spec")).first()["envelope_keys"] == ["ship"]


def test_files_and_streams(spark, tmp_path):
    from fathomline.streaming.documents import stream_files, stream_results, write_results

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.md").write_text("---\nfathom: a:M/v1\nship: {name: Fram, built: 1892}\n---\n")
    (tmp_path / "in/b.md").write_bytes(b"--\xff")
    (tmp_path / "in/c.md").write_text("---\nfathom: a:M/v1\nship: {name: A, built: 1}\n---\n")
    contracts = [Contract("a:M/v1", schema_ref="m.yaml")]
    batch = validate_corpus(decode_files(read_files(spark, str(tmp_path / "in"), "*.md")), contracts, {"m.yaml": SHIP})
    key = lambda df: sorted((r["path"].rsplit("/", 1)[1], r["outcome"], len(r["errors"])) for r in df.collect())
    assert key(batch) == [("a.md", "valid", 0), ("b.md", "input_error", 1), ("c.md", "invalid", 2)]
    assert error_rows(batch).count() == 3
    stream = stream_results(stream_files(spark, str(tmp_path / "in"), "*.md"), contracts, {"m.yaml": SHIP})
    write_results(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(batch)


def test_sections(spark):
    mark = lambda attrs, body: f"<!-- fathom:generated {attrs} -->{body}<!-- /fathom:generated -->"
    texts = {
        "fresh": "x " + mark('kind="vocab" schema="m" pointer="/properties/rig"', "\n- `bark`\n- `s|oop`\n"), "stale": mark('kind="enum_table" schema="m"', "old") + " tail", "legacy": mark('kind="vocab" contract="m"', ""), "odd": mark('kind="pie" schema="m"', ""),
        "unknown": mark('kind="vocab" schema="m" ton="1" deck="2"', ""), "open": 'a <!-- fathom:generated kind="vocab" -->', "plain": "nothing", "lost": mark('kind="field_list" schema="n"', ""), "bare": mark('kind="vocab" schema="m"', ""),
    }
    df = spark.createDataFrame(list(texts.items()), "path string, text string")
    rows = {r["path"]: r for r in sections.drift(sections.sections(df), {"m": SHIP}).collect()}
    assert rows["fresh"]["drift"] is False and rows["stale"]["drift"] is True and "plain" not in rows
    assert "s\\|oop" in rows["stale"]["rendered"]
    for path, said in {"legacy": "not by 'contract'", "odd": "none of enum_table, field_list, vocab", "unknown": "deck, ton", "open": "offset 2", "lost": "no schema named n", "bare": "needs a"}.items():
        assert said in rows[path]["error"], path
    new = {r["path"]: r["regenerated"] for r in sections.regenerate(df, {"m": SHIP}).collect()}
    assert new["fresh"] == texts["fresh"] and new["plain"] == "nothing" and new["odd"] == texts["odd"]
    assert new["stale"].startswith('<!-- fathom:generated kind="enum_table" schema="m" -->\n| Field') and new["stale"].endswith("<!-- /fathom:generated --> tail")


def test_models(spark, tmp_path):
    class Voyage(pydantic.BaseModel):
        fromPort: str = models.annotated(description="Where it starts", tier="core", owner="bridge", aliases={"nb": ["fra_havn"]}, examples=[])
        days: int | None = None

    made = models.compile_model(Voyage, "fleet.logs:Voyage_Log/v3.1", "tag:fleet,2021:voyage")
    assert made.schema["title"] == "Voyage_Log" and made.schema["$id"] == "tag:fleet,2021:voyage"
    assert made.schema["properties"]["fromPort"]["x-fathom"] == {"tier": "core", "owner": "bridge", "aliases": {"nb": ["fra_havn"]}}
    target = tmp_path / "deep/s.yaml"
    for _ in range(2):
        models.write_schema(made, str(target))
    assert models.read_schema(str(target)) == made.schema and [x.name for x in target.parent.iterdir()] == ["s.yaml"]
    kept, fresh = ({"s": x} for x in (models.read_schema(str(target)), made.schema))
    assert schema_drift(catalogue(spark, kept), catalogue(spark, fresh)).first()["drift"] is False
    for bad in (lambda: models.compile_model(Voyage, "9Voyage"), lambda: models.compile_model(Voyage, "a:B", "voyage.json"), lambda: models.annotated(owner=""), lambda: models.annotated(colour="x")):
        with pytest.raises(ValueError):
            bad()


@pytest.mark.parametrize(("text", "ok"), [("Hull", True), ("yard:Hull", True), ("yard.dock_2:_Hull9/2024-a.b", True), ("x1:A/1", True), ("Hull ", False), ("\nHull", False), ("yard.:Hull", False), ("Yard:Hull", False), ("yard:2Hull", False), ("Hull/", False), ("Hull/a/b", False), ("yard:dock:Hull", False), ("", False)])
def test_contract_ids(spark, text, ok):
    from pyspark.sql import functions as F

    from fathomline.operators.binding import is_contract_id

    assert spark.range(1).select(is_contract_id(F.lit(text))).first()[0] is ok


def test_inferred_bindings(spark):
    """Without a registry the contract is each document's own, and so is the status unless one is given."""
    texts = {"e": "---\nfathom: {contract: a:Any/v1, status: enforced, schema: m.yaml}\ns: {name: Fram, built: 1892, more: 1}\n---\n", "s": "---\nfathom: {contract: b:Any, schema: m.yaml}\ns: {name: Fram, built: 1892, more: 1}\n---\n", "n": "---\ns: {}\n---\n", "p": "no fence"}
    got = corpus(spark, texts, [], infer=True)
    assert {k: (r["status"], r["contract_id"], r["outcome"]) for k, r in got.items()} == {"e": ("enforced", "a:Any/v1", "invalid"), "s": ("soft", "b:Any", "valid"), "n": ("soft", "<unknown>", "invalid"), "p": ("soft", "<unknown>", "invalid")}
    assert [e["validator"] for e in got["e"]["errors"]] == ["additionalProperties"] and got["n"]["errors"][0]["kind"] == "contract_unknown"
    given = corpus(spark, texts, [], infer=True, status="soft")
    assert given["e"]["ok"] and given["e"]["warning_codes"] == ["document-status-mismatch"] and got["e"]["warning_codes"] == []


def test_where_schemas_are_looked_for(spark):
    from fathomline.operators.binding import normal_path

    near = "---\nfathom: {contract: a:Free, schema: %s}\ns: {name: no}\n---\n"
    refs = {"file:/data/a/x.md": "ship.yaml", "/data/a/y.md": "./../a/./ship.yaml", "file:///data/b/z.md": "sub/../m.yaml", "/data/b/w.md": "../a/ship.yaml"}
    docs = decode_table(spark.createDataFrame([(p, near % r) for p, r in refs.items()], "path string, text string"), "text")
    rows = {r["path"]: [e["kind"] for e in r["errors"]] for r in validate_corpus(docs, [Contract("a:Free")], {"/data/a/ship.yaml": SHIP, "m.yaml": SHIP}).collect()}
    assert rows == {"file:/data/a/x.md": ["schema_violation"] * 2, "/data/a/y.md": ["schema_missing"], "file:///data/b/z.md": ["schema_violation"] * 2, "/data/b/w.md": ["schema_missing"]}
    host = lambda ref: validate_corpus(docs.where("path = '/data/a/y.md'"), [Contract("a:Free", schema_ref=ref)], {"/data/a/ship.yaml": SHIP, "lib/m.yaml": SHIP}).first()
    assert [host(r)["errors"][0]["kind"] for r in ("/data/a/ship.yaml", "ship.yaml", "./lib//m.yaml", "/lib/m.yaml", "none.yaml")] == ["schema_violation"] * 3 + ["schema_missing"] * 2
    for path in ("a/./b/../c", "file:///x//y", "../../q", "a/../../b", "/", ""):
        from pyspark.sql import functions as F

        from fathomline.operators.binding import normal

        assert spark.range(1).select(normal(F.lit(path))).first()[0] == normal_path(path)


def test_resources_of_a_corpus(spark):
    port = {"$id": "tag:harbour,2020:port", "required": ["berths"]}
    docs = decode_table(spark.createDataFrame([("d", "---\nfathom: {contract: a:P, schema: p.yaml}\np: {home: {}}\n---\n")], "path string, text string"), "text")
    run = lambda resources: validate_corpus(docs, [Contract("a:P")], {"p.yaml": {"properties": {"home": {"$ref": "tag:harbour,2020:port"}}}}, resources=resources).first()["errors"][0]
    assert run({"tag:harbour,2020:port": port})["validator"] == "required" and run(None)["reason"] == "reference"


def test_roots_that_are_decoded_already(spark):
    from fathomline.sources.documents import from_roots

    roots = {"ok": '{"fathom": "a:M", "s": {"name": "Fram", "built": 1892}}', "big": '{"fathom": "a:M", "s": {"name": "Fram", "built": 9007199254740993}}', "cut": '{"a"', "list": "[1]", "null": None}
    df = spark.createDataFrame(list(roots.items()), "path string, root string")
    kinds = lambda guard: {r["path"]: r["kind"] for r in from_roots(df, "root", guard).collect()}
    assert kinds(False) == {"ok": None, "big": None, "cut": "yaml_parse_error", "list": None, "null": None} and kinds(True)["big"] == "number_out_of_range"
    checked = {r["path"]: r for r in validate_corpus(from_roots(df.where("root is not null"), "root"), [Contract("a:M", schema_ref="m.yaml")], {"m.yaml": SHIP}).collect()}
    assert checked["ok"]["ok"] and checked["big"]["ok"] and not checked["cut"]["ok"]
