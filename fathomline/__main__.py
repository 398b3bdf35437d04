"""python -m fathomline validate | inspect | compile | generate: the engine from a shell. Exit: 0 fine, 1 invalid or drift, 2 usage or input."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Iterator
from pathlib import Path


def _spark():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("fathomline").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def _schemas(paths: list[str]) -> dict[str, dict]:
    from fathomline.operators.models import read_schema

    return {p: read_schema(p) for p in paths}


def _print_rows(df) -> Iterator[dict]:
    """Prints results as they come, a partition of them at a time, and passes them on."""
    from fathomline.operators.values import results_json

    for r in results_json(df).toLocalIterator():
        row = json.loads(r["json"])
        print(json.dumps(row, indent=2, sort_keys=True, ensure_ascii=False))
        yield row


def validate(a) -> int:
    """The contract is --contract, else each document's own; so is the status, else soft."""
    from pyspark.sql import functions as F

    from fathomline.operators.corpus import validate_corpus
    from fathomline.operators.models import named_model
    from fathomline.operators.validate import Contract
    from fathomline.sources.documents import decode_files
    from fathomline.sources.folder import read_folder

    if a.contract is None and a.model:
        raise ValueError("--model needs --contract")
    files = decode_files(read_folder(_spark(), a.path, a.glob), a.profile).withColumn("host_contract", F.lit(a.contract).cast("string"))
    contracts = [Contract(a.contract)] if a.contract else []
    models = {a.contract: named_model(a.model)} if a.model else None
    schemas = _schemas([*([a.schema] if a.schema else []), *a.document_schema])
    found = validate_corpus(files, contracts, schemas, "host_contract", a.profile, models, infer=True, status=a.status, host_schema=a.schema, host_envelope=a.envelope)
    outcomes = {"usage" if r["contract_id"] == "<unknown>" else r["outcome"] for r in _print_rows(found)}
    return 2 if not outcomes or outcomes & {"input_error", "usage"} else int(outcomes != {"valid"})


def inspect(a) -> int:
    from fathomline.operators.corpus import inspect_corpus
    from fathomline.sources.documents import decode_files
    from fathomline.sources.folder import read_folder

    return 0 if sum(1 for _ in _print_rows(inspect_corpus(decode_files(read_folder(_spark(), a.path, a.glob))))) else 2


def compile_(a) -> int:
    from fathomline.functions.canonical import canonical_json
    from fathomline.operators.models import compile_model, named_model, read_schema, write_schema
    from fathomline.operators.schemas import DIFFERS, MISSING

    made = compile_model(named_model(a.model), a.contract, a.schema_id)
    if a.check:
        there = Path(a.out).is_file()
        drift = not there or canonical_json(read_schema(a.out)) != canonical_json(made.schema)
        diff = (DIFFERS if there else MISSING).replace("{ref}", a.out) if drift else None
        print(json.dumps({"drift": drift, "drift_diff": diff, "schema_sha256": made.schema_sha256}))
        return int(drift)
    write_schema(made, a.out)
    print(json.dumps({"drift": False, "schema_sha256": made.schema_sha256}))
    return 0


def generate(a) -> int:
    """Without --check files are rewritten in place, or what they should be is written to --out; line ends of rewritten files are \\n."""
    from pyspark.sql import functions as F

    from fathomline.operators import sections
    from fathomline.sources.documents import text_of
    from fathomline.sources.folder import read_folder
    from fathomline.sources.rewrite import rewrite

    texts = text_of(read_folder(_spark(), a.path, a.glob))
    schemas = _schemas(a.schema)
    errors = drift = 0
    for r in _print_rows(sections.drift_by_document(sections.drift(sections.sections(texts), schemas))):
        errors, drift = errors + r["errors"], drift + r["drift"]
    if errors:
        return 2
    if a.check:
        return int(drift > 0)
    changed = sections.rewritten(texts.withColumnRenamed("raw", "old"), schemas).select("path", F.col("regenerated").alias("text"), "old")
    if a.out:
        changed.select("path", F.col("text").alias("regenerated")).write.mode("overwrite").parquet(a.out)
        return 0
    return 2 if rewrite(changed, a.path).get("conflict") else 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="fathomline", description=__doc__)
    verbs = parser.add_subparsers(required=True)

    def verb(name: str, run, *flags: tuple) -> None:
        p = verbs.add_parser(name)
        p.set_defaults(run=run)
        for args, options in flags:
            p.add_argument(*args, **options)

    path, glob = (("path",), {}), (("--glob",), {"default": "*.md"})
    statuses, profiles = ("soft", "permissive", "enforced"), ("frontmatter-md", "pure-yaml")
    verb(
        "validate", validate, path, glob, (("--contract",), {}), (("--schema",), {}), (("--envelope",), {}), (("--model",), {}), (("--status",), {"choices": statuses}),
        (("--profile",), {"default": "frontmatter-md", "choices": profiles}), (
            ("--document-schema",), {"action": "append", "default": [], "help": "a schema that documents may name"},
        ),
    )
    verb("inspect", inspect, path, glob)
    verb(
        "compile", compile_, (("model",), {}), (("--contract",), {"required": True}),
        (("--out",), {"required": True}), (("--schema-id",), {}), (("--check",), {"action": "store_true"}),
    )
    verb(
        "generate", generate, path, glob, (("--schema",), {"action": "append", "default": []}),
        (("--check",), {"action": "store_true"}), (("--out",), {}),
    )
    a = parser.parse_args(argv)
    try:
        return a.run(a)
    except (OSError, ValueError, ImportError, AttributeError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
