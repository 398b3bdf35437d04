"""Document sources: files as rows, fences and YAML as columns. One Arrow crossing decodes; the rest is Column expressions."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .yaml12 import Rejected, check_portable, decode

DECODED = "struct<has_frontmatter:boolean,body:string,root_json:string,root_type:string,kind:string,message:string>"
_LINE = re.compile(r"\r?\n")


def split_fence(text: str) -> tuple[str | None, str]:
    """(YAML between the fences or None, body). A fence is a line --- with nothing but blanks after it."""
    lines = _LINE.split(text)
    if lines[0].rstrip() != "---":
        return None, text
    close = next((k for k, line in enumerate(lines) if k and line.rstrip() == "---"), None)
    if close is None:
        raise Rejected("yaml_parse_error", "Delimiter `---` for end of frontmatter not found")
    body = "\n".join(lines[close + 1 :])
    return ("\n".join(lines[1:close]) if close > 1 else None), body


#: Names of the kinds of values in messages.
TYPE_NAMES = {type(None): "NoneType", bool: "bool", str: "str", int: "int", float: "float", list: "list", dict: "dict"}


def decode_one(text: str, profile: str) -> tuple:
    """A row of DECODED for one text."""
    try:
        if profile == "pure-yaml":
            root = decode(text)
            return False, None, json.dumps(root, ensure_ascii=False), TYPE_NAMES[type(root)], None, None
        head, body = split_fence(text)
        if head is None:
            return False, body, None, None, None, None
        root = decode(head)
        if not isinstance(root, dict):
            raise Rejected("yaml_parse_error", f"Expected YAML metadata to be a dict, got {TYPE_NAMES[type(root)]}")
        return True, body, json.dumps(root, ensure_ascii=False), "dict", None, None
    except Rejected as e:
        return None, None, None, None, e.code, str(e)


def decode_text(text: Column | str, profile: str = "frontmatter-md") -> Column:
    """struct DECODED of a text column; null stays null. root_json keeps the document's key order."""

    @F.arrow_udf(DECODED)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = ["has_frontmatter", "body", "root_json", "root_type", "kind", "message"]
        kinds = [pa.bool_(), *[pa.string()] * 5]
        for batch in batches:
            rows = [decode_one(t.as_py(), profile) if t.is_valid else (None,) * 6 for t in batch]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return run(text)


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, length, modified, content of each file below path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select("path", "length", F.col("modificationTime").alias("modified"), "content")


def decode_files(files: DataFrame, profile: str = "frontmatter-md") -> DataFrame:
    """files(path, content) with the columns of DECODED; content that is no UTF-8 has kind artifact_invalid_utf8.

    Files that have a kind already, as those that read_folder() can't read, keep it and its message."""
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    text = F.when(valid, F.col("content").cast("string"))
    rest = [F.col(f"`{c}`") for c in files.columns if c not in ("content", "kind", "message")]
    before = [F.col(c).alias(f"{c}_") if "kind" in files.columns else F.lit(None).cast("string").alias(f"{c}_") for c in ("kind", "message")]
    decoded = files.select(*rest, *before, valid.alias("utf8"), decode_text(text, profile).alias("d"))
    known, bad = F.col("kind_").isNotNull(), ~F.col("utf8")
    return decoded.select(
        *rest, "d.has_frontmatter", "d.body", "d.root_json", "d.root_type",
        F.when(known, F.col("kind_")).when(bad, "artifact_invalid_utf8").otherwise(F.col("d.kind")).alias("kind"),
        F.when(known, F.col("message_")).when(bad, "input is not valid UTF-8").otherwise(F.col("d.message")).alias("message"),
    )


def decode_table(table: DataFrame, text_col: str, profile: str = "frontmatter-md") -> DataFrame:
    """table with the columns of DECODED in place of its text column."""
    rest = [F.col(f"`{c}`") for c in table.columns if c != text_col]
    return table.select(*rest, decode_text(F.col(f"`{text_col}`"), profile).alias("d")).select(*rest, "d.*")


def from_roots(table: DataFrame, root_col: str, guard: bool = False) -> DataFrame:
    """table with the columns of DECODED in place of a column of roots that are decoded already, as JSON text.

    Nothing is reopened and the portable rules don't apply, unless guard asks for them; text that is no JSON is yaml_parse_error."""

    @F.arrow_udf(DECODED)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kinds = pa.struct([("has_frontmatter", pa.bool_()), *[(c, pa.string()) for c in ("body", "root_json", "root_type", "kind", "message")]])

        def one(text: str) -> dict:
            try:
                root = json.loads(text)
                if guard:
                    check_portable(root)
                return {"has_frontmatter": True, "root_json": text, "root_type": TYPE_NAMES[type(root)]}
            except Rejected as e:
                return {"kind": e.code, "message": str(e)}
            except (ValueError, RecursionError) as e:
                return {"kind": "yaml_parse_error", "message": str(e)}

        for batch in batches:
            yield pa.array([one(t.as_py()) if t.is_valid else {} for t in batch], kinds)

    rest = [F.col(f"`{c}`") for c in table.columns if c != root_col]
    return table.select(*rest, run(F.col(f"`{root_col}`")).alias("d")).select(*rest, "d.*")


def text_of(files: DataFrame) -> DataFrame:
    """path, text, raw: the files' content with every line's end as \\n, and as it is; what is no UTF-8 is null."""
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    return files.select("path", F.regexp_replace(text, r"\r\n?", "\n").alias("text"), text.alias("raw"))


def missing_files(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Paths of the manifest that no file has: kind artifact_unreadable."""
    return manifest.join(files.select("path"), "path", "left_anti").select(
        "path", F.lit("artifact_unreadable").alias("kind"),
        F.concat(F.lit("no file at "), F.col("path")).alias("message"),
    )
