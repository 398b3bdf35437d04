"""Generated sections: marker blocks of texts, what they should say by their schema, and drift. Column expressions throughout."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.functions.vocab import Dialect

from .fields import SchemaFields, fields_of
from .schemas import TEXT, catalogue, mapped

KINDS = ("enum_table", "field_list", "vocab")
KNOWN = ("kind", "schema", "pointer", "sha256")
# How an attribute of a marker is written, the marker's own shape below, and what sections without fields say.
NO_ENUMS, NO_FIELDS = "| _(no enum fields)_ | _(none)_ |", "- _(no fields)_"
_ATTRIBUTE = r'([A-Za-z_][A-Za-z0-9_]*)="([^"]*)"'


def enum_table(fields: SchemaFields) -> str:
    rows = [f"| `{f.name}` | {', '.join(v.replace('|', chr(92) + '|') for v in f.enum)} |" for f in fields.all() if f.enum is not None]
    return "\n".join(["| Field | Allowed values |", "| --- | --- |", *(rows or [NO_ENUMS])])


def field_list(fields: SchemaFields) -> str:
    """Fields of the root only."""
    rows = [f"- `{f.name}` ({f.json_type or 'object'}, {'required' if f.required else 'optional'})" + (f": {f.description}" if f.description else "") for f in fields.all() if f.pointer.count("/properties/") == 1]
    return "\n".join(rows or [NO_FIELDS])


def vocab(values: list[str]) -> str:
    return "\n".join(f"- `{v}`" for v in values)


def bodies(fields: SchemaFields) -> Iterator[tuple[str, str, str]]:
    """(kind, pointer, body): all that sections over a schema can say."""
    yield "enum_table", "", enum_table(fields)
    yield "field_list", "", field_list(fields)
    for f in fields.all():
        if f.enum is not None:
            yield "vocab", f.pointer, vocab(f.enum)


def rendered(schemas: DataFrame, dialect: Dialect = Dialect()) -> DataFrame:
    """schema_ref, r_kind, r_pointer, body of a catalogue's schemas."""

    def make(ref: str, text: str) -> Iterator[tuple]:
        if (fields := fields_of(text, dialect)) is not None:
            yield from bodies(fields)

    return mapped(schemas, make, {"r_kind": TEXT, "r_pointer": TEXT, "body": TEXT})


def _patterns(dialect: Dialect) -> tuple[str, str]:
    mark = re.escape(dialect.marker)
    opens = rf"<!--\s*{mark}\s+([^>]*?)\s*-->"
    return opens, rf"(?s)(<!--\s*{mark}\s+[^>]*?\s*-->)(.*?)<!-- /{mark} -->"


def _attribute(attrs: Column, name: str) -> Column:
    """The last value given to the attribute."""
    keys, values = (F.regexp_extract_all(attrs, F.lit(_ATTRIBUTE), F.lit(k)) for k in (1, 2))
    hits = F.filter(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda a: a["k"] == name)
    return F.when(F.size(hits) > 0, F.element_at(hits, -1)["v"])


def sections(docs: DataFrame, text_col: str = "text", keys: tuple[str, ...] = ("path",), dialect: Dialect = Dialect()) -> DataFrame:
    """keys, section_no, open_marker, kind, schema, pointer, existing, error: a row per block, in order; a text whose last
    marker is not closed has a row with error and no section_no."""
    opens, block = _patterns(dialect)
    text = F.col(text_col)
    pairs = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(block), F.lit(1)).alias("open"),
        F.regexp_extract_all(text, F.lit(block), F.lit(2)).alias("existing"),
    )
    rest = F.regexp_replace(text, block, "")
    stray = F.regexp_extract(rest, opens, 0)
    found = docs.select(*keys, F.posexplode_outer(pairs)).where("pos is not null").select(
        *keys, F.col("pos").alias("section_no"), F.col("col.open").alias("open_marker"),
        F.col("col.existing").alias("existing"),
    )
    attrs = F.regexp_extract("open_marker", opens, 1)
    names = F.regexp_extract_all(attrs, F.lit(_ATTRIBUTE), F.lit(1))
    unknown = F.array_sort(F.array_distinct(F.array_except(names, F.array(*map(F.lit, (*KNOWN, "contract"))))))
    kind, schema = _attribute(attrs, "kind"), _attribute(attrs, "schema")
    mark = dialect.marker
    error = (
        F.when(F.array_contains(names, "contract"), F.lit(f"{mark}: a marker names its schema by 'schema', not by 'contract'"))
        .when(F.size(unknown) > 0, F.concat(F.lit(f"{mark}: attributes that no marker has: "), F.concat_ws(", ", unknown)))
        .when(F.coalesce(kind, F.lit("")) == "", F.concat(F.lit(f"{mark}: no 'kind' in "), F.col("open_marker")))
        .when(F.coalesce(schema, F.lit("")) == "", F.concat(F.lit(f"{mark}: no 'schema' in "), F.col("open_marker")))
        .when(~kind.isin(*KINDS), F.concat(F.lit(f"{mark}: kind '"), kind, F.lit(f"' is none of {', '.join(sorted(KINDS))}")))
    )
    good = found.select(
        *keys, "section_no", "open_marker", kind.alias("kind"), schema.alias("schema"),
        _attribute(attrs, "pointer").alias("pointer"), "existing", error.alias("error"),
    )
    where = F.locate(stray, text) if isinstance(stray, str) else F.instr(text, stray)
    null = F.lit(None).cast("string")
    bad = docs.where(stray != "").select(
        *keys, F.lit(None).cast("int").alias("section_no"), stray.alias("open_marker"), null.alias("kind"), null.alias("schema"), null.alias("pointer"), null.alias("existing"),
        F.concat(F.lit(f"{mark}: no end for the marker at offset "), (where - 1).cast("string")).alias("error"),
    )
    return good.unionByName(bad)


def drift(found: DataFrame, schemas: dict[str, dict] | DataFrame, dialect: Dialect = Dialect()) -> DataFrame:
    """sections() with rendered and drift; a schema or enum that is not there is an error of the section.

    schemas: by reference, or a catalogue: sections meet what their schemas say in one join, the schemas' names in another."""
    known = catalogue(found.sparkSession, schemas)
    pointer = F.when(F.col("kind") == "vocab", F.coalesce("pointer", F.lit(""))).otherwise(F.lit(""))
    said = rendered(known, dialect).withColumnRenamed("schema_ref", "r_schema")
    joined = found.join(
        said, (F.col("schema") == F.col("r_schema")) & (F.col("kind") == F.col("r_kind")) & (pointer == F.col("r_pointer")), "left",
    ).join(known.select(F.col("schema_ref").alias("r_there")).distinct(), F.col("schema") == F.col("r_there"), "left")
    there = F.col("r_there").isNotNull()
    error = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(~there, F.concat(F.lit(f"{dialect.marker}: no schema named "), F.col("schema")))
        .when((F.col("kind") == "vocab") & (pointer == ""), F.lit(f"{dialect.marker}: a vocab section needs a 'pointer'"))
        .when(F.col("body").isNull(), F.concat(F.lit(f"{dialect.marker}: no values are listed at '"), F.col("pointer"), F.lit("'")))
    )
    text = F.concat(F.lit("\n"), F.col("body"), F.lit("\n"))
    return joined.withColumn("error", error).withColumn("rendered", F.when(error.isNull(), text)).withColumn("drift", F.when(error.isNull(), text != F.col("existing"))).drop("r_schema", "r_kind", "r_pointer", "r_there", "body")


#: Fixed value: what is said of a section whose text is not its schema's.
DRIFTED = "{path}: section {kind} drifted"


def drift_by_document(drifted: DataFrame, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """keys, sections, drift, errors, drift_details (a text for each section that has drifted, in order) per document."""
    before, _, after = DRIFTED.partition("{path}")[2].partition("{kind}")
    said = F.concat(F.col(keys[0]).cast("string"), F.lit(before), F.coalesce("kind", F.lit("?")), F.lit(after))
    found = drifted.groupBy(*keys).agg(
        F.count("section_no").alias("sections"), F.coalesce(F.bool_or("drift"), F.lit(False)).alias("drift"),
        F.count("error").alias("errors"), F.array_sort(F.collect_list(F.when(F.col("drift"), F.struct("section_no", said.alias("said"))))).alias("drift_details"),
    )
    return found.withColumn("drift_details", F.transform("drift_details", lambda d: d["said"]))


def _place(marker: Column, dialect: Dialect) -> tuple[Column, Column, Column]:
    """Kind, schema and pointer of a marker; the pointer is empty but for a vocab section's."""
    attrs = F.regexp_extract(marker, _patterns(dialect)[0], 1)
    kind = _attribute(attrs, "kind")
    return kind, _attribute(attrs, "schema"), F.when(kind == "vocab", F.coalesce(_attribute(attrs, "pointer"), F.lit(""))).otherwise(F.lit(""))


def regenerate(docs: DataFrame, schemas: dict[str, dict] | DataFrame, text_col: str = "text", dialect: Dialect = Dialect(), keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """docs with regenerated: the text with every section as its schema says; a text with a faulty section stays as it is.

    Schemas that the driver holds are constants of the plan: no join, no shuffle. With a catalogue the markers meet what
    their schemas say in one join, and their documents, by keys that no two rows share, in another."""
    _, block = _patterns(dialect)
    text, marks = F.col(text_col), F.regexp_extract_all(F.col(text_col), F.lit(block), F.lit(1))
    end = F.lit(f"\n<!-- /{dialect.marker} -->")
    if isinstance(schemas, DataFrame):
        listed = docs.select(*keys, F.posexplode(marks).alias("at_", "marker_"))
        kind, schema, pointer = _place(F.col("marker_"), dialect)
        said = rendered(catalogue(docs.sparkSession, schemas), dialect).select(F.col("schema_ref").alias("r_schema"), "r_kind", "r_pointer", "body")
        named = listed.withColumns({"kind_": kind, "schema_": schema, "pointer_": pointer})
        met = named.join(said, (F.col("schema_") == F.col("r_schema")) & (F.col("kind_") == F.col("r_kind")) & (F.col("pointer_") == F.col("r_pointer")), "left")
        made = F.transform(F.array_sort(F.collect_list(F.struct("at_", F.concat("marker_", F.lit("\n"), "body", end).alias("made")))), lambda x: x["made"])
        by_doc = met.groupBy(*keys).agg(made.alias("made_"))
        docs, made = docs.join(by_doc, list(keys), "left"), F.coalesce("made_", F.array().cast("array<string>"))
    else:
        all_ = [(ref, *b) for ref, schema in schemas.items() for b in bodies(SchemaFields(schema, dialect))]
        known = F.create_map(*[F.lit(x) for s, k, p, b in all_ for x in ("\x1f".join((s, k, p)), b)]) if all_ else F.create_map(F.lit(""), F.lit(None).cast("string"))

        def one(marker: Column) -> Column:
            kind, schema, pointer = _place(marker, dialect)
            return F.concat(marker, F.lit("\n"), F.try_element_at(known, F.concat_ws("\x1f", schema, kind, pointer)), end)

        made = F.transform(marks, one)
    pieces = F.split(text, block, -1)
    whole = F.array_join(F.flatten(F.zip_with(pieces, made, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    return docs.withColumn("regenerated", F.when(F.exists(made, lambda m: m.isNull()), text).otherwise(whole)).drop("made_")


def rewritten(docs: DataFrame, schemas: dict[str, dict] | DataFrame, text_col: str = "text", dialect: Dialect = Dialect()) -> DataFrame:
    """regenerate()'s rows whose text it changes: what there is to write."""
    return regenerate(docs, schemas, text_col, dialect).where(F.col("regenerated") != F.col(text_col))
