"""Values that come from elsewhere than documents, checked by a schema, a model or both; results as JSON lines."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomline.plans.columns import column, number_text

from .validate import Contract, as_json, fractions, validate_rows


def model_errors(text: Column, model: type) -> Column:
    """array<string>: the model's errors on JSON texts, each as JSON; null texts have none."""

    @F.arrow_udf("array<string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from pydantic import ValidationError

        def errors(value: str) -> list[str]:
            try:
                model.model_validate(json.loads(value))
            except ValidationError as e:
                return [json.dumps(x, default=str, ensure_ascii=False) for x in e.errors(include_url=False)]
            return []

        for batch in batches:
            yield pa.array([errors(t.as_py()) if t.is_valid else [] for t in batch], pa.list_(pa.string()))

    return run(text)


def validate_values(df: DataFrame, schema: Contract | None = None, model: type | None = None, column: str | None = None) -> DataFrame:
    """df with structural_ok, violations, semantic_ok, semantic_errors, ok; what was not asked for is ok. Neither: ValueError."""
    if schema is None and model is None:
        raise ValueError("validate_values() needs a schema, a model or both")
    none = F.array().cast("array<string>")
    errors = model_errors(as_json(df, column, texts=True), model) if model is not None else none
    checked = validate_rows(df, schema, column) if schema is not None else df.withColumn("violations", none)
    out = checked.withColumn("semantic_errors", errors)
    out = out.withColumn("structural_ok", F.size("violations") == 0).withColumn("semantic_ok", F.size("semantic_errors") == 0)
    return out.withColumn("ok", F.col("structural_ok") & F.col("semantic_ok"))


def _whole(c: Column, kind: T.DataType) -> Column:
    """A value in which doubles are VARIANT numbers, so that JSON has whole ones without a fraction."""
    match kind:
        case T.DoubleType() | T.FloatType():
            return F.try_parse_json(number_text(c.cast("double")))
        case T.ArrayType() if fractions(kind):
            return F.transform(c, lambda x: _whole(x, kind.elementType))
        case T.MapType() if fractions(kind):
            return F.transform_values(c, lambda _, v: _whole(v, kind.valueType))
        case T.StructType() if fractions(kind):
            return F.when(c.isNotNull(), F.struct(*[_whole(c[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    return c


def results_json(results: DataFrame) -> DataFrame:
    """A column json: each row with its keys sorted, nulls kept, whole floats as integers, ready for write.text."""
    parts = [_whole(column(c), results.schema[c].dataType).alias(c) for c in sorted(results.columns)]
    return results.select(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}).alias("json"))
