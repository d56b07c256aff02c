"""JSON text as VARIANT: parsed once, its schema found from the data, and paths taken out with types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parsed(c: str | Column) -> Column:
    """JSON text as a variant; null for null and for text that isn't JSON."""
    return F.try_parse_json(c)


def path(v: str | Column, at: str, kind: str) -> Column:
    """The value at a path (``$.items[0].sku``), null where there is none or where it can't be of this type."""
    return F.try_variant_get(v, at, kind)


def json_columns(df: DataFrame, column: str, paths: dict[str, tuple[str, str]], malformed: str | None = None) -> DataFrame:
    """``df`` with a column for each path (name: path and type), the text parsed once; ``malformed`` names a flag for text that isn't JSON."""
    rows = df.withColumn("_v", parsed(F.col(f"`{column}`")))
    out = {name: path(F.col("_v"), at, kind) for name, (at, kind) in paths.items()}
    if malformed:
        out[malformed] = F.col(f"`{column}`").isNotNull() & F.col("_v").isNull()
    return rows.withColumns(out).drop("_v")


def schema_of(df: DataFrame, column: str) -> str:
    """The schema that all JSON texts of a column share, in the form of ``schema_of_variant``; kinds that contradict one another are VARIANT."""
    return df.agg(F.schema_of_variant_agg(parsed(F.col(f"`{column}`"))).alias("s")).first()["s"]


def shredded(df: DataFrame, column: str, name: str = "value") -> DataFrame:
    """``df`` with the JSON of a column as a struct whose schema the data gives; fields that no text agrees on stay variants."""
    kind = schema_of(df, column).replace("OBJECT<", "STRUCT<")
    if kind in ("VOID", "VARIANT"):
        return df.withColumn(name, parsed(F.col(f"`{column}`")))
    return df.withColumn(name, F.try_variant_get(parsed(F.col(f"`{column}`")), "$", kind))
