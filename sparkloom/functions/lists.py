"""List, JSON, hash and time expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def chunk_list(c: str | Column, size: int, count: int) -> Column:
    """``count`` consecutive lists of ``size`` elements each."""
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.slice(_c(c), i * size + 1, size))


def list_min(c: str | Column) -> Column:
    return F.array_min(_c(c))


def list_join(c: str | Column, delimiter: str = "") -> Column:
    """Elements as one string; nulls are left out."""
    return F.array_join(_c(c), delimiter)


def ordered_list(order: str | Column, value: str | Column) -> Column:
    """Aggregate: the values of a group in the order of another column, ties by value, so that reruns agree."""
    pairs = F.array_sort(F.collect_list(F.struct(_c(order).alias("o"), _c(value).alias("v"))))
    return F.transform(pairs, lambda x: x["v"])


def json_query(c: str | Column, path: str) -> Column:
    """A jq-style path (``.choices[0].message.content``) into JSON text, as text; null where there is nothing."""
    return F.get_json_object(_c(c), "$" + path)


def json_struct(c: str | Column, schema: str) -> Column:
    """JSON text as a struct of the given schema; null fields for what is absent."""
    return F.from_json(_c(c), schema)


def hash64(*cs: str | Column) -> Column:
    """64-bit xxHash as a signed integer."""
    return F.xxhash64(*[_c(c) for c in cs])


def epoch_millis(c: str | Column) -> Column:
    """Integer milliseconds since 1970 as a timestamp (``cast`` alone means seconds)."""
    return F.timestamp_millis(_c(c))


def timestamp_text(t: str | Column) -> Column:
    """``2024-01-31 08:00:00.250`` in any year: the pattern ``yyyy`` would write a plus before years beyond 9999, and lose the sign of those before 0."""
    year = F.year(_c(t))
    padded = F.when(year.between(0, 9999), F.lpad(year.cast("string"), 4, "0")).otherwise(year.cast("string"))
    return F.concat(padded, F.date_format(_c(t), "-MM-dd HH:mm:ss.SSS"))
