"""Relational operators that take more than one built-in call."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def join_suffix(left: DataFrame, right: DataFrame, on: Sequence[str] | str, how: str = "inner", suffix: str = "_r", strategy: str | None = None) -> DataFrame:
    """Equi-join on equal-named keys; other right columns whose name clashes get the suffix. strategy: a join hint such as shuffle_hash."""
    on = [on] if isinstance(on, str) else list(on)
    if how not in ("left_semi", "left_anti", "semi", "anti"):
        clash = {c: c + suffix for c in right.columns if c in left.columns and c not in on}
        right = right.withColumnsRenamed(clash)
    if strategy:
        right = right.hint(strategy)
    return left.join(right, on, how)


def join_on(left: DataFrame, right: DataFrame, left_on: Sequence[str], right_on: Sequence[str], how: str = "inner", suffix: str = "_r", where=None) -> DataFrame:
    """Equi-join on differing names; both keys stay, clashing right names get the suffix. where: a function of (left, right) giving a residual condition."""
    clash = {c: c + suffix for c in right.columns if c in left.columns}
    right = right.withColumnsRenamed(clash)
    on = [left[a] == right[clash.get(b, b)] for a, b in zip(left_on, right_on, strict=True)]
    if where is not None:
        on.append(where(left, right))
    return left.join(right, reduce(lambda a, b: a & b, on), how)


def band_join(left: DataFrame, right: DataFrame, key: str, t: str, before: int, after: int, suffix: str = "_r") -> DataFrame:
    """Rows with equal key whose right t lies between left t - before and left t + after.

    Times fall into bands as wide as the range; each left row meets the two or three bands that its range touches, so that a
    key with many rows is compared band by band and not as a whole.
    """
    width = max(1, before + after)
    clash = {c: c + suffix for c in right.columns if c in left.columns}
    rt = clash.get(t, t)
    right = right.withColumnsRenamed(clash).withColumn("_band", F.floor(F.col(rt) / width))
    bands = F.sequence(F.floor((F.col(t) - before) / width), F.floor((F.col(t) + after) / width))
    left = left.withColumn("_band_l", F.explode(bands))
    on = (left[key] == right[clash.get(key, key)]) & (left["_band_l"] == right["_band"]) & right[rt].between(left[t] - before, left[t] + after)
    return left.join(right, on).drop("_band", "_band_l")


def zip_explode(df: DataFrame, *cols: str, outer: bool = False) -> DataFrame:
    """Lists of one row side by side, a row per place; rows with empty or null lists go unless ``outer``."""
    packed = F.arrays_zip(*[F.col(f"`{c}`") for c in cols])
    rest = [F.col(f"`{c}`") for c in df.columns if c not in cols]
    each = (F.explode_outer if outer else F.explode)(packed).alias("_z")
    return df.select(*rest, each).select(*rest, *[F.col("_z")[c].alias(c) for c in cols])


def unnest(df: DataFrame, column: str) -> DataFrame:
    """A struct column's fields as columns, in its place."""
    out = []
    for c in df.columns:
        out.append(F.col(f"`{c}`.*") if c == column else F.col(f"`{c}`"))
    return df.select(*out)


def exclude(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in names])


def top_k_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group, with their place; the order must be total for reruns to agree."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn(rank, place).filter(F.col(rank) <= k)


def latest_per_key(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return top_k_per_group(df, by, order, 1, "_place").drop("_place")


def majority_vote(df: DataFrame, by: Sequence[str], label: str) -> DataFrame:
    """Each group's most frequent label, the least on ties, with its votes."""
    votes = df.groupBy(*by, label).agg(F.count("*").alias("votes"))
    return votes.groupBy(*by).agg(F.min(F.struct((-F.col("votes")).alias("v"), F.col(label).alias("l"))).alias("x")).select(*by, F.col("x.l").alias(label), (-F.col("x.v")).alias("votes"))


def pivot_with_total(df: DataFrame, by: str, pivot: str, values: Sequence[str], value: str, total: str = "ALL") -> DataFrame:
    """Sums of value by group and pivot value, in fixed columns, and a last row over all; missing cells are 0."""
    cells = [F.sum(F.when(F.col(pivot) == v, F.col(value)).otherwise(0)).alias(v) for v in values]
    return df.rollup(by).agg(F.grouping(by).alias("_g"), *cells).select(F.when(F.col("_g") == 1, F.lit(total)).otherwise(F.col(by)).alias(by), *values)


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two frames hold the same distinct rows."""
    a, b = a.distinct(), b.select(a.columns).distinct()
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def describe(df: DataFrame, *cols: str) -> DataFrame:
    """A row per column: count, mean, stddev, min, max."""
    one = [F.struct(F.lit(c).alias("name"), F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev(c).alias("stddev"), F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max")) for c in cols]
    return df.agg(F.array(*one).alias("_x")).select(F.inline("_x"))


def with_stable_id(df: DataFrame, *cols: str, name: str = "id") -> DataFrame:
    """An id from the given columns' values: the same on every run and partitioning, unlike ``monotonically_increasing_id``."""
    return df.withColumn(name, F.xxhash64(*[F.col(f"`{c}`") for c in (cols or df.columns)]))
