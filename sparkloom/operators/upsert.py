"""Keyed upserts into Parquet tables and the small reports made from them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.sources.manifest import newest


def typed(df: DataFrame) -> DataFrame:
    """Columns of type null as strings, so that the table can be written."""
    return df.withColumns({c: F.col(f"`{c}`").cast("string") for c, kind in df.dtypes if kind == "void"}) if any(k == "void" for _, k in df.dtypes) else df


def upsert(existing: DataFrame | None, new: DataFrame, keys: list[str], dedupe: bool = False) -> DataFrame:
    """Existing rows whose key is not among the new ones, and all new rows. Null keys never match. dedupe: one new row per key, the greatest by all columns."""
    new = typed(new)
    if dedupe:
        new = newest(new, keys)
    if existing is None:
        return new
    return existing.join(new.select(keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def replace_table(df: DataFrame, path: str) -> None:
    """Write beside ``path`` and swap by renames, so that the plan may read what it replaces. One writer at a time."""
    spark = df.sparkSession
    staged, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    typed(df).write.parquet(staged)
    fs, target = _fs(spark, path)
    if fs.exists(target):
        fs.rename(target, _fs(spark, old)[1])
    fs.rename(_fs(spark, staged)[1], target)
    fs.delete(_fs(spark, old)[1], True)
    spark.catalog.refreshByPath(path)


def upsert_path(spark: SparkSession, path: str, new: DataFrame, keys: list[str], dedupe: bool = False) -> None:
    """Upsert into a Parquet directory, made if missing."""
    fs, p = _fs(spark, path)
    replace_table(upsert(spark.read.parquet(path) if fs.exists(p) else None, new, keys, dedupe), path)


def trailing_mean(df: DataFrame, by: list[str], order: str, value: str, rows: int = 7, name: str = "trailing_mean") -> DataFrame:
    """Mean over up to ``rows`` rows that end at this one, to one decimal."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-(rows - 1), 0)
    return df.withColumn(name, F.round(F.avg(value).over(w), 1))


def scorecard(daily: DataFrame, by: list[str], day: str, value: str, goal: float, rows: int = 7) -> DataFrame:
    """Each key's latest day, its trailing mean and that mean as a percentage of a goal."""
    means = trailing_mean(daily, by, day, value, rows, "mean_value")
    latest = means.groupBy(*by).agg(F.max_by(F.struct(day, value, "mean_value"), day).alias("x")).select(*by, "x.*")
    return latest.withColumn("pct_of_goal", F.round(100 * F.col("mean_value") / goal, 2))


def new_rows(source: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key has not been handled yet."""
    return source.join(done.select(keys).distinct(), keys, "left_anti")
