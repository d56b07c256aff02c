"""Materialising and looking at frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.storagelevel import StorageLevel


def materialized(df: DataFrame) -> DataFrame:
    """The same frame, computed now and kept by the executors (memory, then disk) until it is unpersisted; the driver gets no rows."""
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    kept.count()
    return kept


def to_pydict(df: DataFrame, limit: int = 100_000) -> dict[str, list]:
    """Columns as lists on the driver; an error for a frame of more than ``limit`` rows, which does not belong there."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows")
    return {c: [r[k] for r in rows] for k, c in enumerate(df.columns)}


def show_text(df: DataFrame, n: int = 8, max_width: int | None = 30) -> str:
    """The first rows as a text table, cells cut at ``max_width``."""
    return df._jdf.showString(n, max_width or 0, False)


def explain_text(df: DataFrame, mode: str = "formatted") -> str:
    """The plan as text: simple, extended, codegen, cost or formatted."""
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


def num_partitions(df: DataFrame) -> int:
    return df.rdd.getNumPartitions()


def sample_fraction(df: DataFrame, fraction: float, seed: int = 0) -> DataFrame:
    return df.sample(fraction=fraction, seed=seed)


def into_batches(df: DataFrame, rows: int) -> DataFrame:
    """Hand user functions batches of at most ``rows`` rows (a setting of the session from here on)."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return df
