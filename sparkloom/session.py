"""Session builder, scoped configuration and SQL over explicitly named frames."""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Settings that every result in this package relies on (UTC, ANSI) or that suit wide clusters (AQE).
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(app: str = "sparkloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with this package's defaults; ``conf`` uses ``__`` for dots (``spark__sql__ansi__enabled``)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}
    if (master or "").startswith("local"):
        settings.setdefault("spark.sql.shuffle.partitions", str(os.cpu_count() or 8))
    return builder.config(map=settings).getOrCreate()


@contextmanager
def scoped_conf(spark: SparkSession, **conf: object) -> Iterator[SparkSession]:
    """Set runtime options for a ``with`` block and put the old values back afterwards, also after an error."""
    names = {k.replace("__", "."): str(v) for k, v in conf.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield spark
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def sql(spark: SparkSession, query: str, **frames: DataFrame) -> DataFrame:
    """Run SQL in which ``{name}`` stands for the frame passed as ``name``; other names resolve in the catalog."""
    return spark.sql(query, **frames)
