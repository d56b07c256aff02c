"""Time-series signals over bars of (key, day, close) as chained window functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def daily_bars(events: DataFrame) -> DataFrame:
    """Events (user_id, ts, value) as daily bars: ticker, day, open, high, low, close, volume."""
    day = F.date_format("ts", "yyyy-MM-dd").alias("day")
    return events.groupBy(F.col("user_id").alias("ticker"), day).agg(
        F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close"), F.count("*").alias("volume")
    )


def by_ticker(*order: str):
    return Window.partitionBy("ticker").orderBy(*(order or ("day",)))


def daily_return(bars: DataFrame) -> DataFrame:
    """prev_close and daily_return; a return on 0 is what IEEE 754 says (infinite, or NaN for 0 on 0), no null and no error."""
    before = F.lag("close").over(by_ticker())
    change = F.col("close") - F.col("prev_close")
    # The power keeps the sign of a zero; where it is taken, the division isn't.
    by_zero = F.when(F.col("prev_close") == 0, change * F.pow("prev_close", F.lit(-1.0)))
    return bars.withColumn("prev_close", before).withColumn("daily_return", by_zero.otherwise(F.try_divide(change, F.col("prev_close"))))


def moving_averages(bars: DataFrame, short: int = 5, long: int = 20) -> DataFrame:
    """Means over the last ``short`` and ``long`` rows, this one included."""
    means = {f"ma{n}": F.avg("close").over(by_ticker().rowsBetween(-(n - 1), 0)) for n in (short, long)}
    return bars.withColumns(means)


def cross_signals(bars: DataFrame, short: int = 5, long: int = 20) -> DataFrame:
    """signal: golden where the short mean rises above the long one, death where it falls below, else null."""
    a, b = F.col(f"ma{short}"), F.col(f"ma{long}")
    out = moving_averages(bars, short, long).withColumn("above", a > b)
    was = F.lag("above").over(by_ticker())
    return out.withColumn("signal", F.when(F.col("above") & ~was, "golden").when(~F.col("above") & was, "death"))


def running(bars: DataFrame) -> DataFrame:
    """Cumulative volume, the running minimum of close, and the first close."""
    upto = by_ticker().rowsBetween(Window.unboundedPreceding, 0)
    return bars.withColumns({"cum_volume": F.sum("volume").over(upto), "running_min": F.min("close").over(upto), "first_close": F.first("close").over(upto)})


def fractional_range_mean(df: DataFrame, key: str, t: str, value: str, span: float, name: str, spans: int = 64) -> DataFrame:
    """Mean of value over rows of the key within ``span`` before t; the frame may be fractional, which only SQL text takes.

    A key is no task: its rows are dealt to stretches of t of ``spans`` spans, and those that the frames of the next stretch reach into go
    there too, to be looked at only.
    """
    width = span * spans
    stretch = F.floor(F.col(f"`{t}`") / width)
    reaches = F.floor((F.col(f"`{t}`") + span * (1 + 1e-9)) / width)
    rows = df.withColumn("_at", F.explode(F.array_distinct(F.array(stretch, reaches)))).withColumn("_own", F.col("_at").eqNullSafe(stretch))
    out = rows.withColumn(name, F.expr(f"avg(`{value}`) over (partition by `{key}`, _at order by `{t}` range between {span} preceding and current row)"))
    return out.filter("_own").drop("_at", "_own")
