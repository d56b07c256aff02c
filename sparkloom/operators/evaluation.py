"""Evaluation: ablation quadrants, reports, pair grids and Elo ratings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of the four outcomes with and without the input under test.
QUADRANTS = ("Both Correct", "Image Helped", "Image Hurt", "Both Incorrect")


def quadrant(with_input: Column, without: Column) -> Column:
    """Which of the four outcomes; a null correctness counts as both incorrect."""
    return F.when(with_input & without, QUADRANTS[0]).when(with_input & ~without, QUADRANTS[1]).when(~with_input & without, QUADRANTS[2]).otherwise(QUADRANTS[3])


def report(results: DataFrame, by: str, with_input: str, without: str, total: str = "ALL") -> DataFrame:
    """Per subset and over all: rows, accuracies, counts of the quadrants, help, hurt and net rates."""
    a, b = F.col(with_input), F.col(without)
    kind = quadrant(a, b)
    counts = {"both_correct": 0, "helped": 1, "hurt": 2, "both_incorrect": 3}
    cells = [F.sum((kind == QUADRANTS[k]).cast("long")).alias(n) for n, k in counts.items()]
    out = results.rollup(by).agg(
        F.grouping(by).alias("_g"), F.count("*").alias("rows"), F.avg(a.cast("double")).alias("accuracy"), F.avg(b.cast("double")).alias("accuracy_without"), *cells
    )
    rates = {
        "help_rate": F.try_divide(F.col("helped"), F.col("helped") + F.col("both_incorrect")),
        "hurt_rate": F.try_divide(F.col("hurt"), F.col("hurt") + F.col("both_correct")),
        "net_rate": F.try_divide(F.col("helped") - F.col("hurt"), F.col("rows")),
    }
    return out.withColumns(rates).withColumn(by, F.when(F.col("_g") == 1, F.lit(total)).otherwise(F.col(by))).drop("_g")


def pair_grid(responses: DataFrame, on: list[str], model: str, response: str) -> DataFrame:
    """Each unordered pair of different models' responses to the same prompt, once."""
    a = responses.select(*on, F.col(model).alias("model_a"), F.col(response).alias("response_a"))
    b = responses.select(*on, F.col(model).alias("model_b"), F.col(response).alias("response_b"))
    return a.join(b, on).filter("model_a < model_b")


def verdict(c: Column) -> Column:
    """A judge's answer as A, B or TIE: blanks, case and full stops don't matter, anything else is a tie."""
    plain = F.regexp_replace(F.upper(F.trim(c)), r"\.", "")
    return F.when(plain.isin("A", "B"), plain).otherwise("TIE")


def elo(pairs: DataFrame, order: list[str], by: str | None = None, start: float = 1000.0, k: float = 32.0) -> DataFrame:
    """(model, rating[, by]): ratings after all rows (model_a, model_b, verdict), played in the given total order.

    Each game changes what the next one reads, so a series is played in one task: matches of one leaderboard, not a corpus. With
    ``by`` each value has its own series, and these run in parallel.
    """
    key = by or "_all"
    rows = pairs if by else pairs.withColumn(key, F.lit(1))
    schema = f"`{key}` {dict(rows.dtypes)[key]}, model string, rating double"

    def play(pdf: pd.DataFrame) -> pd.DataFrame:
        rating: dict[str, float] = {}
        for r in pdf.sort_values(order, kind="stable").itertuples():
            a, b = rating.setdefault(r.model_a, start), rating.setdefault(r.model_b, start)
            expected = 1 / (1 + 10 ** ((b - a) / 400))
            got = {"A": 1.0, "B": 0.0}.get(r.verdict, 0.5)
            rating[r.model_a] = a + k * (got - expected)
            rating[r.model_b] = b - k * (got - expected)
        return pd.DataFrame({key: pdf[key].iloc[0], "model": list(rating), "rating": list(rating.values())})

    out = rows.select(*dict.fromkeys([key, *order, "model_a", "model_b", "verdict"])).groupBy(key).applyInPandas(play, schema)
    return out if by else out.drop(key)


def parse_answer(c: Column, pattern: str = r"(?i)answer\s*[:=]\s*\(?([A-Z])\)?") -> Column:
    """The letter that an answer text names, null without one."""
    return F.upper(F.nullif(F.regexp_extract(c, pattern, 1), F.lit("")))
