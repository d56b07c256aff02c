"""Row numbers, ranks and running sums in a global order, or in groups of any size, without one task for all rows.

Rows are dealt to ranges of the order, and numbered and summed inside each. What the ranges before leave to a range is one small row a
range and group, which joins back. Groups and ties may span ranges: ranks go on where a tie does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.storage import materialize


def ordered_totals(
    df: DataFrame, order_by: list[str], then_by: list[str] | None = None, partition_by: list[str] | None = None, sums: dict[str, str] | None = None, ranges: int | None = None
) -> DataFrame:
    """``df`` with row_number, rank, dense_rank and, for each of ``sums`` (new column: column), the sum of all rows up to this one.

    Columns of ``order_by`` and ``then_by`` fall where their name has a minus before it. Rows equal in them are peers of one rank; ``then_by`` and then a
    hash of the whole row order peers for the numbers and sums, so that a value that half the rows have is dealt to several ranges too. Rows
    equal in all columns are numbered in any order. Nulls come as Spark sorts them and are peers of one another; null groups are a group.
    Sums skip nulls, and are null before the first value. The number of ranges is that of shuffle partitions by default.
    """
    spark, keys, sums = df.sparkSession, list(partition_by or []), sums or {}
    columns = list(df.columns)
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.withColumn("_tie", F.xxhash64(*[F.col(f"`{c}`") for c in columns if not dict(df.dtypes)[c].startswith(("map", "variant"))]))
    named = lambda c: F.col(f"`{c.removeprefix('-')}`")
    way = lambda c: named(c).desc() if c.startswith("-") else named(c).asc()
    group, order = [named(k) for k in keys], [*[way(c) for c in [*order_by, *(then_by or [])]], F.col("_tie").asc()]
    peers = F.struct(*[named(c).alias(f"c{i}") for i, c in enumerate(order_by)])
    dealt = materialize(rows.repartitionByRange(ranges, *group, *order).withColumn("_range", F.spark_partition_id()), "ranges")

    here = Window.partitionBy("_range", *group).orderBy(*order)
    upto = here.rowsBetween(Window.unboundedPreceding, 0)
    local = dealt.withColumns({"_rn": F.row_number().over(here), "_peers": peers}).withColumn("_prev", F.lag("_peers").over(here))
    local = local.withColumn("_new", F.when((F.col("_rn") == 1) | ~F.col("_prev").eqNullSafe(F.col("_peers")), F.col("_rn")))

    # One row a range and group: its size, sums, first and last peers, where its last new peers begin and how many begin in it.
    parts = local.groupBy("_range", *[k.alias(f"_k{i}") for i, k in enumerate(group)]).agg(
        F.count("*").alias("n"), F.min_by("_peers", "_rn").alias("first"), F.max_by("_peers", "_rn").alias("last"), F.max("_new").alias("mark"), F.count("_new").alias("begun"),
        *[F.sum(F.col(f"`{c}`")).alias(f"s{i}") for i, c in enumerate(sums.values())],
    )
    by_group = Window.partitionBy(*[f"_k{i}" for i in range(len(keys))]).orderBy("_range") if keys else Window.partitionBy(F.lit(0)).orderBy("_range")
    before = by_group.rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumns({"n_before": F.coalesce(F.sum("n").over(before), F.lit(0)), "goes_on": F.coalesce(F.lag("last").over(by_group).eqNullSafe(F.col("first")) & (F.lag("n").over(by_group) > 0), F.lit(False))})
    started = F.when((F.col("mark") > 1) | ~F.col("goes_on"), F.col("n_before") + F.col("mark"))
    parts = parts.withColumns({"started": started, "begun": F.col("begun") - F.col("goes_on").cast("int")})
    carried = parts.select(
        F.col("_range").alias("_r"), *[f"_k{i}" for i in range(len(keys))], "n_before", "goes_on",
        F.max("started").over(before).alias("rank_before"), F.coalesce(F.sum("begun").over(before), F.lit(0)).alias("dense_before"), *[F.sum(f"s{i}").over(before).alias(f"s{i}_before") for i in range(len(sums))],
    )
    meets = F.col("_range") == F.col("_r")
    for i, k in enumerate(group):
        meets = meets & k.eqNullSafe(F.col(f"_k{i}"))
    # A row a range, and two for each range that a group ends in: small, and by its size it is broadcast or not.
    carried = materialize(carried, "carried")
    joined = local.join(carried, meets)
    begins = F.max("_new").over(upto)
    out = {
        "row_number": (F.col("n_before") + F.col("_rn")).cast("long"),
        "rank": F.when((begins > 1) | ~F.col("goes_on"), F.col("n_before") + begins).otherwise(F.col("rank_before")).cast("long"),
        "dense_rank": (F.col("dense_before") + F.count("_new").over(upto) - F.col("goes_on").cast("int")).cast("long"),
    }
    for i, (name, c) in enumerate(sums.items()):
        own, earlier = F.sum(F.col(f"`{c}`")).over(upto), F.col(f"s{i}_before")
        out[name] = F.coalesce(own + earlier, own, earlier)
    return joined.withColumns(out).select(*[F.col(f"`{c}`") for c in columns if c not in out], *out)
