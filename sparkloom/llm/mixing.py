"""Mixing sources to target weights by Pareto order sampling, with DataFrame operations only.

Weights share the whole corpus out among sources; a target stops at ``most`` times its source's size and what is over goes to
the others by weight, until none is above. Sizes are words. A source's factor is its target over its size:

1. Every document is taken as often as the whole part of its source's factor says. These copies are certain.
2. What the fraction still asks for is sampled. A source's documents are dealt to classes of like size, eight to a doubling, and
   every class gives a fixed number of documents. From the largest class down, a class's share is what is left to take over
   what is left to take it from; its number is that share of its documents, rounded up or down by a random draw, so each
   document's chance of one more copy is the fraction. Where only one way of rounding can still reach the target with the
   smaller classes, it is that one.
3. Large classes are split into cells of about CELL_ROWS documents or CELL_WORDS words by a hash, and each cell gives its share of the class's number.
4. A cell of n documents that gives m is a Pareto sample of fixed size m: a document of size s in a cell of mean size a has the
   chance p (1 + t (s / a - 1)), with p = m / n and t the smaller of 1 and (1 - p) / p. These sum to m; up to p = 1/2 they are
   proportional to size. Documents are ranked by random odds over the odds of their chance, and the first m are in.

Only classes are ever held against targets (a row per source and class), and the only sort is inside cells, so no source,
however large, is sorted or gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.storage import materialize, release

WORDS = r"[^\x20\x09-\x0D]+"
#: Documents and words in a cell, about.
CELL_ROWS, CELL_WORDS = 8192, 1 << 20
#: Classes of size for each doubling; sizes in one differ by 9 % at most.
CLASSES = 8


def running(rows: DataFrame, order: Column, **sums: Column) -> DataFrame:
    """``rows`` with the sum, under each name, over the rows that come before in ``order``.

    Rows are dealt to ranges, summed per range, and summed up inside each; the dealt table is written, so that ranges stay.
    """
    dealt = materialize(rows.withColumn("_o", order).repartitionByRange(F.col("_o").asc_nulls_last()).withColumn("_p", F.spark_partition_id()), "running")
    each = dealt.groupBy(F.col("_p").alias("_q")).agg(*[F.sum(c).alias(f"_{k}") for k, c in sums.items()])
    # A row per range: as many as there are shuffle partitions.
    upto = Window.orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)
    starts = each.select("_q", *[F.coalesce(F.sum(f"_{k}").over(upto), F.lit(0)).alias(f"_{k}") for k in sums])
    inside = Window.partitionBy("_p").orderBy(F.col("_o").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_in_{k}") for k, c in sums.items()])
    return summed.join(F.broadcast(starts), F.col("_p") == F.col("_q")).select(*rows.columns, *[(F.col(f"_{k}") + F.col(f"_in_{k}")).alias(k) for k in sums])


def targets(sources: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """sources: source (distinct, null too), source_size. Adds target: the share by weight, with the stop at ``most`` times the size.

    With sources in order of stop over weight, the level at which target = min(stop, weight * level) adds up to the total is the
    greatest of (total - stops before) / (weights from here on). An empty table, or one without any words, gives targets of 0.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    rows = running(sources.select("source", "source_size"), F.col("source"), rank=F.lit(1))
    rows = materialize(rows.select("source", "source_size", weight.alias("w"), (F.col("source_size") * float(most)).alias("stop")), "weights")
    whole = rows.agg(F.sum("source_size").alias("total"), F.sum("w").alias("w")).first()
    before = running(rows, F.col("stop") / F.col("w"), stops=F.col("stop"), ws=F.col("w"))
    level = before.agg(F.max((float(whole["total"] or 0) - F.col("stops")) / (float(whole["w"] or 0) - F.col("ws")))).first()[0] or 0.0
    return rows.select("source", "source_size", F.least("stop", F.col("w") * max(0.0, level)).alias("target"))


def _uniform(*of: str | Column) -> Column:
    """A number in (0, 1) from a hash."""
    return (F.shiftrightunsigned(F.xxhash64(*of), 11) + 0.5) / float(1 << 53)


def _class(size: Column) -> Column:
    """The class of a size; -1 for 0."""
    return F.when(size > 0, F.floor(F.log2(size) * CLASSES)).otherwise(F.lit(-1)).cast("int")


def _numbers(strata: DataFrame, wanted: DataFrame, seed: int) -> DataFrame:
    """strata: source, class, n, words, squares (of sizes). wanted: source, source_size, target.

    Gives source, class, source_size, target, certain (copies of every document), n, m (documents of the class that get one more), cells.
    """
    source = wanted.select(F.col("source").alias("_s"), "source_size", "target")
    factor = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = strata.join(source, F.col("_s").eqNullSafe(F.col("source"))).withColumn("certain", F.floor(factor + 1e-9).cast("int"))
    u = _uniform(F.lit(seed), F.lit("class"), "source", "class")
    one = F.struct("class", "n", "words", "squares", u.alias("u"))
    # At most a row per class of one source, about CLASSES for each doubling of size.
    each = rows.groupBy("source", "source_size", "target", "certain").agg(F.reverse(F.array_sort(F.collect_list(one))).alias("classes"))
    fold = """aggregate(filter(classes, x -> x.class >= 0),
      named_struct('left', greatest(target - certain * source_size, 0D), 'pool', cast(source_size as double), 'out', cast(array() as array<struct<class: int, m: bigint>>)),
      (acc, x) -> transform(array(named_struct('share', least(1D, greatest(0D, try_divide(acc.left, acc.pool))), 'below', acc.pool - x.words)),
        y -> transform(array(named_struct('low', least(x.n, floor(x.n * y.share + 1e-9)), 'at', x.n * y.share,
            'each', x.words / x.n + least(1D, coalesce(try_divide(1 - y.share, y.share), 1D)) * (x.squares / x.words - x.words / x.n))),
          z -> transform(array(named_struct('a', acc.left - z.low * z.each, 'b', acc.left - least(x.n, z.low + 1) * z.each)),
            v -> transform(array(case
                when v.a between 0 and y.below and v.b between 0 and y.below then if(x.u < z.at - z.low, least(x.n, z.low + 1), z.low)
                when greatest(-v.a, v.a - y.below, 0D) <= greatest(-v.b, v.b - y.below, 0D) then z.low
                else least(x.n, z.low + 1) end),
              m -> named_struct('left', acc.left - m * z.each, 'pool', y.below, 'out', concat(acc.out, array(named_struct('class', x.class, 'm', m)))))[0])[0])[0])[0],
      acc -> acc.out)"""
    picks = each.select("source", F.explode(F.expr(fold)).alias("x")).select(F.col("source").alias("_s"), F.col("x.class").alias("_c"), "x.m")
    rows = rows.drop("_s").join(picks, F.col("_s").eqNullSafe(F.col("source")) & (F.col("_c") == F.col("class")), "left")
    cells = F.ceil(F.greatest(F.col("n") / CELL_ROWS, F.col("words") / CELL_WORDS)).alias("cells")
    return rows.select("source", "class", "source_size", "target", "certain", "n", F.coalesce("m", F.lit(0)).alias("m"), cells)


def _size() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long")


def _plan(sized: DataFrame, weights: tuple[float, ...], most: int, seed: int) -> DataFrame:
    """The numbers of every source and class, as a table. sized: source, size."""
    size = F.col("size").cast("double")
    strata = sized.groupBy("source", _class(F.col("size")).alias("class")).agg(F.count("*").alias("n"), F.sum("size").alias("words"), F.sum(size * size).alias("squares"))
    strata = materialize(strata, "strata")
    wanted = targets(strata.groupBy("source").agg(F.sum("words").alias("source_size")), weights, float(most))
    return materialize(_numbers(strata, wanted, seed), "numbers")


def _taken(sized: DataFrame, numbers: DataFrame, most: int, seed: int, *ties: str) -> DataFrame:
    """sized (source, size, key and more) with source_size, target and copies; ``ties`` order rows of one key."""
    few = numbers.select(F.col("source").alias("_s"), F.col("class").alias("_c"), "source_size", "target", "certain", F.col("n").alias("_n"), F.col("m").alias("_m"), "cells")
    rows = sized.withColumn("_class", _class(F.col("size")))
    rows = rows.join(few, F.col("_s").eqNullSafe(F.col("source")) & F.col("_c").eqNullSafe(F.col("_class")))
    rows = rows.withColumn("_cell", F.pmod(F.xxhash64(F.lit(seed), F.lit("cell"), "key"), F.col("cells")))
    group = ("source", "_class", "_cell")
    cell = Window.partitionBy(*group)
    rows = rows.withColumn("_k", F.count("*").over(cell)).withColumn("_mean", F.sum("size").over(cell) / F.col("_k"))
    # A class in one cell gives just its number; of several cells each rounds its share by a draw of its own.
    share = F.floor(F.col("_k") * F.col("_m") / F.col("_n") + _uniform(F.lit(seed), F.lit("round"), *group))
    rows = rows.withColumn("_give", F.when(F.col("cells") == 1, F.col("_m")).otherwise(F.least(share, "_k")))
    p = F.col("_give") / F.col("_k")
    tilt = F.least(F.lit(1.0), F.coalesce(F.try_divide(1 - p, p), F.lit(1.0)))
    chance = p * (1 + tilt * F.coalesce(F.try_divide(F.col("size"), F.col("_mean")) - 1, F.lit(0.0)))
    u = _uniform(F.lit(seed), F.lit("rank"), "key")
    rank = F.try_divide(u * (1 - chance), (1 - u) * chance)
    place = F.row_number().over(cell.orderBy(rank.asc_nulls_last(), "key", *ties))
    copies = F.least(F.lit(most), F.col("certain") + (place <= F.col("_give")).cast("int"))
    copies = F.when(F.col("size") > 0, copies).otherwise(F.lit(0)).cast("long")
    return rows.withColumn("copies", copies).drop("_s", "_c", "_n", "_m", "_class", "_cell", "_k", "_mean", "_give", "certain", "cells")


def _sized(docs: DataFrame, size: Column, *more: Column) -> DataFrame:
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), F.xxhash64("doc_id", "text").alias("key"), *more)


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: int = 3, seed: int = 17, sizes: Column | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for every row of ``docs``.

    Sources are ordered by code point, null last, and weigh ``weights``, repeating. ``size`` is the number of words (0 for null).
    Texts without words are never taken. Rows that repeat a doc_id and text are documents of their own, with one random number in
    common, and null ids are ids like others. Reruns agree, on any partitioning. Other columns are not looked at; an empty table
    gives an empty result.
    """
    sized = materialize(_sized(docs, sizes if sizes is not None else _size()), "sizes")
    rows = _taken(sized, _plan(sized, weights, most, seed), most, seed)
    return rows.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def apply_mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: int = 3, seed: int = 17) -> DataFrame:
    """``docs`` with each row as often as :func:`mix` takes it; rows that it leaves out are gone.

    Texts move once, to their cells. Rows equal in doc_id and text are told apart by a hash of all columns; rows equal in all are alike.
    """
    # Whole rows travel as one struct, whose fields' names clash with nothing.
    plain = [F.col(f"`{c}`") for c in docs.columns]
    rows = _sized(docs, _size(), F.xxhash64(*plain).alias("_tie"), F.struct(*plain).alias("_row"))
    numbers = _plan(rows.select("source", "size"), weights, most, seed)
    taken = _taken(rows, numbers, most, seed, "_tie").filter("copies > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_row.*")
