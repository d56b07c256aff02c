"""Uniform shuffling into shards of exact size through a communication matrix, with DataFrame operations only.

Rows are dealt by a hash to parts of about PART_ROWS rows. A uniform shuffle of all rows into shards of given sizes sends from each part to each
shard a number of rows that follows the multivariate hypergeometric law; the matrix of these numbers is drawn exactly, on
the driver, from one count per part. Each part then permutes its rows and cuts them by its row of the matrix (who goes where
is uniform given the numbers), rows move to their shards, and each shard permutes again, which gives the slots. Shard sizes come
out exactly as asked.
"""

from __future__ import annotations

import json
import math
import random

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.storage import materialize

#: Rows of a part, and of a cell of a shard, about; and the fewest parts.
PART_ROWS, LEAST_PARTS = 100_000, 256


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` from good + bad, without return, are good, by inversion.

    Chances are products of the ratios of neighbours, from the mode out to 40 deviations, and are divided by their sum, so no
    factorial is ever needed; the law is met but for some 1e-16 a step, whatever the size of the numbers.
    """
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    share, total = good / (good + bad), good + bad
    far = int(40 * math.sqrt(draws * share * (1 - share) * max(1, total - draws) / max(1, total - 1))) + 40
    up, down = np.arange(min(high - mode, far), dtype=np.float64), np.arange(min(mode - low, far), dtype=np.float64)
    # Whole numbers are subtracted before they become floats.
    above = np.cumprod(((good - mode) - up) / ((mode + 1) + up) * (((draws - mode) - up) / ((bad - draws + mode + 1) + up)))
    below = np.cumprod((mode - down) / ((good - mode + 1) + down) * (((bad - draws + mode) - down) / ((draws - mode + 1) + down)))
    chances = np.concatenate([below[::-1], [1.0], above])
    upto = np.cumsum(chances)
    return mode - len(below) + int(np.searchsorted(upto, rng.random() * upto[-1], side="right"))


def communication_matrix(rows: list[int], columns: list[int], seed: int) -> list[list[int]]:
    """Counts with the given sums of rows and columns, as a uniform shuffle has them."""
    rng, left, out = random.Random(seed), list(columns), []
    for n in rows:
        line, rest = [], sum(left)
        for c in left:
            rest -= c
            k = hypergeometric(rng, c, rest, n)
            line.append(k)
            n -= k
        out.append(line)
        left = [c - k for c, k in zip(left, line, strict=True)]
    return out


def assign(docs: DataFrame, shards: int = 8, seed: int = 23, parts: int | None = None) -> DataFrame:
    """``docs`` with shard (0 to shards - 1) and slot (gapless from 0 inside a shard); shard sizes differ by one at most.

    The result depends on the rows alone, not on their partitioning: rows are told apart by doc_id and a hash of all columns, and
    rows that are equal throughout change places only among themselves. All rows stay, whatever is null; an empty table gives
    an empty result. Columns named shard or slot are replaced. ``parts`` is set by the number of rows unless given.
    """
    kept = [c for c in docs.columns if c not in ("shard", "slot")]
    total = docs.count()
    parts, cells = parts or max(LEAST_PARTS, -(-total // PART_ROWS)), max(LEAST_PARTS // shards, -(-total // (PART_ROWS * shards)), 1)
    plain = [F.col(f"`{c}`") for c in kept]
    # Whole rows travel as one struct, whose fields' names clash with nothing.
    rows = docs.select(F.struct(*plain).alias("_doc"), F.xxhash64(F.lit(seed), *plain).alias("_row"))
    rows = rows.withColumn("_part", F.pmod(F.xxhash64(F.lit("part"), "_row"), F.lit(parts)).cast("int"))
    counts = {r["_part"]: r["n"] for r in rows.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    order, total = sorted(counts), sum(counts.values())
    sizes = [total // shards + (k < total % shards) for k in range(shards)]
    matrix = communication_matrix([counts[p] for p in order], sizes, seed)
    upto = [{"p": p, "c": [sum(line[: k + 1]) for k in range(shards)]} for p, line in zip(order, matrix, strict=True)]
    spark = docs.sparkSession
    table = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(upto)), "array<struct<p: int, c: array<long>>>")).alias("x")).select(F.col("x.p").alias("_p"), F.col("x.c").alias("_upto"))
    local = F.row_number().over(Window.partitionBy("_part").orderBy(F.xxhash64(F.lit("local"), "_row"), "_row"))
    sent = rows.withColumn("_n", local).join(F.broadcast(table), F.col("_part") == F.col("_p")).withColumn("shard", F.size(F.filter("_upto", lambda c: c < F.col("_n"))))
    # The second permutation: by another hash, in cells of it so that no shard is sorted in one task.
    key = F.xxhash64(F.lit("shard"), "_row", "_n")
    placed = sent.withColumn("_key", key).withColumn("_cell", F.shiftrightunsigned(F.shiftrightunsigned("_key", 33) * F.lit(cells), 31).cast("int")).drop("_p", "_upto", "_part", "_n")
    cells = placed.groupBy("shard", "_cell").agg(F.count("*").alias("_c"))
    starts = cells.select("shard", "_cell", (F.sum("_c").over(Window.partitionBy("shard").orderBy("_cell")) - F.col("_c")).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("shard", "_cell").orderBy("_key", "_row")) - 1
    out = placed.withColumn("_k", inside).join(F.broadcast(starts), ["shard", "_cell"])
    return out.select("_doc.*", "shard", (F.col("_start") + F.col("_k")).cast("long").alias("slot"))


def shard_digest(docs: DataFrame, shards: int = 8, **options) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row: sizes, checksums and places, without the texts.

    Null texts count as empty; null and repeated doc_ids are rows like others.
    """
    narrow = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))
    placed = assign(materialize(narrow, "narrow"), shards, **options)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
