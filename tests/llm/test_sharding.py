import math
import random
import zlib
from collections import Counter, defaultdict
from math import comb

from pyspark.sql import functions as F

from sparkloom.llm import sharding
from sparkloom.llm.queries import QUERIES


def test_hypergeometric_follows_its_law():
    rng = random.Random(4)
    good, bad, draws, times = 7, 9, 6, 40_000
    seen = Counter(sharding.hypergeometric(rng, good, bad, draws) for _ in range(times))
    for k in range(draws + 1):
        p = comb(good, k) * comb(bad, draws - k) / comb(good + bad, draws)
        assert abs(seen[k] / times - p) < 0.012
    # Against the law in whole numbers, for numbers whose factorials are far beyond floats.
    good, bad, draws = 3 * 10**9 + 7, 10**10 + 1, 40
    whole = comb(good + bad, draws)
    seen = Counter(sharding.hypergeometric(rng, good, bad, draws) for _ in range(20_000))
    for k in range(draws + 1):
        assert abs(seen[k] / 20_000 - comb(good, k) * comb(bad, draws - k) / whole) < 0.015
    spread = [(sharding.hypergeometric(rng, 4 * 10**10, 4 * 10**10, 10**5) - 5 * 10**4) / math.sqrt(10**5 / 4) for _ in range(4000)]
    assert abs(sum(spread) / 4000) < 0.07 and abs(sum(x * x for x in spread) / 4000 - 1) < 0.1
    big = [sharding.hypergeometric(rng, 5 * 10**11, 35 * 10**11, 10**9) for _ in range(20)]
    assert all(abs(x - 125_000_000) < 100_000 for x in big)


def test_matrix_has_its_sums():
    rows, columns = [5, 0, 17, 3, 100], [60, 5, 60, 0]
    m = sharding.communication_matrix(rows, columns, 1)
    assert [sum(r) for r in m] == rows and [sum(c) for c in zip(*m, strict=True)] == columns and min(map(min, m)) >= 0


def check(rows, docs, shards=8):
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots.get(k, ())) for k in range(shards)]
    assert max(counts) - min(counts) <= 1 and sum(counts) == len(docs)


def test_query(spark):
    d = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["text"].encode() for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = QUERIES["op6_sharding"](spark, d).collect()
    check(rows, docs)
    for r in rows:
        assert r["size"] == len(docs[r["doc_id"]]) + 1 and r["text_crc32"] == zlib.crc32(docs[r["doc_id"]]) and r["law"] == "rows" and r["grown_shard"] is None
    again = sharding.shard_digest(spark.read.parquet(f"{d}/documents.parquet").repartition(7)).collect()
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in rows} == {(r["doc_id"], r["shard"], r["slot"]) for r in again}
    # Neighbours in the input are spread: the shard of a row says nothing of the next row's.
    by_id = {r["doc_id"]: r["shard"] for r in rows}
    same = sum(by_id[i] == by_id[i + 1] for i in range(999))
    assert 70 < same < 190


def test_every_row_is_as_likely_in_every_place(spark):
    """Over seeds, each of 24 rows is in each of 3 shards and near each of the slots about equally often."""
    frame = spark.range(24).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    seen, slots, times = Counter(), Counter(), 60
    for seed in range(times):
        for r in sharding.assign(frame, 3, seed=seed, parts=5).collect():
            seen[r["doc_id"], r["shard"]] += 1
            slots[r["doc_id"], r["slot"] // 4] += 1
    chi = sum((seen[i, k] - times / 3) ** 2 / (times / 3) for i in range(24) for k in range(3))
    assert chi < 24 * 2 + 5 * math.sqrt(2 * 24 * 2), chi
    chi = sum((slots[i, k] - times / 2) ** 2 / (times / 2) for i in range(24) for k in range(2))
    assert chi < 24 + 5 * math.sqrt(2 * 24), chi


def test_edge_cases(spark):
    schema = "doc_id long, text string, shard string, slot string, `a.b` int"
    make = lambda rows: spark.createDataFrame([(*r, "x", "y", 1) for r in rows], schema)
    assert sharding.assign(make([])).count() == 0 and sharding.shard_digest(make([])).count() == 0
    docs = [(None, None), (None, None), (1, ""), (1, ""), (1, "é"), (2, "x" * 9999)] * 3
    for n in (1, 3, 8, 40):
        out = sharding.assign(make(docs), n)
        assert out.columns == ["doc_id", "text", "a.b", "shard", "slot"]
        check(out.collect(), docs, n)
    check(sharding.shard_digest(make(docs)).collect(), docs)
