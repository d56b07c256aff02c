import random

import numpy as np
from pyspark.sql import functions as F

from sparkloom.operators import dedup


def test_band_search_gives_the_known_value():
    assert dedup.optimal_bands(0.7, 256) == (25, 10)


def test_signatures_estimate_similarity_and_edges(spark):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(1000)]
    base = [rng.choice(words) for _ in range(300)]
    near = list(base)
    near[150] = "changed"
    rows = [(0, " ".join(base)), (1, " ".join(near)), (2, " ".join(rng.choice(words) for _ in range(300))), (3, None), (4, "  "), (5, "two words"), (6, "two  words")]
    df = spark.createDataFrame(rows, "id long, t string")
    s = {r["id"]: r["s"] for r in df.select("id", dedup.minhash("t").alias("s")).collect()}
    assert s[3] is None and s[4] is None and s[5] == s[6] and len(s[0]) == 64
    same = np.mean(np.array(s[0]) == np.array(s[1]))
    assert same > 0.85 and np.mean(np.array(s[0]) == np.array(s[2])) < 0.05
    marked = {r["id"]: (r["rep"], r["is_duplicate"]) for r in dedup.dedup(df, "id", "t").collect()}
    assert marked == {0: (0, False), 1: (0, True), 2: (2, False), 3: (3, False), 4: (4, False), 5: (5, False), 6: (5, True)}
    assert {r["id"] for r in dedup.keep_representatives(dedup.dedup(df, "id", "t")).collect()} == {0, 2, 3, 4, 5}


def test_shingles(spark):
    rows = [(t, r) for t, r in (("a b c d e f", ["a b c d e", "b c d e f"]), ("a b", ["a b"]), ("", None), (" ", None), (None, None), ("a  b c d e", ["a b c d e"]))]
    df = spark.createDataFrame(rows, "t string, want array<string>").select(dedup.shingle_list("t").alias("got"), "want")
    assert df.filter(~F.col("got").eqNullSafe(F.col("want"))).collect() == []


def test_partitioning_does_not_matter(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    one = {tuple(r) for r in dedup.dedup(docs.coalesce(1), "doc_id", "text").select("doc_id", "rep").collect()}
    assert one == {tuple(r) for r in dedup.dedup(docs.repartition(9), "doc_id", "text").select("doc_id", "rep").collect()}
    assert any(a != b for a, b in one)


def test_recall_of_bands(spark):
    """Of all pairs of documents whose word 5-grams have a similarity of 0.7 or more, how many end in one group."""
    import re
    from itertools import combinations

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    sets = {}
    for r in docs.collect():
        w = re.sub(r"[!-/:-@\[-`{-~]", "", (r["text"] or "").lower()).split()
        sets[r["doc_id"]] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    pairs = [(a, b) for a, b in combinations(sorted(sets), 2) if sets[a] and sets[b] and 0.7 * max(len(sets[a]), len(sets[b])) <= min(len(sets[a]), len(sets[b])) and len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b])]
    found = {}
    for name, options in (("compatible", {}), ("recall", {"recall": 0.95})):
        rep = {r["doc_id"]: r["rep"] for r in dedup.dedup(docs, "doc_id", "text", **options).select("doc_id", "rep").collect()}
        found[name] = sum(rep[a] == rep[b] for a, b in pairs) / len(pairs)
    print("recall of pairs", len(pairs), found)
    assert len(pairs) > 20 and found["recall"] >= max(0.95, found["compatible"])
    assert dedup.bands_for(0.7, 64, 0.95) == (16, 4)
