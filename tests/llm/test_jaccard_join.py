import random
import re
from fractions import Fraction

import numpy as np

from sparkloom.llm import jaccard_join
from sparkloom.llm.queries import QUERIES


def brute(rows, size=5):
    sets = {}
    for i, text in rows:
        if i is None:
            continue
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * x >= 80 * (len(sets[a]) + len(sets[b]) - x):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return {i: (len(sets[i]), root(i)) for i in sets}


def planted(seed=3):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "One two"), (4, "one TWO"), (5, "one two three four five"), (6, "ÉCOLE école x"), (7, "école école x")]
    passage = [rng.choice(words) for _ in range(30)]
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.choice([4, 5, 9, 24, 60, 200]))]
        if rng.random() < 0.5:
            base += passage
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows) + 10, rng.choice([" ", "\n", "  "]).join(copy)))
    return rows


def test_matches_brute_force(spark):
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute(rows)
    for block in (4_000_000, 60):  # the second cuts almost every part into blocks
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(docs, block_shingles=block).collect()}
        assert got == want
    assert any(c != i for i, (_, c) in want.items())


def test_query_matches_brute_force(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in QUERIES["op4_jaccard_join"](spark, d).collect()}
    assert got == brute(rows)
    exact = jaccard_join.jaccard_components(spark.read.parquet(f"{d}/documents.parquet"), exact=True).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in exact} == got


def test_empty_nulls_repeats_and_other_columns(spark):
    schema = "doc_id long, text string, node long, digest string, token int"
    assert jaccard_join.jaccard_components(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "a b c d e f", 5, "x", 1), (1, "a b c d e f", 5, "x", 1), (None, "a b c d e f", 5, "x", 1), (9, "a b c d e f", None, None, None)]
    got = sorted(tuple(r) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, schema)).fillna(-1).collect())
    assert got == [(-1, 2, -1), (1, 2, 1), (1, 2, 1), (9, 2, 1)]


def test_dense_groups_connect_as_all_links_do():
    rng = random.Random(12)
    t = Fraction(4, 5)
    for size, edits in ((40, 3), (40, 5), (12, 1)):
        base = rng.sample(range(10**9), size)
        sets = []
        for _ in range(150):
            s = list(base)
            for _ in range(rng.randint(0, edits)):
                s[rng.randrange(size)] = rng.randrange(10**9)
            sets.append(np.unique(np.array(s, dtype=np.uint64)))
        for side in (None, [k % 2 for k in range(len(sets))]):
            links = jaccard_join.link_sets(list(range(len(sets))), sets, t, 64, side)
            every = [(i, j) for i in range(len(sets)) for j in range(i) if (side is None or side[i] != side[j]) and 5 * len(x := np.intersect1d(sets[i], sets[j])) >= 4 * (len(sets[i]) + len(sets[j]) - len(x))]
            assert {frozenset(x) for x in links} <= {frozenset(x) for x in every} and groups(links) == groups(every) and len(links) < len(sets)


def groups(links):
    of = {}
    for a, b in links:
        one = of.setdefault(a, {a}) | of.setdefault(b, {b})
        for x in one:
            of[x] = one
    return {frozenset(x) for x in of.values()}
