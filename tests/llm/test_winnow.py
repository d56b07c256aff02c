import hashlib
import random

import numpy as np

from sparkloom.llm import winnow
from sparkloom.llm.queries import QUERIES


def slow(text, k, w):
    """Positions by the definition, from this module's own gram hashes."""
    if not text:
        return []
    k = min(k, len(text))
    h = [int(winnow.winnow(text[i : i + k], k, 1)[0][0]) for i in range(len(text) - k + 1)]
    w = min(w, len(h))
    out = []
    for i in range(len(h) - w + 1):
        p = max(range(i, i + w), key=lambda j: (-h[j], j))
        if not out or out[-1] != p:
            out.append(p)
    return [(h[p], p) for p in out]


def test_selects_the_rightmost_least_of_each_window():
    rng = random.Random(5)
    for n in (0, 1, 3, 11, 12, 13, 23, 24, 25, 60, 300):
        for letters in ("ab", "abcdefgh é😀"):
            text = "".join(rng.choice(letters) for _ in range(n))
            for k, w in ((12, 12), (5, 4), (1, 1), (7, 1), (3, 16)):
                h, p = winnow.winnow(text, k, w)
                assert list(zip(h.tolist(), p.tolist())) == slow(text, k, w), (n, k, w)


def test_a_shared_run_of_window_and_gram_is_found():
    rng = random.Random(6)
    make = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    for _ in range(50):
        run = make(winnow.K + winnow.WINDOW - 1)
        a, b = make(200) + run + make(100), make(77) + run
        assert np.intersect1d(winnow.winnow(a)[0], winnow.winnow(b)[0]).size


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for i, (doc, text) in enumerate(rows):
        text, nxt = text or "", rows[(i + 1) % len(rows)][1] or ""
        edited = text[: len(text) - len(text) // 4] + nxt[: len(text) // 4]
        a, b, c = (winnow.winnow(t) for t in (text, edited, nxt))
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), winnow.digest(*a), winnow.digest(*b), winnow.likeness(a[0], b[0]), winnow.likeness(a[0], c[0])))
    return sorted(out, key=str)


def test_query_matches_brute_force(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in QUERIES["op3_winnow"](spark, d).collect()), key=str)
    assert got == expected(rows)
    assert sum(r[5] > r[6] for r in got) > 0.95 * len(got)


def test_nulls_ties_repeats_and_empty_tables(spark):
    schema = "doc_id long, text string, `to` int, late int, least string"
    make = lambda rows: spark.createDataFrame([(*r, 1, 2, "x") for r in rows], schema)
    assert winnow.compare_with_next(make([])).count() == 0
    some = [(None, "zero" * 30), (None, "z"), (4, None), (4, "four" * 20), (4, "four" * 20), (-7, ""), (9, "nine " * 40), (100, "é😀" * 25)]
    for ranges in (1, 2, 3, 50):
        for rows in (some, some[:1], some[2:3], some[2:], some[:2]):
            assert sorted((tuple(r) for r in winnow.compare_with_next(make(rows), ranges=ranges).collect()), key=str) == expected(rows)
    assert winnow.fingerprints(make(some)).count() == len(some)
