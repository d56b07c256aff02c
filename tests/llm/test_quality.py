import math
import random
from collections import Counter, defaultdict

import pytest

from sparkloom.llm import quality
from sparkloom.llm.queries import QUERIES

P = quality.PAD


def slow_model(trusted, order):
    """Interpolated modified Kneser-Ney from its formulas, on dictionaries."""
    counts = {order: Counter()}
    for t in trusted:
        t = P * (order - 1) + t
        counts[order].update(t[i : i + order] for i in range(len(t) - order + 1))
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    d, total, given = {}, {}, {}
    for n in counts:
        of = Counter(counts[n].values())
        d[n] = quality.discounts(of[1], of[2], of[3], of[4])
        total[n], given[n] = defaultdict(int), defaultdict(float)
        for g, c in counts[n].items():
            total[n][g[:-1]] += c
            given[n][g[:-1]] += d[n][min(c, 3) - 1]

    def p(g):
        n = len(g)
        lower = p(g[1:]) if n > 1 else 1 / (len(counts[1]) + 1)
        h, c = g[:-1], counts[n][g]
        if not total[n][h]:
            return lower
        return (max(c - (d[n][min(c, 3) - 1] if c else 0), 0) + given[n][h] * lower) / total[n][h]

    return p


def fixture(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("aaabbc  de") for _ in range(rng.randint(0, 80))) for _ in range(40)] + [None, "", "  \n", "Zz é😀", "x", "A  B\ta" + P]
    docs = [(i, t, rng.choice(["en", "de", None]), "s") for i, t in enumerate(texts)]
    labels = [(i, int(i % 3 > 0), 0) for i in range(30)] + [(1, 1, 0), (999, 1, 0)]
    return docs, labels, spark.createDataFrame(docs, "doc_id long, text string, lang string, trusted string"), spark.createDataFrame(labels, "doc_id long, quality int, gram int")


@pytest.mark.parametrize("order", [1, 2, 4])
def test_matches_the_formulas(spark, order):
    docs, labels, d, lab = fixture(spark)
    plain = {i: " ".join((t or "").replace(P, " ").split()) for i, t, *_ in docs}
    sure = {i for i, q, _ in labels if q == 1}
    p = slow_model([plain[i] for i in plain if i in sure], order)
    for limit in (10**6, 0):  # the second takes the way for models too large to broadcast
        got = quality.log_perplexity(d, lab, order=order, broadcast_ngrams=limit, broadcast_ids=limit, block_chars=300).collect()
        assert len(got) == len(docs)
        for r in got:
            t = P * (order - 1) + plain[r["doc_id"]]
            lp = [-math.log(p(t[i : i + order])) for i in range(len(t) - order + 1)]
            assert r["n_chars"] == len(lp) and r["trusted"] == (r["doc_id"] in sure)
            assert (r["log_ppl"] is None) if not lp else math.isclose(r["log_ppl"], sum(lp) / len(lp), rel_tol=1e-5)


def test_probabilities_sum_to_one():
    p = slow_model(["abracadabra", "abc abd"], 3)
    letters = set("abracdabra bd")
    assert abs(sum(p("ab" + x) for x in letters) + p("ab?") - 1) < 1e-9


def test_query_keeps_trusted_and_finds_noise(spark):
    d = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r["keep"] for r in QUERIES["op2_quality"](spark, d).collect()}
    labels = spark.read.parquet(f"{d}/labels.parquet").collect()
    good, bad = [rows[r["doc_id"]] for r in labels if r["quality"]], [rows[r["doc_id"]] for r in labels if not r["quality"]]
    assert len(rows) == 1000 and sum(good) >= 0.99 * len(good) and sum(bad) < 0.2 * len(bad)


def test_limits_are_quantiles_by_language_and_length(spark):
    """Limits from the perplexities themselves: a band of enough trusted documents, else its language, else all."""
    rng = random.Random(5)
    words = ["Lorem", "ipsum", "dolor", "sit", "amet,", "duis.", "Ante"]
    langs = ["en"] * 11 + ["de"] * 3 + ["xx", None]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([3, 30, 300]))), rng.choice(langs)) for i in range(900)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    lab = spark.createDataFrame([(i, int(i % 7 > 0)) for i in range(900)], "doc_id long, quality int")
    outside = {r[0] for r in d.filter("pmod(xxhash64(doc_id), 5) = 0").collect()}
    got = quality.judge(d, lab, low=0.1, high=0.9, slack=0.01, fewest=15).collect()
    sure = [r for r in got if r["doc_id"] in outside and r["doc_id"] % 7 > 0]

    def band(r):
        return next((k for k, n in enumerate(quality.BANDS) if r["n_chars"] <= n), len(quality.BANDS))

    def limit(r, share, side):
        short = quality.SHORT / math.sqrt(r["n_chars"])
        alike = [s for s in sure if r["lang"] and (s["lang"], band(s)) == (r["lang"], band(r))]
        tongue = [s for s in sure if r["lang"] and s["lang"] == r["lang"]]
        use, level = next(((x, k) for k, x in enumerate((alike, tongue)) if len(x) >= 15), (sure, 2))
        levels.add(level)
        v = sorted(round(s["log_ppl"] - side * quality.SHORT / math.sqrt(s["n_chars"]), 4) for s in use)
        return v[math.ceil(share * len(v)) - 1] + side * (0.01 * (1 + 45 / len(use)) + short)

    levels = set()
    for r in got:
        lo, hi = limit(r, 0.1, -1), limit(r, 0.9, 1)
        assert math.isclose(r["low_limit"], lo, abs_tol=2e-4) and math.isclose(r["high_limit"], hi, abs_tol=2e-4)
        assert r["keep"] == (r["low_limit"] <= r["log_ppl"] <= r["high_limit"])
    assert levels == {0, 1, 2} and len(got) == 900


def test_ordinary_words_repeated_are_found(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    odd = spark.createDataFrame([(10**9 + i, f"{w} " * 300, "en") for i, w in enumerate(["The", "For", "And"])], "doc_id long, text string, lang string")
    got = quality.judge(docs.select("doc_id", "text", "lang").union(odd), labels).filter(f"doc_id >= {10**9}").collect()
    assert len(got) == 3 and not any(r["keep"] for r in got)


def test_empty_tables(spark):
    _, _, d, lab = fixture(spark)
    assert quality.judge(d.limit(0), lab).count() == 0
    got = quality.judge(d, lab.limit(0)).collect()
    assert all(r["keep"] == (r["log_ppl"] is not None) for r in got) and len(got) == d.count()
