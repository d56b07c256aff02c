import zlib

import numpy as np

from sparkloom.llm import toxicity
from sparkloom.llm.queries import QUERIES


def test_features_of_a_text_do_not_depend_on_its_neighbours():
    texts = ["", "a", "Hello  World", "é😀 hello", "x" * 5000, "hello world "]
    alone = [next(toxicity._present([t], 20)) for t in texts]
    together = list(toxicity._present(texts, 20))
    assert all(np.array_equal(a, b) for a, b in zip(alone, together, strict=True))
    assert np.array_equal(alone[2], alone[5])


def test_logistic_fit_reaches_the_minimum():
    rng = np.random.default_rng(0)
    rows = [np.flatnonzero(rng.random(6) < 0.4) for _ in range(200)]
    scale = np.array([2.0, -1.0, 0.5, 3.0, -2.0, 1.0])
    y = np.array([float((0 in r) ^ (rng.random() < 0.1)) for r in rows])
    w, b = toxicity.fit_logistic(rows, y, scale)

    def loss(w, b):
        z = np.array([sum(w[r] * scale[r]) + b for r in rows])
        return np.mean(np.log1p(np.exp(-(2 * y - 1) * z))) + 0.5 / len(rows) * (w * w).sum()

    best = loss(w, b)
    for k in range(7):
        step = np.zeros(7)
        step[k] = 1e-3
        assert loss(w + step[:6], b + step[6]) >= best - 1e-9 and loss(w - step[:6], b - step[6]) >= best - 1e-9


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    rows = {r["doc_id"]: r for r in QUERIES["op9_toxicity"](spark, d).collect()}
    assert len(rows) == 10_000 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    labels = [(rows[r["doc_id"]], r["toxic"]) for r in spark.read.parquet(f"{d}/labels.parquet").collect()]
    test = [(r["predicted"], y) for r, y in labels if r["held_out"]]
    hit = sum(p and y for p, y in test)
    precision, recall = hit / max(1, sum(p for p, _ in test)), hit / sum(y for _, y in test)
    print("precision", precision, "recall", recall)
    assert precision > 0.9 and recall > 0.85


def test_edge_cases(spark):
    schema = "doc_id long, text string, label int, score string"
    rows = [(1, None, 1, "a"), (1, "bad bad words", 1, "a"), (2, "", 0, "a"), (3, "fine words", 0, "a"), (None, "bad", 1, "a"), (5, "x", None, "a"), (6, "y", 7, "a")]
    docs = spark.createDataFrame(rows, schema)
    for labelled in (docs, docs.limit(0), docs.filter("label = 1")):
        model = toxicity.fit(labelled, bits=12, features=50)
        assert toxicity.score(docs, *model).count() == len(rows)
    assert toxicity.score(docs.limit(0), *model).count() == 0


def plain_scores(labelled, texts, orders=(4, 5, 6, 7), alpha=1.0, ridge=1.0):
    """Scores by the definition: n-grams as strings, every one a feature, and a dense Newton fit."""

    def grams(t):
        t = " " + " ".join((t or "").lower().split()) + " "
        return {t[k : k + n] for n in orders for k in range(len(t) - n + 1)}

    rows = [(grams(t), y) for t, y in labelled]
    ones, zeros = sum(y for _, y in rows), sum(1 - y for _, y in rows)
    names = sorted({g for f, _ in rows for g in f})
    a = np.array([sum(g in f and y == 1 for f, y in rows) for g in names])
    b = np.array([sum(g in f and y == 0 for f, y in rows) for g in names])
    r = np.log((a + alpha) / (ones + 2 * alpha) / ((b + alpha) / (zeros + 2 * alpha)))
    x = np.array([[g in f for g in names] + [1] for f, _ in rows], dtype=float)
    x[:, :-1] *= r
    y, v = np.array([y for _, y in rows], dtype=float), np.zeros(len(names) + 1)
    penalty = np.append(np.full(len(names), ridge / len(rows)), 1e-9)
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ v))
        v -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None] / len(rows)) + np.diag(penalty), x.T @ (p - y) / len(rows) + penalty * v)
    weight = dict(zip(names, v[:-1] * r, strict=True))
    return [1 / (1 + np.exp(-(v[-1] + sum(weight.get(g, 0) for g in grams(t))))) for t in texts]


def test_scores_equal_a_plain_version(spark):
    """Counts, ratios, fit and scores, with ties, repeated rows, a very long text and columns whose names clash."""
    rng = np.random.default_rng(4)
    words = ["stupid", "idiot", "nice", "fine", "tree", "Übel", "ok", "日本語"]
    rows = []
    for k in range(60):
        bad = int(rng.random() < 0.4)
        text = " ".join(rng.choice(words[:6] if bad else words[2:], rng.integers(0, 7)))
        rows.append((k, text if rng.random() < 0.95 else None, bad))
    rows += [rows[3]] * 4 + [(99, "nice  tree\n" * 30_000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int")
    clash = docs.selectExpr("*", "'?' as feature", "1 as ones", "2 as order", "3 as present", "4 as z", "5 as r")
    model = toxicity.fit(clash, features=100_000)
    got = toxicity.score(clash, *model, "doc_id", "order").collect()
    want = dict(zip([i for i, _, _ in rows], plain_scores([(t, y) for _, t, y in rows], [t for _, t, _ in rows]), strict=True))
    assert len(got) == len(rows) and len({round(x, 3) for x in want.values()}) > 20
    assert max(abs(r["score"] - want[r["doc_id"]]) for r in got) < 2e-3
