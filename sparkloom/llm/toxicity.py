"""Toxicity scores from a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Texts are lower-cased with white space runs as one space; their character n-grams are hashed into ``2**bits`` features, each
present or absent in a document. From all labelled documents the operator counts in how many of either class each feature
is; the smoothed log ratio of the two shares, r, scales the feature. The ``features`` whose ratio is best supported enter a
logistic regression on r (present) or 0 (absent), fitted on at most ``sample`` labelled documents, chosen by a hash of
doc_id. The fitted weights times r are one number per feature and go out with the query: ``4 * 2**bits`` bytes at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import _words
from sparkloom.storage import materialize, release, spread

ORDERS = (4, 5, 6, 7)
_K = np.uint64(0x9E3779B97F4A7C15)
_ORDER_SALT = {n: np.uint64(0xD6E8FEB86659FD93 * (2 * n + 1) % 2**64) for n in range(1, 9)}


def _hashes(texts: list[str], bits: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order the feature of the n-gram that begins at each code point, and where texts begin."""
    plain = [" " + " ".join(t.lower().split()) + " " for t in texts]
    at = np.concatenate([[0], np.cumsum([len(p) for p in plain])])
    a = np.frombuffer("".join(plain).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
    out, h = [], a.copy()
    for n in range(2, max(ORDERS) + 1):
        h = h[:-1] * _K + a[n - 1 :]
        if n in ORDERS:
            x = (h ^ _ORDER_SALT[n]) * np.uint64(0xFF51AFD7ED558CCD)
            out.append(((x ^ (x >> np.uint64(32))) * np.uint64(0xC4CEB9FE1A85EC53) >> np.uint64(64 - bits)).astype(np.uint32))
    return out, at


def _present(texts: list[str], bits: int) -> Iterator[np.ndarray]:
    """The features of each text, each once, ascending."""
    found, at = _hashes(texts, bits)
    mark = np.zeros(1 << bits, dtype=bool)
    for i in range(len(texts)):
        each = np.concatenate([h[at[i] : max(at[i], at[i + 1] - n + 1)] for n, h in zip(ORDERS, found, strict=True)])
        if len(each) < 2000:
            yield np.unique(each).astype(np.int64)
        else:
            mark[each] = True
            out = np.flatnonzero(mark)
            mark[out] = False
            yield out


def _counts(labelled: DataFrame, bits: int) -> DataFrame:
    """feature, in how many documents of class 1, of class 0; feature -1: the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, (1 << bits) + 1), dtype=np.int64)
        for batch, texts in _words.chunks(batches):
            for y, f in zip(batch.column(0).to_pylist(), _present(texts, bits), strict=True):
                n[y, f] += 1
                n[y, -1] += 1
        some = np.flatnonzero(n.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.where(some == 1 << bits, -1, some).astype(np.int32)), pa.array(n[1, some]), pa.array(n[0, some])], ["feature", "ones", "zeros"])

    return labelled.select("label", "text").mapInArrow(run, "feature int, ones long, zeros long").groupBy("feature").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))


def fit_logistic(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, ridge: float = 1.0, steps: int = 40) -> tuple[np.ndarray, float]:
    """Weights and intercept over features scaled by ``scale``; rows hold the indices of the features present.

    Newton steps on the mean log loss plus ridge, each solved by conjugate gradients and halved until the loss falls.
    """
    cols = np.concatenate(rows) if rows else np.empty(0, np.int64)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    x, n, m = scale[cols], max(1, len(rows)), len(scale)
    penalty = np.append(np.full(m, ridge / n), 1e-9)

    def ahead(v: np.ndarray) -> np.ndarray:
        return np.bincount(row, x * v[cols], minlength=n) + v[m]

    def back(g: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(cols, x * g[row], minlength=m), g.sum())

    def loss(v: np.ndarray) -> float:
        return float(np.logaddexp(0, -(2 * y - 1) * ahead(v)).mean() + 0.5 * (penalty * v * v).sum())

    v, now = np.zeros(m + 1), np.log(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(ahead(v), -35, 35)))
        g = back(p - y) / n + penalty * v
        if np.abs(g).max() < 1e-7:
            break
        curve = p * (1 - p) / n
        d, r = np.zeros(m + 1), -g
        q, rr = r.copy(), r @ r
        for _ in range(60):
            hq = back(curve * ahead(q)) + penalty * q
            k = rr / (q @ hq)
            d += k * q
            r -= k * hq
            rr, old = r @ r, rr
            if rr < 1e-6 * (g @ g):
                break
            q = r + rr / old * q
        step = 1.0
        while step > 1e-6 and (new := loss(v + step * d)) >= now:
            step /= 2
        if step <= 1e-6:
            break
        v, now = v + step * d, new
    return v[:m], float(v[m])


def labelled_texts(docs: DataFrame, labels: DataFrame, broadcast_rows: int = 1_000_000) -> DataFrame:
    """doc_id, text and label of documents that ``labels`` (doc_id, label) names. Few labels go to the texts, many meet them by a shuffle."""
    labels = labels.select("doc_id", "label")
    return spread(docs.select("doc_id", "text")).join(F.broadcast(labels) if labels.count() <= broadcast_rows else labels, "doc_id")


def fit(labelled: DataFrame, bits: int = 20, features: int = 4096, sample: int = 20_000, alpha: float = 1.0) -> tuple[np.ndarray, float]:
    """The weight of each hashed feature and the intercept, from rows of doc_id, text and label (0 or 1).

    Without rows of both classes nothing can be told apart: all weights are 0 and the intercept is the log odds of what is there.
    """
    _words.small_batches(labelled)
    labelled = labelled.filter("label in (0, 1)").select("doc_id", "text", F.col("label").cast("int").alias("label"))
    counts = materialize(_counts(labelled, bits), "features")
    found = {r["feature"]: (r["ones"], r["zeros"]) for r in counts.filter("feature = -1").collect()}
    ones, zeros = found.get(-1, (0, 0))
    weights = np.zeros(1 << bits, dtype=np.float32)
    if not ones or not zeros:
        return weights, float(np.log((ones + alpha) / (zeros + alpha)))
    p, q = (F.col("ones") + alpha) / (ones + 2 * alpha), (F.col("zeros") + alpha) / (zeros + 2 * alpha)
    support = 1 / (F.col("ones") + alpha) + 1 / (F.col("zeros") + alpha)
    scored = counts.filter("feature >= 0").select("feature", F.log(p / q).alias("r"), F.abs(F.log(p / q) / F.sqrt(support)).alias("z"))
    top = scored.orderBy(F.desc("z"), "feature").limit(features).collect()
    release(counts)
    chosen = np.array(sorted(r["feature"] for r in top), dtype=np.int64)
    ratio = {r["feature"]: r["r"] for r in top}
    scale = np.array([ratio[f] for f in chosen.tolist()])
    place = np.full(1 << bits, -1, dtype=np.int32)
    place[chosen] = np.arange(len(chosen))
    held = labelled.sparkSession.sparkContext.broadcast(place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _words.chunks(batches, 2):
            rows = [held.value[f] for f in _present(texts, bits)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r[r >= 0].tobytes() for r in rows], pa.binary())], ["order", "label", "present"])

    rare = "ones" if ones <= zeros else "zeros"
    few, many = (1, 0) if rare == "ones" else (0, 1)
    order = F.xxhash64(F.lit("fit"), "doc_id")
    half = sample // 2
    parts = [labelled.filter(F.col("label") == few).select(order.alias("order"), "doc_id", "label", "text"), labelled.filter(F.col("label") == many).select(order.alias("order"), "doc_id", "label", "text")]
    kept = []
    for part, total in zip(parts, sorted((ones, zeros)), strict=True):
        # Hashes below this share of their range: the sample's expected size, without sorting texts.
        share = min(1.0, half / total)
        kept.append(part.filter(F.col("order") <= F.lit(int(-(2**63) + share * (2**64 - 1)))) if share < 1 else part)
    rows = kept[0].unionByName(kept[1]).select("order", "label", "text").mapInArrow(run, "order long, label int, present binary").collect()
    held.destroy()
    rows.sort(key=lambda r: (r["order"], r["label"], bytes(r["present"])))
    y = np.array([r["label"] for r in rows], dtype=np.float64)
    w, b = fit_logistic([np.frombuffer(r["present"], dtype=np.int32).astype(np.int64) for r in rows], y, scale)
    # The sample holds the classes in another proportion than the labels do; the intercept is set right for that.
    b += np.log(ones / zeros) - np.log(max(1, y.sum()) / max(1, len(y) - y.sum()))
    weights[chosen] = w * scale
    return weights, float(b)


def score(docs: DataFrame, weights: np.ndarray, intercept: float, *keep: str | Column) -> DataFrame:
    """``keep`` columns (doc_id by default) and score, the probability of label 1; null and empty texts score as a text without features does."""
    bits = int(len(weights)).bit_length() - 1
    held = _words.small_batches(docs).sparkContext.broadcast(weights)
    kept = spread(docs.select(*(keep or ("doc_id",)), "text"))
    schema = kept.drop("text").withColumn("score", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = held.value
        for batch, texts in _words.chunks(batches, batch_text):
            found, at = _hashes(texts, bits)
            total = np.full(len(texts), intercept)
            doc, feature = [], []
            for n, h in zip(ORDERS, found, strict=True):
                hit = np.flatnonzero(w[h])
                text = np.searchsorted(at, hit, side="right") - 1
                inside = hit + n <= at[text + 1]
                doc.append(text[inside])
                feature.append(h[hit[inside]])
            both = np.unique(np.concatenate(doc) * (1 << bits) + np.concatenate(feature).astype(np.int64))
            total += np.bincount(both >> bits, w[both & ((1 << bits) - 1)].astype(np.float64), minlength=len(texts))
            yield pa.RecordBatch.from_arrays([*batch.columns[:batch_text], pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))], schema=None, names=[*names, "score"])

    batch_text, names = len(kept.columns) - 1, kept.columns[:-1]
    return kept.mapInArrow(run, schema)
