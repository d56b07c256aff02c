"""Near-duplicate removal by MinHash, LSH banding and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.text import normalize
from sparkloom.functions.words import CHUNK_BYTES, hash_words, shingle_hashes
from sparkloom.operators.components import FEW_EDGES, connected_components
from sparkloom.storage import materialize, release, small_batches, spread


def shingle_list(c: str | Column, n: int = 5) -> Column:
    """Word n-grams of text; a text of fewer words gives itself, an empty one null."""
    words = F.filter(F.split(F.col(c) if isinstance(c, str) else c, r"\s+", -1), lambda w: w != "")
    # The words beside themselves moved by one, two and so on: a lambda that took a slice for each shingle would split anew each time.
    moved = F.arrays_zip(*[F.slice(words, k + 1, F.greatest(F.size(words), F.lit(1))).alias(f"w{k}") for k in range(n)])
    whole = F.slice(moved, 1, F.greatest(F.size(words) - n + 1, F.lit(0)))
    many = F.transform(whole, lambda x: F.concat_ws(" ", *[x[f"w{k}"] for k in range(n)]))
    return F.when(F.size(words) >= n, many).when(F.size(words) > 0, F.array(F.array_join(words, " ")))


def _permutations(num_hashes: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(1, 2**63, num_hashes, dtype=np.uint64) | np.uint64(1), rng.integers(0, 2**63, num_hashes, dtype=np.uint64)


def signatures(words: np.ndarray, first: np.ndarray, num_hashes: int, ngram_size: int, seed: int) -> np.ndarray:
    """A row of minima for each text with words, from word hashes of many texts and where each text's begin."""
    a, b = _permutations(num_hashes, seed)
    runs, at = shingle_hashes(words, first, ngram_size)
    at = at[:-1][np.diff(at) > 0]
    # One permutation at a time over the runs of all texts: multiply, add, and keep the upper half.
    return np.stack([np.minimum.reduceat((runs * x + y) >> np.uint64(32), at) for x, y in zip(a, b, strict=True)], axis=1).astype(np.int64)


def minhash(c: str | Column, num_hashes: int = 64, ngram_size: int = 5, seed: int = 42) -> Column:
    """The signature of a text's word n-grams (array of long), null for null or blank text.

    Words, n-grams and permutations are NumPy arrays over a chunk of texts, however short each text is.
    """

    @F.pandas_udf("array<long>")
    def sign(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            texts = [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in s]
            out: list = []
            begin = size = 0
            for i, t in enumerate(texts):
                size += len(t)
                if size >= CHUNK_BYTES or i + 1 == len(texts):
                    words, first = hash_words(texts[begin : i + 1])
                    some = np.diff(first) > 0
                    found = iter(signatures(words, first, num_hashes, ngram_size, seed) if some.any() else ())
                    out += [next(found) if x else None for x in some]
                    begin, size = i + 1, 0
            yield pd.Series(out, dtype=object)

    return sign(c)


def optimal_bands(threshold: float, num_hashes: int) -> tuple[int, int]:
    """(bands, rows) that minimise the mean of the false positive and false negative areas at the threshold; first wins."""

    def area(f, low: float, high: float) -> float:
        x = np.linspace(low, high, 2001)
        y = f(x)
        return float(((y[1:] + y[:-1]) * np.diff(x)).sum() / 2)

    best, found = np.inf, (1, 1)
    for b in range(1, num_hashes + 1):
        for r in range(1, num_hashes // b + 1):
            met = lambda s, b=b, r=r: 1 - (1 - s**r) ** b
            error = 0.5 * area(met, 0, threshold) + 0.5 * area(lambda s, met=met: 1 - met(s), threshold, 1)
            if error < best:
                best, found = error, (b, r)
    return found


def bands_for(threshold: float, num_hashes: int, recall: float) -> tuple[int, int]:
    """(bands, rows) with the most rows a band by which a pair at the threshold meets with a chance of ``recall`` or more."""
    for r in range(num_hashes, 0, -1):
        b = num_hashes // r
        if 1 - (1 - threshold**r) ** b >= recall:
            return b, r
    raise ValueError(f"{num_hashes} hashes don't reach a recall of {recall} at {threshold}")


def band_edges(signatures: DataFrame, node: str, bands: str) -> DataFrame:
    """Edges (u, v) from each node to the least node that agrees with it in a band's hash; a bucket of n nodes gives n - 1 at most."""
    hashed = signatures.filter(F.col(bands).isNotNull() & F.col(node).isNotNull()).select(F.col(node).alias("v"), F.explode(bands).alias("bucket"))
    # Minima are combined before they move, and a table of them leaves the join free to split a bucket that very many share.
    least = materialize(hashed.groupBy("bucket").agg(F.min("v").alias("u"), F.count("*").alias("n")).filter("n > 1").drop("n"), "buckets")
    return hashed.join(least, "bucket").filter("u <> v").select("u", "v").distinct()


def _signed(docs: DataFrame, node: str, text: str, threshold: float, num_hashes: int, ngram_size: int, bands: tuple[int, int] | None, recall: float | None) -> DataFrame:
    """A table (node, bands, g): a hash per band, and one of them all; null for texts without words. Signatures themselves stay in their task."""
    b, r = bands or (bands_for(threshold, num_hashes, recall) if recall else optimal_bands(threshold, num_hashes))
    plain = normalize("text", remove_punct=True, lowercase=True, white_space=True)
    rows = spread(small_batches(docs).select(F.col(node).alias("node"), F.col(text).alias("text")))
    rows = rows.select("node", minhash(plain, num_hashes, ngram_size).alias("s"))
    pieces = F.transform(F.sequence(F.lit(0), F.lit(b - 1)), lambda i: F.xxhash64(i, F.slice(F.col("s"), i * r + 1, r)))
    rows = rows.select("node", F.when(F.col("s").isNotNull(), pieces).alias("bands"))
    return materialize(rows.select("node", "bands", F.when(F.col("bands").isNotNull(), F.xxhash64("bands")).alias("g")), "signatures")


def _groups(signed: DataFrame) -> DataFrame:
    """A table (g, rep): texts that agree in all bands are one group, and near-duplicate groups share the least node of theirs.

    Only groups meet by band and go through the components, by a number each; copies, and names as long as they may be, stay out of it.
    """
    some = signed.filter("g is not null and node is not null")
    groups = materialize(some.groupBy("g").agg(F.min(F.struct("node", "bands")).alias("m")).select("g", F.col("m.node").alias("first"), F.col("m.bands").alias("bands")), "groups")
    # A node of several texts links their groups.
    same = some.select("node", "g").withColumn("u", F.lag("g").over(Window.partitionBy("node").orderBy("g"))).filter("u <> g").select("u", F.col("g").alias("v"))
    found = connected_components(band_edges(groups, "g", "bands").unionAll(same), one_task_rows=FEW_EDGES, split_hubs=True)
    linked = groups.select("g", "first").join(found.select(F.col("node").alias("g"), "component"), "g")
    reps = materialize(linked.groupBy("component").agg(F.min("first").alias("rep")), "reps")
    every = groups.select("g", "first").join(found.select(F.col("node").alias("g"), "component"), "g", "left").join(reps, "component", "left")
    named = materialize(every.select("g", F.coalesce("rep", "first").alias("rep")), "named")
    release(groups, reps)
    return named


def dedup(docs: DataFrame, node: str, text: str, threshold: float = 0.7, num_hashes: int = 64, ngram_size: int = 5, bands: tuple[int, int] | None = None, recall: float | None = None) -> DataFrame:
    """``docs`` with rep, the least node of each group of near-duplicates (itself for rows without one), and is_duplicate.

    Pairs that meet in a band are linked unverified. The default bands weigh lost against false links evenly, so at the threshold of 0.7 (8 bands of 8)
    a pair meets with a chance of 0.38 only, at 0.85 with 0.92; with ``recall`` they are chosen by :func:`bands_for` (0.95: 16 bands of 4), which
    links more pairs below the threshold, too.
    """
    signed = _signed(docs, node, text, threshold, num_hashes, ngram_size, bands, recall)
    # Any of a node's groups will do, as these are linked.
    of = signed.filter("g is not null and node is not null").groupBy("node").agg(F.min("g").alias("g"))
    return mark_duplicates(docs, node, of.join(_groups(signed), "g").select("node", F.col("rep").alias("component")))


def representatives(docs: DataFrame, node: str, text: str, threshold: float = 0.7, num_hashes: int = 64, ngram_size: int = 5, bands: tuple[int, int] | None = None, recall: float | None = None) -> DataFrame:
    """The nodes that :func:`keep_representatives` leaves of :func:`dedup`, each once: one a group, so that ``docs`` are read once and no text or node is joined."""
    signed = _signed(docs, node, text, threshold, num_hashes, ngram_size, bands, recall)
    alone = signed.filter("g is null or node is null").select("node").distinct().join(signed.filter("g is not null").select("node"), "node", "left_anti")
    return _groups(signed).select(F.col("rep").alias("node")).distinct().unionAll(alone).withColumnRenamed("node", node)


def mark_duplicates(docs: DataFrame, node: str, components: DataFrame) -> DataFrame:
    """Adds rep and is_duplicate from (node, component); rows without a component represent themselves."""
    names = components.select(F.col("node").alias("_n"), F.col("component").alias("_rep"))
    out = docs.join(names, F.col(node) == F.col("_n"), "left").withColumn("rep", F.coalesce("_rep", node)).drop("_n", "_rep")
    return out.withColumn("is_duplicate", ~F.col("rep").eqNullSafe(F.col(node)))


def keep_representatives(marked: DataFrame) -> DataFrame:
    return marked.filter(~F.col("is_duplicate")).drop("rep", "is_duplicate")
