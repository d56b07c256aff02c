"""N-gram Jaccard join with an R-tree over count vectors.

Each document is the set of its distinct word shingles. Two documents link when their sets' Jaccard similarity reaches a
threshold; the operator finds the groups that links connect, without losing a link between different texts.

1. Documents with equal sets are one class and go on as its least doc_id, so a group of copies costs one row per task.
2. Linked sets, each sorted by hash, share runs of three neighbouring shingles. Where sets are small, counting shows that one
   of the first ``c * n + 1`` runs is shared; where they are large, the first ``runs_for(t)`` runs do, but for one pair in 10**12
   (less than for clashes of hashes). Tiny sets use single shingles. Texts that only share a passage seldom share a run,
   whatever the passage's frequency. Classes with a common run fall into one part (linear: each points to the least with it).
3. Inside a part, shingles are counted and each set's rarest ``n - ceil(t * n) + 1`` are taken; linked sets share one of these,
   which splits the part further and exactly. A part of over ``block_shingles`` is split so by a distributed count first.
4. In what is left, shingles are hashed into groups and a set's group counts are a point. A packed R-tree holds the points
   with each node's largest count per group; the sum over groups of the smaller of two counts bounds the overlap from above.
   Nodes and points whose bound is below the overlap that the sizes ask for are left out, the rest is verified on the sets.
   Pairs that earlier links already connect need no verification, so a dense group costs about a link per member.
5. Parts still over ``block_shingles`` are cut into blocks and each pair of blocks is a task of its own, which returns at most
   one connecting link per class. Components over all verified links give the result.

The R-tree alone would compare nearly all nodes: counts of unrelated texts of one size lie close together, and no few
coordinates part them. Hence steps 2 and 3, which deal the points to many small trees.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import _words
from sparkloom.operators.components import FEW_EDGES, connected_components
from sparkloom.storage import materialize, release, spread

#: Points under a node of the tree.
NODE = 16
#: Rows (two integers each) up to which the members of parts are broadcast.
BROADCAST_ROWS = 1_000_000


def _sets(texts: list[str], size: int) -> Iterator[np.ndarray]:
    words, first = _words.hash_words(_words.lowered(texts))
    h, at = _words.shingle_hashes(words, first, size)
    for i in range(len(texts)):
        yield np.unique(h[at[i] : at[i + 1]])


def runs_for(t: Fraction, miss: float = 1e-12) -> int:
    """How many places of the united, sorted sets hold a run of three shared ones, but for ``miss`` of pairs with similarity t.

    Places are shared with probability t each; the chance that n have no run of three falls as the n-th power of the largest
    root of x^3 = (1 - t)(x^2 + t x + t^2).
    """
    t = float(t)
    root = max(r.real for r in np.roots([1, t - 1, (t - 1) * t, (t - 1) * t * t]) if abs(r.imag) < 1e-9)
    return math.ceil(math.log(miss) / math.log(root))


def first_keys(s: np.ndarray, t: Fraction, most: int) -> np.ndarray:
    """Keys of one set (sorted), of which any two linked sets share one.

    With x shingles only here and y only there, x + t y <= (1 - t) n. A lost shingle breaks three runs, a new one two, so that
    n - 2 - c n runs are common, c = max(3 (1 - t), 2 (1 - t) / t): positive from n = 3 / (1 - c) on.
    """
    n = len(s)
    c = max(3 * (1 - t), 2 * (1 - t) / t)
    least = math.ceil(3 / (1 - c)) if c < 1 else None
    out = []
    if n and (least is None or n <= least / t):
        out.append(s[: n - math.ceil(t * n) + 1])
    if least is not None and n >= least:
        k = min(math.floor(c * n) + 1, most, n - 2)
        out.append(_words.mix(s[:k] * np.uint64(3) + s[1 : k + 1] * np.uint64(5) + s[2 : k + 2] * np.uint64(7)))
    return np.concatenate(out) if out else s


def _first_keys(docs: DataFrame, size: int, t: Fraction, most: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set, and its keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _words.chunks(batches):
            counts, digests, heads = [], [], []
            for s in _sets(texts, size):
                counts.append(len(s))
                digests.append(hashlib.md5(s.tobytes()).digest())
                heads.append(first_keys(s, t, most).view(np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in heads])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(heads)))],
                ["doc_id", "n_shingles", "digest", "head"],
            )

    return spread(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, n_shingles long, digest binary, head array<long>")


def rare_parts(sets: list[np.ndarray], t: Fraction) -> list[list[int]]:
    """Groups of sets (by place) that share one of their rarest shingles, frequency counted among these sets."""
    lens = np.array([len(s) for s in sets])
    found, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    at = np.concatenate([[0], np.cumsum(lens)])
    parent = list(range(len(sets)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    least: dict[int, int] = {}
    for i, n in enumerate(lens.tolist()):
        tokens = inverse[at[i] : at[i + 1]]
        order = np.argsort(counts[tokens], kind="stable")[: n - math.ceil(t * n) + 1]
        for k in tokens[order][counts[tokens[order]] > 1].tolist():
            a, b = root(least.setdefault(k, i)), root(i)
            parent[max(a, b)] = min(a, b)
    groups: dict[int, list[int]] = {}
    for i in range(len(sets)):
        groups.setdefault(root(i), []).append(i)
    return [g for g in groups.values() if len(g) > 1]


class CountTree:
    """A packed R-tree over points of group counts, with the least and largest set size under each node.

    Sets come sorted by size, so packing keeps sets of like size together; a node's bound is its largest count per group.
    """

    def __init__(self, sets: list[np.ndarray], groups: int):
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        self.points = np.stack([np.bincount((s % np.uint64(groups)).astype(np.int64), minlength=groups) for s in sets])
        self.points = self.points.astype(np.min_scalar_type(int(self.points.max(initial=0))))
        self.levels = []
        most, low, high = self.points, self.sizes, self.sizes
        while len(most) > NODE:
            cut = np.arange(0, len(most), NODE)
            most, low, high = np.maximum.reduceat(most, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)
            self.levels.append((most, low, high))

    def candidates(self, i: int, t: Fraction, label: np.ndarray) -> np.ndarray:
        """Points before i with another label whose bound with point i reaches the overlap that both sizes ask for."""
        p, n = self.points[i], self.sizes[i]
        num, den = t.numerator, t.numerator + t.denominator
        ids = np.arange(len(self.levels[-1][0]) if self.levels else len(self.points))
        for most, low, high in reversed(self.levels):
            ids = ids[ids < len(most)]
            ok = (high[ids] * t.denominator >= t.numerator * n) & (low[ids] * t.numerator <= t.denominator * n)
            ids = ids[ok]
            ids = ids[np.minimum(most[ids], p).sum(1, dtype=np.int64) * den >= num * (n + low[ids])]
            ids = (ids[:, None] * NODE + np.arange(NODE)).reshape(-1)
        ids = ids[ids < i]
        ids = ids[label[ids] != label[i]]
        ok = (self.sizes[ids] * t.denominator >= t.numerator * n) & (self.sizes[ids] * t.numerator <= t.denominator * n)
        ids = ids[ok]
        return ids[np.minimum(self.points[ids], p).sum(1, dtype=np.int64) * den >= num * (n + self.sizes[ids])]


def link_sets(ids: list[int], sets: list[np.ndarray], t: Fraction, groups: int = 256, side: list[int] | None = None) -> list[tuple[int, int]]:
    """Verified links that connect the same sets as all links with similarity t or more do.

    side: only links between a 0 and a 1 count as wanted (links inside a side are found by another task).
    """
    order = sorted(range(len(ids)), key=lambda k: (len(sets[k]), ids[k]))
    ids, sets = [ids[k] for k in order], [sets[k] for k in order]
    sides = np.array([side[k] for k in order]) if side else None
    tree = CountTree(sets, groups)
    label = np.arange(len(ids))  # equal for sets that links connect
    members = {k: [k] for k in range(len(ids))}
    degree = np.zeros(len(ids), dtype=np.int64)
    links: list[tuple[int, int]] = []

    def link(i: int, j: int) -> bool:
        same = np.intersect1d(sets[i], sets[j], assume_unique=True).size
        if same * t.denominator < t.numerator * (len(sets[i]) + len(sets[j]) - same):
            return False
        links.append((ids[i], ids[j]))
        degree[[i, j]] += 1
        a, b = int(label[i]), int(label[j])
        if len(members[a]) > len(members[b]):
            a, b = b, a
        moved = members.pop(a)
        label[moved] = b
        members[b] += moved
        return True

    hubs: list[int] = []
    for i in range(1, len(ids)):
        # In a group of near copies most link with one of them: trying those with most links first leaves little to bound.
        if i % 64 == 0:
            hubs = [max(m, key=degree.__getitem__) for m in sorted(members.values(), key=len)[-4:] if len(m) > 8]
        for j in hubs:
            if label[j] != label[i] and (sides is None or sides[j] != sides[i]):
                link(i, j)
        found = tree.candidates(i, t, label)
        if sides is not None:
            found = found[sides[found] != sides[i]]
        found = found[::-1]
        while len(found := found[label[found] != label[i]]):
            link(i, int(found[0]))
            found = found[1:]
    return links


def _link_parts(rows: DataFrame, t: Fraction, groups: int) -> DataFrame:
    """rows: key, side, id, shingles; sorted by key in each partition. Gives links (u, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def done() -> pa.RecordBatch:
            ids, sides, sets = [x[0] for x in held], [x[1] for x in held], [x[2] for x in held]
            links = []
            for g in rare_parts(sets, t) if len(held) > 1 else []:
                links += link_sets([ids[k] for k in g], [sets[k] for k in g], t, groups, [sides[k] for k in g] if any(sides) else None)
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], ["u", "v"])

        for batch in batches:
            for k, i, s, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if k != key:
                    if held:
                        yield done()
                    key, held = k, []
                held.append((i, s, np.frombuffer(b, dtype=np.uint64)))
        if held:
            yield done()

    return rows.select("key", "id", "side", "shingles").mapInArrow(run, "u long, v long")


def _to_least(rows: DataFrame) -> DataFrame:
    """rows: rep, token. An edge (u, v) from each rep to the least one with the same token."""
    # Minima are combined before they move, and a table of them leaves the join free to split a token that very many sets have.
    shared = materialize(rows.groupBy("token").agg(F.min("rep").alias("least"), F.count("*").alias("n")).filter("n > 1").drop("n"), "shared")
    return rows.join(shared, "token").filter("rep <> least").select(F.col("rep").alias("u"), F.col("least").alias("v"))


def _rarest(members: DataFrame, t: Fraction) -> DataFrame:
    """members: component, id, shingles. (rep, token): each set's rarest shingles, counted among all members."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = np.frombuffer(b, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), i, dtype=np.int64)), pa.array(s)], ["rep", "token"])

    rows = members.select("id", "shingles").mapInArrow(tokens, "rep long, token long").repartition("token")
    counted = rows.join(rows.groupBy("token").agg(F.count("*").alias("n")), "token")
    keep = F.size("all") - F.ceil(F.lit(t.numerator) * F.size("all") / F.lit(t.denominator)) + 1
    each = counted.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("all"))  # one set a row
    return each.select("rep", F.explode(F.slice("all", 1, keep.cast("int"))).alias("x")).select("rep", "x.token")


def jaccard_components(docs: DataFrame, size: int = 5, similarity: str = "0.8", groups: int = 256, block_shingles: int = 4_000_000, exact: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles and component_id, the least doc_id reachable by links.

    Other columns of ``docs`` are not looked at. Null or empty texts, and texts without words, have no shingles and link with
    nothing. Rows that repeat a doc_id count as one document. Rows whose doc_id is null get a null component and link with
    nothing. An empty table gives an empty result. Sets are compared by 64-bit shingle hashes. With ``exact`` large sets send all the
    runs that counting asks for, not the first ``runs_for(t)``: no pair is left to chance, for several times the keys.
    """
    _words.small_batches(docs)
    t = Fraction(similarity)
    heads = materialize(_first_keys(docs, size, t, 1 << 62 if exact else runs_for(t)), "heads")
    known = heads.filter("n_shingles > 0 and doc_id is not null")
    classes = materialize(known.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("head").alias("head")), "classes")
    parts = materialize(connected_components(_to_least(classes.select("rep", F.explode("head").alias("token"))), one_task_rows=FEW_EDGES), "parts")

    # A small table of members goes to the texts, a large one meets them by a shuffle.
    near = F.broadcast(parts) if parts.count() <= BROADCAST_ROWS else parts
    texts = docs.select("doc_id", "text").join(near, docs["doc_id"] == near["node"]).select("component", F.col("doc_id").alias("id"), "text")

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, chunk in _words.chunks(batches, 2):
            sets = [s.tobytes() for s in _sets(chunk, size)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.binary())], ["component", "id", "shingles"])

    members = materialize(texts.mapInArrow(to_sets, "component long, id long, shingles binary"), "sets")
    large = members.groupBy("component").agg(F.sum(F.length("shingles")).alias("bytes")).filter(F.col("bytes") > 8 * block_shingles)
    if not large.isEmpty():
        finer = connected_components(_to_least(_rarest(members.join(large.select("component"), "component", "left_semi"), t)), one_task_rows=FEW_EDGES)
        kept = members.join(large, "component", "left_anti").unionByName(members.drop("component").join(finer.withColumnRenamed("node", "id"), "id").select("component", "id", "shingles"))
        members, before = materialize(kept, "sets"), members
        release(before)
    blocks = members.groupBy("component").agg(F.ceil(F.sum(F.length("shingles")) / (8 * block_shingles)).cast("long").alias("blocks"))
    placed = members.join(blocks, "component").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    # Each set goes to the pairs of its block with every block, its own included.
    pairs = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(
        F.concat_ws("-", "component", F.least("block", "other"), F.greatest("block", "other")).alias("key"),
        "id",
        F.when(F.col("block") > F.col("other"), 1).otherwise(0).alias("side"),
        "shingles",
    )
    links = _link_parts(pairs.repartition("key").sortWithinPartitions("key"), t, groups)
    found = connected_components(links, one_task_rows=FEW_EDGES)
    release(parts, members)
    reps = classes.select("digest", "rep").join(found, F.col("rep") == F.col("node"), "left").select("digest", F.coalesce("component", "rep").alias("class"))
    named = heads.select("doc_id", "n_shingles", "digest").join(reps, "digest", "left")
    return named.select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("class")).otherwise(F.col("doc_id"))).alias("component_id")
    )
