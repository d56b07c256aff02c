"""Quality by perplexity under an interpolated modified Kneser-Ney n-gram model trained on trusted text.

White space runs are one space, letters keep their case (capitals in the wrong places are noise), and the model reads characters:
character n-grams are few enough that each task can send every distinct one it holds to the counts, which words are not (nearly
every word trigram is new).

1. Each task sends the distinct n-grams of its documents, with how often its trusted documents hold them.
2. Counts are summed per n-gram, sharded by n-gram; lower orders count distinct left neighbours; contexts count how many
   followers have count one, two, or more. Discounts come from the counts of counts of each order.
3. Probabilities are computed for every n-gram of the corpus, order by order, from the n-grams' counts, their contexts' sums and
   the probability one order down. Nothing here is collected but five numbers per order.
4. Documents get the mean negative log probability of their characters (log perplexity). If the scored n-grams are few enough
   (``broadcast_ngrams``, checked by a count), they go to every task as one table and texts stay where they are. Otherwise
   texts and the n-grams that each block of documents needs meet by block; results are the same.
5. Each language's limits are quantiles over its trusted documents of like length, as the perplexities of long texts lie far closer
   together than those of short ones; outside them a document is rejected. The upper limit finds noise and ordinary words in
   unlikely order, the lower one text that repeats itself.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm import _words
from sparkloom.storage import materialize, materialize_observed, release, spread

#: Stands before each text order - 1 times, so that its first characters have a context too.
PAD = "\x02"
_K = np.uint64(0x9E3779B97F4A7C15)
#: Distinct n-grams that a task holds before it sends them on; a later duplicate is only summed.
HELD = 1_000_000
SCHEMA = "gram string, count long"


def _grams(texts: list[str], order: int) -> tuple[str, np.ndarray, np.ndarray]:
    """The padded texts as one string, the hash of the n-gram ending at each character, and where texts begin in the hashes."""
    plain = [" ".join(t.replace(PAD, " ").split()) for t in texts]
    joined = PAD * (order - 1) + (PAD * (order - 1)).join(plain)
    a = np.frombuffer(joined.encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
    h = a.copy()
    for n in range(2, order + 1):
        h = h[:-1] * _K + a[n - 1 :]
    lens = np.array([len(p) for p in plain], dtype=np.int64)
    at = np.concatenate([[0], np.cumsum(lens + order - 1)])
    # Between two texts stand order - 1 hashes that end in padding; they belong to no text.
    return joined, h, at


def _inside(at: np.ndarray, order: int, n: int) -> np.ndarray:
    """Whether each hash ends in a character of a text, and not in padding."""
    out = np.ones(n, dtype=bool)
    for j in range(order - 1):
        stop = at[1:-1] - 1 - j
        out[stop[(stop >= 0) & (stop < n)]] = False
    return out


def _count(docs: DataFrame, order: int) -> DataFrame:
    """docs: text, trusted. Each distinct n-gram and its count in trusted texts, once or a few times per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Hashes ascending, with the count and the place in names of each; an n-gram is cut out of the text only when it is new.
        seen, sums, places, names = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), []

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([names[k] for k in places.tolist()], pa.string()), pa.array(sums)], ["gram", "count"])

        for batch, texts in _words.chunks(batches, 0):
            joined, h, at = _grams(texts, order)
            sure = np.repeat(np.array(batch.column(1).fill_null(False).to_pylist(), dtype=bool), np.diff(at))[: len(h)]
            place = np.flatnonzero(_inside(at, order, len(h)))
            codes, found = pd.factorize(h[place])
            first = np.empty(len(found), dtype=np.int64)
            first[codes[::-1]] = place[::-1]
            counts = np.bincount(codes, sure[place], minlength=len(found)).astype(np.int64)
            k = np.searchsorted(seen, found)
            old = np.zeros(len(found), dtype=bool)
            if len(seen):
                old = seen[np.minimum(k, len(seen) - 1)] == found
                sums[k[old]] += counts[old]
            new = ~old
            ids = np.arange(len(names), len(names) + int(new.sum()))
            names += [joined[i : i + order] for i in first[new].tolist()]
            seen, sums, places = np.concatenate([seen, found[new]]), np.concatenate([sums, counts[new]]), np.concatenate([places, ids])
            ranks = np.argsort(seen, kind="stable")
            seen, sums, places = seen[ranks], sums[ranks], places[ranks]
            if len(seen) > HELD:
                yield done()
                seen, sums, places, names = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), []
        if len(seen):
            yield done()

    return docs.select("text", "trusted").mapInArrow(run, SCHEMA).groupBy("gram").agg(F.sum("count").alias("count"))


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """What modified Kneser-Ney takes off counts of one, two, and three or more; 0.5, 1, 1.5 where counts of counts are missing."""
    if not (n1 and n2 and n3 and n4):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(x, 0.0), k + 1.0) for k, x in enumerate(d))


def _taken(c: Column, d: tuple[float, float, float]):
    return F.when(c == 1, d[0]).when(c == 2, d[1]).when(c >= 3, d[2]).otherwise(0.0)


def _counts_of() -> dict[str, Column]:
    """What the discounts of an order need: how many of its n-grams have count one, two, three and four, and how many have any."""
    c = F.col("count")
    return {f"n{k}": F.sum((c == k).cast("long")) for k in (1, 2, 3, 4)} | {"known": F.sum((c > 0).cast("long"))}


def score_grams(grams: DataFrame, order: int, seen: dict) -> DataFrame:
    """(gram, logp) for every row of ``grams`` (gram, count): the natural log of the last character's probability. The result is a table.

    ``seen``: :func:`_counts_of` of ``grams``. Each order is one grouping of the order above: every n-gram, with the number of distinct left
    neighbours that it has in trusted text (0 where it has none). Contexts are summed by a window, whose partitions hold a row per
    character that follows, and probabilities one order down come by a join.
    """
    tables, counts = {order: grams}, {order: seen}
    for n in range(order - 1, 0, -1):
        each = tables[n + 1].groupBy(F.substring("gram", 2, n).alias("gram")).agg(F.sum((F.col("count") > 0).cast("long")).alias("count"))
        tables[n], counts[n] = materialize_observed(each, f"grams{n}", **_counts_of())
    scored = None
    for n in range(1, order + 1):
        c, of = F.col("count"), {k: v or 0 for k, v in counts[n].items()}
        d = discounts(of["n1"], of["n2"], of["n3"], of["n4"])
        context = Window.partitionBy(F.substring("gram", 1, n - 1))
        rows = tables[n].select("gram", "count", F.sum("count").over(context).alias("total"), F.sum(_taken(c, d)).over(context).alias("given"))
        if n == 1:
            rows = rows.withColumn("lower", F.lit(1.0 / (of["known"] + 1)))  # and one for every character that trusted texts don't have
        else:
            rows = rows.join(scored.select(F.col("gram").alias("tail"), F.col("p").alias("lower")), F.substring("gram", 2, n - 1) == F.col("tail"))
        own = F.greatest(c - _taken(c, d), F.lit(0.0))
        p = F.when(F.col("total") == 0, F.col("lower")).otherwise((own + F.col("given") * F.col("lower")) / F.col("total"))
        scored = rows.select("gram", p.alias("p"))
    out = materialize(scored.select("gram", F.log("p").alias("logp")), "scored")
    release(*tables.values())
    return out


def _gram_hashes(grams: list[str], order: int) -> np.ndarray:
    """The hash of each n-gram, as :func:`_grams` has it."""
    a = np.frombuffer("".join(grams).encode("utf-32-le", "replace"), dtype=np.uint32).reshape(-1, order).astype(np.uint64) + np.uint64(1)
    h = a[:, 0].copy()
    for n in range(1, order):
        h = h * _K + a[:, n]
    return h


class Scores:
    """Scored n-grams by hash: a table with a slot for most, and a sorted rest for those whose slot is taken."""

    def __init__(self, h: np.ndarray, logp: np.ndarray):
        self.shift = np.uint64(64 - max(10, int(len(h) * 4).bit_length()))
        self.key = np.zeros(1 << int(np.uint64(64) - self.shift), dtype=np.uint64)
        self.value = np.zeros(len(self.key), dtype=np.float32)
        slot = self._slot(h)
        self.key[slot], self.value[slot] = h, logp
        rest = self.key[slot] != h
        ranked = np.argsort(h[rest])
        self.rest, self.rest_value = h[rest][ranked], logp[rest][ranked].astype(np.float32)

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> self.shift

    def __call__(self, h: np.ndarray) -> np.ndarray:
        slot = self._slot(h)
        out = self.value[slot]
        other = np.flatnonzero(self.key[slot] != h)
        if len(other) and len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, h[other]), len(self.rest) - 1)
            out[other] = np.where(self.rest[at] == h[other], self.rest_value[at], 0)
        return out


def _means(texts: list[str], scores: Scores, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Characters and mean negative log probability of each text (null without characters)."""
    _, h, at = _grams(texts, order)
    lp = scores(h) * _inside(at, order, len(h))
    total = np.concatenate([[0.0], np.cumsum(lp, dtype=np.float64)])
    stop = np.minimum(at[1:], len(lp))
    n = np.maximum(np.diff(at) - order + 1, 0)
    sums = total[stop] - total[np.minimum(at[:-1], len(lp))]
    return n, np.where(n > 0, -sums / np.maximum(n, 1), np.nan)


def _log_perplexity(docs: DataFrame, labels: DataFrame, order: int = 5, broadcast_ngrams: int = 2_000_000, broadcast_ids: int = 2_000_000, block_chars: int = 32_000_000) -> tuple[DataFrame, Callable]:
    """The rows of :func:`log_perplexity`, still to be computed, and what to call once they are."""
    spark = _words.small_batches(docs)
    sure = labels.filter("quality = 1").select("doc_id").distinct().withColumn("trusted", F.lit(True))
    if sure.count() <= broadcast_ids:
        sure = F.broadcast(sure)
    joined = spread(docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), "lang", "text")).join(sure, "doc_id", "left").withColumn("trusted", F.coalesce("trusted", F.lit(False)))
    grams, seen = materialize_observed(_count(joined, order), "grams", n=F.count(F.lit(1)), **_counts_of())
    scored = score_grams(grams, order, seen)
    schema = "doc_id long, row_key long, lang string, trusted boolean, n_chars long, log_ppl double"
    carried, kinds = ["doc_id", "row_key", "lang", "trusted"], (pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.float64())
    arrow = pa.schema(list(zip([*carried, "n_chars", "log_ppl"], kinds, strict=True)))

    def rows(ids: list, means: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
        means = pa.array(means[0], pa.int64()), pa.Array.from_pandas(means[1], type=pa.float64())
        return pa.RecordBatch.from_arrays([*ids, *means], schema=arrow)

    if seen["n"] <= broadcast_ngrams:
        # Twelve bytes an n-gram, hashed by the executors; each worker makes its own table of them, once.
        packed = scored.mapInArrow(lambda batches: _packed(batches, order), "h binary, logp binary").toArrow()
        h, logp = (np.frombuffer(b"".join(packed.column(k).to_pylist()), dtype=kind) for k, kind in ((0, np.uint64), (1, np.float32)))
        held = spark.sparkContext.broadcast((uuid.uuid4().hex, h, logp))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scores = _table_of(*held.value)
            for batch, texts in _words.chunks(batches, len(carried)):
                yield rows(batch.columns[:-1], _means(texts, scores, order))

        return joined.select(*carried, "text").mapInArrow(run, schema), lambda: (release(scored), held.destroy())

    chars = joined.agg(F.sum(F.length("text"))).first()[0] or 0
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, -(-chars // block_chars))))
    texts = joined.withColumn("block", block)

    def needs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, text in _words.chunks(batches):
            where = np.array(batch.column(0).to_pylist(), dtype=np.int64)
            for b in np.unique(where).tolist():
                joined, h, at = _grams([t for t, k in zip(text, where.tolist(), strict=True) if k == b], order)
                place = np.flatnonzero(_inside(at, order, len(h)))
                first = place[np.unique(h[place], return_index=True)[1]]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), b)), pa.array([joined[i : i + order] for i in first.tolist()], pa.string())], ["block", "gram"])

    wanted = texts.select("block", "text").mapInArrow(needs, "block long, gram string").distinct().join(scored, "gram")

    def meet(part: pa.Table, grams: pa.Table) -> pa.Table:
        scores = Scores(_gram_hashes(grams.column("gram").to_pylist(), order), grams.column("logp").to_numpy())
        part = part.select([*carried, "text"])
        out = [rows(batch.columns[:-1], _means(text, scores, order)) for batch, text in _words.chunks(iter(part.to_batches()), len(carried))]
        return pa.Table.from_batches(out, arrow)

    return texts.groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(meet, schema), lambda: release(scored)


def _packed(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            h = _gram_hashes(batch.column(0).to_pylist(), order)
            yield pa.RecordBatch.from_arrays([pa.array([h.tobytes()], pa.binary()), pa.array([batch.column(1).to_numpy().astype(np.float32).tobytes()], pa.binary())], ["h", "logp"])


_tables: dict[str, Scores] = {}


def _table_of(model: str, h: np.ndarray, logp: np.ndarray) -> Scores:
    """The scores of a model, kept in this worker until another model comes."""
    if model not in _tables:
        _tables.clear()
        _tables[model] = Scores(h, logp)
    return _tables[model]


def log_perplexity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, row_key (xxhash64 of doc_id and text), lang, trusted, n_chars and log_ppl for every row of ``docs``; trusted are those that ``labels`` gives quality 1.

    A text without characters has a null log_ppl. Without any trusted text all n-grams are equally unknown. The result is a table.
    """
    found, done = _log_perplexity(docs, labels, **options)
    found = materialize(found, "perplexity")
    done()
    return found


def judge(docs: DataFrame, labels: DataFrame, low: float = 0.002, high: float = 0.998, slack: float = 0.07, fewest: int = 20, folds: int = 5, **options) -> DataFrame:
    """doc_id, row_key, lang, n_chars, log_ppl, low_limit, high_limit, keep: one row per row of ``docs``; row_key is xxhash64(doc_id, text).

    One trusted document in ``folds`` (by a hash of doc_id) stays out of the model, as most documents that it judges are; limits
    come from these. The limits of a language and a band of lengths (:func:`_band`) are the ``low`` and ``high`` quantiles of their
    log perplexity, moved outwards by what the length allows (:data:`SHORT`) and by ``slack``, fourfold for quantiles of ``fewest``
    documents and falling to itself as they grow in number. A band with fewer than ``fewest`` of them uses the limits over its
    language, a language with fewer, and rows without a language, those over all. Without any, all are kept. Null,
    empty and blank texts have no perplexity and are rejected.
    """
    outside = F.pmod(F.xxhash64("doc_id"), F.lit(folds)) == 0
    scored = log_perplexity(docs, labels.filter(~outside), **options)
    sure = scored.filter(outside & F.col("log_ppl").isNotNull()).join(labels.filter("quality = 1").filter(outside).select("doc_id").distinct(), "doc_id", "left_semi")
    # Short texts vary more, by the root of the length. What a limit holds is the text's excess over that.
    # Four decimals keep the distinct values few, however many documents there are, so that the quantiles are exact and reruns agree.
    sure = sure.select("lang", _band().alias("band"), *[F.round(_centred(F.col("log_ppl"), side), 4).alias(k) for side, k in ((-1, "_low"), (1, "_high"))])
    ends = [F.expr(f"percentile_disc({share}) within group (order by {c})").alias(k) for c, share, k in (("_low", low, "a"), ("_high", high, "b"))]
    # One pass for all three: whether a row of limits is for a language and whether it is for a band. A band over all languages is not asked for.
    limits = sure.rollup("lang", "band").agg(F.grouping_id().alias("over"), *ends, F.count("*").alias("n"))
    limits = materialize(limits, "limits")
    loose = F.lit(slack) * (1 + F.lit(3 * fewest) / F.col("n"))
    limits = limits.select("lang", "band", "over", "n", (F.col("a") - loose).alias("a"), (F.col("b") + loose).alias("b"))
    enough = limits.filter((F.col("n") >= fewest) & F.col("lang").isNotNull())
    by_band = enough.filter("over = 0").select("lang", "band", F.col("a").alias("band_a"), F.col("b").alias("band_b"))
    by_lang = enough.filter("over = 1").select("lang", "a", "b")
    every = limits.filter("over = 3").select(F.col("a").alias("all_a"), F.col("b").alias("all_b"))
    every = every.agg(F.first("all_a").alias("all_a"), F.first("all_b").alias("all_b"))  # a row of nulls where there are no limits
    rows = scored.withColumn("band", _band()).join(by_band, ["lang", "band"], "left").join(by_lang, "lang", "left").crossJoin(F.broadcast(every))
    spread = SHORT / F.sqrt(F.greatest(F.col("n_chars"), F.lit(1)))
    rows = rows.select(
        "doc_id", "row_key", "lang", "n_chars", "log_ppl",
        (F.coalesce("band_a", "a", "all_a") - spread).alias("low_limit"),
        (F.coalesce("band_b", "b", "all_b") + spread).alias("high_limit"),
    )
    ok = F.coalesce(F.col("log_ppl").between(F.col("low_limit"), F.col("high_limit")), F.col("log_ppl").isNotNull())
    return rows.withColumn("keep", ok)


#: Nats that the log perplexity of a text of one character may lie further out; a text of n may by this over the root of n.
SHORT = 2.0
#: Longest texts, in characters, of the bands of length but the last.
BANDS = (64, 256, 1024, 4096)


def _centred(c, side: int):
    return c - side * SHORT / F.sqrt(F.greatest(F.col("n_chars"), F.lit(1)))


def _band() -> Column:
    """The number of the first band of :data:`BANDS` that holds a text of n_chars characters."""
    return sum((F.col("n_chars") > n).cast("int") for n in BANDS)
