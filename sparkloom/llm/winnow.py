"""Document fingerprints by winnowing: rolling k-gram hashes, the least of each window, rightmost on ties, with positions.

Every run of ``window + k - 1`` code points holds a selected k-gram, so two texts that share such a run share a fingerprint
entry, and no shared run of fewer than k code points counts. A text shorter than k has one gram, itself; a text with fewer
grams than a window has one window. An empty text has no entries.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm._words import mix, small_batches

K, WINDOW = 12, 12
_BASE = 0x9E3779B97F4A7C15


def winnow(text: str, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Selected hashes and their positions, in order of position."""
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
    if not len(a):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    k = min(k, len(a))
    # Doubling: the hash of 2^j code points from two of 2^(j-1), and what k needs of them.
    h, have, width, block = None, 0, 1, a
    while True:
        if k & width:
            h = block if h is None else h[: len(a) - have - width + 1] * np.uint64(pow(_BASE, width, 2**64)) + block[have:]
            have += width
        if have == k:
            break
        block = block[:-width] * np.uint64(pow(_BASE, width, 2**64)) + block[width:]
        width *= 2
    h = mix(h)
    # Two hashes that agree in all but these bits (a chance of 2^-44 in a text of a million code points) would count as a tie.
    # Position in the low bits, counted from the end: the least key of a window is its least hash, rightmost on ties.
    n, w = len(h), min(window, len(h))
    bits = np.uint64(max(1, int(n).bit_length()))
    last = np.uint64((1 << int(bits)) - 1)
    key = (h >> bits << bits) | (last - np.arange(n, dtype=np.uint64))
    least, width = key, 1
    while width * 2 <= w:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < w:
        least = np.minimum(least[: n - w + 1], least[w - width :])
    place = (last - (least & last)).astype(np.int64)
    place = place[np.concatenate([[True], place[1:] != place[:-1]])]
    return h[place], place


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of hashes; 1 for two empty ones."""
    a, b = np.unique(a), np.unique(b)
    if not len(a) and not len(b):
        return 1.0
    same = np.intersect1d(a, b, assume_unique=True).size
    return same / (len(a) + len(b) - same)


def digest(hashes: np.ndarray, places: np.ndarray) -> str:
    """A fingerprint as one string: number of entries and a digest of all hashes and positions."""
    return f"{len(hashes)}-{hashlib.blake2b(hashes.tobytes() + places.astype(np.int64).tobytes(), digest_size=16).hexdigest()}"


def fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """doc_id and entries (array of hash, position) for every row; null texts count as empty.

    Null and repeated doc_ids are rows like others, each with its own text's entries. Other columns are not looked at; an empty
    table gives an empty result.
    """

    small_batches(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [winnow(t or "", k, window) for t in batch.column(1).to_pylist()]
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(h) for h, _ in found])]).astype(np.int32))
            empty = [np.empty(0, np.uint64)]
            pairs = pa.StructArray.from_arrays([pa.array(np.concatenate([h for h, _ in found] or empty).view(np.int64)), pa.array(np.concatenate([p for _, p in found] or empty).astype(np.int64))], ["hash", "position"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pairs)], ["doc_id", "entries"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, entries array<struct<hash: long, position: long>>")


def _range_of(cuts: list[int]) -> Column:
    """How many cuts are below doc_id (0 for null), found among every step-th cut first and then among the step after it."""
    if not cuts:
        return F.lit(0)
    step = int(len(cuts) ** 0.5) + 1
    below = lambda some: F.size(F.filter(some, lambda c: c < F.col("doc_id")))
    coarse = below(F.lit(cuts[step - 1 :: step]).cast("array<bigint>")) * step if len(cuts) >= step else F.lit(0)
    fine = below(F.slice(F.lit(cuts).cast("array<bigint>"), coarse + 1, step))
    return F.when(F.col("doc_id").isNull(), 0).otherwise(coarse + fine)


def compare_with_next(docs: DataFrame, k: int = K, window: int = WINDOW, ranges: int | None = None) -> DataFrame:
    """Fingerprints of each text and of an edited text, and how alike they and the next document's are.

    The edited text has its last ``floor(n / 4)`` code points replaced by the first as many, or all, of the next document by
    ascending doc_id; the first follows the last. Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next. Null texts count as empty. Rows that repeat a doc_id follow one another by text; rows whose doc_id is
    null come before all others. A single row is its own next. An empty table gives an empty result.

    Texts move once, to ``ranges`` ranges of doc_id (by default four for each shuffle partition) with about as many rows each;
    the first document of each range also goes to the end of the range before it.
    """
    spark, ids = small_batches(docs), docs.select("doc_id")
    ranges = ranges or max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = ids.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 100 * ranges)).first()[0] if ranges > 1 else None
    cuts = sorted(set(cuts or []))
    number = _range_of(cuts).alias("to")
    heads = ids.select("doc_id", number).groupBy("to").agg(F.min("doc_id").alias("least"), F.bool_and(F.col("doc_id").isNotNull()).alias("known")).orderBy("to").collect()
    ahead = [(r["least"] if r["known"] else None, heads[i - 1]["to"]) for i, r in enumerate(heads)]
    lookup = spark.createDataFrame(ahead, "least long, before int")
    own = F.struct(F.lit(0).alias("late"), F.col("to"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), number).join(F.broadcast(lookup), F.col("doc_id").eqNullSafe(F.col("least")), "left")
    copies = F.when(F.col("before").isNotNull(), F.array(own, F.struct(F.lit(1).alias("late"), F.col("before").alias("to")))).otherwise(F.array(own))
    dealt = rows.withColumn("x", F.explode(copies)).select("x.to", "x.late", "doc_id", "text")
    dealt = dealt.repartition("to").sortWithinPartitions("to", "late", F.col("doc_id").asc_nulls_first(), "text")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finish(held, nxt) -> tuple:
            doc, text, own = held
            cut = len(text) // 4
            edited = text[: len(text) - cut] + nxt[1][:cut]
            changed = winnow(edited, k, window)
            sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
            return doc, len(text), sha, digest(*own), digest(*changed), likeness(own[0], changed[0]), likeness(own[0], nxt[2][0])

        held, to, out = None, None, []
        for batch in batches:
            for r, late, doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if r != to:
                    held, to = None, r
                if late and held is None:
                    continue
                now = (doc, text, winnow(text, k, window))
                if held is not None:
                    out.append(finish(held, now))
                held = None if late else now
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in out], schema=arrow)
                out = []

    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    arrow = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])
    return dealt.mapInArrow(run, schema)
