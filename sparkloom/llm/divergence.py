"""Which sources differ from the rest of their language, and by which terms: an audit in whole numbers.

Every (lang, source) group and every lang gives each kept term a smoothed frequency in parts of 10^9. Two groups differ by the sum
of the absolute differences over all kept terms; a term speaks for a group by how far its frequency there is above the lang's.

Pairs come from postings. A term that a group lacks has the group's floor p0 there, so with p the frequency of a term that occurs,

    sum |p_g - p_h| = V |p0_g - p0_h| + sum over terms of g (|p_g - p0_h| - |p0_g - p0_h|) + the same with g and h exchanged
                      + sum over terms of both (|p_g - p_h| - |p_g - p0_h| - |p0_g - p_h| + |p0_g - p0_h|)

The second sum needs only how many terms of g have each frequency, and the last one only the postings that both groups have.

Top terms come from a search by upper bounds. The terms of a group are put into buckets by their count; the largest frequency of a
bucket less the least lang frequency in it bounds what any of its terms can reach. Buckets are taken from the best bound on until they
hold enough terms, whose k-th value is a first limit; then those whose bound is not strictly below it, and no others, are evaluated.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm._words import small_batches
from sparkloom.storage import materialize, release, spread

#: Each byte of a text as terms have it: ASCII letters in lower case, the rest of ASCII, which lies between terms, as a blank.
_BYTES = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
HELD = 200_000
SMOOTH, SCALE = 5, 10**9


def frequency(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 terms)), exactly: in two steps that keep longs in range for up to 9 * 10^13 occurrences."""
    top, below = count + SMOOTH, total + SMOOTH * terms
    high = top * 100_000
    return (1 + F.call_function("div", high, below) * 10_000 + F.call_function("div", high % below * 10_000, below)).cast("long")


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, df): occurrences, and the documents with the term. Tasks combine before anything moves.

    Letters become lower-case, and what lies between terms blanks, byte by byte in UTF-8; a task holds at most about HELD terms.
    """
    small_batches(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for batch in batches:
            for text, *key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                terms = text.encode("utf-8", "surrogatepass").translate(_BYTES).split()
                n, df = held.setdefault(tuple(key), (Counter(), Counter()))
                n.update(terms)
                df.update(set(terms))
            if sum(len(n) for n, _ in held.values()) > HELD:
                yield from emit(held)
                held = {}
        yield from emit(held)

    def emit(held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, df) in held.items():
            if n:
                names = [pa.array([x] * len(n), pa.string()) for x in (lang, source)]
                counts = [pa.array(n.values(), pa.int64()), pa.array([df[t] for t in n], pa.int64())]
                yield pa.RecordBatch.from_arrays([*names, pa.array(n.keys(), pa.binary()).cast(pa.string()), *counts], ["lang", "source", "term", "n", "df"])

    each = docs.select(F.coalesce("text", F.lit("")).alias("text"), *_group()).mapInArrow(run, "lang string, source string, term string, n long, df long")
    return each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def _group() -> list[Column]:
    return [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]


def audit(docs: DataFrame, least_docs: int = 30, top: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank for the groups of ``docs`` (text, lang, source).

    part ``pair``: every other source of the lang with the difference from it, all ranks; part ``term``: terms that the group has and
    whose frequency there is above the lang's, with the difference, the ``top`` first. Ranks go by falling value, then by the item's
    UTF-8 bytes. A lang keeps the terms of at least ``least_docs`` of its documents.

    Null text, lang and source count as empty; every row is a document, repeated ones too, whatever its doc_id. A lang without kept
    terms has pairs of value 0 and no terms; a source alone in its lang has no pairs. Other columns are not looked at. An empty table
    gives an empty result.
    """
    counts = term_counts(spread(docs.select("text", "lang", "source")))
    posts = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("df").alias("df"), F.collect_list(F.struct("source", "n")).alias("posts"))
    posts = materialize(posts.filter(F.col("df") >= least_docs).drop("df"), "postings")
    rows = posts.select("lang", "term", "lang_n", F.inline("posts"))
    sizes = rows.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = posts.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    groups = docs.select(*_group()).distinct().join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "v", "lang_total"])
    floor = F.when(F.col("v") > 0, frequency(F.lit(0).cast("long"), F.col("total"), F.col("v"))).otherwise(F.lit(0).cast("long"))
    groups = materialize(groups.withColumn("p0", floor), "groups")
    known = rows.join(groups, ["lang", "source"])
    known = materialize(
        known.select("lang", "source", "term", "n", "p0", frequency(F.col("n"), F.col("total"), F.col("v")).alias("p"), frequency(F.col("lang_n"), F.col("lang_total"), F.col("v")).alias("q")),
        "frequencies",
    )
    release(posts)
    return _ranked(_pairs(groups, known), "pair").unionByName(_ranked(_best_terms(known, top), "term", top))


def _ranked(rows: DataFrame, part: str, top: int | None = None) -> DataFrame:
    by = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    out = rows.withColumn("rank", F.row_number().over(by))
    out = out.filter(F.col("rank") <= top) if top else out
    return out.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")


def _pairs(groups: DataFrame, known: DataFrame) -> DataFrame:
    """(lang, source, item, value) for all ordered pairs of sources of a lang."""
    other = groups.select(F.col("lang").alias("other_lang"), F.col("source").alias("item"), F.col("p0").alias("p0_other"))
    meets = (F.col("lang") == F.col("other_lang")) & (F.col("source") != F.col("item"))
    gap = F.abs(F.col("p0") - F.col("p0_other"))
    floors = groups.join(other, meets).select("lang", "source", "item", (F.col("v") * gap).alias("value"))
    levels = known.groupBy("lang", "source", "p0", "p").agg(F.count("*").alias("k"))
    own = levels.join(other, meets).groupBy("lang", "source", "item").agg(F.sum(F.col("k") * (F.abs(F.col("p") - F.col("p0_other")) - gap)).alias("value"))
    a, b = known.alias("a"), known.alias("b")
    both = a.join(b, (F.col("a.lang") == F.col("b.lang")) & (F.col("a.term") == F.col("b.term")) & (F.col("a.source") < F.col("b.source")))
    pa, qa, pb, qb = (F.col(c) for c in ("a.p", "a.p0", "b.p", "b.p0"))
    both = both.groupBy(F.col("a.lang").alias("lang"), F.col("a.source").alias("source"), F.col("b.source").alias("item"))
    both = both.agg(F.sum(F.abs(pa - pb) - F.abs(pa - qb) - F.abs(qa - pb) + F.abs(qa - qb)).alias("value"))
    two_ways = own.unionByName(both)
    two_ways = two_ways.unionByName(two_ways.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    return floors.unionByName(two_ways).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def _best_terms(known: DataFrame, top: int) -> DataFrame:
    """(lang, source, item, value): at least the ``top`` best terms of each group, from the buckets whose bound can reach them."""
    key = ["lang", "source", "bucket"]
    above = known.filter(F.col("p") > F.col("q")).withColumn("bucket", F.floor(4 * F.log2("n")).cast("int"))
    buckets = above.groupBy(*key).agg((F.max("p") - F.min("q")).alias("bound"), F.count("*").alias("n"))
    best_first = Window.partitionBy("lang", "source").orderBy(F.col("bound").desc(), "bucket")
    buckets = materialize(buckets.withColumn("before", F.sum("n").over(best_first) - F.col("n")).drop("n"), "buckets")
    value = (F.col("p") - F.col("q")).alias("value")
    first = above.join(buckets.filter(F.col("before") < top), key).select("lang", "source", F.col("term").alias("item"), value)
    kth = _ranked(first, "term", top).groupBy("lang", "source").agg(F.when(F.count("*") == top, F.min("value")).otherwise(0).alias("kth"))
    left = buckets.join(kth, ["lang", "source"]).filter(F.col("bound") >= F.col("kth")).select(*key, "kth")
    found = above.join(left, key).filter(F.col("p") - F.col("q") >= F.col("kth"))
    return found.select("lang", "source", F.col("term").alias("item"), value)
