"""Line deduplication by pairwise alignment: passages that an earlier document has already go from the later one.

1. Lines are hashed (white space runs as one blank, ends stripped). What shows that documents overlap is a line in at most
   ``rare`` documents, or a run: the fewest lines from some line on, or up to some line, that have ``least_words`` words together, in
   however many documents. Each line with words of a block worth deleting is in such a run inside the block, so none is missed
   for being frequent.
2. Each document is paired with the earliest document (least doc_id) of every such line and run that it holds, itself excepted: one
   in n documents gives n - 1 pairs, and its first occurrence is never paired away.
3. Each pair is aligned by patience diff on line hashes: lines that are unique in both, in their longest common order, split the
   documents; between them the same is done again, and equal lines that touch a matched one join it.
4. Aligned blocks of at least ``least_words`` words are deleted from the later document; all pairs of a document count.
5. An alignment keeps one order and needs lines that are unique in both, so a pair is aligned again, with what went taken out, until
   an alignment finds no more, or ROUNDS times. Then runs take the place of lines as symbols, as passages of repeated lines are told by
   them, and what still holds a line is aligned in as many ascending orders as it needs, at once. Of the lines of the later text, as they stood together there, no run with
   ``least_words`` words that its earlier documents have is left.

Pairs and alignments carry line hashes, an earlier document's once per task; texts move once, to meet what is deleted from them.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm._words import mix, small_batches
from sparkloom.storage import materialize, spread


def line_hashes() -> Column:
    """The hash of each line of text."""
    return F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: F.xxhash64(F.trim(F.regexp_replace(x, r"[ \t\r\f\x0B]+", " "))))


def line_words() -> Column:
    """The number of words of each line of text."""
    return F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]+")))


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Matched places (i, j) of two sequences, ascending in both, as patience diff aligns them."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        na, nb = Counter(a[a0:a1]), Counter(b[b0:b1])
        at = {x: i for i, x in enumerate(a[a0:a1], a0) if na[x] == 1 and nb.get(x) == 1}
        both = [(at[x], j) for j, x in enumerate(b[b0:b1], b0) if x in at]
        # The longest run of places ascending in a, in b's order: the tops of patience piles, with links back.
        tops, piles, back = [], [], {}
        for i, j in both:
            k = bisect_left(tops, i)
            back[i, j] = piles[k - 1] if k else None
            tops[k : k + 1], piles[k : k + 1] = [i], [(i, j)]
        chain, now = [], piles[-1] if piles else None
        while now is not None:
            chain.append(now)
            now = back[now]
        edge = (a0, b0)
        for i, j in reversed(chain):
            out.append((i, j))
            todo.append((edge[0], i, edge[1], j))
            edge = (i + 1, j + 1)
        if chain:
            todo.append((edge[0], a1, edge[1], b1))
    return sorted(out)


def orders(places: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Pairs (i, j), given by ascending j, dealt to as few alignments, ascending in both, as hold them all: each goes on the first that it can follow."""
    tops: list[int] = []  # the last i of each alignment, from the greatest to the least, negated
    out: list[list[tuple[int, int]]] = []
    for i, j in places:
        k = bisect_left(tops, 1 - i)
        if k == len(tops):
            tops.append(-i)
            out.append([])
        tops[k] = -i
        out[k].append((i, j))
    return out


def _whole(a: list[int], b: list[int], i: int, j: int, end: int) -> tuple[int, int]:
    """The run of b around [j, end), which a has from i on, with all lines before and behind it that touch and are equal too."""
    behind = i + end - j
    while i and j and a[i - 1] == b[j - 1]:
        i, j = i - 1, j - 1
    while behind < len(a) and end < len(b) and a[behind] == b[end]:
        behind, end = behind + 1, end + 1
    return j, end


#: Alignments of lines, each of which costs as much as the first; passages in very many orders are left to runs, which need no more of them.
ROUNDS = 8


def aligned_lines(a: list[int], b: list[int], words: list[int], least_words: int) -> np.ndarray:
    """Places in b, whose lines have so many words, of the blocks of least_words words that alignments with a find until there are no more."""
    gone = np.zeros(len(b), dtype=bool)
    upto = np.concatenate([[0], np.cumsum(words)])
    known = set(a)
    for _ in range(ROUNDS):
        # What went, or a lacks, is left out as a symbol of its own, which parts what it stood between.
        left = [x if x in known and not gone[j] else None for j, x in enumerate(b)]
        more = False
        for i, j, end in _touching(patience(a, [x if x is not None else ("gone", j) for j, x in enumerate(left)])):
            j, end = _whole(a, b, i, j, end)
            if upto[end] - upto[j] >= least_words:
                more |= not gone[j:end].all()
                gone[j:end] = True
        if not more:
            break
    # Runs as symbols: of those that a has, all that still hold a line.
    count = dict(zip(b, words, strict=True))
    theirs, at, _ = _runs(np.array(a, dtype=np.int64), np.array([count.get(x, least_words) for x in a], dtype=np.int64), least_words)
    mine, start, end = _runs(np.array(b, dtype=np.int64), np.array(words, dtype=np.int64), least_words)
    first = dict(zip(theirs[::-1].tolist(), at[::-1].tolist(), strict=True))
    dead = np.concatenate([[0], np.cumsum(gone)])
    rest = sorted((s, e, first[t]) for t, s, e in zip(mine.tolist(), start.tolist(), end.tolist(), strict=True) if t in first and dead[e] - dead[s] < e - s)
    ends = {(i, s): e for s, e, i in rest}
    for order in orders([(i, s) for s, _, i in rest]):
        for i, s in order:
            j, e = _whole(a, b, i, s, ends[i, s])
            gone[j:e] = True
    return np.flatnonzero(gone)


def _touching(matched: list[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
    """(i, j, end): runs of matched places that touch in both, from i in a and j to end in b."""
    k = 0
    while k < len(matched):
        n = 1
        while k + n < len(matched) and matched[k + n] == (matched[k][0] + n, matched[k][1] + n):
            n += 1
        yield (*matched[k], matched[k][1] + n)
        k += n


def _runs(h: np.ndarray, n: np.ndarray, least_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, start, end) of the fewest lines with least_words words from each line on and up to each line; h hashes lines, n counts their words."""
    upto = np.concatenate([[0], np.cumsum(n)])
    on = np.searchsorted(upto, upto[:-1] + least_words)
    back = np.searchsorted(upto, upto[1:] - least_words, side="right") - 1
    one, two = np.flatnonzero(on < len(upto)), np.flatnonzero(back >= 0)
    start, end = np.concatenate([one, back[two]]), np.concatenate([on[one], two + 1])
    place = np.concatenate([[np.uint64(0)], np.cumsum(mix(h.view(np.uint64)) * _powers(len(h)), dtype=np.uint64)])
    return mix((place[end] - place[start]) * _inverse(len(h))[start] + (end - start).astype(np.uint64)).view(np.int64), start, end


def _tokens(lines: DataFrame, least_words: int) -> DataFrame:
    """(doc_id, token, run): each document's distinct lines with words (run false) and runs (run true), as hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, tokens, runs = [], [], []
            for doc, hashes, words in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                h, n = np.array(hashes, dtype=np.int64), np.array(words, dtype=np.int64)
                found, start, end = _runs(h, n, least_words)
                found = found[(n[start] > 0) & (n[end - 1] > 0)]
                for kind, some in ((False, np.unique(h[n > 0])), (True, np.unique(found))):
                    tokens.append(some)
                    docs.append(np.full(len(some), doc, dtype=np.int64))
                    runs.append(np.full(len(some), kind))
            columns = [np.concatenate(x) if x else np.empty(0, kind) for x, kind in ((docs, np.int64), (tokens, np.int64), (runs, bool))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc_id", "token", "run"])

    return lines.select("doc_id", "hashes", "words").mapInArrow(run, "doc_id long, token long, run boolean")


#: An odd number and its inverse modulo 2^64: powers place a line in a document, and take a run back to the start.
_ODD = 0x9E3779B97F4A7C15
_ODD_INVERSE = pow(_ODD, -1, 1 << 64)


def _powers(n: int, base: int = _ODD) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _inverse(n: int) -> np.ndarray:
    return _powers(n, _ODD_INVERSE)


def overlaps(docs: DataFrame, rare: int = 16, least_words: int = 20) -> DataFrame:
    """(later, version, earlier, lines): the places, from 0, of lines to delete from each later document; version is its text's hash."""
    small_batches(docs)
    lines = spread(docs.select("doc_id", "text")).filter("doc_id is not null").select("doc_id", _version(F.col("text")).alias("version"), line_hashes().alias("hashes"), line_words().alias("words"))
    # Rows that repeat a doc_id: one text of them stands for it.
    lines = lines.groupBy("doc_id").agg(F.min_by(F.struct("version", "hashes", "words"), "version").alias("x")).select("doc_id", "x.*")
    lines = materialize(lines, "lines")
    each = materialize(_tokens(lines, least_words), "tokens")
    shared = each.groupBy("token", "run").agg(F.min("doc_id").alias("earlier"), F.count("*").alias("docs"))
    telling = shared.filter((F.col("docs") > 1) & (F.col("run") | (F.col("docs") <= rare))).select("token", "run", "earlier")
    telling = materialize(telling, "telling")  # a table of its own, so that the join can split a token that very many documents have
    pairs = each.join(telling, ["token", "run"]).filter("earlier < doc_id").select(F.col("doc_id").alias("later"), "earlier").distinct()
    pairs = pairs.withColumn("salt", F.pmod(F.xxhash64("later"), F.lit(SALTS)).cast("int"))
    # The earlier document of many pairs goes once to each task that aligns with it, ahead of its later documents.
    early = lines.select(F.col("doc_id").alias("earlier"), F.col("hashes").alias("a"))
    late = lines.select(F.col("doc_id").alias("later"), "version", F.col("hashes").alias("b"), "words")
    ahead = pairs.select("earlier", "salt").distinct().join(early, "earlier").select("earlier", "salt", F.lit(None).cast("long").alias("later"), F.lit(None).cast("long").alias("version"), F.col("a").alias("lines"), F.lit(None).cast("array<int>").alias("words"))
    after = pairs.join(late, "later").select("earlier", "salt", "later", "version", F.col("b").alias("lines"), "words")
    meet = ahead.unionByName(after).repartition("earlier", "salt").sortWithinPartitions("earlier", "salt", F.col("later").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = None
        for batch in batches:
            out = []
            for earlier, _, later, version, b, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if later is None:
                    a = b
                    continue
                gone = aligned_lines(a, b, words, least_words).tolist()
                if gone:
                    out.append((later, version, earlier, gone))
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["later", "version", "earlier", "lines"])

    return meet.mapInArrow(run, "later long, version long, earlier long, lines array<int>")


#: Tasks among which the later documents of one earlier document are dealt, at most.
SALTS = 1024


def _version(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with aligned blocks deleted from text, and removed_lines (ascending places, empty where nothing went).

    Documents are told apart by doc_id; of rows that repeat one, those with the text that stands for it (the least hash) lose lines
    and others stay as they are, as do rows whose doc_id is null. A null text stays null, and a text whose lines all go is empty.
    A column named removed_lines is replaced; an empty table gives an empty result.
    """
    kept = [c for c in docs.columns if c != "removed_lines"]
    gone = overlaps(docs, **options).select(F.col("later").alias("_d"), F.col("version").alias("_v"), F.explode("lines").alias("_x"))
    gone = gone.groupBy("_d", "_v").agg(F.collect_set("_x").alias("_gone"))  # at most a row per line of one document
    # Whole rows travel as one struct, whose fields' names clash with nothing.
    text = F.col("_row.text")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), "doc_id")
    joined = whole.join(gone, (F.col("doc_id") == F.col("_d")) & (_version(text) == F.col("_v")), "left")
    rest = F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains("_gone", i)), "\n")
    removed = F.coalesce(F.array_sort("_gone"), F.array().cast("array<int>")).alias("removed_lines")
    return joined.select(F.col("_row").withField("text", F.when(F.col("_gone").isNull(), text).otherwise(rest)).alias("_row"), removed).select("_row.*", "removed_lines")
