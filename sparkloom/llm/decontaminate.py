"""Benchmark decontamination: documents that hold a benchmark item, exactly or with a few words edited.

A document matches an item of L words when at most k = ``floor(max_edits * L)`` word edits turn one of its spans, of L - k to L + k
words, into the item. Without ``free_ends`` only spans of L words count, so a dropped or added word costs two edits.
Words are runs of letters, digits and non-ASCII characters in lower case, so punctuation and line breaks don't hide a copy; characters
of scripts that are written without blanks are words of their own. Items of fewer than ``min_words`` words match unedited or not at all,
and those of fewer than PAIRED words, which have too few word pairs for what follows, wherever their words stand in a row.

1. Windows of the item's length start at each word. The q-gram lemma keeps those that can match at all: within k edits an item
   keeps ``L - 1 - 2k`` of its word pairs, so a window with fewer pairs from items of its length, none counted more often than an item
   has it, is left out. This drops no match. A text may end inside a window. Of a span that words were added to, the window
   loses as many pairs at its end as additions broke fewer, so the bound holds for spans of every length.
2. CGK embedding: a random walk reads the window with a pointer that a random function of step and word moves on or holds.
   After 3L steps, two sequences a few edits apart differ in few places: edit distance has become Hamming distance.
3. Bit-sampling LSH: each repetition has its own walk and compares some sampled places of the embedding. The longer an item, the
   more places its allowed edits change, so :func:`places_for` samples as many places as a simulation of that length at its edit
   limit shows to keep the target recall.
4. The word edit distance of each item and the best span from the start of a window that met it is computed exactly and decides.
5. Of items of more than LONG words few windows are left by step 1, and neighbours nearly always together. Each run of them goes to
   the exact check as one stretch of text, in which the least distance of any span is found bit-parallel, in memory linear in
   the item and the stretch.

The items are the query set: they go out in blocks of ``block_items``, each broadcast and held against all rows.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import _words
from sparkloom.llm._words import mix
from sparkloom.storage import materialize, spread

SEED = 71
#: Every byte that is neither an ASCII letter or digit nor part of a non-ASCII character separates words.
_TO_SPACE = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


#: Characters of scripts without blanks between words: kana, Han, Thai, Lao, Burmese, Khmer.
_ALONE = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff])")


#: Full-width punctuation, which stands between words as ASCII punctuation does.
_MARKS = re.compile("[\u3000-\u303f\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]")


def plain(texts: list[str]) -> list[bytes]:
    texts = [t if t.isascii() or not _ALONE.search(t) else _MARKS.sub(" ", _ALONE.sub(r" \1 ", t)) for t in texts]
    return [t.lower().encode("utf-8", "surrogatepass").translate(_TO_SPACE) for t in texts]


def repetitions_for(recall: float, meet: float) -> int:
    """How often to repeat so that a window that meets its item with probability ``meet`` does so at least once."""
    return math.ceil(math.log(1 - recall) / math.log(1 - meet))


def walk(windows: np.ndarray, n: np.ndarray | int, steps: np.ndarray, total: int) -> Iterator[np.ndarray]:
    """The word (a hash) that each repetition reads of each window (a padded row of n words) at each of the steps."""
    at, rows = np.zeros((len(steps), len(windows)), dtype=np.int64), np.arange(len(windows))
    for step in range(total):
        word = np.where(at < n, windows[rows, at], np.uint64(0))
        yield word
        at = np.minimum(at + ((word * steps[:, step, None]) >> np.uint64(63)).astype(np.int64), n)


@functools.cache
def _equal_places(n: int, edits: int, repetitions: int, copies: int = 128) -> np.ndarray:
    """Shares of equal places (kind of edit, repetition, copy) of items of n words and windows of n words that begin an edited copy."""
    rng = np.random.default_rng(SEED)
    out = []
    for kind in ("replace", "insert", "drop"):
        item, copy = np.zeros((copies, n + 1), dtype=np.uint64), np.zeros((copies, n + 1), dtype=np.uint64)
        for row in range(copies):
            words = rng.integers(1, 2**63, n, dtype=np.uint64)
            at, fresh = np.sort(rng.choice(n, edits, replace=False)), rng.integers(1, 2**63, n + edits, dtype=np.uint64)
            item[row, :n] = copy[row, :n] = words
            if kind == "replace":
                copy[row, at] = fresh[: len(at)]
            elif kind == "insert":
                copy[row, :n] = np.insert(words, at, fresh[: len(at)])[:n]
            else:
                copy[row, :n] = np.concatenate([np.delete(words, at), fresh])[:n]
        steps = rng.integers(1, 2**63, (repetitions, 3 * n), dtype=np.uint64) | np.uint64(1)
        out.append(sum((x == y).astype(np.int64) for x, y in zip(walk(item, n, steps, 3 * n), walk(copy, n, steps, 3 * n), strict=True)) / (3 * n))
    return np.stack(out)


def places_for(n: int, max_edits: float, most: int, repetitions: int, recall: float) -> int:
    """How many places to sample for items of n words, ``most`` at most, so that a window at the edit limit meets its item with ``recall``.

    Measured at the next of some lengths, for words replaced, inserted and dropped alike; 0 lets every window of the length meet.
    """
    step = 1 << max(0, n.bit_length() - 3)
    n = -(-n // step) * step
    equal = _equal_places(n, int(max_edits * n), repetitions)
    for places in range(most, 0, -1):
        met = 1 - (1 - (equal**places).mean(axis=1)) ** repetitions
        if met.mean(axis=1).min() >= recall:
            return places
    return 0


def edit_distances(windows: np.ndarray, items: np.ndarray, most: int, free_end: bool = False) -> np.ndarray:
    """Word edits between each row of windows (with free_end, its best beginning) and of items, or most + 1 where it takes more."""
    out = np.full(len(windows), most + 1, dtype=np.int32)
    left, column = np.arange(len(windows)), np.arange(windows.shape[1] + 1, dtype=np.int32)
    row = np.broadcast_to(column, (len(windows), len(column)))
    for i in range(items.shape[1]):
        now = np.empty(row.shape, dtype=np.int32)
        now[:, 0] = i + 1
        now[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + (windows != items[:, i, None]))
        row = np.minimum.accumulate(now - column, axis=1) + column
        near = row.min(axis=1) <= most
        if not near.all():
            left, row, windows, items = left[near], row[near], windows[near], items[near]
    out[left] = np.minimum(row.min(axis=1) if free_end else row[:, -1], most + 1)
    return out


def best_span(item: list[int], text: list[int], most: int) -> tuple[int, int] | None:
    """(start, edits) of a span of text with the least word edits to item, or None if that takes more than ``most``.

    A column of the table of distances is two integers of a bit for each word of the item (Myers 1999, as Hyyro states it).
    """
    m = len(item)
    full, high = (1 << m) - 1, 1 << (m - 1)

    def scores(of: list[int], words: list[int], carry: int) -> Iterator[int]:
        """The distance of ``of`` to the best span that ends at each word (carry 0), or to all words up to there (carry 1)."""
        where: dict[int, int] = {}
        for k, w in enumerate(of):
            where[w] = where.get(w, 0) | 1 << k
        up, down, score = full, 0, m
        for w in words:
            same = where.get(w, 0)
            vertical = same | down
            level = (((same & up) + up) ^ up) | same
            more, less = down | (full & ~(level | up)), up & level
            score += bool(more & high) - bool(less & high)
            more, less = more << 1 | carry, less << 1
            up, down = (less | ~(vertical | more)) & full, more & vertical & full
            yield score

    least, end = min(((x, k) for k, x in enumerate(scores(item, text, 0))), default=(most + 1, 0))
    if least > most or least >= m:
        return None
    back = next(k for k, x in enumerate(scores(item[::-1], text[end::-1], 1)) if x == least)
    return end - back, least


#: Words of an item from which on it is searched for in stretches of text.
LONG = 1024


class Items:
    """A block of items in the form that windows are held against."""

    def __init__(self, ids: list[int], texts: list[str], max_edits: float, min_words: int, repetitions: int, sampled: int, recall: float = 0.95, free_ends: bool = False, least_words: int = 1):
        self.free_ends = free_ends
        words, first = _words.hash_words(plain(texts))
        every = [(i, words[first[k] : first[k + 1]]) for k, i in enumerate(ids) if first[k + 1] - first[k] >= max(1, least_words)]
        kept = [(i, w) for i, w in every if len(w) >= PAIRED]
        self.short: dict[int, tuple[np.ndarray, list[list[int]]]] = {}
        for n in range(1, PAIRED):
            own = [(i, int(in_row(w, n)[0])) for i, w in every if len(w) == n]
            keys = np.unique(np.array([k for _, k in own], dtype=np.uint64))
            if len(keys):
                self.short[n] = keys, [[i for i, k in own if k == key] for key in keys.tolist()]
        self.ids, self.words, self.min_words = [i for i, _ in kept], [w for _, w in kept], min_words
        self.lengths = sorted({len(w) for w in self.words})
        self.long = {n: [(i, w.tolist()) for i, w in kept if len(w) == n] for n in self.lengths if n > LONG}
        each = [np.unique(w[:-1] * np.uint64(3) + w[1:], return_counts=True) for w in self.words]
        self.pairs, at = np.unique(np.concatenate([p for p, _ in each]), return_inverse=True) if kept else (np.empty(0, np.uint64), None)
        # How often one item has a pair at most: no window can share more of it.
        self.times = np.zeros(len(self.pairs), dtype=np.int64)
        if kept:
            np.maximum.at(self.times, at, np.concatenate([c for _, c in each]))
        # Which pairs items of a length have: only these count for windows of that length.
        self.of_length = {n: np.zeros(len(self.pairs), dtype=bool) for n in self.lengths}
        for w, (p, _) in zip(self.words, each, strict=True):
            self.of_length[len(w)][np.searchsorted(self.pairs, p)] = True
        self.seen = np.zeros(1 << 16, dtype=bool)
        self.seen[mix(self.pairs) >> np.uint64(48)] = True
        self.max_edits, self.repetitions = max_edits, repetitions
        # Each repetition has a random function of step and word, and some places of the embedding for every length.
        rng = np.random.default_rng(SEED)
        short = [n for n in self.lengths if n <= LONG]
        self.steps = rng.integers(1, 2**63, (repetitions, 3 * max(short, default=0)), dtype=np.uint64) | np.uint64(1)
        self.places = {}
        for n in short:
            places = places_for(n, max_edits, min(sampled, 3 * n), repetitions, recall) if n >= min_words else min(sampled, 3 * n)
            self.places[n] = [rng.choice(3 * n, places, replace=False) for _ in range(repetitions)]
        # Items whose length has as many bits are embedded and met together, so that short ones don't walk as far as long ones.
        self.bands = {}
        for band in sorted({n.bit_length() for n in short}):
            own = [k for k, w in enumerate(self.words) if len(w) <= LONG and len(w).bit_length() == band]
            width = max(len(self.words[k]) for k in own)
            keys = self.embed(np.stack([self.padded(self.words[k][None], width)[0] for k in own]), np.array([len(self.words[k]) for k in own]))
            order = np.argsort(keys, axis=1, kind="stable")
            self.bands[band] = (np.array(own), width, [(k[o], o) for k, o in zip(keys, order, strict=True)])

    def short_matches(self, words: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(text, item, first word) of items of fewer than PAIRED words, at the first place of each in a text."""
        for n, (keys, ids) in self.short.items():
            if len(words) < n:
                continue
            here = in_row(words, n)
            at = np.minimum(np.searchsorted(keys, here), len(keys) - 1)
            start = np.flatnonzero(keys[at] == here)
            text = np.searchsorted(first, start, side="right") - 1
            inside = start + n <= first[text + 1]
            start, text = start[inside], text[inside]
            _, once = np.unique(text * len(keys) + at[start], return_index=True)
            for x in once.tolist():
                for i in ids[at[start[x]]]:
                    yield int(text[x]), i, int(start[x] - first[text[x]])

    def edits(self, n: int) -> int:
        return int(self.max_edits * n) if n >= self.min_words else 0

    def span(self, n: int) -> int:
        """The most words that a copy of an item of n words can have."""
        return n + self.edits(n) * self.free_ends

    def padded(self, windows: np.ndarray, longest: int) -> np.ndarray:
        out = np.zeros((len(windows), self.span(longest) + 1), dtype=np.uint64)
        out[:, : windows.shape[1]] = windows
        return out

    def cut(self, words: np.ndarray, start: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
        """The words from each start on, as many as a copy of n words can have and zeros from its text's end on, padded for n's band."""
        at = start[:, None] + np.arange(self.span(n))
        return self.padded(np.where(at < end[:, None], words[np.minimum(at, len(words) - 1)], np.uint64(0)), self.bands[n.bit_length()][1])

    def embed(self, windows: np.ndarray, n: np.ndarray) -> np.ndarray:
        """An LSH key for each repetition and the first n word hashes of each window (a padded row)."""
        key = np.broadcast_to(n.astype(np.uint64), (self.repetitions, len(windows))).copy()
        lengths, which = np.unique(n, return_inverse=True)
        sampled = np.zeros((3 * int(n.max(initial=0)), self.repetitions, len(lengths)), dtype=bool)
        for k, length in enumerate(lengths.tolist()):
            for r, places in enumerate(self.places[length]):
                sampled[places, r, k] = True
        for step, word in enumerate(walk(windows, n, self.steps, len(sampled))):
            hit = np.nonzero(sampled[step][:, which])
            key[hit] = mix(key[hit] * np.uint64(31) + word[hit] + np.uint64(1))
        return key

    def windows(self, words: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """For each item length, the first words of windows that have pairs enough inside their text, which can end before them."""
        if len(words) < 2 or not len(self.pairs):
            return
        pair = words[:-1] * np.uint64(3) + words[1:]
        near = np.flatnonzero(self.seen[mix(pair) >> np.uint64(48)])
        at = np.minimum(np.searchsorted(self.pairs, pair[near]), len(self.pairs) - 1)
        same = self.pairs[at] == pair[near]
        hits, kind = near[same], at[same]
        end = first[1:]
        # Where the pair stood as many times before as an item can have it: in windows from there on, this one adds nothing.
        order = np.argsort(kind, kind="stable")
        back = np.arange(len(hits)) - self.times[kind[order]]
        before = np.full(len(hits), -1, dtype=np.int64)
        known = (back >= 0) & (kind[order[np.maximum(back, 0)]] == kind[order])
        before[order[known]] = hits[order[back[known]]]
        every, every_before = hits, before
        for n in self.lengths:
            own = self.of_length[n][kind]
            hits, before = every[own], every_before[own]
            need = max(1, n - 1 - 2 * self.edits(n))
            if len(hits) < need:
                continue
            low, high = hits[: len(hits) - need + 1], hits[need - 1 :]
            fit = high - low <= n - 2
            if not fit.any():
                continue
            # A window that holds the pairs low..high begins between high - (n - 2) and low.
            spans = np.zeros(len(words) + 1, dtype=np.int32)
            np.add.at(spans, np.maximum(high[fit] - (n - 2), 0), 1)
            np.add.at(spans, low[fit] + 1, -1)
            start = np.flatnonzero(np.cumsum(spans[:-1]) > 0)
            text = np.searchsorted(first, start, side="right") - 1
            if not self.free_ends:
                inside = start + n <= end[text]
                start, text = start[inside], text[inside]
            one, stop = np.searchsorted(hits, start), np.searchsorted(hits, np.minimum(start + n, end[text]) - 2, side="right")
            shared = np.zeros(len(start), dtype=np.int32)
            for j in range(int((stop - one).max(initial=0))):
                k = np.minimum(one + j, len(hits) - 1)
                shared += (one + j < stop) & (before[k] < start)
            start = start[shared >= need]
            if len(start):
                yield n, start

    def stretches(self, words: np.ndarray, start: np.ndarray, end: np.ndarray, n: int) -> Iterator[tuple[int, int, int, int]]:
        """(place in start, item, first word, edits) of items of n words, a long length, in the stretches that windows cover."""
        if not len(start):
            return
        cuts = np.flatnonzero(np.concatenate([[True], (start[1:] > start[:-1] + n) | (end[1:] != end[:-1])]))
        for one, stop in zip(cuts.tolist(), [*cuts[1:].tolist(), len(start)], strict=True):
            text = words[start[one] : min(end[one], start[stop - 1] + n + int(self.max_edits * n))].tolist()
            for i, item in self.long[n]:
                if found := best_span(item, text, self.edits(n)):
                    yield one, i, int(start[one]) + found[0], found[1]

    def matches(self, band: int, windows: np.ndarray, n: np.ndarray, text: np.ndarray, start: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text, item, first word, edits) for each text and item of a band that a window shows to match, the best window of those."""
        own, _, table = self.bands[band]
        keys = self.embed(windows, n)
        met = np.empty(0, dtype=np.int64)
        for mine, (theirs, order) in zip(keys, table, strict=True):
            low, high = np.searchsorted(theirs, mine), np.searchsorted(theirs, mine, side="right")
            times = high - low
            k = np.repeat(np.arange(len(mine)), times)
            j = order[np.arange(len(k)) + np.repeat(low - np.cumsum(times) + times, times)]
            met = np.union1d(met, k * len(own) + j)
        k, j = np.divmod(met, len(own))
        j = own[j]
        edits, limit = np.empty(len(met), dtype=np.int64), np.empty(len(met), dtype=np.int64)
        for length in np.unique(n[k]).tolist():
            of_length = np.flatnonzero(n[k] == length)
            for some in np.array_split(of_length, -(-len(of_length) * length // HELD_WORDS)):
                theirs = np.stack([self.words[x] for x in j[some].tolist()])
                limit[some] = self.edits(length)
                edits[some] = edit_distances(windows[k[some], : self.span(length)], theirs, self.edits(length), self.free_ends)
        fit = np.flatnonzero(edits <= limit)
        fit = fit[np.lexsort((start[k[fit]], edits[fit], j[fit], text[k[fit]]))]
        same = np.zeros(len(fit), dtype=bool)
        same[1:] = (text[k[fit[1:]]] == text[k[fit[:-1]]]) & (j[fit[1:]] == j[fit[:-1]])
        return [(int(text[k[x]]), self.ids[j[x]], int(start[k[x]]), int(edits[x])) for x in fit[~same].tolist()]


#: Items of fewer words have no word pairs to be found by, or hardly any.
PAIRED = 4


def in_row(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words from each word on."""
    out = words[: len(words) - n + 1]
    for k in range(1, n):
        out = mix(out * np.uint64(31) + words[k : len(words) - n + 1 + k])
    return out


#: Words of windows that a task gathers before it embeds them together.
HELD_WORDS = 1 << 19


def leaks(
    docs: DataFrame, items: DataFrame, max_edits: float = 0.2, min_words: int = 8, recall: float = 0.95, meet: float = 0.12, sampled: int = 6, block_items: int = 20_000, free_ends: bool = False, least_words: int = 1
) -> DataFrame:
    """(doc_id, item_id, start_word, edits): each document and item that match, with the first word of the best window found.

    ``meet`` is the probability with which one repetition should bring a window at the allowed edits together with its item; with
    ``recall`` it sets the number of repetitions. Of each length's places, ``sampled`` or as many fewer are compared as keep that
    recall (:func:`places_for`). With ``free_ends`` (the query and :func:`clean`) edits are those to the best span that begins with
    the window, else those to the window itself; items of over LONG words have free ends in any case. Unedited copies always
    meet. Items of fewer than ``least_words`` words, items without words, and null texts on either side match nothing. Rows that repeat a doc_id or an
    item_id each count: a pair then shows once per row of the documents and once per block of items. Other columns are not
    looked at; an empty table on either side gives an empty result.

    Items are read in blocks of ``block_items``, each held against all rows; with several, each block's matches are written
    before the next block is read, so one block at a time is in memory.
    """
    spark = _words.small_batches(docs)
    times = repetitions_for(recall, meet)
    schema = "doc_id long, item_id long, start_word long, edits int"
    numbered = items.filter("text is not null").select("item_id", "text")
    blocks = max(1, math.ceil(numbered.count() / block_items))
    out = None
    for b in range(blocks):
        rows = numbered.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        held = spark.sparkContext.broadcast(Items([r[0] for r in rows], [r[1] for r in rows], max_edits, min_words, times, sampled, recall, free_ends, least_words))
        del rows
        part = spread(docs.select("doc_id", "text")).mapInArrow(functools.partial(_search, held), schema)
        if blocks > 1:
            part = materialize(part, "leaks")
            held.destroy()
        out = part if out is None else out.unionByName(part)
    return out


def _search(held: Broadcast, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The matches of a task's documents (doc_id, text) with the items of a broadcast block."""
    items, ids, found = held.value, [], []
    gathered: dict[int, list] = {}

    def done() -> pa.RecordBatch:
        rows = [(ids[t], i, s, e) for band, some in gathered.items() for t, i, s, e in items.matches(band, *(np.concatenate(x) for x in zip(*some, strict=True)))]
        columns = list(zip(*found, *rows, strict=True)) if found or rows else [[]] * 4
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "start_word", "edits"])

    for batch, texts in _words.chunks(batches):
        words, first = _words.hash_words(plain(texts))
        found += [(batch.column(0)[t].as_py(), i, s, 0) for t, i, s in items.short_matches(words, first)]
        for n, start in items.windows(words, first):
            text = np.searchsorted(first, start, side="right") - 1
            if n > LONG:
                for place, i, s, e in items.stretches(words, start, first[text + 1], n):
                    found.append((batch.column(0)[int(text[place])].as_py(), i, s - int(first[text[place]]), e))
                continue
            some = gathered.setdefault(n.bit_length(), [])
            for part in np.array_split(np.arange(len(start)), -(-len(start) * n // HELD_WORDS)):
                some.append((items.cut(words, start[part], first[text[part] + 1], n), np.full(len(part), n), text[part] + len(ids), start[part] - first[text[part]]))
        ids += batch.column(0).to_pylist()
        if sum(x[0].size for some in gathered.values() for x in some) >= HELD_WORDS:
            yield done()
            ids, found = [], []
            gathered.clear()
    yield done()


def clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that match an item, with free ends and items of four words or more unless told otherwise.

    Fewer words name too little to be evidence against a whole document; ``least_words=1`` takes all items.

    Every row is judged by its own text, whatever its doc_id: null ids, and ids that several rows share, are no exception. Null texts
    match nothing and stay, as do all rows if there are no items.
    """
    key = F.xxhash64("doc_id", "text")
    found = leaks(docs.select(key.alias("doc_id"), "text"), items, **({"free_ends": True, "least_words": PAIRED} | options)).select(F.col("doc_id").alias("_key")).distinct()
    plain_columns = [F.col(f"`{c}`") for c in docs.columns]
    # Whole rows travel as one struct, whose fields' names clash with nothing.
    rows = docs.select(F.struct(*plain_columns).alias("_row"), key.alias("_k"))
    return rows.join(found, F.col("_k") == F.col("_key"), "left_anti").select("_row.*")
