"""Point-in-time features by pushing: each row of the past finds the probe times that it is part of, not each probe its rows.

A row that is seen from ``lo`` on and leaves a window at ``hi`` adds its values to all probes of its client in [lo, hi). In a client's
chunk the probe times are ranked, ``searchsorted`` gives the range that a row affects, ``np.add.at`` adds at its first rank and takes
off behind its last one, and one cumulated sum gives all probes their totals.

Most clients are one chunk. A client with more than ``chunk_rows`` rows is cut into cells of time, each a chunk of its own, and a row
goes only to the cells that hold one of its ends: rows that cover a chunk, or lie before it, enter as a chunk constant. Constants are
sums over all earlier cells, put together from totals of 1, 2, 4, ... cells, so that no task ever holds all cells of a client.

What is no sum is made one, or a running maximum. The click seen last at t is the latest of all those seen by t, if it is still in the
window, as clicks leave in the order of their times. An item is there from a line's ``lo`` until the item's next line takes over or the
latest sale so far leaves the window; these intervals are disjoint, and so count each item once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm._words import small_batches
from sparkloom.session import scoped_conf
from sparkloom.storage import materialize, release

DAY = 86_400_000_000
#: Before and after all times, and the mark of a missing id.
BEGIN, END, NONE = -(1 << 62), 1 << 62, -(1 << 63)
PROBE, CLICK, SALE, LINE, ITEM, NEXT = range(6)
_VALUES = ("v1", "v2", "v3")
#: Rows that a Python worker handles together, in whole chunks.
SLAB = 200_000


def _us(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def _cents(c: str) -> Column:
    return F.coalesce(F.floor(100 * F.col(c) + 0.5).cast("long"), F.lit(0).cast("long"))


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def features(
    clicks: DataFrame, sales: DataFrame, lines: DataFrame, windows: tuple[int, ...] = (2, 14), label_days: int = 7, delay_minutes: int = 240, chunk_rows: int = 20_000
) -> DataFrame:
    """A row per sale with client and sold_at and per window of ``windows`` days, at the time t of that sale.

    t is sold_at and a number of seconds below three days by the CRC-32 of the decimal sale_id. Counted are rows of the same client in
    the window that ends at t which had arrived ``delay_minutes`` before t: clicks (fully equal rows once), sales, and those sales'
    lines shipped by t. label: the client has a sale in the ``label_days`` after t, whenever that arrived.

    Clicks, sales and lines whose client, time, arrival, sale or shipping is null are never seen; null amounts, totals and values
    count as 0 cents and null items are no items. Repeated sales are sales of their own, with their lines each; a null sale_id has a
    checksum of 0 and no lines, a null click_id is the least. Times without a zone are UTC. Other columns are not looked at, but
    they tell clicks apart. Tables without rows give an empty result, or zeros.
    """
    small_batches(sales)
    spans = [d * DAY for d in windows]
    delay = delay_minutes * 60_000_000
    with scoped_conf(sales.sparkSession, spark__sql__session__timeZone="UTC"):
        sold = sales.select("client_id", "sale_id", _us("sold_at").alias("sold"), (_us("arrived_at") + delay).alias("seen"), _cents("total").alias("cents"))
        sold = sold.filter("client_id is not null and sold is not null")
        clicked = clicks.filter("client_id is not null and ts is not null and arrived_at is not null").dropDuplicates()
        clicked = clicked.select("client_id", _us("ts").alias("ts"), (_us("arrived_at") + delay).alias("seen"), "click_id", (F.col("kind") == "purchase").alias("bought"), _cents("value").alias("cents"))
        shipped = lines.select("sale_id", "item_id", _us("shipped_at").alias("shipped"), _cents("amount").alias("cents")).filter("sale_id is not null and shipped is not null")
    # Repeated and like lines meet before they move to their sale.
    shipped = shipped.groupBy("sale_id", "shipped", "item_id").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))
    parts = shipped.join(sold.filter("seen is not null").drop("cents"), "sale_id").withColumn("lo", F.greatest("sold", "seen", "shipped"))
    parts = materialize(parts.filter(F.col("lo") < F.col("sold") + spans[-1]).select("client_id", "item_id", "lo", "sold", "n", "cents"), "parts")
    hot, levels = _hot(clicks, sold, parts, chunk_rows)

    def chunked(df: DataFrame) -> DataFrame:
        return df.join(hot, "client_id", "left") if levels else df.withColumns({"first": _long(0), "width": _long(0), "cells": _long(0)})

    probe = F.col("sold") + F.crc32(F.coalesce(F.col("sale_id").cast("string"), F.lit(""))) % 259_200 * 1_000_000
    probes = chunked(sold.select("client_id", probe.alias("lo"), F.coalesce("sale_id", _long(NONE)).alias("id")))
    probes = probes.select("client_id", _cell(F.col("lo")).alias("cell"), F.lit(PROBE).alias("kind"), "lo", *[_long(END).alias(f"h{i}") for i in range(len(spans))], *_no_values(), _long(NONE).alias("ts"), "id")
    rows = _clicks(chunked(clicked), spans).unionByName(_sales(chunked(sold), spans, label_days)).unionByName(_parts(chunked(parts), spans, levels))
    rows = rows.filter(F.col("lo") < F.col(f"h{len(spans) - 1}"))
    placed = materialize(_placed(rows, len(spans)), "effects")
    release(parts)
    if levels:
        # Rows of a cell that have the same ends there are one.
        ends = ["client_id", "cell", "kind", "lo", *[f"h{i}" for i in range(len(spans))]]
        crowded = placed.filter("cell >= 0").groupBy(*ends).agg(*[F.sum(v).alias(v) for v in _VALUES], F.max(F.struct("ts", "id")).alias("last")).select(*ends, *_VALUES, "last.ts", "last.id")
        crowded = materialize(crowded, "crowded")
        asked = probes.filter("cell >= 0").select("client_id", "cell").distinct()
        placed = placed.filter("cell < 0").unionByName(crowded).unionByName(_constants(crowded, asked, levels, len(spans)))
    # Every chunk in one task, chunks after one another.
    dealt = probes.unionByName(placed).repartition("client_id", "cell").sortWithinPartitions("client_id", "cell")
    return dealt.mapInArrow(_summer(spans, windows), _schema())


def _no_values() -> list[Column]:
    return [_long(0).alias(v) for v in _VALUES]


def _ends(seen: list[Column], leaves: list[Column], n: int) -> list[Column]:
    """lo, when all of ``seen`` are past, and h0, h1, ..., when the windows are left, not before lo."""
    lo = F.greatest(*seen) if len(seen) > 1 else seen[0]
    return [lo.alias("lo"), *[F.greatest(lo, leaves[i]).alias(f"h{i}") for i in range(n)]]


_CHUNK = ("client_id", "first", "width", "cells")


def _clicks(clicked: DataFrame, spans: list[int]) -> DataFrame:
    ends = _ends([F.col("ts"), F.col("seen")], [F.col("ts") + s for s in spans], len(spans))
    values = [_long(1).alias("v1"), F.coalesce("bought", F.lit(False)).cast("long").alias("v2"), F.col("cents").alias("v3")]
    return clicked.select(*_CHUNK, F.lit(CLICK).alias("kind"), *ends, *values, "ts", F.coalesce("click_id", _long(NONE)).alias("id"))


def _sales(sold: DataFrame, spans: list[int], label_days: int) -> DataFrame:
    """Each sale as a row of its windows, where it arrived, and as a next sale of the days before it."""
    at = F.col("sold")
    nothing = [_long(NONE).alias("ts"), _long(NONE).alias("id")]
    own = F.struct(F.lit(SALE).alias("kind"), *_ends([at, F.col("seen")], [at + s for s in spans], len(spans)), _long(1).alias("v1"), _long(0).alias("v2"), F.col("cents").alias("v3"))
    ahead = F.struct(F.lit(NEXT).alias("kind"), *_ends([at - label_days * DAY], [at] * len(spans), len(spans)), _long(1).alias("v1"), _long(0).alias("v2"), _long(0).alias("v3"))
    return sold.withColumn("x", F.explode(F.when(F.col("seen").isNotNull(), F.array(own, ahead)).otherwise(F.array(ahead)))).select(*_CHUNK, "x.*", *nothing)


def _parts(parts: DataFrame, spans: list[int], levels: int) -> DataFrame:
    """Each line as a row of its sale's windows and, disjoint from the item's other lines, as a row of its item's presence."""
    parts = parts.withColumn("cell", _cell(F.col("lo")))
    if levels:
        edges = _item_edges(parts.filter("cell >= 0 and item_id is not null").select(*_CHUNK, "item_id", "cell", "lo", "sold"), levels)
        parts = parts.unionByName(edges.withColumns({"n": _long(0), "cents": _long(0)}))
    line = Window.partitionBy("client_id", "item_id", "cell").orderBy("lo", "sold")
    parts = parts.withColumns({"reach": F.max("sold").over(line.rowsBetween(Window.unboundedPreceding, 0)), "until": F.lead("lo", 1, END).over(line)}).filter("n > 0")
    lo, n = [F.col("lo")], len(spans)
    own = F.struct(F.lit(LINE).alias("kind"), *_ends(lo, [F.col("sold") + s for s in spans], n), F.col("n").alias("v1"), _long(0).alias("v2"), F.col("cents").alias("v3"))
    there = F.struct(F.lit(ITEM).alias("kind"), *_ends(lo, [F.least(F.col("until"), F.col("reach") + s) for s in spans], n), _long(1).alias("v1"), _long(0).alias("v2"), _long(0).alias("v3"))
    both = F.when(F.col("item_id").isNotNull(), F.array(own, there)).otherwise(F.array(own))
    return parts.withColumn("x", F.explode(both)).select(*_CHUNK, "x.*", _long(NONE).alias("ts"), _long(NONE).alias("id"))


#: Cells, and blocks of cells, that one window spans.
_BITS = 6


def _item_edges(rows: DataFrame, bits: int) -> DataFrame:
    """What an item's lines in other cells leave to each of its cells, as two rows: the latest sale before, at BEGIN, and when its next line comes.

    Cells are summed up in blocks of 2^_BITS, these in blocks again until there is one, and each block is a window of its own.
    """
    group = [*_CHUNK, "item_id"]
    cells = rows.groupBy(*group, "cell").agg(F.min("lo").alias("lo"), F.max("sold").alias("sold"))
    inner = cells.select("*", F.shiftright("cell", _BITS).alias("block"), F.lit(0).alias("side"))
    if bits > _BITS:
        outer = _item_edges(cells.withColumn("cell", F.shiftright("cell", _BITS)), bits - _BITS).withColumnRenamed("cell", "block")
        # Rows that come from earlier blocks have no line of their own here, those from later ones no sale.
        before = F.col("lo") == BEGIN
        outer = outer.withColumns({"side": F.when(before, -1).otherwise(1), "lo": F.when(before, END).otherwise(F.col("lo")), "cell": _long(-1)})
        inner = inner.unionByName(outer)
    block = Window.partitionBy(*group, "block").orderBy("side", "cell")
    found = inner.withColumns(
        {"latest": F.max("sold").over(block.rowsBetween(Window.unboundedPreceding, -1)), "next": F.min("lo").over(block.rowsBetween(1, Window.unboundedFollowing))}
    )
    found = materialize(found.filter("side = 0").select(*group, "cell", "latest", "next"), "edges")
    before = found.filter(F.col("latest") > BEGIN).select(*group, "cell", _long(BEGIN).alias("lo"), F.col("latest").alias("sold"))
    return before.unionByName(found.filter(F.col("next") < END).select(*group, "cell", F.col("next").alias("lo"), _long(BEGIN).alias("sold")))


def _hot(clicks: DataFrame, sold: DataFrame, parts: DataFrame, chunk_rows: int) -> tuple[DataFrame, int]:
    """Clients of more rows than ``chunk_rows``, with the first time, width and number of their cells, and how many bits number the cells."""
    with scoped_conf(clicks.sparkSession, spark__sql__session__timeZone="UTC"):
        times = clicks.select("client_id", _us("ts").alias("at")).unionByName(sold.select("client_id", F.col("sold").alias("at"))).unionByName(parts.select("client_id", F.col("lo").alias("at")))
    sizes = times.filter("client_id is not null and at is not null").groupBy("client_id").agg(F.count("*").alias("n"), F.min("at").alias("first"), F.max("at").alias("last")).filter(F.col("n") > chunk_rows)
    # Cells get a quarter of the bound on average, as no client's rows come evenly.
    cells = F.ceil(4 * F.col("n") / chunk_rows).cast("long")
    hot = materialize(sizes.select("client_id", "first", (F.floor((F.col("last") - F.col("first")) / cells) + 1).cast("long").alias("width"), cells.alias("cells")), "hot")
    most = hot.agg(F.max("cells")).first()[0]
    return hot, int(most or 0).bit_length()


def _cell(at: Column) -> Column:
    """The cell of a time, -1 for clients of one chunk. Times outside a client's cells are in its first or last one."""
    cell = F.least(F.greatest(F.floor((at - F.col("first")) / F.col("width")).cast("long"), _long(0)), F.col("cells") - 1)
    return F.when(F.col("cells") > 0, cell).otherwise(_long(-1))


def _placed(rows: DataFrame, n: int) -> DataFrame:
    """Each row in the cells that hold its ends; an end in another cell is at END, where its value comes and goes unseen."""
    ends = ["lo", *[f"h{i}" for i in range(n)]]
    at = F.col("at")
    rows = rows.withColumn("at", F.explode(F.array_distinct(F.array(*[_cell(F.col(e)) for e in ends]))))
    here = {e: F.when(_cell(F.col(e)) == at, F.col(e)).otherwise(_long(END)) for e in ends}
    last = {c: F.when(_cell(F.col("lo")) == at, F.col(c)).otherwise(_long(NONE)) for c in ("ts", "id")}
    return rows.select("client_id", at.alias("cell"), "kind", *[x.alias(e) for e, x in here.items()], *_VALUES, *[x.alias(c) for c, x in last.items()])


def _over_cells(totals: DataFrame, asked: DataFrame, levels: int, aggs: list[Column], more: str) -> DataFrame:
    """For each row of ``asked`` (client_id, cell): the aggregates, by ``more``, of the rows of ``totals`` of that client in all earlier cells.

    The cells before c are a node of 2^k cells for each bit k that is set in c.
    """
    up = totals.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(levels)))).withColumn("node", F.expr("shiftright(cell, k)"))
    up = up.groupBy("client_id", more, "k", "node").agg(*aggs)
    bits = F.filter(F.sequence(F.lit(0), F.lit(levels)), lambda k: F.call_function("shiftright", F.col("cell"), k) % 2 == 1)
    down = asked.withColumn("k", F.explode(bits)).withColumn("node", F.expr("shiftright(cell, k)") - 1)
    return down.join(up, ["client_id", "k", "node"]).groupBy("client_id", "cell", more).agg(*aggs)


def _constants(crowded: DataFrame, asked: DataFrame, levels: int, n: int) -> DataFrame:
    """A row per chunk, kind and window with what all rows in earlier cells add to every probe of the chunk, and the latest click among them."""
    sums = [f"{v}_{i}" for v in _VALUES for i in range(n)]
    inside = lambda e: (F.col(e) != END).cast("long")
    totals = crowded.groupBy("client_id", "cell", "kind").agg(
        *[F.sum(F.col(v) * (inside("lo") - inside(f"h{i}"))).alias(f"{v}_{i}") for v in _VALUES for i in range(n)], F.max(F.struct("ts", "id")).alias("last")
    )
    found = _over_cells(totals, asked, levels, [*[F.sum(c).alias(c) for c in sums], F.max("last").alias("last")], "kind")
    each = []
    for i in range(n):
        # From the chunk's begin; in the other windows it is gone at once.
        ends = [_long(BEGIN).alias("lo"), *[_long(END if j == i else BEGIN).alias(f"h{j}") for j in range(n)]]
        last = [F.col("last")[c].alias(c) if i == 0 else _long(NONE).alias(c) for c in ("ts", "id")]
        each.append(F.struct(*ends, *[F.col(f"{v}_{i}").alias(v) for v in _VALUES], *last))
    return found.select("client_id", "cell", "kind", F.inline(F.array(*each)))


_FIELDS = ("n_clicks", "n_purchases", "click_cents", "n_sales", "sale_cents", "n_lines", "n_items", "line_cents")
_SOURCES = ((CLICK, 0), (CLICK, 1), (CLICK, 2), (SALE, 0), (SALE, 2), (LINE, 0), (ITEM, 0), (LINE, 2))


def _schema() -> str:
    return "sale_id long, d int, t_us long, label boolean, last_click_id long, " + ", ".join(f"{f} long" for f in _FIELDS)


def _summer(spans: list[int], windows: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0
        for batch in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held and size >= SLAB:
                before = held[-1]
                begins = np.concatenate([[before[0][-1]], now[0]]), np.concatenate([[before[1][-1]], now[1]])
                cuts = np.flatnonzero((begins[0][1:] != begins[0][:-1]) | (begins[1][1:] != begins[1][:-1]))
                if len(cuts):
                    held.append([c[: cuts[-1]] for c in now])
                    yield from whole(held)
                    now, held, size = [c[cuts[-1] :] for c in now], [], 0
            held.append(now)
            size += len(now[0])
        if held:
            yield from whole(held)

    def whole(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        found = chunk_sums([np.concatenate(c) for c in zip(*held, strict=True)], spans, windows)
        if found is not None:
            yield found

    return run


def chunk_sums(columns: list[np.ndarray], spans: list[int], windows: tuple[int, ...]) -> pa.RecordBatch | None:
    """The features of all probes of whole chunks, sorted by chunk; columns as in :func:`features`."""
    n = len(spans)
    client, cell, kind, lo = columns[:4]
    leaves, values, (ts, ids) = columns[4 : 4 + n], columns[4 + n : 7 + n], columns[7 + n : 9 + n]
    g = np.concatenate([[0], np.cumsum((client[1:] != client[:-1]) | (cell[1:] != cell[:-1]))])
    is_probe = kind == PROBE
    if not is_probe.any():
        return None
    # Probe times ranked in each chunk, equal times once. Each chunk has one slot more, where what lies behind its last probe goes.
    times = np.unique(lo[is_probe])
    m = len(times) + 1
    key, slot_of_probe = np.unique(g[is_probe] * m + np.searchsorted(times, lo[is_probe]), return_inverse=True)
    chunk, t = key // m, times[key % m]
    slots = np.arange(len(key)) + chunk
    total = len(key) + g[-1] + 1

    def slot(of: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(key, of * m + np.searchsorted(times, at)) + of

    def summed(first: np.ndarray, behind: np.ndarray, v: np.ndarray) -> np.ndarray:
        # What a row adds it takes off in the same chunk, so sums begin at 0 in each.
        change = np.zeros(total, np.int64)
        np.add.at(change, first, v)
        np.subtract.at(change, behind, v)
        return np.cumsum(change)[slots]

    rows = {k: np.flatnonzero(kind == k) for k in (CLICK, SALE, LINE, ITEM, NEXT)}
    first = {k: slot(g[r], lo[r]) for k, r in rows.items()}
    behind = {k: [slot(g[r], h[r]) for h in leaves] for k, r in rows.items()}
    label = summed(first[NEXT], behind[NEXT][0], values[0][rows[NEXT]]) > 0

    clicks = rows[CLICK][ts[rows[CLICK]] != NONE]
    clicks = clicks[np.lexsort((lo[clicks], g[clicks]))]
    by_time = np.lexsort((ids[clicks], ts[clicks]))
    rank = np.empty(len(clicks), np.int64)
    rank[by_time] = np.arange(len(clicks))
    latest = np.maximum.accumulate(g[clicks] * (len(clicks) + 1) + rank)
    place = np.searchsorted(g[clicks] * m + np.searchsorted(times, lo[clicks]), key, "right") - 1
    seen = place >= 0
    seen[seen] = g[clicks][place[seen]] == chunk[seen]
    last_ts, last_id = np.full(len(key), NONE), np.full(len(key), NONE)
    of = clicks[by_time[latest[place[seen]] % (len(clicks) + 1)]]
    last_ts[seen], last_id[seen] = ts[of], ids[of]

    out: dict[str, list] = {}
    probe_ids = ids[is_probe]
    put = lambda name, a, none=None: out.setdefault(name, []).append(pa.array(a[slot_of_probe], mask=none[slot_of_probe] if none is not None else None))
    for i, span in enumerate(spans):
        out.setdefault("sale_id", []).append(pa.array(probe_ids, mask=probe_ids == NONE))
        put("d", np.full(len(key), windows[i], np.int32))
        put("t_us", t)
        put("label", label)
        put("last_click_id", last_id, (last_id == NONE) | (last_ts <= t - span))
        for name, (k, v) in zip(_FIELDS, _SOURCES, strict=True):
            put(name, summed(first[k], behind[k][i], values[v][rows[k]]))
    return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in out.values()], list(out))
