import random
import zlib
from datetime import datetime, timedelta

import pytest

from sparkloom.llm import pointintime

CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string"
SALES = "sale_id long, client_id long, status string, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz, priority int"
LINES = "sale_id long, line_no int, item_id long, vendor_id long, quantity int, amount double, discount double, flag string, shipped_at timestamp_ntz"
T0, DAY = datetime(2024, 1, 1), timedelta(days=1)
DELAY = timedelta(minutes=240)


def cents(xs):
    return sum(int((100 * x + 0.5) // 1) for x in xs if x is not None)


def brute(clicks, sales, lines):
    clicks, out = set(clicks), []
    for sid, client, _, _, sold, _, _ in sales:
        if client is None or sold is None:
            continue
        t = sold + timedelta(seconds=zlib.crc32(str(sid).encode() if sid is not None else b"") % 259200)
        label = any(s[1] == client and s[4] and t < s[4] <= t + 7 * DAY for s in sales)
        for d in (2, 14):
            c = [x for x in clicks if x[3] == client and x[1] and x[2] and t - d * DAY < x[1] <= t and x[2] + DELAY <= t]
            s = [x for x in sales if x[1] == client and x[4] and x[5] and t - d * DAY < x[4] <= t and x[5] + DELAY <= t]
            of = [y for x in s for y in lines if x[0] is not None and y[0] == x[0] and y[8] and y[8] <= t]
            last = max(((x[1], -(1 << 63) if x[0] is None else x[0]) for x in c), default=(0, None))[1]
            us = (t - datetime(1970, 1, 1)) // timedelta(microseconds=1)
            out.append((sid, d, us, label, len(c), sum(x[4] == "purchase" for x in c), cents(x[5] for x in c), None if last == -(1 << 63) else last,
                        len(s), cents(x[3] for x in s), len(of), len({y[2] for y in of if y[2] is not None}), cents(y[5] for y in of)))
    return sorted(out, key=repr)


NAMES = "sale_id d t_us label n_clicks n_purchases click_cents last_click_id n_sales sale_cents n_lines n_items line_cents".split()


def run(spark, clicks, sales, lines, **kw):
    frames = (spark.createDataFrame(x, s) for x, s in ((clicks, CLICKS), (sales, SALES), (lines, LINES)))
    return sorted((tuple(r[n] for n in NAMES) for r in pointintime.features(*frames, **kw).collect()), key=repr)


def shop(seed, n=60):
    r = random.Random(seed)
    maybe = lambda x, p=0.05: None if r.random() < p else x
    when = lambda: T0 + timedelta(seconds=r.choice([r.randrange(40 * 86400), 86400 * r.randrange(40)]))
    client = lambda: maybe(r.choice([1, 1, 1, 2, 3]))
    late = lambda x: x and maybe(x + timedelta(seconds=r.choice([0, 5, 3600, 6 * 86400])))
    clicks, sales, lines = [], [], []
    for k in range(3 * n):
        ts = maybe(when())
        clicks += [(maybe(k, 0.03), ts, late(ts), client(), maybe(r.choice(["purchase", "view"])), maybe(r.choice([1.005, -2.5, 0.0, 19.99])), "{}")] * r.choice([1, 1, 2])
    clicks += [(10_000 + k, T0 + 5 * DAY, T0 + 5 * DAY, 1, "view", 1.0, "{}") for k in range(5)]
    for k in range(n):
        sold = maybe(when())
        sales.append((k, client(), "done", maybe(r.choice([3.335, 10.0])), sold, late(sold), 1))
        for j in range(30 if k == 7 else r.randrange(5)):
            lines += [(maybe(k), j, maybe(r.choice([5, 5, 5, 6, 7, 8])), 1, 1, maybe(2.675), 0.0, "kept", maybe(sold and sold + DAY * r.randrange(9)))] * r.choice([1, 1, 2])
    return clicks, sales, lines


@pytest.mark.parametrize("seed, chunk_rows", [(1, 20_000), (1, 40), (2, 8), (3, 1)])
def test_equals_brute_force_whatever_the_chunks(spark, seed, chunk_rows):
    tables = shop(seed)
    assert run(spark, *tables, chunk_rows=chunk_rows) == brute(*tables)


def test_blocks_of_cells(spark, monkeypatch):
    monkeypatch.setattr(pointintime, "_BITS", 1)
    tables = shop(6)
    assert run(spark, *tables, chunk_rows=10) == brute(*tables)


def test_repeated_sales_null_ids_and_rows_that_nobody_sees(spark):
    sales = [(1, 1, None, 1.0, T0, T0, None)] * 2 + [(None, 1, None, None, T0 + DAY, None, None), (2, None, None, 1.0, T0, T0, None), (3, 9, None, 1.0, None, T0, None)]
    lines = [(1, 1, 5, 1, 1, 1.0, 0.0, None, T0)] * 3 + [(None, 1, 5, 1, 1, 1.0, 0.0, None, T0)]
    for chunk_rows in (100, 1):
        assert run(spark, [], sales, lines, chunk_rows=chunk_rows) == brute([], sales, lines)


def test_empty_tables(spark):
    assert not run(spark, [], [], [])
    sales = [(1, 1, None, 1.0, T0, T0, None)]
    assert run(spark, [], sales, []) == brute([], sales, [])


def test_other_columns_and_another_session_zone(spark):
    from sparkloom.session import scoped_conf

    clicks, sales, lines = shop(4, 25)
    frames = [spark.createDataFrame(x, s) for x, s in ((clicks, CLICKS), (sales, SALES), (lines, LINES))]
    frames = [f.selectExpr("*", "1 as lo", "2 as cell", "3 as h0", "4 as at", "'x' as first") for f in frames]
    with scoped_conf(spark, spark__sql__session__timeZone="America/New_York"):
        got = pointintime.features(*frames, chunk_rows=30).collect()
    assert sorted((tuple(r[n] for n in NAMES) for r in got), key=repr) == brute(clicks, sales, lines)


def test_slabs_cut_between_chunks(spark, monkeypatch):
    tables = shop(5)
    want = brute(*tables)
    run_of = pointintime._summer

    def small(spans, windows):
        f = run_of(spans, windows)

        def run(batches):
            import sparkloom.llm.pointintime as p

            p.SLAB = 10
            for b in batches:
                yield from f(iter([b.slice(k, 7) for k in range(0, b.num_rows, 7)]))

        return run

    monkeypatch.setattr(pointintime, "_summer", small)
    assert run(spark, *tables, chunk_rows=20) == want
