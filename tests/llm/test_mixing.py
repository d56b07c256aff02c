import re
from collections import defaultdict

import pytest

from sparkloom.llm import mixing
from sparkloom.llm.queries import QUERIES


def slow_targets(sizes, weights=(5, 2, 1), most=3.0):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, full = float(sum(sizes.values())), {}
    while True:
        rest = [s for s in order if s not in full]
        if not rest:
            return full
        level = (total - sum(full.values())) / sum(w[s] for s in rest)
        over = [s for s in rest if w[s] * level >= most * sizes[s]]
        if not over:
            return full | {s: w[s] * level for s in rest}
        full |= {s: most * sizes[s] for s in over}


def check(rows, docs, tight=True):
    n = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t, _ in docs}
    sizes, largest, taken = defaultdict(int), defaultdict(int), defaultdict(int)
    for d, _, s in docs:
        sizes[s] += n[d]
        largest[s] = max(largest[s], n[d])
    want = slow_targets(sizes)
    source = {d: s for d, _, s in docs}
    assert sorted(r["doc_id"] for r in rows) == sorted(source)
    for r in rows:
        s = source[r["doc_id"]]
        assert r["size"] == n[r["doc_id"]] and r["source_size"] == sizes[s]
        assert r["target"] == pytest.approx(want[s]) and 0 <= r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        taken[s] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(largest[s], 0 if tight else 0.02 * want[s]), (s, taken[s], want[s])
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))


def test_query_reaches_its_targets_and_reruns_agree(spark):
    d = "/root/testdata/sf0.01"
    docs = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    rows = QUERIES["op5_mixing"](spark, d).collect()
    check(rows, docs)
    got, want = defaultdict(int), {r["source_size"]: r["target"] for r in rows}
    for r in rows:
        got[r["source_size"]] += r["taken"]
    assert all(abs(got[k] - want[k]) < 0.02 * want[k] for k in want)
    again = mixing.mix(spark.read.parquet(f"{d}/documents.parquet").repartition(13)).collect()
    assert {(r["doc_id"], r["taken"]) for r in rows} == {(r["doc_id"], r["taken"]) for r in again}


def test_every_document_has_its_chance(spark):
    """Sources with the same sizes are trials of the same draw: over them, mean copies are the source's factor, whatever the size."""
    sizes = [1] * 20 + [2] * 10 + [3] * 8 + [5] * 6 + [8] * 5 + [13] * 4 + [21] * 3 + [34, 55, 55, 60, 62, 64]
    docs = [(s * 100 + i, "w " * n, f"{s:04d}") for s in range(600) for i, n in enumerate(sizes)]
    rows = mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(8)).collect()
    check(rows, docs)
    copies = defaultdict(list)
    for r in rows:
        copies[int(r["source"]) % 3, r["doc_id"] % 100].append(r["copies"])
    for (k, i), got in copies.items():
        factor = (15 / 8, 6 / 8, 3 / 8)[k]
        assert len(got) == 200 and {*got} <= {int(factor), int(factor) + 1}
        # Five standard errors; inside a class of many sizes chances grow with size, and the smallest make up for what rounding leaves.
        assert abs(sum(got) / 200 - factor) < 0.17 + 0.05 * (sizes[i] == 1), (k, i, sizes[i], sum(got) / 200)


def test_a_cell_gives_a_fixed_number_by_pareto_order(spark):
    """One class, one cell: the number taken is the plan's, and who is taken are the first by odds over the odds of their chance."""
    docs = [(i, "w " * (100 + i % 9), "ab"[i % 4 == 0]) for i in range(800)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    sized = mixing._sized(frame, mixing._size())
    numbers = {(r["source"], r["class"]): r for r in mixing._plan(sized, (5, 2, 1), 3, 17).collect()}
    uniform = {r["doc_id"]: r["u"] for r in sized.withColumn("u", mixing._uniform(mixing.F.lit(17), mixing.F.lit("rank"), "key")).collect()}
    key = {r["doc_id"]: r["key"] for r in sized.collect()}
    rows = defaultdict(list)
    for r in mixing.mix(frame).withColumn("class", mixing._class(mixing.F.col("size"))).collect():
        rows[r["source"], r["class"]].append(r)
    assert sum(0 < numbers[k]["m"] < len(v) for k, v in rows.items()) >= 2
    for k, v in rows.items():
        want, n = numbers[k], len(v)
        p, mean = want["m"] / n, sum(r["size"] for r in v) / n
        chance = {r["doc_id"]: p * (1 + min(1, (1 - p) / p if p else 1) * (r["size"] / mean - 1)) for r in v}
        assert want["n"] == n and abs(sum(chance.values()) - want["m"]) < 1e-9 and all(0 <= c <= 1 for c in chance.values())
        odds = lambda d: uniform[d] * (1 - chance[d]) / ((1 - uniform[d]) * chance[d]) if chance[d] else 9e9  # noqa: B023, E731
        first = {r["doc_id"] for r in sorted(v, key=lambda r: (odds(r["doc_id"]), key[r["doc_id"]]))[: want["m"]]}
        assert {r["doc_id"] for r in v if r["copies"] > want["certain"]} == first


def test_large_classes_are_split_into_cells(spark, monkeypatch):
    docs = [(i, "w " * (1 + i % 3), "abc"[i % 3]) for i in range(9000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    monkeypatch.setattr(mixing, "CELL_ROWS", 100)
    monkeypatch.setattr(mixing, "CELL_WORDS", 300)
    rows = mixing.mix(frame).collect()
    check(rows, docs, tight=False)


def test_edge_cases(spark):
    schema = "doc_id long, text string, source string, size string, rank string, target int"
    make = lambda rows: spark.createDataFrame([(*r, "x", "y", 1) for r in rows], schema)
    assert mixing.mix(make([])).count() == 0 and mixing.apply_mix(make([])).count() == 0
    docs = [(1, None, None), (2, "", "a"), (3, "one two", "B"), (4, "one two three", "é"), (5, "x " * 900, None), (6, "x", "z"), (7, " \n", "z")]
    check(mixing.mix(make(docs)).collect(), docs)
    check(mixing.mix(make(docs[:2])).collect(), docs[:2])
    twice = mixing.mix(make(docs + docs)).collect()
    assert len(twice) == 14
    out = mixing.apply_mix(make(docs))
    taken = {r["doc_id"]: r["copies"] for r in mixing.mix(make(docs)).collect()}
    assert out.columns == make(docs).columns
    found = defaultdict(int)
    for r in out.collect():
        found[r["doc_id"]] += 1
    assert found == {k: v for k, v in taken.items() if v}
