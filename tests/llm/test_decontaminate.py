import pickle
import random
import re

import numpy as np

from sparkloom.llm import decontaminate
from sparkloom.llm.queries import QUERIES


def words_of(text):
    return decontaminate.plain([text or ""])[0].decode().split()


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next(row, i, x, b)
    return row[-1]


def _next(last, i, x, b):
    row = [i]
    for j, y in enumerate(b, 1):
        row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row


def brute(docs, items, max_edits=0.2, least=8):
    out = set()
    for d, text in docs:
        w = words_of(text)
        for i, item in items:
            v = words_of(item)
            if len(v) >= least and any(distance(w[s : s + len(v)], v) <= int(max_edits * len(v)) for s in range(len(w) - len(v) + 1)):
                out.add((d, i))
    return out


def span_distance(w, v):
    """The least distance of v to a span of w."""
    row = [0] * (len(w) + 1)
    for i, y in enumerate(v, 1):
        now = [i]
        for j, x in enumerate(w, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
        row = now
    return min(row)


def test_best_span_is_exact():
    rng = random.Random(1)
    for _ in range(400):
        item, text = ([rng.randrange(4) for _ in range(rng.randint(a, 14))] for a in (1, 0))
        d = span_distance(text, item)
        for most in (0, 2, 9):
            found = decontaminate.best_span(item, text, most)
            if d > most or d >= len(item):
                assert found is None
            else:
                start, edits = found
                assert edits == d and any(distance(text[start:e], item) == d for e in range(start, len(text) + 1))


def edited(rng, words, k, vocabulary):
    words = list(words)
    for _ in range(k):
        p = rng.randrange(len(words))
        how = rng.choice("rid")
        words[p : p + 1] = {"r": [rng.choice(vocabulary)], "i": [words[p], rng.choice(vocabulary)], "d": []}[how]
    return words


def test_recall_against_brute_force(spark):
    rng = random.Random(8)
    vocabulary = [f"v{k}" for k in range(300)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(6, 30)))) for i in range(12)]
    docs = []
    for d in range(90):
        body = [rng.choice(vocabulary) for _ in range(rng.randint(0, 30))]
        if d % 2:
            words = items[d % 12][1].split()
            body[len(body) // 2 : len(body) // 2] = edited(rng, words, rng.randint(0, int(0.2 * len(words))), vocabulary)
        docs.append((d, (rng.choice([" ", ", ", "\n", " **"])).join(body)))
    want = brute(docs, items)
    for block in (20_000, 7):
        rows = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_items=block).collect()
        got = {(r["doc_id"], r["item_id"]) for r in rows}
        assert got <= want and len(got) >= 0.95 * len(want) and len(want) > 30
    assert {(d, i) for d, i in want if items[i][1] in docs[d][1]} <= got


def test_query_finds_all_verbatim_items_and_only_matches(spark):
    d = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: words_of(r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    items = {r["item_id"]: words_of(r["text"]) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()}
    rows = QUERIES["op1_decontaminate"](spark, d).collect()
    for r in rows:
        v = items[r["item_id"]]
        w = docs[r["doc_id"]][r["start_word"] : r["start_word"] + len(v)]
        assert distance(w, v) == r["edits"] <= int(0.2 * len(v))
    verbatim = {(d, i) for d, w in docs.items() for i, v in items.items() if len(v) >= 8 and f" {' '.join(v)} " in f" {' '.join(w)} "}
    assert verbatim and verbatim <= {(r["doc_id"], r["item_id"]) for r in rows}


def test_edge_cases(spark):
    schema = "doc_id long, text string, item_id long, edits int"
    item = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, None, 1, 1), (2, "", 1, 1), (3, item.upper() + "!", 1, 1), (3, item, 1, 1), (None, item, 1, 1)], schema)
    items = spark.createDataFrame([(7, item, "x"), (8, None, "x"), (7, item, "x"), (9, "too short", "x")], "item_id long, text string, doc_id string")
    none = items.limit(0)
    assert decontaminate.leaks(docs, none).count() == 0 and decontaminate.leaks(docs.limit(0), items).count() == 0
    assert {(r["doc_id"], r["item_id"], r["edits"], r["start_word"]) for r in decontaminate.leaks(docs, items).collect()} == {(3, 7, 0, 0), (None, 7, 0, 0)}
    left = decontaminate.clean(docs, items)
    assert left.columns == docs.columns and sorted(r["doc_id"] or 0 for r in left.collect()) == [1, 2]


def test_edit_distances_of_many_pairs_are_exact():
    rng = random.Random(2)
    for n in (1, 5, 9):
        a, b = (np.array([[rng.randrange(3) for _ in range(n)] for _ in range(60)]) for _ in range(2))
        for most in (0, 2, 9):
            assert decontaminate.edit_distances(a, b, most).tolist() == [min(distance(x, y), most + 1) for x, y in zip(a.tolist(), b.tolist(), strict=True)]


def test_recall_at_the_edge_for_long_items(spark):
    """Items of 8 to 400 words with exactly floor(0.2 L) words replaced: at least 0.95 are found at each length."""
    rng = random.Random(12)
    for n in (8, 20, 40, 60, 120, 200, 400):
        items = [(i, " ".join(f"n{n}i{i}w{k}" for k in range(n))) for i in range(120)]
        docs = []
        for i, text in items:
            words = text.split()
            for p in rng.sample(range(n), int(0.2 * n)):
                words[p] = f"x{rng.randrange(10**9)}"
            docs.append((i, " ".join([f"y{rng.randrange(10**9)}" for _ in range(20)] + words + [f"z{rng.randrange(10**9)}" for _ in range(20)])))
        rows = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
        assert all(r["doc_id"] == r["item_id"] and r["edits"] <= int(0.2 * n) for r in rows)
        assert len(rows) >= 0.95 * len(items), n


def test_dropped_and_added_words_cost_one_edit_each(spark):
    rng = random.Random(21)

    def fresh(k):
        return [f"f{rng.randrange(10**9)}" for _ in range(k)]

    items = [(i, [f"i{i}w{k}" for k in range(n)]) for i, n in enumerate([8, 10, 15, 20, 30, 40, 59])]
    docs, want = [], {}
    for i, item in items:
        n, most = len(item), int(0.2 * len(item))
        for how in ("drop", "add", "drop more", "add more", "short"):
            for _ in range(8):
                k = 1 if how == "short" else most + how.endswith("more")
                places = rng.sample(range(1, n - 1), k)
                if how.startswith("add"):
                    words = [y for p, w in enumerate(item) for y in ([w, *fresh(1)] if p in places else [w])]
                else:
                    words = [w for p, w in enumerate(item) if p not in places]
                d = len(docs)
                docs.append((d, " ".join(words if how == "short" else fresh(n) + words + fresh(n))))
                if not how.endswith("more"):
                    want[d] = (i, k)
    item_rows = [(i, " ".join(w)) for i, w in items]
    docs, item_rows = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(item_rows, "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.leaks(docs, item_rows, free_ends=True).collect()}
    assert got.keys() <= want.keys() and len(got) >= 0.95 * len(want)
    assert all(r["item_id"] == want[d][0] and r["edits"] == want[d][1] for d, r in got.items() if r["start_word"] in (0, len(items[r["item_id"]][1])))
    left = {r["doc_id"] for r in decontaminate.clean(docs, item_rows).collect()}
    assert left == {r["doc_id"] for r in docs.collect()} - got.keys()


def test_free_ends_against_brute_force(spark):
    rng = random.Random(22)
    vocabulary = [f"v{k}" for k in range(300)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(8, 30)))) for i in range(12)]
    docs = []
    for d in range(90):
        body = [rng.choice(vocabulary) for _ in range(rng.choice([0, 5, 30]))]
        if d % 2:
            words = items[d % 12][1].split()
            body[len(body) // 2 : len(body) // 2] = edited(rng, words, rng.randint(0, int(0.2 * len(words))), vocabulary)
        docs.append((d, " ".join(body)))

    want = {(d, i) for d, t in docs for i, v in items if span_distance(t.split(), v.split()) <= int(0.2 * len(v.split()))}
    rows = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), free_ends=True).collect()
    got = {(r["doc_id"], r["item_id"]) for r in rows}
    assert got <= want and len(got) >= 0.95 * len(want) and len(want) > 30


def test_very_long_items_in_bounded_memory(spark):
    """An item of 20 000 words beside short ones: its edited copy is found, and what goes to the executors stays below 100 MB."""
    rng = random.Random(31)
    long = [f"l{k}" for k in range(20_000)]
    copy = [w if rng.random() > 0.1 else f"x{k}" for k, w in enumerate(long)]
    del copy[5000:5400]
    short = " ".join(f"s{k}" for k in range(30))
    items = [(1, " ".join(long)), (2, short), (3, " ".join(f"m{k}" for k in range(1500)))]
    block = decontaminate.Items([i for i, _ in items], [t for _, t in items], 0.2, 8, 24, 6, 0.95, True)
    assert len(pickle.dumps(block)) < 100e6
    far = [w if k % 3 else f"y{k}" for k, w in enumerate(long)]
    docs = [(1, " ".join(["a"] * 50 + copy + ["b"] * 50)), (2, "c " + short), (3, " ".join(far)), (4, " ".join(["d"] * 9 + [f"m{k}" for k in range(1500)] + long))]
    rows = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), free_ends=True).collect()
    edits = 400 + sum(w.startswith("x") for w in copy)
    first = next(k for k, w in enumerate(copy) if w.startswith("l"))  # a replaced word before it may be in the span or not
    assert {(r["doc_id"], r["item_id"], r["start_word"], r["edits"]) for r in rows} == {(1, 1, 50 + first, edits), (2, 2, 1, 0), (4, 3, 9, 0), (4, 1, 1509, 0)}


def test_short_items_and_scripts_without_blanks(spark):
    items = [(1, "what is the boiling point"), (2, "two words"), (3, "水は百度で沸騰しますがどうですか"), (4, "ああああああああああああ")]
    docs = [(1, "So: What is the BOILING point?"), (2, "what is the melting point"), (3, "two words"), (4, "前 水は百度で沸騰します、がどうですか 後"), (5, "水は五十度で沸騰しませんがこうですか"), (6, "水")]
    for least, more in ((1, {(3, 2, 0)}), (4, set())):
        rows = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), free_ends=True, least_words=least).collect()
        assert {(r["doc_id"], r["item_id"], r["edits"]) for r in rows} == {(1, 1, 0), (4, 3, 0)} | more


def test_items_of_one_to_three_words(spark):
    """Exactly where their words stand in a row in one text, once a text and item; least_words leaves them out."""
    rng = random.Random(12)
    words = ["alpha", "Beta", "gamma", "dé", "日", "x1"]
    docs = [(k, rng.choice([None, "", " ".join(rng.choice(words) for _ in range(rng.randint(0, 9)))]) if k % 7 == 0 else " ".join(rng.choice(words) for _ in range(rng.randint(0, 9)))) for k in range(120)]
    items = [(1, "alpha"), (2, "Alpha, beta!"), (3, "gamma x1 dé"), (4, "alpha"), (5, ""), (6, None), (7, "日"), (8, "beta beta"), (9, "not there"), (10, "alpha beta gamma dé x1")]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    plain = lambda t: re.findall(r"[a-z0-9é]+|日", (t or "").lower())
    want = set()
    for doc, text in docs:
        t = plain(text)
        for item, x in items:
            w = plain(x)
            at = next((k for k in range(len(t) - len(w) + 1) if t[k : k + len(w)] == w), None)
            if w and at is not None:
                want.add((doc, item, at, 0))
    got = [tuple(r) for r in decontaminate.leaks(d, i).collect()]
    assert len(got) == len(set(got)) and set(got) == want and {x[1] for x in want} >= {1, 2, 4, 7}
    assert {tuple(r) for r in decontaminate.leaks(d, i, least_words=3).collect()} == {x for x in want if x[1] in (3, 10)}
    kept = decontaminate.clean(d, i).count()
    assert kept == len(docs) - len({x[0] for x in want if x[1] == 10}) and decontaminate.clean(d, i, least_words=1).count() == len(docs) - len({x[0] for x in want})
