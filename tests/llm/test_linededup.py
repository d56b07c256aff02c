import random

from sparkloom.llm import linededup
from sparkloom.llm.queries import QUERIES


def test_patience_gives_a_common_subsequence_and_finds_moved_blocks_once():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ([rng.randrange(8) for _ in range(rng.randint(0, 12))] for _ in range(2))
        m = linededup.patience(a, b)
        assert all(a[i] == b[j] for i, j in m) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(m, m[1:], strict=False))
    assert linededup.patience([1, 2, 3, 9], [7, 1, 2, 3]) == [(0, 1), (1, 2), (2, 3)]
    assert linededup.patience([1, 2, 3], [1, 2, 3]) == [(0, 0), (1, 1), (2, 2)]
    assert list(linededup._touching([(0, 1), (1, 2), (3, 3), (4, 9)])) == [(0, 1, 3), (3, 3, 4), (4, 9, 10)]


def common(a, b, words, least):
    """Places in b of all runs of at least so many words that a has too, found diagonal by diagonal."""
    at, gone = {}, set()
    for i, x in enumerate(a):
        at.setdefault(x, []).append(i)
    for j, x in enumerate(b):
        for i in at.get(x, ()):
            if i and j and a[i - 1] == b[j - 1]:
                continue
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            if sum(words[j : j + n]) >= least:
                gone |= set(range(j, j + n))
    return sorted(gone)


def test_alignments_find_all_common_runs():
    rng = random.Random(8)
    for k in range(600):
        size = rng.choice([3, 8, 30])
        count = [rng.choice([0, 1, 5, 9, 25]) for _ in range(size)]
        a, b = ([rng.randrange(size) for _ in range(rng.randint(0, 25))] for _ in range(2))
        if k % 3 == 0:
            b = b[:3] + a[5:] + a[:5] + a[:4] + b[3:]
        words = [count[x] for x in b]
        assert linededup.aligned_lines(a, b, words, 20).tolist() == common(a, b, words, 20)


def test_orders_are_ascending_and_few():
    rng = random.Random(2)
    for _ in range(200):
        places = [(rng.randrange(12), j) for j in range(rng.randint(0, 15))]
        found = linededup.orders(places)
        assert sorted(x for o in found for x in o) == sorted(places)
        assert all(p[0] < q[0] for o in found for p, q in zip(o, o[1:], strict=False))
        # As many as the longest run that never ascends.
        longest = [0] * len(places)
        for q, (i, _) in enumerate(places):
            longest[q] = 1 + max([longest[p] for p in range(q) if places[p][0] >= i], default=0)
        assert len(found) == max(longest, default=0)
    passages = [[10 * k + x for x in range(10)] for k in range(2000)]
    a, b = sum(passages, []), sum(reversed(passages), [])
    assert len(linededup.aligned_lines(a, b, [3] * len(b), 20)) == len(b)
    many = [(50_000 - k, k) for k in range(50_000)]
    assert len(linededup.orders(many)) == 50_000


def brute(docs, rare=16, least=20):
    """The pairs and deletions by the definition, without an alignment."""
    lines = {d: [" ".join(x.split()) for x in (t or "").split("\n")] for d, t in docs}
    held = {}
    for d, ls in lines.items():
        for x in ls:
            if x:
                held.setdefault(x, set()).add(d)
    number = {x: k for k, x in enumerate({x for ls in lines.values() for x in ls})}
    for d, ls in lines.items():
        for i in range(len(ls)):
            j = next((j for j in range(i + 1, len(ls) + 1) if sum(len(x.split()) for x in ls[i:j]) >= least), None)
            if ls[i] and j:
                held.setdefault(tuple(ls[i:j]), set()).add(d)
    pairs = {(d, min(ds)) for x, ds in held.items() if len(ds) > 1 and (len(ds) <= rare or isinstance(x, tuple)) for d in ds if d != min(ds)}
    gone = {d: set() for d in lines}
    for late, early in pairs:
        gone[late] |= set(common([number[x] for x in lines[early]], [number[x] for x in lines[late]], [len(x.split()) for x in lines[late]], least))
    return {d: ("\n".join(x for j, x in enumerate((t or "").split("\n")) if j not in gone[d]), sorted(gone[d])) for d, t in docs}


def test_query_matches_brute_force(spark):
    d = "/root/testdata/sf0.01"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = {r["doc_id"]: (r["text"], r["removed_lines"]) for r in QUERIES["op10_line_dedup"](spark, d).collect()}
    assert got == brute(docs) and sum(bool(v[1]) for v in got.values()) > 10


def test_frequent_passages_of_short_lines(spark):
    rng = random.Random(4)
    passage = "\n".join(" ".join(f"w{k}{j}" for j in range(6)) for k in range(9))
    docs = [(i, " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randint(1, 30))) + "\n" + passage + "\ntail " + str(i)) for i in range(70)]
    got = {r["doc_id"]: (r["text"], r["removed_lines"]) for r in linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute(docs) and all(v[1] == list(range(1, 10)) for k, v in got.items() if k)


def test_hot_long_lines_and_edge_cases(spark):
    rng = random.Random(9)
    passage = " ".join(f"p{k}" for k in range(55))
    short = "common short line"
    docs = [(i, "\n".join([short, " ".join(f"u{rng.randrange(10**6)}" for _ in range(30)), passage.replace(" ", "  ") if i % 2 else passage])) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "\n\n"), (103, passage)]
    schema = "doc_id long, text string, removed_lines string, line long, earlier int"
    frame = spark.createDataFrame([(*x, "r", 1, 2) for x in docs] + [(None, passage, "r", 1, 2)] + [(59, docs[59][1], "r", 1, 2)], schema)
    out = linededup.dedup_lines(frame)
    rows = out.collect()
    want = brute(docs)
    assert out.columns == ["doc_id", "text", "line", "earlier", "removed_lines"] and len(rows) == len(docs) + 2
    for r in rows:
        if r["doc_id"] is None:
            assert r["text"] == passage and r["removed_lines"] == []
        else:
            assert ((r["text"] or "").split(), r["removed_lines"]) == (want[r["doc_id"]][0].split(), want[r["doc_id"]][1])
    assert [r["text"] for r in rows if r["doc_id"] == 100] == [None] and sum(bool(r["removed_lines"]) for r in rows) == 61
    assert linededup.dedup_lines(frame.limit(0)).count() == 0


def test_no_shared_run_survives(spark):
    """Passages of one or more lines, in any order and repeated: no run of 20 words that an earlier document has is left."""
    rng = random.Random(6)

    def line(k, n):
        return " ".join(f"w{k}x{j}" for j in range(n))

    passages = [[line(10 * p + k, rng.choice([3, 7, 12, 25])) for k in range(5)] + [line(1000 + p, 6)] for p in range(6)]
    docs = [(1, "\n".join(passages[0] + passages[1])), (2, "\n".join(passages[1] + passages[0])), (3, "\n".join(passages[2] + ["x y"] + passages[2])), (4, "\n".join(passages[2]))]
    for d in range(5, 120):
        body = []
        for p in rng.choices(passages, k=3):
            body += [line(10**6 + rng.randrange(10**6), rng.randint(1, 30)), *p[rng.randrange(3) :]]
        docs.append((d, "\n".join(body)))
    lines = {d: t.split("\n") for d, t in docs}

    def runs(d):
        ls = lines[d]
        n = [len(x.split()) for x in ls]
        return [(i, j, tuple(ls[i:j])) for i in range(len(ls)) for j in range(i + 1, len(ls) + 1) if sum(n[i:j]) >= 20]

    want, seen = {}, set()
    for d in sorted(lines):
        want[d] = sorted({k for i, j, x in runs(d) if x in seen for k in range(i, j)})
        seen |= {x for _, _, x in runs(d)}
    got = {r["doc_id"]: r["removed_lines"] for r in linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == want
    assert got[2] == list(range(12)) and got[4] == list(range(6))
