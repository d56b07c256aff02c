import random
import re
from collections import Counter, defaultdict

import pytest

from sparkloom.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string"


def brute(rows, least_docs, top):
    docs = [("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""), la or "", s or "") for _, t, la, s in rows]
    groups, df, lang_n, n = sorted({(la, s) for _, la, s in docs}), Counter(), defaultdict(Counter), defaultdict(Counter)
    for t, la, s in docs:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t)
        df.update((la, x) for x in set(terms))
        lang_n[la].update(terms)
        n[la, s].update(terms)
    out = set()
    for la, s in groups:
        kept = sorted(t for t in lang_n[la] if df[la, t] >= least_docs)

        def p(c, t, kept=kept):
            return 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept))

        pairs = [(-sum(abs(p(n[la, s], t) - p(n[la, o], t)) for t in kept), o.encode()) for l2, o in groups if l2 == la and o != s]
        terms = [(-(p(n[la, s], t) - p(lang_n[la], t)), t.encode()) for t in kept if n[la, s][t] and p(n[la, s], t) > p(lang_n[la], t)]
        for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
            out |= {(la, s, part, i.decode(), -v, k) for k, (v, i) in enumerate(found, 1)}
    return out


def run(spark, rows, **kw):
    got = divergence.audit(spark.createDataFrame(rows, SCHEMA), **kw).collect()
    out = {(r.lang, r.source, r.part, r["item"], r.value, r.rank) for r in got}
    assert len(out) == len(got)
    return out


@pytest.mark.parametrize("seed, top", [(1, 3), (2, 50), (3, 1)])
def test_equals_brute_force(spark, seed, top):
    r = random.Random(seed)
    words = ["Ab", "aB", "é", "É", "z-z", "x1y", "日本", "\U0001d54f", "k"] + [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)]
    rows = []
    for k in range(150):
        source = r.choice(["hot", "hot", "a", "b", None, "c"])
        text = " ".join(r.choice(words[: 12 if source == "hot" else len(words)]) for _ in range(r.choice([0, 1, 5, 40])))
        rows.append((k, r.choice([text, text, text, None]), r.choice(["en", "en", "fr", None]), source))
    rows += [(1, "hot w hot", "en", "hot")] * 40 + [(None, "solo", "xx", "only"), (None, "", "yy", "e1"), (None, None, "yy", "e2")]
    assert run(spark, rows, least_docs=4, top=top) == brute(rows, 4, top)


def test_counts_are_the_same_however_often_tasks_let_go(spark, monkeypatch):
    rows = [(k, f"a b{k % 5} c a É {'x' * (k % 3)}", "en", f"s{k % 3}") for k in range(60)]
    want = run(spark, rows, least_docs=3)
    monkeypatch.setattr(divergence, "HELD", 0)
    assert run(spark, rows, least_docs=3) == want == brute(rows, 3, 50)


def test_ties_very_long_text_and_empty_table(spark):
    rows = [(k, "b a c " * (30_000 if k == 0 else 1), "en", f"s{k % 2}") for k in range(6)] + [(9, "rare " * 50, "en", "s0")]
    assert run(spark, rows, least_docs=2, top=2) == brute(rows, 2, 2)
    assert not run(spark, [], least_docs=2)


def test_other_columns_with_clashing_names(spark):
    rows = [(k, "x y" if k % 2 else "y", "en", f"s{k % 2}") for k in range(6)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for c in ("term", "n", "p0", "value", "rank", "item", "posts"):
        docs = docs.selectExpr("*", f"'?' as {c}")
    assert {tuple(r) for r in divergence.audit(docs, 2).collect()} == brute(rows, 2, 50)


def test_frequency_is_exact_for_large_counts(spark):
    for c, n, v in ((0, 0, 1), (9 * 10**12, 3 * 10**13, 10**6), (123456789, 987654321, 77)):
        got = spark.range(1).select(divergence.frequency(*[divergence.F.lit(x).cast("long") for x in (c, n, v)])).first()[0]
        assert got == 1 + 10**9 * (c + 5) // (n + 5 * v)
