from collections import Counter

import corpus_pipeline
from sparkloom.llm import decontaminate, jaccard_join, mixing, quality


def test_each_stage_against_its_operator(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert 4 <= len(stages) <= 5
    for name, stage in stages.items():
        before = {r["doc_id"] for r in docs.select("doc_id").collect()}
        out = stage(spark, docs, d)
        after = Counter(r["doc_id"] for r in out.select("doc_id").collect())
        if name == "quality":
            want = {r["doc_id"] for r in quality.judge(docs, spark.read.parquet(f"{d}/labels.parquet")).filter("keep").collect()}
        elif name == "near_copies":
            want = {r["component_id"] for r in jaccard_join.jaccard_components(docs).collect()}
        elif name == "decontamination":
            want = before - {r["doc_id"] for r in decontaminate.leaks(docs, spark.read.parquet(f"{d}/benchmark.parquet")).collect()}
        elif name == "mixing":
            copies = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect() if r["copies"]}
            want = set(copies)
            assert after == copies
        else:
            want = before
            assert out.columns == [*columns, "shard", "slot"] and out.count() == docs.count()
            break
        assert set(after) == want and out.columns == columns
        docs = spark.createDataFrame(out.collect(), out.schema)


def test_nulls_ties_and_odd_columns(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").limit(60).selectExpr("*", "'x' as `a.b`", "1 as keep", "2 as component_id", "3 as _size", "4 as _row", "5 as _d")
    odd = docs.limit(3).selectExpr("case when doc_id % 2 = 0 then null else doc_id end as doc_id", "cast(null as string) as text", "cast(null as string) as lang", "cast(null as string) as source", "n_chars", "`a.b`", "keep", "component_id", "_size", "_row", "_d")
    docs = docs.unionByName(docs.limit(5)).unionByName(odd)
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, d)
        rows = out.collect()
        assert rows and out.columns[: len(docs.columns)] == docs.columns, name
        assert {tuple(r)[5:11] for r in rows} == {("x", 1, 2, 3, 4, 5)}
        docs = spark.createDataFrame([tuple(r)[: len(docs.columns)] for r in rows], docs.schema)


def test_run_and_empty_input(spark, tmp_path):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 100 and {"shard", "slot", "text"} <= set(out.columns)
    d = f"file://{tmp_path}"
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").limit(0).write.parquet(f"{d}/{t}.parquet")
    assert corpus_pipeline.run(spark, d).count() == 0


def test_rows_are_judged_by_their_own_text(spark):
    """Null and shared doc_ids: a bad text goes, and takes no other row with it."""
    d = "/root/testdata/sf0.001"
    stages = dict(corpus_pipeline.STAGES)
    schema = "doc_id long, text string, lang string, source string"
    item = spark.read.parquet(f"{d}/benchmark.parquet").first()["text"]
    good = [r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").filter("lang = 'en' and n_chars between 300 and 2000").limit(2).collect()]
    noise = "zqxj vkw qqzx jjxv " * 40
    rows = [(None, good[0], "en", "s"), (None, noise, "en", "s"), (5, good[1], "en", "s"), (5, noise + "q", "en", "s")]
    texts = lambda name, rows: sorted(r["text"] for r in stages[name](spark, spark.createDataFrame(rows, schema), d).collect())
    # The model learns from the labelled documents among those that it judges.
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    kept = texts("quality", docs + rows)
    assert all(kept.count(t) > texts("quality", docs).count(t) for t in good) and not any(t.startswith("zqxj") for t in kept)
    rows = [(None, f"{noise} {item}", "en", "s"), (None, good[0], "en", "s"), (5, item, "en", "s"), (5, good[1], "en", "s")]
    assert texts("decontamination", rows) == sorted(good)
    one, two = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    rows = [(None, one, "en", "s"), (7, one + " x", "en", "s"), (None, two, "en", "s"), (8, two + " x", "en", "s"), (8, "another text", "en", "s"), (3, two + " y", "en", "s")]
    assert texts("near_copies", rows) == sorted([one + " x", "another text", two + " y"])
