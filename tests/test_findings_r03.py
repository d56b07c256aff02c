"""Cases that the review of round 3 found, each held against the query's own SQL or a plain version."""

import datetime
import random

import duckdb
import numpy as np
import pyarrow as pa
from oracle import differences
from pyspark.sql import functions as F

from sparkloom.operators import dedup, extract, retrieval
from sparkloom.plans.queries import ORACLE_SQL, QUERIES
from sparkloom.session import scoped_conf


def differs(spark, tmp_path, name, **tables):
    """What :func:`differences` says of a query over the given tables only."""
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t, df in tables.items():
        df.coalesce(1).write.parquet(f"file://{tmp_path}/{t}.parquet")
        con.execute(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    return differences(spark, con, str(tmp_path), QUERIES[name], ORACLE_SQL[name])


def test_f1_years_of_five_digits_and_before_zero(spark, tmp_path):
    ids = [0, 19_000, 2_932_896, 2_932_897, 5_999_999, 106_751_990, -1, -719_000, -719_163, -719_529, -800_000, None]
    assert not differs(spark, tmp_path, "epoch_millis", events=spark.createDataFrame([(k,) for k in ids], "event_id long"))


def test_f2_titles_as_written(spark, tmp_path):
    pages = ["<title>a &quot;b&quot; &amp; c&amp</title>", "<title>  x\u00a0</title><title>y</title>", "<p>none</p>", "<title></title>", "<title>\ta\n</title>", None, "", "<title>a<b></title>", "<TITLE>t</TITLE>", "<title> </title>", "<title>&amp;lt; &amp;amp; $1 \\1</title>"]
    assert not differs(spark, tmp_path, "html_titles", pages=spark.createDataFrame(list(enumerate(pages)), "page_id long, html string"))


def test_f3_returns_on_a_close_of_zero(spark, tmp_path):
    closes = [5.0, 0.0, 7.5, 0.0, 0.0, -2.5, -0.0, 1.0, -0.0, -1.0, 0.0, -3.0, 4.0]
    rows = [(k, datetime.datetime(2024, 1, 1 + k), 1, v) for k, v in enumerate(closes)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, value double")
    assert not differs(spark, tmp_path, "win_lag_return", events=events)


def vectors(spark, n=700):
    """Copies, and vectors nearer to a query than a lesser key's by less than nine digits show."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, 8)).astype(np.float32)
    x[300:340] = x[100]
    double = x.astype(float)
    double[11] = double[200] + 3e-5 * rng.normal(size=8)
    double[12] = double[200] + 2e-5 * rng.normal(size=8)
    return spark.createDataFrame([(k, v.tolist(), k % 3) for k, v in enumerate(double)], "vec_id long, embedding array<double>, label int")


def test_f4_contexts_of_examples_that_tie(spark, tmp_path):
    assert not differs(spark, tmp_path, "context_few_shot", embeddings=vectors(spark))


def test_f5_neighbours_that_tie(spark, tmp_path):
    assert not differs(spark, tmp_path, "knn_per_query", embeddings=vectors(spark))


def test_f5_blocks_of_any_kind_give_what_a_plain_version_gives(spark, monkeypatch):
    e = vectors(spark, 400)
    odd = spark.createDataFrame([(1000, [0.0] * 8, 0), (1001, None, 0), (1002, [1.0, 2.0], 0), (1003, [1.0, 2.5], 0), (1004, [None] * 8, 0), (1005, [], 0)], e.schema)
    e = e.unionAll(odd).repartition(5)
    all_rows = {r["vec_id"]: r["embedding"] for r in e.collect()}
    asked = [k for k in all_rows if k % 7 == 0 or k >= 1000]
    want = set()
    for a in asked:
        found = []
        for b, v in all_rows.items():
            q = all_rows[a]
            if q and v and len(q) == len(v) and None not in q + v and any(q) and any(v):
                found.append((round(1 - np.dot(q, v) / np.sqrt(np.dot(q, q) * np.dot(v, v)), 9) + 0.0, b))
        want |= {(a, b, rank) for rank, (_, b) in enumerate(sorted(found)[:4], 1)}
    q = e.filter(F.col("vec_id").isin(asked)).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    for few in (16, 0):
        monkeypatch.setattr(retrieval, "FEW_BLOCKS", few)
        with scoped_conf(spark, spark__sql__autoBroadcastJoinThreshold=-1):
            got = retrieval.knn(e, q, 4, block=9)
            assert {(r["query_id"], r["vec_id"], r["rank"]) for r in got.collect()} == want
            plan = got._jdf.queryExecution().executedPlan().toString()
        assert ("BroadcastNestedLoopJoin" if few else "CartesianProduct") in plan and "SortMergeJoin" not in plan


def test_f6_blocks_leave_in_small_batches():
    nested = "<div>" * 300 + "".join(f"<p>{k} {'word ' * 200}</p>" for k in range(20)) + "</div>" * 300
    pages = [nested, None, "", "<p>a</p><p>a</p>", nested, "<li>x"]
    given = pa.RecordBatch.from_arrays([pa.array(range(len(pages))), pa.array(pages)], ["k", "h"])
    out = list(extract.block_batches(iter([given])))
    assert len(out) > 10 and all(b.nbytes < 2 * extract.HELD_CHARS for b in out)
    got = [tuple(row.values()) for b in out for row in b.to_pylist()]
    assert got == [(k, *x) for k, page in enumerate(pages) for x in extract.blocks_of(page)]


def test_f6_pages_come_in_small_batches(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    blocks = extract.html_blocks(spark.range(400).select("id", F.repeat(F.lit("<p>word</p>"), 5000).alias("h")).coalesce(1), "id", "h")
    assert blocks.groupBy("id").count().filter("count = 5000").count() == 400
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 4 << 20


def test_f7_texts_come_in_small_batches(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    docs = spark.range(300).select("id", F.concat_ws(" ", (F.col("id") % 3).cast("string"), F.repeat(F.concat(F.lit("w"), (F.col("id") % 3).cast("string"), F.lit(" ")), 5000)).alias("t")).coalesce(1)
    got = {r["id"]: r["rep"] for r in dedup.dedup(docs, "id", "t").collect()}
    assert got == {k: k % 3 for k in range(300)}
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 4 << 20


def test_f8_copies_stay_out_of_the_components(spark, monkeypatch):
    r = random.Random(2)
    base = [" ".join(r.choice("abcdefgh") + str(r.randrange(300)) for _ in range(200)) for _ in range(3)]
    near = base[0].replace(base[0].split()[100], "changed", 1)
    rows = [(f"n{k:04}", (base + [near])[k % 4]) for k in range(1200)] + [("x", None), ("x", None), ("y", " "), ("n0001", None), (None, base[1]), (None, None)]
    # A node of two texts links what resembles either.
    rows += [("q", base[1]), ("q", base[2])]
    df, seen = spark.createDataFrame(rows, "id string, t string").repartition(4), []
    real = dedup.connected_components

    def counted(edges, **options):
        seen.append(edges.count())
        return real(edges, **options)

    monkeypatch.setattr(dedup, "connected_components", counted)
    marked = dedup.dedup(df, "id", "t")
    got = {(x["id"], x["rep"]) for x in marked.collect()}
    want = {(i, "n0000" if k % 4 in (0, 3) else "n0001") for k, (i, _) in enumerate(rows[:1200])}
    assert got == want | {("x", "x"), ("y", "y"), (None, None), ("q", "n0001")} and marked.count() == len(rows)
    kept = sorted((x["id"] for x in dedup.representatives(df, "id", "t").collect()), key=repr)
    assert kept == sorted([None, "n0000", "n0001", "x", "y"], key=repr)
    assert set(kept) == {x["id"] for x in dedup.keep_representatives(marked).collect()} and max(seen) < 20


def test_f8_blocks_kept_are_those_of_the_plain_way(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    # The same page_id with the same and with another page.
    pages = pages.select("page_id", "html").unionAll(pages.filter("page_id % 3 = 0").select("page_id", "html")).unionAll(pages.filter("page_id % 5 = 0").select("page_id", F.lit("<p>...</p><p>other</p>")))
    blocks = extract.html_blocks(pages, "page_id", "html")
    plain = dedup.keep_representatives(dedup.dedup(blocks.select("block_id", "text").dropDuplicates(["block_id"]), "block_id", "text")).select("block_id")
    kept = sorted(r["block_id"] for r in dedup.representatives(blocks, "block_id", "text").collect())
    assert kept == sorted(r["block_id"] for r in plain.collect()) and len(kept) == len(set(kept)) > 50
