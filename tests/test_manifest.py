import glob
import os
import threading

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sparkloom.session import scoped_conf
from sparkloom.sources import manifest, pushdown, stores


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def grouped(tmp_path):
    """Two files of five row groups of 100 rows each, sorted by k."""
    for f in range(2):
        n = range(500 * f, 500 * f + 500)
        t = pa.table({"k": n, "s": [f"s{i // 100}" for i in n], "x": [float("nan") if i == 250 else float(i) for i in n], "z": [None if i >= 900 else i % 7 for i in n], "l": [[i] for i in n]})
        pq.write_table(t, tmp_path / f"{f}.parquet", row_group_size=100)
    return str(tmp_path)


CONDITIONS = ["k = 250", "k > 899", "k >= 100 and k < 200", "k in (5, 950)", "s = 's3'", "s >= 's8'", "x > 989", "x = 7", "x < 2", "z is null", "z is not null and k > 880", "z = 3 and k <= 300", "k = 5000",
              "x > double('NaN')", "x = double('NaN')", "not (k < 990)", "s like 's1%' and k > 150", "k is null", "s in ('s2') and k <> 201"]


@pytest.mark.parametrize("condition", CONDITIONS)
def test_filters_give_what_spark_gives(spark, grouped, condition):
    # Spark's own reader prunes by statistics that leave NaN out, and so loses rows, unless told not to.
    with scoped_conf(spark, spark__sql__parquet__filterPushdown="false"):
        want = rows_of(spark.read.parquet(grouped).filter(condition).selectExpr("k", "s", "cast(x as string)", "z"))
    got = pushdown.read_filtered(spark, grouped, target_rows=150).filter(condition).selectExpr("k", "s", "cast(x as string)", "z")
    assert rows_of(got) == want


@pytest.mark.parametrize("filters, rows", [
    ([], 1000), ([pushdown.EqualTo(("k",), 250)], 100), ([pushdown.In(("k",), (5, 950))], 200), ([pushdown.GreaterThanOrEqual(("k",), 400), pushdown.LessThan(("k",), 600)], 200),
    ([pushdown.GreaterThan(("x",), 1e9)], 1000), ([pushdown.LessThan(("x",), 100.0)], 100), ([pushdown.IsNull(("z",))], 100), ([pushdown.EqualTo(("s",), "s3")], 100), ([pushdown.EqualTo(("k",), -1)], 0),
])
def test_only_row_groups_that_can_match_are_read(grouped, filters, rows):
    reader = pushdown.ParquetReader([p for p, _ in stores.data_files(grouped)], pq.read_schema(f"{grouped}/0.parquet"))
    assert not list(reader.pushFilters(filters))
    assert sum(p.rows for p in reader.partitions()) == rows


def test_filters_that_the_source_cannot_take_go_back(grouped):
    reader = pushdown.ParquetReader([], pq.read_schema(f"{grouped}/0.parquet"))
    left = [pushdown.EqualTo(("l",), [1]), pushdown.EqualTo(("x",), float("nan")), pushdown.EqualTo(("a", "b"), 1), pushdown.EqualTo(("k",), None)]
    assert list(reader.pushFilters([*left, pushdown.EqualTo(("k",), 1)])) == left


def test_columns_and_the_plan(spark, grouped):
    df = pushdown.read_filtered(spark, grouped, ["s", "k"]).filter("k = 3 and s like '%3'")
    assert df.columns == ["s", "k"]
    plan = df._jdf.queryExecution().executedPlan().toString()
    # What the source takes is gone from Spark's own filter.
    assert "EndsWith(s" in plan.split("BatchScan")[0] and "(k" not in plan.split("BatchScan")[0].split("Filter")[1].split("\n")[0]


def test_write_read_append_overwrite_and_older_versions(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    df = spark.range(100).withColumn("v", F.col("id") % 3)
    manifest.write(df, root, "id")
    manifest.write(spark.range(100, 120).withColumn("v", F.lit(9).cast("long")), root, "id")
    assert manifest.read(spark, root).count() == 120 and manifest.read(spark, root, version=1).count() == 100
    assert spark.read.format(manifest.FORMAT).option("path", root).load().filter("id >= 95 and v = 9").count() == 20
    low = manifest.read(spark, root, between=(105, 107))
    assert low.filter("id between 105 and 107").count() == 3 and low.count() < 120
    with pytest.raises(Exception, match="the table has columns"):
        manifest.write(spark.range(3).withColumn("other", F.lit("x")), root)
    manifest.write(df.filter("id < 5"), root, "id", mode="overwrite")
    assert rows_of(manifest.read(spark, root)) == [(k, k % 3) for k in range(5)]
    assert manifest.vacuum(root) > 0 and manifest.read(spark, root).count() == 5
    manifest.write(df.filter("id < 0"), f"{root}2")
    assert manifest.read(spark, f"{root}2").count() == 0


def test_a_task_that_fails_half_way_leaves_the_old_state(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    manifest.write(spark.range(10), root)
    before = latest_files(tmp_path), manifest.latest(root)

    @F.udf("long")
    def fails(x):
        if x == 77:
            raise ValueError("half-way")
        return x

    with pytest.raises(Exception, match="half-way"):
        manifest.write(spark.range(0, 100, 1, 4).select(fails("id").alias("id")), root)
    assert rows_of(manifest.read(spark, root)) == [(k,) for k in range(10)]
    # A task that was killed meanwhile may leave a file, which no manifest names.
    assert manifest.latest(root) == before[1] and set(latest_files(tmp_path)) >= set(before[0])
    manifest.vacuum(root)
    assert latest_files(tmp_path) == before[0]


def latest_files(tmp_path):
    return sorted(glob.glob(f"{tmp_path}/t/data/**/*.parquet", recursive=True))


def test_upsert_touches_only_files_with_its_keys(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    for k in range(4):
        manifest.write(spark.range(100 * k, 100 * k + 100).coalesce(1).withColumn("v", F.lit("old")), root, "id")
    before = {p.path for p in manifest.latest(root).parts}
    new = spark.createDataFrame([(205, "a", 1), (205, "b", 2), (299, "c", 1), (1000, "d", 1), (None, "n", 1), (None, "n", 1)], "id long, v string, o int")
    did = manifest.upsert(spark, root, new.drop("o"), ["id"])
    after = {p.path for p in manifest.latest(root).parts}
    assert did == {"kept": 3, "rewritten": 1, "added": 1} and len(before & after) == 3
    got = dict(r for r in rows_of(manifest.read(spark, root)) if r[0] is not None)
    assert got == {k: "old" for k in range(400)} | {205: "b", 299: "c", 1000: "d"}
    assert manifest.read(spark, root).filter("id is null").count() == 2
    # No new key: nothing but one file more. An order column decides before the values do.
    assert manifest.upsert(spark, root, spark.createDataFrame([(5000, "x")], "id long, v string"), ["id"])["rewritten"] == 0
    ordered = manifest.newest(new, ["id"], "o").filter("id = 205").first()
    assert ordered["v"] == "b"
    assert manifest.newest(new.withColumn("o", -F.col("o")), ["id"], "o").filter("id = 205").first()["v"] == "a"


def test_upsert_makes_a_table_and_takes_several_and_text_keys(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    make = lambda rows: spark.createDataFrame(rows, "a string, b date, v int").withColumn("b", F.to_date("b")) if rows else None
    import datetime

    d = datetime.date(2024, 1, 2)
    manifest.upsert(spark, root, make([("é", d, 1), ("z", d, 2)]), ["a", "b"])
    manifest.upsert(spark, root, make([("é", d, 3), ("é", d + datetime.timedelta(1), 4)]), ["a", "b"])
    manifest.upsert(spark, root, make([("q", d, 5)]), ["b", "a"])
    assert rows_of(manifest.read(spark, root).select("a", "v")) == [("q", 5), ("z", 2), ("é", 3), ("é", 4)]


def test_of_two_writers_one_starts_again(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/t"
    manifest.write(spark.range(10).withColumn("v", F.lit(0)), root, "id")
    waits, real = threading.Barrier(2, timeout=120), manifest.commit
    first = threading.local()

    def together(*a):
        if not getattr(first, "done", False):
            first.done = True
            waits.wait()
        return real(*a)

    monkeypatch.setattr(manifest, "commit", together)
    results = {}

    def write(v):
        results[v] = manifest.upsert(spark, root, spark.createDataFrame([(3, v), (100 + v, v)], "id long, v int"), ["id"])

    threads = [threading.Thread(target=write, args=(v,)) for v in (1, 2)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    got = dict(map(tuple, manifest.read(spark, root).collect()))
    assert set(results) == {1, 2} and manifest.latest(root).version == 3
    assert set(got) == {*range(10), 101, 102} and got[3] in (1, 2) and (got[101], got[102]) == (1, 2)


def test_publish_takes_a_name_once(tmp_path):
    path = f"file://{tmp_path}/log/1.json"
    assert stores.publish(path, b"a") and not stores.publish(path, b"b")
    assert open(f"{tmp_path}/log/1.json").read() == "a" and os.listdir(f"{tmp_path}/log") == ["1.json"]
