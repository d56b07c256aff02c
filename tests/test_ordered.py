import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.functions import variant
from sparkloom.operators.ordered import ordered_totals


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed, groups", [(1, []), (2, ["g"]), (3, ["g"])])
def test_equals_a_window_over_all(spark, seed, groups):
    r = random.Random(seed)
    # Half the rows have one value and, in groups, one group.
    rows = [(k, r.choice([None, 1, 1, 1, 2]), r.choice([5, 5, 5, None, r.randrange(20)]), r.choice([None, 1, 7]), "x") for k in range(700)]
    df = spark.createDataFrame(rows, "id int, g int, a int, v int, rank string")
    got = ordered_totals(df, ["-a"], ["id"], groups, {"total": "v"}, ranges=13)
    w = Window.partitionBy(*groups).orderBy(F.col("a").desc(), "id")
    ties = Window.partitionBy(*groups).orderBy(F.col("a").desc())
    want = df.withColumns({"row_number": F.row_number().over(w), "rank": F.rank().over(ties), "dense_rank": F.dense_rank().over(ties), "total": F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    names = ["id", "g", "a", "v", "row_number", "rank", "dense_rank", "total"]
    assert rows_of(got, *names) == rows_of(want, *names)


def test_a_value_of_half_the_rows_is_in_many_ranges(spark):
    df = spark.range(20_000).select("id", F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id")).alias("a"))
    got = ordered_totals(df, ["a"], ranges=16)
    assert sorted(r[0] for r in got.select("row_number").collect()) == list(range(1, 20_001))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "hashpartitioning(_range" in plan


def test_empty_and_equal_rows(spark):
    df = spark.createDataFrame([], "a int")
    assert not ordered_totals(df, ["a"], ranges=3).collect()
    same = spark.createDataFrame([(1,)] * 50, "a int")
    assert rows_of(ordered_totals(same, ["a"], ranges=4, sums={"s": "a"}), "row_number", "rank", "dense_rank", "s") == sorted(((k, 1, 1, k) for k in range(1, 51)), key=repr)


JSON = [(1, '{"k": 5, "d": {"os": "a"}, "items": [{"sku": 3}]}'), (2, '{"k": "x"'), (3, None), (4, '{"k": "word", "items": []}'), (5, "7"), (6, ""), (7, '{"k": null, "d": 1}'), (8, '{"k": 1.5}')]


def test_variant_paths_and_malformed_text(spark):
    df = spark.createDataFrame(JSON, "id int, j string")
    got = variant.json_columns(df, "j", {"k": ("$.k", "long"), "os": ("$.d.os", "string"), "sku": ("$.items[0].sku", "int")}, "bad")
    assert [tuple(r) for r in got.orderBy("id").select("id", "k", "os", "sku", "bad").collect()] == [
        (1, 5, "a", 3, False), (2, None, None, None, True), (3, None, None, None, False), (4, None, None, None, False), (5, None, None, None, False), (6, None, None, None, True), (7, None, None, None, False), (8, 1, None, None, False),
    ]


def test_schema_from_the_data(spark):
    df = spark.createDataFrame([(1, '{"k": 5, "t": ["a"]}'), (2, '{"k": 6, "d": {"os": "x"}}'), (3, "{")], "id int, j string")
    assert variant.schema_of(df, "j") == "OBJECT<d: OBJECT<os: STRING>, k: BIGINT, t: ARRAY<STRING>>"
    got = [r["value"] for r in variant.shredded(df, "j").orderBy("id").collect()]
    assert got[0]["k"] == 5 and got[0]["t"] == ["a"] and got[1]["d"]["os"] == "x" and got[2] is None
    assert variant.schema_of(df.filter("id > 3"), "j") == "VOID" and variant.shredded(df.filter("id > 3"), "j").count() == 0
