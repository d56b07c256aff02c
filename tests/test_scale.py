import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from sparkloom import storage
from sparkloom.operators import components, windows
from sparkloom.operators.ai import OfflineProvider
from sparkloom.plans.queries import QUERIES, TRANSCRIPT_QUESTIONS
from sparkloom.session import scoped_conf
from sparkloom.sources import compaction, stores

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("span, spans", [(1.0, 64), (0.25, 3), (2.5, 1)])
def test_stretches_of_a_key_give_what_one_window_gives(spark, span, spans):
    r = random.Random(1)
    rows = [(k % 2, r.choice([None, k / 24, k / 24, float(k // 10)]), float(k)) for k in range(2000)]
    df = spark.createDataFrame(rows, "k int, t double, v double")
    want = df.withColumn("m", F.expr(f"avg(v) over (partition by k order by t range between {span} preceding and current row)"))
    got = windows.fractional_range_mean(df, "k", "t", "v", span, "m", spans)
    plain = lambda x: sorted((tuple(-1 if c is None else round(c, 9) for c in row) for row in x.collect()), key=repr)
    assert plain(got) == plain(want)


def test_hub_edges_are_dealt_to_several_tasks(spark):
    edges = spark.range(1, 400_000).select(F.lit(0).cast("long").alias("u"), F.col("id").alias("v"))
    edges = storage.materialize(edges.unionAll(spark.range(1_000_000, 1_000_500).select("id", (F.col("id") + 1).alias("v"))).repartition(24), "star")
    small = {"spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes": "64k", "spark__sql__adaptive__advisoryPartitionSizeInBytes": "64k", "spark__sql__autoBroadcastJoinThreshold": "-1"}
    with scoped_conf(spark, **small):
        split = components.large_star(edges, split=True)
        assert split.count() == components.large_star(edges).count()
        join = edges.filter("v > u").join(storage.materialize(edges.groupBy("u").agg(F.min("v").alias("m")), "least"), "u").select("u", "m", F.xxhash64("v").alias("h"))
        join.collect()
        assert "SortMergeJoin(skew=true)" in join._jdf.queryExecution().executedPlan().toString()
    got = {(r["node"], r["component"]) for r in components.connected_components(edges.filter("u >= 1000000 or v < 300"), split_hubs=True).collect()}
    assert got == {(k, 0) for k in range(300)} | {(k, 1_000_000) for k in range(1_000_000, 1_000_501)}


def test_compaction_keeps_rows_order_and_folders(spark, tmp_path):
    many, few = f"file://{tmp_path}/many", f"file://{tmp_path}/few"
    docs = spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "lang", "text")
    docs.repartition(60).write.partitionBy("lang").parquet(many)
    before = stores.data_files(many, ".parquet")
    assert len(before) > 100
    did = compaction.compact(spark, many, few, target_bytes=60_000, partition_columns=["lang"])
    assert did["before"] == len(before) and did["after"] < len(before) / 5
    key = lambda df: sorted((r["doc_id"], r["lang"], r["text"]) for r in df.collect())
    assert key(compaction.read_compacted(spark, few)) == key(docs)
    # In a folder, rows come in the order of the files they were in.
    lang = docs.first()["lang"]
    old = [x for p, _ in before if f"lang={lang}" in p for x in spark.read.parquet(p).select("doc_id").toPandas()["doc_id"]]
    new = [x for p, _ in sorted(stores.data_files(few, ".parquet"), key=lambda f: int(f[0].split("_bin=")[1].split("/")[0])) if f"lang={lang}" in p for x in spark.read.parquet(p).select("doc_id").toPandas()["doc_id"]]
    assert old == new
    assert compaction.plan([("a", 5), ("b", 9), ("c", 100), ("d", 1), ("e", 1)], 10) == [("a", 0, 0), ("b", 1, 1), ("c", 2, 2), ("d", 3, 3), ("e", 4, 3)]


def test_a_cluster_without_a_shared_folder_is_told_so():
    class Conf(dict):
        def get(self, k, default=None):
            return dict.get(self, k, default)

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf({"spark.sql.warehouse.dir": "file:/home/x/spark-warehouse"})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.shared_dir(Session())


def test_transcript_contexts_against_a_plain_version(spark):
    import re

    offline, rows = OfflineProvider(), spark.read.parquet(f"{D}/conversations.parquet").collect()
    segments = []
    for r in rows:
        pieces = [p.strip() for p in re.split(r"(?<=[.!?])\s+(?=[A-Z])", r["text"] or "")]
        segments += [(f"{r['conv_id']}/{r['turn']}/{n}", p) for n, p in enumerate(x for x in pieces if x)]
    vectors = np.array([offline.embed_text(p) for _, p in segments])
    got = {r["question"]: r["context"] for r in QUERIES["transcript_contexts"](spark, D).collect()}
    assert set(got) == set(TRANSCRIPT_QUESTIONS)
    for q in TRANSCRIPT_QUESTIONS:
        v = np.array(offline.embed_text(q))
        with np.errstate(invalid="ignore", divide="ignore"):
            d = 1 - vectors @ v / (np.linalg.norm(vectors, axis=1) * np.linalg.norm(v))
        found = [x[1] for x in sorted((round(float(x), 9), k) for x, k in zip(d, range(len(d)), strict=True) if x == x)[:5]]
        parts = got[q].split("\n\n")
        # Of segments equally near, any may come first but for the last bits of their distance.
        assert len(parts) == 5 and sorted(round(float(d[[s for _, s in segments].index(p)]), 6) for p in parts) == sorted(round(float(d[k]), 6) for k in found)
