import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import ivf, retrieval

D = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.read.parquet(f"{D}/embeddings.parquet").select("vec_id", "embedding")


@pytest.fixture(scope="module")
def index(spark, vectors, tmp_path_factory):
    return ivf.build(vectors, f"file://{tmp_path_factory.mktemp('ivf')}/i")


def queries_of(vectors):
    return vectors.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_embedding"))


def pairs(df):
    return {(r["query_id"], r["vec_id"]) for r in df.collect()}


def test_every_row_is_in_one_list(spark, vectors, index):
    assert spark.read.parquet(f"{index.path}/lists").groupBy("vec_id").count().filter("count = 1").count() == vectors.count()


def test_recall_against_all_rows(spark, vectors, index):
    q = queries_of(vectors)
    want = pairs(retrieval.knn(vectors, q, 10))
    got = pairs(ivf.search(index, vectors, q, 10))
    assert len(got) == len(want) and len(got & want) >= 0.9 * len(want)
    print("recall", len(got & want) / len(want))


def test_vectors_with_clusters_need_few_lists(spark, tmp_path):
    r = np.random.default_rng(3)
    centres = r.normal(size=(40, 16))
    x = centres[r.integers(0, 40, 4000)] + 0.1 * r.normal(size=(4000, 16))
    v = spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(x)], "vec_id long, embedding array<double>")
    index = ivf.build(v, f"file://{tmp_path}/c", lists=40)
    want = pairs(retrieval.knn(v, queries_of(v), 10))
    assert index.nprobe <= 4 and len(pairs(ivf.search(index, v, queries_of(v))) & want) >= 0.9 * len(want)


def test_a_search_of_all_lists_and_rows_is_exact(spark, vectors, index):
    q = queries_of(vectors).filter("query_id % 400 = 0")
    got = ivf.search(index, vectors, q, 5, nprobe=len(index.centroids), candidates=vectors.count(), block=3)
    want = retrieval.knn(vectors, q, 5)
    rows = lambda df: sorted((r["query_id"], r["rank"], r["vec_id"], round(r["distance"], 9)) for r in df.collect())
    assert rows(got) == rows(want)


def test_only_probed_lists_are_scanned(spark, vectors, index):
    q = queries_of(vectors).limit(1)
    part = q.toArrow()
    found = ivf._search_block(spark, index, part, 2, 10, "query_id", "bigint")
    scan = next(x for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Scan parquet" in x)
    wanted = ivf.nearest(ivf._matrix(part.column(1).combine_chunks()), index.centroids, 2)[0]
    assert "PartitionFilters" in scan and all(str(c) in scan.split("PartitionFilters")[1] for c in wanted)
    read = spark.read.parquet(f"{index.path}/lists").filter(F.col("list").isin([int(c) for c in wanted])).inputFiles()
    assert {int(f.split("list=")[1].split("/")[0]) for f in read} >= {int(c) for c in wanted}


def test_reopened_index_finds_the_same(spark, vectors, index):
    q = queries_of(vectors).filter("query_id % 500 = 0")
    again = ivf.open_index(spark, index.path)
    assert np.allclose(again.books, index.books) and pairs(ivf.search(again, vectors, q)) == pairs(ivf.search(index, vectors, q))


def test_ties_nulls_zeros_and_empty(spark, tmp_path):
    rows = [(k, [1.0, 0.0, 0.0, 0.0]) for k in range(300)] + [(1000 + k, [0.0, 1.0, float(k), 0.0]) for k in range(20)] + [(2000, None), (2001, [0.0] * 4)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = ivf.build(v, f"file://{tmp_path}/a", subspaces=2, codes=8)
    q = spark.createDataFrame([(1, [2.0, 0.0, 0.0, 0.0]), (2, None), (3, [0.0, 1.0, 0.0, 0.0])], "query_id long, query_embedding array<double>")
    got = ivf.search(index, v, q, 5, nprobe=len(index.centroids), candidates=10).collect()
    assert sorted(r["vec_id"] for r in got if r["query_id"] == 1) == [0, 1, 2, 3, 4]
    assert next(r["vec_id"] for r in got if r["query_id"] == 3 and r["rank"] == 1) == 1000 and not [r for r in got if r["query_id"] == 2]
    none = v.filter("vec_id < 0")
    assert not ivf.search(ivf.build(none, f"file://{tmp_path}/b", subspaces=2), none, q.filter("query_id = 2")).collect()
