"""A training-data pipeline of five operators of ``sparkloom.llm``, each stage a table that the next one reads.

Each stage takes (spark, docs, sf_dir) and returns what it keeps of ``docs``: all columns of documents, and the last stage also
the shard and the slot. ``run`` writes every stage as Parquet in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import decontaminate, jaccard_join, mixing, quality, sharding
from sparkloom.storage import materialize, release


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _without(docs: DataFrame, key: Column, dropped: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose key is not in ``dropped`` (one column). Whole rows travel as one struct, whose fields' names clash with nothing."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), key.alias("_k"))
    return rows.join(dropped.toDF("_key").distinct(), F.col("_k") == F.col("_key"), "left_anti").select("_row.*")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is inside their language's limits. Every row is judged by its own text, whatever its doc_id."""
    rejected = quality.judge(docs, _table(spark, sf_dir, "labels")).filter(~F.col("keep"))
    return _without(docs, F.xxhash64("doc_id", "text"), rejected.select("row_key"))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each group of near copies; null ids come last.

    Rows that share a doc_id, or have none, are documents of their own, told apart by their text. Rows equal in doc_id and text are
    one document, and stay or go together.
    """
    key = F.xxhash64("doc_id", "text")
    groups = jaccard_join.jaccard_components(docs.select(key.alias("doc_id"), "text")).select(F.col("doc_id").alias("key"), F.col("component_id").alias("group"))
    named = materialize(docs.select(key.alias("key"), "doc_id").distinct().join(groups.distinct(), "key"), "groups")
    first = named.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    return _without(docs, key, named.join(first, "group").filter("key <> first.key").select("key"))


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item; every row is judged by its own text, and null texts stay."""
    return decontaminate.clean(docs, _table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; texts without words are never taken, null sources are one source, and
    rows that repeat are documents of their own."""
    return mixing.apply_mix(docs)


def shuffle_into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard and slot."""
    return sharding.assign(docs, shards=8)


STAGES = [
    ("quality", keep_quality),
    ("near_copies", keep_one_of_near_copies),
    ("decontamination", remove_benchmark),
    ("mixing", mix_sources),
    ("sharding", shuffle_into_shards),
]

#: Perplexities, alignments and random draws have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents of ``sf_dir``."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs, before = materialize(stage(spark, docs, sf_dir), name), docs
        release(before)
    return docs
