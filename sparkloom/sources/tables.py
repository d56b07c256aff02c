"""Readers and writers for tabular files, with options for remote stores and table formats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.utils import AnalysisException


def read_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*paths)


def read_csv(spark: SparkSession, path: str, schema: str | None = None, header: bool = True, recursive: bool = True) -> DataFrame:
    """CSV below a path; many small files share tasks (``spark.sql.files.maxPartitionBytes`` and ``openCostInBytes``). Give the schema in production."""
    reader = spark.read.option("header", header).option("recursiveFileLookup", recursive)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def read_json(spark: SparkSession, paths: str | Sequence[str], schema: str | None = None, fallback: DataFrame | None = None) -> DataFrame:
    """JSON lines from the first path that can be read, else ``fallback``; the last error if there is none."""
    error: Exception | None = None
    for path in [paths] if isinstance(paths, str) else paths:
        try:
            return (spark.read.schema(schema) if schema else spark.read).json(path)
        except AnalysisException as e:
            error = e
    if fallback is not None:
        return fallback
    raise error or ValueError("no path")


def read_format(spark: SparkSession, kind: str, target: str, **options: str) -> DataFrame:
    """A table format (iceberg, delta, hudi, lance) if its data source is on the class path; else an error that says so."""
    try:
        return spark.read.format(kind).options(**options).load(target)
    except Exception as e:
        if "DATA_SOURCE_NOT_FOUND" in str(e) or "ClassNotFound" in str(e) or "Failed to find" in str(e):
            raise RuntimeError(f"the data source {kind!r} is not on Spark's class path") from e
        raise


def write_format(df: DataFrame, kind: str, target: str, mode: str = "append", **options: str) -> None:
    try:
        df.write.format(kind).mode(mode).options(**options).save(target)
    except Exception as e:
        if "DATA_SOURCE_NOT_FOUND" in str(e) or "ClassNotFound" in str(e) or "Failed to find" in str(e):
            raise RuntimeError(f"the data source {kind!r} is not on Spark's class path") from e
        raise


def write_parquet(df: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Write, and return the paths of the files there now."""
    df.write.mode(mode).parquet(path)
    return written_files(df.sparkSession, path, "*.parquet")


def write_json(df: DataFrame, path: str, mode: str = "append") -> DataFrame:
    df.write.mode(mode).json(path)
    return written_files(df.sparkSession, path, "*.json")


def written_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "length")


def s3_conf(bucket: str | None = None, anonymous: bool = False, region: str | None = None, key_id: str | None = None, access_key: str | None = None, session_token: str | None = None, requester_pays: bool = False, max_connections: int | None = None) -> dict[str, str]:
    """Hadoop settings for S3, for one bucket or all."""
    prefix = f"spark.hadoop.fs.s3a.bucket.{bucket}." if bucket else "spark.hadoop.fs.s3a."
    provider = "org.apache.hadoop.fs.s3a.AnonymousAWSCredentialsProvider" if anonymous else ("org.apache.hadoop.fs.s3a.TemporaryAWSCredentialsProvider" if session_token else None)
    given = {
        "aws.credentials.provider": provider,
        "endpoint.region": region,
        "access.key": key_id,
        "secret.key": access_key,
        "session.token": session_token,
        "requester.pays.enabled": "true" if requester_pays else None,
        "connection.maximum": str(max_connections) if max_connections else None,
    }
    return {prefix + k: v for k, v in given.items() if v is not None}


def read_hub(spark: SparkSession, dataset: str, root: str, split: str | None = None) -> DataFrame:
    """A hub dataset from a mirror of its Parquet files: ``root``/``dataset``, of one split if given."""
    reader = spark.read.option("recursiveFileLookup", True)
    return (reader.option("pathGlobFilter", f"*{split}*.parquet") if split else reader.option("pathGlobFilter", "*.parquet")).parquet(f"{root.rstrip('/')}/{dataset}")
