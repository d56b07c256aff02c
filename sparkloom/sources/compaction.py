"""Many small Parquet files packed into few of a target size, rows in the same order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.sources.stores import data_files


def plan(files: list[tuple[str, int]], target_bytes: int) -> list[tuple[str, int, int]]:
    """(path, number of the file in the list, bin): files in the order given, next to one another until a bin is full. A larger file is a bin of its own."""
    out, bin_, size = [], 0, 0
    for k, (path, n) in enumerate(files):
        if size and size + n > target_bytes:
            bin_, size = bin_ + 1, 0
        out.append((path, k, bin_))
        size += n
    return out


def compact(spark: SparkSession, source: str, target: str, target_bytes: int = 128 << 20, partition_columns: list[str] | None = None) -> dict[str, int]:
    """Write the table at ``source`` to ``target`` as files of about ``target_bytes``, and return how many files there were and are.

    The list of files and the bins are made on the driver, a row a file; rows are read once, dealt to their bins and sorted by file and place in
    it. With ``partition_columns`` (those of the source's folders) files are packed within a folder only. Empty files go.
    """
    files = data_files(source, ".parquet")
    folders: dict[str, list[tuple[str, int]]] = {}
    for path, size in files:
        folders.setdefault(path.rpartition("/")[0] if partition_columns else "", []).append((path, size))
    rows, begin = [], 0
    for some in folders.values():
        planned = plan(some, target_bytes)
        rows += [(path, len(rows) + k, begin + b) for k, (path, _, b) in enumerate(planned)]
        begin += planned[-1][2] + 1
    if not rows:
        raise ValueError(f"no Parquet files at {source}")
    bins = spark.createDataFrame(rows, "_file string, _place long, _bin int")
    df = spark.read.option("basePath", source).parquet(source)
    names = df.columns
    path = F.regexp_replace(F.col("_metadata.file_path"), "^[a-z]+:/+", "/")
    at = df.select("*", path.alias("_path"), F.col("_metadata.row_index").alias("_row"))
    at = at.join(bins, F.col("_path") == F.col("_file")).drop("_file", "_path")
    # Sorted by the folders first, as the writer would else sort by them alone.
    folder = [*(partition_columns or []), "_bin"]
    dealt = at.repartition(begin, "_bin").sortWithinPartitions(*folder, "_place", "_row")
    dealt.select(*names, "_bin").write.partitionBy(*folder).parquet(target)
    return {"before": len(files), "after": len(data_files(target, ".parquet"))}


def read_compacted(spark: SparkSession, path: str) -> DataFrame:
    """The table that :func:`compact` has written, without the bins' folders as a column."""
    return spark.read.parquet(path).drop("_bin")
