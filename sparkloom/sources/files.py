"""Files as rows: listings without content, handles, downloads and uploads."""

from __future__ import annotations

import os
import shutil
import tempfile
import urllib.parse
import urllib.request
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators.extract import file_kind


def from_glob(spark: SparkSession, pattern: str, recursive: bool = True) -> DataFrame:
    """path, size and modified of files; the content column is pruned, so no file is opened."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    return reader.load(pattern).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def from_files(spark: SparkSession, pattern: str) -> DataFrame:
    """One column file: a handle (path, size, modified) whose content is read when asked for."""
    return from_glob(spark, pattern).select(F.struct("path", "size", "modified").alias("file"))


def read_contents(spark: SparkSession, pattern: str) -> DataFrame:
    """path and content of files, by Spark's own reader, so any store that Spark reads will do."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(pattern).select("path", "content")


def knowledge_base(files: DataFrame) -> DataFrame:
    """Files and bytes by kind, from a listing."""
    return files.groupBy(file_kind(F.col("path")).alias("kind")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def _fetch(url: str | None, timeout: float) -> bytes | None:
    if url is None:
        return None
    with urllib.request.urlopen(url if "://" in url or url.startswith("file:") else "file://" + url, timeout=timeout) as r:
        return r.read()


def download(c: str | Column, on_error: str = "raise", max_connections: int = 32, timeout: float = 30.0) -> Column:
    """What URLs (http, https, file) hold, fetched concurrently in each task; failures are null or raise."""

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(url):
            try:
                return _fetch(url, timeout)
            except Exception:
                if on_error == "raise":
                    raise
                return None

        with ThreadPoolExecutor(max_connections) as pool:
            for s in batches:
                yield pd.Series(list(pool.map(one, [None if pd.isna(u) else u for u in s])), dtype=object)

    return run.asNondeterministic()(c)


def upload(content: str | Column, location: str, name: str | Column, max_connections: int = 32) -> Column:
    """Write bytes to ``location``/name and give the path; a retried task writes the same names again. Folders that tasks share only."""
    root = urllib.parse.urlparse(location).path if location.startswith("file:") else location

    @F.pandas_udf("string")
    def run(data: pd.Series, names: pd.Series) -> pd.Series:
        os.makedirs(root, exist_ok=True)

        def one(row):
            raw, n = row
            if raw is None or pd.isna(n):
                return None
            path = os.path.join(root, n)
            fd, part = tempfile.mkstemp(dir=root)
            with os.fdopen(fd, "wb") as f:
                f.write(raw)
            shutil.move(part, path)
            return path

        with ThreadPoolExecutor(max_connections) as pool:
            return pd.Series(list(pool.map(one, zip(data, names, strict=True))), dtype=object)

    return run.asNondeterministic()(content, name)


class FileHandle:
    """A handle inside a user function: open, read a range, or copy to a temporary file of the worker."""

    def __init__(self, path: str):
        self.path = urllib.parse.unquote(urllib.parse.urlparse(path).path) if path.startswith("file:") else path

    def open(self):
        return open(self.path, "rb")

    def read(self, size: int = -1, start: int = 0) -> bytes:
        with self.open() as f:
            f.seek(start)
            return f.read(size)

    def to_tempfile(self) -> str:
        fd, path = tempfile.mkstemp(suffix=os.path.splitext(self.path)[1])
        os.close(fd)
        shutil.copyfile(self.path, path)
        return path
