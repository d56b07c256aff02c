"""Python data sources: WARC archives, DB-API queries, paged APIs, synthetic video frames, and a vector store sink."""

from __future__ import annotations

import gzip
import io
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sparkloom.sources import archives

def parse_warc(raw: bytes) -> Iterator[tuple]:
    """Records of an archive, compressed or not: named fields, block, and all other fields as JSON. Blocks are cut by Content-Length.

    A compressed archive is read as a stream of its members, so that one record at a time is in memory besides ``raw``.
    """
    stream = io.BytesIO(raw)
    if raw[:2] == b"\x1f\x8b":
        stream = io.BufferedReader(gzip.GzipFile(fileobj=stream), 1 << 20)
    yield from (archives.row_of(head, block) for head, block in archives.records(stream))


def read_warc(spark: SparkSession, path: str | list[str], content: str = "raw", split_bytes: int = 64 << 20) -> DataFrame:
    """Records of the archives at a path, compressed ones by many tasks a file. content: raw (all), wet (conversion), wat (metadata) or warc (response)."""
    kinds = {"wet": "conversion", "wat": "metadata", "warc": "response"}
    out = archives.read_archives(spark, path, split_bytes)
    return out.filter(F.col("`WARC-Type`") == kinds[content]) if content in kinds else out


#: Other names by which the three kinds of crawl archives are asked for.
CRAWL_KINDS = {"warc": "warc", "raw": "warc", "wet": "wet", "text": "wet", "wat": "wat", "metadata": "wat"}


def crawl_paths(listing: DataFrame, content: str = "warc", segment: str | None = None, num_files: int | None = None, prefix: str = "") -> list[str]:
    """Archive paths from a crawl's path listing (one a line, column value), of one kind and segment, the first ``num_files`` by name."""
    kind = CRAWL_KINDS[content]
    rows = listing.filter(F.col("value").contains(f"/{kind}/"))
    if segment:
        rows = rows.filter(F.col("value").contains(f"/{segment}/"))
    rows = rows.orderBy("value")
    return [prefix + r["value"] for r in (rows.limit(num_files) if num_files else rows).collect()]


class _Slices(DataSourceReader):
    def __init__(self, make: Callable[[int], Iterator[pa.RecordBatch]], count: int):
        self.make, self.count = make, count

    def partitions(self):
        return [InputPartition(k) for k in range(self.count)]

    def read(self, partition):
        yield from self.make(partition.value)


def read_sql(spark: SparkSession, query: str, connect: Callable, schema: str, slices: int = 1, slice_by: str | None = None) -> DataFrame:
    """A DB-API query. ``connect`` opens a connection in each task; with ``slice_by`` (an integer expression) slices are read in parallel."""
    arrow = _arrow(spark, schema)

    def make(k: int) -> Iterator[pa.RecordBatch]:
        mine = f"abs({slice_by}) % {slices} = {k}" + (f" or {slice_by} is null" if k == 0 else "")
        text = f"select * from ({query}) q" + (f" where {mine}" if slice_by else "")
        con = connect()
        try:
            cursor = con.cursor()
            cursor.execute(text)
            while rows := cursor.fetchmany(10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)
        finally:
            con.close()

    return _source(spark, "sparkloom_sql", schema, lambda: _Slices(make, slices if slice_by else 1))


def read_pages(spark: SparkSession, fetch: Callable[[int], list[dict]], pages: int, schema: str) -> DataFrame:
    """A paged source: ``fetch(k)`` gives the k-th page's rows; a task per page."""
    arrow = _arrow(spark, schema)

    def make(k: int) -> Iterator[pa.RecordBatch]:
        rows = fetch(k)
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return _source(spark, "sparkloom_pages", schema, lambda: _Slices(make, pages))


def video_frames(spark: SparkSession, paths: list[str], height: int, width: int, decode: Callable, sample_interval_seconds: float | None = None) -> DataFrame:
    """path, frame_index, frame_time and image of frames; ``decode(path)`` yields (time, array height x width x channels), as no decoder is built in."""
    from sparkloom.functions.media import IMAGE, _row

    schema = f"path string, frame_index int, frame_time double, image {IMAGE}"
    arrow = _arrow(spark, schema)

    def make(k: int) -> Iterator[pa.RecordBatch]:
        due = 0.0
        for i, (t, a) in enumerate(decode(paths[k])):
            if sample_interval_seconds is not None:
                if t + 1e-9 < due:
                    continue
                due += sample_interval_seconds
            rows = [int((j + 0.5) * a.shape[0] / height) for j in range(height)]
            columns = [int((j + 0.5) * a.shape[1] / width) for j in range(width)]
            small = a[rows][:, columns]
            yield pa.RecordBatch.from_pylist([{"path": paths[k], "frame_index": i, "frame_time": t, "image": _row(small)}], schema=arrow)

    return _source(spark, "sparkloom_frames", schema, lambda: _Slices(make, len(paths)))


def _arrow(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def _source(spark: SparkSession, label: str, ddl: str, make: Callable[[], DataSourceReader]) -> DataFrame:
    class Source(DataSource):
        @classmethod
        def name(cls):
            return label

        def schema(self):
            return ddl

        def reader(self, schema):
            return make()

    spark.dataSource.register(Source)
    return spark.read.format(label).load()


def write_vectors(df: DataFrame, path: str, id_column: str, vector_column: str, mode: str = "append") -> None:
    """A vector store as a Parquet table: ids, vectors and attributes; rows whose id is there already are replaced."""
    from sparkloom.operators.upsert import replace_table, upsert_path

    out = df.withColumnsRenamed({id_column: "id", vector_column: "vector"})
    if mode == "overwrite":
        replace_table(out, path)
    else:
        upsert_path(df.sparkSession, path, out, ["id"])


def iso_seconds(c: Column) -> Column:
    """A WARC date as a timestamp."""
    return F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ssX"))
