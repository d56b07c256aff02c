"""Parquet tables with a manifest: appends, overwrites and upserts that show all at once or not at all, and cost what they change.

A table is a folder of data files and a log of manifests, one a version, each the full list of the files that make up that version with
their rows and the range of the key. A writer puts new files into the folder, where nobody sees them, and then makes the next manifest;
of two writers that make the same version one fails, and starts again from what the other left. Files of a failed or older version
stay until :func:`vacuum`.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from sparkloom.sources.pushdown import ParquetReader, enable_pushdown
from sparkloom.sources.stores import data_files, publish, store
from sparkloom.storage import materialize, release

FORMAT = "sparkloom_manifest"


class Conflict(RuntimeError):
    """Other writers were faster each time."""


@dataclass
class Part(WriterCommitMessage):
    """A data file, its path below the table's folder, and the least and greatest key as JSON values (None: unknown, or no keys)."""

    path: str
    rows: int
    low: object = None
    high: object = None

    def may_hold(self, low: object, high: object) -> bool:
        return self.low is None or (self.low <= high and low <= self.high)


@dataclass
class Manifest:
    version: int
    schema: str | None
    key: str | None
    parts: list[Part] = field(default_factory=list)


def _log(root: str, version: int) -> str:
    return f"{root.rstrip('/')}/log/{version:012d}.json"


def latest(root: str, version: int | None = None) -> Manifest:
    """The newest manifest, or that of a version; version 0 with no files where there is none."""
    fs, base = store(root)
    try:
        found = [p for p, _ in data_files(f"{root.rstrip('/')}/log", ".json")]
    except FileNotFoundError:
        found = []
    if version is not None:
        found = [p for p in found if p.endswith(f"/{version:012d}.json")]
        if not found:
            raise ValueError(f"no version {version} at {root}")
    if not found:
        return Manifest(0, None, None)
    with fs.open_input_file(found[-1]) as f:
        body = json.loads(f.read())
    return Manifest(body["version"], body["schema"], body["key"], [Part(**p) for p in body["parts"]])


def commit(root: str, base: Manifest, schema: str, key: str | None, parts: list[Part]) -> bool:
    """Make the version after ``base``, of these parts; False if another writer has made one."""
    body = {"version": base.version + 1, "schema": schema, "key": key, "parts": [vars(p) for p in parts]}
    return publish(_log(root, base.version + 1), json.dumps(body, ensure_ascii=False).encode())


def _json(x: pa.Scalar) -> object:
    v = x.as_py()
    return v if v is None or isinstance(v, int | str | float) else str(v)


class ManifestWriter(DataSourceArrowWriter):
    """A file a task, under a name of its own; a manifest when all are there."""

    def __init__(self, root: str, key: str | None, schema: StructType, overwrite: bool):
        self.root, self.key, self.overwrite, self.ddl = root, key, overwrite, schema.json()

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, base = store(self.root)
        fs.create_dir(f"{base}/data", recursive=True)
        path = f"data/{uuid.uuid4().hex}.parquet"
        rows, low, high, writer = 0, None, None, None
        try:
            for batch in iterator:
                writer = writer or pq.ParquetWriter(f"{base}/{path}", batch.schema, filesystem=fs, compression="zstd")
                writer.write_batch(batch, row_group_size=200_000)
                rows += batch.num_rows
                if self.key:
                    ends = pc.min_max(batch.column(self.key))
                    a, b = _json(ends["min"]), _json(ends["max"])
                    low, high = (a if low is None else low if a is None else min(low, a)), (b if high is None else high if b is None else max(high, b))
        except BaseException:
            if writer:
                writer.close()
                fs.delete_file(f"{base}/{path}")
            raise
        if writer:
            writer.close()
        return Part(path, rows, low, high)

    def commit(self, messages: list[Part | None]) -> None:
        new = [m for m in messages if m and m.rows]
        # Appends and overwrites hold whatever others have done meanwhile, so they may simply be tried on the version that is there then.
        for _ in range(100):
            now = latest(self.root)
            if now.schema and not self.overwrite and StructType.fromJson(json.loads(now.schema)).simpleString() != StructType.fromJson(json.loads(self.ddl)).simpleString():
                self.abort(messages)
                raise ValueError(f"the table has columns {StructType.fromJson(json.loads(now.schema)).simpleString()}")
            key = self.key or (None if self.overwrite else now.key)
            parts = new if self.overwrite else now.parts + ([Part(p.path, p.rows) for p in new] if key != self.key else new)
            if commit(self.root, now, self.ddl, key, parts):
                return
        self.abort(messages)
        raise Conflict(self.root)

    def abort(self, messages: list[Part | None]) -> None:
        fs, base = store(self.root)
        for m in messages:
            if m and m.rows:
                fs.delete_file(f"{base}/{m.path}")


class ManifestSource(DataSource):
    """``spark.read`` and ``df.write`` with ``format("sparkloom_manifest")``; options path, key (of the ranges) and version (to read)."""

    @classmethod
    def name(cls):
        return FORMAT

    def _now(self) -> Manifest:
        found = latest(self.options["path"], int(self.options["version"]) if "version" in self.options else None)
        if not found.schema:
            raise ValueError(f"no table at {self.options['path']}")
        return found

    def schema(self):
        return StructType.fromJson(json.loads(self._now().schema))

    def reader(self, schema):
        from pyspark.sql.pandas.types import to_arrow_schema

        fs, base = store(self.options["path"])
        now = self._now()
        parts = [f"{base}/{p.path}" for p in now.parts]
        found = pq.read_schema(parts[0], filesystem=fs).remove_metadata() if parts else to_arrow_schema(schema)
        return ParquetReader(parts, found, int(self.options.get("target_rows", 1_000_000)), self.options["path"])

    def writer(self, schema, overwrite):
        return ManifestWriter(self.options["path"], self.options.get("key"), schema, overwrite)


def register(spark: SparkSession) -> None:
    enable_pushdown(spark)
    spark.dataSource.register(ManifestSource)


def write(df: DataFrame, root: str, key: str | None = None, mode: str = "append") -> None:
    """Append to or overwrite a table, made if missing."""
    register(df.sparkSession)
    out = df.write.format(FORMAT).mode(mode).option("path", root)
    (out.option("key", key) if key else out).save()


def read(spark: SparkSession, root: str, version: int | None = None, between: tuple | None = None) -> DataFrame:
    """A version of a table, by Spark's own Parquet reader; ``between`` (low, high) of the key leaves out files that can't hold it, and only those."""
    now = latest(root, version)
    if not now.schema:
        raise ValueError(f"no table at {root}")
    parts = [p for p in now.parts if between is None or p.may_hold(*between)]
    return _read_parts(spark, root, now, parts)


def _read_parts(spark: SparkSession, root: str, now: Manifest, parts: list[Part]) -> DataFrame:
    schema = StructType.fromJson(json.loads(now.schema))
    if not parts:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{root.rstrip('/')}/{p.path}" for p in parts])


def newest(new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """One row per key: that with the greatest ``order``, then the greatest of all columns; null keys are keys like others here."""
    whole = F.struct((F.col(f"`{order}`") if order else F.lit(0)).alias("_first"), F.struct(*[F.col(f"`{c}`") for c in new.columns]).alias("_row"))
    rows = new.groupBy(*[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.max(whole).alias("_best"))
    return rows.select("_best._row.*")


def upsert(spark: SparkSession, root: str, new: DataFrame, keys: list[str], order: str | None = None, files: int | None = None, attempts: int = 5) -> dict[str, int]:
    """Replace the rows whose keys are in ``new`` and add the rest of ``new``; returns how many files were kept, rewritten and added.

    Of new rows with one key the newest wins (:func:`newest`). Null keys match nothing and are added. Only files that hold a key of ``new``
    are read beyond their key columns and written again, dealt by ranges of the first key so that ranges stay narrow; the others keep
    their names. If another writer commits first, the upsert starts again from that version.
    """
    has_keys = " and ".join(f"`{k}` is not null" for k in keys)
    new = materialize(newest(new.filter(has_keys), keys, order).unionByName(new.filter(f"not ({has_keys})")), "new")
    ends = new.agg(F.min(keys[0]).alias("low"), F.max(keys[0]).alias("high")).first()
    plain = lambda v: v if v is None or isinstance(v, int | str | float) else str(v)
    try:
        for _ in range(attempts):
            now = latest(root)
            schema = now.schema or new.schema.json()
            near = [p for p in now.parts if ends["low"] is not None and (now.key != keys[0] or p.may_hold(plain(ends["low"]), plain(ends["high"])))]
            hit: list[Part] = []
            rows = new
            if near:
                old = _read_parts(spark, root, now, near)
                file = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
                names = {r[0] for r in old.select(*keys, file.alias("_file")).join(new.select(keys), keys, "left_semi").select("_file").distinct().collect()}
                hit = [p for p in near if p.path.rpartition("/")[2] in names]
                if hit:
                    rows = _read_parts(spark, root, now, hit).join(new.select(keys), keys, "left_anti").select(new.columns).unionByName(new)
            added = _write_parts(rows, root, keys[0], files or max(1, len(hit)))
            kept = [p for p in now.parts if p not in hit]
            if now.key != keys[0]:
                kept = [Part(p.path, p.rows) for p in kept]
            if commit(root, now, schema, keys[0], kept + added):
                return {"kept": len(kept), "rewritten": len(hit), "added": len(added)}
            fs, base = store(root)
            for p in added:
                fs.delete_file(f"{base}/{p.path}")
        raise Conflict(root)
    finally:
        release(new)


def _write_parts(rows: DataFrame, root: str, key: str, files: int) -> list[Part]:
    """Write data files by Spark, dealt by ranges of the key, and take their statistics from the footers, on the executors."""
    folder = f"data/{uuid.uuid4().hex}"
    rows.repartitionByRange(files, F.col(key)).write.parquet(f"{root.rstrip('/')}/{folder}")
    written = rows.sparkSession.read.schema(rows.schema).parquet(f"{root.rstrip('/')}/{folder}")
    file = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    stats = written.groupBy(file.alias("file")).agg(F.count("*").alias("rows"), F.min(key).alias("low"), F.max(key).alias("high")).orderBy("low").collect()
    plain = lambda v: v if v is None or isinstance(v, int | str | float) else str(v)
    return [Part(f"{folder}/{r['file']}", r["rows"], plain(r["low"]), plain(r["high"])) for r in stats]


def vacuum(root: str, keep: int = 1) -> int:
    """Delete data files that none of the newest ``keep`` versions lists, and older manifests; returns how many data files. Not while others write."""
    fs, base = store(root)
    now = latest(root)
    first = max(1, now.version - keep + 1)
    used = {f"{base}/{p.path}" for v in range(first, now.version + 1) for p in latest(root, v).parts}
    dead = [p for p, _ in data_files(f"{root.rstrip('/')}/data", ".parquet") if p not in used]
    for p in dead:
        fs.delete_file(p)
    for v in range(1, first):
        if fs.get_file_info(store(_log(root, v))[1]).is_file:
            fs.delete_file(store(_log(root, v))[1])
    return len(dead)
