"""Compressed WARC archives read in many tasks a file, and written a file a task.

An archive of ordinary ``.warc.gz`` is a row of gzip members, mostly one a record. A task owns the members that begin in its byte range: it
looks for the first one there and reads on to the end of the last, one record at a time. Bytes that look like a member may lie inside one,
as in an archive within an archive, which is stored as it is in blocks of at most 65 535 bytes; so a first member counts only if whole
members with right checksums follow it for longer than two such blocks, or to the end of the file.
"""

from __future__ import annotations

import gzip
import io
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from sparkloom.sources.stores import data_files, store

MAGIC = b"\x1f\x8b\x08"
#: Longer than two stored blocks with their headers.
PROOF = 2 * 65_540
_CHUNK = 1 << 18


class Pages:
    """A file read by offset, the block read last kept, so that small members next to one another cost one read."""

    def __init__(self, f, size: int):
        self.f, self.size, self.begin, self.block = f, size, 0, b""

    def at(self, place: int, n: int) -> bytes:
        if not self.begin <= place < self.begin + len(self.block):
            self.f.seek(place)
            self.begin, self.block = place, self.f.read(_CHUNK)
        return self.block[place - self.begin : place - self.begin + n]


class Member(io.RawIOBase):
    """The content of the gzip member at an offset, decompressed as it is read; ``length`` when it is at its end."""

    def __init__(self, pages: Pages, at: int):
        self.pages, self.at, self.fed, self.length = pages, at, 0, None
        self.inflate, self.left, self.step = zlib.decompressobj(31), b"", 512

    def readable(self) -> bool:
        return True

    def readinto(self, b) -> int:
        while not self.inflate.eof:
            if not self.left:
                self.left = self.pages.at(self.at + self.fed, self.step)
                self.fed, self.step = self.fed + len(self.left), min(2 * self.step, _CHUNK)
                if not self.left:
                    raise EOFError(f"the member at {self.at} ends with the file")
            out = self.inflate.decompress(self.left, len(b))
            self.left = self.inflate.unconsumed_tail
            if out:
                b[: len(out)] = out
                return len(out)
        self.length = self.fed - len(self.inflate.unused_data)
        return 0

    def skip(self) -> int:
        """Read to the end, and return the member's length."""
        block = bytearray(1 << 16)
        while self.readinto(block):
            pass
        return self.length


def is_member(pages: Pages, at: int) -> bool:
    """Whether an archive's member begins at an offset, by what it says first and by the members after it."""
    try:
        head = bytearray(5)
        if Member(pages, at).readinto(head) != 5 or head != b"WARC/":
            return False
        place = at
        while place < pages.size and place - at <= PROOF:
            place += Member(pages, place).skip()
        return True
    except (zlib.error, EOFError):
        return False


def first_member(pages: Pages, begin: int, end: int) -> int | None:
    """The offset of the first member that begins in [begin, end)."""
    place = begin
    while place < end:
        data = pages.at(place, _CHUNK)
        if len(data) < 3 and place + len(data) < pages.size:
            data += pages.at(place + len(data), _CHUNK)
        k = data.find(MAGIC)
        if k < 0:
            if place + len(data) >= pages.size:
                return None
            place += len(data) - 2
        elif place + k >= end:
            return None
        elif is_member(pages, place + k):
            return place + k
        else:
            place += k + 1
    return None


def members(f, begin: int, end: int, size: int) -> Iterator[Member]:
    """The members that begin in [begin, end); each is read to its end before the next one."""
    pages = Pages(f, size)
    at = 0 if begin == 0 else first_member(pages, begin, end)
    while at is not None and at < end:
        one = Member(pages, at)
        yield one
        at += one.length if one.length is not None else one.skip()


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of the records of a stream, cut by Content-Length."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        head: dict[str, str] = {}
        while (line := stream.readline()) and line.strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.strip()] = value.strip()
        yield head, stream.read(int(head.pop("Content-Length", "0")))


class _Plain(io.RawIOBase):
    """A file of pyarrow as Python's own readers take it."""

    def __init__(self, f):
        self.f = f

    def readable(self) -> bool:
        return True

    def readinto(self, b) -> int:
        data = self.f.read(len(b))
        b[: len(data)] = data
        return len(data)


@dataclass
class Range(InputPartition):
    path: str
    begin: int
    end: int
    size: int


class ArchiveReader(DataSourceReader):
    def __init__(self, paths: list[str], split_bytes: int, index: bool):
        self.paths, self.path, self.split_bytes, self.index = paths, paths[0], split_bytes, index

    def partitions(self) -> list[Range]:
        fs, _ = store(self.path)
        out = []
        for path, size in (x for p in self.paths for x in data_files(p)):
            with fs.open_input_file(path) as f:
                packed = f.read(3) == MAGIC
            # Nothing in a plain archive tells a record's begin from the same words in a page, so it stays whole.
            step = self.split_bytes if packed else max(size, 1)
            out += [Range(path, k, min(size, k + step), size) for k in range(0, size, step)]
        return out or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, _ = store(self.path)
        with fs.open_input_file(partition.path) as f:
            if self.index:
                rows = [(partition.path, m.at, m.skip()) for m in members(f, partition.begin, partition.end, partition.size)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else ([], [], []), (pa.string(), pa.int64(), pa.int64()), strict=True)], ["file", "offset", "length"])
            else:
                yield from _batches(r for stream in self._streams(f, partition) for r in records(stream))

    def _streams(self, f, partition: Range) -> Iterator[io.BufferedReader]:
        f.seek(partition.begin)
        if partition.begin == 0 and f.read(3) != MAGIC:
            f.seek(0)
            yield io.BufferedReader(_Plain(f), _CHUNK)
            return
        for m in members(f, partition.begin, partition.end, partition.size):
            yield io.BufferedReader(m, _CHUNK)


_NAMED = ("WARC-Record-ID", "WARC-Target-URI", "WARC-Type", "WARC-Date", "WARC-Identified-Payload-Type")
SCHEMA = ", ".join(f"`{n}` string" for n in _NAMED) + ", warc_content binary, warc_headers string"
INDEX = "file string, offset long, length long"


def row_of(head: dict[str, str], block: bytes) -> tuple:
    """Named fields, block, and all other fields as JSON."""
    named = [head.pop(n, None) for n in _NAMED]
    if named[0]:
        named[0] = named[0].removeprefix("<urn:uuid:").removesuffix(">")
    return (*named, block, json.dumps(head, sort_keys=True))


def _batches(found: Iterator[tuple[dict[str, str], bytes]], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for head, block in found:
        rows.append(row_of(head, block))
        size += len(block)
        if size >= most or len(rows) >= 1000:
            yield _batch(rows)
            rows, size = [], 0
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string()] * 5 + [pa.binary(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [*_NAMED, "warc_content", "warc_headers"])


@dataclass
class Written(WriterCommitMessage):
    path: str


class ArchiveWriter(DataSourceArrowWriter):
    """Resource records of rows (uri, date, content), each a gzip member; files are moved to their names when all tasks are done."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, base = store(self.path)
        fs.create_dir(f"{base}/_staged", recursive=True)
        name = f"{uuid.uuid4().hex}.warc.gz"
        any_rows = False
        with fs.open_output_stream(f"{base}/_staged/{name}", compression=None) as f:
            for batch in iterator:
                for uri, date, content in zip(*(batch.column(c).to_pylist() for c in ("uri", "date", "content")), strict=True):
                    content, any_rows = content or b"", True
                    head = f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {date}\r\nWARC-Target-URI: {uri}\r\nContent-Type: text/html\r\nContent-Length: {len(content)}\r\n\r\n"
                    f.write(gzip.compress(head.encode() + content + b"\r\n\r\n", 6, mtime=0))
        if not any_rows:
            fs.delete_file(f"{base}/_staged/{name}")
        return Written(name if any_rows else "")

    def commit(self, messages: list[Written | None]) -> None:
        fs, base = store(self.path)
        for m in messages:
            if m and m.path:
                fs.move(f"{base}/_staged/{m.path}", f"{base}/{m.path}")

    def abort(self, messages: list[Written | None]) -> None:
        fs, base = store(self.path)
        for m in messages:
            if m and m.path:
                fs.delete_file(f"{base}/_staged/{m.path}")


class ArchiveSource(DataSource):
    """Options: path; split_bytes; index (true: where members are, instead of records)."""

    @classmethod
    def name(cls):
        return "sparkloom_warc"

    def schema(self):
        return INDEX if self.options.get("index") == "true" else SCHEMA

    def reader(self, schema):
        paths = self.options["path"]
        return ArchiveReader(json.loads(paths) if paths.startswith("[") else [paths], int(self.options.get("split_bytes", 64 << 20)), self.options.get("index") == "true")

    def writer(self, schema: StructType, overwrite: bool):
        return ArchiveWriter(self.options["path"])


def read_archives(spark: SparkSession, path: str | list[str], split_bytes: int = 64 << 20) -> DataFrame:
    """The records of the archives at a path, a pattern or a list of these on one file system, each once whatever the split size.

    A file whose first bytes are no gzip is one task's.
    """
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("sparkloom_warc").options(path=path if isinstance(path, str) else json.dumps(path), split_bytes=str(split_bytes)).load()


def member_index(spark: SparkSession, path: str, split_bytes: int = 64 << 20) -> DataFrame:
    """(file, offset, length) of every member, found by as many tasks."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("sparkloom_warc").options(path=path, split_bytes=str(split_bytes), index="true").load()


def read_members(index: DataFrame, path: str) -> DataFrame:
    """The records of some members of an index; only their bytes are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = store(path)
        for batch in batches:
            for file, offset in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_file(file) as f:
                    yield from _batches(records(io.BufferedReader(Member(Pages(f, f.size()), offset))))

    return index.select("file", "offset").mapInArrow(run, SCHEMA)


def write_archives(df: DataFrame, path: str) -> None:
    """Rows (uri, date, content) as archives of one resource record a gzip member, a file a task; nothing shows before all are done."""
    df.sparkSession.dataSource.register(ArchiveSource)
    shown = df.select(F.col("uri").cast("string").alias("uri"), F.col("date").cast("string").alias("date"), F.col("content").cast("binary").alias("content"))
    shown.write.format("sparkloom_warc").mode("append").option("path", path).save()
