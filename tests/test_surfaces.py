import asyncio
import gzip
import sqlite3
from collections.abc import Iterator
from dataclasses import dataclass
from typing import TypedDict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import ai
from sparkloom.plans import udf
from sparkloom.plans.catalog import Workspace
from sparkloom.session import scoped_conf, sql
from sparkloom.sources import custom, files, tables
from sparkloom.streaming import events as stream

EVENTS = "/root/testdata/sf0.001/events.parquet"


class Point(TypedDict):
    x: float
    name: str


@dataclass
class Pair:
    a: int
    b: list[int]


class Counter:
    made = 0

    def __init__(self, start: int):
        self.start = start

    def __call__(self, x: int) -> int:
        return x + self.start

    def point(self, x: int) -> Point:
        return {"x": float(x), "name": f"p{x}"}


def test_row_batch_async_class_and_generator_functions(spark):
    df = spark.range(5).withColumn("t", F.concat(F.lit("t"), "id"))

    @udf.func
    def add(x: int, y: int = 1) -> int:
        return x + y

    @udf.func
    async def wait(x: int) -> int:
        return x * 10

    @udf.func(return_dtype="long", on_error="null")
    def fails(x):
        return 1 // (x % 2)

    @udf.func
    def pair(x: int) -> Pair:
        return Pair(x, [x, x])

    @udf.batch(return_dtype="double", batch_size=2)
    def scale(s: pd.Series, by: float) -> pd.Series:
        return s * by

    @udf.generator(return_dtype="place int, letter string")
    def letters(t: str) -> Iterator:
        for i, c in enumerate(t):
            if c != "t":
                yield i, c

    c = F.col("id")
    got = df.select(add(c, 5), add(c), wait(c), fails(c), pair(c)["b"], scale(c, 0.5), udf.Remote(Counter, 100)(c), udf.Remote(Counter, 1).method("point")(c)["name"]).collect()
    assert tuple(got[3]) == (8, 4, 30, 1, [3, 3], 1.5, 103, "p3") and got[2][3] is None
    assert [tuple(r) for r in letters(df, "t").filter("id = 2").collect()] == [(2, "t2", 1, "2")]
    with pytest.raises(Exception, match="ZeroDivision"):
        df.select(udf.func(lambda x: 1 // 0, return_dtype="long")(c)).collect()
    z = [r["z"] for r in udf.z_score(df, "id").orderBy("id").collect()]
    assert z[0] == pytest.approx(-(2**0.5)) and sum(z) == pytest.approx(0)


class Client:
    """A class with every form of method."""

    def __init__(self, base: int = 0):
        self.base, self.running, self.most = base, 0, 0

    async def later(self, x: int) -> int:
        self.running += 1
        self.most = max(self.most, self.running)
        await asyncio.sleep(0.01)
        self.running -= 1
        if x == 3:
            raise ValueError("three")
        return self.base + x

    async def peak(self, x: int) -> int:
        await self.later(0)
        return self.most

    @udf.batch_method(return_dtype="long", batch_size=2)
    def add(self, s: pd.Series, by: int) -> pd.Series:
        assert len(s) <= 2
        return s + self.base + by


class OldStyle:
    def __init__(self, by: int = 2):
        self.by = by

    def __call__(self, s):
        return [x * self.by for x in s]


def test_methods_of_every_form_and_the_older_ones(spark):
    df = spark.range(6).coalesce(1)
    c, client = F.col("id"), udf.Remote(Client).with_init_args(10)
    got = df.select(client.method("later", on_error="log")(c), client.method("add")(c, 5)).collect()
    assert [tuple(r) for r in got] == [(None if k == 3 else 10 + k, 15 + k) for k in range(6)]
    with pytest.raises(Exception, match="three"):
        df.select(client.method("later")(c)).collect()
    assert max(r[0] for r in df.select(udf.Remote(Client, 77).with_concurrency(2).method("peak")(c)).collect()) <= 2
    twice = udf.legacy_udf(return_dtype="long")(lambda s: [x * 2 for x in s])
    old = udf.legacy_udf(return_dtype="long", batch_size=3)(OldStyle)
    assert [tuple(r) for r in df.select(twice(c), old()(c), old(by=5)(c)).collect()] == [(2 * k, 2 * k, 5 * k) for k in range(6)]


def test_images_and_generation(spark):
    df = spark.createDataFrame([(b"abc", "Q one"), (None, None)], "b binary, q string")
    got = df.select(ai.classify_image("b", ["cat", "dog"], "offline"), ai.llm_generate("q", model="any", provider="offline", extra_body={"guided_choice": ["A", "B"]}), ai.llm_generate("q", provider="offline")).collect()
    assert got[0][0] in ("cat", "dog") and got[0][1] in ("A", "B") and got[0][2] == "answer: Q one" and tuple(got[1]) == (None, None, None)


def test_model_calls(spark):
    df = spark.createDataFrame([("good news",), (None,)], "t string")
    calls = df.select(ai.prompt("t", "Say"), ai.prompt(["t", "t"], return_format=Point)["name"], ai.embed_text("t"), ai.classify_text("t", ["news", "law"]), ai.classify_text("t", ["news", "law"], multi_label=True)).collect()
    assert calls[0][0] == "Say: good news" and calls[0][1] == "good news good news" and len(calls[0][2]) == 64 and calls[0][3] == "news" and calls[0][4] == ["news"]
    assert all(x is None for x in calls[1])

    class Loud(ai.OfflineProvider):
        def prompt(self, messages, system=None, **options):
            if messages[0] == "bad":
                raise ValueError("bad")
            return messages[0].upper()

    registry = ai.PROVIDERS
    registry.attach("loud", Loud())
    with registry.using("loud"):
        assert registry.current() == "loud" and df.select(ai.prompt("t")).first()[0] == "GOOD NEWS"
    assert registry.current() == "offline" and registry.has("loud")
    bad = spark.createDataFrame([("bad",)], "t string")
    assert bad.select(ai.prompt("t", provider="loud", on_error="null")).first()[0] is None
    with pytest.raises(Exception, match="bad"):
        bad.select(ai.prompt("t", provider="loud")).collect()
    registry.detach("loud")
    assert ai.struct_type(Pair).simpleString() == "struct<a:bigint,b:array<bigint>>"


def test_catalog(spark):
    w = Workspace(spark)
    w.create_namespace("ns1", if_not_exists=True)
    with w.namespace("ns1"):
        assert w.current_namespace() == "ns1"
        w.create_table("t", spark.range(3))
        w.write_table("t", spark.range(2))
        assert w.read_table("t").count() == 5 and w.has_table("t") and w.list_tables("t*") == ["t"]
        w.write_table("t", w.read_table("t").filter("id = 0"), "overwrite")
        assert w.read_table("t").count() == 2
        w.drop_table("t")
        assert not w.has_table("t")
    assert w.current_namespace() == "default" and "ns1" in w.list_namespaces("ns*")
    w.drop_namespace("ns1", cascade=True)
    assert not w.has_namespace("ns1")
    w.attach_catalog("shop", {"users": spark.createDataFrame([(1, "a")], "id int, name string")})
    w.create_temp_table("orders", spark.createDataFrame([(7, 1)], "oid int, id int"))
    assert [tuple(r) for r in w.sql("select oid, name from orders join users using (id)").collect()] == [(7, "a")]
    assert w.has_table("users") and w.read_table("shop.users").count() == 1 and w.list_catalogs() == ["shop"]
    w.detach_table("orders")
    w.detach_catalog("shop")
    assert not w.has_catalog("shop") and not w.has_table("orders")
    assert sql(spark, "select count(*) as n from {x}", x=spark.range(4)).first()["n"] == 4
    before = spark.conf.get("spark.sql.shuffle.partitions")
    with pytest.raises(ZeroDivisionError), scoped_conf(spark, spark__sql__shuffle__partitions=3):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "3"
        raise ZeroDivisionError
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


def test_tables(spark, tmp_path):
    root = f"file://{tmp_path}"
    df = spark.createDataFrame([(1, "a"), (2, None)], "i int, s string")
    assert tables.write_parquet(df, f"{root}/p").count() >= 1 and tables.read_parquet(spark, f"{root}/p").count() == 2
    tables.write_json(df, f"{root}/j")
    assert sorted(map(tuple, tables.read_json(spark, [f"{root}/none", f"{root}/j"], "i int, s string").collect()), key=repr) == [(1, "a"), (2, None)]
    assert tables.read_json(spark, f"{root}/none", fallback=df).count() == 2
    df.write.option("header", True).csv(f"{root}/c/deep")
    assert tables.read_csv(spark, f"{root}/c").count() == 2
    with pytest.raises(RuntimeError, match="class path"):
        tables.read_format(spark, "iceberg", "x")
    conf = tables.s3_conf("b", anonymous=True, max_connections=9)
    assert conf["spark.hadoop.fs.s3a.bucket.b.connection.maximum"] == "9"


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.py").write_bytes(b"x = 1")
    (tmp_path / "in/b.txt").write_bytes(b"hello")
    listed = files.from_glob(spark, f"file://{tmp_path}/in")
    assert sorted((r["path"].rsplit("/")[-1], r["size"]) for r in listed.collect()) == [("a.py", 5), ("b.txt", 5)]
    assert {r["kind"]: r["files"] for r in files.knowledge_base(listed).collect()} == {"code": 1, "doc": 1}
    assert files.from_files(spark, f"file://{tmp_path}/in").select("file.size").count() == 2
    got = listed.withColumn("raw", files.download("path")).withColumn("to", files.upload("raw", f"{tmp_path}/out", F.element_at(F.split("path", "/"), -1)))
    assert {open(r["to"], "rb").read() for r in got.select("to").collect()} == {b"x = 1", b"hello"}
    missing = spark.createDataFrame([("file:///no/such",), (None,)], "u string")
    assert [r[0] for r in missing.select(files.download("u", on_error="null")).collect()] == [None, None]
    handle = files.FileHandle(f"file://{tmp_path}/in/b.txt")
    assert handle.read(3, 1) == b"ell" and open(handle.to_tempfile(), "rb").read() == b"hello"


def test_custom_sources(spark, tmp_path):
    records = b"".join(
        b"WARC/1.0\r\nWARC-Type: %s\r\nWARC-Record-ID: <urn:uuid:%d>\r\nX-Other: y\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (kind, i, len(body), body)
        for i, (kind, body) in enumerate([(b"response", b"a\r\n\r\nWARC/1.0\r\nb"), (b"conversion", b""), (b"metadata", "é".encode())])
    )
    (tmp_path / "w").mkdir()
    (tmp_path / "w/a.warc").write_bytes(records)
    half = records.index(b"WARC/1.0\r\nWARC-Type: conversion")
    (tmp_path / "w/b.warc.gz").write_bytes(gzip.compress(records[:half]) + gzip.compress(records[half:]))
    got = custom.read_warc(spark, f"file://{tmp_path}/w").collect()
    assert len(got) == 6 and {bytes(r["warc_content"]) for r in got if r["WARC-Record-ID"] == "0"} == {b"a\r\n\r\nWARC/1.0\r\nb"}
    assert got[0]["warc_headers"] == '{"X-Other": "y"}' and custom.read_warc(spark, f"file://{tmp_path}/w", "wet").count() == 2

    path = str(tmp_path / "db")
    with sqlite3.connect(path) as con:
        con.execute("create table t (i integer, s text)")
        con.executemany("insert into t values (?, ?)", [(i, None if i == 3 else f"s{i}") for i in range(10)])
    for kw in ({}, {"slices": 3, "slice_by": "i"}):
        out = custom.read_sql(spark, "select i, s from t where i < 8", lambda: sqlite3.connect(path), "i long, s string", **kw)
        assert out.count() == 8 and out.filter("s is null").count() == 1
    assert custom.read_pages(spark, lambda k: [{"k": k, "v": "x"}] * k, 4, "k int, v string").count() == 6

    def decode(p):
        for i in range(10):
            yield i / 10, np.full((4, 6, 3), i, dtype=np.uint8)

    frames = custom.video_frames(spark, ["a", "b"], 2, 3, decode, 0.25).orderBy("path", "frame_index").collect()
    assert [r["frame_index"] for r in frames if r["path"] == "a"] == [0, 3, 5, 8] and frames[1]["image"]["data"] == bytes([3] * 18)

    vectors = spark.createDataFrame([(1, [1.0], "x"), (2, [2.0], "y")], "doc int, v array<float>, a string")
    custom.write_vectors(vectors, f"file://{tmp_path}/v", "doc", "v")
    custom.write_vectors(vectors.filter("doc = 2").withColumn("a", F.lit("z")), f"file://{tmp_path}/v", "doc", "v")
    assert sorted((r["id"], r["a"]) for r in spark.read.parquet(f"file://{tmp_path}/v").collect()) == [(1, "x"), (2, "z")]


def test_streams_equal_batches(spark, tmp_path):
    batch = spark.read.parquet(EVENTS)
    root = f"{tmp_path}/in"
    batch.orderBy("ts").repartitionByRange(4, "ts").write.parquet(root)
    rows = stream.read_events(spark, root, batch.schema, files_per_trigger=10)
    for k, make in enumerate((lambda e: stream.windowed_totals(e, "1 day"), lambda e: stream.sessions(e, "6 hours"), lambda e: stream.distinct_events(e, ["event_id"], "1000 days").select("event_id"))):
        mode = "append" if k == 2 else "complete"
        q = make(rows).writeStream.outputMode(mode).format("memory").queryName(f"out{k}").trigger(availableNow=True).start()
        q.awaitTermination(60)
        got, want = spark.table(f"out{k}"), make(batch)
        round_ = lambda d: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in d.collect())
        assert round_(got) == round_(want)
    q = stream.upsert_stream(rows.select("user_id", "event_id"), f"{tmp_path}/t", ["user_id"], f"{tmp_path}/c")
    q.awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/t").count() == batch.select("user_id").distinct().count()


def test_frames(spark):
    from sparkloom.plans import frames

    df = frames.materialized(spark.createDataFrame([(1, "abcdef" * 20), (2, None)], "i int, s string"))
    assert frames.to_pydict(df)["i"] == [1, 2] and "abc" in frames.show_text(df) and "InMemory" in frames.explain_text(df)
    with pytest.raises(ValueError, match="more than 1"):
        frames.to_pydict(df, 1)
    df.unpersist()
    assert frames.num_partitions(spark.range(10).repartition(3)) == 3 and 0 < frames.sample_fraction(spark.range(1000), 0.3).count() < 600


def test_listings_and_ids(spark, tmp_path):
    from sparkloom.functions import media
    from sparkloom.operators.relational import with_stable_id

    listing = spark.createDataFrame([(f"crawl/segments/{s}/{k}/f{i}.gz",) for s in (1, 2) for k in ("warc", "wet") for i in range(3)], "value string")
    assert custom.crawl_paths(listing, "text", "2", 2, "s3://b/") == ["s3://b/crawl/segments/2/wet/f0.gz", "s3://b/crawl/segments/2/wet/f1.gz"]
    spark.range(3).write.parquet(f"{tmp_path}/org/name/train")
    assert tables.read_hub(spark, "org/name", str(tmp_path)).count() == 3
    a, b = (with_stable_id(spark.range(9).repartition(n), "id", name="h") for n in (1, 4))
    assert {tuple(r) for r in a.collect()} == {tuple(r) for r in b.collect()}
    frames = spark.createDataFrame([("a", 0, [0.0]), ("a", 1, [0.1]), ("a", 2, [5.0]), ("b", 7, [1.0])], "path string, frame_index int, embedding array<double>")
    assert sorted((r["path"], r["frame_index"]) for r in media.keyframes(frames, 1.0).collect()) == [("a", 0), ("a", 2), ("b", 7)]
