import gzip
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.sources import archives, custom


def record(k, body, kind="resource"):
    return f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{k}>\r\nWARC-Target-URI: u{k}\r\nX-K: {k}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


def body(r, n):
    return bytes(r.randrange(256) for _ in range(n))


@pytest.fixture(scope="module")
def archive(tmp_path_factory):
    """Members of all sizes, one with several records, some that hold an archive, compressed and as it is, and one of other bytes."""
    r, out, bodies = random.Random(5), b"", {}
    inner = b"".join(gzip.compress(record(900 + k, body(r, 40))) for k in range(900))
    for k in range(40):
        b = [body(r, r.choice([0, 10, 5000])), inner, b"WARC/1.0\r\nContent-Length: 5\r\n\r\n" * 20, inner[: 30_000 + k]][r.choice([0, 0, 0, 1, 2, 3])]
        bodies[str(k)] = b
        out += gzip.compress(record(k, b), r.choice([0, 6, 9]))
    out += gzip.compress(b"".join(record(k, b"x" * k) for k in range(40, 50)))
    bodies |= {str(k): b"x" * k for k in range(40, 50)}
    path = tmp_path_factory.mktemp("warc")
    (path / "a.warc.gz").write_bytes(out)
    return path, bodies


@pytest.mark.parametrize("split", [1 << 30, 150_000, 70_001])
def test_each_record_once_whatever_the_split(spark, archive, split):
    path, bodies = archive
    df = archives.read_archives(spark, f"file://{path}", split)
    rows = df.select("`WARC-Record-ID`", "warc_content").collect()
    assert len(rows) == len(bodies) and {r[0]: bytes(r[1]) for r in rows} == bodies
    if split < 1 << 20:
        assert df.rdd.getNumPartitions() > 3


@pytest.mark.parametrize("split", [997, 4096, 65_536, 123_457])
def test_ranges_cut_members_between_them(archive, split):
    path, _ = archive
    size = (path / "a.warc.gz").stat().st_size
    with open(path / "a.warc.gz", "rb") as f:
        whole = [(m.at, m.skip()) for m in archives.members(f, 0, size, size)]
        assert sum(n for _, n in whole) == size
        begins = range(0, size, split) if split > 10_000 else sorted({max(0, at + x) for at, _ in whole for x in (-3, -1, 0, 1)})
        cuts = [0, *[b for b in begins if b], size]
        assert [(m.at, m.skip()) for a, b in zip(cuts, cuts[1:], strict=False) if a < b for m in archives.members(f, a, b, size)] == whole


def test_index_and_single_members(spark, archive):
    path, bodies = archive
    index = archives.member_index(spark, f"file://{path}", 200_000)
    rows = sorted(index.collect())
    assert len(rows) == 41 and all(a["offset"] + a["length"] == b["offset"] for a, b in zip(rows, rows[1:], strict=False))
    some = index.filter(F.col("offset").isin(rows[7]["offset"], rows[40]["offset"]))
    got = archives.read_members(some, f"file://{path}").select("`WARC-Record-ID`", "warc_content").collect()
    assert {r[0]: bytes(r[1]) for r in got} == {k: bodies[k] for k in ["7", *map(str, range(40, 50))]}


def test_plain_and_empty_archives_and_kinds(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(record(1, b"WARC/1.0 no record", "response") + record(2, b"", "metadata"))
    (tmp_path / "b.warc.gz").write_bytes(b"")
    (tmp_path / "_hidden").write_bytes(b"?")
    assert custom.read_warc(spark, f"file://{tmp_path}").count() == 2
    (tmp_path / "x=1").mkdir()
    (tmp_path / "x=1" / "c.warc").write_bytes(record(3, b"c"))
    (tmp_path / ".d.warc").write_bytes(record(4, b"d"))
    assert custom.read_warc(spark, f"file://{tmp_path}").count() == 3
    assert custom.read_warc(spark, f"file://{tmp_path}/*.warc").count() == 2 and custom.read_warc(spark, f"file://{tmp_path}/**/[c].war?").count() == 1
    assert custom.read_warc(spark, [f"{tmp_path}/a.warc", f"{tmp_path}/x=1"]).count() == 3
    assert [r["WARC-Target-URI"] for r in custom.read_warc(spark, f"file://{tmp_path}", "warc").collect()] == ["u1"]


def test_a_writer_that_fails_leaves_nothing(spark, tmp_path):
    rows = spark.range(40, numPartitions=4).select(F.concat(F.lit("u"), "id").alias("uri"), F.lit("2024-01-01T00:00:00Z").alias("date"), F.lit("x").alias("content"))
    archives.write_archives(rows, f"file://{tmp_path}/w")
    assert archives.read_archives(spark, f"file://{tmp_path}/w").count() == 40

    @F.udf("string")
    def fails(u):
        if u == "u35":
            raise ValueError("half-way")
        return u

    with pytest.raises(Exception, match="half-way"):
        archives.write_archives(rows.withColumn("uri", fails("uri")), f"file://{tmp_path}/w")
    assert archives.read_archives(spark, f"file://{tmp_path}/w").count() == 40
