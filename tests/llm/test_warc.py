import base64
import datetime
import gzip
import hashlib
from pathlib import Path

from sparkloom.llm import warc
from sparkloom.llm.queries import QUERIES


def expected(pages, least=0):
    """Of equal payloads one row with the largest page_id (null below all others) is the response."""
    last, out, told = {}, [], set()
    rank = lambda i: (i is not None, i or 0)
    for i, h in pages:
        b = (h or "").encode()
        last[b] = max(i, last.get(b, i), key=rank)
    for i, h in pages:
        b = (h or "").encode()
        first = last[b] == i and b not in told
        if first:
            told.add(b)
        again = len(b) >= least and not first
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", last[b] if again else None))
    return sorted(map(str, out))


def plain(rows):
    return sorted(str(tuple(r)) for r in rows)


def test_query_round_trip(spark):
    d = "/root/testdata/sf0.01"
    pages = [(r["page_id"], r["html"]) for r in spark.read.parquet(f"{d}/pages.parquet").collect()]
    assert plain(QUERIES["op8_warc_revisits"](spark, d).collect()) == expected(pages)


def test_awkward_payloads(spark, tmp_path):
    texts = [None, "", "\r\n\r\n", "WARC/1.1\r\nWARC-Type: response\r\n\r\nx\r\n\r\n", "é😀\x00\x85 \n", "\n", "a" * 300_000, "x\r\n\r\nWARC/1.1\r\n", "same", "WARC-Type: revisit\r", " lead", "trail "]
    pages = [(i, texts[i % len(texts)]) for i in range(40)] + [(-5, "same"), (None, "gone")]
    frame = spark.createDataFrame([(i, f"http://h/{i}\r\nX: 1" if i else None, t, "r", "d") for i, t in pages], "page_id long, url string, html string, record_type string, payload_digest string")
    for least in (0, 3, 10**6):
        path = f"file://{tmp_path}/{least}"
        assert plain(warc.round_trip(frame.repartition(3), least, path).collect()) == expected(pages, least)
    warc.write_archives(frame, f"file://{tmp_path}/w")
    records = warc.read_archives(spark, f"file://{tmp_path}/w").collect()
    rows = {r["page_id"]: r for r in records}
    for i, t in pages:
        if rows[i]["record_type"] == "response":
            assert rows[i]["payload"] == (t or "").encode() and rows[i]["says"] == rows[i]["payload_digest"]
    assert rows[7]["url"] == "http://h/7  X: 1" and rows[None]["payload"] == b"gone" and len({r["id"] for r in records}) == len(pages)
    assert warc.round_trip(frame.limit(0)).count() == 0


def test_archives_are_warc(spark, tmp_path):
    """Files read without Spark: gzip members with a record each, fresh dates, whole blocks, and revisits that name their response."""
    frame = spark.createDataFrame([(1, "http://h/1", "same é"), (2, "http://h/2", "same é"), (3, "http://h/3", "own")], "page_id long, url string, html string")
    warc.write_archives(frame, f"file://{tmp_path}/w")
    records = []
    for f in Path(tmp_path, "w").glob("part-*"):
        data = f.read_bytes()
        assert gzip.decompress(data)  # one stream for readers that don't care
        for member in data.split(warc.BETWEEN):
            if member:
                head, _, rest = gzip.decompress(member).partition(b"\r\n\r\n")
                field = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
                assert head.startswith(b"WARC/1.1\r\n") and rest[int(field["Content-Length"]) :] == b"\r\n\r\n"
                records.append((field, rest[: int(field["Content-Length"])]))
    by_url = {f["WARC-Target-URI"]: (f, b) for f, b in records}
    (one, empty), (two, block), (three, _) = (by_url[f"http://h/{k}"] for k in (1, 2, 3))
    assert one["WARC-Type"] == "revisit" and not empty and one["WARC-Refers-To"] == two["WARC-Record-ID"] != three["WARC-Record-ID"]
    assert one["WARC-Refers-To-Target-URI"] == "http://h/2" and one["WARC-Refers-To-Date"] == two["WARC-Date"] and one["WARC-Profile"] == warc.PROFILE
    assert two["Content-Type"] == "application/http; msgtype=response" and block.startswith(b"HTTP/1.1 200 OK\r\n") and block.endswith("\r\n\r\nsame é".encode())
    written = datetime.datetime.strptime(two["WARC-Date"], "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=datetime.UTC)
    assert abs((datetime.datetime.now(datetime.UTC) - written).total_seconds()) < 600


def test_a_record_per_row_where_page_ids_repeat(spark):
    pages = [(1, "a"), (1, "b"), (1, "b"), (2, "a"), (3, "b"), (3, "c"), (4, "d"), (4, "d"), (5, "e"), (None, "e"), (None, None), (None, "n"), (None, "n")] * 2 + [(6, "c"), (7, "a")]
    for url in ("http://h/{}", "http://h/x"):  # rows that differ in url only, and rows equal in all
        frame = spark.createDataFrame([(i, url.format(k), h) for k, (i, h) in enumerate(pages)], "page_id long, url string, html string")
        assert plain(warc.round_trip(frame.repartition(3)).collect()) == expected(pages)
