"""WARC archives without repeated payloads: revisit records for equal payloads, written and read back with Spark's text files.

Headers (ids, digest, length) are shuffled by payload digest to find which record is the response; payloads are shuffled once, to
meet the header of the response that holds them. Records are WARC/1.1 with fresh ids, date, digest and length: responses hold an
HTTP message, revisits no block but the id, URL and date of the response that they refer to.

Every record is a gzip member of its own, as the format asks. Files are written and read by Spark's text source, whose separator
is an empty gzip member: other readers see nothing in it, and Spark splits files there, whatever payloads hold. (That a
compressed payload holds these 20 bytes has a chance of 2**-160 a byte.) Reading joins revisits to their responses by record id.
"""

from __future__ import annotations

import base64
import datetime
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm._words import small_batches
from sparkloom.storage import materialize, new_path

END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A gzip member of no bytes, between two records.
BETWEEN = bytes.fromhex("1f8b08000000000000030300000000000000" + "0000")
#: Salts by which the headers of responses are repeated for the join with the revisits that refer to them.
SALTS = 16


def base32_sha1(data: Column) -> Column:
    """The SHA-1 of a binary column in base 32: upper case, 32 characters."""
    digits = F.sha1(data)
    four = [F.lpad(F.conv(F.substring(digits, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.upper(F.concat(*four)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def headers(pages: DataFrame, run: str, least_bytes: int = 0) -> DataFrame:
    """A row for each row of ``pages``: page_id, url, payload_bytes, payload_digest, id, record_type, and the response's to_id, to_url, refers_to.

    Of rows with equal payloads of ``least_bytes`` or more, the one with the largest page_id (then url; null before all others) is
    the response and the rest, rows equal to it among them, are revisits; rows with shorter payloads are all responses.
    """
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.octet_length(payload).cast("long").alias("payload_bytes"), base32_sha1(payload.cast("binary")).alias("payload_digest"))
    # Rows that are equal so far are counted before they move, and numbered when they are written out again.
    rows = materialize(rows.groupBy("page_id", "url", "payload_bytes", "payload_digest").agg(F.count("*").alias("n")), "headers")
    # Only digests that repeat, in a table of their own, so that the join can split one that very many rows have.
    first = rows.filter(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(F.max(F.struct("page_id", "url")).alias("to"), F.sum("n").alias("m"))
    first = materialize(first.filter("m > 1").drop("m"), "originals")
    joined = rows.join(first.withColumnRenamed("payload_digest", "_d"), F.col("payload_digest") == F.col("_d"), "left").withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), "n")))

    def record_id(page: Column, url: Column, k: Column) -> Column:
        h = F.sha1(F.concat_ws("|", F.lit(run), F.coalesce(page.cast("string"), F.lit("-")), k.cast("string"), "payload_digest", url).cast("binary"))
        cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (14, 3), (18, 3), (21, 12))]
        return F.concat(F.lit("urn:uuid:"), cut[0], F.lit("-"), cut[1], F.lit("-5"), cut[2], F.lit("-8"), cut[3], F.lit("-"), cut[4])

    original = F.col("to").isNull() | (F.struct("page_id", "url").eqNullSafe(F.col("to")) & (F.col("k") == 1))
    to = {"to_id": record_id(F.col("to.page_id"), F.col("to.url"), F.lit(1)), "to_url": F.col("to.url"), "refers_to": F.col("to.page_id")}
    return joined.select(
        "page_id", "url", "payload_bytes", "payload_digest", record_id(F.col("page_id"), F.col("url"), F.col("k")).alias("id"),
        F.when(original, "response").otherwise("revisit").alias("record_type"), *[F.when(~original, c).alias(k) for k, c in to.items()],
    )


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, run: str | None = None, date: str | None = None, level: int = 6) -> None:
    """Write a record per row of ``pages`` (page_id, url, html) under ``path``, as files of gzip members (``level`` of compression).

    ``run`` (by default a new one) goes into record ids, which are unique; ``date`` is the time of writing unless given.
    """
    small_batches(pages)
    date = date or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = headers(pages, run or uuid.uuid4().hex, least_bytes)

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))

    def in_line(url: Column) -> Column:
        return F.regexp_replace(url, r"[\r\n]", " ")  # a line break in a URL would end its header line

    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    revisit = F.col("record_type") == "revisit"
    same = F.concat(line("WARC-Refers-To", F.concat(F.lit("<"), "to_id", F.lit(">"))), line("WARC-Refers-To-Target-URI", in_line(F.col("to_url"))), line("WARC-Refers-To-Date", F.lit(date)), line("WARC-Profile", F.lit(PROFILE)))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.concat(F.lit("<"), "id", F.lit(">"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", in_line(F.col("url"))),
        F.when(F.col("page_id").isNull(), F.lit("")).otherwise(line("Page-ID", F.col("page_id").cast("string"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        F.when(revisit, same).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise((F.octet_length(http) + F.col("payload_bytes")).cast("string"))),
        F.lit("\r\n"),
        F.when(revisit, F.lit("")).otherwise(http),
    )
    def row_key(page: str, url: Column, digest: Column) -> Column:
        return F.concat_ws("|", F.coalesce(F.col(page).cast("string"), F.lit("-")), digest, url).alias("key")

    rows = rows.select("record_type", row_key("page_id", F.col("url"), F.col("payload_digest")), head.alias("head"))
    # Equal rows give one payload, before it moves; the join takes it where it is.
    html = F.coalesce("html", F.lit(""))
    html = pages.select(row_key("page_id", F.coalesce("url", F.lit("")), base32_sha1(html.cast("binary"))), html.alias("html")).groupBy("key").agg(F.first("html").alias("html"))
    responses = rows.filter("record_type = 'response'").join(html, "key").select("head", "html")
    records = responses.unionByName(rows.filter(revisit).select("head", F.lit("").alias("html")))

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([gzip.compress(f"{h}{t}".encode("utf-8", "surrogatepass") + END, level, mtime=0) for h, t in both], pa.binary())], ["value"])

    packed = records.mapInArrow(members, "value binary").select(F.col("value").cast("string"))  # the bytes as they are
    packed.write.option("encoding", "ISO-8859-1").option("lineSep", BETWEEN.decode("latin-1")).text(path)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records: id, page_id, url, record_type, to_id, says (the digest in the header), payload_bytes and payload_digest of the payload as read
    (null for revisits) and, with ``payloads``, payload (binary)."""
    files = spark.read.option("encoding", "ISO-8859-1").option("lineSep", BETWEEN.decode("latin-1")).text(path)
    schema = "id string, page_id long, url string, record_type string, to_id string, says string, payload_bytes long, payload_digest string" + ", payload binary" * payloads
    kinds = [pa.string(), pa.int64(), *[pa.string()] * 4, pa.int64(), pa.string(), *[pa.binary()] * payloads]
    names = [c.split()[0] for c in schema.split(", ")]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for member in batch.column(0).to_pylist():
                head, _, rest = gzip.decompress(member).partition(END)
                field = dict(x.split(": ", 1) for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
                block = rest[: int(field["Content-Length"])]
                page = [int(field["Page-ID"]) if "Page-ID" in field else None, field["WARC-Target-URI"], field["WARC-Type"]]
                row = [field["WARC-Record-ID"][1:-1], *page, field["WARC-Refers-To"][1:-1] if "WARC-Refers-To" in field else None, field["WARC-Payload-Digest"].partition(":")[2]]
                data = block.partition(END)[2] if page[2] == "response" else None
                row += [None, None] if data is None else [len(data), base64.b32encode(hashlib.sha1(data).digest()).decode()]
                out.append([*row, data][: len(names)])
            columns = list(zip(*out, strict=True)) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

    return files.filter("octet_length(value) > 0").select(F.col("value").cast("binary")).mapInArrow(parse, schema)


def resolve(records: DataFrame) -> DataFrame:
    """``records`` (of :func:`read_archives`) with refers_to, and with bytes and digest of a revisit taken from the response that it refers to."""
    own = ["id", "page_id", "url", "record_type"]
    responses = records.filter("record_type = 'response'").select(*own, "payload_bytes", "payload_digest", F.lit(None).cast("long").alias("refers_to"))
    revisits = records.filter("record_type = 'revisit'").select(*own, "to_id", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"))
    # Only responses that are referred to meet revisits; one that very many refer to does so in many tasks.
    wanted = revisits.select(F.col("to_id").alias("id"), "salt").distinct()
    found = responses.join(wanted, "id").select(F.col("id").alias("to_id"), "salt", "payload_bytes", "payload_digest", F.col("page_id").alias("refers_to"))
    return responses.unionByName(revisits.join(found, ["to_id", "salt"]).select(responses.columns))


def round_trip(pages: DataFrame, least_bytes: int = 0, path: str | None = None) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: a row per row of ``pages``, read back from archives written for them.

    Bytes and digest are computed from the payload read, for revisits from the response that they refer to. Null html counts as
    empty and a null url too. Rows that repeat a page_id, with the same html or another, and rows whose page_id is null have
    records of their own; which of equal payloads is the response says :func:`headers`. Other columns are not looked at; an empty
    table gives an empty result.
    """
    pages = pages.select("page_id", "url", "html")
    path = path or new_path(pages.sparkSession, "warc")
    write_archives(pages, path, least_bytes)
    records = materialize(read_archives(pages.sparkSession, path, payloads=False), "records")
    return resolve(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
