import io
import unicodedata
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import geo, lists, media, text, vector


def one(spark, value, kind, f):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


def test_text(spark):
    s = lambda v, f: one(spark, v, "string", f)
    assert s("\t a \n", text.strip) == "a" and s(" a ", text.lstrip) == "a " and s(" a ", text.rstrip) == " a"
    assert s("a.b.c", lambda c: text.split_plain(c, ".")) == ["a", "b", "c"]
    assert s("x=5", lambda c: text.extract_or_null(c, r"=(\d)")) == "5" and s("x", lambda c: text.extract_or_null(c, r"=(\d)")) is None
    assert s(None, lambda c: text.format_template("a{}b", c)) is None and s("1", lambda c: text.format_template("{{{}}}{n}", c, n=c)) == "{1}1"
    assert s("Crème, BRÛLÉE!  x", lambda c: text.normalize(c, True, True, True, True)) == unicodedata.normalize("NFD", "crème brûlée x")
    assert one(spark, b"\xff", "binary", text.try_decode) is None and one(spark, "é".encode(), "binary", text.try_decode) == "é"
    assert s("a\r\n\r\nbody\r\n\r\nmore", text.http_body) == "body" and s("a", text.http_body) == ""
    assert s("mail a.b@c.org or +49 30 1234567 from 10.0.0.1", text.redact_pii) == ("mail [EMAIL] or [PHONE] from [IP]", ["EMAIL", "IP", "PHONE"])


def test_chunkers(spark):
    s = lambda v, f: one(spark, v, "string", f)
    for n in (0, 1, 400, 401, 500, 900, 1234):
        t = "".join(chr(97 + k % 26) for k in range(n))
        assert s(t, text.chunk_fixed) == [t[i : i + 500] for i in range(0, n, 400)]
    assert s(None, text.chunk_fixed) is None
    long = "p" * 200
    assert s(f"{long}\r\n \t\r\nshort\r\r {long} ", text.paragraphs) == [long, long] and s(None, text.paragraphs) == []
    assert s("One sentence that is long enough. Another one that is long too! no. Tiny.", text.chunk_sentences) == ["One sentence that is long enough.", "Another one that is long too! no."]
    assert [tuple(h) for h in s("# A #\nx\n##B\n```\n#tag\n```", text.headings)] == [(1, "A #"), (2, "B"), (1, "tag")]


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([1.0, 1.0], [2.0, 2.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 2.0]), (None, [1.0])], "a array<float>, b array<float>")
    got = [tuple(r) for r in df.select(vector.cosine_distance("a", "b"), vector.l2_distance("a", "b")).collect()]
    assert got[0] == (1.0, pytest.approx(5**0.5)) and got[1][0] == pytest.approx(0) and got[2] == (None, 1.0) and got[3] == (None, None) and got[4] == (None, None)
    with pytest.raises(Exception, match="expected a vector"):
        df.select(vector.check_length("a", 2)).collect()


def test_lists(spark):
    assert one(spark, [1, 2, 3, 4], "array<int>", lambda c: lists.chunk_list(c, 2, 2)) == [[1, 2], [3, 4]]
    assert one(spark, ["a", None, "b"], "array<string>", lambda c: lists.list_join(c, "-")) == "a-b"
    assert one(spark, '{"a": [{"b": "c"}]}', "string", lambda c: lists.json_query(c, ".a[0].b")) == "c"


def test_grid_cells(spark):
    # A cell of resolution 5 and its parents: known indices of one place.
    cell = one(spark, "85283473fffffff", "string", geo.from_text)
    value = lambda f: one(spark, cell, "long", f)
    assert value(geo.resolution) == 5 and value(geo.base_cell) == 20 and value(geo.is_valid) and value(geo.to_text) == "85283473fffffff"
    assert one(spark, value(lambda c: geo.parent(c, 4)), "long", geo.to_text) == "8428347ffffffff" and value(lambda c: geo.parent(c, 6)) is None
    assert not one(spark, 5, "long", geo.is_valid) and one(spark, "zz", "string", geo.from_text) is None


def test_images(spark):
    rng = np.random.default_rng(0)
    for channels in (1, 3, 4):
        a = rng.integers(0, 256, (7, 5, channels), dtype=np.uint8)
        assert np.array_equal(media.decode_array(media.encode_png(a)), a)
    red = np.zeros((10, 10, 3), np.uint8)
    red[:5, :, 0] = 255
    ppm = b"P6\n10 10\n255\n" + red.tobytes()
    df = spark.createDataFrame([(media.encode_png(red),), (ppm,), (b"broken",), (None,)], "raw binary").withColumn("image", media.decode_image("raw"))
    out = df.select(media.red_pixels("image").alias("red"), media.resize(media.to_rgb("image"), 4, 2).alias("small"), media.crop("image", 0, 0, 3, 2)["width"].alias("w")).collect()
    assert [r["red"] for r in out] == [50, 50, None, None] and [r["w"] for r in out][:2] == [3, 3]
    assert (out[0]["small"]["height"], out[0]["small"]["width"], out[0]["small"]["mode"]) == (2, 4, "RGB")
    assert out[2]["small"] is None or out[2]["small"]["data"] is None
    with pytest.raises(Exception, match="not a PNG"):
        df.select(media.decode_image("raw", "raise")).collect()
    again = df.limit(1).select(media.encode_image("image").alias("p")).first()["p"]
    assert np.array_equal(media.decode_array(bytes(again)), red)


def test_images_of_other_formats(spark):
    """A format that only the caller's functions know; built-in formats don't reach them."""

    def decode(raw):
        if raw[:2] != b"X:":
            raise ValueError("not X")
        return np.frombuffer(raw[3:], dtype=np.uint8).reshape(raw[2], -1)

    def encode(a):
        return b"X:" + bytes([a.shape[0]]) + a[:, :, 0].tobytes()

    grey = np.arange(6, dtype=np.uint8).reshape(2, 3, 1)
    df = spark.createDataFrame([(encode(grey),), (media.encode_png(grey),), (b"?",), (None,)], "raw binary").withColumn("image", media.decode_image("raw", decode=decode))
    out = df.select(media.encode_image("image", encode).alias("x"), "image").collect()
    assert [r["x"] and bytes(r["x"]) for r in out] == [encode(grey), encode(grey), None, None]
    assert (out[0]["image"]["height"], out[0]["image"]["width"], out[0]["image"]["mode"]) == (2, 3, "L")
    with pytest.raises(Exception, match="not X"):
        df.select(media.decode_image("raw", "raise", decode)).collect()


def test_sound_and_segments(spark):
    raw = io.BytesIO()
    with wave.open(raw, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(b"\0\0" * 4000)
    got = spark.createDataFrame([(raw.getvalue(),), (b"x",)], "raw binary").select(media.wav_metadata("raw").alias("m")).collect()
    assert tuple(got[0]["m"]) == (8000, 1, 4000, 0.5) and got[1]["m"]["frames"] is None
    assert one(spark, [0.0, 1.0, 2.0, 3.0], "array<double>", lambda c: media.resample(c, 4, 2)) == [0.0, 2.0]
    row = spark.range(1).select(
        media.snap(F.lit(2.5), F.lit(3.5), F.array(F.lit(0.0), F.lit(2.0), F.lit(4.0)), F.array(F.lit(2.0), F.lit(4.0))).alias("s"),
        media.snap(F.lit(0.1), F.lit(9.0), F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("edge"),
        media.clip_frames(F.lit(-1.0), F.lit(99.0), F.lit(10), F.lit(50).cast("long")).alias("f"),
        media.clip_name(F.lit("a"), F.lit(1.0), F.lit(2.345)).alias("n"),
    ).first()
    assert tuple(row["s"]) == (1.8, 4.2) and tuple(row["edge"]) == (0.0, 9.2) and tuple(row["f"]) == (0, 50) and row["n"].startswith("a_1.00_2.3")
