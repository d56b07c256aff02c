"""Images, frames and segments.

An image is a struct of height, width, channels, mode and raw bytes, row by row. PNG (8 bits, not interlaced) and binary
PPM/PGM are decoded without further libraries; other formats, such as JPEG, by a function of the caller's. What neither can read
is null or an error, as asked for.
"""

from __future__ import annotations

import io
import struct
import wave
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IMAGE = "struct<height: int, width: int, channels: int, mode: string, data: binary>"
_MODES = {1: "L", 2: "LA", 3: "RGB", 4: "RGBA"}


def decode_array(raw: bytes) -> np.ndarray:
    """Pixels of a PNG, PPM or PGM file, height by width by channels."""
    if raw[:8] == b"\x89PNG\r\n\x1a\n":
        at, data, head = 8, b"", None
        while at < len(raw):
            size, kind = struct.unpack(">I4s", raw[at : at + 8])
            body = raw[at + 8 : at + 8 + size]
            at += size + 12
            if kind == b"IHDR":
                head = struct.unpack(">IIBBBBB", body)
            elif kind == b"IDAT":
                data += body
        width, height, depth, color, _, _, interlace = head
        channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(color)
        if depth != 8 or interlace or channels is None:
            raise ValueError("only 8-bit grey or colour PNG files without interlacing")
        lines = np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(height, 1 + width * channels)
        out = np.zeros((height, width * channels), dtype=np.uint8)
        before = np.zeros(width * channels, dtype=np.int32)
        for y, line in enumerate(lines):
            now = _unfilter(int(line[0]), line[1:].astype(np.int32), before, channels)
            out[y], before = now, now
        return out.reshape(height, width, channels)
    if raw[:2] in (b"P5", b"P6"):
        fields, at = [], 2
        while len(fields) < 3:
            while raw[at : at + 1].isspace():
                at += 1
            end = at
            while not raw[end : end + 1].isspace():
                end += 1
            fields.append(int(raw[at:end]))
            at = end
        width, height, _ = fields
        channels = 3 if raw[:2] == b"P6" else 1
        return np.frombuffer(raw, dtype=np.uint8, offset=at + 1, count=width * height * channels).reshape(height, width, channels)
    raise ValueError("not a PNG, PPM or PGM file")


def _unfilter(kind: int, line: np.ndarray, up: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return line
    if kind == 2:
        return (line + up) & 255
    out = line.copy()
    for x in range(len(out)):
        a, b, c = (out[x - step] if x >= step else 0), up[x], (up[x - step] if x >= step else 0)
        if kind == 1:
            add = a
        elif kind == 3:
            add = (a + b) // 2
        else:
            p = a + b - c
            add = min((a, b, c), key=lambda v: abs(p - v))
        out[x] = (out[x] + add) & 255
    return out


def encode_png(pixels: np.ndarray) -> bytes:
    height, width, channels = pixels.shape
    lines = np.concatenate([np.zeros((height, 1), np.uint8), pixels.reshape(height, -1)], axis=1).tobytes()

    def part(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 2: 4, 3: 2, 4: 6}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(lines)) + part(b"IEND", b"")


def _row(a: np.ndarray | None) -> dict | None:
    return None if a is None else {"height": a.shape[0], "width": a.shape[1], "channels": a.shape[2], "mode": _MODES[a.shape[2]], "data": np.ascontiguousarray(a, dtype=np.uint8).tobytes()}


def _array(r: dict | None) -> np.ndarray | None:
    return None if r is None or r["data"] is None else np.frombuffer(r["data"], dtype=np.uint8).reshape(r["height"], r["width"], r["channels"])


def _frame(rows: list[dict | None]) -> pd.DataFrame:
    names = ["height", "width", "channels", "mode", "data"]
    return pd.DataFrame([r or dict.fromkeys(names) for r in rows], columns=names).astype({"mode": object, "data": object})


def _pixels(raw: bytes, decode: Callable[[bytes], np.ndarray] | None) -> np.ndarray:
    """By the decoder that is built in if the file is one of its formats, else by ``decode``; two dimensions are one channel."""
    if decode is None or raw[:2] in (b"P5", b"P6") or raw[:8] == b"\x89PNG\r\n\x1a\n":
        return decode_array(raw)
    a = np.asarray(decode(raw), dtype=np.uint8)
    return a[:, :, None] if a.ndim == 2 else a


def decode_image(c: str | Column, on_error: str = "null", decode: Callable[[bytes], np.ndarray] | None = None) -> Column:
    """File bytes to an image; ``on_error``: "null" or "raise". ``decode(bytes)`` gives the pixels (height, width, channels) of formats not built in."""

    @F.pandas_udf(IMAGE)
    def run(s: pd.Series) -> pd.DataFrame:
        def one(raw: bytes | None) -> dict | None:
            try:
                return None if raw is None else _row(_pixels(bytes(raw), decode))
            except Exception:
                if on_error == "raise":
                    raise
                return None

        return _frame([one(x) for x in s])

    return run(c)


def _each(c: str | Column, change) -> Column:
    @F.pandas_udf(IMAGE)
    def run(images: pd.DataFrame) -> pd.DataFrame:
        found = [None if r["data"] is None else _array(r) for r in images.to_dict("records")]
        return _frame([_row(None if a is None else change(a)) for a in found])

    return run(c)


def to_rgb(c: str | Column) -> Column:
    """Grey as three equal channels, alpha dropped."""
    return _each(c, lambda a: np.repeat(a[:, :, :1], 3, axis=2) if a.shape[2] < 3 else a[:, :, :3])


def resize(c: str | Column, width: int, height: int) -> Column:
    """The nearest source pixel for each target pixel."""

    def change(a: np.ndarray) -> np.ndarray:
        y = ((np.arange(height) + 0.5) * a.shape[0] / height).astype(int)
        x = ((np.arange(width) + 0.5) * a.shape[1] / width).astype(int)
        return a[y][:, x]

    return _each(c, change)


def crop(c: str | Column, x: int, y: int, width: int, height: int) -> Column:
    return _each(c, lambda a: a[y : y + height, x : x + width])


def encode_image(c: str | Column, encode: Callable[[np.ndarray], bytes] | None = None) -> Column:
    """An image as PNG bytes, or as what ``encode(pixels)`` makes of it."""

    @F.pandas_udf("binary")
    def run(images: pd.DataFrame) -> pd.Series:
        return pd.Series([None if r["data"] is None else (encode or encode_png)(_array(r)) for r in images.to_dict("records")], dtype=object)

    return run(c)


def red_pixels(c: str | Column) -> Column:
    """How many pixels are red after a 5 by 5 majority filter: hue at least 245 or at most 10 of 256, saturation and value at least 100."""

    @F.pandas_udf("long")
    def run(images: pd.DataFrame) -> pd.Series:
        return pd.Series([None if r["data"] is None else int(_red(_array(r)).sum()) for r in images.to_dict("records")], dtype="Int64")

    return run(c)


def keyframes(frames: DataFrame, threshold: float, path: str = "path", index: str = "frame_index", vector: str = "embedding") -> DataFrame:
    """The first frame of each path and those whose vector is further than ``threshold`` from the one before."""
    from sparkloom.functions.vector import l2_distance

    before = F.lag(vector).over(Window.partitionBy(path).orderBy(index))
    out = frames.withColumn("_before", before)
    return out.filter(F.col("_before").isNull() | (l2_distance(vector, "_before") > threshold)).drop("_before")


def _red(a: np.ndarray) -> np.ndarray:
    rgb = (np.repeat(a[:, :, :1], 3, axis=2) if a.shape[2] < 3 else a[:, :, :3]).astype(np.float64) / 255
    high, low = rgb.max(2), rgb.min(2)
    spread = np.where(high > low, high - low, 1)
    r, g, b = rgb[..., 0], rgb[..., 1], rgb[..., 2]
    sixth = np.where(high == r, (g - b) / spread % 6, np.where(high == g, (b - r) / spread + 2, (r - g) / spread + 4))
    hue = np.where(high > low, sixth / 6, 0) * 255
    mask = ((hue >= 245) | (hue <= 10)) & (np.where(high > 0, (high - low) / np.where(high > 0, high, 1), 0) * 255 >= 100) & (high * 255 >= 100)
    padded = np.pad(mask.astype(np.int32), 2, mode="edge")
    votes = sum(padded[y : y + mask.shape[0], x : x + mask.shape[1]] for y in range(5) for x in range(5))
    return votes > 12


def snap(start: Column, end: Column, starts: Column, ends: Column, pad: float = 0.2) -> Column:
    """A span widened to the boundaries of segments around it, with ``pad`` seconds on either side, from 0 on, as struct (snap_start, snap_end)."""
    left = F.coalesce(F.array_max(F.filter(starts, lambda x: x <= start)), start)
    right = F.coalesce(F.array_min(F.filter(ends, lambda x: x >= end)), end)
    return F.struct(F.greatest(left - pad, F.lit(0.0)).alias("snap_start"), (right + pad).alias("snap_end"))


def clip_frames(start: Column, end: Column, rate: Column, frames: Column) -> Column:
    """First and last frame of a clip, clamped to what there is."""
    clamp = lambda t: F.least(F.greatest(F.round(t * rate).cast("long"), F.lit(0).cast("long")), frames)
    return F.struct(clamp(start).alias("first_frame"), clamp(end).alias("last_frame"))


def clip_name(stem: Column, start: Column, end: Column, suffix: str = "mp3") -> Column:
    return F.format_string(f"%s_%.2f_%.2f.{suffix}", stem, start, end)


def wav_metadata(c: str | Column) -> Column:
    """What the header of a WAV file says, as a struct; nulls for anything else."""

    @F.pandas_udf("struct<sample_rate: int, channels: int, frames: long, seconds: double>")
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_wav(x) for x in s], columns=["sample_rate", "channels", "frames", "seconds"])

    return run(c)


def _wav(raw: bytes | None) -> dict:
    try:
        with wave.open(io.BytesIO(bytes(raw))) as w:
            return {"sample_rate": w.getframerate(), "channels": w.getnchannels(), "frames": w.getnframes(), "seconds": w.getnframes() / w.getframerate()}
    except Exception:
        return {}


def resample(c: str | Column, from_rate: int, to_rate: int) -> Column:
    """Samples (array of double) at another rate, by linear interpolation."""

    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        def one(x):
            if x is None or not len(x):
                return x
            n = max(1, round(len(x) * to_rate / from_rate))
            return np.interp(np.arange(n) * from_rate / to_rate, np.arange(len(x)), np.asarray(x, dtype=np.float64))

        return s.map(one)

    return run(c)
