"""Text expressions. All but :func:`nfd` stay inside the JVM."""

from __future__ import annotations

import unicodedata
from string import Formatter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def format_template(template: str, *args: str | Column, **named: str | Column) -> Column:
    """``{}`` and ``{name}`` filled with columns cast to string; null as soon as one of them is (unlike ``format_string``)."""
    parts, k = [], 0
    for literal, field, _, _ in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if field is not None:
            value = args[k] if field == "" else named[field]
            k += field == ""
            parts.append(_c(value).cast("string"))
    return F.concat(*parts) if parts else F.lit("")


def strip(c: str | Column) -> Column:
    """Without white space of any kind at either end (``trim`` takes spaces only)."""
    return F.regexp_replace(_c(c), r"^\s+|\s+$", "")


def lstrip(c: str | Column) -> Column:
    return F.regexp_replace(_c(c), r"^\s+", "")


def rstrip(c: str | Column) -> Column:
    return F.regexp_replace(_c(c), r"\s+$", "")


def substr0(c: str | Column, start: int, length: int) -> Column:
    """Substring with a start counted from 0."""
    return F.substring(_c(c), start + 1, length)


def split_plain(c: str | Column, delimiter: str) -> Column:
    """Split at a literal delimiter; ``split`` alone takes a regular expression."""
    return F.split(_c(c), "\\Q" + delimiter + "\\E", -1)


def extract_or_null(c: str | Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null without one (``regexp_extract`` gives an empty string)."""
    return F.when(F.regexp_like(_c(c), F.lit(pattern)), F.regexp_extract(_c(c), pattern, group))


def try_decode(c: str | Column) -> Column:
    """Bytes as UTF-8 text, null where they are malformed."""
    return F.try_validate_utf8(_c(c).cast("string"))


def nfd(c: str | Column) -> Column:
    """Canonical decomposition; Spark has no built-in for it."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: unicodedata.normalize("NFD", t), na_action="ignore")

    return run(_c(c))


def normalize(c: str | Column, remove_punct: bool = False, lowercase: bool = False, nfd_unicode: bool = False, white_space: bool = False) -> Column:
    """NFD, then lower case, then punctuation and symbols out, then white space runs as one blank; each step by its flag."""
    out = nfd(c) if nfd_unicode else _c(c)
    if lowercase:
        out = F.lower(out)
    if remove_punct:
        out = F.regexp_replace(out, r"[\p{P}\p{S}]", "")
    if white_space:
        out = F.trim(F.regexp_replace(out, r"\s+", " "))
    return out


def chunk_fixed(c: str | Column, size: int = 500, overlap: int = 100) -> Column:
    """Pieces of ``size`` characters, each beginning ``size - overlap`` after the one before; the last may lie inside it. Empty text: none."""
    step, n = size - overlap, F.length(_c(c))
    pieces = F.transform(F.sequence(F.lit(0), n - 1, F.lit(step)), lambda i: F.substring(_c(c), i + 1, F.lit(size)))
    return F.when(n > 0, pieces).when(n == 0, F.array().cast("array<string>"))


def chunk_paragraphs(c: str | Column, least: int = 80, separator: str = "\\n\\n") -> Column:
    """Stripped pieces between separators (a regular expression) of at least ``least`` characters."""
    return F.filter(F.transform(F.split(_c(c), separator, -1), strip), lambda p: F.length(p) >= least)


def paragraphs(c: str | Column, least: int = 200) -> Column:
    """Pieces between blank lines, after CRLF and CR became LF; null text gives none."""
    plain = F.regexp_replace(_c(c), r"\r\n?", "\n")
    return F.coalesce(chunk_paragraphs(plain, least, r"\n\s*\n+"), F.array().cast("array<string>"))


def chunk_sentences(c: str | Column, more_than: int = 20) -> Column:
    """Stripped pieces cut after ``.``, ``!`` or ``?`` and white space before a capital A-Z, of more than ``more_than`` characters."""
    pieces = F.split(_c(c), r"(?<=[.!?])\s+(?=[A-Z])", -1)
    return F.filter(F.transform(pieces, strip), lambda p: F.length(p) > more_than)


def sentence_spans(c: str | Column) -> Column:
    """Sentences as structs (sent_id, sent_start, sent_end, sent_text): their place and where their words begin and end in the text."""
    pieces = F.filter(F.transform(F.split(_c(c), r"(?<=[.!?])\s+(?=[A-Z])", -1), strip), lambda p: p != "")
    sized = F.transform(pieces, lambda p: F.struct(p.alias("t"), F.regexp_count(p, F.lit(r"\S+")).alias("n")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<sent_id: int, sent_start: int, sent_end: int, sent_text: string>>").alias("out"))

    def add(done: Column, p: Column) -> Column:
        now = F.struct(F.size(done["out"]).alias("sent_id"), done["at"].alias("sent_start"), (done["at"] + p["n"]).alias("sent_end"), p["t"].alias("sent_text"))
        return F.struct((done["at"] + p["n"]).alias("at"), F.concat(done["out"], F.array(now)).alias("out"))

    return F.aggregate(sized, start, add, lambda done: done["out"])


def headings(c: str | Column) -> Column:
    """Markdown headings as structs (level, heading): every line that begins with ``#``, fenced code included."""
    lines = F.filter(F.split(_c(c), "\n", -1), lambda x: x.startswith("#"))
    return F.transform(lines, lambda x: F.struct(F.length(F.regexp_extract(x, "^(#+)", 1)).alias("level"), strip(F.regexp_replace(x, "^[# ]+", "")).alias("heading")))


def http_body(c: str | Column) -> Column:
    """The second piece between header breaks (CR LF CR LF); empty without one."""
    return F.coalesce(F.get(split_plain(c, "\r\n\r\n"), 1), F.lit(""))


def redact_pii(c: str | Column) -> Column:
    """Struct (safe_text, pii_types): e-mail addresses, IPv4 addresses and phone numbers replaced by their kind in brackets."""
    kinds = {"EMAIL": r"[\w.+-]+@[\w-]+\.[\w.-]*\w", "IP": r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "PHONE": r"\+?\d[\d ().-]{7,}\d"}
    safe, found = _c(c), []
    for kind, pattern in kinds.items():
        found.append(F.when(F.regexp_like(safe, F.lit(pattern)), F.lit(kind)))
        safe = F.regexp_replace(safe, pattern, f"[{kind}]")
    return F.struct(safe.alias("safe_text"), F.filter(F.array(*found), lambda x: x.isNotNull()).alias("pii_types"))
