"""One-to-many extraction: blocks from web pages, definitions from Python source, headings from Markdown."""

from __future__ import annotations

import ast
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.text import headings
from sparkloom.storage import small_batches, spread

#: Tags whose text is a block, and tags whose content never is.
BLOCK_TAGS = ("title", "article", "main", "p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "div", "section", "figcaption", "caption", "blockquote", "th", "td", "pre", "code", "summary")
HIDDEN_TAGS = ("script", "style", "noscript")
_VOID = {"br", "hr", "img", "input", "link", "meta", "area", "base", "col", "embed", "source", "track", "wbr"}


class _Blocks(HTMLParser):
    """Collects the text of every block tag; nested blocks repeat their text in each block around them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int]] = []
        self.found: list[tuple[str, list[str]]] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN_TAGS:
            self.hidden += 1
        elif tag not in _VOID:
            if tag in ("p", "li", "td", "th") and self.open and self.open[-1][0] == tag:
                self.open.pop()
            self.open.append((tag, len(self.found)))
            self.found.append((tag, []))

    def handle_endtag(self, tag):
        if tag in HIDDEN_TAGS:
            self.hidden = max(0, self.hidden - 1)
        elif any(t == tag for t, _ in self.open):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if not self.hidden and (data := data.strip()):
            for _, k in self.open:
                self.found[k][1].append(data)


def _each_block(html: str | None) -> Iterator[tuple[str, str]]:
    parser = _Blocks()
    parser.feed(html or "")
    parser.close()
    return ((tag, " ".join(text)) for tag, text in parser.found if tag in BLOCK_TAGS and text)


def blocks_of(html: str | None) -> list[tuple[str, str]]:
    """(tag, text) of the blocks of a page in document order, without empty ones."""
    return list(_each_block(html))


#: Code points of blocks that a task holds before it passes them on; a longer block goes alone.
HELD_CHARS = 1 << 20


def block_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, tag, text) of the blocks of (k, html), a few pages' or a part of a page's at a time: nested blocks make up many times their page."""
    for batch in batches:
        of, tags, texts, held = [], [], [], 0

        def passed(batch=batch):
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int32())), pa.array(tags, pa.string()), pa.array(texts, pa.string())], ["k", "tag", "text"])

        for i, page in enumerate(batch.column(1)):
            for tag, text in _each_block(page.as_py()):
                of.append(i)
                tags.append(tag)
                texts.append(text)
                held += len(text) + 50
                if held >= HELD_CHARS:
                    yield passed()
                    of, tags, texts, held = [], [], [], 0
        if of:
            yield passed()


def html_blocks(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, tag, text, block_id): a row per block of each page; equal blocks of one page share an id."""

    source = spread(small_batches(pages).select(F.col(key).alias("k"), F.col(html).alias("h")))
    rows = source.mapInArrow(block_batches, f"k {source.schema['k'].dataType.simpleString()}, tag string, text string")
    return rows.select(F.col("k").alias(key), "tag", "text", F.concat_ws("-", F.col("k").cast("string"), "tag", F.xxhash64("text").cast("string")).alias("block_id"))


def raw_title(html: str | Column) -> Column:
    """The first title of a page as it is written, but for ``&amp;`` and blanks around it; empty for a page without one, null for no page."""
    found = F.regexp_extract(html, "<title>([^<]*)</title>", 1)
    return F.regexp_replace(F.replace(found, F.lit("&amp;"), F.lit("&")), r"^\p{Zs}+|\p{Zs}+\z", "")


def definitions_of(source: str | None) -> list[dict] | None:
    """Functions and classes of Python source, nested ones too, in the order of their lines; null for source that doesn't parse."""
    try:
        tree = ast.parse(source or "")
    except (SyntaxError, ValueError, RecursionError):
        return None
    out = []
    for node in ast.walk(tree):
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            out.append(_function(node, source) | {"kind": "function", "bases": [], "methods": []})
        elif isinstance(node, ast.ClassDef):
            methods = [f.name for f in node.body if isinstance(f, ast.FunctionDef | ast.AsyncFunctionDef)]
            out.append(_common(node, source) | {"kind": "class", "signature": f"class {node.name}", "is_async": False, "bases": [ast.unparse(b) for b in node.bases], "methods": methods})
    return sorted(out, key=lambda r: (r["start_line"], -r["end_line"], r["name"]))


def _common(node, source: str) -> dict:
    return {
        "name": node.name,
        "start_line": node.lineno,
        "end_line": node.end_lineno,
        "docstring": ast.get_docstring(node),
        "decorators": [ast.unparse(d) for d in node.decorator_list],
        "body": ast.get_source_segment(source, node),
    }


def _function(node, source: str) -> dict:
    is_async = isinstance(node, ast.AsyncFunctionDef)
    returns = f" -> {ast.unparse(node.returns)}" if node.returns else ""
    return _common(node, source) | {"signature": f"{'async ' * is_async}def {node.name}({ast.unparse(node.args)}){returns}", "is_async": is_async}


DEFINITION = (
    "struct<kind: string, name: string, signature: string, docstring: string, start_line: int, end_line: int, decorators: array<string>, "
    "bases: array<string>, methods: array<string>, body: string, is_async: boolean>"
)


def python_definitions(files: DataFrame, key: str, source: str) -> DataFrame:
    """A row per definition of each file, fields as columns; files that don't parse have none."""
    find = F.udf(definitions_of, f"array<{DEFINITION}>")
    return files.select(F.col(key), F.explode(find(F.col(source))).alias("d")).select(key, "d.*")


def markdown_headings(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, level, heading): a row per heading line."""
    return files.select(F.col(key), F.inline(headings(text)))


def github_url(c):
    """owner, repo, branch and path of a repository URL as a struct, null for anything else."""
    pattern = r"^https?://github\.com/([^/\s]+)/([^/\s]+?)(?:\.git)?(?:/(?:tree|blob)/([^/\s]+)(?:/(\S*?))?)?/?$"
    part = lambda k: F.nullif(F.regexp_extract(c, pattern, k), F.lit(""))
    fields = F.struct(*[part(k).alias(n) for k, n in enumerate(("owner", "repo", "branch", "path"), 1)])
    return F.when(F.regexp_like(c, F.lit(pattern)), fields)


#: File suffixes by kind.
KINDS = {
    "code": ("py", "js", "ts", "rs", "go", "java"),
    "doc": ("md", "txt", "rst"),
    "pdf": ("pdf",),
    "image": ("jpg", "jpeg", "png", "gif", "webp"),
    "audio": ("mp3", "wav", "flac", "ogg"),
    "video": ("mp4", "mov", "avi", "mkv"),
    "data": ("parquet", "csv", "json", "jsonl"),
}


def file_kind(path):
    """The kind of a file by its suffix, "other" for the rest."""
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    out = F.lit("other")
    for kind, suffixes in KINDS.items():
        out = F.when(suffix.isin(*suffixes), kind).otherwise(out)
    return out
