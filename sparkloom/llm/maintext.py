"""Main text of web pages: flat text blocks, told apart by a decision tree over word counts and link densities of neighbours.

A page becomes a list of blocks, each the text between two block-level tags, in page order and with nothing of the tree of tags but
what the innermost telling container says of it: an article or content on one side, a menu, advert, form or comments on the other.
Features of a block are its words and the share of them inside links, the same of the blocks before and after it, and the container. The
tree is trained by Spark ML on the small labelled table below and becomes a plain expression in the plan of the pages, which read each
page once and shuffle nothing.
"""

from __future__ import annotations

import functools
import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm._words import small_batches
from sparkloom.storage import spread

# Fixed values of HTML: elements that begin and end a block, those that never hold article text, and those without an end tag.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "label legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
UNSEEN = "script style noscript template svg iframe object textarea select canvas audio video math"
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements that end an open one of the same kind, and those that they don't reach beyond.
SIBLINGS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "td": ("table", "tr"), "th": ("table", "tr"), "tr": ("table",)}

# What containers say. Elements and roles first, then words in class and id; a trailing * stands for any ending.
AGAINST = {"nav", "aside", "footer", "form", "menu", "button", "label", "dialog", "search", "head", "title", "header"}
FOR = {"article", "main"}
ROLES = {"navigation": -1, "banner": -1, "contentinfo": -1, "complementary": -1, "search": -1, "dialog": -1, "alert": -1, "alertdialog": -1, "form": -1, "menu": -1, "menubar": -1, "main": 1, "article": 1}
WORDS_AGAINST = (
    "ad ads adsense adslot adv advert* advertorial sponsor* promo* banner* taboola outbrain nav navi navbar* navig* menu* breadcrumb* toc topbar masthead logo sidebar* rail aside widget* related* recommend* "
    "recirc* popular trending teaser* comment* disqus discussion repl* respond responses cookie* consent gdpr notice* notif* alert* popup* modal* overlay* paywall newsletter* subscri* signup login "
    "search* form share* sharing social* footer* foot copyright legal pagination pager header* skip"
).split()
WORDS_FOR = "article* content* post entry story text maintext bodytext main".split()

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({UNSEEN.replace(' ', '|')})(?=[\s/>])[^>]*>.*?(?:</\1(?=[\s/>])[^>]*>|\Z)|<[!?][^>]*>|<(/?)([a-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: What a container says it has, or has not, besides: no name of its own.
_BESIDES = re.compile(r"\b(?:with|without|has|no|hide|show)(?:[-_]\w+|[A-Z]\w*)")
#: Parts of other documents and of other readers; an article inside them is not the page's.
_OTHERS = re.compile("comment.*|disqus|discussion|repl.*|respond|responses|related.*|recommend.*|recirc.*|teaser.*|trending|popular|ad|ads|adv|advert.*|sponsor.*|promo.*")


def _pattern(words: list[str]) -> re.Pattern:
    return re.compile("|".join(w[:-1] + ".*" if w.endswith("*") else w for w in words))


_AGAINST, _FOR = _pattern(WORDS_AGAINST), _pattern(WORDS_FOR)


@functools.lru_cache(maxsize=20_000)
def container(tag: str, attributes: str, inside: int) -> int:
    """Negative for a container of anything but the article (-2: even an article in it), 1 for the article's, else what holds around it (``inside``)."""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)} if attributes else {}
    words = [w.lower() for w in _PARTS.findall(_BESIDES.sub("", f"{found.get('class', '')} {found.get('id', '')}"))]
    says_for = any(_FOR.fullmatch(w) for w in words) or found.get("itemprop", "").lower() in ("articlebody", "text")
    against = {w for w in words if _AGAINST.fullmatch(w)}
    if says_for and against <= {"header", "headers"}:
        against = set()
    role = ROLES.get(found.get("role", "").lower(), 0)
    if inside == -2 or any(_OTHERS.fullmatch(w) for w in against) or tag in AGAINST and tag != "header":
        return -2
    if against or role == -1 or tag == "header" and inside != 1:
        return -1
    if tag in FOR or inside != -1 and (says_for or role == 1):
        return 1
    return inside


def blocks_of(html: str | None) -> list[tuple[str, int, int, int]]:
    """(text, words, words inside links, container) of the text blocks of a page in order, without empty ones."""
    html, out = html or "", []
    held: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, int]] = []  # open elements and what holds inside them
    said, in_link, at = 0, 0, 0

    def flush() -> None:
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            if text:
                out.append((text, text.count(" ") + 1, len(entities.unescape(" ".join(linked)).split()), said))
            held.clear()
            linked.clear()

    def close(to: int) -> None:
        nonlocal said, in_link
        in_link -= sum(tag == "a" for tag, _ in stack[to:])
        del stack[to:]
        said = stack[-1][1] if stack else 0

    def innermost(tags: tuple[str, ...], stop: tuple[str, ...] | frozenset = ()) -> int | None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in tags:
                return k
            if stack[k][0] in stop:
                return None
        return None

    for m in _TOKEN.finditer(html):
        if m.start() > at:
            held.append(html[at : m.start()])
            if in_link:
                linked.append(held[-1])
        at = m.end()
        if m[3] is None:
            if m[1]:
                held.append(" ")
            continue
        tag, block = m[3].lower(), False
        block = tag in BLOCKS
        if block:
            flush()
        elif tag == "br":
            held.append(" ")
        if tag in VOID:
            continue
        if m[2]:
            k = innermost((tag,))
            if k is not None and (block or not any(t in BLOCKS for t, _ in stack[k:])):
                close(k)
            continue
        if block:
            if (k := innermost(("p",), BLOCKS - {"p"})) is not None:
                close(k)
            if tag in SIBLINGS and (k := innermost(("dt", "dd") if tag[0] == "d" else ("td", "th") if tag in ("td", "th") else (tag,), SIBLINGS[tag])) is not None:
                close(k)
        elif tag == "a":
            if (k := innermost(("a",), BLOCKS)) is not None:
                close(k)
            in_link += 1
        elif tag != "span" or not m[4]:
            continue
        said = container(tag, m[4], said) if block or m[4] else said
        stack.append((tag, said))
    if at < len(html):
        held.append(html[at:])
    flush()
    return out


FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "container")
_BLOCK = "array<struct<text: string, features: array<double>>>"


def features_of(found: list[tuple[str, int, int, int]]) -> list[list[float]]:
    """FEATURES of each block. container: -2 one that holds no article, -1 outside the page's article, 0 where nothing says, 1 the article's."""
    marked = any(b[3] == 1 for b in found)
    own = [(float(words), min(1.0, linked / words)) for _, words, linked, _ in found]
    around = [(0.0, 0.0), *own, (0.0, 0.0)]
    said = [float(b[3] if b[3] == 1 else -2 if b[3] < 0 else -1 if marked else 0) for b in found]
    return [[*around[k + 1], *around[k], *around[k + 2], said[k]] for k in range(len(found))]


def blocks(pages: DataFrame) -> DataFrame:
    """page_id, url and blocks (array of text and features) for every row of ``pages``; null html has none."""
    small_batches(pages)
    source = spread(pages.select("page_id", "url", "html"))
    kind = pa.list_(pa.struct([("text", pa.string()), ("features", pa.list_(pa.float64()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [blocks_of(h) for h in batch.column(2).to_pylist()]
            rows = [[{"text": b[0], "features": f} for b, f in zip(some, features_of(some), strict=True)] for some in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, kind)], ["page_id", "url", "blocks"])

    kinds = source.schema
    return source.mapInArrow(run, f"page_id {kinds['page_id'].dataType.simpleString()}, url {kinds['url'].dataType.simpleString()}, blocks {_BLOCK}")


#: The labelled table: pages as pieces of html, each with 1 if its blocks are the article's and 0 if not. {n} stands for n words, {an} for a link of n words.
LABELLED: tuple[tuple[tuple[int, str], ...], ...] = (
    ((0, "<head><title>{6}</title></head><body><nav><ul><li>{a1}<li>{a1}<li>{a2}</ul></nav><div class=ad>{8}</div>"), (1, "<article><h1>{6}</h1><p>{90}<p>{1}<p>{40}<p>{2}</p></article>"), (0, "<footer>{12}</footer>")),
    ((0, "<header>{3}<p>{a2}</p></header><div class=menu>{a1} {a1} {a2}</div>"), (1, "<main><h1>{7}</h1><p>{55}</p><h2>{3}</h2><p>{70} {a3} {8}</p><ul><li>{9}<li>{4}</ul></main>"), (0, "<aside><h3>{2}</h3><p>{30}</p><p>{a6}</p></aside><footer><p>{25}</p></footer>")),
    ((0, "<div id=top>{4}</div><div class=navbar>{a1} {a1}</div>"), (1, "<div class=article-body><p>{60}</p><p>{3}</p>"), (0, "<div class='ad-slot'>{20}</div>"), (1, "<p>{80}</p></div>"), (0, "<div id=comments><h3>{2}</h3><p>{45}</p><p>{60}</p></div><p>{9}</p>")),
    ((0, "<p>{a1} {a1} {a2} {a1}</p><p>{a2} {a2}</p>"), (1, "<h1>{8}</h1><p>{70}</p><p>{45}</p><p>{28} {a2} {12}</p><p>{33}</p>"), (0, "<p>{a3}</p><p>{a4}</p><p>{7}</p>")),
    ((0, "<table><tr><td>{a1}<td>{a1}<td>{a2}</tr></table>"), (1, "<p>{50}</p><p>{21}</p><p>{65}</p>"), (0, "<p>{a5} {1}</p><p>{4} {a1}</p>")),
    ((1, "<p>{30}</p><p>{25}</p><p>{44}</p><p>{19}</p>"),),
    ((0, "<div>{a2}</div><div>{a1} {a1}</div><div>{5}</div>"), (1, "<div>{85}</div><div>{120}</div>"), (0, "<div>{a4}</div><div>{6}</div>")),
    ((0, "<div class=cookie-notice>{35} {a2}</div><form><p>{12}</p><label>{2}</label></form>"), (1, "<article><header><h1>{9}</h1></header><p>{65}</p><blockquote>{25}</blockquote><p>{a8}</p>"), (0, "<aside>{40}</aside><div class='share'>{a1} {a1}</div>"), (1, "<p>{50}</p></article>"), (0, "<section class=comments><article class=comment><p>{70}</p></article><p>{15}</p></section>")),
    ((0, "<div class=sidebar><p>{50}</p><p>{a3}</p></div>"), (1, "<div id=content><h2>{4}</h2><p>{35}</p><p>{1}</p><p>{10}</p></div>"), (0, "<p>{14}</p><p>{40}</p>")),
    ((0, "<div role=navigation>{a1} {a1}</div><div role=alert>{18}</div>"), (1, "<div role=main><p>{5}</p><p>{a2} {6}</p><p>{75}</p></div>"), (0, "<div role=contentinfo>{30}</div>")),
    ((0, "<ul><li>{a1}<li>{a2}<li>{a1}</ul><p>{3}</p>"), (1, "<h1>{5}</h1><p>{40}</p><p>{16}</p><p>{52}</p><p>{24}</p>"), (0, "<ul><li>{a4}<li>{a5}<li>{a6}</ul><p>{5} {a2}</p>")),
    ((0, "<p>{2}</p><p>{a9}</p><p>{a7} {3}</p>"), (1, "<p>{100}</p>"), (0, "<p>{a8}</p><p>{3}</p>")),
    ((0, "<div>{a1} {a1}</div><div>{3}</div>"), (1, "<h1>{6}</h1><p>{48}</p><p>{4}</p><p>{62}</p><p>{1}</p><p>{35}</p><p>{11}</p><p>{90}</p>"), (0, "<div>{a2}</div><div>{9}</div>")),
    ((0, "<p>{a1}</p><p>{5}</p><p>{a3}</p>"), (1, "<p>{41}</p><p>{7}</p><p>{57}</p><p>{2}</p><p>{38}</p>"), (0, "<p>{a2}</p><p>{12}</p><p>{a1}</p><p>{6}</p>")),
)


def labelled_blocks(spark: SparkSession) -> DataFrame:
    """(features, label): the blocks of the labelled pages. Each piece ends with a mark that tells its blocks and is no part of them."""
    rows = []
    for page in LABELLED:
        # Words are w0 in pieces of other things and w1 in pieces of the article, so that each block carries its label.
        word = lambda n, label: " ".join([f"w{label}"] * int(n))
        fill = lambda m, label: f"<a href=#>{word(m[2], label)}</a>" if m[1] else word(m[2], label)
        html = "".join(re.sub(r"\{(a?)(\d+)\}", lambda m, label=label: fill(m, label), piece) for label, piece in page)
        found = blocks_of(html)
        rows += [(f, float(text.startswith("w1"))) for (text, *_), f in zip(found, features_of(found), strict=True)]
    return spark.createDataFrame(rows, "features array<double>, label double")


def train(table: DataFrame, depth: int = 6) -> str:
    """The tree for a labelled table (features, label), in the text form of Spark ML."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.functions import array_to_vector

    rows = table.select(array_to_vector("features").alias("features"), "label").coalesce(1)
    return DecisionTreeClassifier(maxDepth=depth, maxBins=64, minInstancesPerNode=2, seed=1).fit(rows).toDebugString


def tree_column(tree: str, features: Column) -> Column:
    """1 or 0 as the tree says for an array of features: the tree as one nested expression."""
    lines = [x.strip() for x in tree.splitlines()[1:] if x.strip()]

    def node(k: int) -> tuple[Column, int]:
        if m := re.fullmatch(r"Predict: (\S+)", lines[k]):
            return F.lit(int(float(m[1]))), k + 1
        m = re.fullmatch(r"If \(feature (\d+) <= (\S+)\)", lines[k])
        low, k = node(k + 1)
        high, k = node(k + 1)  # past the line of Else
        return F.when(features[int(m[1])] <= float(m[2]), low).otherwise(high), k

    return node(0)[0]


def main_text(pages: DataFrame, tree: str | None = None) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages`` (page_id, url, html): the blocks that the tree takes for the article's, joined by line feeds.

    Character references are decoded, white space inside a block is one space; ``<br>`` is white space, inline tags are nothing. Null and
    empty html, and pages without article, give an empty text. Repeated rows and null ids are rows like others. Unclosed and misplaced
    tags end with what holds them; an unclosed script takes the rest of its page. Other columns are not looked at; an empty table gives an
    empty result.
    """
    tree = tree or train(labelled_blocks(pages.sparkSession))
    kept = F.filter("blocks", lambda b: tree_column(tree, b["features"]) == 1)
    text = F.array_join(F.transform(kept, lambda b: b["text"]), "\n")
    return blocks(pages).select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
