import random
import re
from html.parser import HTMLParser

import pytest

from sparkloom.llm import maintext
from sparkloom.llm.queries import QUERIES

SCHEMA = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def tree(spark):
    return maintext.train(maintext.labelled_blocks(spark))


def run(spark, tree, pages):
    got = maintext.main_text(spark.createDataFrame([(k, f"u{k}", h) for k, h in enumerate(pages)], SCHEMA), tree).collect()
    assert all(r.n_chars == len(r.text) for r in got)
    return [r.text for r in sorted(got, key=lambda r: r.page_id)]


class Article(HTMLParser):
    """The text inside <article>, block by block, by another parser."""

    def __init__(self):
        super().__init__()
        self.inside, self.parts = False, [""]

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        self.parts += [""] if tag in ("p", "h1", "article") else []
        self.parts[-1] += " " if tag == "br" else ""

    def handle_endtag(self, tag):
        self.parts += [""] if tag in ("p", "h1", "article") else []
        self.inside &= tag != "article"

    def handle_data(self, data):
        self.parts[-1] += data if self.inside else ""


def test_query_finds_the_articles_of_all_pages(spark):
    d = "/root/testdata/sf0.001"
    got = {r.page_id: r for r in QUERIES["op11_main_text"](spark, d).collect()}
    pages = spark.read.parquet(f"{d}/pages.parquet").collect()
    assert len(got) == len(pages)
    for r in pages:
        parser = Article()
        parser.feed(r.html)
        parser.close()
        want = "\n".join(x for x in (" ".join(p.split()) for p in parser.parts) if x)
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (want, len(want), r.url)


def words(r, n):
    return " ".join(r.choice(["alpha", "béta", "gam&amp;ma", "dé&eacute;", "sentence.", "the", "of"]) for _ in range(n))


#: Layouts that the labelled table has not: m(n) is a paragraph of the article, b(n) any other text.
LAYOUTS = [
    lambda m, b: f"<div class='topNav'><a href=/>{b(1)}</a></div><div id='page'><div class='post-entry'>{m(40)}{m(1)}<div class='promoBox'>{b(15)}</div>{m(12)}</div><div id='respond'>{b(60)}</div></div>",
    lambda m, b: f"<header id=masthead><h1>{b(3)}</h1></header><main><article>{m(3)}{m(70)}<form action=/s><p>{b(20)}<button>{b(1)}</button></form>{m(2)}</article></main><div role=complementary>{b(50)}</div>",
    lambda m, b: f"<body><div class=wrap><ul id=mainmenu><li><a>{b(2)}</a><li><a>{b(1)}</a></ul><section itemprop=articleBody>{m(30)}{m(5)}{m(44)}</section><section id=disqus_thread><div>{b(80)}</div></section></div>",
    lambda m, b: f"<div role=dialog class=gdpr>{b(60)}</div><article class=story>{m(8)}<aside class=pull>{b(25)}</aside>{m(25)}<nav>{b(4)}</nav>{m(1)}</article><footer><div>{b(40)}</div></footer>",
    lambda m, b: f"<p><a href=a>{b(3)}</a> <a href=b>{b(2)}</a><p><a href=c>{b(1)}</a>{m(60)}{m(25)}{m(40)}<p><a href=d>{b(6)}</a>",
    lambda m, b: f"<article>{m(20)}<ol class='commentlist'><li><article class='comment'>{b(55)}</article></ol></article><div class='newsletter-signup'>{b(22)}</div>",
    lambda m, b: f"<div class='wrap with-sidebar hasMenu'><div class='content has-sidebar'>{m(33)}{m(2)}</div><div class=sidebar-right>{b(50)}</div></div><section class=comments><article><p>{b(40)}</p></article></section>",
    lambda m, b: f"<div class=x1><a href=a>{b(2)}</a> <a href=b>{b(1)}</a></div><div class=x2>{m(70)}{m(3)}{m(55)}{m(1)}{m(48)}</div><div class=x3><a href=c>{b(3)}</a></div>",
    lambda m, b: f"<div id=menuWrapper><ul><li>{b(1)}</ul><main>{m(45)}{m(4)}</main></div><div class='relatedPosts'><article><h2>{b(5)}</h2><p>{b(30)}</p></article></div>",
]


@pytest.mark.parametrize("layout", range(len(LAYOUTS)))
def test_layouts_that_the_table_has_not(spark, tree, layout):
    r, pages, wants = random.Random(layout), [], []
    for _ in range(10):
        want = []

        def m(n, want=want):
            t = words(r, n)
            want.append(t.replace("&amp;", "&").replace("&eacute;", "é"))
            return f"<p>{t}</p>"

        pages.append("<!DOCTYPE html><style>p{}</style>" + LAYOUTS[layout](m, lambda n: words(r, n).replace("the", "NOT")))
        wants.append("\n".join(want))
    assert run(spark, tree, pages) == wants


def test_broken_empty_and_odd_pages(spark, tree):
    pages = [
        None,
        "",
        "<article>",
        "<article><p>a <b>b<br>c<p class=ad>" + "x " * 30 + "<p>d &amp;lt; &copy; &nbsp; e</article>",
        "<article><p>one<script>var a = '<p>two</p>';</script> three <!-- <p>four</p> --> five<p>six < seven",
        "<article><p title='a > b' class=\"x\">kept</p></div></section>end</article><script>never closed <p>gone",
        "<article><p>" + "long word " * 100_000 + "</p></article>",
        "<article><ul><li>1<li>2<ul><li>3</ul></ul><table><tr><td>4<td>5<tr><td>6</table></article>",
        "\x00<article>퟿𝕏 ﬁ</article",
    ]
    got = run(spark, tree, pages)
    assert got[:3] == ["", "", ""]
    assert got[3] == "a b c\nd &lt; © e"
    assert got[4] == "one three five\nsix < seven"
    assert got[5] == "kept\nend"
    assert got[6] == ("long word " * 100_000).strip()
    assert got[7] == "1\n2\n3\n4\n5\n6"
    assert got[8] == "퟿𝕏 ﬁ</article"


def test_repeated_null_and_clashing_rows_and_an_empty_table(spark, tree):
    rows = [(1, "u", "<article><p>x</p></article>")] * 2 + [(None, None, None)]
    pages = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as blocks", "2 as text", "3 as n_chars", "4 as features")
    assert sorted(map(str, (tuple(r) for r in maintext.main_text(pages, tree).collect()))) == ["(1, 'u', 'x', 1)"] * 2 + ["(None, None, '', 0)"]
    assert not maintext.main_text(spark.createDataFrame([], SCHEMA), tree).collect()


def test_the_tree_column_is_the_tree_and_fits_its_table(spark, tree):
    table = maintext.labelled_blocks(spark).select("features", "label", maintext.tree_column(tree, maintext.F.col("features")).alias("said")).collect()
    assert sum(r.said == r.label for r in table) >= 0.95 * len(table) and len({r.label for r in table}) == 2

    def walk(lines, f):
        """The text form of the tree, followed line by line."""
        depth = 0
        while not lines[depth].strip().startswith("Predict"):
            m = re.search(r"feature (\d+) <= (\S+)\)", lines[depth])
            indent = len(lines[depth]) - len(lines[depth].lstrip())
            depth += 1 if f[int(m[1])] <= float(m[2]) else 1 + next(k for k, x in enumerate(lines[depth + 1 :]) if x[:indent] == " " * indent and x[indent:].startswith("Else")) + 1
        return float(lines[depth].split()[-1])

    lines = [x for x in tree.splitlines()[1:] if x.strip()]
    assert all(walk(lines, r.features) == r.said for r in table)
