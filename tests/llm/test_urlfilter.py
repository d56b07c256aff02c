import random
import re
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import duckdb

from sparkloom.llm import urlfilter
from sparkloom.llm.queries import ORACLE_SQL, QUERIES


def parts(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    return (m[1].lower() if m[1].isascii() else m[1], m[2]) if m else ("", "")


def rule(host, path):
    fit = [(len(h) + len(p), h + p, v) for v, h, p in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit) if fit else None


class Links(HTMLParser):
    """The first base, canonical link and refresh target of a page."""

    def __init__(self, html):
        super().__init__()
        self.base = self.canonical = self.refresh = None
        self.feed(html or "")

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "base":
            self.base = self.base or a.get("href")
        elif tag == "link" and a.get("rel", "").lower() == "canonical":
            self.canonical = self.canonical or a.get("href")
        elif tag == "meta" and a.get("http-equiv", "").lower() == "refresh" and "url=" in a.get("content", "").lower():
            self.refresh = self.refresh or re.split("(?i)url=", a["content"], maxsplit=1)[1].strip("'\" ")


def node(url):
    m = re.match(r"(?s)^(.*?)://([^/?#]*)([^#]*)", url or "")
    return f"{m[1].lower()}://{m[2].lower()}{m[3]}" if m else None


def brute(pages, extra=()):
    """pages: page_id, url, html. URLs are resolved by urllib and tags read by an HTML parser."""
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    edges = [(node(a), node(b)) for a, b in extra]
    for _, u, html in pages:
        if not node(u):
            continue
        found = Links(html)
        base = urljoin(u, found.base) if found.base else u
        edges += [(node(u), node(urljoin(base, to))) for to in (found.canonical, found.refresh) if to and not to.startswith("#")]
    for a, b in edges:
        if a and b:
            parent[root(a)] = root(b)
    hit = {root(x) for x in list(parent) if (rule(*parts(x)) or (0, 0, 0))[2] == "block"}
    out = set()
    for i, u, _ in pages:
        found = rule(*parts(u))
        out.add((i, *parts(u), found and found[1], found[2] if found else "block" if node(u) in parent and root(node(u)) in hit else "allow"))
    return out


def test_query_matches_brute_force(spark):
    d = "/root/testdata/sf0.1"
    pages = [tuple(r) for r in spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url", "html").collect()]
    got = {tuple(r) for r in QUERIES["op7_url_filter"](spark, d).collect()}
    assert got == brute(pages)
    assert all(urlsplit(u).hostname == h for i, u, _ in pages for j, h, *_ in list(got)[:50] if i == j)


def linked_pages():
    """Pages with canonical links, refreshes and bases of every form, some of which lead to blocked URLs."""
    rng = random.Random(3)
    hosts = ["a.net", "b.net", "c.net:8080", "WWW.d.net", "e.org", "bad.com", "x.example.org"]
    forms = ["/de/home", "/en/1", "../up", "./here", "next.html", "?q=1&amp;r=2", "#top", "//bad.com/de/z", "//F.net/x#y", "http://bad.com/de/home", "HTTPS://g.net/", "mailto:x@y.z", "a/../../b/./c", "..", "/fr/1"]
    pages = []
    for i in range(400):
        url = f"http{'s' * rng.randrange(2)}://{rng.choice(hosts)}{rng.choice(['', '/', '/de/home', '/p/q/r', f'/u{i % 60}', f'/u{i % 50}?id={i % 3}#f'])}"
        q = rng.choice(["'", '"'])
        tags = [
            f"<LINK href={q}{rng.choice(forms)}{q} rel={q}canonical{q} />" if rng.random() < 0.5 else "",
            f"<meta http-equiv={q}Refresh{q} content={q}0; url={rng.choice(forms)}{q}>" if rng.random() < 0.3 else "",
            f"<base href={q}{rng.choice(['/base/dir/', 'http://h.net/k/l'])}{q}>" if rng.random() < 0.2 else "",
        ]
        pages.append((i, url, "<html><head>" + "".join(tags) + "</head>text</html>"))
    return pages


def test_links_of_every_form_match_brute_force(spark):
    pages = linked_pages()
    got = {tuple(r) for r in urlfilter.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == brute(pages)
    assert {"allow", "block"} == {v for *_, r, v in got if r is None}


def test_sql_reads_links(spark, tmp_path):
    """The query's SQL on pages with links, without the forms that it leaves to brute force."""
    pages = [p for p in linked_pages() if "<base" not in p[2] and not re.search(r"[=\"'/]\.\.?[/\"'u]|/\.\.?/|\.\.", p[2])]
    assert len(pages) > 150
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/all")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{tmp_path}/all/*.parquet')")
    cur = con.execute(ORACLE_SQL["op7_url_filter"])
    assert [c[0] for c in cur.description] == ["page_id", "host", "path", "rule", "verdict"]
    assert set(cur.fetchall()) == brute(pages)


def test_relative_links_and_queries_join_nothing_else(spark):
    pages = [
        (1, "http://good.net/x", '<link rel="canonical" href="/de/home">'), (2, "http://bad.com/de/y", '<link rel="canonical" href="/de/home">'),
        (3, "http://shop.net/view?id=1", ""), (4, "http://shop.net/view?id=2", '<link rel="canonical" href="http://bad.com/de/y">'),
    ]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in urlfilter.judge(frame).collect()}
    assert got == {1: "allow", 2: "block", 3: "allow", 4: "block"}
    assert {r["page_id"]: r["verdict"] for r in urlfilter.judge(frame, variants=True).collect()} == {1: "allow", 2: "block", 3: "block", 4: "block"}


def test_aliases_precedence_and_edge_cases(spark):
    far = "http://a.net/x"
    pages = [
        (1, far, '<link href="https://b.net/start" rel=canonical>'), (13, "https://b.net/start", ""),
        (2, "https://www.b.net/start/", None),
        (3, "https://c.net/m", '<META http-equiv="Refresh" content="0; url=http://spam.com/de/q">'),
        (4, "https://c.org/m", '<link rel="canonical" href="http://spam.com/de/q">'),
        (5, None, "x"), (6, "no host", "x"), (7, "://", None), (8, "https://WWW.Example.ORG/en/12?x#y", ""), (9, "https://example.org/en/2", ""),
        (10, "http://other.net/", ""), (10, "http://other.net/", ""), (None, "http://fr.com/fr/1", ""), (11, "HTTP://M.spam.com/de", "a"),
        (12, "http://free.net/page.html", ""),
    ]
    schema = "page_id long, url string, html string, host string, u int, component string"
    frame = spark.createDataFrame([(*p, "h", 1, "c") for p in pages], schema)
    redirects = spark.createDataFrame([("http://a.net/x", "http://s.com/de/z"), (None, "x"), ("http://free.net/page", "http://free.net/page"), ("https://WWW.b.net/start/#x", "https://b.net/start")], "u string, v string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge(frame, redirects=redirects).collect()}
    assert got[1] == ("a.net", "/x", None, "block") and got[2] == ("www.b.net", "/start/", None, "block")
    assert got[3][3] == "block" and got[4] == ("c.org", "/m", "org/", "allow")
    assert got[5] == got[6] == got[7] == ("", "", None, "allow")
    assert got[8] == ("www.example.org", "/en/12", "example.org/en/1", "block") and got[9] == ("example.org", "/en/2", "org/", "allow")
    assert got[10][3] == "allow" and got[None] == ("fr.com", "/fr/1", "com/fr/", "allow") and got[11][2:] == (None, "allow") and got[12][3] == "allow"
    assert urlfilter.judge(frame, redirects=redirects).count() == len(pages)
    assert urlfilter.judge(frame.limit(0)).count() == 0
