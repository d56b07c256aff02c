"""The queries ``opN_<name>`` over the driver's tables: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import decontaminate, divergence, jaccard_join, linededup, maintext, mixing, pointintime, quality, sharding, toxicity, urlfilter, warc, winnow


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), free_ends=True)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).drop("row_key")


def op3_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.compare_with_next(_table(spark, sf_dir, "documents"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_table(spark, sf_dir, "documents"), size=5, similarity="0.8")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).drop("source", "copies")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_digest(_table(spark, sf_dir, "documents"), shards=8)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(_table(spark, sf_dir, "pages"))


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = toxicity.fit(toxicity.labelled_texts(docs, labels.filter(~held_out)))
    scored = toxicity.score(docs, *model, "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintext.main_text(_table(spark, sf_dir, "pages"))


def op12_point_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pointintime.features(*[_table(spark, sf_dir, t) for t in ("clicks", "sales", "sale_lines")])


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_decontaminate,
        op2_quality,
        op3_winnow,
        op4_jaccard_join,
        op5_mixing,
        op6_sharding,
        op7_url_filter,
        op8_warc_revisits,
        op9_toxicity,
        op10_line_dedup,
        op11_main_text,
        op12_point_in_time,
        op13_divergence,
    )
}
#: SQL for the operators whose results SQL can express; the others are tested against brute force.
ORACLE_SQL: dict[str, str] = {
    "op12_point_in_time": r"""with s as (select client_id, sale_id, epoch_us(sold_at) as sold, epoch_us(arrived_at) + 14400000000 as seen, coalesce(cast(floor(100 * total + 0.5) as bigint), 0) as cents
from sales where client_id is not null and sold_at is not null),
crc as (select n, list_reduce(list_prepend(n, range(0, 8)), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c from range(0, 256) t(n)),
tab as (select list(c order by n) as tab from crc),
p as (select client_id, sale_id, sold + (xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(cast(sale_id as varchar), ''), lambda ch: ascii(ch)::bigint)), lambda c, b: xor(c >> 8, tab[cast(xor(c, b) & 255 as int) + 1])), 4294967295::bigint) % 259200) * 1000000 as t
from s, tab),
w as (select client_id, sale_id, t, d, t - d * 86400000000 as since from p, (values (2), (14)) v(d)),
c as (select client_id, click_id, epoch_us(ts) as ts, epoch_us(arrived_at) + 14400000000 as seen, kind, coalesce(cast(floor(100 * value + 0.5) as bigint), 0) as cents from (select distinct * from clicks)),
fc as (select w.sale_id, w.d, count(*) as n_clicks, count(*) filter (kind = 'purchase') as n_purchases, cast(sum(cents) as bigint) as click_cents, arg_max(click_id, struct_pack(ts := ts, i := click_id)) as last_click_id
from w join c on c.client_id = w.client_id and c.ts > w.since and c.ts <= w.t and c.seen <= w.t group by 1, 2),
fs as (select w.sale_id, w.d, count(*) as n_sales, cast(sum(cents) as bigint) as sale_cents from w join s on s.client_id = w.client_id and s.sold > w.since and s.sold <= w.t and s.seen <= w.t group by 1, 2),
l as (select s.client_id, s.sold, greatest(s.seen, epoch_us(shipped_at)) as seen, item_id, coalesce(cast(floor(100 * amount + 0.5) as bigint), 0) as cents from sale_lines x join s on s.sale_id = x.sale_id where s.seen is not null and shipped_at is not null),
fl as (select w.sale_id, w.d, count(*) as n_lines, count(distinct item_id) as n_items, cast(sum(cents) as bigint) as line_cents from w join l on l.client_id = w.client_id and l.sold > w.since and l.sold <= w.t and l.seen <= w.t group by 1, 2),
n as (select distinct p.sale_id from p join s on s.client_id = p.client_id and s.sold > p.t and s.sold <= p.t + 7 * 86400000000)
select w.sale_id, w.d, w.t as t_us, n.sale_id is not null as label, coalesce(n_clicks, 0) as n_clicks, coalesce(n_purchases, 0) as n_purchases, coalesce(click_cents, 0) as click_cents, last_click_id,
coalesce(n_sales, 0) as n_sales, coalesce(sale_cents, 0) as sale_cents, coalesce(n_lines, 0) as n_lines, coalesce(n_items, 0) as n_items, coalesce(line_cents, 0) as line_cents
from w left join fc using (sale_id, d) left join fs using (sale_id, d) left join fl using (sale_id, d) left join n using (sale_id)""",
    "op13_divergence": r"""with d as (select row_number() over () as r, coalesce(text, '') as text, coalesce(lang, '') as lang, coalesce(source, '') as source from documents),
w as (select r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
k as (select lang, term, cast(count(*) as bigint) as lang_n from w group by 1, 2 having count(distinct r) >= 30),
g as (select distinct lang, source from d), v as (select lang, cast(count(*) as bigint) as v, cast(sum(lang_n) as bigint) as lang_total from k group by 1),
c as (select lang, source, term, cast(count(*) as bigint) as n from w group by 1, 2, 3),
s as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, k.lang_n, v.v, v.lang_total, sum(coalesce(c.n, 0)) over (partition by g.lang, g.source) as total
from g join k using (lang) join v using (lang) left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
p as (select lang, source, term, n, cast(1 + 1000000000 * (n + 5)::hugeint // (total + 5 * v)::hugeint as bigint) as p, cast(1 + 1000000000 * (lang_n + 5)::hugeint // (lang_total + 5 * v)::hugeint as bigint) as q from s),
f as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item, cast(coalesce(f.value, 0) as bigint) as value from g a join g b on a.lang = b.lang and a.source <> b.source
left join f on f.lang = a.lang and f.source = a.source and f.item = b.source),
rows as (select * from pairs union all select lang, source, 'term', term, p - q from p where n > 0 and p > q),
ranked as (select *, cast(row_number() over (partition by lang, source, part order by value desc, encode(item)) as int) as rank from rows)
select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= 50""",
    "op4_jaccard_join": r"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select doc_id, case when len(ws) >= 5 then list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' '))) when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end as sh from w),
n as (select doc_id, cast(len(sh) as bigint) as n_shingles from s), e as (select doc_id, unnest(sh) as g from s),
c as (select a.doc_id as x, b.doc_id as y, count(*) as k from e a join e b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select x, y from c join n p on x = p.doc_id join n q on y = q.doc_id where 100 * k >= 80 * (p.n_shingles + q.n_shingles - k)),
b as (select x, y from l union select y, x from l),
reach(doc_id, other) as (select doc_id, doc_id from n union select r.doc_id, b.y from reach r join b on r.other = b.x)
select doc_id, any_value(n_shingles) as n_shingles, min(other) as component_id from n join reach using (doc_id) group by doc_id""",
    # Links with dot segments and pages with <base>, which these tables lack, are held against brute force in the tests.
    "op7_url_filter": r"""with recursive q as (select page_id, url, html, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path from pages),
p as (select *, case when contains(url, '://') then lower(regexp_extract(url, '(?s)^(.*?)://', 1)) || '://' || host || regexp_extract(url, '(?s)^.*?://[^/?#]*([^#]*)', 1) end as node from q),
tags as (select node, url, path, unnest([regexp_extract(regexp_extract(html, '(?is)(<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>)', 1), '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1),
regexp_extract(regexp_extract(html, '(?is)(<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>)', 1), '(?is)\burl\s*=\s*["'']?([^"''\s>;]+)', 1)]) as t from p where node is not null),
named as (select node, url, path, regexp_replace(t, '&(?:amp|#38|#[xX]26);', '&', 'g') as t from tags where t <> '' and not starts_with(t, '#')),
full_urls as (select node, case when regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') then t when starts_with(t, '//') then regexp_extract(url, '(?s)^(.*?)://', 1) || ':' || t
when starts_with(t, '/') then regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || t when starts_with(t, '?') then regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || path || t
else regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || coalesce(nullif(regexp_extract(path, '(?s)^(.*/)', 1), ''), '/') || t end as t from named),
e as (select node as u, lower(regexp_extract(t, '(?s)^(.*?://[^/?#]*)', 1)) || regexp_extract(t, '(?s)^.*?://[^/?#]*([^#]*)', 1) as v from full_urls where contains(t, '://')),
links as (select u, v from e union select v, u from e),
rules(verdict, h, t) as (values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
ends as (select distinct u, regexp_extract(u, '(?s)^.*?://([^/?#]*)', 1) as host, regexp_extract(u, '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path from links),
judged as (select u, arg_max(verdict, length(h || t)) as verdict from ends join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, t) group by u),
hit(u) as (select u from judged where verdict = 'block' union select links.v from hit join links using (u)),
found as (select page_id, url, arg_max(struct_pack(rule := h || t, verdict := verdict), length(h || t)) as r from p join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, t) group by 1, 2)
select p.page_id, p.host, p.path, found.r.rule as rule, coalesce(found.r.verdict, case when p.node in (select u from hit) then 'block' else 'allow' end) as verdict
from p left join found on p.page_id = found.page_id and p.url = found.url""",
    "op8_warc_revisits": r"""with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h, max(page_id) over (partition by coalesce(html, '')) as original from pages),
d as (select page_id, html, original, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast((cast('0x' || substr(h, cast(1 + 5 * (i // 4) as int), 5) as bigint) >> (5 * (3 - i % 4))) & 31 as int) + 1, 1)), '') as payload_digest from p)
select page_id, cast(octet_length(encode(html)) as bigint) as payload_bytes, payload_digest, case when page_id = original then 'response' else 'revisit' end as record_type,
case when page_id <> original then original end as refers_to from d""",
}
