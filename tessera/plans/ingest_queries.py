"""Queries for crawling, extraction, deduplication and document updates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import urls as U
from ..functions.addresses import is_blocked, ranges_of, with_range
from ..functions.html import extracted
from ..lineage import checkpointed, stored
from ..operators.frontier import crawl_order, start_times
from ..operators.jobs import latest_upsert
from ..operators.lifecycle import crawl_frontier, live_documents, retry_delay, upsert
from ..sources import robots
from .common import Registry, table

register = Registry()

_URL = r"'^(https?)://([^/?#@:]+)(:[0-9]+)?([^?#]*)(\?([^#]*))?(#.*)?$'"
_NORMAL = f"""parts AS (SELECT page_id, url, lower(regexp_extract(url, {_URL}, 1)) AS scheme, lower(regexp_extract(url, {_URL}, 2)) AS host, regexp_replace(regexp_extract(url, {_URL}, 4), '/+', '/', 'g') AS path, regexp_extract(url, {_URL}, 6) AS query FROM pages),
normal AS (SELECT page_id, url, host, path, concat(scheme, '://', host, CASE WHEN path = '' THEN '/' ELSE path END, CASE WHEN query = '' THEN '' ELSE concat('?', array_to_string(list_sort(string_split(query, '&')), '&')) END) AS normalized FROM parts)"""


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").withColumn("normalized", U.normalized_url(F.col("url")))


@register(f"WITH {_NORMAL} SELECT page_id, normalized FROM normal")
def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", "normalized")


@register(
    f"""WITH {_NORMAL}
SELECT page_id, CASE page_id % 8 WHEN 0 THEN concat(site, folder, 'a%20b/c') WHEN 1 THEN concat(site, '/up?b=%C3%BC&q=1') WHEN 2 THEN concat('https://cdn', page_id, '.example.net/x') WHEN 3 THEN concat(site, whole, '?n=', page_id)
  WHEN 4 THEN concat(site, folder) WHEN 5 THEN concat(site, '/last/') WHEN 6 THEN NULL ELSE concat('http://other.example/p?k=a+b') END AS resolved
FROM (SELECT page_id, scheme || '://' || host AS site, CASE WHEN path = '' THEN '/' ELSE path END AS whole, regexp_extract(CASE WHEN path = '' THEN '/' ELSE path END, '^(.*/)', 1) AS folder FROM parts) x"""
)
def url_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of eight kinds against the address of each page."""
    p = F.col("page_id")
    n = p.cast("string")
    link = F.when(p % 8 == 0, "./x/../a b/c#here").when(p % 8 == 1, "/v/../up?q=1&b=ü").when(p % 8 == 2, F.concat(F.lit("https://CDN"), n, F.lit(".example.net:443//x"))).when(p % 8 == 3, F.concat(F.lit("?n="), n)).when(p % 8 == 4, ".")
    link = link.when(p % 8 == 5, "/first/../last/%2e").when(p % 8 == 6, "mailto:someone@example.org").otherwise("http://other.example:80/p?k=a b")
    return table(spark, sf_dir, "pages").select("page_id", U.normalized_url(link, F.col("url")).alias("resolved"))


@register(f"WITH {_NORMAL} SELECT page_id, (host = 'example.com' OR host LIKE '%.example.com') AND NOT path LIKE '%.html' AS allowed FROM normal")
def url_domain_allow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", U.admitted(F.col("url"), ["example.com"], exclude=["**.html"]).alias("allowed"))


@register(f"WITH {_NORMAL} SELECT page_id, substr(sha256(normalized), 1, 32) AS document_id FROM normal")
def doc_id_from_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", U.document_id(F.lit(None).cast("string"), F.col("normalized")).alias("document_id"))


@register()
def html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages")).select("page_id", "title", "language", F.size("headings").alias("n_headings"), "content", F.size("links").alias("n_links"), "content_hash")


@register("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", H.content_hash(F.col("text")).alias("content_hash"))


@register("SELECT doc_id, doc_id = min(doc_id) OVER (PARTITION BY text) AS kept FROM documents")
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    first = docs.groupBy("hash").agg(F.min("doc_id").alias("first"))
    return docs.join(first, "hash").select("doc_id", (F.col("doc_id") == F.col("first")).alias("kept"))


_WORDS = r"""w AS (SELECT page_id, unnest(list_filter(string_split(regexp_replace(lower(html), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '')) AS w FROM pages),
g AS (SELECT page_id, w, count(*) AS n FROM w GROUP BY page_id, w), d AS (SELECT page_id, n, substr(sha256(w), 1, 16) AS h FROM g),
b AS (SELECT page_id, i, sum(CASE WHEN (CAST(concat('0x', substr(h, 2 * (i // 8) + 1, 2)) AS INTEGER) >> (i % 8)) & 1 = 1 THEN n ELSE -n END) AS v FROM d, range(64) t(i) GROUP BY page_id, i)"""


@register(f"WITH {_WORDS} SELECT page_id, CAST(sum(CASE WHEN v >= 0 THEN CASE WHEN i = 63 THEN -9223372036854775808::HUGEINT ELSE (1::HUGEINT << CAST(i AS INTEGER)) END ELSE 0 END) AS BIGINT) AS simhash FROM b GROUP BY page_id")
def simhash64(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.simhash64(table(spark, sf_dir, "pages"), "html")


@register()
def near_dup_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-wins near-duplicate pages by extracted content, in order of page id."""
    # Contents are extracted once; only their hashes and fingerprints are shuffled.
    pages = stored(extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"), only=("content", "content_hash")).drop("url"), "pages")
    unique = H.exact_first(pages.select("page_id", "content_hash"), "content_hash").filter("kept").select("page_id")
    prints = checkpointed(H.simhash64(pages, "content").join(unique, "page_id", "left_semi"))
    prints = checkpointed(H.exact_first(prints, "simhash").filter("kept").drop("kept"))
    near = H.first_wins(prints, H.near_pairs(prints))
    return pages.select("page_id").join(near, "page_id", "left").select("page_id", F.coalesce("kept", F.lit(False)).alias("kept"))


@register(f"WITH {_NORMAL}, h AS (SELECT host, page_id, normalized, row_number() OVER (PARTITION BY host ORDER BY page_id DESC) AS n FROM normal) SELECT host, page_id, normalized FROM h WHERE n = 1")
def latest_page_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_upsert(_pages(spark, sf_dir).withColumn("host", U.host_of(F.col("url"))), ["host"], ["page_id"]).select("host", "page_id", "normalized")


@register("SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN concat(source, '-new') ELSE source END AS source FROM documents UNION ALL SELECT doc_id + 1000000, concat(source, '-new') FROM documents WHERE doc_id % 70 = 0")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    changed = docs.filter("doc_id % 7 = 0").select("doc_id", F.concat("source", F.lit("-new")).alias("source"))
    added = docs.filter("doc_id % 70 = 0").select((F.col("doc_id") + 1000000).alias("doc_id"), F.concat("source", F.lit("-new")).alias("source"))
    return upsert(docs, changed.unionByName(added), "doc_id")


@register("SELECT doc_id, source FROM documents WHERE doc_id % 11 <> 0 AND (source IS NULL OR source <> 'src0')")
def tombstone_live_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.when(F.col("doc_id") % 11 == 0, F.lit("2024-01-01").cast("timestamp")).alias("deleted_at"))
    deleting = spark.createDataFrame([("src0",)], "source string")
    return live_documents(docs, deleting, "source").select("doc_id", "source")


@register("SELECT event_id, CAST(floor(least(2000, 100 * pow(2, event_id % 9)) * 0.75) AS BIGINT) AS delay_ms FROM events")
def retry_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", retry_delay(F.col("event_id") % 9 + 1, 100, 2000, F.lit(0.5)).alias("delay_ms"))


ROBOTS = "User-agent: *\nDisallow: /en/7\nAllow: /en/77\nDisallow: /*.html$\nDisallow: /de\n\nUser-agent: otherbot\nDisallow: /\n"


@register(f"""WITH {_NORMAL} SELECT page_id, CASE WHEN path LIKE '/en/77%' THEN NOT (path LIKE '%.html' AND length('/*.html$') > length('/en/77')) WHEN path LIKE '/en/7%' OR path LIKE '%.html' OR path LIKE '/de%' THEN false ELSE true END AS allowed FROM normal""")
def robots_allow(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = robots.rules(spark.createDataFrame([("all", ROBOTS)], "origin string, body string"))
    urls = _pages(spark, sf_dir).select("page_id", F.lit("all").alias("origin"), F.regexp_replace("normalized", "^https?://[^/]+", "").alias("path"))
    return robots.allows(urls, rules, "testbot/1.0").select("page_id", "allowed")


@register(
    """WITH RECURSIVE links AS (SELECT o_orderkey AS a, (o_orderkey * 7 + o_custkey) % 5000 AS b FROM orders),
bfs AS (SELECT CAST(1 AS BIGINT) AS node, 0 AS depth UNION SELECT b, depth + 1 FROM bfs JOIN links ON a = node WHERE depth < 6)
SELECT node, min(depth) AS depth FROM bfs GROUP BY node"""
)
def crawl_frontier_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("a"), ((F.col("o_orderkey") * 7 + F.col("o_custkey")) % 5000).alias("b"))
    return crawl_frontier(spark.createDataFrame([(1,)], "node long"), links, 6)


_DEPTH, _QUOTA = 5, 700
#: Links of pages, from orders: three of each page, some of them to pages that don't exist or to itself.
_LINKS = "links AS MATERIALIZED (SELECT o_orderkey AS a, (o_orderkey * (k + 3) + o_custkey) % 3000 AS b, k AS at_ FROM orders, range(3) t(k))"


def _generation_sql(g: int) -> str:
    seen = " ".join(f"AND b NOT IN (SELECT node FROM g{k})" for k in range(g))
    return f"""m{g} AS MATERIALIZED (SELECT b AS node, min(ROW(place, at_, depth + 1)) AS x FROM g{g - 1} JOIN links ON a = node WHERE depth < {_DEPTH} {seen} GROUP BY b),
g{g} AS MATERIALIZED (SELECT node, x[3] AS depth, 1 AS attempt, {g} AS generation, row_number() OVER (ORDER BY x[1], x[2], node) - 1 + (SELECT sum(n) FROM ({" UNION ALL ".join(f"SELECT count(*) AS n FROM g{k}" for k in range(g))}) c) AS place FROM m{g} QUALIFY place < {_QUOTA})"""


_ORDER_SQL = f"""WITH {_LINKS},
seeds AS (SELECT c_custkey AS node, 0 AS kind, c_acctbal AS at_, c_custkey % 3 AS depth, 2 AS attempt FROM customer WHERE c_custkey % 29 = 0
  UNION ALL SELECT c_custkey * 3, 1, c_custkey, 0, 1 FROM customer WHERE c_custkey % 31 = 0 UNION ALL SELECT k, 2, k, 0, 1 FROM range(1, 4) t(k)),
s0 AS (SELECT node, min(ROW(kind, at_, depth, attempt)) AS x FROM seeds GROUP BY node),
g0 AS MATERIALIZED (SELECT node, x[3] AS depth, x[4] AS attempt, 0 AS generation, row_number() OVER (ORDER BY x[1], x[2], node) - 1 AS place FROM s0 QUALIFY place < {_QUOTA}),
{", ".join(_generation_sql(g) for g in range(1, _DEPTH + 1))},
crawl AS MATERIALIZED ({" UNION ALL ".join(f"SELECT * FROM g{g}" for g in range(_DEPTH + 1))})"""


def _crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Due retries with their depths, sitemap entries and three starts, over links from orders."""
    k = F.col("o_orderkey")
    links = table(spark, sf_dir, "orders").select(k.alias("a"), F.posexplode(F.array(*((k * (i + 3) + F.col("o_custkey")) % 3000 for i in range(3)))).alias("at", "b"))
    c = F.col("c_custkey")
    own = table(spark, sf_dir, "customer")
    seed = lambda df, node, kind, at, depth, attempt: df.select(node.cast("long").alias("node"), F.lit(kind).alias("kind"), at.cast("double").alias("at"), depth.cast("int").alias("depth"), F.lit(attempt).alias("attempt"))
    seeds = seed(own.filter(c % 29 == 0), c, 0, F.col("c_acctbal"), c % 3, 2).unionByName(seed(own.filter(c % 31 == 0), c * 3, 1, c, F.lit(0), 1)).unionByName(seed(spark.range(1, 4), F.col("id"), 2, F.col("id"), F.lit(0), 1))
    return crawl_order(seeds, links, _DEPTH, _QUOTA)


@register(_ORDER_SQL + " SELECT node, CAST(depth AS INTEGER) AS depth, CAST(attempt AS INTEGER) AS attempt, CAST(generation AS INTEGER) AS generation, CAST(place AS BIGINT) AS place FROM crawl")
def crawl_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _crawl(spark, sf_dir)


@register(
    _ORDER_SQL
    + """, p AS (SELECT node, place, node % 7 AS host, place * 10 AS ready, CASE node % 7 WHEN 0 THEN 100 WHEN 1 THEN 40 WHEN 2 THEN 1000 END AS delay, row_number() OVER (PARTITION BY node % 7 ORDER BY place) - 1 AS turn FROM crawl)
SELECT node, host, CAST(turn AS BIGINT) AS turn, CAST(CASE WHEN delay IS NULL THEN ready ELSE max(ready - turn * delay) OVER (PARTITION BY host ORDER BY turn ROWS UNBOUNDED PRECEDING) + turn * delay END AS BIGINT) AS starts FROM p"""
)
def crawl_start_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When the pages of that crawl start, ten milliseconds after another and no sooner than their hosts' delays allow."""
    pages = _crawl(spark, sf_dir).select("node", (F.col("node") % 7).alias("host"), "place", (F.col("place") * 10).alias("ready"))
    delays = spark.createDataFrame([(0, 100), (1, 40), (2, 1000)], "host long, delay long")
    return start_times(pages, delays, ["place"]).select("node", "host", "turn", "starts")


@register("SELECT page_id, CASE WHEN page_id % 9 = 0 THEN 'unchanged' WHEN page_id % 7 = 0 THEN 'failed' WHEN page_id % 5 = 0 THEN 'skipped' ELSE 'indexed' END AS status FROM pages")
def page_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.lifecycle import page_status as classify

    p = F.col("page_id")
    http = F.when(p % 9 == 0, 304).when(p % 7 == 0, 503).otherwise(200)
    kind = F.when((p % 5 == 0), "application/pdf").otherwise("text/html; charset=utf-8")
    return table(spark, sf_dir, "pages").select("page_id", classify(http, kind, F.lit(False), F.lit(False), F.lit(False)).alias("status"))


@register("SELECT 'v' || CAST(o_custkey % 50 AS VARCHAR) AS index_id, max(o_orderkey) + 1 AS next_sequence FROM orders GROUP BY 1")
def version_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.lifecycle import next_sequence

    v = table(spark, sf_dir, "orders").select(F.concat(F.lit("v"), (F.col("o_custkey") % 50).cast("string")).alias("index_id"), F.col("o_orderkey").alias("sequence"))
    fences = v.select("index_id", F.lit(0).cast("long").alias("minimum_sequence")).distinct()
    return next_sequence(v, fences)


@register("WITH v AS (SELECT o_custkey % 50 AS index_id, o_orderkey AS sequence, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey DESC) AS n FROM orders) SELECT index_id, sequence, CASE n WHEN 1 THEN 'active' WHEN 2 THEN 'retired' ELSE 'ready' END AS state FROM v")
def version_activate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.lifecycle import activate

    v = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("index_id"), F.col("o_orderkey").alias("sequence"))
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("index_id").orderBy(F.desc("sequence")))
    v = v.withColumn("n", n).withColumn("state", F.when(F.col("n") == 2, "active").otherwise("ready"))
    return activate(v.drop("n"), v.filter("n = 1").select("index_id", "sequence")).select("index_id", "sequence", "state")


@register("SELECT doc_id, source FROM documents WHERE source NOT IN ('src1', 'src2')")
def source_erasure(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = spark.createDataFrame([("src1",), ("src2",)], "source string")
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(gone, "source", "left_anti").select("doc_id", "source")


@register(
    """WITH a AS (SELECT user_id % 20 AS origin, ts AS at_, max(CASE WHEN value < 10 THEN 200 WHEN value < 20 THEN 403 WHEN value < 30 THEN 503 WHEN value < 40 THEN 429 ELSE 404 END) AS status FROM events WHERE event_type = 'signup' GROUP BY 1, 2),
f AS (SELECT event_id, user_id % 20 AS origin, ts AS at_ FROM events WHERE event_type <> 'signup')
SELECT event_id, CASE WHEN holds THEN epoch_us(answered) END AS answered_at, CASE WHEN NOT coalesce(holds, false) THEN 'ask' WHEN status BETWEEN 200 AND 299 THEN 'parse' WHEN status IN (401, 403) THEN 'disallow' WHEN status >= 500 OR status = 429 THEN 'abort' ELSE 'allow' END AS policy
FROM (SELECT event_id, a.at_ AS answered, status, f.at_ - a.at_ < INTERVAL 1 HOUR AS holds FROM f ASOF LEFT JOIN a ON f.origin = a.origin AND f.at_ >= a.at_) x"""
)
def robots_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last robots answer of each host, at most an hour old, says of a fetch."""
    v = F.col("value")
    ev = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 20).alias("origin"), F.col("ts").cast("timestamp").alias("at"), "event_type", F.when(v < 10, 200).when(v < 20, 403).when(v < 30, 503).when(v < 40, 429).otherwise(404).alias("status"))
    answers = ev.filter("event_type = 'signup'").select("origin", "at", "status")
    out = robots.policies_at(ev.filter("event_type <> 'signup'").select("event_id", "origin", "at"), answers)
    return out.select("event_id", F.unix_micros("answered_at").alias("answered_at"), "policy")


#: Addresses made of the digits of an event: its numbers, and how they are written.
_OCTETS = "SELECT event_id, user_id % 256 AS a, event_id % 256 AS b, (event_id * 7) % 256 AS c, CASE event_id % 6 WHEN 0 THEN 10 WHEN 1 THEN 172 WHEN 2 THEN 192 WHEN 3 THEN 8 WHEN 4 THEN 203 ELSE 100 END AS top FROM events"


@register(
    f"""WITH o AS ({_OCTETS}), n AS (SELECT *, CAST(top AS BIGINT) * 16777216 + a * 65536 + b * 256 + c AS ip FROM o), r(net, bits) AS (VALUES (167772160, 8), (1681915904, 10), (2886729728, 12), (3221225472, 24), (3221225984, 24), (3223307264, 24), (3224682752, 24), (3227017984, 24), (3232235520, 16), (3232706560, 24), (3405803776, 24))
SELECT event_id, CASE WHEN event_id % 5 = 4 THEN NULL WHEN event_id % 5 = 3 THEN b % 2 = 0 OR a = 0 ELSE EXISTS (SELECT 1 FROM r WHERE (ip >> (32 - bits)) = (net >> (32 - bits))) END AS blocked FROM n"""
)
def blocked_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which addresses a crawler keeps away from: IPv4 and IPv6 ones, and texts that are none."""
    e = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 256).alias("a"), (F.col("event_id") % 256).alias("b"), ((F.col("event_id") * 7) % 256).alias("c"))
    k = F.col("event_id")
    top = F.when(k % 6 == 0, 10).when(k % 6 == 1, 172).when(k % 6 == 2, 192).when(k % 6 == 3, 8).when(k % 6 == 4, 203).otherwise(100)
    four = F.concat_ws(".", top.cast("string"), F.col("a").cast("string"), F.col("b").cast("string"), F.col("c").cast("string"))
    # Even ones are local (fd00::/8), odd ones public below 2a00::/12 unless they are written as mapped.
    six = F.when(F.col("a") == 0, F.concat(F.lit("::ffff:"), four)).otherwise(F.concat(F.when(F.col("b") % 2 == 0, "fd00:").otherwise("2a00:"), F.lower(F.hex("a")), F.lit("::"), F.lower(F.hex("c"))))
    text = F.when(k % 5 == 4, "not.an.address").when(k % 5 == 3, six).otherwise(four)
    return e.select("event_id", is_blocked(text).alias("blocked"))


_NETS = [("10.0.0.0/8", "ten"), ("10.1.0.0/16", "ten.one"), ("10.1.128.0/17", "ten.one.high"), ("172.0.0.0/7", "wide"), ("192.0.0.0/3", "high"), ("0.0.0.0/0", "any")]


@register(
    f"""WITH o AS ({_OCTETS}), n AS (SELECT event_id, CAST(top AS BIGINT) * 16777216 + a * 65536 + b * 256 + c AS ip FROM o),
r(net, bits, name) AS (VALUES (167772160, 8, 'ten'), (167837696, 16, 'ten.one'), (167870464, 17, 'ten.one.high'), (2885681152, 7, 'wide'), (3221225472, 3, 'high'), (0, 0, 'any'))
SELECT event_id, arg_max(name, bits) AS range FROM n JOIN r ON (ip >> (32 - bits)) = (net >> (32 - bits)) GROUP BY event_id"""
)
def address_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The narrowest of some ranges that holds each address."""
    k = F.col("event_id")
    top = F.when(k % 6 == 0, 10).when(k % 6 == 1, 172).when(k % 6 == 2, 192).when(k % 6 == 3, 8).when(k % 6 == 4, 203).otherwise(100)
    e = table(spark, sf_dir, "events").select("event_id", F.concat_ws(".", top.cast("string"), (F.col("user_id") % 256).cast("string"), (k % 256).cast("string"), ((k * 7) % 256).cast("string")).alias("address"))
    return with_range(e, "address", ranges_of(spark, _NETS)).select("event_id", "range")
