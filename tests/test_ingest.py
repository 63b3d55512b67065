"""Crawling pieces: addresses, robots rules, sitemaps, pages, retries, duplicates."""

import datetime
import gzip

import pytest
from pyspark.sql import functions as F

from tessera.functions import urls as U
from tessera.functions.hashing import first_wins, near_pairs, simhash64
from tessera.functions.html import extract_page
from tessera.operators import analytics as A
from tessera.operators.evaluation import macro_metrics
from tessera.operators.lifecycle import retry_after_ms, retry_delay
from tessera.sources import robots
from tessera.sources.sitemap import crawl_sitemaps, parse_sitemap


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first().x if values else spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "url,expected",
    [
        ("HTTP://Shop.Example.ORG:80//x///y?q=2&c=1#top", "http://shop.example.org/x/y?c=1&q=2"),
        ("https://shop.example.org:8443", "https://shop.example.org:8443/"),
        ("mailto:someone@shop.example.org", None),
        ("https://me@shop.example.org/x", None),
        ("http://shop.example.org/x/?ref=mail", "http://shop.example.org/x/?ref=mail"),
    ],
)
def test_normalized_url(spark, url, expected):
    assert one(spark, U.normalized_url(F.lit(url))) == expected


def test_domains(spark):
    assert one(spark, U.allowed_domain(F.lit("https://sub.news.example/"), ["news.example"]))
    assert not one(spark, U.allowed_domain(F.lit("https://notnews.example/"), ["news.example"]))
    assert not one(spark, U.allowed_domain(F.lit("https://news.example/"), []))


RULES = [
    ("/fish", "/fish.html", False), ("/fish", "/Fish", True), ("/fish*", "/fishheads", False), ("/*.php", "/a/b.php?x", False), ("/*.php$", "/a.php", False),
    ("/*.php$", "/a.php?x", True), ("/fish*.php", "/fishheads/catfish.php?p", False), ("/", "/x", False), ("", "/x", True), ("/$", "/", False), ("/$", "/x", True),
]


def test_robots_rules(spark):
    bodies = [(f"o{i}", f"User-agent: *\nDisallow: {rule}\n") for i, (rule, _, _) in enumerate(RULES)]
    table = robots.rules(spark.createDataFrame(bodies, "origin string, body string"))
    urls = spark.createDataFrame([(f"o{i}", p) for i, (_, p, _) in enumerate(RULES)], "origin string, path string")
    got = {r.origin: r.allowed for r in robots.allows(urls, table, "bot").collect()}
    assert got == {f"o{i}": ok for i, (_, _, ok) in enumerate(RULES)}


def test_robots_agents_and_ties(spark):
    body = "User-agent: *\nDisallow: /\n\nUser-agent: special\nAllow: /a\nDisallow: /a\nCrawl-delay: 3\nSitemap: https://x/s.xml\n"
    table = robots.rules(spark.createDataFrame([("o", body)], "origin string, body string"))
    urls = spark.createDataFrame([("o", "/a"), ("o", "/b")], "origin string, path string")
    assert {r.path: r.allowed for r in robots.allows(urls, table, "SpecialBot/2").collect()} == {"/a": True, "/b": True}
    assert {r.path: r.allowed for r in robots.allows(urls, table, "other").collect()} == {"/a": False, "/b": False}
    assert robots.crawl_delay(table, "special").first().crawl_delay == 3
    assert table.filter("sitemap IS NOT NULL").first().sitemap == "https://x/s.xml"


def test_sitemaps():
    urls = b"<urlset xmlns='http://www.sitemaps.org/schemas/sitemap/0.9'><url><loc> https://x/a </loc><lastmod>2024-01-01</lastmod><priority>0.5</priority></url></urlset>"
    assert parse_sitemap(gzip.compress(urls)) == ("urlset", [{"loc": "https://x/a", "lastmod": "2024-01-01", "priority": 0.5}])
    index = b"<sitemapindex><sitemap><loc>https://x/1.xml</loc></sitemap></sitemapindex>"
    assert crawl_sitemaps(["https://x/i.xml"], {"https://x/i.xml": index, "https://x/1.xml": urls}.get) == ["https://x/a"]
    with pytest.raises(ValueError):
        parse_sitemap(b"<!DOCTYPE x [<!ENTITY a 'b'>]><urlset/>")
    with pytest.raises(ValueError):
        parse_sitemap(gzip.compress(b"a" * (11 << 20)))


def test_extraction():
    html = """<html lang="EN-us"><head><title> T  x </title><meta name="description" content="d  e"><meta name="author" content="me"><meta property="og:title" content="og">
    <link rel="canonical" href="/canon"><script type="application/ld+json">{"a": 1}</script><script>var x = "</p>";</script></head>
    <body><header><h1>gone</h1></header><main><h1>One</h1><p>whea.<br><p>By <a href="b?c#d">l</a><div hidden>no</div><span style="display: none">no</span></p><h2> Two </h2></main><footer>f</footer><a href="mailto:x">m</a></body></html>"""
    p = extract_page(html, "https://h.example/x/y")
    assert p["title"] == "T x" and p["language"] == "en" and p["description"] == "d e"
    assert p["content"] == "Onewhea.By l Two" and p["headings"] == ["One", "Two"]
    assert p["canonical_url"] == "https://h.example/canon" and p["links"] == ["https://h.example/x/b?c#d"]
    assert p["open_graph"] == '{"og:title": "og"}' and p["structured_data"] == '[{"a": 1}]' and p["metadata"] == '{"author": "me"}'
    assert extract_page(None, None)["content"] == ""


def test_retries(spark):
    delays = spark.createDataFrame([(1,), (3,), (6,)], "n int").select(retry_delay(F.col("n"), 250, 3000, F.lit(1.0)).alias("d"))
    assert [r.d for r in delays.collect()] == [250, 1000, 3000]
    now = F.lit("2024-02-29 12:00:00").cast("timestamp")
    values = ["7", "Thu, 29 Feb 2024 12:00:05 GMT", "1.5", "soon", None]
    got = spark.createDataFrame([(v,) for v in values], "h string").select(retry_after_ms(F.col("h"), now).alias("m")).collect()
    assert [r.m for r in got] == [7000, 5000, None, None, None]


def test_quota_and_expiry(spark):
    used = spark.createDataFrame([(37, 50), (38, 50), (49, 50), (50, 50), (61, 50), (5, 0), (0, 0), (5, None)], "used int, quota int")
    got = used.select(A.alert_state(F.col("used"), F.col("quota"), F.lit(75)).alias("a"), A.quota_status(F.col("used"), F.col("quota"), F.lit(75)).alias("s"), A.quota_percent(F.col("used"), F.col("quota")).alias("p")).collect()
    assert [r.a for r in got] == ["none", "warning", "warning", "exceeded", "exceeded", "none", "none", "none"]
    # A limit of 0 is exceeded, only no limit is unlimited.
    assert [(r.s, r.p) for r in got] == [("ok", 74.0), ("warning", 76.0), ("warning", 98.0), ("exceeded", 100.0), ("exceeded", 100.0), ("exceeded", 100.0), ("exceeded", 100.0), ("unlimited", None)]
    days = ["2026-10-12", "2026-10-06 12:00:00", "2026-10-05 12:00:00", "2026-10-04", "2026-10-20"]
    got = spark.createDataFrame([(d,) for d in days], "d string").select(A.expiry_bucket(F.col("d").cast("timestamp"), F.lit("2026-10-06").cast("timestamp")).alias("b")).collect()
    assert [r.b for r in got] == ["7d", "1d", "expired", "none", "none"]


def test_metrics(spark):
    judged = spark.createDataFrame([("q1", "a", 3), ("q2", "b", 3), ("q3", "c", 1)], "query_id string, doc_id string, grade int")
    hits = spark.createDataFrame([("q1", "a", 1), ("q2", "x", 1), ("q2", "b", 2)], "query_id string, doc_id string, rank int")
    m = macro_metrics(hits, judged).first()
    assert (m.precision_at_5, m.recall_at_5, m.mrr_at_5) == (0.1333, 0.6667, 0.5)
    assert m.ndcg_at_5 == round((1 + 0.63093) / 3, 4)


def test_first_wins_is_in_order(spark):
    prints = spark.createDataFrame([(1, 0), (2, 0b111), (3, 0b111111), (4, -1)], "page_id long, simhash long")
    kept = {r.page_id: r.kept for r in first_wins(prints, near_pairs(prints)).collect()}
    assert kept == {1: True, 2: False, 3: True, 4: True}


def test_near_pairs_and_first_wins_by_brute_force(spark):
    import random

    rng = random.Random(7)
    prints = {}
    for i in range(160):
        base = rng.choice(list(prints.values())) if prints and rng.random() < 0.7 else rng.getrandbits(64)
        for bit in rng.sample(range(64), rng.randint(0, 4)):
            base ^= 1 << bit
        if base not in prints.values():
            prints[i] = base
    df = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in prints.items()], "page_id long, simhash long")
    pairs = near_pairs(df).persist()
    near = {(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3}
    assert {(r.a, r.b) for r in pairs.collect()} == near and len(near) > 50
    kept = set()
    for i in sorted(prints):
        if not any((k, i) in near for k in kept):
            kept.add(i)
    assert {r.page_id for r in first_wins(df, pairs).collect() if r.kept} == kept


def test_simhash_of_nothing(spark):
    rows = simhash64(spark.createDataFrame([(1, None), (2, ""), (3, "one two two")], "page_id long, t string"), "t").collect()
    got = {r.page_id: r.simhash for r in rows}
    import hashlib

    votes = [0] * 64
    for w in ("one", "two", "two"):
        d = hashlib.sha256(w.encode()).digest()
        for i in range(64):
            votes[i] += 1 if d[i // 8] >> (i % 8) & 1 else -1
    value = sum(1 << i for i in range(64) if votes[i] >= 0)
    assert got == {1: -1, 2: -1, 3: value - (1 << 64) if value >> 63 else value}


def test_robots_answers_hold_for_an_hour(spark):
    t0 = datetime.datetime(2024, 1, 1, 11, 59)
    at = lambda minutes: t0 + datetime.timedelta(minutes=minutes)
    answers = [("a", at(0), 200), ("a", at(30), 403), ("a", at(30), 200), ("b", at(0), 503), ("c", at(0), 404), ("d", None, 200)]
    fetches = [(1, "a", at(-1)), (2, "a", at(0)), (3, "a", at(29)), (4, "a", at(30)), (5, "a", at(89)), (6, "a", at(90)), (7, "b", at(59)), (8, "b", at(60)), (9, "c", at(1)), (10, "z", at(1)), (11, "a", None), (12, None, at(1))]
    found = robots.policies_at(spark.createDataFrame(fetches, "n long, origin string, at timestamp"), spark.createDataFrame(answers, "origin string, at timestamp, status int"))
    assert found.columns == ["n", "origin", "at", "answered_at", "policy"]
    want = {1: "ask", 2: "parse", 3: "parse", 4: "disallow", 5: "disallow", 6: "ask", 7: "abort", 8: "ask", 9: "allow", 10: "ask", 11: "ask", 12: "ask"}
    assert {r.n: r.policy for r in found.collect()} == want


def test_extraction_of_some_columns_in_parts(spark):
    from tessera.functions.html import PART_ROWS, extract_page, extracted

    pages = [(i, f"https://e.example/{i}", f"<html><body><h1>T{i}</h1><p>{'word ' * (i % 7)}</p></body></html>" if i % 50 else None) for i in range(2 * PART_ROWS + 3)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    want = {(i, u, extract_page(h, u)["content"]) for i, u, h in pages}
    some = extracted(df, only=("content",))
    assert some.columns == ["page_id", "url", "content"] and {tuple(r) for r in some.collect()} == want
    whole = extracted(df)
    assert {(r.page_id, r.url, r.content) for r in whole.collect()} == want and "links" in whole.columns
