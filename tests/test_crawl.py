"""Crawl order, gates of hosts, near-duplicate chains, components, and documents of pages."""

import json
from collections import defaultdict, deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.hashing import exact_first, first_wins
from tessera.functions.html import extracted
from tessera.operators.components import components
from tessera.operators.frontier import crawl_order, start_times
from tessera.operators.lifecycle import crawl_document, crawl_frontier

SEEDS = "node long, kind int, at double, depth int, attempt int"


def expected_order(seeds, links, most_depth, most_pages):
    """One queue, page after page."""
    out, queue = {}, deque()

    def enqueue(node, depth, attempt, generation):
        if node not in out and len(out) < most_pages:
            out[node] = (depth, attempt, generation, len(out))
            queue.append(node)

    for node, _, _, depth, attempt in sorted(seeds, key=lambda s: (s[1], s[2], s[0])):
        enqueue(node, depth, attempt, 0)
    while queue:
        node = queue.popleft()
        depth, _, generation, _ = out[node]
        if depth < most_depth:
            for _, b in sorted(links.get(node, [])):
                enqueue(b, depth + 1, 1, generation + 1)
    return out


@pytest.mark.parametrize("most_depth,most_pages", [(4, 10_000), (6, 120), (0, 50), (3, 7)])
def test_crawl_order(spark, most_depth, most_pages):
    rng = np.random.default_rng(most_pages)
    links = defaultdict(list)
    for a in range(300):
        links[a] = [(i, int(b)) for i, b in enumerate(rng.integers(0, 400, rng.integers(0, 4)))]
    seeds = [(5, 2, 0.0, 0, 1), (9, 0, 3.0, 2, 4), (5, 0, 7.0, 1, 3), (11, 0, 3.0, 0, 2), (20, 1, 1.0, 0, 1), (5, 1, 0.0, 0, 1), (2, 2, 1.0, 0, 1)]
    table = spark.createDataFrame([(a, b, i) for a, out in links.items() for i, b in out], "a long, b long, at int")
    found = {r.node: (r.depth, r.attempt, r.generation, r.place) for r in crawl_order(spark.createDataFrame(seeds, SEEDS), table, most_depth, most_pages).collect()}
    assert found == expected_order(seeds, links, most_depth, most_pages)


def test_deep_crawls(spark):
    chain = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"), F.lit(0).alias("at"))
    start = spark.createDataFrame([(0,)], "node long")
    assert {r.node: r.depth for r in crawl_frontier(start, chain, 50).collect()} == {i: i for i in range(51)}
    found = crawl_order(spark.createDataFrame([(0, 2, 0.0, 0, 1)], SEEDS), chain, 12, 1000)
    assert {r.node: r.place for r in found.collect()} == {i: i for i in range(13)}


def test_hosts_start_one_page_after_another(spark):
    rng = np.random.default_rng(1)
    pages = [(int(i), "hot" if i % 3 else f"h{i % 5}", int(r)) for i, r in enumerate(np.sort(rng.integers(0, 3000, 200)))]
    delays = {"hot": 30, "h0": 0, "h1": 500}
    found = start_times(spark.createDataFrame(pages, "page long, host string, ready long"), spark.createDataFrame(list(delays.items()), "host string, delay long"), ["page"])
    last, want = {}, {}
    for page, host, ready in pages:
        delay = delays.get(host, 0)
        want[page] = max(ready, last[host] + delay) if delay and host in last else ready
        last[host] = want[page]
    assert {r.page: r.starts for r in found.collect()} == want


def greedy(n, pairs):
    kept = {}
    for b in range(n):
        kept[b] = not any(kept[a] for a, x in pairs if x == b)
    return kept


@pytest.mark.parametrize("solo", [100_000, 30])
def test_first_wins(spark, solo):
    # A chain of 200 pages in order, a star, a random graph and pages near none.
    rng = np.random.default_rng(2)
    pairs = {(i, i + 1) for i in range(199)} | {(200, i) for i in range(201, 230)} | {tuple(sorted(map(int, p))) for p in rng.integers(230, 300, (90, 2)) if p[0] != p[1]}
    if solo == 30:
        pairs = {p for p in pairs if p[0] > 190}
    pages = spark.range(310).withColumnRenamed("id", "page_id")
    found = first_wins(pages, spark.createDataFrame(sorted(pairs), "a long, b long"), solo=solo)
    assert {r.page_id: r.kept for r in found.collect()} == greedy(310, pairs)


def test_exact_first(spark):
    pages = spark.createDataFrame([(i, "h" if i % 3 else f"x{i}") for i in range(20)], "page_id long, h string")
    assert {r.page_id for r in exact_first(pages, "h").filter("kept").collect()} == {1} | {i for i in range(0, 20, 3)}


def test_components(spark):
    rng = np.random.default_rng(3)
    pairs = [(i, i + 1) for i in range(100)] + [(200, i) for i in range(201, 240)] + [tuple(map(int, p)) for p in rng.integers(300, 400, (60, 2))] + [(500, 500)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()} == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_documents_of_extracted_pages(spark):
    html = """<html lang="en"><head><title>A page</title><meta name="description" content="of &quot;mine&quot;"><meta name="author" content="me"><meta property="og:title" content="Open">
    <script type="application/ld+json">{"@type": "Article", "n": [1, 2]}</script></head><body><h1>Head</h1><p>Text</p></body></html>"""
    pages = extracted(spark.createDataFrame([("https://h.example/a", html), ("https://h.example/b", "<p>bare</p>")], "url string, html string"))
    docs = crawl_document(pages.withColumnRenamed("url", "normalized_url").withColumn("source_id", F.lit("s7")))
    first, second = (json.loads(r.metadata) for r in docs.orderBy("url").collect())
    assert first["author"] == "me" and first["description"] == 'of "mine"' and first["sourceId"] == "s7"
    assert first["openGraph"] == {"og:title": "Open"} and first["structuredData"] == [{"@type": "Article", "n": [1, 2]}]
    assert second["sourceId"] == "s7" and second["openGraph"] == {} and "author" not in second
