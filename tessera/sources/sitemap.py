"""Sitemaps: URL sets and sitemap indexes, plain or gzipped."""

from __future__ import annotations

import gzip
import io
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

MAX_BYTES = 10 << 20
MAX_VISITED = 100


def parse_sitemap(body: bytes) -> tuple[str, list[dict]]:
    """("urlset" or "sitemapindex", entries with loc, lastmod and priority)."""
    if body[:2] == b"\x1f\x8b":
        with gzip.GzipFile(fileobj=io.BytesIO(body)) as f:
            body = f.read(MAX_BYTES + 1)
    if len(body) > MAX_BYTES:
        raise ValueError("the sitemap is too large")
    if b"<!DOCTYPE" in body.upper() or b"<!ENTITY" in body.upper():
        raise ValueError("document types and entities are not allowed")
    root = ET.fromstring(body)
    name = root.tag.rpartition("}")[2]
    if name not in ("urlset", "sitemapindex"):
        raise ValueError("not a sitemap")
    out = []
    for child in root:
        entry = {e.tag.rpartition("}")[2]: (e.text or "").strip() for e in child}
        if entry.get("loc"):
            out.append({"loc": entry["loc"], "lastmod": entry.get("lastmod"), "priority": float(entry["priority"]) if entry.get("priority") else None})
    return name, out


def entries(bodies: DataFrame) -> DataFrame:
    """(url, body binary) to the entries of each sitemap; unreadable ones have an error."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples():
                try:
                    kind, found = parse_sitemap(r.body)
                    out += [(r.url, kind, e["loc"], e["lastmod"], e["priority"], None) for e in found]
                except (ValueError, ET.ParseError, OSError) as e:
                    out.append((r.url, None, None, None, None, str(e)))
            yield pd.DataFrame(out, columns=["sitemap", "kind", "loc", "lastmod", "priority", "error"])

    return bodies.select("url", "body").mapInPandas(rows, "sitemap string, kind string, loc string, lastmod string, priority double, error string")


def crawl_sitemaps(starts: list[str], read: Callable[[str], bytes], most: int = MAX_VISITED) -> list[str]:
    """Page addresses of nested sitemaps, breadth first, at most ``most`` visited."""
    queue, seen, pages = list(dict.fromkeys(starts)), set(), {}
    while queue and len(seen) < most:
        url = queue.pop(0)
        if url in seen:
            continue
        seen.add(url)
        kind, found = parse_sitemap(read(url))
        if kind == "sitemapindex":
            queue += [e["loc"] for e in found]
        else:
            pages.update(dict.fromkeys(e["loc"] for e in found))
    return list(pages)
