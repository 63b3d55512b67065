"""Page extraction from HTML, on Arrow batches, with the standard library's parser."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


# Elements that hold no content, elements without an end, and hiding styles.
DROPPED = {"script", "style", "noscript", "nav", "footer", "header", "aside", "form", "iframe", "canvas", "svg"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
HIDING = ("display:none", "display: none", "visibility:hidden", "visibility: hidden")
HEADINGS = ("h1", "h2", "h3")
PARAGRAPH_ENDS = {"address", "article", "blockquote", "div", "dl", "fieldset", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "main", "ol", "p", "pre", "section", "table", "ul"}

#: A task parses at most so much HTML, and so many pages, at a time (or one page).
PART_BYTES, PART_ROWS = 2 << 20, 256

SCHEMA = "title string, description string, headings array<string>, content string, canonical_url string, language string, metadata string, open_graph string, structured_data string, links array<string>, content_hash string"


def _clean(parts: list[str] | str) -> str:
    return " ".join("".join(parts).replace("﻿", " ").split())


class _Page(HTMLParser):
    def __init__(self, url: str):
        super().__init__(convert_charrefs=True)
        self.url, self.open, self.hidden = url, [], 0
        self.parts: dict[str, list[str]] = {}
        self.done: dict[str, str] = {}
        self.headings: list[list[str]] = []
        self.inside: list[tuple[str, list[str]]] = []
        self.data: list[object] = []
        self.ld: list[str] | None = None
        self.links: dict[str, None] = {}
        self.meta: dict[str, str] = {}
        self.graph: dict[str, str] = {}
        self.description = self.canonical = self.language = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        names = {k for k, _ in attrs}
        if tag in PARAGRAPH_ENDS and "p" in (t for t, _ in self.open):
            self.handle_endtag("p")
        if tag == "script" and a.get("type") == "application/ld+json":
            self.ld = []
        hides = tag in DROPPED or "hidden" in names or a.get("aria-hidden") == "true" or any(h in a.get("style", "") for h in HIDING)
        if tag not in VOID:
            self.open.append((tag, hides))
            self.hidden += hides
        if self.hidden or (tag in VOID and hides):
            return
        if tag == "html" and "lang" in a and self.language is None:
            self.language = a["lang"].split("-")[0].lower() or None
        elif tag == "meta":
            if a.get("name") == "description" and self.description is None:
                self.description = _clean(a.get("content", "")) or None
            elif a.get("name") and a.get("content") and a["name"].lower() != "description":
                self.meta[a["name"]] = a["content"]
            if a.get("property", "").startswith("og:") and a.get("content"):
                self.graph[a["property"]] = a["content"]
        elif tag == "link" and "canonical" in a.get("rel", "").split() and a.get("href") and self.canonical is None:
            self.canonical = urljoin(self.url, a["href"])
        elif tag == "a" and a.get("href"):
            try:
                to = urljoin(self.url, a["href"])
                if urlsplit(to).scheme in ("http", "https"):
                    self.links[to] = None
            except ValueError:
                pass
        if tag in (*HEADINGS, "title", "main", "article", "body"):
            text: list[str] = []
            self.inside.append((tag, text))
            if tag in HEADINGS:
                self.headings.append(text)
            self.parts.setdefault(tag, text)

    def handle_endtag(self, tag: str) -> None:
        if tag not in (t for t, _ in self.open):
            return
        while self.open:
            name, hides = self.open.pop()
            self.hidden -= hides
            if name == "script" and self.ld is not None:
                try:
                    self.data.append(json.loads("".join(self.ld)))
                except ValueError:
                    pass
                self.ld = None
            for i in range(len(self.inside) - 1, -1, -1):
                if self.inside[i][0] == name:
                    del self.inside[i]
                    break
            if name == tag:
                return

    def handle_data(self, data: str) -> None:
        if self.ld is not None:
            self.ld.append(data)
        if self.hidden:
            return
        for _, text in self.inside:
            text.append(data)


def extract_page(html: str | None, url: str | None) -> dict[str, object]:
    """What a page holds; block elements are joined without a space between them, as their texts stand."""
    page = _Page(url or "")
    page.feed(html or "")
    page.close()
    get = lambda tag: page.parts.get(tag)
    root = next((get(t) for t in ("main", "article", "body") if get(t) is not None), [])
    content = _clean(root)
    title = _clean(get("title") or []) or _clean(get("h1") or [])
    return {
        "title": title,
        "description": page.description,
        "headings": [h for h in map(_clean, page.headings) if h],
        "content": content,
        "canonical_url": page.canonical,
        "language": page.language,
        "metadata": json.dumps(page.meta, ensure_ascii=False, sort_keys=True),
        "open_graph": json.dumps(page.graph, ensure_ascii=False, sort_keys=True),
        "structured_data": json.dumps(page.data, ensure_ascii=False),
        "links": list(page.links),
        "content_hash": hashlib.sha256(content.encode()).hexdigest(),
    }


def extracted(pages: DataFrame, html: str = "html", url: str = "url", only: Sequence[str] | None = None) -> DataFrame:
    """``pages`` with the columns of ``SCHEMA``, or some of them, in place of the HTML.

    A task parses some ``PART_BYTES`` of HTML at a time and hands them on, whatever the batch's size.
    """
    keep = [c for c in pages.columns if c != html]
    fields = [f for f in T.StructType.fromDDL(SCHEMA) if only is None or f.name in only]
    kinds = [pa.list_(pa.string()) if isinstance(f.dataType, T.ArrayType) else pa.string() for f in fields]
    names = [*keep, *(f.name for f in fields)]
    source = pages.select(*keep, F.col(html).cast("string").alias("__html"), F.col(url).cast("string").alias("__url"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies, urls = batch.column(len(keep)), batch.column(len(keep) + 1)
            ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(bodies), 0), dtype=np.int64))
            row = 0
            while row < batch.num_rows:
                before = int(ends[row - 1]) if row else 0
                end = max(row + 1, int(np.searchsorted(ends, before + PART_BYTES, "right")))
                n = min(end, batch.num_rows, row + PART_ROWS) - row
                found = [extract_page(h.as_py(), u.as_py()) for h, u in zip(bodies.slice(row, n), urls.slice(row, n), strict=True)]
                own = [pa.array([f[field.name] for f in found], kind) for field, kind in zip(fields, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(row, n) for i in range(len(keep))), *own], names)
                row += n

    return source.mapInArrow(parse, T.StructType([*(pages.schema[c] for c in keep), *fields]))
