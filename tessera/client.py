"""A client of one index: search, autocomplete, explain, and document changes."""

from __future__ import annotations

from dataclasses import dataclass, field
from dataclasses import replace as _replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.cursor import encode_cursor, start_of
from .functions.text import analyze_offsets
from .operators import search as S
from .operators.filters import condition
from .operators.index import Index, build
from .operators.lifecycle import upsert
from .settings import SearchRequest

MAX_BATCH = 5_000
MAX_HIGHLIGHTS = 12


@dataclass
class SearchResponse:
    hits: list[dict]
    total: int
    facets: dict[str, dict[str, int]]
    next_cursor: str | None
    expanded: list[str] = field(default_factory=list)


class SearchClient:
    """Searches ``index`` under a version name; changes make a new index, the old one stays as it was."""

    def __init__(self, spark: SparkSession, index: Index, version: str = "1", synonyms: DataFrame | None = None):
        self.spark, self.index, self.version, self.synonyms = spark, index, version, synonyms

    def search(self, request: SearchRequest) -> SearchResponse:
        start = start_of(request, self.version)
        s, docs = self.index.settings, self.index.docs
        kept = docs.filter(condition(docs, request.filters))
        parsed = S.parse(request.query, s)
        names: list[str] = []
        if not request.query.strip():
            ranked = kept.select("doc_id", F.lit(0.0).alias("score"))
        else:
            terms, phrases = S.parsed_queries(self.spark, {"q": request.query}, s)
            grown = S.expand_in(self.index, terms, self.synonyms, request.typo).persist()
            names = sorted({r.term for r in grown.collect()} | {t for p in parsed.phrases for t in p})
            ranked = S.score(self.index, grown, phrases if parsed.phrases else None, kept if request.filters else None).select("doc_id", "score")
        ranked = ranked.persist()
        total = ranked.count()
        rows = ranked.join(docs, "doc_id") if request.sort else ranked
        order = [F.desc(F.round("score", S.DIGITS)), F.collate(F.col("doc_id").cast("string"), "UNICODE")]
        if request.sort:
            name, way = request.sort
            order.insert(0, F.desc(name) if way == "desc" else F.asc(name))
        page = rows.orderBy(*order).offset(start).limit(request.limit).select("doc_id", "score")
        # Documents are fetched for the page only.
        found = {r["doc_id"]: r.asDict(True) for r in docs.join(F.broadcast(page.select("doc_id")), "doc_id", "left_semi").collect()}  # at most a page
        hits = [{"id": r.doc_id, "score": r.score, "document": found[r.doc_id], "highlights": self._highlights(found[r.doc_id], set(names))} for r in page.collect()]
        facets: dict[str, dict[str, int]] = {}
        if request.facets:
            for r in S.facets(ranked, docs, list(request.facets)).collect():
                facets.setdefault(r.facet, {})[r.value] = r.n
        after = start + len(hits)
        return SearchResponse(hits, total, facets, encode_cursor(self.version, after, request) if after < total else None, names)

    def _highlights(self, doc: dict, terms: set[str]) -> list[tuple[str, int, int]]:
        found = [(f, s, e) for f in ("title", "content") for s, e, _, t in analyze_offsets(doc.get(f) or "", self.index.settings) if t in terms]
        return found[:MAX_HIGHLIGHTS]

    def autocomplete(self, prefix: str, limit: int = 8) -> list[str]:
        return [r.value for r in S.autocomplete(self.index, prefix, limit).collect()]

    def explain(self, doc_id: object, request: SearchRequest) -> dict[str, float]:
        """Components of a document's score; paging has no part in it."""
        terms, phrases = S.parsed_queries(self.spark, {"q": request.query}, self.index.settings)
        grown = S.expand_in(self.index, terms, self.synonyms, request.typo)
        has = bool(S.parse(request.query, self.index.settings).phrases)
        return {r.component: r.value for r in S.explain(self.index, grown, doc_id, phrases if has else None).collect()}

    def with_documents(self, changes: DataFrame, version: str) -> SearchClient:
        """The client of a new version in which ``changes`` replace or join the documents."""
        if changes.limit(MAX_BATCH + 1).count() > MAX_BATCH:
            raise ValueError(f"a batch has at most {MAX_BATCH} documents")
        return SearchClient(self.spark, build(upsert(self.index.docs, changes, "doc_id"), self.index.settings), version, self.synonyms)

    def without_document(self, doc_id: object, version: str) -> SearchClient:
        return SearchClient(self.spark, build(self.index.docs.filter(F.col("doc_id") != doc_id), self.index.settings), version, self.synonyms)


def next_page(request: SearchRequest, response: SearchResponse) -> SearchRequest | None:
    return None if response.next_cursor is None else _replace(request, cursor=response.next_cursor)


def highlighted(text: str, ranges: list[tuple[int, int]]) -> list[tuple[str, bool]]:
    """Runs of a text, marked or not; ranges that overlap an earlier one are left out."""
    out, at = [], 0
    for start, end in sorted(ranges):
        if start < at:
            continue
        if start > at:
            out.append((text[at:start], False))
        out.append((text[start:end], True))
        at = end
    return out + ([(text[at:], False)] if at < len(text) else [])
