"""Documents and index versions over time: updates, crawling state, activation, erasure."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import checkpointed
from .frontier import merged

#: Responses that are worth another attempt.
TRANSIENT = (408, 429, 500, 502, 503, 504)


def upsert(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``changes`` in place of equal keys."""
    return rows.join(changes.select(key), key, "left_anti").unionByName(changes)


def live_documents(docs: DataFrame, deleting: DataFrame, source: str = "source_id") -> DataFrame:
    """Documents without a tombstone whose source is absent or not being deleted."""
    return docs.filter(F.col("deleted_at").isNull()).join(deleting.select(source), source, "left_anti")


def admitted_by_quota(live: int, additions: int, most: int | None) -> bool:
    return most is None or live + additions <= most


def retry_delay(attempt: Column, base_ms: int, most_ms: int, jitter: Column) -> Column:
    """Milliseconds until the next attempt: doubled each time, bounded, times half to one."""
    return F.floor(F.least(F.lit(float(most_ms)), base_ms * F.pow(F.lit(2.0), attempt - 1)) * (0.5 + jitter * 0.5)).cast("long")


def retry_after_ms(header: Column, now: Column) -> Column:
    """Seconds or an HTTP date; null for anything else."""
    seconds = F.when(F.trim(header).rlike("^[0-9]+$"), F.trim(header).cast("double") * 1000)
    date = F.when(F.trim(header).rlike("^[A-Za-z]"), F.try_to_timestamp(F.regexp_replace(F.trim(header), "^[A-Za-z]+, *| *GMT$", ""), F.lit("d MMM yyyy HH:mm:ss")))
    ahead = F.when(date.isNotNull(), F.greatest(F.lit(0.0), (F.unix_micros(date) - F.unix_micros(now)) / 1000.0))
    return F.coalesce(seconds, ahead)


def page_status(http: Column, content_type: Column, allowed_out: Column, duplicate: Column, deferred: Column) -> Column:
    """What became of a fetched page; ``allowed_out`` means robots rules forbid it."""
    html = content_type.contains("text/html") | content_type.contains("application/xhtml+xml")
    return F.when(allowed_out, "blocked").when(deferred, "deferred").when(http == 304, "unchanged").when(http.isin(*TRANSIENT) | ~http.between(200, 299), "failed").when(~html, "skipped").when(duplicate, "duplicate").otherwise("indexed")


def recrawl(queue: DataFrame, pages: DataFrame, live: DataFrame) -> DataFrame:
    """``queue`` (source_id, normalized_url) with the validators to send: those of the last page that was
    indexed or unchanged, if its document (``live``: document_id) is still there."""
    kept = pages.filter(F.col("status").isin("indexed", "unchanged"))
    last = kept.groupBy("source_id", "normalized_url").agg(F.max_by(F.struct("etag", "last_modified", "canonical_url"), "crawled_at").alias("p"))
    own = queue.join(last, ["source_id", "normalized_url"], "left")
    own = own.withColumn("document_id", F.left(F.sha2(F.coalesce("p.canonical_url", "normalized_url"), 256), F.lit(32)))
    own = own.join(live.select("document_id", F.lit(True).alias("there")), "document_id", "left")
    return own.select("source_id", "normalized_url", F.when(F.col("there"), F.col("p.etag")).alias("if_none_match"), F.when(F.col("there"), F.col("p.last_modified")).alias("if_modified_since"))


def unchanged_links(fetched: DataFrame, pages: DataFrame, most_depth: int) -> DataFrame:
    """(source_id, normalized_url, depth): the stored links of pages that answered 304, one level deeper."""
    kept = pages.filter(F.col("status").isin("indexed", "unchanged"))
    last = kept.groupBy("source_id", "normalized_url").agg(F.max_by("links", "crawled_at").alias("links"))
    same = fetched.filter((F.col("http") == 304) & (F.col("depth") < most_depth)).join(last, ["source_id", "normalized_url"])
    return same.select("source_id", F.explode("links").alias("normalized_url"), (F.col("depth") + 1).alias("depth")).distinct()


def crawl_document(pages: DataFrame) -> DataFrame:
    """Documents from extracted pages: id, url, title, content, headings, language and metadata as JSON.

    The metadata are the page's own with its description, Open Graph entries, structured data and
    source, which win over own entries of these names.  ``metadata``, ``open_graph`` and
    ``structured_data`` are JSON texts and become part of the document as JSON; absent ones are left out.
    """
    url = F.coalesce("canonical_url", "normalized_url")
    text = lambda c: F.when(F.col(c).isNotNull(), F.expr(f"substring(to_json(named_struct('v', {c})), 6, length(to_json(named_struct('v', {c}))) - 6)"))
    added = {"description": text("description"), "openGraph": F.col("open_graph"), "structuredData": F.col("structured_data"), "sourceId": text("source_id")}
    entry = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f'"{name}":'), value))
    own = F.lit(None).cast("string")
    if "metadata" in pages.columns:
        kept = F.map_filter(F.from_json("metadata", "map<string,string>"), lambda k, v: ~k.isin(*added) & v.isNotNull())
        body = F.to_json(kept)
        own = F.when(F.size(kept) > 0, F.expr("substring(__own, 2, length(__own) - 2)"))
        pages = pages.withColumn("__own", body)
    metadata = F.concat(F.lit("{"), F.concat_ws(",", own, *(entry(n, v) for n, v in added.items())), F.lit("}"))
    return pages.select(F.left(F.sha2(url, 256), F.lit(32)).alias("doc_id"), url.alias("url"), "title", "content", "headings", F.coalesce("language", F.lit("auto")).alias("language"), metadata.alias("metadata"))


def crawl_frontier(starts: DataFrame, links: DataFrame, most_depth: int, most_pages: int | None = None) -> DataFrame:
    """(node, depth) of pages reached from ``starts`` over ``links`` (a, b), breadth first, each once.

    One join per level.  Every level is written and read again, so the plan doesn't grow into
    itself and a crawl may be as deep as it likes.
    """
    edge = checkpointed(starts.select("node", F.lit(0).alias("depth")).distinct())
    parts, count = [edge], edge.count()
    for depth in range(1, most_depth + 1):
        new = edge.join(links, edge.node == links.a).select(F.col("b").alias("node")).distinct()
        for seen in parts:
            new = new.join(seen.select("node"), "node", "left_anti")
        edge = checkpointed(new.withColumn("depth", F.lit(depth)))
        found = edge.count()
        if not found:
            break
        parts = merged([*parts, edge])
        count += found
        if most_pages is not None and count >= most_pages:
            return reduce(DataFrame.unionByName, parts).orderBy("depth", "node").limit(most_pages)
    return reduce(DataFrame.unionByName, parts)


def next_sequence(versions: DataFrame, fences: DataFrame) -> DataFrame:
    """One more than the latest version, and at least the erasure fence."""
    latest = versions.groupBy("index_id").agg(F.coalesce(F.max("sequence"), F.lit(0)).alias("latest"))
    both = fences.join(latest, "index_id", "left")
    return both.select("index_id", F.greatest(F.coalesce("latest", F.lit(0)) + 1, "minimum_sequence").cast("long").alias("next_sequence"))


def activate(versions: DataFrame, chosen: DataFrame) -> DataFrame:
    """``chosen`` (index_id, sequence) become active and the versions active before retired."""
    pick = chosen.withColumn("pick", F.lit(True)).withColumnRenamed("sequence", "picked")
    own = versions.join(pick, "index_id", "left")
    hit = F.col("pick") & (F.col("sequence") == F.col("picked")) & F.col("state").isin("ready", "retired", "active")
    state = F.when(hit, "active").when(F.col("pick") & (F.col("state") == "active"), "retired").otherwise(F.col("state"))
    return own.withColumn("state", state).drop("pick", "picked")
