"""Looking at documents one page at a time, and at what the active version knows of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import escaped_like

STATUSES = ("live", "deleted", "all")
MOST_ROWS, MOST_CHANGED = 100, 200


def browse(docs: DataFrame, q: str = "", after: object = None, source: object = None, status: str = "live", limit: int = 30) -> DataFrame:
    """A page of documents (doc_id, title, content, source_id, deleted_at) in order of id, with ``next_after``.

    ``q`` is looked for as it stands, in any case, in id, title and content.  A page begins after the
    last one's ``next_after``, which is null on the last page; so pages stay right while documents come
    and go, and no page reads what the ones before it have shown.
    """
    if status not in STATUSES or not 1 <= limit <= MOST_ROWS:
        raise ValueError("not a valid status or limit")
    rows = docs
    if after is not None:
        rows = rows.filter(F.col("doc_id") > F.lit(after))
    if source is not None:
        rows = rows.filter(F.col("source_id") == F.lit(source))
    if status != "all":
        rows = rows.filter(F.col("deleted_at").isNull() if status == "live" else F.col("deleted_at").isNotNull())
    if q:
        pattern = f"%{escaped_like(q)}%"
        rows = rows.filter(F.col("doc_id").cast("string").ilike(pattern) | F.col("title").ilike(pattern) | F.col("content").ilike(pattern))
    page = rows.orderBy("doc_id").limit(limit + 1)
    # A page is at most a hundred rows and one, so a window over it is no large task.
    whole = Window.partitionBy(F.lit(0))
    page = page.withColumns({"__place": F.row_number().over(whole.orderBy("doc_id")), "__rows": F.count("*").over(whole)})
    last = F.max(F.when(F.col("__place") == limit, F.col("doc_id"))).over(whole)
    return page.withColumn("next_after", F.when(F.col("__rows") > limit, last)).filter(F.col("__place") <= limit).drop("__place", "__rows")


def document_states(docs: DataFrame, active: DataFrame, body: list[str]) -> DataFrame:
    """``docs`` with ``in_active`` and ``state``: deleted, indexed where the active version holds the same body, else pending.

    ``active`` are the documents of the active version; ``body`` names the columns that make a body.
    """
    held = active.select("doc_id", F.struct(*body).alias("__active"))
    both = docs.join(held, "doc_id", "left")
    same = F.col("__active").isNotNull() & F.struct(*body).eqNullSafe(F.col("__active"))
    state = F.when(F.col("deleted_at").isNotNull(), "deleted").when(same, "indexed").otherwise("pending")
    return both.withColumns({"in_active": F.col("__active").isNotNull(), "state": state}).drop("__active")


def changed_fields(before: DataFrame, after: DataFrame, key: str = "doc_id", body: str = "body", most: int = MOST_CHANGED) -> DataFrame:
    """(key, changed): names of a JSON body's entries that an edit added, removed or changed, in order, at most ``most``."""
    entries = lambda c: F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))
    pairs = before.select(key, entries(F.col(body)).alias("old")).join(after.select(key, entries(F.col(body)).alias("new")), key)
    names = F.array_sort(F.array_union(F.map_keys("old"), F.map_keys("new")))
    differs = F.filter(names, lambda n: ~F.col("old")[n].eqNullSafe(F.col("new")[n]) | (F.map_contains_key("old", n) != F.map_contains_key("new", n)))
    return pairs.select(key, F.slice(differs, 1, most).alias("changed"))
