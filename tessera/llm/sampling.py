"""Bounded samples of labelled rows, for fitting models on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled_passages(rows: DataFrame, label: str, text: str, key: str, rows_in_all: int, chars: int, seed: int = 1) -> list[tuple[object, str]]:
    """At most ``rows_in_all`` (label, passage) pairs, equally many of each label where there are enough.

    Rows are chosen by a hash of ``key`` and text, and a passage is ``chars`` characters
    from a place that the hash chooses, so the same rows give the same sample on any
    number of tasks.  The sample is bounded in rows and in characters; every label is in
    it as long as there are no more labels than ``rows_in_all``, beyond which the most
    frequent ones are.  Nulls give no passage; an empty table gives an empty sample.
    """
    rows = rows.filter(F.col(label).isNotNull() & F.col(text).isNotNull())
    counts = rows.groupBy(F.col(label).alias("label")).count().orderBy(F.desc("count"), "label").limit(rows_in_all).collect()
    if not counts:
        return []
    each = max(1, rows_in_all // len(counts))
    # One row for each label in the sample, so it may be broadcast.
    shares = rows.sparkSession.createDataFrame([(r.label, min(1.0, 1.3 * each / r["count"] + 1e-9)) for r in counts], rows.select(F.col(label).alias("label"), F.lit(1.0).alias("share")).schema)
    order = F.xxhash64(F.col(key), F.col(text), F.lit(seed))
    place = F.pmod(F.xxhash64(F.col(key), F.col(text), F.lit(seed + 1)), F.greatest(F.length(text) - chars, F.lit(0)) + 1)
    passages = rows.select(F.col(label).alias("label"), order.alias("order"), F.substring(F.col(text), (place + 1).cast("int"), F.lit(chars)).alias("passage"))
    chance = F.pmod(F.col("order"), F.lit(1 << 30)) / float(1 << 30)
    chosen = passages.join(F.broadcast(shares), "label").filter(chance < F.col("share"))
    found: dict[object, list[str]] = {r.label: [] for r in counts}
    for r in chosen.orderBy("order", "passage").limit(2 * rows_in_all).collect():
        if len(found[r.label]) < each:
            found[r.label].append(r.passage)
    for k, own in found.items():
        if not own:  # rows that are all alike share one hash
            own += [r.passage for r in passages.filter(F.col("label") == F.lit(k)).orderBy("order", "passage").limit(each).collect()]
    return [(k, p) for k in sorted(found, key=str) for p in found[k]]
