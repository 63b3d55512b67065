"""Mixing sources to target weights by systematic sampling.

The mix has as many words as all documents together.  Sources in order of code points,
a missing one last, weigh ``weights`` in turn; each gets its share by weight, up to
``cap`` times its own words, and what a source can't take is shared again among the
others.  Within a source, documents are in order of size, every document's expected
copies are summed up from the first one on, and a document is taken once for each
integer that the sum, begun at one random offset, crosses.  So a source misses its target
by about one of its longest documents at most, and a document is taken ``cap`` times at
most.  Of ``STARTS`` evenly spaced offsets, the first of them random, a source uses the one that
brings its words nearest to its target.

The sums are exact: expected copies are fixed-point numbers, and only their fraction's
bits matter for the next crossing.  All documents of a source expect the same number of
copies, so a document's sum is its rank times that.  Ranks come from a range partitioning
whose last key is a tie-breaker, so a source (or copies of one document) with a third of
all rows is dealt to many tasks; only counts by partition and source are added up.

Null texts have no words; they and other texts without words are dealt like any other and
add nothing.  Rows of equal source, size, id and text are interchangeable, so reruns agree
in what they return.  An empty table gives an empty mix.  Other columns are carried
only if named in ``keep``, in a struct, so no name clashes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .exchange import checkpoint
from .textbytes import BLANKS, slices

WEIGHTS = (1, 2, 3)
CAP = 3
#: Bits of the fraction of expected copies.
BITS = 31
#: Offsets that are tried for each source.
STARTS = 32


def _sized(docs: DataFrame, keep: Sequence[str], source: str, text: str, doc_id: str) -> DataFrame:
    """unnamed, source, size, id, text_hash, row: one for each document, without its text unless that is kept."""
    body = F.col(text).cast("string")
    rows = docs.select(
        F.col(source).isNull().alias("unnamed"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), body.alias("text"), F.col(doc_id).alias("id"), F.xxhash64(body).alias("text_hash"), F.struct(*(F.col(c) for c in keep)).alias("row")
    )

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [np.diff(s.word_at) for s in slices(batch.column("text"), BLANKS)]
            sizes = pa.array(np.concatenate(counts).astype(np.int64) if counts else np.empty(0, np.int64))
            at = batch.schema.get_field_index("text")
            yield pa.RecordBatch.from_arrays([sizes if i == at else c for i, c in enumerate(batch.columns)], ["size" if f == "text" else f for f in batch.schema.names])

    kinds = T.StructType([T.StructField("size", T.LongType()) if f.name == "text" else f for f in rows.schema])
    return rows.mapInArrow(measure, kinds)


def ranked(df: DataFrame, group: Sequence[str], order: Sequence[str], of_group: DataFrame | None = None) -> DataFrame:
    """``df`` with ``rank``: how many rows of the same group (columns that aren't null) come before in the given order.

    Equal rows get different ranks, in any order.  Rows are dealt by ranges of group and
    order and numbered within their range; what other ranges hold before it is a count for
    each.  Columns ``of_group``, a table with one row for each group, come along with these
    counts, so that rows aren't joined by a group that may hold a third of them.  ``part`` is a
    row's range, for joining other columns of groups in the same way.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = df.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(n, *group, *order, "tie").withColumn("part", F.spark_partition_id())
    parts = checkpoint(parts)  # the ranges are drawn anew by every job
    earlier = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.groupBy("part", *group).agg(F.count("*").alias("n")).select("part", *group, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    if of_group is not None:
        before = before.join(of_group, [*group])
    own = F.row_number().over(Window.partitionBy("part", *group).orderBy(*order, "tie"))
    numbered = parts.withColumn("own", own).join(before, ["part", *group])
    return numbered.withColumn("rank", F.col("before") + F.col("own") - 1).drop("tie", "own", "before")


def source_targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """unnamed, source, source_size, target: the words that the mix shall have of each source.

    The level at which the remaining words are shared by weight only rises as sources reach
    their cap, so each round adds up the capped ones under the last level, until there are
    no more.  The driver sees sums alone.
    """
    totals = checkpoint(sized.groupBy("unnamed", "source").agg(F.sum("size").alias("source_size")))
    turns = F.array(*(F.lit(float(w)) for w in weights))
    sources = checkpoint(ranked(totals, [], ["unnamed", "source"]).withColumn("weight", F.element_at(turns, (F.col("rank") % len(weights) + 1).cast("int"))))
    total, shared = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    most = F.col("source_size") * float(cap)
    left, capped = total, 0
    while True:
        full = most * F.lit(float(shared)) <= F.col("weight") * F.lit(float(left))
        n, words, shared_now = sources.agg(F.count_if(full), F.coalesce(F.sum(F.when(full, F.col("source_size"))), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        if n == capped or not shared_now:
            break
        capped, left, shared = n, total - cap * words, shared_now
    share = F.lit(float(left)) * F.col("weight") / F.lit(float(shared or 1))
    return sources.select("unnamed", "source", "source_size", F.when(full, most).otherwise(share).alias("target"))


def mixed(docs: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP, keep: Sequence[str] = ("doc_id",), seed: int = 0, source: str = "source", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per document: row (a struct of the columns to keep), size, source_size, target and copies."""
    sized = checkpoint(_sized(docs, keep, source, text, doc_id))
    targets = source_targets(sized, weights, cap)
    one = 1 << BITS
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    dice = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("unnamed").cast("int"), "source").cast("binary"), 256), 1, 8), 16, 10).cast("long")
    steps = targets.select("unnamed", "source", "source_size", "target", F.floor(expected * one).alias("step"), (dice % one).alias("offset"))
    rows = checkpoint(ranked(sized, ["unnamed", "source"], ["size", "id", "text_hash"], of_group=steps))
    whole, part = F.floor(F.col("step") / one), F.col("step") % one
    at = ((F.col("rank") % one) * part + F.col("offset")) % one
    copies = lambda start: whole + ((at + start) % one + part >= one).cast("long")
    starts = [k * (one // STARTS) for k in range(STARTS)]
    sums = rows.groupBy("unnamed", "source").agg(F.first("target").alias("target"), *(F.sum(F.col("size") * copies(F.lit(u))).alias(f"w{k}") for k, u in enumerate(starts)))
    best = F.array_min(F.array(*(F.struct(F.abs(F.col(f"w{k}") - F.col("target")), F.lit(u).cast("long").alias("start")) for k, u in enumerate(starts))))
    chosen = sums.select("unnamed", "source", best["start"].alias("start"))
    by_part = rows.select("part", "unnamed", "source").distinct().join(chosen, ["unnamed", "source"])
    out = rows.join(by_part, ["part", "unnamed", "source"])
    return out.select("row", "size", "source_size", "target", copies(F.col("start")).alias("copies"))


def mixture(docs: DataFrame, **settings: object) -> DataFrame:
    """The mix itself: the rows of ``docs``, all columns, each as often as it is taken."""
    taken = mixed(docs, keep=docs.columns, **settings).filter("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


#: For DuckDB: the documents' sizes, sources' shares by the order in which they reach their
#: cap, and copies by rank in each source.
MIXING_SQL = r"""
WITH sized AS (
  SELECT doc_id, source IS NULL AS unnamed, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
totals AS (
  SELECT unnamed, source, CAST(sum(size) AS BIGINT) AS source_size, CAST((row_number() OVER (ORDER BY unnamed, source) - 1) % 3 + 1 AS DOUBLE) AS weight FROM sized GROUP BY unnamed, source),
filled AS (
  SELECT *, row_number() OVER o AS place, sum(source_size) OVER () AS all_words,
    all_words - 3 * coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS words_left,
    sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left
  FROM totals WINDOW o AS (ORDER BY source_size / weight, unnamed, source)),
cut AS (SELECT arg_min(words_left, place) AS words_left, arg_min(weight_left, place) AS weight_left FROM filled WHERE 3.0 * source_size * weight_left > weight * words_left),
targets AS (
  SELECT unnamed, source, source_size,
    CASE WHEN c.weight_left IS NULL OR 3.0 * source_size * c.weight_left <= weight * c.words_left THEN CAST(3 * source_size AS DOUBLE) ELSE CAST(c.words_left AS DOUBLE) * weight / c.weight_left END AS target
  FROM filled, cut c),
steps AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size * 2147483648) AS BIGINT) ELSE 0 END AS step,
    CAST('0x' || substr(sha256('0:' || CAST(unnamed AS INT) || ':' || source), 1, 8) AS BIGINT) % 2147483648 AS shift
  FROM targets),
ranks AS (SELECT *, row_number() OVER (PARTITION BY unnamed, source ORDER BY size, doc_id) - 1 AS rank FROM sized),
mixes AS (
  SELECT unnamed, source, doc_id, size, source_size, target, k,
    size * (step // 2147483648 + CASE WHEN ((rank % 2147483648) * (step % 2147483648) + shift + k * 67108864) % 2147483648 + step % 2147483648 >= 2147483648 THEN 1 ELSE 0 END) AS taken
  FROM ranks JOIN steps USING (unnamed, source), range(32) t(k)),
best AS (SELECT unnamed, source, arg_min(k, (miss, k)) AS k FROM (SELECT unnamed, source, k, abs(sum(taken) - any_value(target)) AS miss FROM mixes GROUP BY unnamed, source, k) m GROUP BY unnamed, source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(taken AS BIGINT) AS taken FROM mixes JOIN best USING (unnamed, source, k)
"""
