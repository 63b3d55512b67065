"""Dominance counting by the logarithmic method.

A point is above another if its slot is smaller and its level strictly larger.  Points
of equal slot and level are first added up to *cells*.  Cells are dealt to shards by ranges
of (slot, level), and again to bands by ranges of (level, slot).  What is above a cell is then

* in its own shard: the shard is a stream in order of slots;
* in an earlier shard and its own band: the band is a stream in order of shards;
* in an earlier shard and a higher band: a histogram of the cells by shard and band,
  which is the same task over far fewer points, seeds the counts.

Both orders break ties so that cells of one slot, or of one level, may be cut anywhere:
an earlier cell of the same slot has a smaller level and never counts.

A stream keeps geometrically sized runs (``Runs``), each sorted by level with suffix sums of
its weights; a group of equal slot first searches every run by bisection and then becomes a run
itself, and runs of one size class merge.  Cells cost a task the logarithm of its size.

Nothing that grows with the input goes to one task: shards and bands are ranges of at most
some hundred thousand cells, and the last histogram has at most ``LEAF``.  Counts go back
to the points by a join on slot and level.  Cells with a 256th of all points or more, of
which there can be no more than 256, are broadcast for it; others are shuffled.

Nulls: a point without slot or level is above none and has null counts.  Repeated rows are
points of their own and never above each other.  An empty table gives no rows.  The points'
own columns come along in a struct, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exchange import checkpoint

#: Groups smaller than this are compared directly with their neighbours before they become a run.
BATCH = 64
#: A histogram of no more points than this is counted by one task.
LEAF = 1 << 17
SHARD_CELLS = 1 << 20
#: A cell that holds more than this part of all points is joined by broadcast.
HOT = 256


class Runs:
    """Weighted levels in runs of geometrically growing size, each sorted, with suffix sums."""

    def __init__(self) -> None:
        self.runs: list[tuple[np.ndarray, np.ndarray]] = []

    def above(self, levels: np.ndarray) -> np.ndarray:
        """For each level the weights (two columns) of all entries with a larger one."""
        out = np.zeros((levels.size, 2), np.int64)
        for keys, sums in self.runs:
            out += sums[np.searchsorted(keys, levels, "right")]
        return out

    def add(self, levels: np.ndarray, weights: np.ndarray) -> None:
        while self.runs and self.runs[-1][0].size.bit_length() <= levels.size.bit_length():  # of one size class, or smaller
            keys, sums = self.runs.pop()
            levels = np.concatenate([keys, levels])
            weights = np.concatenate([sums[:-1] - sums[1:], weights])
        order = np.argsort(levels, kind="stable")
        sums = np.zeros((levels.size + 1, 2), np.int64)
        sums[:-1] = np.cumsum(weights[order][::-1], axis=0)[::-1]
        self.runs.append((levels[order], sums))


def pieces(groups: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts an ascending array into runs of whole groups: one group of any size, or several with at most ``BATCH`` entries."""
    edges = np.append(np.flatnonzero(np.diff(groups)) + 1, groups.size)
    at = 0
    while at < groups.size:
        k = int(np.searchsorted(edges, at + BATCH, "right")) - 1
        end = int(edges[k] if k >= 0 and edges[k] > at else edges[k + 1])
        yield at, end
        at = end


def stream(groups: np.ndarray, levels: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """What is above each entry among those of earlier groups; ``groups`` ascend."""
    runs, out = Runs(), np.empty((groups.size, 2), np.int64)
    for at, end in pieces(groups):
        g, own = groups[at:end], levels[at:end]
        out[at:end] = runs.above(own)
        if g[0] != g[-1]:
            out[at:end] += ((g[None, :] < g[:, None]) & (own[None, :] > own[:, None])).astype(np.int64) @ weights[at:end]
        runs.add(own, weights[at:end])
    return out


def _streamed(cells: DataFrame, group: str, part: str) -> DataFrame:
    """Counts of each partition's stream added to n_above and w_above; column ``part`` gets the partition's number."""
    kinds = cells.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches([b for b in batches if b.num_rows] or [pa.RecordBatch.from_pylist([], schema=empty)])
        if not rows.num_rows:
            return
        column = {c: rows.column(c).to_numpy() for c in rows.column_names}
        above = stream(column[group], column["level"], np.stack([column["n"], column["w"]], axis=1))
        column["n_above"], column["w_above"] = column["n_above"] + above[:, 0], column["w_above"] + above[:, 1]
        column[part] = np.full(rows.num_rows, TaskContext.get().partitionId(), np.int64)
        table = pa.table({c: column[c] for c in rows.column_names})
        yield from table.to_batches(max_chunksize=1 << 16)

    empty = pa.schema([(f.name, pa.int64()) for f in kinds])
    return cells.mapInArrow(run, kinds)


def shard_count(cells: int) -> int:
    """Up to 256 shards, and no more than ``SHARD_CELLS`` cells in each however many there are."""
    return max(8, min(-(-cells // (1 << 16)), 256), -(-cells // SHARD_CELLS))


def above_cells(cells: DataFrame, leaf: int = 0) -> DataFrame:
    """``cells`` (slot, level, n, w; one for each slot and level) with n_above and w_above.

    Tables of at most ``leaf`` cells are counted by one task.
    """
    zero = F.lit(0).cast("long")
    rows = cells.select("slot", "level", "n", "w", zero.alias("n_above"), zero.alias("w_above"), zero.alias("shard"), zero.alias("band"))
    size = cells.count()
    if size <= leaf:
        return _streamed(rows.coalesce(1).sortWithinPartitions("slot", "level"), "slot", "shard").drop("shard", "band")
    k = shard_count(size)
    # Ranges are drawn anew by every job, so what depends on them is written once.
    rows = checkpoint(_streamed(rows.repartitionByRange(k, "slot", "level").sortWithinPartitions("slot", "level"), "slot", "shard"))
    rows = checkpoint(_streamed(rows.repartitionByRange(k, "level", "slot").sortWithinPartitions("shard", "slot", "level"), "shard", "band"))
    histogram = checkpoint(rows.groupBy(F.col("shard").alias("slot"), F.col("band").alias("level")).agg(F.sum("n").alias("n"), F.sum("w").alias("w")))
    seeds = above_cells(histogram, LEAF).select(F.col("slot").alias("shard"), F.col("level").alias("band"), F.col("n_above").alias("n_seed"), F.col("w_above").alias("w_seed"))
    total = rows.join(seeds, ["shard", "band"])
    return total.select("slot", "level", "n", "w", (F.col("n_above") + F.col("n_seed")).alias("n_above"), (F.col("w_above") + F.col("w_seed")).alias("w_above"))


def dominated(points: DataFrame, slot: Column, level: Column, weight: Column) -> DataFrame:
    """Per point: row (a struct of its columns), slot, level, n_above (points above it) and w_above (their weight).

    ``slot`` and ``level`` are integers, ``weight`` one that isn't null.
    """
    rows = points.select(F.struct(*points.columns).alias("row"), slot.cast("long").alias("slot"), level.cast("long").alias("level"), weight.cast("long").alias("w"))
    placed = F.col("slot").isNotNull() & F.col("level").isNotNull()
    cells = checkpoint(rows.filter(placed).groupBy("slot", "level").agg(F.count("*").alias("n"), F.sum("w").alias("w")))
    counted = checkpoint(above_cells(cells).select("slot", "level", "n", "n_above", "w_above"))
    most = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = F.col("n") * HOT > most
    # At most HOT cells, as each holds more than that part of all points.
    large = F.broadcast(counted.filter(hot).select("slot", "level", "n_above", "w_above", F.lit(True).alias("large")))
    rows = rows.drop("w")
    near = rows.join(large, ["slot", "level"], "left")
    done = near.filter(F.col("large") | ~placed).select("row", "slot", "level", "n_above", "w_above")
    rest = near.filter(F.col("large").isNull() & placed).select("row", "slot", "level").join(counted.filter(~hot).select("slot", "level", "n_above", "w_above"), ["slot", "level"])
    return done.unionByName(rest.select("row", "slot", "level", "n_above", "w_above"))


def day_of(sales: DataFrame, column: str) -> Column:
    """Days since 1970 of a time taken as UTC, in any session zone."""
    if dict(sales.dtypes)[column] == "timestamp":
        return F.floor(F.unix_seconds(column) / 86400)
    return F.unix_date(F.col(column).cast("date"))


def copies_of(key: str) -> Column:
    """1 to 3 by the crc32 of a whole number's decimal digits; a null counts as no digits."""
    return 1 + F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 3


def level_of(value: str) -> Column:
    """Tens of currency units, from cents rounded half up; null and not-a-number have none."""
    amount = F.col(value).cast("double")
    cents = F.floor(F.lit(100.0) * amount + F.lit(0.5))
    return F.when(~F.isnan(amount), F.floor(cents / 1000))


#: For DuckDB: crc32 bit by bit, cells, and a join of cells with those of earlier slots.
DOMINANCE_SQL = """
WITH marked AS (
  SELECT sale_id, CAST(floor(epoch(sold_at) / 86400) AS BIGINT) AS slot, CAST(floor(floor(100 * total + 0.5) / 1000) AS BIGINT) AS level,
    1 + xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(sale_id AS VARCHAR), ''), lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda c, o: CASE WHEN o >= 0 THEN xor(c, o) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295) % 3 AS copies
  FROM sales),
cells AS (SELECT slot, level, count(*) AS n, sum(copies) AS w FROM marked WHERE slot IS NOT NULL AND level IS NOT NULL GROUP BY slot, level),
sums AS (SELECT q.slot, q.level, CAST(coalesce(sum(p.n), 0) AS BIGINT) AS n_sales, CAST(coalesce(sum(p.w), 0) AS BIGINT) AS n_rows FROM cells q LEFT JOIN cells p ON p.slot < q.slot AND p.level > q.level GROUP BY q.slot, q.level)
SELECT sale_id, slot, level, n_sales, n_rows FROM marked LEFT JOIN sums USING (slot, level)
"""
