"""Nearest neighbours by a block matrix join.

Queries and candidates are cut into blocks of some megabytes, in the precision they are
stored in; every query block meets every candidate block in one task, so with vectors of
64 floats a value that is sent is multiplied 65,536 times.  There, tiles of products of
int8 values (by floating-point matrix products, which are exact for them) give approximate
distances together with bounds from each vector's quantisation error (triangle
inequality), so a pair whose lower bound lies above a query's k-th smallest upper
bound can't be among its nearest.  Surviving pairs are recomputed in double
precision on the original vectors.  The candidate blocks' lists are merged by
heaps, some dozen lists at a time, so no task sees more than that.  The result is
exact.

Vectors that are null, zero, or hold null or non-finite components take no part,
nor do vectors without an id; vectors meet only those of the same dimension.  A
query is not its own candidate: rows that repeat its id are left out.  Repeated
query rows count once; repeated candidate rows count each.  Ties go to the
smaller id.  An empty table gives an empty result.  Other columns, also those named
like results, are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of vectors in a block of queries and of candidates, about.  A candidate is sent
#: once for every block of queries, so these are as large as a task can hold.
BLOCK_BYTES = 16 << 20
TILE = 2048
#: Lists that one heap merge takes.
FAN_IN = 32
_PAIRS = 1 << 15
LISTS = "number long, query_id long, strip long, ids array<long>, scores array<double>"


def usable(vectors: DataFrame, vector: str, vector_id: str) -> DataFrame:
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = v if vectors.schema[vector].dataType.simpleString() == "array<float>" else v.cast("array<double>")
    return vectors.filter(F.col(vector_id).isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0)).select(F.col(vector_id).cast("long").alias("id"), kept.alias("v"))


def _quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """int8 values (as floats, exact in products), their squared norms, errors, and the scale."""
    scale = max(float(np.abs(x).max(initial=0)) / 127, 1e-300)
    q = np.rint(x / scale).astype(np.int8)
    error = np.sqrt(((x - scale * q) ** 2).sum(1))
    f = q.astype(np.float32 if x.shape[1] <= 1000 else np.float64)
    return f, (q.astype(np.float64) ** 2).sum(1), error, scale


def nearest_in_block(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, distances), each (queries, k), of the nearest candidates; -1 and infinity where there are fewer."""
    q = q.astype(np.float64)
    ids, best = np.full((len(q), k), -1, np.int64), np.full((len(q), k), np.inf)
    fq, nq, eq, sq = _quantised(q)
    for at in range(0, len(c), TILE):
        tile, names = c[at : at + TILE].astype(np.float64), cid[at : at + TILE]
        fc, nc, ec, sc = _quantised(tile)
        for row in range(0, len(q), 256):
            r = slice(row, row + 256)
            squared = (sq * sq * nq[r])[:, None] + (sc * sc * nc)[None, :] - 2 * sq * sc * (fq[r] @ fc.T).astype(np.float64)
            near = np.sqrt(np.maximum(squared, 0))
            slack = (eq[r][:, None] + ec[None, :]) * (1 + 1e-9) + 1e-6 * np.sqrt(sq * sq * nq[r])[:, None]
            same = qid[r][:, None] == names[None, :]
            upper = np.where(same, np.inf, near + slack)
            bound = best[r, k - 1]
            if upper.shape[1] >= k:
                bound = np.minimum(bound, np.partition(upper, k - 1, axis=1)[:, k - 1])
            i, j = np.nonzero((near - slack <= bound[:, None]) & ~same)
            exact = np.concatenate([np.empty(0), *(np.sqrt(((q[row + i[p : p + _PAIRS]] - tile[j[p : p + _PAIRS]]) ** 2).sum(1)) for p in range(0, i.size, _PAIRS))])
            order = np.lexsort((names[j], exact, i))
            i, j, exact = i[order], j[order], exact[order]
            place = np.arange(i.size) - np.searchsorted(i, i)
            top = place < k
            new, new_ids = np.full((near.shape[0], k), np.inf), np.full((near.shape[0], k), -1, np.int64)
            new[i[top], place[top]], new_ids[i[top], place[top]] = exact[top], names[j[top]]
            both, both_ids = np.concatenate([best[r], new], 1), np.concatenate([ids[r], new_ids], 1)
            order = np.lexsort((both_ids, both), axis=1)[:, :k]
            best[r], ids[r] = np.take_along_axis(both, order, 1), np.take_along_axis(both_ids, order, 1)
    return ids, best


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = pa.concat_arrays(column.chunks)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1))


def nearest(vectors: DataFrame, is_query: F.Column, k: int = 10, vector: str = "embedding", vector_id: str = "vec_id", query_block: int | None = None, candidate_block: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest candidates by Euclidean distance.

    ``is_query`` is a condition on the column ``id``; a block has ``BLOCK_BYTES`` of
    vectors unless its rows are given.
    """
    rows = usable(vectors, vector, vector_id).withColumn("d", F.size("v"))
    queries = rows.filter(is_query).distinct()
    width = 4 if rows.schema["v"].dataType.simpleString() == "array<float>" else 8

    def blocks(part: DataFrame, size: int | None) -> int:
        n, numbers = part.agg(F.count("*"), F.coalesce(F.sum("d"), F.lit(0))).first()
        return max(1, -(-n // size) if size else -(-width * numbers // BLOCK_BYTES))

    across, down = blocks(queries, query_block), blocks(rows, candidate_block)
    strips = F.transform(F.sequence(F.lit(0), F.lit(down - 1)), lambda s: s.cast("long"))
    asked = queries.withColumn("number", F.xxhash64("id", "v")).withColumn("block", F.pmod(F.col("number"), F.lit(across))).withColumn("strip", F.explode(strips))
    given = rows.withColumn("strip", F.pmod(F.xxhash64("id", "v", F.lit(1)), F.lit(down))).withColumn("block", F.explode(F.transform(F.sequence(F.lit(0), F.lit(across - 1)), lambda s: s.cast("long"))))
    given = given.select(*(F.col(c).alias(f"c_{c}") for c in given.columns))

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, scores = [[] for _ in range(left.num_rows)], [[] for _ in range(left.num_rows)]
        if left.num_rows and right.num_rows:
            qid, cid = np.asarray(left.column("id"), dtype=np.int64), np.asarray(right.column("c_id"), dtype=np.int64)
            found, far = nearest_in_block(qid, _matrix(left.column("v")), cid, _matrix(right.column("c_v")), k)
            ids = [f[d < np.inf].tolist() for f, d in zip(found, far, strict=True)]
            scores = [d[d < np.inf].tolist() for d in far]
        return pa.Table.from_arrays(
            [left.column("number"), left.column("id"), left.column("strip"), pa.array(ids, pa.list_(pa.int64())), pa.array(scores, pa.list_(pa.float64()))], ["number", "query_id", "strip", "ids", "scores"]
        )

    keys = ("d", "block", "strip")
    lists = asked.groupBy(*keys).cogroup(given.groupBy(*(f"c_{x}" for x in keys))).applyInArrow(tile, LISTS)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, scores = [], []
            for parts in batch.column("parts").to_pylist():
                first = list(zip(range(k), heapq.merge(*(zip(p["scores"], p["ids"], strict=True) for p in parts)), strict=False))
                scores.append([s for _, (s, _) in first])
                ids.append([i for _, (_, i) in first])
            yield pa.RecordBatch.from_arrays(
                [batch.column("number"), batch.column("query_id"), batch.column("strip"), pa.array(ids, pa.list_(pa.int64())), pa.array(scores, pa.list_(pa.float64()))], ["number", "query_id", "strip", "ids", "scores"]
            )

    left = down
    while left > 1:
        lists = lists.withColumn("strip", F.floor(F.col("strip") / FAN_IN).cast("long")).groupBy("number", "query_id", "strip").agg(F.collect_list(F.struct("ids", "scores")).alias("parts")).mapInArrow(merge, LISTS)
        left = -(-left // FAN_IN)
    ranked = lists.select("query_id", F.posexplode(F.arrays_zip("ids", "scores")).alias("place", "hit"))
    return ranked.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("hit.ids").alias("vec_id"), F.col("hit.scores").alias("score"))
