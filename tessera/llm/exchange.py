"""Counting keys across a corpus by blocks and buckets.

Operators that compare every word window or word pair of a corpus with all
others would shuffle one row per occurrence.  Here a task packs some megabytes
of texts into a *block*; the block sends its distinct 64-bit keys, sorted and
delta-coded, to key *buckets*, one row per (block, bucket); each bucket adds up
the values of equal keys and answers every block in the order it was asked.  A
frequent key costs each block one entry however often the block holds it, so no
key makes a task larger than the others, and both sides are bounded: a block by
``BLOCK_BYTES``, a bucket by the number of buckets, which follows the input.

Blocks are checkpointed, so a lost executor repeats only its own part and
asking and answering always see the same blocks.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 16 << 20
#: Keys that one bucket should receive at most, on average.
BUCKET_KEYS = 3 << 20

BLOCK_SCHEMA = "block long, data binary, n_bytes long, n_rows long"
REQUEST_SCHEMA = "bucket int, block long, blob binary"
ANSWER_SCHEMA = "block long, bucket int, blob binary"
_REQUEST = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("blob", pa.binary())])
_ANSWER = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("blob", pa.binary())])


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share; a folder of its own only in local mode."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` written to the session's shared checkpoint folder and read from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def arrow_batches(spark: SparkSession, n_bytes: int) -> Iterator[None]:
    """Jobs run inside hand batches of about so many bytes to Python, however wide their rows are."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, n_bytes)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes: byte planes, compressed."""
    code = zstandard.ZstdCompressor(level=1)
    out = [len(arrays).to_bytes(1, "little")]
    for a in arrays:
        planes = np.ascontiguousarray(a.view(np.uint8).reshape(a.size, a.itemsize).T).tobytes() if a.size else b""
        body = code.compress(planes)
        kind = a.dtype.str.encode().ljust(4)
        out += [kind, a.size.to_bytes(8, "little"), len(body).to_bytes(8, "little"), body]
    return b"".join(out)


def unpack(blob: bytes) -> list[np.ndarray]:
    code, at, out = zstandard.ZstdDecompressor(), 1, []
    for _ in range(blob[0]):
        kind = np.dtype(blob[at : at + 4].decode().strip())
        n = int.from_bytes(blob[at + 4 : at + 12], "little")
        size = int.from_bytes(blob[at + 12 : at + 20], "little")
        planes = np.frombuffer(code.decompress(blob[at + 20 : at + 20 + size], max_output_size=max(1, n * kind.itemsize)), np.uint8)
        out.append(np.ascontiguousarray(planes.reshape(kind.itemsize, n).T).reshape(-1).view(kind) if n else np.empty(0, kind))
        at += 20 + size
    return out


def pack_sorted(keys: np.ndarray, *more: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)), *more)


def unpack_sorted(blob: bytes) -> list[np.ndarray]:
    gaps, *more = unpack(blob)
    return [np.cumsum(gaps, dtype=np.uint64), *more]


def to_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` (a ``text`` column and any other) as blocks of compressed Arrow rows."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

        def block() -> pa.RecordBatch:
            nonlocal seq, held, size
            sink = pa.BufferOutputStream()
            rows = pa.Table.from_batches(held).combine_chunks()
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(rows)
            out = pa.RecordBatch.from_arrays(
                [pa.array([(task << 24) + seq]), pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([size]), pa.array([rows.num_rows])], ["block", "data", "n_bytes", "n_rows"]
            )
            seq, held, size = seq + 1, [], 0
            return out

        for batch in batches:
            lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column("text")), 0)
            ends = np.cumsum(np.asarray(lengths, dtype=np.int64))
            row = 0
            while row < batch.num_rows:
                before = int(ends[row - 1]) if row else 0
                end = int(np.searchsorted(ends, before + block_bytes - size, "right"))
                end = min(batch.num_rows, max(end, row + (not held)))
                if end > row:
                    held.append(batch.slice(row, end - row))
                    size += int(ends[end - 1]) - before
                    row = end
                if row < batch.num_rows or size >= block_bytes:
                    yield block()
        if held:
            yield block()

    return docs.mapInArrow(cut, BLOCK_SCHEMA)


def open_block(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all().combine_chunks()


def text_of(rows: pa.Table) -> pa.Array:
    column = rows.column("text")
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())


def bucket_count(spark: SparkSession, keys: int) -> int:
    return max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-keys // BUCKET_KEYS))


def split(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's range begins in sorted keys, and the end."""
    edges = np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [keys.size]]).astype(np.int64)


def requests(block: int, buckets: int, keys: np.ndarray, *values: np.ndarray, first: int = 0) -> pa.RecordBatch:
    """Rows that send sorted distinct keys, each with its values, to their buckets, from ``first`` on."""
    at = split(keys, buckets)
    full = [i for i in range(buckets) if at[i] < at[i + 1]]
    blobs = [pack_sorted(keys[at[i] : at[i + 1]], *(v[at[i] : at[i + 1]] for v in values)) for i in full]
    return pa.RecordBatch.from_arrays([pa.array([first + i for i in full], pa.int32()), pa.array([block] * len(full), pa.int64()), pa.array(blobs, pa.binary())], schema=_REQUEST)


def answers(table: pa.Table) -> list[np.ndarray]:
    """A block's answers, in the order of the keys that it sent."""
    order = np.argsort(np.asarray(table.column("bucket")), kind="stable")
    blobs = table.column("blob").to_pylist()
    parts = [unpack(blobs[i]) for i in order]
    if not parts:
        return [np.empty(0)]
    return [np.concatenate(p) for p in zip(*parts, strict=True)]


Merge = Callable[[np.ndarray, list[np.ndarray]], list[np.ndarray]]


def exchange(asked: DataFrame, checked: bool = False, statistics: Callable[[list[np.ndarray]], list[np.ndarray]] | None = None, reply: Callable[[list[np.ndarray], np.ndarray, list[np.ndarray]], list[np.ndarray]] | None = None, below: tuple[int, Callable[[pa.Table], pa.Table]] | None = None) -> DataFrame:
    """Adds up each key's values over all blocks; one answer per request.

    With ``checked`` the first value is a second hash of the key: keys are equal
    only if both hashes are.  ``reply(totals, first, sent)`` makes the answer from
    the totals aligned with the asking block's keys, a flag that is true for one
    asking block of each key, and the block's own values.  ``statistics(totals)`` adds a row of block -1 to
    each bucket, with sums over its distinct keys; see ``summed``.  With ``below``, an
    edge and a function, buckets below the edge are answered by that function.
    """

    def merge(group: pa.Table) -> pa.Table:
        if below and group.column("bucket")[0].as_py() < below[0]:
            return below[1](group)
        order = np.argsort(np.asarray(group.column("block")), kind="stable")
        blobs, ids = group.column("blob").to_pylist(), group.column("block").to_pylist()
        bucket = group.column("bucket")[0].as_py()
        parts = [unpack_sorted(blobs[i]) for i in order]
        sizes = [p[0].size for p in parts]
        keys = np.concatenate([p[0] for p in parts])
        values = [np.concatenate(v) for v in list(zip(*parts, strict=True))[1:]]
        del parts
        sort = np.argsort(keys, kind="stable")
        ordered = keys[sort]
        new = np.ones(keys.size, bool)
        new[1:] = ordered[1:] != ordered[:-1]
        if checked:
            second = values.pop(0)
            by = second[sort]
            if (~new[1:] & (by[1:] != by[:-1])).any():
                sort = np.lexsort((second, keys))
                ordered, by = keys[sort], second[sort]
                new[1:] = (ordered[1:] != ordered[:-1]) | (by[1:] != by[:-1])
        starts = np.flatnonzero(new)
        group_of = np.cumsum(new) - 1
        place = np.empty(keys.size, np.int64)
        place[sort] = group_of
        first = np.zeros(keys.size, bool)
        first[sort[starts]] = True
        totals = [np.add.reduceat(v[sort], starts) for v in values]
        out_blocks, out_blobs, at = [], [], 0
        for i, n in zip(order, sizes, strict=True):
            own = [t[place[at : at + n]] for t in totals]
            out_blobs.append(pack(*(reply(own, first[at : at + n], [v[at : at + n] for v in values]) if reply else own)))
            out_blocks.append(ids[i])
            at += n
        if statistics:
            out_blocks.append(-1)
            out_blobs.append(pack(*statistics(totals)))
        return pa.Table.from_arrays([pa.array(out_blocks, pa.int64()), pa.array([bucket] * len(out_blocks), pa.int32()), pa.array(out_blobs, pa.binary())], schema=_ANSWER)

    return asked.groupBy("bucket").applyInArrow(merge, ANSWER_SCHEMA)


def summed(replies: DataFrame, edge: int) -> list[list[float]]:
    """The buckets' statistics added up: those of buckets below ``edge``, then the others'."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for bucket, blob in zip(b.column("bucket").to_pylist(), b.column("blob").to_pylist(), strict=True):
                (values,) = unpack(blob)
                n = values.size
                yield pa.RecordBatch.from_arrays([pa.array([int(bucket >= edge)] * n), pa.array(range(n), pa.int64()), pa.array(values.astype(np.float64))], ["part", "i", "v"])

    found = replies.filter(F.col("block") == -1).mapInArrow(rows, "part long, i long, v double").groupBy("part", "i").agg(F.sum("v").alias("v")).collect()
    width = 1 + max((r.i for r in found), default=0)
    out = [[0.0] * width, [0.0] * width]
    for r in found:
        out[r.part][r.i] = r.v
    return out


def with_answers(blocks: DataFrame, *replies: DataFrame) -> object:
    """Blocks beside the replies to them, tagged 0, 1, ...; for ``applyInArrow``."""
    tagged = None
    for i, r in enumerate(replies):
        r = r.filter(F.col("block") >= 0).withColumn("tag", F.lit(i))
        tagged = r if tagged is None else tagged.unionByName(r)
    return blocks.groupBy("block").cogroup(tagged.groupBy("block"))


def tagged(table: pa.Table, tag: int, first: int = 0, last: int = 1 << 30) -> list[np.ndarray]:
    """The answers with this tag from buckets ``first`` to ``last``, that one excluded."""
    column = table.column("bucket")
    chosen = pa.compute.and_(pa.compute.equal(table.column("tag"), tag), pa.compute.and_(pa.compute.greater_equal(column, first), pa.compute.less(column, last)))
    return answers(table.filter(chosen))
