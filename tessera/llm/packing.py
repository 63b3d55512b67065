"""Best-fit packing of token sequences by a configuration linear program.

Texts are tokenised on the executors, ended by id 0 and, only if longer than a
sequence, cut into pieces.  What reaches the driver is the histogram of piece
lengths, at most ``capacity`` numbers whatever the corpus.  There the
configuration program (least number of sequences, fractions allowed, whose contents
cover the histogram) is solved by multiplicative weights: every length has a price
that falls exponentially with how often it has been covered, pricing finds the
dearest contents of a sequence by a knapsack dynamic program, and each of them is
used until one of its lengths is covered once more.  Prices that no content can beat
are a dual solution, so they bound the number of sequences from below.  The
fractional solution is rounded down, its residue is solved in the same way, and what
no configuration takes is filled best-fit.

A plan has at most some entries per length and configuration, so it is broadcast.
Pieces of one length are ranked in salted groups of bounded size, so a length that a
third of all pieces have is no hot key.

A null text is empty and has the one token 0.  An empty table has no sequences.
Strings of special tokens become their ids, as the tokenizer file has it.  Very long
texts are tokenised whole.  Repeated rows are documents of their own; a null id stays
null; pieces of one length are interchangeable and ranked by id, piece and checksum.
Other columns, also those named like results, aren't read.
"""

from __future__ import annotations

import json
import logging
import re
import zlib
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .exchange import checkpoint

CAPACITY = 2048
#: Pieces of one length that are ranked in one group, about.
GROUP_ROWS = 1024
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_LOG = logging.getLogger(__name__)
RESULT = PIECES + ", sequence_id long, offset long"


#: Fixed value: how byte-level BPE splits a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters on whose classes all engines of regular expressions agree.
_COMMON = re.compile(r"[\t\n\r\x20-\x7e\xa0-\u024f]*")
#: The second engine backtracks over blanks and overflows its stack at some hundred thousand of them.
_BLANKS = re.compile(r"\s{10000}")


class Coder:
    """A tokenizer file's ids.

    The file's own library gives the ids.  Where the file is a plain byte-level BPE,
    whose ids are its merge ranks, a second engine that works from these ranks gives
    the same ids about four times as fast, and takes the texts of common characters
    that hold no special token and no endless run of blanks.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        self.quick, self.special = None, re.compile("|".join(re.escape(t.content) for t in self.exact.get_added_tokens_decoder().values()) or r"(?!)")
        ranks = self._ranks(path)
        if ranks is not None:
            import tiktoken

            self.quick = tiktoken.Encoding("ranks", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})

    @staticmethod
    def _ranks(path: str) -> dict[bytes, int] | None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or split.get("use_regex") is False or spec.get("normalizer"):
            return None
        # Bytes that can be printed stand for themselves; the others are numbered from 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        special = {t["content"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        if any(model["vocab"].get(a + b) != 256 + i for i, (a, b) in enumerate(pairs)):
            return None
        return ranks

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The texts' ids, each followed by id 0."""
        out: list = [None] * len(texts)
        rest = []
        for i, t in enumerate(texts):
            if self.quick and _COMMON.fullmatch(t) and not self.special.search(t) and not _BLANKS.search(t):
                out[i] = self.quick.encode_ordinary(t)
            else:
                rest.append(i)
        if rest:
            for i, e in zip(rest, self.exact.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
                out[i] = e.ids
        return [np.array([*ids, 0], np.uint32) for ids in out]


@cache
def coder(path: str) -> Coder:
    return Coder(path)


def cut(size: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole sequences, but for the first piece."""
    first = size if size <= capacity else size % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, size, capacity))]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The pieces of all documents; ``ids_crc32`` is over their ids as unsigned little-endian 32-bit numbers."""

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                out: list[list] = [[], [], [], [], []]
                for doc, ids in zip(some.column("doc_id").to_pylist(), coder(tokenizer_path).encode(some.column("text").fill_null("").to_pylist()), strict=True):
                    for n, (start, length) in enumerate(cut(ids.size, capacity)):
                        for column, value in zip(out, (doc, n, start, length, zlib.crc32(ids[start : start + length].astype("<u4").tobytes())), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *(pa.array(c, pa.int64()) for c in out[2:])], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(tokenise, PIECES)


Config = tuple[list[tuple[int, int]], int]  # ((length, count), ...) and how many sequences hold it

#: How fast a price falls with the times that its length has been covered.
RATE = 0.05
#: Lengths priced by the knapsack program in all, and the least number of pricings.
PRICED, PRICINGS = 60_000, 32
#: A fractional solution this near to its bound, relatively, is good enough.
GAP = 0.0005


def best_fit(histogram: np.ndarray, capacity: int) -> list[Config]:
    """Best-fit decreasing over a histogram, equal sequences at a time."""
    left = histogram.astype(np.int64).copy()
    out: list[Config] = []
    while (used := np.flatnonzero(left)).size:
        content, room = [], capacity
        while room > 0 and used.size:
            i = np.searchsorted(used, room, "right") - 1
            if i < 0:
                break
            size = int(used[i])
            n = min(room // size, int(left[size]))
            if n > 0:
                content.append((size, n))
                room -= n * size
            used = used[:i]
        times = min(int(left[s]) // n for s, n in content)
        for s, n in content:
            left[s] -= n * times
        out.append((content, times))
    return out


def knapsack(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> np.ndarray:
    """The dearest content of every room up to ``capacity``, any number of pieces of each size.

    Taking k more pieces of a size costs k sizes of room and adds k prices, so along
    rooms that differ by whole sizes the best is a running maximum.
    """
    best = np.zeros(capacity + 1)
    for size, price in zip(sizes.tolist(), prices.tolist(), strict=True):
        rows = capacity // size + 1
        grid = np.full(rows * size, -np.inf)
        grid[: capacity + 1] = best
        climb = price * np.arange(rows)[:, None]
        best = (np.maximum.accumulate(grid.reshape(rows, size) - climb, axis=0) + climb).reshape(-1)[: capacity + 1]
    return np.maximum.accumulate(best)


def content_with(first: int, best: np.ndarray, sizes: np.ndarray, prices: np.ndarray, covered: np.ndarray, slack: float = 2e-3) -> dict[int, int]:
    """Counts by place in ``sizes`` of a dearest content that holds ``first``; of nearly equal choices the least covered."""
    held, room = {first: 1}, best.size - 1 - int(sizes[first])
    while room >= sizes[0] and best[room] > 0:
        n = np.searchsorted(sizes, room, "right")
        good = np.flatnonzero(prices[:n] + best[room - sizes[:n]] >= best[room] * (1 - slack))
        if not good.size:
            break
        i = int(good[covered[good].argmin()])
        held[i] = held.get(i, 0) + 1
        room -= int(sizes[i])
    return held


class Fraction(NamedTuple):
    """A fractional solution: how often each content is used, how often each length is covered, and the dual bound."""

    sizes: np.ndarray
    uses: dict[tuple[tuple[int, int], ...], float]
    covered: np.ndarray
    bound: float

    @property
    def value(self) -> float:
        """Sequences used once every length is covered; infinite if one never was."""
        low = self.covered.min(initial=np.inf)
        return sum(self.uses.values()) / low if low > 0 else float("inf")


def solve(histogram: np.ndarray, capacity: int, rate: float = RATE, priced: int = PRICED, gap: float = GAP) -> Fraction:
    """The configuration program by multiplicative weights.

    Prices begin as the lengths.  At pricings 2, 4, 8, ... the solution starts again
    from the prices reached, which forgets the way there; the mean of the prices since
    then is a dual solution too.  With many lengths, one pricing serves contents for a
    quarter of them, those covered least.
    """
    sizes = np.flatnonzero(histogram)
    need = histogram[sizes].astype(float)
    m = sizes.size
    start, covered, mean = np.zeros(m), np.zeros(m), np.zeros(m)
    uses: dict[tuple[tuple[int, int], ...], float] = {}
    bound, mark = 0.0, 2
    last = max(PRICINGS, priced // m)
    for turn in range(1, last + 1):
        log = start - rate * covered
        prices = sizes / capacity * np.exp(log - log.max())
        best = knapsack(sizes, prices, capacity)
        bound = max(bound, float(prices @ need) / best[capacity])
        mean += prices / best[capacity]
        each = m // 4
        firsts = np.argsort(covered, kind="stable")[:each].tolist() if each > 1 else [int((prices + best[capacity - sizes]).argmax())]
        for first in firsts:
            held = content_with(first, best, sizes, prices, covered)
            places, counts = np.fromiter(held, np.int64), np.array(list(held.values()))
            step = float((need[places] / counts).min())
            covered[places] += counts * step / need[places]
            key = tuple(sorted(held.items()))
            uses[key] = uses.get(key, 0.0) + step
        if turn in (mark, last):
            bound = max(bound, float(mean @ need) / knapsack(sizes, mean, capacity)[capacity])
            low = covered.min()
            if low > 0 and sum(uses.values()) <= low * bound * (1 + gap):
                break
            if 2 * turn <= last and low > 0:
                start, covered, mean, uses = log - log.max(), np.zeros(m), np.zeros(m), {}
            mark *= 2
    return Fraction(sizes, uses, covered, bound)


def rounded(histogram: np.ndarray, found: Fraction) -> tuple[list[Config], np.ndarray]:
    """Whole uses of a fractional solution's contents that cover no length too often, and the histogram left."""
    left, out = histogram.copy(), []
    # A few lengths that were hardly covered don't set the scale.
    scale = 1 / max(found.covered.min(), np.quantile(found.covered, 0.1), 1e-3)

    def use(content: tuple[tuple[int, int], ...], most: int) -> int:
        n = min(most, *(int(left[found.sizes[i]]) // k for i, k in content))
        if n > 0:
            for i, k in content:
                left[found.sizes[i]] -= k * n
            out.append(([(int(found.sizes[i]), k) for i, k in reversed(content)], n))
        return max(n, 0)

    rest = []
    for content, times in sorted(found.uses.items(), key=lambda item: (-item[1], item[0])):
        rest.append((times * scale - use(content, int(times * scale)), content))
    for times, content in sorted(rest, reverse=True):
        if times >= 0.05:
            use(content, 1)
    return out, left


class Plan(NamedTuple):
    configurations: list[Config]
    bound: float  # no plan has fewer sequences

    @property
    def sequences(self) -> int:
        return sum(n for _, n in self.configurations)


def plan(histogram: np.ndarray, capacity: int = CAPACITY) -> Plan:
    """Whole configurations that hold every piece of the histogram once.

    The program is solved and rounded again for what rounding leaves, as long as that
    takes a fair part of the pieces; the rest is filled best-fit.
    """
    left = histogram.astype(np.int64).copy()
    full = int(left[capacity])
    left[capacity] = 0
    out: list[Config] = [([(capacity, 1)], full)] if full else []
    bound = 0.0
    while left.any():
        found = solve(left, capacity)
        bound = bound or found.bound
        part, rest = rounded(left, found)
        out += part
        done = rest.sum() > 0.7 * left.sum() or rest.sum() < 2 * np.count_nonzero(rest)
        left = rest
        if done:
            break
    return Plan(out + best_fit(left, capacity), full + bound)


def places(chosen: list[Config], base: int = 1 << 40) -> dict[str, np.ndarray]:
    """For ranks of pieces of one length: their sequence and offset, as sorted intervals.

    ``key`` is length times ``base`` plus the interval's first rank.
    """
    rank: dict[int, int] = {}
    rows, sequence = [], 0
    for content, times in chosen:
        offset = 0
        for size, n in content:
            at = rank.get(size, 0)
            rows.append((size * base + at, at, sequence, n, offset, size))
            rank[size] = at + n * times
            offset += n * size
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 6)
    return {name: np.ascontiguousarray(table[:, i]) for i, name in enumerate(("key", "first", "sequence", "each", "offset", "size"))}


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Every piece with its sequence and its place there."""
    cutted = checkpoint(pieces(docs, tokenizer_path, capacity, text, doc_id))
    histogram = np.zeros(capacity + 1, np.int64)
    for r in cutted.groupBy("length").count().collect():  # at most ``capacity`` rows
        histogram[r["length"]] = r["count"]
    planned = plan(histogram, capacity)
    _LOG.info("%d sequences planned, at least %.1f needed", planned.sequences, planned.bound)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(places(planned.configurations))
    # One row for each length at most, so it may be broadcast.
    salts = spark.createDataFrame([(i, 1 + int(n) // GROUP_ROWS) for i, n in enumerate(histogram.tolist()) if n], "length long, salts long")
    salted = cutted.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("salts")))
    ordered = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    before = salted.groupBy("length", "salt").count().withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count"))
    ranked = salted.withColumn("rank", F.row_number().over(ordered) - 1).join(before.drop("count"), ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        for batch in batches:
            length, rank = (np.asarray(batch.column(c), dtype=np.int64) for c in ("length", "rank"))
            i = np.searchsorted(t["key"], (length << 40) + rank, "right") - 1
            number, slot = np.divmod(rank - t["first"][i], t["each"][i]) if i.size else (rank, rank)
            out = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            sequence, offset = (t["sequence"][i] + number, t["offset"][i] + slot * length) if i.size else (rank, rank)
            yield pa.RecordBatch.from_arrays([*out, pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("rank").cast("long").alias("rank")).mapInArrow(place, RESULT)
