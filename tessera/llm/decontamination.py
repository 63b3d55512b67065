"""Benchmark decontamination with an FM-index per training shard.

A shard is a slice of whole training texts (about four megabytes) inside its
Arrow batch.  Its word sequence is mapped to the benchmark's vocabulary; a word
outside it ends a run, and runs shorter than the shortest test phrase can hold
no match and are left out.  Over the remaining runs the shard gets an FM-index:
suffix order by prefix doubling, the Burrows-Wheeler transform in a wavelet
matrix for ranks, and suffix positions sampled every ``SAMPLE`` words of a run.
All test phrases are searched backwards at once, occurrences are located through
the samples, and overlapping ones merge into removal spans.

The benchmark is collected and broadcast in blocks of at most ``BLOCK_BYTES`` of
text, one broadcast each.  A task reads one block after the other for each shard and
lets go of it before the next, and the driver makes one at a time, so both hold one
block whatever the benchmark's size.  Training texts never leave their task: there is
no shuffle of them.

Words are equal if their 64-bit hashes are.  Null texts have no words; empty items have
no phrase; items may repeat, and an item counts once; the items of a document are in
order of their ids as strings.  An item without an id still marks words, but isn't
listed.  Without documents or without items there is nothing to find.  A very long text
is a shard of its own.  Repeated documents are judged each; other columns, also those
named like results, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import checkpoint
from .textbytes import PUNCTUATION, slices

PHRASE_WORDS = 10
SAMPLE = 8
SHARD_BYTES = 4 << 20
BLOCK_BYTES = 8 << 20
RESULT = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"


class WaveletMatrix:
    """Ranks of symbols in a sequence of integers below ``2**bits``."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        for level in reversed(range(bits)):
            bit = ((seq >> level) & 1).astype(np.int32)
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(int(seq.size - bit.sum()))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        low, high = np.zeros(end.size, np.int64), end.astype(np.int64)
        for i, level in enumerate(reversed(range(self.bits))):
            one = ((symbol >> level) & 1).astype(bool)
            a, b = self.ones[i][low], self.ones[i][high]
            low = np.where(one, self.zeros[i] + a, low - a)
            high = np.where(one, self.zeros[i] + b, high - b)
        return high - low


class FMIndex:
    """Index of a sequence in which 0 separates runs of symbols from 1 on; it ends with a 0."""

    def __init__(self, seq: np.ndarray, sample: int = SAMPLE):
        n = seq.size
        gaps = np.flatnonzero(seq == 0)
        m = gaps.size
        # Separators are terminators of their own, in order of place, before all symbols.
        rank = seq.astype(np.int64) + m - 1
        rank[gaps] = np.arange(m)
        step = 1
        while True:
            order = np.argsort(rank, kind="stable")
            ranked = rank[order]
            new = np.ones(n, bool)
            new[1:] = ranked[1:] != ranked[:-1]
            if new.all():
                break
            dense = np.empty(n, np.int64)
            dense[order] = np.cumsum(new) - 1
            ahead = np.zeros(n, np.int64)
            ahead[:-step] = dense[step:] + 1
            rank = dense * (n + 1) + ahead
            step *= 2
        self.last = seq[order - 1]  # the symbol before each suffix; before the first stands the final 0
        self.size = n
        top = int(seq.max(initial=0))
        self.ranks = WaveletMatrix(self.last, max(1, top.bit_length()))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=top + 1))])
        self.top = top
        begins = np.concatenate([[0], gaps[:-1] + 1]) if m else np.zeros(0, np.int64)
        inside = np.arange(n) - np.repeat(begins, np.diff(np.append(begins, n)))
        known = (inside % sample == 0)[order]
        self.sampled = np.where(known, order, -1)

    def count(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals of right-aligned phrases (rows padded with 0 on the left)."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size, np.int64)
        width = phrases.shape[1] if phrases.size else 0
        for j in range(1, width + 1):
            at = np.flatnonzero((lengths >= j) & (low < high))
            if not at.size:
                break
            c = phrases[at, width - j].astype(np.int64)
            known = c <= self.top
            high[at[~known]] = low[at[~known]]
            at, c = at[known], c[known]
            low[at], high[at] = self.first[c] + self.ranks.rank(c, low[at]), self.first[c] + self.ranks.rank(c, high[at])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places of suffixes, walking back to the nearest sampled one."""
        rows, steps = rows.astype(np.int64).copy(), np.zeros(rows.size, np.int64)
        todo = np.flatnonzero(self.sampled[rows] < 0)
        while todo.size:
            c = self.last[rows[todo]].astype(np.int64)
            rows[todo] = self.first[c] + self.ranks.rank(c, rows[todo])
            steps[todo] += 1
            todo = todo[self.sampled[rows[todo]] < 0]
        return self.sampled[rows] + steps


class Phrases:
    """The test phrases of some benchmark items, over a vocabulary of word hashes."""

    def __init__(self, ids: list, texts: list, length: int = PHRASE_WORDS):
        rows, items = [], []
        hashes = []
        for part in slices(pa.array([t or "" for t in texts], pa.string()), PUNCTUATION, lower=True):
            h = part.hashes()
            hashes += [(part.first + r, h[part.word_at[r] : part.word_at[r + 1]]) for r in range(part.rows)]
        self.vocabulary = np.unique(np.concatenate([np.empty(0, np.uint64), *(h for _, h in hashes)]))
        for item, h in hashes:
            symbols = np.searchsorted(self.vocabulary, h).astype(np.int32) + 1
            if 0 < h.size < length:
                row = np.zeros((1, length), np.int32)
                row[0, length - h.size :] = symbols
            elif h.size:
                row = np.lib.stride_tricks.sliding_window_view(symbols, length)
            else:
                continue
            rows.append(row)
            items.append(np.full(len(row), item))
        table = np.concatenate([np.zeros((0, length), np.int32), *rows])
        self.phrases, of = np.unique(table, axis=0, return_inverse=True)
        self.lengths = (self.phrases > 0).sum(1)
        self.shortest = int(self.lengths.min(initial=length))
        # The items of phrase p are item_of[item_at[p] : item_at[p + 1]].
        pairs = np.unique(np.stack([of.reshape(-1), np.concatenate([np.zeros(0, np.int64), *items])]), axis=1) if len(table) else np.zeros((2, 0), np.int64)
        self.item_of, self.item_at = pairs[1], np.searchsorted(pairs[0], np.arange(len(self.phrases) + 1))
        self.ids = [None if i is None else str(i) for i in ids]
        self.near = np.zeros(1 << 16, bool)
        self.near[(self.vocabulary >> np.uint64(48)).astype(np.int64)] = True

    def symbols(self, h: np.ndarray) -> np.ndarray:
        """Each word's symbol; 0 if it isn't in the vocabulary."""
        out = np.zeros(h.size, np.int32)
        at = np.flatnonzero(self.near[(h >> np.uint64(48)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.vocabulary, h[at]), self.vocabulary.size - 1)
        found = self.vocabulary[place] == h[at]
        out[at[found]] = place[found] + 1
        return out

    def occurrences(self, h: np.ndarray, word_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, first word) of every occurrence in texts whose words begin at ``word_at``."""
        nothing = np.empty(0, np.int64), np.empty(0, np.int64)
        if not h.size or not self.vocabulary.size:
            return nothing
        symbol = self.symbols(h)
        begins = np.zeros(h.size + 1, bool)
        begins[word_at] = True
        inside = symbol > 0
        start = np.flatnonzero(inside & (begins[:-1] | ~np.concatenate([[False], inside[:-1]])))
        end = np.flatnonzero(inside & (begins[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
        long = end - start >= self.shortest
        start, end = start[long], end[long]
        if not start.size:
            return nothing
        sizes = end - start
        base = np.cumsum(sizes + 1) - sizes - 1
        place = np.repeat(start - base, sizes + 1) + np.arange(int(sizes.sum()) + sizes.size)
        seq = symbol[np.minimum(place, h.size - 1)]
        seq[base + sizes] = 0
        # Symbols are renumbered to those of this shard.
        used = np.unique(seq)
        if used[0] != 0:
            used = np.concatenate([[0], used])
        number = np.full(self.vocabulary.size + 1, -1, np.int64)
        number[used] = np.arange(used.size)
        seq = number[seq]
        known = np.where(self.phrases > 0, number[self.phrases], 0)
        possible = np.flatnonzero((known >= 0).all(1))
        if not possible.size:
            return nothing
        index = FMIndex(seq)
        low, high = index.count(known[possible], self.lengths[possible])
        n = high - low
        rows = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
        return np.repeat(possible, n), place[index.locate(rows)]


def _covered(spans: np.ndarray) -> np.ndarray:
    """Starts and ends merged from starts (row 0, sorted) and ends (row 1)."""
    reach = np.maximum.accumulate(spans[1])
    new = np.ones(spans.shape[1], bool)
    new[1:] = spans[0, 1:] > reach[:-1]
    first = np.flatnonzero(new)
    return np.stack([spans[0, first], reach[np.append(first[1:], spans.shape[1]) - 1]])


def benchmark_blocks(benchmark: DataFrame, text: str = "text", item_id: str = "item_id", block_bytes: int = BLOCK_BYTES) -> list:
    """Broadcasts of the benchmark's phrases, each made from at most about ``block_bytes`` of text."""
    items = benchmark.select(F.col(item_id).cast("string").alias("id"), F.col(text).cast("string").alias("text")).filter("text is not null").distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = -(-size // block_bytes)
    if n > 1:
        items = checkpoint(items)
    context = benchmark.sparkSession.sparkContext
    out = []
    for i in range(n):
        rows = items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == i).collect()
        out.append(context.broadcast(Phrases([r.id for r in rows], [r.text for r in rows])))
    return out


def _each(blocks: list) -> Iterator[Phrases]:
    """The blocks' phrases; of several, one at a time is held."""
    for block in blocks:
        yield block.value
        if len(blocks) > 1:
            vars(block).pop("_value", None)  # a worker's copy, read again when it is asked for


def _search(blocks: list, texts: pa.Array) -> Iterator[tuple]:
    """For each shard: the slice, its words' rows, and sorted occurrences as (starts, ends) with items by row."""
    for part in slices(texts, PUNCTUATION, lower=True, limit=SHARD_BYTES):
        h, row_of = part.hashes(), part.word_rows
        starts, ends, names = [np.empty(0, np.int64)], [np.empty(0, np.int64)], {}
        for phrases in _each(blocks):
            which, first = phrases.occurrences(h, part.word_at)
            starts.append(first)
            ends.append(first + phrases.lengths[which])
            held = np.unique(np.stack([row_of[first], which]), axis=1)
            for r, p in held.T.tolist():
                names.setdefault(r, set()).update(phrases.ids[i] for i in phrases.item_of[phrases.item_at[p] : phrases.item_at[p + 1]].tolist())
        both = np.stack([np.concatenate(starts), np.concatenate(ends)])
        yield part, row_of, both[:, np.lexsort((both[1], both[0]))], names


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per document: its words, those inside test phrases, the items found, and spans of words to remove."""
    blocks = benchmark_blocks(benchmark)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, row_of, found, names in _search(blocks, batch.column("text")):
                hits, spans = np.zeros(part.rows, np.int64), {}
                rows = row_of[found[0]]
                for r in np.unique(rows).tolist():
                    a, b = np.searchsorted(rows, [r, r + 1])
                    merged = _covered(found[:, a:b])
                    hits[r] = (merged[1] - merged[0]).sum()
                    spans[r] = [{"start": int(s), "end": int(e)} for s, e in (merged - part.word_at[r]).T]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(part.first, part.rows),
                        pa.array(np.diff(part.word_at).astype(np.int64)),
                        pa.array(hits),
                        pa.array([sorted(x for x in names.get(r, ()) if x is not None) for r in range(part.rows)], pa.list_(pa.string())),
                        pa.array([spans.get(r, []) for r in range(part.rows)], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    ],
                    ["doc_id", "n_words", "n_hit", "items", "spans"],
                )

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(search, RESULT)


def uncontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no test phrase."""
    blocks = benchmark_blocks(benchmark)
    place = docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, row_of, found, _ in _search(blocks, batch.column(place)):
                clean = np.ones(part.rows, bool)
                clean[row_of[found[0]]] = False
                yield batch.slice(part.first, part.rows).filter(pa.array(clean))

    return docs.mapInArrow(keep, docs.schema)
