"""Substring deduplication by seed and extend.

Seeds are winnowed anchors: in every window of ``window`` consecutive words the
``SEED_WORDS``-gram with the smallest hash is the window's anchor, so equal windows
always hold the same anchor at the same place.  Documents are joined on anchors: every
occurrence of an anchor that occurs elsewhere too is sent, with the words around it
that a window over it can reach, to the anchor's bucket.  There the occurrences that
match in the anchor's words are extended word by word to the left and to the right,
which splits them into classes that still match; an occurrence whose class is left to
itself is extended no further.  Where a left and a right extension make up a window
and some other occurrence shares both, the window is a repeat.  Overlapping repeats
are merged into the maximal ones of at least ``window`` words, and the words in them
are removed.  Every occurrence is removed, and windows are judged on the input.

Words are compared themselves, not by hashes, with one exception: an anchor with more
than ``HOT`` occurrences would be an unbounded group, so its windows are extended
where they are, and counted by 128-bit hashes of their words.

Nulls, empty texts and texts of fewer words than a window keep all words (none
for null); repeated rows and texts that repeat themselves count as occurrences;
of equally small hashes in a window the first is the anchor; very long texts are
blocks of their own; columns other than the id and the text, also those named like
results, are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from .textbytes import BLANKS, mix, slices

SEED_WORDS = 16
#: Occurrences of an anchor that are joined in one task.
HOT = 1 << 12
#: Text that contexts of one bucket come from, about.
BUCKET_TEXT = 4 << 20
_K1 = np.uint64(0x9E3779B185EBCA87)
_K1_INVERSE = np.uint64(pow(0x9E3779B185EBCA87, -1, 1 << 64))
_OTHER = np.uint64(0x6A09E667F3BCC909)
_LOW = np.uint64((1 << 32) - 1)
ONCE, SHARED, CROWDED = 0, 1, 2
RESULT = "doc_id long, n_words long, n_removed long, kept string, repeats array<struct<start:long,end:long>>"


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * _K1 + b)


def run_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each place on, by doubling."""
    if h.size < n:
        return np.empty(0, np.uint64)
    size, out = 1, mix(h + np.uint64(n))
    while size * 2 <= n:
        out = _join(out[:-size], out[size:])
        size *= 2
    if size < n:
        out = _join(out[: h.size - n + 1], out[n - size : n - size + h.size - n + 1])
    return out


def sliding_least(v: np.ndarray, n: int) -> np.ndarray:
    """Smallest of ``n`` consecutive values from each place on."""
    size, out = 1, v
    while size * 2 <= n:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    m = v.size - n + 1
    return np.minimum(out[:m], out[n - size : n - size + m])


def seed_words(window: int) -> int:
    """Words of an anchor: a window has at most 64 places for it."""
    return max(min(SEED_WORDS, window), window - 63)


class _Anchors:
    """Windows and anchors of one slice of texts."""

    def __init__(self, part, window: int):
        self.part, self.seed = part, seed_words(window)
        span = window - self.seed
        h = self.h = part.hashes()
        sizes = np.diff(part.word_at)
        first, last = np.repeat(part.word_at[:-1], sizes), np.repeat(part.word_at[1:], sizes)
        at = np.flatnonzero(np.arange(h.size) + window <= last)
        self.place, of, self.key = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
        if at.size:
            g = run_hashes(h, self.seed)
            least = sliding_least((g & ~_LOW) | np.arange(g.size, dtype=np.uint64), span + 1)
            self.place, of = np.unique((least & _LOW).astype(np.int64)[at], return_inverse=True)
            self.key = mix(g[self.place])  # the least hashes of windows are small, keys shall be spread evenly
        self.at, self.of = at.astype(np.uint32), of.astype(np.uint32)
        # A block holds all its slices, so what can be had again isn't kept.
        part.starts, part.ends, part.data = part.starts.astype(np.int32), part.ends.astype(np.int32), None
        # Words to either side that a window over the anchor can hold.
        self.left = np.minimum(self.place - first[self.place], span)
        self.right = np.minimum(last[self.place] - self.place - self.seed, span)

    def context_hashes(self) -> np.ndarray:
        """One hash of an anchor with all words around it."""
        if not self.place.size:
            return np.empty(0, np.uint64)
        n = self.h.size
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.h * np.cumprod(np.full(n, _K1)), dtype=np.uint64)])
        back = np.cumprod(np.full(n, _K1_INVERSE))
        start = self.place - self.left
        return mix((sums[self.place + self.seed + self.right] - sums[start]) * back[start] ^ mix((self.left << 6 | self.right).astype(np.uint64)))

    def spaced(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words joined by one blank, and where each begins and ends there."""
        part = self.part
        data = np.frombuffer(part.raw, np.uint8)
        edge = np.zeros(data.size + 1, np.int8)
        edge[part.starts] += 1
        edge[part.ends] -= 1
        sizes = (part.ends - part.starts).astype(np.int64)
        ends = np.cumsum(sizes + 1) - 1
        out = np.full(int(sizes.sum()) + sizes.size, 0x20, np.uint8)
        inside = np.ones(out.size, bool)
        inside[ends] = False
        out[inside] = data[np.cumsum(edge[:-1], dtype=np.int8) > 0]
        return out, ends - sizes, ends


def _slices(data: bytes, window: int) -> tuple[pa.Table, list[_Anchors]]:
    rows = X.open_block(data)
    return rows, [_Anchors(part, window) for part in slices(X.text_of(rows), BLANKS)]


def _together(arrays, kind) -> np.ndarray:
    return np.concatenate([*arrays, np.empty(0, kind)])


def _distinct(k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order of ``k1``, their counts, and each input's place among them."""
    order = np.argsort(k1, kind="stable")
    a, b = k1[order], k2[order]
    if k1.size and (~(a[1:] != a[:-1]) & (b[1:] != b[:-1])).any():
        order = np.lexsort((k2, k1))
        a, b = k1[order], k2[order]
    new = np.ones(a.size, bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    place = np.empty(a.size, np.int64)
    place[order] = np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    return a[new], b[new], np.diff(np.append(starts, a.size)).astype(np.int32), place


class _Asked:
    """What a block asks: contexts of its shared anchors, and windows of its crowded ones."""

    def __init__(self, parts: list[_Anchors], codes: np.ndarray, known: np.ndarray, window: int):
        # ``known`` are the block's distinct anchors, ``codes`` what is known of each.
        code = [codes[np.searchsorted(known, p.key)] if p.key.size else np.empty(0, np.uint8) for p in parts]
        self.rows = [np.flatnonzero(c == SHARED) for c in code]
        keys = _together((p.key[r] for p, r in zip(parts, self.rows, strict=True)), np.uint64)
        around = _together((p.context_hashes()[r] for p, r in zip(parts, self.rows, strict=True)), np.uint64)
        self.keys, _, self.counts, self.context_of = _distinct(keys, around)
        # Windows whose own anchor is crowded.
        self.starts = [p.at[(c == CROWDED)[p.of]].astype(np.int64) if p.at.size else p.at for p, c in zip(parts, code, strict=True)]
        k1 = _together((run_hashes(p.h, window)[s] for p, s in zip(parts, self.starts, strict=True) if s.size), np.uint64)
        k2 = _together((run_hashes(p.h ^ _OTHER, window)[s] for p, s in zip(parts, self.starts, strict=True) if s.size), np.uint64)
        self.k1, self.k2, self.window_counts, self.window_of = _distinct(k1, k2)

    def contexts(self, parts: list[_Anchors], block: int, buckets: int) -> pa.RecordBatch:
        """One row for each bucket: anchors' hashes, words to either side, how often, and the words themselves."""
        if not self.keys.size:
            return X.requests(block, buckets, self.keys)
        first = np.empty(self.keys.size, np.int64)
        first[self.context_of[::-1]] = np.arange(self.context_of.size)[::-1]
        left, right, begin, end, texts, base = [], [], [], [], [], 0
        for p, r in zip(parts, self.rows, strict=True):
            text, starts, ends = p.spaced()
            left.append(p.left[r])
            right.append(p.right[r])
            begin.append(base + starts[p.place[r] - p.left[r]] if r.size else r)
            end.append(base + ends[p.place[r] + p.seed + p.right[r] - 1] if r.size else r)
            texts.append(text)
            base += text.size
        left, right, begin, end, whole = (np.concatenate(x) for x in (left, right, begin, end, texts))
        left, right, begin, end = left[first].astype(np.uint8), right[first].astype(np.uint8), begin[first], end[first]
        at = X.split(self.keys, buckets)
        full, blobs = [], []
        for i in range(buckets):
            s = slice(at[i], at[i + 1])
            if at[i] < at[i + 1]:
                sizes = end[s] - begin[s]
                words = whole[np.repeat(begin[s] - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))]
                full.append(i)
                blobs.append(X.pack_sorted(self.keys[s], left[s], right[s], self.counts[s], sizes.astype(np.int32), words))
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([block] * len(full), pa.int64()), pa.array(blobs, pa.binary())], schema=X._REQUEST)


def _word_numbers(part) -> np.ndarray:
    """A number for each word, equal for equal words only: those of one hash are compared byte by byte."""
    _, one, number = np.unique(part.hashes(), return_index=True, return_inverse=True)
    other = one[number]
    size = part.ends - part.starts
    differ = size != size[other]
    lanes = np.ndarray((part.data.size - 7,), "<u8", part.data, strides=(1,))
    step, rest = 0, np.flatnonzero(~differ)
    while rest.size:
        left = np.minimum(size[rest] - step, 8)
        mask = np.uint64((1 << 64) - 1) >> ((8 - left) * 8).astype(np.uint64)
        differ[rest] = ((lanes[part.starts[rest] + step] ^ lanes[part.starts[other[rest]] + step]) & mask) != 0
        step += 8
        rest = rest[(size[rest] > step) & ~differ[rest]]
    more: dict[bytes, int] = {}
    for i in np.flatnonzero(differ).tolist():
        number[i] = one.size + more.setdefault(part.raw[part.starts[i] : part.ends[i]], len(more))
    return number


def _extensions(first: np.ndarray, columns: list[np.ndarray], room: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """Classes of occurrences that match so far, after none, one, two, ... more words; -1 where none is left to match."""
    out = [first]
    for i, words in enumerate(columns, 1):
        now, then = out[-1], np.full(first.size, -1, np.int32)
        some = np.flatnonzero((now >= 0) & (room >= i))
        if some.size:
            _, kind = np.unique(now[some].astype(np.int64) << 32 | words[some], return_inverse=True)
            then[some] = np.where((np.bincount(kind, counts[some]) >= 2)[kind], kind, -1)
        out.append(then)
    return out


def extended(keys: np.ndarray, left: np.ndarray, right: np.ndarray, counts: np.ndarray, texts: pa.Array, window: int) -> np.ndarray:
    """For occurrences of anchors with the words around them: the windows over each that occur again.

    Bit i of a result stands for the window that begins i words left of the anchor.
    """
    seed = seed_words(window)
    span, n = window - seed, keys.size
    (part,) = slices(texts, BLANKS, limit=1 << 62)
    row = part.word_rows
    words = np.full((2 * span + seed, n), -1, np.int32)
    words[np.arange(row.size) - part.word_at[row] + span - left.astype(np.int64)[row], row] = _word_numbers(part)
    _, one, kind = np.unique(keys, return_index=True, return_inverse=True)
    middle = words[span : span + seed]
    apart = (middle != middle[:, one[kind]]).any(0)
    if apart.any():  # equal hashes of different anchors
        kind[apart] = one.size + np.unique(np.column_stack([kind[apart], middle[:, apart].T]), axis=0, return_inverse=True)[1].reshape(-1)
    first = np.where((np.bincount(kind, counts) >= 2)[kind], kind, -1).astype(np.int32)
    to_left = _extensions(first, [words[span - i] for i in range(1, span + 1)], left, counts)
    to_right = _extensions(first, [words[span + seed + i] for i in range(span)], right, counts)
    found = np.zeros(n, np.uint64)
    for i in range(span + 1):
        a, b = to_left[i], to_right[span - i]
        some = np.flatnonzero((a >= 0) & (b >= 0))
        if some.size:
            _, kind = np.unique(a[some].astype(np.int64) << 32 | b[some], return_inverse=True)
            found[some[(np.bincount(kind, counts[some]) >= 2)[kind]]] |= np.uint64(1 << i)
    return found


def _joined(group: pa.Table, window: int) -> pa.Table:
    """Answers of one bucket of contexts: each asking block's windows that occur again."""
    blocks, blobs = group.column("block").to_pylist(), group.column("blob").to_pylist()
    bucket = group.column("bucket")[0].as_py()
    order = np.argsort(blocks, kind="stable").tolist()
    parts = [X.unpack_sorted(blobs[i]) for i in order]
    del blobs
    keys, left, right, counts, sizes, raw = (np.concatenate(x) for x in zip(*parts, strict=True))
    ends = np.cumsum([p[0].size for p in parts])
    del parts
    offsets = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    texts = pa.LargeStringArray.from_buffers(keys.size, pa.py_buffer(offsets), pa.py_buffer(raw))
    found = extended(keys, left, right, counts, texts, window)
    out = [X.pack(found[b - n : b]) for b, n in zip(ends.tolist(), np.diff(ends, prepend=0).tolist(), strict=True)]
    return pa.Table.from_arrays([pa.array([blocks[i] for i in order], pa.int64()), pa.array([bucket] * len(out), pa.int32()), pa.array(out, pa.binary())], schema=X._ANSWER)


def remove_repeats(docs: DataFrame, window: int = 35, text: str = "text", doc_id: str = "doc_id", hot: int = HOT) -> DataFrame:
    """One row per document: word counts, the text without repeats, and the repeats as spans of words.

    ``kept`` is the text of the words kept, joined by one space.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    blocks = X.checkpoint(X.to_blocks(source))
    total = blocks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    few = X.bucket_count(spark, total // 60)  # an anchor for about ten words
    edge = max(X.bucket_count(spark, 0), -(-total // BUCKET_TEXT))  # buckets of contexts; those of windows follow
    many = X.bucket_count(spark, total // 6)
    span = window - seed_words(window)

    def ask_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, data in zip(b.column("block").to_pylist(), b.column("data").to_pylist(), strict=True):
                keys, counts = np.unique(_together((p.key for p in _slices(data, window)[1]), np.uint64), return_counts=True)
                yield X.requests(block, few, keys, counts.astype(np.int32))

    def judged(totals: list[np.ndarray], first: np.ndarray, sent: list[np.ndarray]) -> list[np.ndarray]:
        return [np.where(totals[0] < 2, ONCE, np.where(totals[0] <= hot, SHARED, CROWDED)).astype(np.uint8)]

    anchors = X.checkpoint(X.exchange(blocks.mapInArrow(ask_anchors, X.REQUEST_SCHEMA), reply=judged))

    def asked_by(parts: list[_Anchors], replies: pa.Table) -> _Asked:
        known = np.unique(_together((p.key for p in parts), np.uint64))
        codes = X.tagged(replies, 0)[0] if known.size else np.empty(0, np.uint8)
        return _Asked(parts, codes, known, window)

    def ask_windows(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for block, data in zip(left.column("block").to_pylist(), left.column("data").to_pylist(), strict=True):
            parts = _slices(data, window)[1]
            own = asked_by(parts, right)
            out += [own.contexts(parts, block, edge), X.requests(block, many, own.k1, own.k2, own.window_counts, first=edge)]
        return pa.Table.from_batches(out, X._REQUEST)

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for data in left.column("data").to_pylist():
            rows, parts = _slices(data, window)
            own = asked_by(parts, right)
            over = X.tagged(right, 1, 0, edge)[0][own.context_of] if own.keys.size else np.empty(0, np.uint64)
            again = X.tagged(right, 1, edge)[0].astype(bool)[own.window_of] if own.k1.size else np.empty(0, bool)
            ids, at, seen = rows.column("doc_id"), 0, 0
            for p, r, starts in zip(parts, own.rows, own.starts, strict=True):
                part, n = p.part, p.h.size
                begins = np.zeros(n + window, bool)
                begins[starts[again[seen : seen + starts.size]]] = True
                for i in range(span + 1):
                    begins[p.place[r[(over[at : at + r.size] >> np.uint64(i)) & np.uint64(1) > 0]] - i] = True
                at, seen = at + r.size, seen + starts.size
                sums = np.concatenate([np.zeros(window, np.int64), np.cumsum(begins)])
                gone = (sums[window : window + n] - sums[:n]) > 0
                out.append(_kept(part, gone, ids.slice(part.first, part.rows)))
        return pa.concat_tables(out) if out else pa.Table.from_arrays([pa.array([], f.type) for f in _KEPT], schema=_KEPT)

    asked = X.with_answers(blocks, anchors).applyInArrow(ask_windows, X.REQUEST_SCHEMA)
    twice = lambda totals, first, sent: [(totals[0] >= 2).astype(np.uint8)]
    windows = X.exchange(asked, checked=True, reply=twice, below=(edge, lambda group: _joined(group, window)))
    return X.with_answers(blocks, anchors, windows).applyInArrow(cut, RESULT)


_KEPT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("repeats", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def _kept(part, gone: np.ndarray, ids: pa.ChunkedArray) -> pa.Table:
    """Result rows of one slice, given which of its words are in repeats."""
    sums = np.concatenate([[0], np.cumsum(gone)])
    n_gone = sums[part.word_at[1:]] - sums[part.word_at[:-1]]
    opens = np.zeros(gone.size + 1, bool)
    opens[part.word_at] = True
    starts = np.flatnonzero(gone & (opens[:-1] | ~np.concatenate([[False], gone[:-1]])))
    ends = np.flatnonzero(gone & (opens[1:] | ~np.concatenate([gone[1:], [False]]))) + 1
    run_at = np.searchsorted(starts, part.word_at)
    kept = []
    for r in range(part.rows):
        tokens = part.raw[part.bounds[r] : part.bounds[r + 1]].split()
        if n_gone[r]:
            tokens = compress(tokens, ~gone[part.word_at[r] : part.word_at[r + 1]])
        kept.append(b" ".join(tokens))
    base = np.repeat(part.word_at[:-1], np.diff(run_at))
    spans = pa.StructArray.from_arrays([pa.array(starts - base, pa.int64()), pa.array(ends - base, pa.int64())], ["start", "end"])
    columns = [ids.combine_chunks(), pa.array(np.diff(part.word_at), pa.int64()), pa.array(n_gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.ListArray.from_arrays(pa.array(run_at, pa.int32()), spans)]
    return pa.Table.from_arrays(columns, schema=_KEPT)
