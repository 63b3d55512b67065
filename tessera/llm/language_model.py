"""Katz backoff language model over word bigrams.

Good-Turing discounts (counts up to ``TOP``) take mass from seen bigrams and
words; a context's backoff weight gives exactly that mass to the words not seen
after it, so every context's distribution over the vocabulary and one unknown
word sums to 1.  A token's probability is evaluated recursively: the discounted
bigram if it was seen, else the context's weight times the probability of the
shorter history.

Counts cover all training texts.  They live in tables partitioned by ranges of
the n-gram's hash (the buckets of ``exchange``), from which each block of texts
asks for the n-grams that it holds; nothing that grows with the corpus reaches
the driver, only count-of-counts.  Words are told apart by 64-bit hashes, and
so are bigrams; for ten billion distinct n-grams one expects a handful of equal
hashes.

A null text is empty and scores its end token; a null id counts as the empty
text in ``held_out``.  Repeated rows are texts of their own.  Without any
training text every probability is 1.  Columns other than id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from .textbytes import BLANKS, mix, slices

TOP = 5
_K = np.uint64(0x9E3779B185EBCA87)
END = np.uint64(0x5851F42D4C957F2D)
BEGIN = np.uint64(0x14057B7EF767814F)
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def discounts(of_counts: np.ndarray) -> np.ndarray:
    """Factor by which a count of 0 ... ``TOP`` is discounted; ``of_counts[r]`` n-grams occur r times.

    Good-Turing with Katz's correction for large counts.  Where the counts of
    counts give no factor between 0 and 1, half a count is taken away.
    """
    n = np.asarray(of_counts, dtype=float)
    out = np.ones(TOP + 1)
    common = (TOP + 1) * n[TOP + 1] / n[1] if n[1] else 1.0
    for r in range(1, TOP + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if n[r] and common < 1 else 0.0
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


class Unigrams:
    """Word probabilities; ``unknown`` is the mass of all words not seen."""

    def __init__(self, total: float, of_counts: np.ndarray):
        self.total = total
        self.factor = discounts(of_counts)
        r = np.arange(1, TOP + 1)
        freed = float((of_counts[1 : TOP + 1] * r * (1 - self.factor[1:])).sum())
        self.whole = total if freed > 0 else total + 1
        self.unknown = (freed if freed > 0 else 1.0) / self.whole

    def __call__(self, counts: np.ndarray) -> np.ndarray:
        small = np.minimum(counts, TOP).astype(np.int64)
        factor = np.where(counts <= TOP, self.factor[small], 1.0)
        return np.where(counts > 0, counts * factor / self.whole, self.unknown)


def discounted(counts: np.ndarray, factor: np.ndarray) -> np.ndarray:
    small = np.minimum(counts, TOP).astype(np.int64)
    return counts * np.where(counts <= TOP, factor[small], 1.0)


def _tokens(data: bytes) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """A block's rows, its tokens with an end after each text, their contexts, and their rows."""
    rows = X.open_block(data)
    words, contexts, owner = [], [], []
    for part in slices(X.text_of(rows), BLANKS, lower=True):
        h, at = part.hashes(), np.arange(part.rows)
        seq = np.full(h.size + part.rows, END, np.uint64)
        seq[np.arange(h.size) + part.word_rows] = h
        before = np.empty_like(seq)
        before[1:] = seq[:-1]
        before[part.word_at[:-1] + at] = BEGIN
        words.append(seq)
        contexts.append(before)
        owner.append((part.first + np.repeat(at, np.diff(part.word_at) + 1)).astype(np.int32))
    none = np.empty(0, np.uint64)
    return rows, np.concatenate([*words, none]), np.concatenate([*contexts, none]), np.concatenate([*owner, np.empty(0, np.int32)])


class _Block:
    """Distinct words and bigrams of a block, with their places in its tokens."""

    def __init__(self, data: bytes):
        self.rows, words, contexts, self.owner = _tokens(data)
        self.held = np.asarray(self.rows.column("held_out").to_numpy(zero_copy_only=False), dtype=bool)
        self.train = ~self.held[self.owner] if self.owner.size else np.zeros(0, bool)
        self.words, place = np.unique(words, return_inverse=True)
        self.word_of = place.astype(np.int32)
        self.contexts = np.unique(np.append(self.words, BEGIN))
        pairs = mix(contexts * _K + words)
        del words, place
        self.pairs, first, place = np.unique(pairs, return_index=True, return_inverse=True)
        self.pair_of = place.astype(np.int32)
        self.pair_word = self.word_of[first]
        self.pair_context = np.searchsorted(self.contexts, contexts[first]).astype(np.int32)

    def counted(self, n: int, place: np.ndarray) -> np.ndarray:
        return np.bincount(place[self.train], minlength=n).astype(np.int64)

    def context_counts(self, word_counts: np.ndarray) -> np.ndarray:
        """Training tokens that follow each context: a word's own count, and for the beginning the texts."""
        out = np.zeros(self.contexts.size)
        out[np.searchsorted(self.contexts, self.words)] = word_counts
        ends = word_counts[np.searchsorted(self.words, END)] if self.words.size else 0
        out[np.searchsorted(self.contexts, END)] = 0
        out[np.searchsorted(self.contexts, BEGIN)] = ends
        return out


def _ranked(counts: np.ndarray, place: np.ndarray, n: int) -> list[np.ndarray]:
    """For each of ``n`` places: how many of its counts are 1 ... ``TOP``, and the sum of those above.

    Whole numbers add up exactly in any order, and most are 0.
    """
    out = [np.bincount(place[counts == r], minlength=n).astype(np.int32) for r in range(1, TOP + 1)]
    return [*out, np.bincount(place[counts > TOP], counts[counts > TOP], n).astype(np.int64)]


def _weighed(ranked: list[np.ndarray], factor: np.ndarray) -> np.ndarray:
    """The discounted sum of the counts that ``_ranked`` describes."""
    return ranked[TOP] + sum(ranked[r - 1] * (r * factor[r]) for r in range(1, TOP + 1))


def _of_counts(totals: list[np.ndarray]) -> list[np.ndarray]:
    c = totals[0]
    small = np.bincount(c[c <= TOP + 1], minlength=TOP + 2)
    return [np.array([c.sum(), (c > 0).sum(), *small], dtype=np.float64)]


def katz_scores(docs: DataFrame, held_out: F.Column, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Scores every text under a model of the texts for which ``held_out`` is false."""
    spark = docs.sparkSession
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text).cast("string").alias("text"))
    blocks = X.checkpoint(X.to_blocks(source))
    total = blocks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    few = X.bucket_count(spark, total // 30)
    many = X.bucket_count(spark, total // 9)

    def ask_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("data").to_pylist(), strict=True):
                b = _Block(data)
                yield X.requests(block, few, b.words, b.counted(b.words.size, b.word_of))
                yield X.requests(block, many, b.pairs, b.counted(b.pairs.size, b.pair_of), first=few)

    with_owner = lambda totals, first, sent: [totals[0], first.astype(np.uint8)]
    counts = X.checkpoint(X.exchange(blocks.mapInArrow(ask_counts, X.REQUEST_SCHEMA), statistics=_of_counts, reply=with_owner))
    ones, twos = (np.array(x) for x in X.summed(counts, few))
    size, vocabulary = (ones[0], ones[1]) if ones.size > 1 else (0.0, 0.0)
    ones, twos = (np.resize(np.append(x[2:], np.zeros(TOP + 2)), TOP + 2) for x in (ones, twos))
    unigrams = Unigrams(size, ones) if size else None
    factor = discounts(twos)

    def counts_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        pair, own = X.tagged(table, 0, few)
        return X.tagged(table, 0, 0, few)[0], pair, own.astype(bool)

    def ask_weights(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for block, data in zip(left.column("block").to_pylist(), left.column("data").to_pylist(), strict=True):
            b = _Block(data)
            word, pair, own = counts_of(right)
            used = own & (pair > 0)
            n, place = b.contexts.size, b.pair_context[used]
            needed = np.zeros(n, np.uint8)
            needed[b.pair_context[pair == 0]] = 1
            follow = b.context_counts(word).astype(np.int64)
            out.append(X.requests(block, few, b.contexts, *_ranked(pair[used], place, n), *_ranked(word[b.pair_word[used]], place, n), follow, needed))
        return pa.Table.from_batches(out, X._REQUEST)

    def weigh(totals: list[np.ndarray], first: np.ndarray, sent: list[np.ndarray]) -> list[np.ndarray]:
        """Whether a context's tokens are one more than its count, and its backoff weight if the block needs it.

        One token more goes to unseen words if no seen bigram was discounted.
        """
        follow, needed = sent[-2], sent[-1]
        kept = _weighed(totals[: TOP + 1], factor)
        lower = _weighed(totals[TOP + 1 : 2 * TOP + 2], unigrams.factor) / unigrams.whole if unigrams else np.zeros(kept.size)
        more = (follow > 0) & (kept >= follow - 1e-9)
        weight = np.where(more, 1.0, follow - kept) / np.maximum(follow + more, 1) / np.maximum(1 - lower, 1e-300)
        return [more.astype(np.uint8), np.where(needed > 0, weight, 0.0)]

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        tables = []
        for data in left.column("data").to_pylist():
            b = _Block(data)
            n = b.rows.num_rows
            word, pair, _ = counts_of(right)
            more, weight = X.tagged(right, 1)
            follow = b.context_counts(word)
            base = np.log10((word + 1) / (size + vocabulary + 1))
            if unigrams:
                whole = follow + more
                seen = pair > 0
                c = b.pair_context
                p = np.where(seen, discounted(pair, factor) / np.maximum(whole[c], 1), np.where(follow[c] > 0, weight[c], 1.0) * unigrams(word[b.pair_word]))
                logs = np.log10(p)
            else:
                logs = np.zeros(b.pairs.size)
            tables.append(
                pa.Table.from_arrays(
                    [
                        pa.array(b.rows.column("doc_id").to_pylist(), pa.int64()),
                        pa.array(b.held),
                        pa.array(np.bincount(b.owner, minlength=n).astype(np.int64)),
                        pa.array(np.bincount(b.owner, (word > 0)[b.word_of], n).astype(np.int64)),
                        pa.array(np.full(n, int(size), np.int64)),
                        pa.array(np.bincount(b.owner, base[b.word_of], n)),
                        pa.array(np.bincount(b.owner, logs[b.pair_of], n)),
                    ],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )
            )
        return pa.concat_tables(tables)

    asked = X.with_answers(blocks, counts).applyInArrow(ask_weights, X.REQUEST_SCHEMA)
    weights = X.exchange(asked, reply=weigh)
    return X.with_answers(blocks, counts, weights).applyInArrow(score, RESULT)
