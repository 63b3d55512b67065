"""Quality classifier by compression.

Two zstandard dictionaries are made of good and of bad labelled passages, whole ones.
A text is cut into blocks of ``BLOCK`` bytes, so short that a text which repeats itself
can't hide it from the dictionaries, and every block is compressed with either: the
dictionary that resembles it makes it smaller.  The difference of the two compressed
sizes, summed over the blocks and divided by the text's bytes (plus a constant that
draws short texts to the prior), is calibrated to a probability by logistic regression
on passages that are in neither dictionary.  Nothing else is read of a text.

Labels come from a bounded sample.  Null and empty texts have no difference and
score the prior of the calibration; without labels of both kinds every score is
the share of good labels, or 0.5 without any.  An empty table has no scores.  Very long
texts are read whole, block by block.  Equal texts have equal scores; repeated
documents are scored each; of a document's repeated labels each counts; other columns,
also those named like results, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import labelled_passages
from .textbytes import bytes_of

BLOCK = 64
#: Bound of the sample: passages of both labels, and characters in each.
SAMPLE_ROWS = 4000
SAMPLE_CHARS = 4096
#: Bytes of whole passages in a dictionary, at most.
DICTIONARY_BYTES = 1 << 20
#: Bytes added to a text's size when its difference is normalised.
SHRINK = 16
LEVEL = 3
RESULT = "doc_id long, score double, size_good long, size_bad long"


@dataclass
class Classifier:
    good: bytes
    bad: bytes
    weights: np.ndarray  # of the features, the last one constant

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        out = []
        for content in (self.good, self.bad):
            book = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            book.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(dict_data=book, write_content_size=False, write_checksum=False, write_dict_id=False))
        return out

    def calibrated(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -60, 60)))


def constant(share: float) -> Classifier:
    """A classifier that has no dictionary and gives every text the same score."""
    return Classifier(b"", b"", np.array([0, np.log((share + 1e-6) / (1 - share + 1e-6))]))


def sizes(codes: list[zstandard.ZstdCompressor], raw: bytes | memoryview, block: int = BLOCK) -> tuple[int, int]:
    """Compressed bytes of a text with the good and the bad dictionary."""
    out = [0, 0]
    for at in range(0, len(raw), block):
        part = raw[at : at + block]
        for i in (0, 1):
            out[i] += len(codes[i].compress(part))
    return out[0], out[1]


def features(good: np.ndarray, bad: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """The normalised difference (0 for an empty text) and a constant."""
    x = (np.asarray(bad, float) - good) / (np.asarray(raw, float) + SHRINK)
    return np.stack([50 * x, np.ones_like(x)], axis=1)


def _regress(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weights of a logistic regression, by Newton steps that are halved until they help."""

    def loss(w: np.ndarray) -> float:
        z = np.where(y == 1, 1, -1) * (x @ w)
        return float((weight * np.logaddexp(0, -z)).sum() + ridge / 2 * (w * w).sum())

    w = np.zeros(x.shape[1])
    now = loss(w)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -60, 60)))
        g = x.T @ (weight * (p - y)) + ridge * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(h, g)
        while (then := loss(w - step)) > now and np.abs(step).max() > 1e-9:
            step = step / 2
        w, gain, now = w - step, now - then, then
        if gain < 1e-9:
            break
    return w


def fit_quality(docs: DataFrame, labels: DataFrame, learn: F.Column, quality: str = "quality", text: str = "text", doc_id: str = "doc_id", rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Classifier:
    """Dictionaries and calibration from at most ``rows`` labelled passages of rows where ``learn`` holds."""
    marks = labels.filter(learn).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(quality).cast("int").alias("mark")).filter("mark in (0, 1) and doc_id is not null")
    share = marks.agg(F.avg("mark")).first()[0]
    n = marks.groupBy("mark").count().collect()
    if len(n) < 2:
        return constant(0.5 if share is None else float(share))
    # The sample is chosen among the labels first: its size is bounded, so it may be broadcast.
    each = rows // 2
    chance = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) / float(1 << 30)
    part = F.when(F.col("mark") == 1, min(1.0, 1.3 * each / next(r["count"] for r in n if r["mark"] == 1))).otherwise(min(1.0, 1.3 * each / next(r["count"] for r in n if r["mark"] == 0)))
    chosen = marks.filter(chance < part).orderBy(F.xxhash64("doc_id"), "doc_id", "mark").limit(2 * rows)
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    found = labelled_passages(texts.join(F.broadcast(chosen), "doc_id"), "mark", "text", "doc_id", rows, chars)
    # One passage in two makes the dictionaries, the other calibrates.
    books, rest = {0: bytearray(), 1: bytearray()}, []
    for i, (mark, passage) in enumerate(found):
        raw = passage.encode()
        if i % 2:
            rest.append((mark, raw))
        elif len(books[mark]) + len(raw) <= DICTIONARY_BYTES:
            books[mark] += raw
    y = np.array([m for m, _ in rest], float)
    if len(set(y.tolist())) < 2 or not (books[0] and books[1]):
        return constant(float(share))
    model = Classifier(bytes(books[1]), bytes(books[0]), np.zeros(2))
    codes = model.compressors()
    pairs = np.array([sizes(codes, raw) for _, raw in rest])
    x = features(pairs[:, 0], pairs[:, 1], np.array([len(raw) for _, raw in rest]))
    # The sample is balanced; weights restore the labels' shares.
    model.weights = _regress(x, y, np.where(y == 1, share / (y == 1).mean(), (1 - share) / (y == 0).mean()))
    return model


def score_quality(docs: DataFrame, model: Classifier, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Each text's probability of a good label, and its compressed sizes."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        codes = model.compressors() if model.good else None
        for batch in batches:
            data, offsets = bytes_of(batch.column("text"))
            n = batch.num_rows
            pairs = np.zeros((n, 2), np.int64)
            if codes:
                for r in range(n):
                    pairs[r] = sizes(codes, data[offsets[r] : offsets[r + 1]])
            x = features(pairs[:, 0], pairs[:, 1], np.diff(offsets))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.calibrated(x)), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["doc_id", "score", "size_good", "size_bad"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(score, RESULT)
