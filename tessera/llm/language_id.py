"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads segments of ``SEGMENT`` bytes from both ends with gated
recurrent units (update and reset gate; softsign instead of the exponential
functions, so a step is a few vector operations), gives every byte position a
distribution over the languages from both states, and a document's probabilities
are the mean over all its positions.  It is trained in numpy by backpropagation
through time on a bounded sample of labelled passages, and applied to every byte
of every text, many segments side by side.

A null text, or one without any letter, is ``und`` with score 0; so is every
text if no label could be learned.  Of equally probable languages the first by name
is taken.  An empty table gives no rows.  Very long texts are read whole, in segments.
Repeated rows are judged each; other columns, also those named like results, are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import labelled_passages
from .textbytes import bytes_of

SEGMENT = 64
HIDDEN = 8
#: Bound of the training sample: passages, and characters in each.
SAMPLE_ROWS = 6000
SAMPLE_CHARS = 256
UNDETERMINED = "und"
#: Share of a document's positions, by probability, that its language must have; else it is rejected.
LEAST = 0.4
RESULT = "doc_id long, lang_pred string, score double, n_positions long"
_WIDE = 2048
_RUN_BYTES = 4 << 20


def softsign(x: np.ndarray) -> np.ndarray:
    d = np.abs(x)
    d += 1
    return np.divide(x, d, out=d)


@dataclass
class Network:
    """Both directions' weights, stacked: 0 reads forwards and 1 backwards."""

    labels: list[str]
    table: np.ndarray  # (2, 256, 3 h): what a byte adds to update gate, reset gate and candidate
    inner: np.ndarray  # (2, h, 3 h)
    outer: np.ndarray  # (2, h, labels)
    bias: np.ndarray  # (labels,)

    @staticmethod
    def fresh(labels: list[str], hidden: int, rng: np.random.Generator) -> Network:
        draw = lambda *shape, s: (rng.standard_normal(shape) * s).astype(np.float32)
        return Network(labels, draw(2, 256, 3 * hidden, s=0.5), draw(2, hidden, 3 * hidden, s=1 / np.sqrt(hidden)), draw(2, hidden, len(labels), s=0.5), np.zeros(len(labels), np.float32))

    def forward(self, x: np.ndarray, mask: np.ndarray | None, keep: list | None = None) -> np.ndarray:
        """Logits (positions, segments, labels) for bytes (segments, positions).

        ``mask`` (segments, positions) is false behind a segment's end; there the
        state stays zero.  ``keep`` collects each step's values for training.
        """
        n, t = x.shape
        hidden = self.inner.shape[1]
        logits = np.empty((t, n, len(self.labels)), np.float32)
        logits[:] = self.bias
        h = np.zeros((2, n, hidden), np.float32)
        x = np.ascontiguousarray(x.T)
        alive = None if mask is None else np.ascontiguousarray(mask.T)[:, :, None].astype(np.float32)
        for i in range(t):
            given = np.stack([self.table[0].take(x[i], axis=0), self.table[1].take(x[t - 1 - i], axis=0)])
            own = h @ self.inner
            gates = softsign(given[..., : 2 * hidden] + own[..., : 2 * hidden])
            gates *= 0.5
            gates += 0.5
            z, r = gates[..., :hidden], gates[..., hidden:]
            last = own[..., 2 * hidden :]
            new = softsign(given[..., 2 * hidden :] + r * last)
            if keep is not None:
                keep.append((h, gates, new, last))
            h = new + z * (h - new)
            if alive is not None:
                h[0] *= alive[i]
                h[1] *= alive[t - 1 - i]
            logits[i] += h[0] @ self.outer[0]
            logits[t - 1 - i] += h[1] @ self.outer[1]
            if keep is not None:
                keep[-1] += (h,)
        return logits

    def gradients(self, x: np.ndarray, mask: np.ndarray, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy over all positions, and its gradients by backpropagation through time."""
        steps: list = []
        logits = self.forward(x, mask, steps)
        t, n, _ = logits.shape
        p = np.exp(logits - logits.max(-1, keepdims=True))
        p /= p.sum(-1, keepdims=True)
        live = mask.T.astype(np.float32)
        total = live.sum()
        loss = float(-(np.log(np.maximum(p[:, np.arange(n), label], 1e-12)) * live).sum() / total)
        p[:, np.arange(n), label] -= 1
        p *= live[:, :, None] / total
        hidden = self.inner.shape[1]
        d_table, d_inner, d_outer = np.zeros_like(self.table), np.zeros_like(self.inner), np.zeros_like(self.outer)
        d_h = np.zeros((2, n, hidden), np.float32)
        for i in reversed(range(t)):
            before, gates, new, last, h = steps[i]
            here = (i, t - 1 - i)
            d_h = d_h.copy()
            for d in (0, 1):
                d_outer[d] += h[d].T @ p[here[d]]
                d_h[d] += p[here[d]] @ self.outer[d].T
                d_h[d] *= live[here[d]][:, None]
            z, r = gates[..., :hidden], gates[..., hidden:]
            d_new = d_h * (1 - z) * (1 - np.abs(new)) ** 2
            d_gates = np.concatenate([d_h * (before - new), d_new * last], axis=-1)
            d_gates *= 0.5 * (1 - np.abs(2 * gates - 1)) ** 2
            d_given = np.concatenate([d_gates, d_new], axis=-1)
            d_own = np.concatenate([d_gates, d_new * r], axis=-1)
            d_inner += before.transpose(0, 2, 1) @ d_own
            d_h = d_h * z + d_own @ self.inner.transpose(0, 2, 1)
            for d in (0, 1):
                np.add.at(d_table[d], x[:, here[d]], d_given[d])
        return loss, [d_table, d_inner, d_outer, p.sum((0, 1))]


def train(passages: list[tuple[str, str]], hidden: int = HIDDEN, segment: int = SEGMENT, steps: int = 220, batch: int = 192, rate: float = 0.03, seed: int = 7) -> Network | None:
    """A network fitted by Adam to (label, passage) pairs; None without any."""
    labels = sorted({k for k, _ in passages})
    rows, marks = [], []
    for label, text in passages:
        raw = text.encode()
        for at in range(0, len(raw), segment):
            rows.append(raw[at : at + segment])
            marks.append(labels.index(label))
    if not rows:
        return None
    x = np.zeros((len(rows), segment), np.uint8)
    for i, r in enumerate(rows):
        x[i, : len(r)] = np.frombuffer(r, np.uint8)
    mask = np.arange(segment) < np.array([len(r) for r in rows])[:, None]
    marks = np.array(marks)
    of_label = [np.flatnonzero(marks == k) for k in range(len(labels))]
    rng = np.random.default_rng(seed)
    net = Network.fresh(labels, hidden, rng)
    weights = [net.table, net.inner, net.outer, net.bias]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, steps + 1):
        kind = rng.integers(len(labels), size=batch)
        pick = np.array([of_label[k][rng.integers(of_label[k].size)] for k in kind])
        _, grads = net.gradients(x[pick], mask[pick], marks[pick])
        norm = float(np.sqrt(sum(float((g * g).sum()) for g in grads)))
        pace = rate * min(1.0, 2.0 / max(norm, 1e-9)) * (1 - 0.9 * step / steps)
        for w, g, m, v in zip(weights, grads, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def _pooled(net: Network, data: np.ndarray, bounds: np.ndarray, segment: int) -> np.ndarray:
    """Sums over all positions of each text's position probabilities."""
    sizes = np.diff(bounds)
    count = -(-sizes // segment)
    owner = np.repeat(np.arange(sizes.size), count)
    start = np.repeat(bounds[:-1], count) + segment * (np.arange(owner.size) - np.repeat(np.cumsum(count) - count, count))
    length = np.minimum(segment, bounds[1:][owner] - start)
    padded = np.concatenate([data, np.zeros(segment, np.uint8)])
    out = np.zeros((sizes.size, len(net.labels)))
    order = np.argsort(length != segment, kind="stable")
    full = int((length == segment).sum())
    for group in (order[:full], order[full:]):
        for at in range(0, group.size, _WIDE):
            some = group[at : at + _WIDE]
            x = padded[start[some][:, None] + np.arange(segment)]
            mask = None if length[some[0]] == segment else np.arange(segment) < length[some][:, None]
            p = net.forward(x, mask)
            p -= p.max(-1, keepdims=True)
            np.exp(p, out=p)
            p /= p.sum(-1, keepdims=True)
            if mask is not None:
                p *= mask.T[:, :, None]
            sums = p.sum(0, dtype=np.float64)
            for k in range(sums.shape[1]):
                out[:, k] += np.bincount(owner[some], sums[:, k], sizes.size)
    return out


def fit_language_id(docs: DataFrame, learn: F.Column, label: str = "lang", text: str = "text", doc_id: str = "doc_id", rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Network | None:
    """A network that has learned from a sample of at most ``rows`` passages of rows where ``learn`` holds."""
    return train(labelled_passages(docs.filter(learn), label, text, doc_id, rows, chars))


def judge(net: Network | None, texts: pa.Array, letters: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of texts: the first one's row, their languages, scores and byte counts."""
    whole, offsets = bytes_of(texts)
    data = np.frombuffer(whole, np.uint8)
    row = 0
    while row < len(texts):
        end = min(len(texts), max(row + 1, int(np.searchsorted(offsets, offsets[row] + _RUN_BYTES, "right")) - 1))
        size = np.diff(offsets[row : end + 1])
        names, scores = np.full(end - row, UNDETERMINED, object), np.zeros(end - row)
        known = letters[row:end] & (size > 0)
        if net is not None and known.any():
            sums = _pooled(net, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row], SEGMENT)
            names[known] = np.array(net.labels, object)[sums.argmax(1)[known]]
            scores[known] = np.clip(sums.max(1)[known] / size[known], 0, 1)
        yield row, names, scores, size
        row = end


def _with_letters(df: DataFrame, text: str) -> DataFrame:
    """``df`` with a last column, under a name that it doesn't have, that tells whether the text has a letter."""
    name = "__letters"
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return df.withColumn(name, F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))


def _flags(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False), dtype=bool)


def identify(docs: DataFrame, net: Network | None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Each text's language, its pooled probability, and the positions labelled."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    source = _with_letters(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), "text")

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, names, scores, size in judge(shared.value, batch.column("text"), _flags(batch)):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, size.size), pa.array(names.tolist(), pa.string()), pa.array(scores), pa.array(size)], ["doc_id", "lang_pred", "score", "n_positions"])

    return source.mapInArrow(label, RESULT)


def identified(docs: DataFrame, net: Network | None, text: str = "text", label: str = "lang", least: float = LEAST) -> DataFrame:
    """The rows of ``docs``, all columns, whose language the network identifies; a null ``label`` becomes that language.

    A row is rejected if its text has no letter, or if no language has a pooled
    probability of ``least``.  Where nothing could be learned, texts with letters stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)
    place = docs.columns.index(text)
    named = docs.columns.index(label) if label in docs.columns else None

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            letters, schema = _flags(batch), pa.schema(list(batch.schema)[:-1])
            columns = batch.columns[:-1]
            for row, names, scores, size in judge(net, batch.column(place), letters):
                part = [c.slice(row, size.size) for c in columns]
                if named is not None:
                    known = pa.array([None if n == UNDETERMINED else n for n in names.tolist()], part[named].type)
                    part[named] = pa.compute.coalesce(part[named], known)
                stays = letters[row : row + size.size] if net is None else (names != UNDETERMINED) & (scores >= least)
                yield pa.RecordBatch.from_arrays(part, schema=schema).filter(pa.array(stays))

    return _with_letters(docs, text).mapInArrow(keep, docs.schema)
