"""Words of whole texts as numpy arrays.

The Arrow operators of this subpackage read the UTF-8 buffer of a string column
directly: a byte table tells word bytes from separators, word boundaries come
from one pass over the buffer and every word gets a 64-bit hash of its bytes.
Texts are handled in slices of about two megabytes (a longer text is a slice of
its own), so memory follows the slice and not the Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SAME = bytes(range(256))
#: Separators of ``[^\x20\x09-\x0D]+``.
BLANKS = bytes([0x20, *range(0x09, 0x0E)])
#: Separators of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
PUNCTUATION = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])

_P1 = np.uint64(0x9E3779B185EBCA87)
_P2 = np.uint64(0xC2B2AE3D27D4EB4F)
_S29, _S32, _S33 = np.uint64(29), np.uint64(32), np.uint64(33)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (multiply and xor-shift)."""
    h = (h ^ (h >> _S33)) * _P2
    h = (h ^ (h >> _S29)) * _P1
    return h ^ (h >> _S32)


@dataclass
class Slice:
    """Some consecutive texts: ``first`` is the row of the first one in its batch."""

    first: int
    rows: int
    data: np.ndarray  # bytes, with eight zero bytes behind
    raw: bytes  # the same bytes without the padding
    bounds: np.ndarray  # rows + 1 offsets into data
    starts: np.ndarray  # of words
    ends: np.ndarray
    word_at: np.ndarray  # rows + 1 offsets into starts

    @property
    def word_rows(self) -> np.ndarray:
        """The row (from 0 in this slice) of each word."""
        return np.repeat(np.arange(self.rows), np.diff(self.word_at))

    def hashes(self, seed: int = 0) -> np.ndarray:
        """64-bit hashes of the words' bytes."""
        lanes = np.ndarray((self.data.size - 7,), "<u8", self.data, strides=(1,))
        at, left = self.starts, self.ends - self.starts
        h = mix(left.astype(np.uint64) * _P1 + np.uint64(seed))
        part = lanes[at] & _MASKS[np.minimum(left, 8)]
        h = mix(h ^ part)
        more = np.flatnonzero(left > 8)
        step = 8
        while more.size:
            rest = left[more] - step
            part = lanes[at[more] + step] & _MASKS[np.minimum(rest, 8)]
            h[more] = mix(h[more] ^ part)
            step += 8
            more = more[rest > 8]
        return h


_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)


def bytes_of(texts: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The UTF-8 bytes of a string array, and where each text begins and ends there; null texts are empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset) if len(texts) else np.zeros(1, np.int64)
    return memoryview(texts.buffers()[2] or b""), offsets


def slices(texts: pa.Array, separators: bytes, lower: bool = False, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """The texts of an Arrow string array, in order; null texts are empty."""
    n = len(texts)
    if not n:
        return
    if pa.types.is_large_string(texts.type):
        kind = np.int64
    else:
        kind = np.int32
        texts = texts.cast(pa.string()) if not pa.types.is_string(texts.type) else texts
    offsets = np.frombuffer(texts.buffers()[1], kind, n + 1, texts.offset * np.dtype(kind).itemsize).astype(np.int64)
    data = texts.buffers()[2]
    whole = memoryview(data) if data is not None else memoryview(b"")
    if texts.null_count:
        # A null's bytes are undefined: give nulls no bytes.
        valid = np.asarray(texts.is_valid())
        if (np.diff(offsets)[~valid] > 0).any():
            texts = texts.fill_null("")
            yield from slices(texts, separators, lower, limit)
            return
    is_word = bytes(0 if b in separators else 1 for b in range(256))
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(n, max(row + 1, end))
        raw = bytes(whole[offsets[row] : offsets[end]])
        if lower:
            raw = raw.translate(_LOWER)
        bounds = offsets[row : end + 1] - offsets[row]
        size = len(raw)
        flags = np.zeros(size + 2, np.int8)
        flags[1:-1] = np.frombuffer(raw.translate(is_word), np.int8)
        edge = np.diff(flags)  # 1 where a word starts, -1 where one has ended
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        inner = bounds[1:-1]
        inner = inner[(inner > 0) & (inner < size)]
        if inner.size:
            inner = np.unique(inner)
            cut = inner[(flags[inner] == 1) & (flags[inner + 1] == 1)]
            if cut.size:
                starts = np.sort(np.concatenate([starts, cut]))
                ends = np.sort(np.concatenate([ends, cut]))
        data8 = np.frombuffer(raw + b"\0" * 8, np.uint8)
        yield Slice(row, end - row, data8, raw, bounds, starts, ends, np.searchsorted(starts, bounds))
        row = end


def grams(h: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hashes of ``n`` consecutive words at each start; whole runs of ``h`` only."""
    if h.size < n:
        return np.empty(0, np.uint64)
    m = h.size - n + 1
    out = np.full(m, np.uint64((seed * 2 + 1) & ((1 << 64) - 1)), np.uint64)
    for k in range(n):
        out = (out ^ h[k : k + m]) * _P1
        out ^= out >> _S29
    return mix(out)
