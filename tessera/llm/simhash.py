"""SimHash near-duplicates through Golay-code fuzzy hashing.

A text's fingerprint has a bit set if more than half of its word shingles' XXH64
hashes have it.  To find fingerprints within two bits, the 64 bits are cut into
three segments.  By the pigeonhole principle two errors leave one segment exact
and another with at most one error.  A segment is padded to 23 bits and decoded
by the perfect binary Golay code; the codewords of all vectors within one bit
are one or six keys, and two vectors one bit apart share the codeword of either.
So each fingerprint is filed under (exact segment, codeword of another segment)
and asked for under (exact segment, each key of another segment); the join's
condition verifies the distance.

Copies meet as one fingerprint, and only distinct fingerprints are joined.  A
key with more than ``HOT`` of them isn't joined in pairs: its fingerprints ask
for each of their at most 2,080 neighbours by equality, which loses no link and
stays linear.  Groups are connected components by large-star and small-star
steps over distributed links; no link or component reaches the driver.

A null text has no words, and no words give fingerprint zero, which links like
any other.  Repeated rows stay rows.  ``component_id`` passes over null ids and is
null only in a group without any id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import checkpoint
from .textbytes import BLANKS, slices

SEED = 42
HOT = 4096
#: First bit and width of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 generates the Golay code of length 23.
GOLAY = 0b101011100011

_U = np.uint64
_P1, _P2, _P3, _P4, _P5 = (_U(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << _U(r)) | (x >> _U(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * _P2, 31) * _P1


def xxh64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of many byte ranges of a buffer that has eight bytes behind the last one."""
    lanes = np.ndarray((data.size - 7,), "<u8", data, strides=(1,))
    words = np.ndarray((data.size - 7,), "<u4", data, strides=(1,))
    at, left = starts.copy(), ends - starts
    h = np.full(at.size, (seed + int(_P5)) & (2**64 - 1), np.uint64)
    big = np.flatnonzero(left >= 32)
    if big.size:
        acc = [np.full(big.size, (seed + c) & (2**64 - 1), np.uint64) for c in (int(_P1) + int(_P2), int(_P2), 0, -int(_P1))]
        go = np.arange(big.size)
        while go.size:
            p = at[big[go]]
            for i in range(4):
                acc[i][go] = _round(acc[i][go], lanes[p + 8 * i])
            at[big[go]] += 32
            left[big[go]] -= 32
            go = go[left[big[go]] >= 32]
        x = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
        for a in acc:
            x = (x ^ _round(np.zeros_like(a), a)) * _P1 + _P4
        h[big] = x
    h += (ends - starts).astype(np.uint64)
    go = np.flatnonzero(left >= 8)
    while go.size:
        h[go] = _rotl(h[go] ^ _round(np.zeros(go.size, np.uint64), lanes[at[go]]), 27) * _P1 + _P4
        at[go] += 8
        left[go] -= 8
        go = go[left[go] >= 8]
    go = np.flatnonzero(left >= 4)
    h[go] = _rotl(h[go] ^ words[at[go]].astype(np.uint64) * _P1, 23) * _P2 + _P3
    at[go] += 4
    left[go] -= 4
    for _ in range(3):
        go = np.flatnonzero(left > 0)
        h[go] = _rotl(h[go] ^ data[at[go]].astype(np.uint64) * _P5, 11) * _P1
        at[go] += 1
        left[go] -= 1
    h = (h ^ (h >> _U(33))) * _P2
    h = (h ^ (h >> _U(29))) * _P3
    return h ^ (h >> _U(32))


def fingerprints(texts: pa.Array, shingle: int = 3) -> np.ndarray:
    """The unsigned fingerprint of each text."""
    out = [np.empty(0, np.uint64)]
    for part in slices(texts, BLANKS, lower=True):
        n = np.diff(part.word_at)
        normal, sizes = [], part.ends - part.starts
        for r in range(part.rows):
            normal.append(b" ".join(part.raw[part.bounds[r] : part.bounds[r + 1]].split()))
        # Words follow one another with one separator each, between texts too.
        data = np.frombuffer(b" ".join(x for x in normal if x) + b"\0" * 8, np.uint8)
        start = np.cumsum(sizes + 1) - sizes - 1
        end = start + sizes
        count = np.where(n >= shingle, n - shingle + 1, np.minimum(n, 1))
        first = np.repeat(part.word_at[:-1], count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        last = np.where(np.repeat(n, count) >= shingle, first + shingle - 1, np.repeat(part.word_at[1:] - 1, count))
        h = xxh64(data, start[first], end[last])
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        at = np.concatenate([[0], np.cumsum(count)])
        votes = np.zeros((part.rows, 64), np.int64)
        for r in np.flatnonzero(count).tolist():
            votes[r] = bits[at[r] : at[r + 1]].sum(0, dtype=np.int32)
        majority = (2 * votes > count[:, None]).astype(np.uint8)
        out.append(np.packbits(majority, axis=1, bitorder="little").reshape(-1, 8).view("<u8").reshape(-1))
    return np.concatenate(out)


@cache
def _golay_errors() -> np.ndarray:
    """The error of weight 3 or less for each of the 2,048 syndromes."""
    table = np.zeros(2048, np.int64)
    for a in range(23):
        for b in range(a, 23):
            for c in range(b, 23):
                error = np.int64((1 << a) | (1 << b) | (1 << c))
                table[_syndrome(np.array([error]))[0]] = error
    table[0] = 0
    return table


def _syndrome(v: np.ndarray) -> np.ndarray:
    v = v.copy()
    for bit in range(22, 10, -1):
        v ^= ((v >> bit) & 1) * (GOLAY << (bit - 11))
    return v


def golay_index(v: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the codeword within three bits of each 23-bit vector."""
    return (v ^ _golay_errors()[_syndrome(v)]) >> 11


def golay_keys(v: np.ndarray, width: int) -> np.ndarray:
    """Codeword indices of all vectors within one bit of each; -1 fills the rows up."""
    near = np.stack([golay_index(v), *(golay_index(v ^ (1 << i)) for i in range(width))], axis=1)
    near.sort(axis=1)
    near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
    return near


def _keyed(prints: DataFrame, asking: bool) -> DataFrame:
    """(key, fp) rows under which fingerprints are filed, or asked for."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signed = np.asarray(batch.column("fp"), dtype=np.int64)
            for at in range(0, signed.size, 20_000):
                fp = signed[at : at + 20_000]
                cut = [((fp.view(np.uint64) >> _U(s)) & _U((1 << w) - 1)).astype(np.int64) for s, w in SEGMENTS]
                for j, (_, width) in enumerate(SEGMENTS):
                    codes = golay_keys(cut[j], width) if asking else golay_index(cut[j])[:, None]
                    row, col = np.nonzero(codes >= 0)
                    for i in range(3):
                        if i != j:
                            key = ((i * 3 + j) << 40) | (cut[i][row] << 12) | codes[row, col]
                            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row])], ["key", "fp"])

    return prints.select("fp").mapInArrow(emit, "key long, fp long")


def _neighbours(prints: DataFrame) -> DataFrame:
    masks = [1 << i for i in range(64)] + [(1 << i) | (1 << j) for i in range(64) for j in range(i)]
    masks = np.array(masks, np.uint64).view(np.int64)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for fp in np.asarray(batch.column("fp"), dtype=np.int64):
                near = masks ^ fp
                near = near[near > fp]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(near.size, fp)), pa.array(near)], ["a", "b"])

    return prints.select("fp").mapInArrow(emit, "a long, b long")


def links(prints: DataFrame, distance: int = 2, hot: int = HOT) -> DataFrame:
    """Pairs a < b of the distinct fingerprints ``prints.fp`` that differ in ``distance`` bits or less (two at most)."""
    if not 0 <= distance <= 2:
        raise ValueError("the segments find up to two differing bits")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    filed = _keyed(prints, asking=False).withColumnRenamed("fp", "a")
    # The join infers this filter below the window; with it in both uses of ``asked``, they share one shuffle.
    asked = _keyed(prints, asking=True).filter("key is not null").withColumnRenamed("fp", "b").selectExpr("*", "count(*) over (partition by key) as n")
    pairs = filed.join(asked.filter(F.col("n") <= hot), (filed.key == asked.key) & (F.col("a") < F.col("b")) & near).select("a", "b")
    crowded = asked.filter(F.col("n") > hot).select(F.col("b").alias("fp")).distinct()
    more = _neighbours(crowded).filter(near).join(prints.select(F.col("fp").alias("b")), "b", "left_semi").select("a", "b")
    # A link from a fingerprint in a crowded key to a smaller one is found from the smaller, which is in that key too.
    return pairs.unionByName(more).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of ``edges`` (a, b) with the smallest node that it reaches."""
    edges = checkpoint(edges.filter("a != b").selectExpr("greatest(a, b) as a", "least(a, b) as b").distinct())
    state = None
    while True:
        now = tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())
        if now == state or not now[0]:
            break
        state = now
        both = edges.unionByName(edges.selectExpr("b as a", "a as b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").selectExpr("b as a", "m as b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b != m").selectExpr("b as a", "m as b").unionByName(least.selectExpr("a", "m as b"))
        edges = checkpoint(small.distinct())
    return edges.selectExpr("a as node", "b as root").unionByName(edges.selectExpr("b as node", "b as root")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 2, text: str = "text", doc_id: str = "doc_id", hot: int = HOT) -> DataFrame:
    """Each document's fingerprint (hexadecimal) and the smallest id of its group."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fingerprints(batch.column("text"), shingle).view(np.int64))], ["doc_id", "fp"])

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    printed = checkpoint(source.mapInArrow(hashed, "doc_id long, fp long"))
    prints = checkpoint(printed.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = checkpoint(components(links(prints, distance, hot)))
    rooted = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    groups = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(groups, "root").select("fp", "component_id")
    return printed.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
