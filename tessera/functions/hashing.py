"""Content hashes, 64-bit word fingerprints, and first-wins page deduplication."""

from __future__ import annotations

import hashlib
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import checkpointed
from ..operators.components import components
from .text import words

NEAR_BITS = 3
#: Widths of the bands of a fingerprint.
BANDS = (11, 11, 11, 11, 10, 10)


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def hmac_sha256(message: Column, key: bytes) -> Column:
    """The keyed digest of a message (text or binary) in lower-case hex, as an expression of two plain digests."""
    block = 64
    key = hashlib.sha256(key).digest() if len(key) > block else key
    inner, outer = (bytes(k ^ pad for k in key.ljust(block, b"\0")) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), message.cast("binary")), 256))), 256)


def hmac_by_version(message: Column, version: Column, keys: dict[int, bytes]) -> Column:
    """The digest under the key of each row's version; null for a version that has no key any more."""
    out = F.lit(None).cast("string")
    for number, key in keys.items():
        out = F.when(version == number, hmac_sha256(message, key)).otherwise(out)
    return out


def simhash64(pages: DataFrame, text: str, key: str = "page_id") -> DataFrame:
    """(key, simhash): bit i is set if at least half of the words' digests have it; -1 for no words.

    Votes of a page's words are added up where the page is, so of each page one row is shuffled.
    Bit i is bit i mod 8 of byte i div 8 of the SHA-256 digest.
    """
    # The first eight bytes, the last of them first, as a signed number.
    number = lambda d: F.conv(F.concat(*(F.substring(d, 2 * byte + 1, 2) for byte in reversed(range(8)))), 16, -10).cast("long")
    hashed = pages.select(key, F.explode(words(F.lower(F.col(text)))).alias("w")).select(key, number(F.sha2(F.col("w"), 256)).alias("h"))
    # Two counters in each sum, 32 bits apart.
    bit = lambda i: F.shiftrightunsigned("h", i).bitwiseAND(F.lit(1).cast("long"))
    votes = hashed.groupBy(key).agg(F.count("*").alias("all"), *(F.sum(bit(i) + F.shiftleft(bit(i + 32), 32)).alias(f"v{i}") for i in range(32)))
    value = F.lit(0).cast("long")
    for i in range(64):
        ones = F.shiftrightunsigned(f"v{i - 32}", 32) if i >= 32 else F.col(f"v{i}").bitwiseAND(F.lit((1 << 32) - 1))
        value = value.bitwiseOR(F.when(2 * ones >= F.col("all"), F.lit((1 << i) - (1 << 64 if i == 63 else 0)).cast("long")).otherwise(F.lit(0).cast("long")))
    return pages.select(key).join(votes.select(key, value.alias("simhash")), key, "left").withColumn("simhash", F.coalesce("simhash", F.lit(-1).cast("long")))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def near_pairs(prints: DataFrame, key: str = "page_id", bits: int = NEAR_BITS) -> DataFrame:
    """Pairs a < b within ``bits``.

    Of six bands at least three are equal in a pair of up to three errors, so the keys are
    all choices of three bands, 31 bits or more each: pages meet hardly any others by chance.
    Give one page of each fingerprint; equal ones would all meet.
    """
    if bits > len(BANDS) // 2:
        raise ValueError("too many bits for the bands")
    start = [sum(BANDS[:i]) for i in range(len(BANDS))]
    masks = [((1 << w) - 1) << s for w, s in zip(BANDS, start, strict=True)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    choices = list(combinations(masks, len(BANDS) - bits))
    band = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col("simhash").bitwiseAND(F.lit(signed(sum(c)))).alias("v")) for i, c in enumerate(choices))))
    rows = prints.select(key, "simhash", band.alias("band"))
    a, b = rows.toDF("a", "ha", "band"), rows.toDF("b", "hb", "band")
    return a.join(b, "band").filter((F.col("a") < F.col("b")) & (hamming(F.col("ha"), F.col("hb")) <= bits)).select("a", "b").distinct()


def exact_first(pages: DataFrame, hash_column: str, key: str = "page_id") -> DataFrame:
    """``kept`` for the first page of each content: counts combine before the shuffle, so equal pages are no large group."""
    first = pages.groupBy(hash_column).agg(F.min(key).alias("__first"))
    return pages.join(first, hash_column).withColumn("kept", F.col(key) == F.col("__first")).drop("__first").select(*pages.columns, "kept")


def first_wins(pages: DataFrame, pairs: DataFrame, key: str = "page_id", rounds: int = 2, solo: int = 100_000) -> DataFrame:
    """(key, kept): in order of key a page is kept unless a kept one is near it.

    In rounds a page is dropped once a smaller page near it is kept, and kept once all of those are
    dropped.  That settles most groups at once, but a chain of pages takes as many rounds as it is
    long; so after ``rounds`` of them the groups still open (components of their pairs) that have at
    most ``solo`` pairs are settled each by one task, and only larger ones go on in rounds.  Each
    round is written, so plans don't grow.
    """
    smaller = checkpointed(pairs.select("a", F.col("b").alias("node")))
    state = checkpointed(pages.select(F.col(key).alias("node"), F.lit(None).cast("boolean").alias("kept")))
    at = 0
    while True:
        told = smaller.join(state.select(F.col("node").alias("a"), F.col("kept").alias("k")), "a").groupBy("node").agg(F.bool_or(F.coalesce("k", F.lit(False))).alias("beaten"), F.bool_or(F.col("k").isNull()).alias("waits"))
        kept = F.coalesce("kept", F.when(F.coalesce("beaten", F.lit(False)), False).when(~F.coalesce("waits", F.lit(False)), True))
        state = checkpointed(state.join(told, "node", "left").select("node", kept.alias("kept")))
        if not state.filter("kept IS NULL").limit(1).count():
            return state.select(F.col("node").alias(key), "kept")
        at += 1
        if at == rounds:
            state = _solved(state, smaller, solo)


def _solved(state: DataFrame, smaller: DataFrame, solo: int) -> DataFrame:
    """``state`` with the open components of at most ``solo`` pairs settled."""
    open_ = state.filter("kept IS NULL").select("node")
    # A kept neighbour has dropped its pages already, a dropped one doesn't count: pairs of open pages are left.
    left = checkpointed(smaller.join(open_, "node", "left_semi").join(open_.withColumnRenamed("node", "a"), "a", "left_semi"))
    roots = checkpointed(components(left.select("a", F.col("node").alias("b"))))
    sized = left.join(roots, "node")
    few = sized.groupBy("root").count().filter(F.col("count") <= solo).select("root")

    def settle(table: pa.Table) -> pa.Table:
        near: dict[object, list[object]] = {}
        for a, b in zip(table.column("a").to_pylist(), table.column("node").to_pylist(), strict=True):
            near.setdefault(b, []).append(a)
            near.setdefault(a, [])
        verdict: dict[object, bool] = {}
        for node in sorted(near):
            verdict[node] = not any(verdict[a] for a in near[node])
        return pa.table({"node": pa.array(list(verdict), table.schema.field("node").type), "found": pa.array(list(verdict.values()))})

    kind = state.schema["node"].dataType.simpleString()
    found = sized.join(few, "root", "left_semi").groupBy("root").applyInArrow(settle, f"node {kind}, found boolean")
    return checkpointed(state.join(found, "node", "left").select("node", F.coalesce("kept", "found").alias("kept")))


__all__ = ["content_hash", "exact_first", "first_wins", "hamming", "near_pairs", "simhash64"]
