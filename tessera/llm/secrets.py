"""Secrets in texts, with SQL functions only: multipart credential linking.

Strong candidates are reported by themselves: assignments of long values to
secret-like names, access identifiers and long hexadecimal strings.  Weak ones
prove little alone: forty-character keys, short assigned values, and service
endpoints.  An interval join within each text links a weak candidate to the
access identifiers whose scope (``SCOPE`` characters on either side) it overlaps,
and it is reported only where complementary parts co-occur: a key or a value with
an identifier, an endpoint with an identifier and a key or value.

A null or empty text has no spans; an empty table gives no rows.  Spans that start at
one place are in the order of kinds.  Very long texts are scanned whole, and spans are
linked in one pass over them in order of place.  Repeated rows are scanned each; other
columns, also those named like results, aren't read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .matches import joined, with_masked, with_matches, with_meeting

SCOPE = 200
#: The patterns of the base kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]++)"""
ACCESS = r"AKIA[A-Z0-9]{14,}+"
HEX = r"[0-9a-f]{16,}+"
#: Patterns of weak candidates.  A key may stand right behind an equals sign.
KEY = r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])"
ENDPOINT = r"https?://[A-Za-z0-9.-]++(?::[0-9]++)?(?:/[A-Za-z0-9._~/-]*+)?"
BASE = ("assign", "access", "hex")


def _value(match: str) -> str:
    """SQL: the assigned value, what is left without the name, the separator and quotes."""
    return rf"regexp_replace({match}, r'^[A-Za-z_]+[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?', '')"


def _scanned(df: DataFrame, text: str, scope: int) -> DataFrame:
    """``df`` with the columns of counts, ``base`` and ``spans``."""
    body = F.col(text)
    assigned = (body.contains("=") | body.contains(":")) & body.rlike(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]")
    df = with_matches(df, text, "assign", 0, ASSIGN, assigned, context=False)
    df = with_matches(df, text, "access", 1, ACCESS, body.contains("AKIA"), context=False)
    df = with_matches(df, text, "hex", 2, HEX, body.rlike(r"[0-9a-f]{16}"), context=False)
    linked = F.size("access") > 0
    df = with_matches(df, text, "key", 3, KEY, linked, context=False)
    df = with_matches(df, text, "endpoint", 4, ENDPOINT, linked & body.contains("://"), context=False)
    short = lambda s: f"named_struct('start', {s}.start, 'rank', {s}.rank, 'end', {s}.end, 'kind', {s}.kind, 'match', {s}.match)"
    for kind in (*BASE, "key", "endpoint"):
        df = df.withColumn(kind, F.expr(f"transform({kind}, s -> {short('s')})"))
    df = df.withColumn("assign", F.expr(f"transform(assign, s -> named_struct('span', s, 'size', length({_value('s.match')})))"))
    weak = "transform(filter(assign, s -> s.size BETWEEN 6 AND 11), s -> named_struct('start', s.span.start, 'rank', 5, 'end', s.span.end, 'kind', 'value', 'match', s.span.match))"
    df = df.withColumn("value", F.expr(f"CASE WHEN size(access) > 0 THEN {weak} ELSE slice(access, 1, 0) END"))
    df = df.withColumn("assign", F.expr("transform(filter(assign, s -> s.size >= 12), s -> s.span)"))
    df = df.withColumn("base", F.array_sort(F.concat(*BASE)))
    df = df.withColumn("weak", F.concat("key", "value"))
    df = with_meeting(df, "parts", "weak", "access", scope)
    df = with_meeting(df, "near", "endpoint", "access", scope)
    df = df.withColumn("proof", F.concat("parts", "assign"))
    df = with_meeting(df, "ends", "near", "proof", scope)
    df = df.withColumn("added", F.concat("parts", "ends"))
    df = with_meeting(df, "added", "added", "base", 0, meet=False)
    df = df.withColumn("spans", F.array_sort(F.concat("base", "added")))
    return df.withColumns({f"n_{k}": F.size(k).cast("long") for k in BASE})


def find_secrets(docs: DataFrame, scope: int = SCOPE, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per document: counts, ``base`` and ``spans``, arrays of struct(start, rank, end, kind, match)."""
    df = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return _scanned(df, "text", scope).select("doc_id", *(f"n_{k}" for k in BASE), "base", "spans")


def redacted(docs: DataFrame, mask: str = "[SECRET]", scope: int = SCOPE, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """The rows of ``docs``, all columns, with every reported span masked; ``length`` counts the new text's characters."""
    held = docs.select(F.struct(*docs.columns).alias("__row"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    out = with_masked(_scanned(held, "__text", scope).select("__row", "__text", "spans"), "__text", "spans", mask)
    changed = F.size("spans") > 0
    fresh = {text: F.col("__text")} | ({length: F.length("__text").cast(docs.schema[length].dataType)} if length in docs.columns else {})
    return out.select(*((F.when(changed, fresh[c]).otherwise(F.col("__row")[c]) if c in fresh else F.col("__row")[c]).alias(c) for c in docs.columns))


__all__ = ["BASE", "find_secrets", "joined", "redacted"]
