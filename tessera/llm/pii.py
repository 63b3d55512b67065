"""Personal data, with SQL functions only.

Regular expressions propose spans: electronic mail and network addresses, payment
cards, telephone numbers, bank accounts and short national forms.  Checks confirm
them (octets up to 255, Luhn for cards, mod 97 for accounts, digit counts), and
words within ``NEAR`` characters, whatever lies between, adjust a confirmed span's score: context that fits adds to it, context
of another kind (orders, serial numbers, versions) takes from it.  The four base
kinds are always reported; added spans only from ``min_score`` on.

Patterns find their leftmost match in one pass also in very long texts: possessive
quantifiers and a look-behind keep a failed attempt from being repeated at every
later place of the same run.

A null or empty text has no spans; an empty table gives no rows.  Spans that start at
one place are in the order of kinds.  Repeated rows are scanned each; other columns,
also those named like results, aren't read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .matches import joined, with_matches, with_meeting

#: The patterns of the base kinds.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Patterns of added kinds.
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
NATIONAL = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"

_OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\\.|$)){4}$"
#: Words that speak for a kind, and words that speak against personal data.
CONTEXT = {
    "email": "mail|contact|write to|reach",
    "ip": r"\bip\b|address|host|server|client",
    "card": "card|visa|mastercard|amex|credit|debit|payment",
    "phone": "phone|tel|call|mobile|fax|whatsapp",
    "iban": "iban|account|bank|transfer|konto",
    "national": "ssn|social security|national id|taxpayer",
}
AGAINST = r"order|invoice|serial|version|isbn|part no|sku"
#: Score of a confirmed span before its context is read.
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.9, "national": 0.3}
BASE = ("email", "ip", "card", "phone")


def luhn(digits: str) -> str:
    """SQL: the digits pass Luhn's check."""
    digit = f"cast(substr(reverse({digits}), i, 1) as int)"
    return f"aggregate(sequence(1, length({digits})), 0, (a, i) -> a + CASE WHEN i % 2 = 0 THEN 2 * {digit} - CASE WHEN {digit} > 4 THEN 9 ELSE 0 END ELSE {digit} END) % 10 = 0"


def mod97(account: str) -> str:
    """SQL: the account number, its first four characters moved to the end, is 1 modulo 97."""
    moved = f"concat(substr({account}, 5), left({account}, 4))"
    value = "CASE WHEN c >= 'A' THEN ascii(c) - 55 ELSE cast(c as int) END"
    return f"aggregate(filter(split({moved}, ''), c -> c <> ''), 0, (a, c) -> (a * CASE WHEN c >= 'A' THEN 100 ELSE 10 END + {value}) % 97) = 1"


def _confirmed(df: DataFrame) -> DataFrame:
    card = r"regexp_replace(s.match, '[ -]', '')"
    checks = {
        "ip": rf"s.match rlike r'{_OCTETS}'".replace("\\\\", "\\"),
        "card": f"length({card}) BETWEEN 14 AND 19 AND {luhn(card)}",
        "phone": r"length(regexp_replace(s.match, '[^0-9]', '')) BETWEEN 10 AND 15",
        "iban": f"length(replace(s.match, ' ', '')) BETWEEN 15 AND 34 AND {mod97('replace(s.match, chr(32), chr(0))')}".replace("chr(0)", "''"),
        "national": "NOT s.match rlike '^(000|666|9)' AND NOT s.match rlike '-00-|-0000$'",
    }
    for kind, check in checks.items():
        df = df.withColumn(kind, F.expr(f"filter({kind}, s -> {check})"))
    return df


def find_personal_data(docs: DataFrame, min_score: float = 0.5, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per document: ``base`` and ``spans``, arrays of struct(start, rank, end, kind, match, score).

    Base spans are those of the four base kinds that pass their checks; ``spans``
    has them too, and added ones that overlap none of them.
    """
    df = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    body = F.col("text")
    df = with_matches(df, "text", "email", 0, EMAIL, body.contains("@"))
    df = with_matches(df, "text", "ip", 1, IP, body.rlike(r"[0-9]\.[0-9]"))
    df = with_matches(df, "text", "card", 2, CARD, body.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"))
    df = with_matches(df, "text", "phone", 3, PHONE, body.contains("+"))
    df = with_matches(df, "text", "iban", 4, IBAN, body.rlike(r"[A-Z]{2}[0-9]{2}[A-Z0-9\x20]{8}"))
    df = with_matches(df, "text", "national", 5, NATIONAL, body.rlike(r"[0-9]-[0-9]{2}-[0-9]{4}"))
    df = _confirmed(df.drop("text"))
    near = "lower(concat(s.before, ' ', s.after))"
    for kind, words in CONTEXT.items():
        score = f"round(least(1.0D, greatest(0.0D, {PRIOR[kind]}D + CASE WHEN {near} rlike r'{words}' THEN 0.3D ELSE 0D END - CASE WHEN {near} rlike r'{AGAINST}' THEN 0.2D ELSE 0D END)), 3)"
        df = df.withColumn(kind, F.expr(f"transform({kind}, s -> named_struct('start', s.start, 'rank', s.rank, 'end', s.end, 'kind', s.kind, 'match', s.match, 'score', {score}))"))
    df = df.withColumn("base", F.array_sort(F.concat(*BASE)))
    df = df.withColumn("added", F.expr(f"filter(concat(iban, national), s -> s.score >= {min_score}D)"))
    df = with_meeting(df, "added", "added", "base", 0, meet=False)
    df = df.withColumn("spans", F.array_sort(F.concat("base", "added")))
    return df.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in BASE), "base", "spans")


__all__ = ["BASE", "find_personal_data", "joined", "luhn", "mod97"]
