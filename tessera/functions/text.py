"""Text analysis: normalisation, tokens, stop words and stems, as columns and for single strings.

Both forms share the fixed values below.  Columns stay inside the JVM, but for
compatibility normalisation (NFKC), which Spark lacks: texts with a character that it
might change, and only those, pass through an Arrow function.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..settings import Arabic, IndexSettings

# Arabic letter classes, affixes, and the English suffix rules, in order.
DIACRITICS = "\u0610-\u061a\u064b-\u065f\u0670\u06d6-\u06ed"
TATWEEL = "ـ"
ALEF_FORMS, ALEF = "أإآٱ", "ا"
YA_FORMS, YA = "ىی", "ي"
TAA_MARBUTA, HA = "ة", "ه"
ARABIC = "\u0600-\u06ff"
PREFIXES = ("وال", "بال", "كال", "فال", "لل", "ال")
SUFFIXES = ("يات", "يون", "يين", "ات", "ون", "ين", "ها", "هم", "هن", "ية", "ه", "ي")
RULES = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"),
    ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"),
    ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"),
    ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"),
    ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
LEAST_STEM = 3


@F.pandas_udf(T.StringType())
def _nfkc(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield s.map(lambda x: x if x is None else unicodedata.normalize("NFKC", x))


#: Characters that normalisation might change: those of Latin scripts that it does change, and all beyond them.
UNSTABLE = "[" + "".join(f"\\u{c:04x}" for c in range(0x80, 0x250) if unicodedata.normalize("NFKC", chr(c)) != chr(c)) + "]|[^\\u0000-\\u024f]"


def nfkc(text: Column) -> Column:
    """Compatibility normalisation; stable texts don't leave the JVM."""
    changed = _nfkc(F.when(text.rlike(UNSTABLE), text))
    return F.coalesce(changed, text)


def normalized_arabic(text: Column, how: Arabic = Arabic()) -> Column:
    if how.tatweel:
        text = F.translate(text, TATWEEL, "")
    if how.diacritics:
        text = F.regexp_replace(text, f"[{DIACRITICS}]", "")
    if how.alef:
        text = F.translate(text, ALEF_FORMS, ALEF * len(ALEF_FORMS))
    if how.ya:
        text = F.translate(text, YA_FORMS, YA * len(YA_FORMS))
    return F.translate(text, TAA_MARBUTA, HA) if how.taa_marbuta else text


def normalized(text: Column, settings: IndexSettings = IndexSettings()) -> Column:
    return normalized_arabic(F.lower(nfkc(text) if settings.nfkc else text), settings.arabic)


def words(text: Column) -> Column:
    """Runs of letters and digits, in order."""
    return F.filter(F.split(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")


def cleaned(text: Column) -> Column:
    """White space, also beyond ASCII, collapsed to single spaces and trimmed."""
    return F.trim(F.regexp_replace(text, "(?U)[\\s\\uFEFF]+", " "))


def as_text(df: DataFrame, field: str) -> Column:
    """A field's text: a string itself, the strings of an array joined by spaces, nothing for other types."""
    kind = df.schema[field].dataType
    if isinstance(kind, T.StringType):
        return F.col(field)
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
        return F.concat_ws(" ", F.col(field))
    return F.lit(None).cast("string")


def snippet(text: Column, longest: int = 320) -> Column:
    return F.when(F.length(text) > longest, F.concat(F.substring(text, 1, longest - 3), F.lit("…"))).otherwise(text)


def escaped_like(needle: str) -> str:
    """A needle as a literal part of a LIKE pattern."""
    return re.sub(r"([\\%_])", r"\\\1", needle)


def is_arabic(word: Column) -> Column:
    return word.rlike(f"[{ARABIC}]")


def english_steps(word: str = "raw") -> list[list[str]]:
    """SQL of the stemming steps; each reads columns that the ones before have made.

    Steps: ``plural`` with ``fixed`` (the word is done), ``verb``, ``rule`` and ``term``.
    The text is plain SQL, so that one definition serves every engine.
    """
    fixed = f"(length({word}) < 4 OR ({word} LIKE '%ss' AND NOT {word} LIKE '%sses'))"
    plural = f"CASE WHEN {fixed} THEN {word} WHEN {word} LIKE '%sses' OR {word} LIKE '%ies' THEN left({word}, length({word}) - 2) WHEN {word} LIKE '%s' THEN left({word}, length({word}) - 1) ELSE {word} END"
    verb = "CASE WHEN fixed THEN plural WHEN plural LIKE '%eed' AND length(plural) > 5 THEN left(plural, length(plural) - 1) WHEN plural LIKE '%ing' AND length(plural) > 6 THEN left(plural, length(plural) - 3) WHEN plural LIKE '%ed' AND length(plural) > 5 THEN left(plural, length(plural) - 2) ELSE plural END"
    # The first rule of the list that leaves a long enough stem; plain comparisons, no regular expression a token.
    first = " ".join(f"WHEN verb LIKE '%{x}' AND length(verb) >= {len(x) + LEAST_STEM} THEN '{x}'" for x, _ in RULES)
    cases = " ".join(f"WHEN '{x}' THEN '{y}'" for x, y in RULES)
    return [[f"{plural} AS plural", f"{fixed} AS fixed"], [f"{verb} AS verb"], [f"CASE WHEN fixed THEN '' {first} ELSE '' END AS suffix"], [f"CASE WHEN suffix = '' THEN verb ELSE concat(left(verb, length(verb) - length(suffix)), CASE suffix {cases} END) END AS rule"], ["CASE WHEN NOT fixed AND rule LIKE '%e' AND length(rule) > 4 THEN left(rule, length(rule) - 1) ELSE rule END AS term"]]


def with_stems(tokens: DataFrame, settings: IndexSettings = IndexSettings()) -> DataFrame:
    """``tokens`` (a column ``raw``) with ``term``: the English stem, or the light Arabic stem of Arabic words."""
    own, df = tokens.columns, tokens
    for step in english_steps("raw"):
        df = df.selectExpr("*", *step)
    df = df.select(*own, "term")
    arabic = is_arabic(F.col("raw"))
    if not settings.arabic.light_stem:
        return df.select(*own, _kept_apart(F.when(arabic, F.col("raw")).otherwise(F.col("term"))).alias("term"))
    # Both lists have longer affixes before shorter ones, so the regular expressions find the first that fits.
    bare = F.regexp_replace("raw", f"^(?:{'|'.join(PREFIXES)})(?=.{{{LEAST_STEM}}})", "")
    stem = F.regexp_replace(bare, f"^(.{{{LEAST_STEM},}}?)(?:{'|'.join(SUFFIXES)})$", "$1")
    return df.select(*own, _kept_apart(F.when(arabic, stem).otherwise(F.col("term"))).alias("term"))


def _kept_apart(term: Column) -> Column:
    """The same value, as the row of a generator: a filter on it, such as a join infers, would else be
    pushed below the steps and hold a copy of all of them for each mention of the term."""
    return F.explode(F.array(term))


def token_count(text: Column, settings: IndexSettings = IndexSettings()) -> Column:
    """How many tokens a text has, stop words left out."""
    stop = {k: settings.stop_words.get(k, ()) for k in ("ar", "en")}
    found = words(normalized(text, settings))
    if stop["ar"]:
        found = F.filter(found, lambda w: ~(is_arabic(w) & w.isin(*stop["ar"])))
    if stop["en"]:
        found = F.filter(found, lambda w: is_arabic(w) | ~w.isin(*stop["en"]))
    return F.size(found)


def without_stop_words(tokens: DataFrame, settings: IndexSettings) -> DataFrame:
    """Positions are kept, so stop words leave gaps."""
    arabic, english = settings.stop_words.get("ar", ()), settings.stop_words.get("en", ())
    if arabic:
        tokens = tokens.filter(~(is_arabic(F.col("raw")) & F.col("raw").isin(*arabic)))
    if english:
        tokens = tokens.filter(is_arabic(F.col("raw")) | ~F.col("raw").isin(*english))
    return tokens


def analyzed(df: DataFrame, text: str, settings: IndexSettings = IndexSettings()) -> DataFrame:
    """One row per token: the other columns, ``pos`` (from 0), ``raw`` and ``term``."""
    others = [c for c in df.columns if c != text]
    tokens = df.select(*others, F.posexplode(words(normalized(F.col(text), settings))).alias("pos", "raw"))
    return with_stems(without_stop_words(tokens, settings), settings)


# Single strings, for queries on the driver and for tests.


def normalize_arabic_text(text: str, how: Arabic = Arabic()) -> str:
    text = unicodedata.normalize("NFKC", text)
    drop = (TATWEEL if how.tatweel else "")
    text = text.translate(dict.fromkeys(map(ord, drop)))
    if how.diacritics:
        text = re.sub(f"[{DIACRITICS}]", "", text)
    if how.alef:
        text = text.translate(dict.fromkeys(map(ord, ALEF_FORMS), ALEF))
    if how.ya:
        text = text.translate(dict.fromkeys(map(ord, YA_FORMS), YA))
    return text.replace(TAA_MARBUTA, HA) if how.taa_marbuta else text


#: Texts without these characters are Latin: they have no Arabic letter, and ``re`` sees their words as ``regex`` does.
_BEYOND_LATIN = re.compile("[^\u0000-\u024f]")
_LATIN_WORDS, _ASCII_WORDS = re.compile(r"[^\W_]+"), re.compile("[0-9A-Za-z]+")


def normalize_text(text: str, settings: IndexSettings = IndexSettings()) -> str:
    if text.isascii():
        return text.lower()
    plain = unicodedata.normalize("NFKC", text).lower()
    if not _BEYOND_LATIN.search(plain):
        return plain
    return normalize_arabic_text(unicodedata.normalize("NFKC", text).lower(), settings.arabic)


def split_words(text: str) -> list[str]:
    if text.isascii():
        return _ASCII_WORDS.findall(text)
    if not _BEYOND_LATIN.search(text):
        return _LATIN_WORDS.findall(text)
    import regex

    return regex.findall(r"[\p{L}\p{N}]+", text)


def stem_english(word: str) -> str:
    if len(word) < 4:
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("ss"):
        return word
    else:
        word = word.removesuffix("s")
    for ending, longer, cut in (("eed", 5, 1), ("ing", 6, 3), ("ed", 5, 2)):
        if word.endswith(ending) and len(word) > longer:
            word = word[:-cut]
            break
    word = next((word[: -len(s)] + r for s, r in RULES if word.endswith(s) and len(word) >= len(s) + LEAST_STEM), word)
    return word[:-1] if word.endswith("e") and len(word) > 4 else word


def stem_arabic(word: str) -> str:
    word = next((word[len(p) :] for p in PREFIXES if word.startswith(p) and len(word) >= len(p) + LEAST_STEM), word)
    return next((word[: -len(s)] for s in SUFFIXES if word.endswith(s) and len(word) >= len(s) + LEAST_STEM), word)


def term_of(word: str, settings: IndexSettings = IndexSettings()) -> str:
    """A word's term; the empty string for a stop word."""
    arabic = re.search(f"[{ARABIC}]", word) is not None
    if word in settings.stop_words.get("ar" if arabic else "en", ()):
        return ""
    return (stem_arabic(word) if settings.arabic.light_stem else word) if arabic else stem_english(word)


def analyze_text(text: str, settings: IndexSettings = IndexSettings()) -> list[tuple[str, int, str]]:
    """(term, position, word) of a string's tokens."""
    terms = [(term_of(word, settings), at, word) for at, word in enumerate(split_words(normalize_text(text, settings)))]
    return [t for t in terms if t[0]]


def analyze_offsets(text: str, settings: IndexSettings = IndexSettings()) -> list[tuple[int, int, int, str]]:
    """(start, end, position, term) of a raw string's surfaces; offsets count UTF-16 units."""
    import regex

    wide = lambda at: at + sum(ord(c) > 0xFFFF for c in text[:at])
    if all(ord(c) <= 0xFFFF for c in text):
        wide = lambda at: at
    out = []
    for at, m in enumerate(regex.finditer(rf"[\p{{L}}\p{{N}}{DIACRITICS}{TATWEEL}]+", text)):
        out += [(wide(m.start()), wide(m.end()), at, term) for term, _, _ in analyze_text(m.group(), settings)]
    return out
