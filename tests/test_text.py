"""Analysis and distances: golden values, and properties."""

import hmac

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.hashing import hmac_sha256
from tessera.functions.distance import deletion_variants, deletion_variants_of, osa_distance
from tessera.settings import Arabic, IndexSettings

STEMS = {
    "distributed": "distribut", "system": "system", "systems": "system", "engine": "engin", "databases": "databas", "relational": "relat",
    "queries": "queri", "class": "class", "classes": "class", "running": "runn", "string": "string", "agreed": "agre", "need": "need",
    "optimization": "optimiz", "indexes": "index", "this": "thi", "bus": "bus", "creation": "creat", "nation": "nation", "operator": "operat",
}
ARABIC = {"المعلمون": "معلم", "كتابها": "كتاب", "والقلم": "قلم", "سيارات": "سيار"}


def test_english_stems(spark):
    assert {w: T.stem_english(w) for w in STEMS} == STEMS
    rows = T.with_stems(spark.createDataFrame([(w,) for w in STEMS], "raw string")).collect()
    assert {r.raw: r.term for r in rows} == STEMS


def test_arabic_stems(spark):
    assert {w: T.stem_arabic(w) for w in ARABIC} == ARABIC
    rows = T.with_stems(spark.createDataFrame([(w,) for w in ARABIC], "raw string")).collect()
    assert {r.raw: r.term for r in rows} == ARABIC


def test_arabic_normalisation(spark):
    assert T.normalize_arabic_text("مُستشفى الأُمّ") == "مستشفي الام"
    assert T.normalize_arabic_text("حديقة") == "حديقة"
    assert T.normalize_arabic_text("حديقة", Arabic(taa_marbuta=True)) == "حديقه"
    df = spark.createDataFrame([("مُستشفى الأُمّ",)], "t string")
    assert df.select(T.normalized(F.col("t"))).first()[0] == "مستشفي الام"


def test_stemmers_agree(spark):
    import random

    rng = random.Random(3)
    ends = [s for s, _ in T.RULES] + ["s", "sses", "ies", "ss", "eed", "ing", "ed", "e", ""]
    words = sorted({"".join(rng.choice("abeilnst") for _ in range(rng.randint(1, 6))) + rng.choice(ends) for _ in range(3000)})
    words += ["".join(rng.choice("والبكفتينهمةيا") for _ in range(rng.randint(1, 8))) for _ in range(2000)]
    rows = T.with_stems(spark.createDataFrame([(w,) for w in dict.fromkeys(words)], "raw string")).collect()
    arabic = lambda w: any("؀" <= c <= "ۿ" for c in w)
    assert [(r.raw, r.term) for r in rows if r.term != (T.stem_arabic(r.raw) if arabic(r.raw) else T.stem_english(r.raw))] == []


def test_mixed_tokens_and_gaps(spark):
    terms = [t for t, _, _ in T.analyze_text("Garden الحدائق Tools")]
    assert terms == ["garden", "حدائق", "tool"]
    settings = IndexSettings(stop_words={"en": ("of",)})
    assert [(t, p) for t, p, _ in T.analyze_text("state of art", settings)] == [("state"[:-1], 0), ("art", 2)]
    df = T.analyzed(spark.createDataFrame([(1, "state of art")], "doc_id int, text string"), "text", settings)
    assert [(r.term, r.pos) for r in df.orderBy("pos").collect()] == [("stat", 0), ("art", 2)]


def test_empty_and_null_texts(spark):
    df = T.analyzed(spark.createDataFrame([(1, None), (2, ""), (3, " .,! ")], "doc_id int, text string"), "text")
    assert df.count() == 0


def test_offsets_count_utf16_units():
    assert T.analyze_offsets("🙂 engines")[0][:2] == (3, 10)
    assert T.analyze_offsets("حَدِيقَة")[0][:2] == (0, 8)


def test_distances():
    assert osa_distance("gadren", "garden", 2) == 1
    assert osa_distance("ca", "abc", 3) == 3
    assert osa_distance("abc", "xyz", 2) == 3


words = st.text("abcd", min_size=1, max_size=7)


@given(words, words)
@settings(max_examples=300, deadline=None)
def test_close_words_share_a_variant(a, b):
    d = osa_distance(a, b, 2)
    assert d == osa_distance(b, a, 2)
    if d <= 2 and len(a) > 2 and len(b) > 2:
        assert deletion_variants_of(a, 2) & deletion_variants_of(b, 2)


def test_deletion_variants(spark):
    row = spark.createDataFrame([("garden",), ("ab",), ("a",)], "t string").select("t", deletion_variants(F.col("t"), 2).alias("v")).collect()
    for r in row:
        assert len(r.v) == len(set(r.v))
        assert set(r.v) == deletion_variants_of(r.t, 2)
    assert {"garden", "garde", "grdn"} <= set(row[0].v)


def test_escaped_like_and_snippet(spark):
    assert T.escaped_like(r"50%_a\b") == r"50\%\_a\\b"
    long = spark.createDataFrame([("x" * 400,), ("y" * 320,)], "t string").select(T.snippet(F.col("t")).alias("s")).collect()
    assert len(long[0].s) == 318 and long[0].s.endswith("…") and long[1].s == "y" * 320


def test_keyed_digests(spark):
    rng = np.random.default_rng(4)
    keys = [rng.bytes(n) for n in (0, 1, 20, 63, 64, 65, 131, 200)]
    texts = ["", "a", "What is meant here?", "é中🙂" * 50]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for key in keys:
        assert [r.d for r in df.select(hmac_sha256(F.col("t"), key).alias("d")).collect()] == [hmac.new(key, t.encode(), "sha256").hexdigest() for t in texts]
