"""Search over a small bilingual corpus with known answers."""

import math

import pytest

from tessera.operators import search as S
from tessera.operators.filters import condition, with_body
from tessera.operators.index import build, checksum, persisted, typo_dictionary
from tessera.settings import IndexSettings, SearchRequest

SETTINGS = IndexSettings(boosts={"title": 4.0, "content": 1.0})
DOCS = [
    ("r1", "Growing tomato seedlings", "Warm soil helps tomato seedlings root quickly.", "2021-03-05T08:00:00Z", "garden"),
    ("r2", "Pruning apple trees", "Winter pruning keeps an orchard productive.", "2019-11-20T08:00:00Z", "orchard"),
    ("r3", "Composting basics", "Kitchen scraps become dark soil within months.", "2020-06-01T08:00:00Z", "garden"),
    ("r4", "زِرَاعَة الأشجار", "تحتاج الأشجار المثمرة إلى الماء والشمس.", "2022-01-15T08:00:00Z", "garden"),
]


@pytest.fixture(scope="module")
def index(spark):
    df = spark.createDataFrame([(i, t, c, p, (k,)) for i, t, c, p, k in DOCS], "doc_id string, title string, content string, publishedAt string, metadata struct<category:string>")
    return persisted(build(df, SETTINGS))


def hits(spark, index, query, typo=True):
    terms, phrases = S.parsed_queries(spark, {"q": query}, SETTINGS)
    grown = S.expand(terms, index.vocabulary, SETTINGS, typo=typo)
    return [r.doc_id for r in S.top(S.score(index, grown, phrases if phrases.count() else None), 10).orderBy("rank").collect()]


def test_ranking(spark, index):
    found = hits(spark, index, "tomato soil")
    assert found[0] == "r1" and set(found) == {"r1", "r3"}


def test_phrase(spark, index):
    assert hits(spark, index, '"apple trees"') == ["r2"]
    assert hits(spark, index, 'soil "tomato seedlings"') == ["r1"]


def test_phrases_keep_postings_whole(spark):
    """Phrases of one, two and three terms, a term twice, and fields apart; positions aren't unfolded into rows."""
    texts = ["a b a b c", "b a", "c b a a", "a x b", "b c", None]
    rows = [(i, t, "b c" if i == 3 else None) for i, t in enumerate(texts)]
    index = build(spark.createDataFrame(rows, "doc_id long, content string, title string"), SETTINGS)
    words = {"one": "c", "two": "a b", "three": "a b c", "twice": "a a", "again": "a b a b", "fields": "b c"}
    phrases = S.parsed_queries(spark, {name: f'"{text}"' for name, text in words.items()}, SETTINGS)[1]
    found = S.phrase_hits(index, phrases)
    want = {(name, i) for name, text in words.items() for i, t, title in rows for own in (t, title) if own and f" {text} " in f" {own} "}
    assert sorted((r.query_id, r.doc_id) for r in found.collect()) == sorted(want)
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("query,expected", [("tomatto", "r1"), ("seedlngs", "r1"), ("orchrad", "r2")])
def test_typos(spark, index, query, expected):
    assert hits(spark, index, query) == [expected]
    assert hits(spark, index, query, typo=False) == []


def test_typos_with_and_without_the_stored_dictionary(spark, index):
    terms = S.parsed_queries(spark, {"q": "tomatto orchrad wintre"}, SETTINGS)[0]
    stored = {(r.term, r.expansion, r.distance) for r in S.typo_candidates(terms, index.vocabulary, SETTINGS, variants=index.variants).collect()}
    assert stored == {(r.term, r.expansion, r.distance) for r in S.typo_candidates(terms, index.vocabulary, SETTINGS).collect()}
    assert ("orchrad", "orchard", 1) in stored


def test_the_stored_dictionary_alone_is_read(spark, index):
    terms = S.parsed_queries(spark, {"q": "orchrad"}, SETTINGS)[0]
    other = typo_dictionary(spark.createDataFrame([("orchads", 3)], "term string, df long"))
    assert [r.expansion for r in S.typo_candidates(terms, index.vocabulary, SETTINGS, variants=other).collect()] == ["orchads"]


def test_arabic(spark, index):
    assert hits(spark, index, "أَشجار") == ["r4"]


def test_bm25_value(spark, index):
    terms = spark.createDataFrame([("q", "soil")], "query_id string, term string")
    parts = {(r.doc_id, r.field): r.value for r in S.components(index, terms).collect()}
    # Two of four contents have the word; they have 7, 6, 7 and 6 words.
    assert parts.keys() == {("r1", "content"), ("r3", "content")}
    assert parts[("r3", "content")] == pytest.approx(math.log(1 + 2.5 / 2.5) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 7 / 6.5)), rel=1e-9)


def test_score_is_the_sum_of_its_components(spark, index):
    terms, phrases = S.parsed_queries(spark, {"q": 'soil "tomato seedlings"'}, SETTINGS)
    parts = S.explain(index, terms, "r1", phrases).collect()
    assert {r.component: r.value for r in parts}["phrase:tomato seedl"] == 2
    score = S.score(index, terms, phrases).filter("doc_id = 'r1'").first().score
    assert sum(r.value for r in parts) == pytest.approx(score)
    assert S.explain(index, terms, "r3", phrases).count() == 0


def filtered(index, spec):
    return {r.doc_id for r in index.docs.filter(condition(index.docs, spec)).collect()}


def test_filters(index):
    spec = {"or": [{"metadata.category": "orchard"}, {"and": [{"metadata.category": "garden"}, {"publishedAt": {"op": "gt", "value": "2021-01-01"}}]}]}
    assert filtered(index, spec) == {"r1", "r2", "r4"}
    assert filtered(index, {"publishedAt": {"min": "2020-01-01", "max": "2020-12-31"}}) == {"r3"}
    everything = {i for i, *_ in DOCS}
    assert filtered(index, {"nothing": {"op": "neq", "value": 1}}) == everything
    assert filtered(index, {"nothing": {"op": "gt", "value": 1}}) == set()
    assert filtered(index, {"nothing": {}}) == everything
    assert filtered(index, {"doc_id": {"op": "like", "value": "r1"}}) == set()
    with pytest.raises(ValueError):
        condition(index.docs, {"and": []})


BODIES = ['{"a": {"b": 5}, "t": ["x", 1, true, null], "d": "2024-02-01"}', '{"a": {"b": "5"}, "t": [], "d": 7}', '{"a": [{"b": 5}], "n": null, "t": "x"}', '{"a": {"b": 5.0, "c.d": 1}, "flag": true}', "no json", None]


@pytest.mark.parametrize(
    "spec,expected",
    [
        ({"body.a.b": 5}, {0, 3}), ({"body.a.b": "5"}, {1}), ({"body.a.b": {"op": "neq", "value": 5}}, {1, 2, 4, 5}), ({"body.t": "x"}, {0, 2}), ({"body.t": 1}, {0}), ({"body.t": True}, {0}), ({"body.t": None}, {0}), ({"body.n": None}, {2}),
        ({"body.missing": None}, set()), ({"body.a.b": {"op": "in", "value": ["5", 5]}}, {0, 1, 3}), ({"body.a.b": {"op": "gte", "value": 5}}, {0, 3}), ({"body.a.b": {"min": 6}}, set()), ({"body.a.b": {}}, {0, 1, 2, 3, 4, 5}),
        ({"body.d": {"op": "lt", "value": "2024-03-01"}}, {0}), ({"body.d": {"op": "lt", "value": 8}}, {1}), ({"body.flag": True}, {3}), ({"body.flag": 1}, set()), ({"or": [{"body.flag": True}, {"and": [{"body.t": 1}, {"body.a.b": 5}]}]}, {0, 3}), ({"body.a": 5}, set()),
    ],
)
def test_filters_over_json_bodies(spark, spec, expected):
    df = with_body(spark.createDataFrame(list(enumerate(BODIES)), "i long, body string"), "body")
    assert {r.i for r in df.filter(condition(df, spec)).select("i").collect()} == expected


def test_filter_before_scoring_keeps_statistics(spark, index):
    terms = spark.createDataFrame([("q", "soil")], "query_id string, term string")
    whole = {r.doc_id: r.score for r in S.score(index, terms).collect()}
    one = S.score(index, terms, among=index.docs.filter("doc_id = 'r3'")).collect()
    assert [r.doc_id for r in one] == ["r3"] and one[0].score == pytest.approx(whole["r3"])


def test_text_of_fields_by_type(spark):
    docs = spark.createDataFrame([(1, ["red soil", None, "clay"], 2024, None), (2, [], 7, "sand")], "doc_id int, tags array<string>, content int, url string")
    posts = {(r.doc_id, r.field, r.term, tuple(r.positions), r.len) for r in build(docs, SETTINGS).postings.collect()}
    assert posts == {(1, "tags", "red", (0,), 3), (1, "tags", "soil", (1,), 3), (1, "tags", "clay", (2,), 3), (2, "url", "sand", (0,), 1)}


def test_compatibility_forms_are_found(spark):
    docs = spark.createDataFrame([(1, "ｇａｒｄｅｎ of ﬁgs"), (2, "other words")], "doc_id int, content string")
    index = build(docs, IndexSettings(boosts={"content": 1.0}))
    assert hits(spark, index, "garden", typo=False) == hits(spark, index, "ﬁg", typo=False) == hits(spark, index, "figs", typo=False) == [1]


def test_average_length_counts_all_documents(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (2, None)], "doc_id int, content string")
    assert build(docs, IndexSettings(boosts={"content": 1.0})).averages.first().avg_len == 2.0


def test_duplicate_ids_are_refused(spark):
    with pytest.raises(ValueError):
        build(spark.createDataFrame([(1, "x"), (1, "y")], "doc_id int, content string"), IndexSettings(boosts={"content": 1.0}))


def test_synonyms(spark):
    groups = [(["plum", "prune"], False), (["spade", "shovel"], True), (["fork lift", "jack"], False), (["alone"], False)]
    pairs = {(r.term, r.expansion) for r in S.synonym_pairs(spark, groups).collect()}
    assert pairs == {("plum", "prun"), ("prun", "plum"), ("spad", "shovel"), *((a, b) for a in ("fork", "lift", "jack") for b in ("fork", "lift", "jack") if a != b)}


def test_parse():
    p = S.parse('one "two three" four "open')
    assert p.phrases == [["two", "thre"]] and p.terms == ["one", "four", "open"]
    assert S.parse("!!").terms == []


def test_autocomplete(spark, index):
    assert [r.value for r in S.autocomplete(index, "fresh orch").collect()] == ["orchard"]
    assert S.autocomplete(index, "  ").count() == 0


def test_typo_dictionary(spark):
    vocabulary = spark.createDataFrame([("lantern",), ("copper",), ("ridge",)], "term string")
    rows = {(r.variant, r.term) for r in typo_dictionary(vocabulary).collect()}
    assert {("lanern", "lantern"), ("coper", "copper"), ("rdg", "ridge"), ("ridge", "ridge")} <= rows


def test_checksum_ignores_order(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "a int, b string")
    assert checksum(a) == checksum(a.orderBy("b", ascending=False)) != checksum(a.limit(1))


def test_request_limits():
    with pytest.raises(ValueError):
        SearchRequest(limit=0)
    with pytest.raises(ValueError):
        SearchRequest(query="x" * 1001)


def test_enabled_synonyms(spark):
    rows = [(1, True, False, ["car", "Autos", "vehicle"]), (2, True, True, ["car", "sedan"]), (3, True, False, ["car", "cab"]), (4, False, False, ["car", "lorry"]), (5, True, True, ["bike", "bicycle", "two wheeler"]), (6, True, False, ["alone"]), (7, True, True, ["bike", "cycle"]), (8, True, False, None)]
    sets = spark.createDataFrame(rows, "set_id long, enabled boolean, one_way boolean, terms array<string>")
    want = S.synonym_pairs(spark, [(t or [], w) for _, on, w, t in rows if on], SETTINGS)
    pairs = lambda df: sorted(map(tuple, df.collect()))
    assert pairs(S.enabled_synonyms(sets, SETTINGS)) == pairs(want.select("term", "expansion"))
    assert ("car", "lorry") not in pairs(want)


def test_words_and_postings_of_odd_texts(spark):
    import regex

    from tessera.functions.text import normalize_text, split_words, term_of
    from tessera.operators.index import field_lengths, postings, text_counts

    # The short ways of Latin texts find what the general one finds.
    odd = [chr(c) for c in range(0x260)] + ["İstanbul x²y ½", "áb ﬁne", "قال الكتاب", "Straße_12 ÀÉ"]
    for text in odd:
        both = f"ab{text}cd"
        assert split_words(normalize_text(both)) == regex.findall(r"[\p{L}\p{N}]+", normalize_text(both)), repr(text)
    docs = spark.createDataFrame([(1, "b a b", "x"), (2, None, ""), (3, "été, b! B", "..."), (1, "b", "x")], "doc_id long, content string, title string")
    got = {(r.term, r.tf, tuple(r.positions), r.len) for r in postings(docs.filter("doc_id = 3"), ["content"]).collect()}
    assert got == {(term_of("été"), 1, (0,), 3), ("b", 2, (1, 2), 3)}
    assert {(r.doc_id, r.term, r.tf) for r in text_counts(docs, ["content"]).collect()} == {(1, "a", 1), (1, "b", 3), (3, term_of("été"), 1), (3, "b", 2)}
    assert {(r.doc_id, r.field, r.len) for r in field_lengths(docs, ["content", "title"]).collect()} == {(1, "content", 4), (1, "title", 2), (3, "content", 3)}


def test_lookups_of_a_version_come_later(spark, tmp_path):
    from tessera.sources import segments

    docs = spark.createDataFrame([(i, f"word{i} common apple") for i in range(30)], "doc_id long, content string")
    root = str(tmp_path)
    segments.write_version(build(docs, SETTINGS, ["content"]), root, "i", "v1", lookups=())
    bare = segments.read_version(spark, root, "i", "v1")
    assert bare.variants is None and bare.prefixes is None and bare.postings.count() == 90
    for _ in range(2):
        for name in segments.LOOKUPS:
            segments.write_lookup(spark, root, "i", "v1", name)
    full = segments.read_version(spark, root, "i", "v1")
    segments.write_version(build(docs, SETTINGS, ["content"]), root, "i", "v2")
    other = segments.read_version(spark, root, "i", "v2")
    for name in segments.LOOKUPS:
        assert checksum(getattr(full, name)) == checksum(getattr(other, name))
