"""Queries for text analysis, the index, and search."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.distance import deletion_variants
from ..functions.text import analyze_offsets, snippet, with_stems, words
from ..operators import explorer as X
from ..operators import search as S
from ..operators.filters import condition, with_body
from ..operators.index import build, field_lengths, field_tokens, spread, text_counts
from .common import INDEX_SQL, SETTINGS, TOKENS_SQL, Registry, active_index, search_docs, stem_sql, table

register = Registry()

PLAIN = "that tion ofthe inhe"
BATCH = {"q1": "the reting", "q2": "andhe erin that", "q3": "nation", "q4": "der und"}
PHRASE = 'in "of the" tion'
GROUPS = [(["tion", "ering"], False), (["inhe", "andhe"], True)]


def _terms(spark: SparkSession, queries: dict[str, str]) -> DataFrame:
    return S.parsed_queries(spark, queries, SETTINGS)[0]


def _values(pairs: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in p) + ")" for p in pairs)


def _terms_sql(queries: dict[str, str]) -> str:
    return f"q(query_id, term) AS (VALUES {_values([(k, t) for k, v in queries.items() for t in S.parse(v, SETTINGS).terms])})"


def _with(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "


@register(_with(TOKENS_SQL) + "SELECT doc_id, pos, raw FROM tok WHERE field = 'content'")
def tokenize_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_docs(spark, sf_dir).select("doc_id", F.posexplode(words(F.lower("content"))).alias("pos", "raw")).select("doc_id", F.col("pos").cast("long").alias("pos"), "raw")


@register(_with(TOKENS_SQL) + "SELECT DISTINCT raw, term FROM tok WHERE field = 'content'")
def stem_english_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = search_docs(spark, sf_dir).select(F.explode(words(F.lower("content"))).alias("raw")).distinct()
    return with_stems(raw).select("raw", "term")


@register(_with(INDEX_SQL) + "SELECT doc_id, term, tf FROM post WHERE field = 'content'")
def term_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_counts(spread(search_docs(spark, sf_dir)), ["content"]).select("doc_id", "term", "tf")


@register(_with(INDEX_SQL) + "SELECT doc_id, field, CAST(len AS BIGINT) AS len FROM lens")
def doc_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return field_lengths(spread(search_docs(spark, sf_dir)), ["title", "content"])


@register(_with(INDEX_SQL) + "SELECT field, round(avg_len, 6) AS avg_len FROM avgs")
def avg_field_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return active_index(spark, sf_dir).averages.select("field", F.round("avg_len", 6).alias("avg_len"))


@register(_with(INDEX_SQL) + "SELECT field, term, df FROM dict")
def dictionary_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return active_index(spark, sf_dir).dictionary.select("field", "term", "df")


@register(_with(INDEX_SQL) + "SELECT term, CAST(sum(df) AS BIGINT) AS df FROM dict GROUP BY term")
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return active_index(spark, sf_dir).vocabulary


def _ranked(spark: SparkSession, sf_dir: str, queries: dict[str, str], k: int, among: DataFrame | None = None) -> DataFrame:
    index = active_index(spark, sf_dir)
    hits = S.top(S.score(index, _terms(spark, queries), among=among), k)
    return hits.select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", F.round("score", 6).alias("score"))


def _ranked_sql(queries: dict[str, str], k: int, where: str = "") -> str:
    return (
        _with(INDEX_SQL, _terms_sql(queries))
        + f"""SELECT query_id, rank, doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank
FROM (SELECT query_id, doc_id, sum(value) AS score FROM parts JOIN q USING (term) {where} GROUP BY query_id, doc_id) s WHERE score > 0) r WHERE rank <= {k}"""
    )


@register(_ranked_sql({"q": PLAIN}, 20))
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir, {"q": PLAIN}, 20)


@register(_with(INDEX_SQL, _terms_sql({"q": PLAIN})) + "SELECT doc_id, round(sum(CASE WHEN field = 'title' THEN value ELSE 0 END), 6) AS title_score, round(sum(value), 6) AS score FROM parts JOIN q USING (term) GROUP BY doc_id")
def bm25_multifield_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = S.components(active_index(spark, sf_dir), _terms(spark, {"q": PLAIN}))
    return parts.groupBy("doc_id").agg(F.round(F.sum(F.when(F.col("field") == "title", F.col("value")).otherwise(0.0)), 6).alias("title_score"), F.round(F.sum("value"), 6).alias("score"))


@register(_with(INDEX_SQL, _terms_sql({"q": PLAIN})) + "SELECT doc_id, concat('bm25:', field, ':', term) AS component, round(value, 6) AS value FROM parts JOIN q USING (term)")
def bm25_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = S.components(active_index(spark, sf_dir), _terms(spark, {"q": PLAIN}))
    return parts.select("doc_id", F.concat_ws(":", F.lit("bm25"), "field", "term").alias("component"), F.round("value", 6).alias("value"))


@register(_ranked_sql(BATCH, 10))
def bm25_batch_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir, BATCH, 10)


@register(_ranked_sql({"q": PLAIN}, 20, "WHERE doc_id IN (SELECT doc_id FROM docs WHERE language = 'en' AND n_chars >= 500)"))
def bm25_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = active_index(spark, sf_dir).docs
    return _ranked(spark, sf_dir, {"q": PLAIN}, 20, docs.filter(condition(docs, {"language": "en", "n_chars": {"op": "gte", "value": 500}})))


_PREFIX = {"p": "reti onth", "r": "ande"}
_VOCAB = "vocab AS (SELECT term AS expansion, sum(df) AS df FROM dict GROUP BY term)"
_PREFIX_CTE = "near AS (SELECT query_id, term, expansion, row_number() OVER (PARTITION BY query_id, term ORDER BY expansion) AS n FROM q JOIN vocab ON starts_with(expansion, term))"


@register(_with(INDEX_SQL, _VOCAB, _terms_sql(_PREFIX), _PREFIX_CTE) + "SELECT query_id, term, expansion FROM near WHERE n <= 32")
def prefix_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.prefix_candidates(_terms(spark, _PREFIX), active_index(spark, sf_dir).vocabulary)



def _synonyms(spark: SparkSession) -> DataFrame:
    return S.synonym_pairs(spark, GROUPS, SETTINGS)


def _synonym_sql() -> str:
    from ..functions.text import analyze_text

    found: dict[str, list[str]] = {}
    for names, one_way in GROUPS:
        tokens = [t for n in names for t, _, _ in analyze_text(n, SETTINGS)]
        found.update({tokens[0]: tokens[1:]} if one_way else {t: [o for o in tokens if o != t] for t in tokens})
    return f"syn(term, expansion) AS (VALUES {_values([(t, e) for t, es in found.items() for e in es])})"


@register(_with(_terms_sql({"q": PLAIN}), _synonym_sql()) + "SELECT query_id, term FROM q UNION SELECT query_id, expansion FROM q JOIN syn USING (term)")
def synonym_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = _terms(spark, {"q": PLAIN})
    return terms.unionByName(terms.join(_synonyms(spark), "term").select("query_id", F.col("expansion").alias("term"))).distinct()


@register(
    _with(INDEX_SQL, _VOCAB, f"q0{_terms_sql({'q': 'reti inhe'})[1:]}", _synonym_sql(), "near AS (SELECT query_id, expansion, row_number() OVER (PARTITION BY query_id, term ORDER BY expansion) AS n FROM q0 JOIN vocab ON starts_with(expansion, term))")
    + """, q AS (SELECT query_id, term FROM q0 UNION SELECT query_id, expansion FROM q0 JOIN syn USING (term) UNION SELECT query_id, expansion FROM near WHERE n <= 32)
SELECT rank, doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rank FROM (SELECT doc_id, sum(value) AS score FROM parts JOIN q USING (term) GROUP BY doc_id) s) r WHERE rank <= 20"""
)
def expanded_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = active_index(spark, sf_dir, "prefixes")
    terms = S.expand_in(index, _terms(spark, {"q": "reti inhe"}), _synonyms(spark), typo=False)
    return S.top(S.score(index, terms), 20).select(F.col("rank").cast("long").alias("rank"), "doc_id", F.round("score", 6).alias("score"))


_PHRASE_CTE = "hit AS (SELECT DISTINCT a.doc_id FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND a.field = b.field AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term = 'the')"


@register(_with(TOKENS_SQL, _PHRASE_CTE) + "SELECT doc_id, 2.0::DOUBLE AS score FROM hit")
def phrase_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms, phrases = S.parsed_queries(spark, {"q": '"of the"'}, SETTINGS)
    return S.score(active_index(spark, sf_dir), terms, phrases).select("doc_id", "score")


@register(
    _with(INDEX_SQL, _PHRASE_CTE, _terms_sql({"q": PHRASE}))
    + """, base AS (SELECT doc_id, sum(value) AS score FROM parts JOIN q USING (term) GROUP BY doc_id)
SELECT h.doc_id, round(coalesce(score, 0) + 2, 6) AS score FROM hit h LEFT JOIN base USING (doc_id)"""
)
def phrase_and_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms, phrases = S.parsed_queries(spark, {"q": PHRASE}, SETTINGS)
    return S.score(active_index(spark, sf_dir), terms, phrases).select("doc_id", F.round("score", 6).alias("score"))


_PART_WORDS = "pw AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS term FROM part)"
_DELETE = "SELECT term, substr(v, 1, i - 1) || substr(v, i + 1) AS v FROM (SELECT term, v, unnest(range(1, length(v) + 1)) AS i FROM {0} WHERE length(v) > 1) x"


@register(_with(_PART_WORDS, "v0 AS (SELECT term, term AS v FROM pw)", f"v1 AS ({_DELETE.format('v0')})", f"v2 AS ({_DELETE.format('v1')})") + "SELECT DISTINCT term, v AS variant FROM (SELECT * FROM v0 UNION ALL SELECT * FROM v1 UNION ALL SELECT * FROM v2) a")
def deletion_variants_of_part_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("term")).distinct()
    return terms.select("term", F.explode(deletion_variants(F.col("term"), 2)).alias("variant"))


_TYPOS = {"t": "ertion anthat", "u": "hten"}
_TYPO_CTE = """typos AS (SELECT query_id, term, expansion, distance, row_number() OVER (PARTITION BY query_id, term ORDER BY distance, df DESC, expansion) AS n
FROM (SELECT *, damerau_levenshtein(term, expansion) AS distance FROM q JOIN vocab ON abs(length(term) - length(expansion)) <= 2 WHERE length(term) >= 4) x WHERE distance <= 2)"""


@register(_with(INDEX_SQL, _VOCAB, _terms_sql(_TYPOS), _TYPO_CTE) + "SELECT query_id, term, expansion, CAST(distance AS INTEGER) AS distance FROM typos WHERE n <= 12")
def typo_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = active_index(spark, sf_dir, "variants")
    return S.stored_typo_candidates(index, _terms(spark, _TYPOS)).withColumn("distance", F.col("distance").cast("int"))


@register(
    _with(INDEX_SQL, _VOCAB, _terms_sql({"t": "ertionn"}), _TYPO_CTE, _PREFIX_CTE)
    + """, grown AS (SELECT query_id, term FROM q UNION SELECT query_id, expansion FROM near WHERE n <= 32 UNION SELECT query_id, expansion FROM typos WHERE n <= 12)
SELECT rank, doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rank FROM (SELECT doc_id, sum(value) AS score FROM parts JOIN grown USING (term) GROUP BY doc_id) s) r WHERE rank <= 20"""
)
def typo_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = active_index(spark, sf_dir, "prefixes", "variants")
    terms = S.expand_in(index, _terms(spark, {"t": "ertionn"}))
    return S.top(S.score(index, terms), 20).select(F.col("rank").cast("long").alias("rank"), "doc_id", F.round("score", 6).alias("score"))


_MATCH = _with(INDEX_SQL, _terms_sql({"q": PLAIN}), "ranked AS (SELECT doc_id, sum(value) AS score FROM parts JOIN q USING (term) GROUP BY doc_id)")


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.score(active_index(spark, sf_dir), _terms(spark, {"q": PLAIN}))


@register(_MATCH + "SELECT 'language' AS facet, language AS value, count(*) AS n FROM docs JOIN ranked USING (doc_id) GROUP BY language UNION ALL SELECT 'source', source, count(*) FROM docs JOIN ranked USING (doc_id) GROUP BY source")
def facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.facets(_matched(spark, sf_dir), active_index(spark, sf_dir).docs, ["language", "source"])


@register(_MATCH + "SELECT 'tags' AS facet, value, count(*) AS n FROM (SELECT unnest([source, language]) AS value FROM docs JOIN ranked USING (doc_id)) t WHERE value IS NOT NULL GROUP BY value")
def facet_array_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.facets(_matched(spark, sf_dir), active_index(spark, sf_dir).docs, ["tags"])


@register(_MATCH + "SELECT count(*) AS total FROM ranked")
def total_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir).agg(F.count("*").alias("total"))


@register(_MATCH + "SELECT doc_id, n_chars, round(score, 6) AS score FROM docs JOIN ranked USING (doc_id) ORDER BY n_chars DESC, round(score, 9) DESC, doc_id LIMIT 20")
def sort_by_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = active_index(spark, sf_dir).docs.select("doc_id", "n_chars")
    return docs.join(_matched(spark, sf_dir), "doc_id").orderBy(F.desc("n_chars"), F.desc(F.round("score", 9)), "doc_id").limit(20).select("doc_id", "n_chars", F.round("score", 6).alias("score"))


@register(_MATCH + "SELECT doc_id, round(score, 6) AS score FROM ranked ORDER BY round(score, 9) DESC, doc_id LIMIT 10 OFFSET 10")
def page_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir).orderBy(F.desc(F.round("score", 9)), "doc_id").offset(10).limit(10).select("doc_id", F.round("score", 6).alias("score"))


@register("SELECT doc_id, source FROM documents WHERE doc_id > 100 ORDER BY doc_id LIMIT 26")
def keyset_asc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter("doc_id > 100").orderBy("doc_id").limit(26).select("doc_id", "source")


@register("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate < TIMESTAMP '1997-06-01' OR (o_orderdate = TIMESTAMP '1997-06-01' AND o_orderkey < 900) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 26")
def keyset_desc_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.lit("1997-06-01").cast("timestamp")
    older = (F.col("o_orderdate") < at) | ((F.col("o_orderdate") == at) & (F.col("o_orderkey") < 900))
    return table(spark, sf_dir, "orders").filter(older).orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(26).select("o_orderkey", "o_orderdate")


def _filtered(spec: dict, name: str, *columns: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, name)
        return df.filter(condition(df, spec)).select(*columns)

    return run


register("SELECT p_partkey, p_brand, p_size FROM part WHERE p_type = 'ECONOMY' AND p_size IN (1, 5, 11, 28)", "filter_eq_in")(_filtered({"p_type": "ECONOMY", "p_size": {"op": "in", "value": [1, 5, 11, 28]}}, "part", "p_partkey", "p_brand", "p_size"))
register("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate <= TIMESTAMP '1996-06-01'", "filter_range_date")(_filtered({"o_orderdate": {"min": "1996-01-01", "max": "1996-06-01"}}, "orders", "o_orderkey"))
register("SELECT p_partkey FROM part WHERE (p_size > 40 OR p_brand = 'Brand#2') AND (p_type = 'ECONOMY' OR (p_retailprice < 1000 AND NOT p_brand = 'Brand#17'))", "filter_nested_bool")(
    _filtered({"and": [{"or": [{"p_size": {"op": "gt", "value": 40}}, {"p_brand": "Brand#2"}]}, {"or": [{"p_type": "ECONOMY"}, {"and": [{"p_retailprice": {"op": "lt", "value": 1000}}, {"p_brand": {"op": "neq", "value": "Brand#17"}}]}]}]}, "part", "p_partkey")
)
register("SELECT p_partkey FROM part", "filter_neq_missing")(_filtered({"absent.field": {"op": "neq", "value": 1}, "other": {}}, "part", "p_partkey"))

#: Filters over JSON bodies with nested objects, arrays, missing fields and mixed kinds.
_BODY_FILTERS = {
    "eq": {"props.device.os": "ios"},
    "strict": {"props.k": "5"},
    "listed": {"props.k": {"op": "in", "value": [5, 30.0, "7", None]}},
    "member": {"props.tags": "b"},
    "neq": {"props.device.ver": {"op": "neq", "value": "2.0"}},
    "ranged": {"props.k": {"min": 10, "max": 40}},
    "dated": {"props.device.ver": {"op": "gte", "value": "2001-05-01"}},
    "through_array": {"props.items.sku": 3},
    "tree": {"or": [{"props.device.os": "tv"}, {"and": [{"props.tags": "c"}, {"props.k": {"op": "gt", "value": 50}}]}]},
    "open": {"props.nothing": {}},
}


@register(
    """WITH b AS (SELECT click_id, CASE WHEN json_valid(props) THEN props END AS props FROM clicks),
x AS (SELECT click_id, json_extract_string(props, '$.device.os') AS os, CASE WHEN json_type(props, '$.k') IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS k, coalesce(json_type(props, '$.k') = 'NULL', false) AS k_null, coalesce(json_type(props, '$.k') = 'VARCHAR' AND json_extract_string(props, '$.k') = '7', false) AS seven,
  coalesce(CASE WHEN json_type(props, '$.tags') = 'ARRAY' THEN CAST(json_extract(props, '$.tags') AS VARCHAR[]) END, []) AS tags, json_extract_string(props, '$.device.ver') AS ver, json_type(props, '$.items') AS items FROM b)
SELECT click_id, coalesce(os = 'ios', false) AS eq, false AS strict, coalesce(k IN (5, 30), false) OR k_null OR seven AS listed, list_contains(tags, 'b') AS member, coalesce(ver <> '2.0', true) AS neq, coalesce(k BETWEEN 10 AND 40, false) AS ranged, false AS dated,
  false AS through_array, coalesce(os = 'tv', false) OR (list_contains(tags, 'c') AND coalesce(k > 50, false)) AS tree, true AS open FROM x"""
)
def filter_json_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which clicks each filter over their JSON properties admits."""
    df = with_body(table(spark, sf_dir, "clicks").select("click_id", "props"), "props")
    return df.select("click_id", *(condition(df, spec).alias(name) for name, spec in _BODY_FILTERS.items()))




@register(_with(INDEX_SQL, _VOCAB) + "SELECT value, score FROM (SELECT expansion AS value, CAST(df AS BIGINT) AS score FROM vocab WHERE starts_with(expansion, 'reti') ORDER BY expansion LIMIT 40) x ORDER BY score DESC, value LIMIT 10")
def autocomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.autocomplete(active_index(spark, sf_dir, "prefixes"), "the reti", 10)


@register(_with(INDEX_SQL, _terms_sql({"q": PLAIN})) + "SELECT query_id, concat('bm25:', field, ':', term) AS component, round(value, 6) AS value FROM parts JOIN q USING (term) WHERE doc_id = (SELECT min(doc_id) FROM parts JOIN q USING (term))")
def explain_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document that the query finds."""
    first = _matched(spark, sf_dir).agg(F.min("doc_id")).first()[0]
    return S.explain(active_index(spark, sf_dir), _terms(spark, {"q": PLAIN}), first).select("query_id", "component", F.round("value", 6).alias("value"))


@register(_with(TOKENS_SQL, "d AS (SELECT field, term, count(DISTINCT doc_id) AS df FROM tok GROUP BY field, term)") + "SELECT field, term, count(*) AS tf, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions, max(df) AS df FROM tok JOIN d USING (field, term) WHERE doc_id = 1 GROUP BY field, term ORDER BY field, term LIMIT 500")
def document_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.document_terms(active_index(spark, sf_dir), 1).select("field", "term", "tf", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"), "df")


_SURFACES = r"""page AS (SELECT doc_id FROM ranked ORDER BY round(score, 9) DESC, doc_id LIMIT 10),
shown AS (SELECT doc_id, 0 AS f, 'title' AS field, title AS body FROM docs JOIN page USING (doc_id) UNION ALL SELECT doc_id, 1, 'content', content FROM docs JOIN page USING (doc_id)),
cuts AS (SELECT doc_id, f, field, regexp_extract_all(body, '[\p{L}\p{N}]+') AS s, regexp_split_to_array(body, '[\p{L}\p{N}]+') AS g FROM shown),
flat AS (SELECT doc_id, f, field, unnest(s) AS word, unnest(g[1:len(s)]) AS gap, unnest(range(len(s))) AS pos FROM cuts),
placed AS (SELECT doc_id, f, field, pos, lower(word) AS raw, sum(length(gap) + length(word)) OVER (PARTITION BY doc_id, f ORDER BY pos) - length(word) AS start, length(word) AS size FROM flat)"""


@register(
    _with(INDEX_SQL, _VOCAB, f"q0{_terms_sql({'q': 'reti inhe'})[1:]}", _synonym_sql(), "near AS (SELECT query_id, expansion, row_number() OVER (PARTITION BY query_id, term ORDER BY expansion) AS n FROM q0 JOIN vocab ON starts_with(expansion, term))")
    + """, q AS (SELECT query_id, term FROM q0 UNION SELECT query_id, expansion FROM q0 JOIN syn USING (term) UNION SELECT query_id, expansion FROM near WHERE n <= 32),
ranked AS (SELECT doc_id, sum(value) AS score FROM parts JOIN q USING (term) GROUP BY doc_id), """
    + _SURFACES
    + ", "
    + stem_sql("placed", "stemmed", "doc_id, f, field, pos, start, size")
    + """, found AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY f, pos) AS n FROM stemmed WHERE term IN (SELECT term FROM q))
SELECT doc_id, field, term, CAST(start AS INTEGER) AS "start", CAST(start + size AS INTEGER) AS "end" FROM found WHERE n <= 12"""
)
def highlight_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 12 ranges of expanded terms per hit, title before content, for the first page only."""
    index = active_index(spark, sf_dir, "prefixes")
    terms = S.expand_in(index, _terms(spark, {"q": "reti inhe"}), _synonyms(spark), typo=False).persist()
    wanted = {r.term for r in terms.collect()}  # bounded by the query's length and the limits of expansion
    page = S.top(S.score(index, terms), 10).select("doc_id").join(index.docs.select("doc_id", "title", "content"), "doc_id")

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples():
                found = [(r.doc_id, f, t, s, e) for f, text in (("title", r.title), ("content", r.content)) for s, e, _, t in analyze_offsets(text or "", SETTINGS) if t in wanted]
                out += found[:12]
            yield pd.DataFrame(out, columns=["doc_id", "field", "term", "start", "end"])

    return page.mapInPandas(mark, "doc_id long, field string, term string, start int, end int")


@register(
    r"""WITH bodies AS (SELECT doc_id, 'title' AS field, split_part(text, '.', 1) AS body FROM documents UNION ALL SELECT doc_id, 'tags', concat_ws(' ', source, CASE WHEN doc_id % 3 <> 0 THEN lang END) FROM documents),
raws AS (SELECT doc_id, field, unnest(list_filter(string_split(regexp_replace(lower(body), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '')) AS raw FROM bodies), """
    + stem_sql("raws", "tok", "doc_id, field")
    + " SELECT field, term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM tok GROUP BY field, term"
)
def indexed_field_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings and arrays of strings are indexed, null members and numbers aren't."""
    docs = search_docs(spark, sf_dir).select("doc_id", "title", F.col("n_chars").alias("content"), F.array("source", F.when(F.col("doc_id") % 3 != 0, F.col("language"))).alias("tags"))
    return build(docs, SETTINGS, check=False).postings.groupBy("field", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


@register(
    r"""WITH raws AS (SELECT doc_id, unnest(list_filter(string_split(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '')) AS raw FROM documents), """
    + stem_sql("raws", "tok", "doc_id")
    + " SELECT term, count(*) AS n FROM tok GROUP BY term"
)
def normalized_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full-width letters and ligatures are found as the plain ones that the documents have."""
    odd = F.when(F.col("doc_id") % 4 == 0, F.replace(F.translate("text", "aeT", "ａｅＴ"), F.lit("fi"), F.lit("ﬁ"))).otherwise(F.col("text"))
    docs = table(spark, sf_dir, "documents").select("doc_id", odd.alias("content"))
    return field_tokens(docs, ["content"]).groupBy("term").agg(F.count("*").alias("n"))


@register("SELECT doc_id, CASE WHEN length(text) > 320 THEN concat(substr(text, 1, 317), '…') ELSE text END AS snippet FROM documents")
def snippet_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", snippet(F.col("text")).alias("snippet"))


_CONSOLE = "c AS (SELECT doc_id, split_part(text, '.', 1) AS title, text AS content, source AS source_id, doc_id % 6 = 0 AS deleted FROM documents)"


def _console(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = search_docs(spark, sf_dir).select("doc_id", "title", "content", F.col("source").alias("source_id"))
    return docs.withColumn("deleted_at", F.when(F.col("doc_id") % 6 == 0, F.lit("2024-01-01").cast("timestamp")))


@register(
    f"""WITH {_CONSOLE}, p AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS n, count(*) OVER () AS total FROM c WHERE NOT deleted AND doc_id > 20 AND (contains(lower(title), '%%% an') OR contains(lower(content), '%%% an')))
SELECT doc_id, source_id, CASE WHEN total > 9 THEN (SELECT doc_id FROM p WHERE n = 9) END AS next_after FROM p WHERE n <= 9"""
)
def document_browser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of live documents with a text in them, after some id."""
    return X.browse(_console(spark, sf_dir), "%%% AN", after=20, limit=9).select("doc_id", "source_id", "next_after")


@register(f"WITH {_CONSOLE} SELECT doc_id, title FROM c WHERE deleted AND source_id = 'src0' ORDER BY doc_id LIMIT 100")
def deleted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first deleted documents of one source."""
    return X.browse(_console(spark, sf_dir), source="src0", status="deleted", limit=100).select("doc_id", "title")


@register("SELECT doc_id, doc_id % 5 <> 0 AS in_active, CASE WHEN doc_id % 6 = 0 THEN 'deleted' WHEN doc_id % 5 <> 0 AND doc_id % 7 <> 0 THEN 'indexed' ELSE 'pending' END AS state FROM documents")
def document_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against an active version without one in five, in which one in seven has an older title."""
    docs = _console(spark, sf_dir)
    active = docs.filter("doc_id % 5 <> 0").withColumn("title", F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("old "), "title")).otherwise(F.col("title")))
    return X.document_states(docs, active, ["title", "content"]).select("doc_id", "in_active", "state")


@register(
    """WITH b AS (SELECT click_id, json_valid(props) AS good, coalesce(CASE WHEN json_valid(props) THEN json_keys(props) END, []) AS names FROM clicks)
SELECT click_id, array_to_string(list_sort(list_distinct(list_concat(list_filter(names, lambda n: n <> 'k'), ['added', 'k']))), ',') AS changed FROM b"""
)
def body_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an edit that keeps nothing and adds one entry changes of clicks' JSON bodies, all of which have another ``k``."""
    before = table(spark, sf_dir, "clicks").select("click_id", "props")
    return X.changed_fields(before, before.select("click_id", F.lit('{"k": "other", "added": 1}').alias("props")).dropDuplicates(["click_id"]), "click_id", "props").select("click_id", F.array_join("changed", ",").alias("changed"))


@register("SELECT a.doc_id, concat_ws(',', CASE WHEN a.lang IS DISTINCT FROM b.lang THEN 'lang' END, CASE WHEN a.source IS DISTINCT FROM b.source THEN 'source' END) AS changed FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1")
def changed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    b = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("lang").alias("new_lang"), F.col("source").alias("new_source"))
    diff = F.concat_ws(",", *(F.when(~F.col(c).eqNullSafe(F.col(f"new_{c}")), F.lit(c)) for c in ("lang", "source")))
    return d.join(b, "doc_id").select("doc_id", diff.alias("changed"))


@register(
    _with(INDEX_SQL, _terms_sql(BATCH))
    + """, hits AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM (SELECT query_id, doc_id, sum(value) AS score FROM parts JOIN q USING (term) GROUP BY query_id, doc_id) s),
graded AS (SELECT query_id, rank, doc_id, coalesce(quality, 0) AS grade FROM hits LEFT JOIN labels USING (doc_id) WHERE rank <= 5),
relevant AS (SELECT count(*) AS n FROM labels WHERE quality > 0),
m AS (SELECT query_id, sum(CASE WHEN grade > 0 THEN 1 ELSE 0 END) / 5.0 AS p, sum(CASE WHEN grade > 0 THEN 1 ELSE 0 END) / max(n) AS r, coalesce(max(CASE WHEN grade > 0 THEN 1.0 / rank END), 0) AS rr,
  sum((pow(2, grade) - 1) / log2(rank + 1)) / (SELECT sum(1 / log2(i + 1)) FROM range(1, 6) t(i)) AS ndcg FROM graded, relevant GROUP BY query_id)
SELECT round(sum(p) / 4, 4) AS precision_at_5, round(sum(r) / 4, 4) AS recall_at_5, round(sum(rr) / 4, 4) AS mrr_at_5, round(sum(ndcg) / 4, 4) AS ndcg_at_5 FROM m"""
)
def ir_metrics_at_5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.evaluation import macro_metrics

    hits = S.top(S.score(active_index(spark, sf_dir), _terms(spark, BATCH)), 5)
    judged = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("grade"))
    return macro_metrics(hits, judged.withColumn("query_id", F.explode(F.array(*(F.lit(k) for k in BATCH)))), 5)
