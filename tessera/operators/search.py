"""Search over index tables: expansion, candidates, BM25, phrases, ranking, facets.

Every step takes a batch of queries, one row per (query, term), so many queries are
one plan: the postings are scanned once and joined with the terms.  Term tables are
small by construction (a query has at most a thousand characters, and expansion is
limited per term), but a batch may be large, so broadcasting is left to the size
estimate of the optimizer.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.distance import deletion_variants, osa
from ..functions.text import analyze_text
from ..settings import IndexSettings
from .index import LEAST_COMPLETIONS, MOST_COMPLETIONS, PER_COMPLETION, Index, prefix_table

PHRASE_BONUS = 2.0
MAX_PREFIXES, MAX_TYPOS = 32, 12
#: A batch of queries with more terms is joined with whole tables.
MAX_NAMES = 1000
DIGITS = 9


@dataclass
class Parsed:
    terms: list[str]
    phrases: list[list[str]]


def parse(query: str, settings: IndexSettings = IndexSettings()) -> Parsed:
    """Quoted phrases and the plain terms of the rest; an unbalanced quote is a separator."""
    phrases = [[t for t, _, _ in analyze_text(q, settings)] for q in re.findall(r'"([^"]+)"', query)]
    rest = re.sub(r'"([^"]+)"', " ", query)
    return Parsed(list(dict.fromkeys(t for t, _, _ in analyze_text(rest, settings))), [p for p in phrases if p])


def parsed_queries(spark: SparkSession, queries: dict[str, str], settings: IndexSettings = IndexSettings()) -> tuple[DataFrame, DataFrame]:
    """Plain terms (query_id, term) and phrase terms (query_id, phrase, ordinal, size, term)."""
    terms, phrases = [], []
    for name, text in queries.items():
        p = parse(text, settings)
        terms += [(name, t) for t in p.terms]
        phrases += [(name, i, j, len(f), t) for i, f in enumerate(p.phrases) for j, t in enumerate(f)]
    return (
        spark.createDataFrame(terms, "query_id string, term string"),
        spark.createDataFrame(phrases, "query_id string, phrase int, ordinal int, size int, term string"),
    )


# Expansion


def prefix_candidates(terms: DataFrame, vocabulary: DataFrame, most: int = MAX_PREFIXES) -> DataFrame:
    """(query_id, term, expansion): the first ``most`` vocabulary terms that begin with each term.

    Words are joined on their first letters, so the range is compared within one
    letter's words only.
    """
    q = terms.select("query_id", "term").withColumn("initial", F.substring("term", 1, 1))
    v = vocabulary.select(F.col("term").alias("expansion")).withColumn("initial", F.substring("expansion", 1, 1))
    near = q.join(v, (q.initial == v.initial) & F.startswith(v.expansion, q.term)).select("query_id", "term", "expansion")
    first = Window.partitionBy("query_id", "term").orderBy("expansion")
    return near.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= most).drop("n")


def stored_typo_candidates(index: Index, terms: DataFrame) -> DataFrame:
    """``typo_candidates`` of a few queries from the deletion dictionary, of which only the buckets of their variants are read."""
    d = index.settings.max_distance
    asked = terms.filter(F.length("term") >= index.settings.min_token_length).select(F.explode(deletion_variants(F.col("term"), d)).alias("term"))
    names = names_of(asked) if index.buckets else None
    return typo_candidates(terms, index.vocabulary, index.settings, variants=index.rows("variants", names, "variant"))


def typo_candidates(terms: DataFrame, vocabulary: DataFrame, settings: IndexSettings = IndexSettings(), most: int = MAX_TYPOS, variants: DataFrame | None = None) -> DataFrame:
    """(query_id, term, expansion, distance): nearest terms that share a deletion variant.

    The variants are those of the index's deletion dictionary; without one, vocabulary
    words of nearly the same length are expanded.  Spark's own edit distance removes
    most pairs before the exact one runs.
    """
    d = settings.max_distance
    q = terms.filter(F.length("term") >= settings.min_token_length)
    q = q.select("query_id", "term", F.explode(deletion_variants(F.col("term"), d)).alias("variant"))
    if variants is None:
        bounds = terms.agg(F.min(F.length("term")).alias("low"), F.max(F.length("term")).alias("high"))
        v = vocabulary.join(F.broadcast(bounds), F.length("term").between(F.col("low") - d, F.col("high") + d))  # one row
        variants = v.select("term", "df", F.explode(deletion_variants(F.col("term"), d)).alias("variant"))
    v = variants.select(F.col("term").alias("expansion"), "df", "variant")
    pairs = q.join(v, "variant").filter(F.abs(F.length("term") - F.length("expansion")) <= d).select("query_id", "term", "expansion", "df").distinct()
    pairs = pairs.filter(F.levenshtein("term", "expansion", 2 * d) >= 0).withColumn("distance", osa(F.col("term"), F.col("expansion"), d)).filter(F.col("distance") <= d)
    best = Window.partitionBy("query_id", "term").orderBy("distance", F.desc("df"), F.collate("expansion", "UNICODE"))
    return pairs.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= most).drop("n", "df")


def synonym_pairs(spark: SparkSession, groups: list[tuple[list[str], bool]], settings: IndexSettings = IndexSettings()) -> DataFrame:
    """(term, expansion) of synonym groups (terms, one_way).

    A group's terms are analysed into single tokens; a one-way group maps its first
    token to the others and replaces what that token had, two-way groups add up.
    """
    found: dict[str, list[str]] = {}
    for names, one_way in groups:
        tokens = list(dict.fromkeys(t for n in names for t, _, _ in analyze_text(n, settings)))
        if len(tokens) < 2:
            continue
        if one_way:
            found[tokens[0]] = tokens[1:]
        else:
            for t in tokens:
                found[t] = list(dict.fromkeys([*found.get(t, []), *(o for o in tokens if o != t)]))
    return spark.createDataFrame([(t, e) for t, es in found.items() for e in es], "term string, expansion string")


def enabled_synonyms(sets: DataFrame, settings: IndexSettings = IndexSettings()) -> DataFrame:
    """``synonym_pairs`` of a stored table (set_id, enabled, one_way, terms), read when a query is asked.

    Only enabled sets count, in order of ``set_id``: a one-way set replaces what its first token had
    from the sets before it, so of a token's pairs those from its last one-way set on are kept.
    """

    @F.pandas_udf("array<string>")
    def tokens(names: pd.Series) -> pd.Series:
        return names.map(lambda some: list(dict.fromkeys(t for n in some if n is not None for t, _, _ in analyze_text(n, settings))) if some is not None else [])

    own = sets.filter("enabled").select("set_id", "one_way", tokens("terms").alias("t")).filter("size(t) >= 2")
    one = own.filter("one_way").select("set_id", F.lit(True).alias("one"), F.col("t")[0].alias("term"), F.explode(F.slice("t", 2, 1 << 20)).alias("expansion"))
    two = own.filter("NOT one_way").select("set_id", F.lit(False).alias("one"), "t", F.explode("t").alias("term")).select("set_id", "one", "term", F.explode("t").alias("expansion")).filter("term <> expansion")
    pairs = one.unionByName(two)
    last = pairs.groupBy("term").agg(F.max(F.when(F.col("one"), F.col("set_id"))).alias("last"))
    return pairs.join(last, "term").filter("last IS NULL OR set_id >= last").select("term", "expansion").distinct()


def expand(terms: DataFrame, vocabulary: DataFrame, settings: IndexSettings = IndexSettings(), synonyms: DataFrame | None = None, typo: bool = True, variants: DataFrame | None = None) -> DataFrame:
    """(query_id, term): each query's distinct terms after expansion, all of equal weight."""
    out = terms.select("query_id", "term")
    if synonyms is not None:
        out = out.unionByName(terms.join(synonyms, "term").select("query_id", F.col("expansion").alias("term")))
    if settings.prefix:
        out = out.unionByName(prefix_candidates(terms, vocabulary).select("query_id", F.col("expansion").alias("term")))
    if settings.typo and typo:
        out = out.unionByName(typo_candidates(terms, vocabulary, settings, variants=variants).select("query_id", F.col("expansion").alias("term")))
    return out.distinct()


def expand_in(index: Index, terms: DataFrame, synonyms: DataFrame | None = None, typo: bool = True) -> DataFrame:
    """``expand`` of a few queries by an index's tables of prefixes and deletion variants, so its vocabulary isn't read."""
    s = index.settings
    if index.prefixes is None or index.variants is None:
        return expand(terms, index.vocabulary, s, synonyms, typo, index.variants)
    out = terms.select("query_id", "term")
    if synonyms is not None:
        out = out.unionByName(terms.join(synonyms, "term").select("query_id", F.col("expansion").alias("term")))
    if s.prefix:
        first = index.rows("prefixes", names_of(terms), "prefix").filter(F.col("place") <= MAX_PREFIXES).select("prefix", F.col("term").alias("expansion"))
        out = out.unionByName(terms.join(first, F.col("prefix") == terms.term).select("query_id", F.col("expansion").alias("term")))
    if s.typo and typo:
        out = out.unionByName(stored_typo_candidates(index, terms).select("query_id", F.col("expansion").alias("term")))
    return out.distinct()


# Scores


def bm25(tf: F.Column, length: F.Column, average: F.Column, df: F.Column, n_docs: int, k1: float, b: float) -> F.Column:
    n = float(max(1, n_docs))
    idf = F.log(1 + (F.lit(n) - df + 0.5) / (df + 0.5))
    mean = F.when(F.coalesce(average, F.lit(0.0)) > 0, average).otherwise(1.0)
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.coalesce(length, F.lit(0)) / mean))


def names_of(terms: DataFrame, most: int = MAX_NAMES) -> list[str] | None:
    """The distinct terms of a few queries, for lookups; None for more than ``most``, where tables are joined whole."""
    found = [r.term for r in terms.select("term").distinct().limit(most + 1).collect()]
    return sorted(found) if len(found) <= most else None


def components(index: Index, terms: DataFrame, among: DataFrame | None = None, names: list[str] | None = None) -> DataFrame:
    """(query_id, doc_id, field, term, value): boosted BM25 of every matching posting.

    ``among`` restricts documents before scores are computed; document frequencies
    and averages stay those of the whole index.  ``names``, all terms of the queries, restricts
    what is read of a stored index.
    """
    s = index.settings
    posts = index.rows("postings", names).select("field", "term", "doc_id", "tf", "len")
    if among is not None:
        posts = posts.join(among.select("doc_id"), "doc_id", "left_semi")
    hits = posts.join(terms, "term").join(index.rows("dictionary", names).select("field", "term", "df"), ["field", "term"]).join(F.broadcast(index.averages), "field", "left")  # a row per field
    boost = F.lit(1.0)
    for name, weight in s.boosts.items():
        boost = F.when(F.col("field") == name, float(weight)).otherwise(boost)
    value = bm25(F.col("tf"), F.col("len"), F.col("avg_len"), F.col("df"), index.n_docs, s.k1, s.b) * boost
    return hits.select("query_id", "doc_id", "field", "term", value.alias("value"))


def phrase_hits(index: Index, phrases: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(query_id, doc_id, phrase) where a phrase's terms stand one after another in one field.

    Positions minus ordinals agree for a whole phrase, so what is left of the first term's
    after those of the others must hold one.  A posting stays one row with its positions: the
    tasks that read them keep nothing, and a group is a document's own postings of the phrase.
    """
    posts = index.rows("postings", names).select("field", "term", "doc_id", "positions").join(phrases, "term")
    own = ["query_id", "phrase", "size", "field", "doc_id"]
    starts = F.expr("transform(positions, p -> p - ordinal)").alias("starts")
    # Dealt by document before they are grouped, or each reading task would sort all that it reads.
    lined = posts.select(*own, F.struct("ordinal", starts).alias("x")).repartition("field", "doc_id")
    held = lined.groupBy(*own).agg(F.collect_list("x").alias("xs")).filter("size(xs) >= size")
    of = "flatten(transform(filter(xs, x -> x.ordinal = {0}), x -> x.starts))"
    left = f"aggregate(if(size > 1, sequence(1, size - 1), array()), {of.format(0)}, (s, k) -> array_intersect(s, {of.format('k')}))"
    return held.filter(f"size({left}) > 0").select("query_id", "doc_id", "phrase").distinct()


def score(index: Index, terms: DataFrame, phrases: DataFrame | None = None, among: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, score): terms are alternatives, every phrase must match and adds a bonus.

    Of a stored index only the buckets and pages of the queries' terms are read, as long as they are few.
    """
    names = names_of(terms) if index.buckets else None
    total = components(index, terms, among, names).groupBy("query_id", "doc_id").agg(F.sum("value").alias("score"))
    if phrases is not None:
        need = phrases.groupBy("query_id").agg(F.countDistinct("phrase").alias("need"))
        hits = phrase_hits(index, phrases, names_of(phrases) if index.buckets else None)
        if among is not None:
            hits = hits.join(among.select("doc_id"), "doc_id", "left_semi")
        have = hits.groupBy("query_id", "doc_id").agg(F.count("*").alias("have"))
        total = total.join(have, ["query_id", "doc_id"], "full").join(need, "query_id", "left")
        total = total.filter(F.coalesce("have", F.lit(0)) == F.coalesce("need", F.lit(0)))
        total = total.select("query_id", "doc_id", (F.coalesce("score", F.lit(0.0)) + PHRASE_BONUS * F.coalesce("have", F.lit(0))).alias("score"))
    return total.filter("score > 0")


def top(scored: DataFrame, k: int, offset: int = 0) -> DataFrame:
    """Ranked hits of each query: score down, then id up."""
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", DIGITS)), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter((F.col("rank") > offset) & (F.col("rank") <= offset + k))


def facets(ranked: DataFrame, docs: DataFrame, fields: list[str]) -> DataFrame:
    """(facet, value, n) over all ranked documents; arrays count each member, missing values no bucket."""
    held = docs.join(ranked.select("doc_id"), "doc_id", "left_semi")
    kinds = dict(docs.dtypes)
    def entries(name: str) -> F.Column:
        entry = lambda v: F.struct(F.lit(name).alias("facet"), v.cast("string").alias("value"))
        if not kinds[name].startswith("array"):
            return F.array(entry(F.col(name)))
        return F.transform(F.coalesce(F.col(name), F.array().cast(kinds[name])), entry)

    parts = [entries(f) for f in fields]
    rows = held.select(F.explode(F.concat(*parts)).alias("x")).select("x.facet", "x.value").filter("value IS NOT NULL")
    return rows.groupBy("facet", "value").agg(F.count("*").alias("n"))


def autocomplete(index: Index, prefix: str, limit: int = 10) -> DataFrame:
    """(value, score): terms that begin with the last analysed term, by document frequency.

    They are chosen from the prefix's first terms, as many as the limit asks for; these are rows of a
    stored table, so the vocabulary isn't read.
    """
    from ..functions.text import normalize_text

    if not 1 <= limit <= MOST_COMPLETIONS:
        raise ValueError(f"limit must be 1 to {MOST_COMPLETIONS}")
    parsed = [t for t, _, _ in analyze_text(prefix, index.settings)]
    stem = parsed[-1] if parsed else normalize_text(prefix, index.settings).strip()
    names = [stem] if stem else []
    near = (index.rows("prefixes", names, "prefix") if index.prefixes is not None else prefix_table(index.vocabulary.filter(F.startswith("term", F.lit(stem)))).filter(F.col("prefix").isin(*names))).filter(F.col("place") <= max(PER_COMPLETION * limit, LEAST_COMPLETIONS))
    return near.select(F.col("term").alias("value"), F.col("df").alias("score")).orderBy(F.desc("score"), "value").limit(limit)


def explain(index: Index, terms: DataFrame, doc_id: object, phrases: DataFrame | None = None) -> DataFrame:
    """(query_id, component, value) of one document; nothing if it fails the query."""
    one = index.docs.filter(F.col("doc_id") == doc_id).select("doc_id")
    passed = score(index, terms, phrases, one).select("query_id", "doc_id")
    parts = components(index, terms, one).select("query_id", "doc_id", F.concat_ws(":", F.lit("bm25"), "field", "term").alias("component"), "value")
    if phrases is not None:
        named = phrases.groupBy("query_id", "phrase").agg(F.expr("array_join(transform(array_sort(collect_list(struct(ordinal, term))), x -> x.term), ' ')").alias("words"))
        parts = parts.unionByName(phrase_hits(index, phrases).join(one, "doc_id", "left_semi").join(named, ["query_id", "phrase"]).select("query_id", "doc_id", F.concat(F.lit("phrase:"), "words").alias("component"), F.lit(PHRASE_BONUS).alias("value")))
    return parts.join(passed, ["query_id", "doc_id"], "left_semi").select("query_id", "component", "value")


def document_terms(index: Index, doc_id: object, most_terms: int = 500, most_positions: int = 100) -> DataFrame:
    """A document's terms with counts, first positions and document frequencies."""
    own = index.postings.filter(F.col("doc_id") == doc_id).join(index.dictionary, ["field", "term"])
    return own.select("field", "term", "tf", F.slice("positions", 1, most_positions).alias("positions"), "df").orderBy("field", "term").limit(most_terms)
