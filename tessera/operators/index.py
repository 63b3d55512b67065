"""Inverted index tables from documents.

``postings`` is the only pass over texts: a task splits its own texts into words, looks up each
distinct word's term once and groups a text's positions by term, so nothing is shuffled; the
other tables are aggregates of it.  A term's documents stay rows, so a frequent term is no single
large value.  A posting carries its document's field length, so scores need no join with lengths.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.distance import deletion_variants
from ..functions.text import analyzed, as_text, normalize_text, split_words, term_of
from ..lineage import stored
from ..settings import IndexSettings

#: The fields that are indexed unless others are named.
DEFAULT_FIELDS = ("title", "headings", "content", "url", "tags")
#: Lookups of more keys than this are left to their buckets.
MOST_PUSHED = 200
#: How many of a prefix's terms, in their order, completions are chosen from, for each one asked for and at least.
PER_COMPLETION, LEAST_COMPLETIONS, MOST_COMPLETIONS = 4, 20, 20
#: Words are grouped in batches of so many, and a task remembers the terms of so many.
HELD, KNOWN = 1 << 18, 1 << 20
SPLIT_BYTES = 128 << 20


@dataclass
class Index:
    """Tables of one index version."""

    docs: DataFrame  # doc_id and stored fields
    postings: DataFrame  # field, term, doc_id, tf, positions, len
    lengths: DataFrame  # doc_id, field, len
    dictionary: DataFrame  # field, term, df
    averages: DataFrame  # field, avg_len
    n_docs: int
    settings: IndexSettings
    variants: DataFrame | None = None  # variant, term, df: the deletion dictionary
    prefixes: DataFrame | None = None  # prefix, place, term, df: the first terms of each prefix
    buckets: dict[str, int] = field(default_factory=dict)  # of stored tables that are kept in buckets

    @property
    def vocabulary(self) -> DataFrame:
        """term and df summed over fields."""
        return self.dictionary.groupBy("term").agg(F.sum("df").alias("df"))

    def rows(self, table: str, names: Sequence[str] | None = None, key: str = "term") -> DataFrame:
        """A table, or its rows of the given keys: of a stored one only their buckets are listed, and within
        them only pages whose bounds admit one of the keys are read."""
        df: DataFrame = getattr(self, table)
        return df if names is None else df.filter(key_filter(key, names, self.buckets.get(table)))


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def key_filter(key: str, names: Sequence[str], buckets: int | None) -> Column:
    """Rows of some keys, as comparisons that Parquet readers take: a list of more than ten values would be widened to its bounds."""
    if not names:
        return F.lit(False)

    def any_of(some: Sequence[str]) -> Column:
        half = len(some) // 2
        return F.col(key) == some[0] if not half else any_of(some[:half]) | any_of(some[half:])

    own = any_of(names) if len(names) <= MOST_PUSHED else F.col(key).isin(*names)
    return own if buckets is None else F.col("bucket").isin(*(bucket_of(F.lit(n), buckets) for n in names)) & own


def spread(docs: DataFrame) -> DataFrame:
    """``docs`` over all cores where the optimizer estimates less than a file split for each; larger inputs stay as they are."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return docs.repartition(cores) if size < SPLIT_BYTES * cores else docs


def field_tokens(docs: DataFrame, fields: list[str], settings: IndexSettings = IndexSettings()) -> DataFrame:
    """doc_id, field, pos, raw, term: every field's tokens."""
    return analyzed(field_texts(docs, fields), "text", settings)


def field_texts(docs: DataFrame, fields: list[str]) -> DataFrame:
    """doc_id, field, text: one row for each field with a text."""
    texts = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), as_text(docs, f).alias("text")) for f in fields)))
    return docs.select("doc_id", texts.alias("x")).select("doc_id", "x.field", "x.text").filter("text IS NOT NULL")


class _Numbers(dict):
    """Each word's number, that of its term in ``terms``; 0 for stop words."""

    def __init__(self, settings: IndexSettings):
        self.settings, self.terms, self.number = settings, [""], {"": 0}

    def __missing__(self, word: str) -> int:
        term = term_of(word, self.settings)
        found = self.number.setdefault(term, len(self.terms))
        if found == len(self.terms):
            self.terms.append(term)
        self[word] = found
        return found


def postings(docs: DataFrame, fields: list[str], settings: IndexSettings = IndexSettings()) -> DataFrame:
    """field, term, doc_id, tf, positions, len: each text's tokens by term, grouped where the text is."""
    texts = field_texts(docs, fields)
    doc_id = texts.schema["doc_id"]

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Numbers(settings)
        for batch in batches:
            first, sizes, found = 0, [], []
            for i, text in enumerate(batch.column("text")):
                own = split_words(normalize_text(text.as_py(), settings))
                found += map(known.__getitem__, own)
                sizes.append(len(own))
                if len(found) >= HELD:
                    yield whole(batch, first, sizes, found, known.terms)
                    first, sizes, found = i + 1, [], []
                    if len(known) >= KNOWN:
                        known = _Numbers(settings)
            if found:
                yield whole(batch, first, sizes, found, known.terms)

    def whole(batch: pa.RecordBatch, first: int, sizes: list[int], found: list[int], terms: list[str]) -> pa.RecordBatch:
        term, n = np.array(found, np.int64), np.array(sizes, np.int64)
        row = np.repeat(np.arange(n.size), n)
        pos = np.arange(term.size) - np.repeat(np.cumsum(n) - n, n)
        if 0 in term:
            row, pos, term = row[term > 0], pos[term > 0], term[term > 0]
        key = row * len(terms) + term
        order = np.argsort(key, kind="stable")
        head = np.flatnonzero(np.diff(key[order], prepend=-1))
        counts = np.diff(np.append(head, key.size))
        row, term = row[order[head]], term[order[head]]
        used, which = np.unique(term, return_inverse=True)
        take = pa.array(row + first)
        places = pa.ListArray.from_arrays(pa.array(np.append(head, key.size).astype(np.int32)), pa.array(pos[order].astype(np.int32)))
        lens = np.bincount(row, counts, n.size).astype(np.int64)[row]
        return pa.RecordBatch.from_arrays([batch.column("field").take(take), pa.array([terms[t] for t in used.tolist()], pa.string()).take(pa.array(which)), batch.column("doc_id").take(take), pa.array(counts), places, pa.array(lens)], ["field", "term", "doc_id", "tf", "positions", "len"])

    kinds = T.StructType([T.StructField("field", T.StringType()), T.StructField("term", T.StringType()), doc_id, T.StructField("tf", T.LongType()), T.StructField("positions", T.ArrayType(T.IntegerType())), T.StructField("len", T.LongType())])
    return texts.select("doc_id", "field", "text").mapInArrow(grouped, kinds)


def posted_lengths(posts: DataFrame) -> DataFrame:
    """doc_id, field, len from postings."""
    return posts.groupBy("doc_id", "field").agg(F.max("len").alias("len"))


def prefix_table(vocabulary: DataFrame, most: int = PER_COMPLETION * MOST_COMPLETIONS) -> DataFrame:
    """prefix, place, term, df: the first ``most`` terms of each prefix.

    The limit is applied before the shuffle too, so a short prefix sends so many rows from each task.
    """
    each = vocabulary.select("term", "df", F.explode(F.sequence(F.lit(1), F.length("term"))).alias("n"))
    each = each.select(F.substring(F.col("term"), F.lit(1), F.col("n")).alias("prefix"), "term", "df")
    place = F.row_number().over(Window.partitionBy("prefix").orderBy("term"))
    return each.withColumn("place", place).filter(F.col("place") <= most).select("prefix", "place", "term", "df")


def field_lengths(docs: DataFrame, fields: list[str], settings: IndexSettings = IndexSettings()) -> DataFrame:
    """doc_id, field, len: counted within each text, without a shuffle."""
    texts = field_texts(docs, fields)
    stops = any(settings.stop_words.values())

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = (split_words(normalize_text(text.as_py(), settings)) for text in batch.column("text"))
            sizes = pa.array([sum(term_of(w, settings) != "" for w in own) if stops else len(own) for own in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("field"), sizes], ["doc_id", "field", "len"])

    kinds = T.StructType([texts.schema["doc_id"], T.StructField("field", T.StringType()), T.StructField("len", T.LongType())])
    out = texts.select("doc_id", "field", "text").mapInArrow(counted, kinds).filter("len > 0")
    return out.groupBy("doc_id", "field").agg(F.sum("len").alias("len")) if _repeats(docs) else out


def _repeats(docs: DataFrame) -> bool:
    return not docs.groupBy("doc_id").count().filter("count > 1").isEmpty()


def text_counts(docs: DataFrame, fields: list[str], settings: IndexSettings = IndexSettings()) -> DataFrame:
    """doc_id, field, term, tf: counted within each text, without a shuffle unless an id repeats."""
    out = postings(docs, fields, settings).select("doc_id", "field", "term", "tf")
    return out.groupBy("doc_id", "field", "term").agg(F.sum("tf").alias("tf")) if _repeats(docs) else out


def term_counts(tokens: DataFrame) -> DataFrame:
    """Postings without positions: counts combine before the shuffle."""
    return tokens.groupBy("field", "term", "doc_id").agg(F.count("*").alias("tf"))


def lengths(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("doc_id", "field").agg(F.count("*").alias("len"))


def dictionary(counts: DataFrame) -> DataFrame:
    return counts.groupBy("field", "term").agg(F.count("*").alias("df"))


def averages(lens: DataFrame, n_docs: int) -> DataFrame:
    """Mean field length over all documents, also those without the field."""
    return lens.groupBy("field").agg((F.sum("len") / F.lit(max(1, n_docs))).alias("avg_len"))


def build(docs: DataFrame, settings: IndexSettings = IndexSettings(), fields: list[str] | None = None, check: bool = True) -> Index:
    """All tables of an index over ``docs``; its fields are the default ones that the documents have."""
    fields = fields or [f for f in DEFAULT_FIELDS if f in docs.columns]
    if not fields:
        raise ValueError("no field to index")
    ids = docs.groupBy("doc_id").count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.count_if(F.expr("count > 1 OR doc_id IS NULL"))).first()
    if check and ids[1]:
        raise ValueError("document ids must be unique and not null")
    wide = spread(docs)
    posts = stored(postings(wide, fields, settings), "postings")
    lens, n = posted_lengths(posts), ids[0]
    return Index(docs, posts, lens, dictionary(posts), averages(lens, n), n, settings)


def persisted(index: Index) -> Index:
    """The index with its smaller tables kept by the session, for many searches of one version."""
    index.dictionary = dictionary(index.postings).persist()
    index.averages = averages(index.lengths, index.n_docs).persist()
    if index.settings.typo:
        index.variants = typo_dictionary(index.vocabulary, index.settings.max_distance).persist()
    index.prefixes = prefix_table(index.vocabulary).persist()
    return index


def typo_dictionary(vocabulary: DataFrame, most: int = 2) -> DataFrame:
    """Every term, with its other columns, under each of its deletion variants."""
    return vocabulary.select("*", F.explode(deletion_variants(F.col("term"), most)).alias("variant"))


def checksum(df: DataFrame) -> str:
    """A digest of a table's rows that doesn't depend on their order."""
    lists = {c for c, kind in df.dtypes if kind.startswith("array")}  # are hashed as they are, which is faster than as text
    cols = [F.coalesce(F.xxhash64(c).cast("string") if c in lists else F.col(c).cast("string"), F.lit("\0")) for c in sorted(df.columns)]
    row = df.select(F.xxhash64(*cols).alias("h"), F.xxhash64(F.lit(1), *cols).alias("g")).agg(F.count("*"), F.bit_xor("h"), F.expr("sum(cast(g as decimal(38, 0)))")).first()
    import hashlib

    return hashlib.sha256(repr(tuple(map(str, row))).encode()).hexdigest()
