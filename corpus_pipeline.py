"""A training corpus from raw documents, in five stages.

Each stage takes the documents that the one before kept and returns documents with
the same columns; the last returns packed token sequences.

1. language identification: documents in which the network finds no language, or none
   with a pooled probability of 0.4, go; a null ``lang`` becomes the one it finds;
2. near-duplicates by SimHash: fingerprints of three-word shingles within two bits, found
   through Golay keys, and beyond them texts with a Jaccard similarity of 0.8 or more on
   five-word shingles: one row of each group stays, the one with the smallest id (nulls
   last), and among rows of one id the one whose text has the smallest hash;
3. benchmark decontamination: documents that hold a test phrase go;
4. secret scan: secrets are masked in the text;
5. best-fit packing into sequences of 2,048 tokens.

Nulls: a null text has no language and goes in the first stage.  In the second stage
rows are told apart by id and text, so different texts under one id, or without an
id, are documents of their own.  An empty table gives empty results.  Very long texts
pass every stage whole.  Where no row has a language to learn from, all texts with
letters pass the first stage.  Further columns are carried along.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.decontamination import uncontaminated
from tessera.llm.exchange import shared_folder
from tessera.llm.language_id import fit_language_id, identified
from tessera.llm.packing import CAPACITY, pack
from tessera.llm.queries import fold, tokenizer_path
from tessera.llm.secrets import redacted
from tessera.llm.similar import marked, similar_groups, wanted


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return identified(docs, fit_language_id(docs, learn=fold(4) != 2))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = similar_groups(docs, shingle=5, similarity=0.8, distance=2)
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")
    mark = "__text"  # the texts' hashes, under a name that the documents don't have
    while any(c.lower().startswith(mark.lower()) for c in docs.columns):
        mark += "_"
    each = groups.groupBy("root").agg(F.min(order).alias("first"), F.count("*").alias("rows"))
    first = each.select("first.doc_id", F.col("first.text_hash").alias(mark))
    # Most rows are alone in their group. They stay, and their texts aren't shuffled: the map has all rows
    # of larger groups, and the few others that share a bit with one go the same way as these.
    row = "xxhash64(cast(doc_id as long), `{}`)"
    several = groups.join(each.filter("rows > 1").select("root"), "root", "left_semi")
    several = wanted(several.selectExpr(f"{row.format('text_hash')} as node"))
    listed = F.pandas_udf(lambda rows: pd.Series(marked(several.value, rows.to_numpy()) == 1), "boolean")
    hashed = docs.withColumn(mark, F.xxhash64(F.col("text").cast("string"))).withColumn(mark + "listed", listed(F.expr(row.format(mark))))
    single, hashed = hashed.filter(~F.col(mark + "listed")), hashed.filter(F.col(mark + "listed"))
    named = hashed.join(first, ["doc_id", mark], "left_semi").dropDuplicates(["doc_id", mark])
    unnamed = hashed.filter(F.col("doc_id").isNull()).join(first.filter(F.col("doc_id").isNull()).select(mark), mark, "left_semi")
    # A join by name puts its columns first.
    return single.select(*docs.columns).unionByName(named.unionByName(unnamed.dropDuplicates([mark])).select(*docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redacted(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, tokenizer_path(), CAPACITY)


STAGES = [
    ("language_id", language),
    ("simhash_dedup", deduplicate),
    ("decontamination", decontaminate),
    ("secrets", hide_secrets),
    ("packing", sequences),
]

#: Neither the network nor the packing plan can be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences of ``documents``; every stage's result is written as Parquet and read again."""
    place = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{k}")
        docs = spark.read.parquet(f"{place}/{k}")
    return docs
