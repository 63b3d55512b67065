"""The queries of this subpackage: ``(spark, sf_dir) -> DataFrame`` by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontamination import find_contamination
from .dominance import DOMINANCE_SQL, copies_of, day_of, dominated, level_of
from .fill_in_middle import FILL_IN_MIDDLE_SQL, fill_in_middle, restored
from .language_id import fit_language_id, identify
from .language_model import katz_scores
from .matches import joined
from .mixing import MIXING_SQL, mixed
from .neighbours import nearest
from .packing import CAPACITY, pack
from .pii import find_personal_data
from .quality import fit_quality, score_quality
from .secrets import find_secrets
from .simhash import near_duplicates
from .substring_dedup import remove_repeats

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(modulus: int, doc_id: str = "doc_id") -> F.Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    net = fit_language_id(docs, learn=fold(4) != 2)
    return identify(docs, net).select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score", "n_positions")


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"), is_query=F.col("id") % 100 == 0, k=10)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), tokenizer_path(), CAPACITY)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = fit_quality(docs, _table(spark, sf_dir, "labels"), learn=fold(5) != 0)
    scored = score_quality(docs, model)
    return scored.select("doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def _digest(found: DataFrame, kinds: list[str], *more: F.Column) -> DataFrame:
    base = F.sha2(F.expr(joined("base")).cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *kinds, base, F.expr(joined("spans")).alias("spans"), *more)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(_table(spark, sf_dir, "documents"))
    scores = F.expr("array_join(transform(spans, s -> cast(s.score AS string)), ',')").alias("scores")
    return _digest(found, ["n_email", "n_ip", "n_card", "n_phone"], scores)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(_table(spark, sf_dir, "documents"), window=35)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, distance=2)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz_scores(_table(spark, sf_dir, "documents"), held_out=fold(7) == 2)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(find_secrets(_table(spark, sf_dir, "documents")), ["n_assign", "n_access", "n_hex"])


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixed(_table(spark, sf_dir, "documents"))
    return mix.select("row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_in_middle(_table(spark, sf_dir, "documents"))
    back = restored(F.col("output"), F.col("form"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(back.cast("binary"), 256).alias("restored_sha256"))


def op13_dominance(spark: SparkSession, sf_dir: str) -> DataFrame:
    sales = _table(spark, sf_dir, "sales").select("sale_id", "sold_at", "total")
    found = dominated(sales, day_of(sales, "sold_at"), level_of("total"), copies_of("sale_id"))
    return found.select("row.sale_id", "slot", "level", F.col("n_above").alias("n_sales"), F.col("w_above").alias("n_rows"))


QUERIES: dict[str, Query] = {
    "op1_language_id": op1_language_id,
    "op2_neighbours": op2_neighbours,
    "op3_packing": op3_packing,
    "op4_quality": op4_quality,
    "op5_pii": op5_pii,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_simhash": op7_simhash,
    "op8_decontamination": op8_decontamination,
    "op9_language_model": op9_language_model,
    "op10_secrets": op10_secrets,
    "op11_mixing": op11_mixing,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_dominance": op13_dominance,
}

ORACLES: dict[str, str] = {"op11_mixing": MIXING_SQL, "op12_fill_in_middle": FILL_IN_MIDDLE_SQL, "op13_dominance": DOMINANCE_SQL}
