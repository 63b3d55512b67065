"""Ranking quality and load figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def query_metrics(hits: DataFrame, judgments: DataFrame, k: int = 5) -> DataFrame:
    """Per judged query: precision, recall, reciprocal rank and normalised discounted gain at ``k``.

    ``hits`` has query_id, doc_id and rank from 1; ``judgments`` query_id, doc_id and
    grade.  A judged query without hits has zeros.
    """
    gain = lambda grade: F.pow(F.lit(2.0), grade) - 1
    best = Window.partitionBy("query_id").orderBy(F.desc("grade"), "doc_id")
    ideal = judgments.filter("grade > 0").withColumn("n", F.row_number().over(best))
    ideal = ideal.groupBy("query_id").agg(F.count("*").alias("relevant"), F.sum(F.when(F.col("n") <= k, gain(F.col("grade")) / F.log2(F.col("n") + 1))).alias("ideal"))
    found = hits.filter(F.col("rank") <= k).join(judgments, ["query_id", "doc_id"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))
    hit = F.col("grade") > 0
    per = found.groupBy("query_id").agg(F.sum(hit.cast("int")).alias("hits"), F.min(F.when(hit, F.col("rank"))).alias("first"), F.sum(gain(F.col("grade")) / F.log2(F.col("rank") + 1)).alias("dcg"))
    both = ideal.join(per, "query_id", "left")
    zero = F.lit(0.0)
    return both.select(
        "query_id",
        (F.coalesce("hits", F.lit(0)) / F.lit(float(k))).alias("precision"),
        (F.coalesce("hits", F.lit(0)) / F.col("relevant")).alias("recall"),
        F.coalesce(1.0 / F.col("first"), zero).alias("rr"),
        F.coalesce(F.col("dcg") / F.col("ideal"), zero).alias("ndcg"),
    )


def macro_metrics(hits: DataFrame, judgments: DataFrame, k: int = 5) -> DataFrame:
    """Means over queries, rounded to four digits."""
    names = {"precision": f"precision_at_{k}", "recall": f"recall_at_{k}", "rr": f"mrr_at_{k}", "ndcg": f"ndcg_at_{k}"}
    return query_metrics(hits, judgments, k).agg(*(F.round(F.avg(c), 4).alias(n) for c, n in names.items()))


def nearest_rank(column: str, p: float) -> F.Column:
    """The value at rank ceil(p n), at least the first."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {column})")
