"""The queue as a single-writer stream: every batch of commands is applied and followed by one tick."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import queue as Q

#: Seconds between ticks and between purges.
TICK_SECONDS, PURGE_SECONDS = 2, 300


def written(q: Q.Queue, folder: str) -> None:
    for name in Q.TABLES:
        getattr(q, name).write.mode("overwrite").parquet(f"{folder}/{name}")


def stored(spark: SparkSession, folder: str) -> Q.Queue:
    return Q.Queue(**{name: spark.read.parquet(f"{folder}/{name}") for name in Q.TABLES})


def tick_sink(store: str, send: Callable[[DataFrame], None] | None = None, purge_every: int = PURGE_SECONDS // TICK_SECONDS) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function over commands (job_id, execution_id, kind, at).

    Version ``v=0`` of the queue lies under ``store``.  Batch ``n`` reads version ``n``, whatever
    has been written since, and writes version ``n + 1`` and what it sent; so a batch that is
    repeated after a failure gives the same tables, and what it sends again has the same ids.
    The tick's time is the latest command's; a batch without commands doesn't tick.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        q = stored(spark, f"{store}/v={number}")
        now = batch.agg(F.max("at")).first()[0]
        if now is None:
            written(q, f"{store}/v={number + 1}")
            return
        q = Q.replace(q, jobs=Q.commanded(q.jobs, batch))
        q, sent = Q.tick(q, F.lit(now).cast("timestamp"), purging=number % purge_every == 0)
        if send is not None:
            send(sent)
        sent.write.mode("overwrite").parquet(f"{store}/sent/v={number + 1}")
        written(q, f"{store}/v={number + 1}")

    return apply
