"""Counting requests against monthly limits as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.control import month_of
from ..operators.ranks import ranked
from .events import newest


def admission_sink(target: str, counters: DataFrame) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that judges requests (project_id, request_id, at).

    ``counters`` (project_id, period, used, most) is a static table of what was used before and the
    limits; a missing one counts from 0 without a limit.  Requests are judged in order of time within
    a batch and batches in their order; one that would pass the limit is refused and not counted.
    Verdicts (with ``admitted`` and the counter then) are in folders of ``target``/out.  State is a row
    for each project and month in ``target``/used: batch ``n`` reads the last version before it and
    writes version ``n``, so a batch that is repeated writes the same again.  Places in a month come
    from ranges of the batch, so neither a request nor a project passes a task of its own.
    """
    key = ["__project", "__period"]

    def keyed(rows: DataFrame) -> DataFrame:
        # Requests without a project or a time are counted too, and groups of ranks have no nulls.
        return rows.withColumns({c: F.coalesce(F.col(name).cast("string"), F.lit("")) for c, name in zip(key, ("project_id", "period"), strict=True)})

    limits = keyed(counters.filter("project_id IS NOT NULL AND period IS NOT NULL")).select(*key, F.col("used").alias("__first"), F.col("most").cast("long").alias("__most"))

    def apply(batch: DataFrame, number: int) -> None:
        last = newest(batch.sparkSession, f"{target}/used", number)
        own = limits.withColumn("__used", F.lit(None).cast("long")) if last is None else limits.join(last.withColumnRenamed("used", "__used"), key, "full")
        own = own.select(*key, F.coalesce("__used", "__first", F.lit(0)).cast("long").alias("__base"), "__most")
        rows = keyed(batch.withColumn("period", month_of(batch, "at")))
        placed = ranked(rows, key, ["at", "request_id"], of_group=own).withColumn("__n", F.coalesce("__base", F.lit(0)) + F.col("rank") + 1)
        fits, base = F.col("__most").isNull() | (F.col("__n") <= F.col("__most")), F.coalesce("__base", F.lit(0))
        used = F.when(F.col("__most").isNull(), F.col("__n")).otherwise(F.greatest(base, F.least("__n", "__most")))
        place = f"{target}/out/v={number}"
        placed.select("project_id", "period", "request_id", fits.alias("admitted"), used.cast("long").alias("used"), *key).write.mode("overwrite").parquet(place)
        state = batch.sparkSession.read.parquet(place).select(*key, "used")
        state = state if last is None else state.unionByName(last.select(*key, "used"))
        # A counter never falls.
        state.groupBy(*key).agg(F.max("used").alias("used")).write.mode("overwrite").parquet(f"{target}/used/v={number}")

    return apply
