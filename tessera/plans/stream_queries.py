"""Queries that run streams over the tables and return what the sinks hold."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types

from ..lineage import new_folder, stored
from ..operators import control as C
from ..streaming import events as E
from ..streaming import timers as T
from ..streaming import usage as U
from .common import EVENTS_SQL, Registry, plain_time, search_events, table

register = Registry()


def _folder(spark: SparkSession) -> str:
    return new_folder(spark, "stream")


def _complete(stream: DataFrame, place: str) -> DataFrame:
    """What a stream's complete result is after all batches."""
    q = stream.writeStream.outputMode("complete").foreachBatch(E.table_sink(f"{place}/out")).trigger(availableNow=True).option("checkpointLocation", f"{place}/c").start()
    q.awaitTermination()
    return E.newest(stream.sparkSession, f"{place}/out")


def _staged(spark: SparkSession, sf_dir: str, place: str) -> DataFrame:
    """Search events as a stream over files, in two batches."""
    ev = search_events(spark, sf_dir)
    ev.repartitionByRange(2, "created_at").write.parquet(f"{place}/in")
    return E.event_stream(spark, f"{place}/in", ev.schema)


@register(f"WITH {EVENTS_SQL} SELECT project, date_trunc('minute', created_at) AS minute, count(*) AS requests FROM ev GROUP BY 1, 2")
def stream_minute_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = _folder(spark)
    counts = E.minute_counts(_staged(spark, sf_dir, place), "project")
    return plain_time(_complete(counts, place), "minute")


@register(f"WITH {EVENTS_SQL} SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS searches, round(sum(latency_ms), 4) AS latency, count(*) FILTER (WHERE result_count = 0) AS zero_results FROM ev GROUP BY 1")
def stream_daily_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = _folder(spark)
    return _complete(E.daily_rollup(_staged(spark, sf_dir, place)), place).withColumn("latency", F.round("latency", 4))


@register(f"WITH {EVENTS_SQL} SELECT user_id, event_id, query FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, event_id DESC) AS n FROM ev) x WHERE n = 1")
def stream_latest_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = _folder(spark)
    stream = _staged(spark, sf_dir, place)
    q = stream.writeStream.foreachBatch(E.upsert_sink(f"{place}/out", ["user_id"], ["created_at", "event_id"])).option("checkpointLocation", f"{place}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    return E.newest(spark, f"{place}/out").select("user_id", "event_id", "query")


HOUR = 3600
#: One row for each command of a job, and the job before and after it; timers are due in between.
_WATCH = f"""c AS (SELECT user_id AS job_id, event_id AS seq, epoch_us(ts) AS due, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i,
  CASE event_type WHEN 'signup' THEN 'enqueue' WHEN 'view' THEN 'start' WHEN 'click' THEN 'beat' WHEN 'purchase' THEN 'finish' ELSE 'cancel' END AS kind FROM events),
last AS (SELECT (max(due) // 1000) * 1000 AS due FROM c),
steps AS (SELECT job_id, i, due, kind FROM c UNION ALL SELECT job_id, max(i) + 1, max(last.due), 'end' FROM c, last GROUP BY job_id),
run AS (
  SELECT job_id, 0 AS i, CAST(NULL AS VARCHAR) AS state, CAST(0 AS BIGINT) AS since, CAST(0 AS BIGINT) AS execution, false AS cancel, CAST(NULL AS VARCHAR) AS was, CAST(0 AS BIGINT) AS from_due, CAST(0 AS BIGINT) AS was_execution, CAST(0 AS BIGINT) AS until
  FROM (SELECT DISTINCT job_id FROM c) j
  UNION ALL
  SELECT x.job_id, x.i,
    CASE WHEN x.s IS NULL THEN CASE WHEN x.kind = 'enqueue' THEN 'queued' END
      WHEN x.kind = 'start' AND x.s = 'queued' OR x.kind = 'beat' AND x.s = 'running' AND NOT x.c THEN 'running'
      WHEN x.kind = 'finish' AND x.s = 'running' OR x.kind = 'cancel' AND x.s = 'queued' THEN 'ended' ELSE x.s END,
    CASE WHEN x.s IS NULL OR x.kind = 'start' AND x.s = 'queued' OR x.kind = 'beat' AND x.s = 'running' AND NOT x.c OR x.kind = 'finish' AND x.s = 'running' OR x.kind = 'cancel' AND x.s = 'queued' THEN x.due ELSE x.t END,
    CASE WHEN x.s IS NULL THEN 1 ELSE x.e END,
    x.s IS NOT NULL AND (x.c OR x.kind = 'cancel' AND x.s = 'running') AND NOT (x.kind = 'start' AND x.s = 'queued'),
    x.state, x.since, x.execution, x.due
  FROM (SELECT r.state, r.since, r.execution, n.job_id, n.i, n.due, n.kind,
      CASE WHEN r.state = 'running' AND NOT r.cancel AND r.since + {4 * HOUR}000000 <= n.due THEN 'queued' WHEN r.state = 'ended' AND r.since + {48 * HOUR}000000 <= n.due THEN NULL ELSE r.state END AS s,
      CASE WHEN r.state = 'running' AND NOT r.cancel AND r.since + {4 * HOUR}000000 <= n.due THEN r.since + {4 * HOUR}000000 ELSE r.since END AS t,
      CASE WHEN r.state = 'running' AND NOT r.cancel AND r.since + {4 * HOUR}000000 <= n.due THEN r.execution + 1 ELSE r.execution END AS e,
      r.cancel AND r.state IS NOT NULL AS c
    FROM run r JOIN steps n ON n.job_id = r.job_id AND n.i = r.i + 1) x),
gaps AS (SELECT a.job_id, a.i, a.was AS state, a.from_due AS since, a.was_execution AS execution, b.cancel, a.until FROM run a JOIN run b ON b.job_id = a.job_id AND b.i = a.i - 1 WHERE a.was IS NOT NULL),
fired AS (
  SELECT job_id, since + {4 * HOUR}000000 AS due, 'recover' AS action, execution + 1 AS execution, until FROM gaps WHERE state = 'running' AND NOT cancel AND since + {4 * HOUR}000000 <= until
  UNION ALL SELECT job_id, since + {48 * HOUR}000000, 'purge', execution, until FROM gaps WHERE state = 'ended' AND since + {48 * HOUR}000000 <= until),
waits AS (SELECT job_id, since, execution, until FROM gaps WHERE state = 'queued' UNION ALL SELECT job_id, due, execution, until FROM fired WHERE action = 'recover'),
again AS (SELECT DISTINCT job_id, since + CAST({2 * HOUR}000000 AS BIGINT) * (CAST(pow(2, k + 1) AS BIGINT) - 1) AS due, execution FROM (SELECT *, unnest(range(20)) AS k FROM waits) w WHERE since + CAST({2 * HOUR}000000 AS BIGINT) * (CAST(pow(2, k + 1) AS BIGINT) - 1) <= until)"""


def _in_order(rows: DataFrame, place: str, batches: int, order: list[str], run: Callable[[DataFrame], None]) -> None:
    """Runs a stream over ``rows`` in batches by ``order``: it is stopped after each one and started again with more files."""
    spark = rows.sparkSession
    # A batch is a run of ranges, so that no task writes or reads it alone.
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = rows.repartitionByRange(batches * n, *order).withColumn("part", F.expr(f"least({batches - 1}, spark_partition_id() div {n})").cast("int"))
    ranges.write.partitionBy("part").parquet(f"{place}/parts")
    parts = spark.read.schema(types.StructType([*rows.schema.fields, types.StructField("part", types.IntegerType())])).parquet(f"{place}/parts")
    for k in range(batches):
        parts.filter(F.col("part") == k).drop("part").write.mode("append").parquet(f"{place}/in")
        run(E.event_stream(spark, f"{place}/in", rows.schema, files_per_batch=1 << 30))


def _commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as commands of jobs, one job for each user."""
    kind = F.when(F.col("event_type") == "signup", "enqueue").when(F.col("event_type") == "view", "start").when(F.col("event_type") == "click", "beat").when(F.col("event_type") == "purchase", "finish").otherwise("cancel")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), kind.alias("kind"), F.col("ts").cast("timestamp").alias("at"))


@register(f"WITH RECURSIVE {_WATCH} SELECT job_id, due AS \"at\", action, execution FROM fired UNION ALL SELECT job_id, due, 'redeliver', execution FROM again")
def stream_job_timers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What timers of jobs do on a stream of their commands: recovered, delivered again, forgotten."""
    place = _folder(spark)
    with T.with_rocks(spark):
        _in_order(_commands(spark, sf_dir), place, 2, ["at", "seq"], lambda stream: E.run_available(T.watched(stream, silent=4 * HOUR, lost=2 * HOUR, kept=48 * HOUR), f"{place}/out", f"{place}/c"))
    return spark.read.parquet(f"{place}/out").select("job_id", "at", "action", "execution")


@register("""WITH n AS (SELECT event_id, user_id, strftime(ts, '%Y-%m') AS period, row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y-%m') ORDER BY ts, event_id) + CASE WHEN user_id % 3 = 0 THEN 14 ELSE 0 END AS n FROM events)
SELECT event_id AS request_id, user_id AS project_id, period, user_id % 4 = 0 OR n <= 15 AS admitted, CASE WHEN user_id % 4 = 0 THEN n ELSE least(n, 15) END AS used FROM n""")
def stream_usage_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests against monthly limits, judged as they arrive in two batches."""
    from .control_queries import usage_counters

    place = _folder(spark)
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("project_id"), F.col("event_id").alias("request_id"), F.col("ts").alias("at"))
    counters = usage_counters(rows.withColumn("period", C.month_of(rows, "at")))
    counters = stored(counters, "counters")
    sink = U.admission_sink(place, counters)

    def run(stream: DataFrame) -> None:
        stream.writeStream.foreachBatch(sink).trigger(availableNow=True).option("checkpointLocation", f"{place}/c").start().awaitTermination()

    _in_order(rows, place, 2, ["at", "request_id"], run)
    return spark.read.parquet(f"{place}/out").select("request_id", "project_id", "period", "admitted", "used")
