"""Queries for search analytics, logs, quotas, notifications and load figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analytics as A
from ..operators import jobs as J
from .common import EVENTS_SQL, Registry, plain_time, search_events, table

register = Registry()
EV = f"WITH {EVENTS_SQL} "
#: Windows are anchored at a fixed moment behind the events.
NOW = "2024-01-31 00:00:00"


def _ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_events(spark, sf_dir)


def _last(df: DataFrame, days: int) -> DataFrame:
    return df.filter((F.col("created_at") >= F.lit(NOW).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS")) & (F.col("created_at") < F.lit(NOW).cast("timestamp")))


def _clicks(df: DataFrame) -> DataFrame:
    return df.filter("event_type = 'click'")


@register(EV + "SELECT project, count(*) AS searches, round(avg(latency_ms), 6) AS avg_latency, count(*) FILTER (WHERE result_count = 0) AS zero_results, round(count(*) FILTER (WHERE result_count = 0) / count(*), 6) AS zero_rate, count(DISTINCT user_id) AS users FROM ev GROUP BY project")
def kpi_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    zero = F.count_if(F.col("result_count") == 0)
    return _ev(spark, sf_dir).groupBy("project").agg(F.count("*").alias("searches"), F.round(F.avg("latency_ms"), 6).alias("avg_latency"), zero.alias("zero_results"), F.round(A.rate(zero, F.count("*")), 6).alias("zero_rate"), F.countDistinct("user_id").alias("users"))


_SUMMARY = """SELECT {d} AS days, count(*) AS searches, round(avg(latency_ms), 6) AS avg_latency, count(*) FILTER (WHERE result_count = 0) AS zero_results, count(*) FILTER (WHERE event_type = 'click') AS clicks,
round(count(*) FILTER (WHERE event_type = 'click') / count(*), 6) AS ctr, round(count(*) FILTER (WHERE result_count = 0) / count(*), 6) AS zero_rate FROM ev WHERE created_at >= TIMESTAMP '2024-01-31' - INTERVAL {d} DAY AND created_at < TIMESTAMP '2024-01-31'"""


@register(EV + " UNION ALL ".join(_SUMMARY.format(d=d) for d in (7, 30, 90)))
def analytics_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _ev(spark, sf_dir)
    spans = F.explode(F.filter(F.array(*(F.lit(d) for d in (7, 30, 90))), lambda d: F.unix_micros("created_at") >= F.unix_micros(F.lit(NOW).cast("timestamp")) - d.cast("long") * 86_400_000_000))
    rows = ev.filter(F.col("created_at") < F.lit(NOW).cast("timestamp")).select("*", spans.alias("days"))
    s = A.summary(rows, _clicks(rows), ["days"])
    return s.select("days", "searches", F.round("avg_latency", 6).alias("avg_latency"), "zero_results", "clicks", F.round("ctr", 6).alias("ctr"), F.round("zero_rate", 6).alias("zero_rate"))


_TIMELINE = """tl AS (SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS searches, avg(latency_ms) AS avg_latency, count(*) FILTER (WHERE result_count = 0) AS zero_results, count(*) FILTER (WHERE event_type = 'click') AS clicks FROM ev WHERE created_at >= TIMESTAMP '2024-01-01' AND created_at < TIMESTAMP '2024-01-31' GROUP BY 1)"""


@register(f"WITH {EVENTS_SQL}, {_TIMELINE} SELECT day, searches, round(avg_latency, 6) AS avg_latency, zero_results, clicks FROM tl")
def analytics_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _last(_ev(spark, sf_dir), 30)
    return A.timeline(ev, _clicks(ev)).withColumn("avg_latency", F.round("avg_latency", 6))


@register(f"WITH {EVENTS_SQL}, {_TIMELINE} SELECT day, searches, round(greatest(2.0, least(100.0, searches * 100.0 / greatest(1, max(searches) OVER ()))), 6) AS height FROM tl")
def bar_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _last(_ev(spark, sf_dir), 30)
    return A.bar_heights(A.timeline(ev, _clicks(ev)).select("day", "searches"), "searches").select("day", "searches", F.round("height", 6).alias("height"))


@register(EV + "SELECT query, count(*) AS searches, round(avg(latency_ms), 6) AS avg_latency FROM ev GROUP BY query HAVING count(*) >= 3 ORDER BY searches DESC, query LIMIT 20")
def top_queries_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.top_queries(_ev(spark, sf_dir)).withColumn("avg_latency", F.round("avg_latency", 6))


@register(EV + "SELECT query, count(*) AS searches, round(avg(latency_ms), 6) AS avg_latency FROM ev WHERE result_count = 0 GROUP BY query HAVING count(*) >= 3 ORDER BY searches DESC, query LIMIT 20")
def zero_result_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.top_queries(_ev(spark, sf_dir).filter("result_count = 0")).withColumn("avg_latency", F.round("avg_latency", 6))


_JOBS = "jobs AS (SELECT o_orderkey AS job_id, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'completed' ELSE 'running' END AS state, o_orderdate AS created_at, o_custkey AS source_id, o_totalprice AS cost FROM orders), outbox AS (SELECT l_orderkey AS job_id, count(*) AS n_lines, min(l_shipdate) AS dispatched_at FROM lineitem GROUP BY l_orderkey)"


def jobs_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "completed").otherwise("running")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), state.alias("state"), F.col("o_orderdate").cast("timestamp").alias("created_at"), F.col("o_custkey").alias("source_id"), F.col("o_totalprice").alias("cost"))


def outbox_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("job_id")).agg(F.count("*").alias("n_lines"), F.min("l_shipdate").cast("timestamp").alias("dispatched_at"))


@register(
    f"WITH {EVENTS_SQL}, {_JOBS}, "
    + """a AS (SELECT 'audit' AS origin, event_id AS id, created_at AS logged_at, CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS level, query AS message FROM ev ORDER BY created_at DESC, event_id DESC LIMIT 200),
b AS (SELECT 'job', job_id, created_at, CASE WHEN state = 'failed' THEN 'error' ELSE 'info' END, state FROM jobs ORDER BY created_at DESC, job_id DESC LIMIT 200)
SELECT * FROM (SELECT * FROM a UNION ALL SELECT * FROM b) u WHERE level = 'error' ORDER BY logged_at DESC, origin, id DESC LIMIT 100"""
)
def developer_logs_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source is limited before the level filter."""
    level = lambda c: F.when(c, "error").otherwise("info").alias("level")
    a = _ev(spark, sf_dir).orderBy(F.desc("created_at"), F.desc("event_id")).limit(200).select(F.lit("audit").alias("origin"), F.col("event_id").alias("id"), F.col("created_at").alias("logged_at"), level(F.col("event_type") == "error"), F.col("query").alias("message"))
    b = jobs_table(spark, sf_dir).orderBy(F.desc("created_at"), F.desc("job_id")).limit(200).select(F.lit("job").alias("origin"), F.col("job_id").alias("id"), F.col("created_at").alias("logged_at"), level(F.col("state") == "failed"), F.col("state").alias("message"))
    return plain_time(a.unionByName(b).filter("level = 'error'").orderBy(F.desc("logged_at"), "origin", F.desc("id")).limit(100), "logged_at")


@register(f"WITH {_JOBS} SELECT j.job_id, n_lines, n_lines IS NOT NULL AS retryable FROM jobs j LEFT JOIN outbox o ON o.job_id = j.job_id WHERE state = 'failed'")
def dead_letter_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.dead_letters(jobs_table(spark, sf_dir), outbox_table(spark, sf_dir)).select("job_id", "n_lines", "retryable")


@register("SELECT count(*) AS jobs FROM orders o WHERE EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_acctbal > 0)")
def live_source_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").join(live, "o_custkey", "left_semi").agg(F.count("*").alias("jobs"))


@register("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY l_orderkey")
def erase_by_event_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf_dir, "lineitem").join(gone, "l_orderkey", "left_anti").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@register("SELECT r_name, n_name, count(*) AS members, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name")
def membership_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    return c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).groupBy("r_name", "n_name").agg(F.count("*").alias("members"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


_USE = "use AS (SELECT c_custkey AS project_id, c_nationkey, CAST(greatest(0, floor(c_acctbal / 500)) AS BIGINT) AS quota, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS used FROM customer)"


def _usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotas derived from balances, beside the number of each project's documents: counted once, then joined."""
    used = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("project_id")).agg(F.count("*").alias("used"))
    own = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("project_id"), "c_nationkey", F.greatest(F.lit(0), F.floor(F.col("c_acctbal") / 500)).cast("long").alias("quota"))
    return own.join(used, "project_id", "left").withColumn("used", F.coalesce("used", F.lit(0).cast("long")))


_STATUS = "CASE WHEN quota <= 0 THEN 'none' WHEN used >= quota THEN 'exceeded' WHEN used * 100.0 / quota >= 80 THEN 'warning' ELSE 'none' END"


@register(
    f"""WITH {_USE}, lim AS (SELECT project_id, used, CASE WHEN project_id % 5 <> 0 THEN quota END AS quota FROM use)
SELECT project_id, quota, used, CASE WHEN quota IS NULL THEN 'unlimited' WHEN used >= quota THEN 'exceeded' WHEN (CASE WHEN quota = 0 THEN 100 ELSE least(100, used / quota * 100) END) >= 80 THEN 'warning' ELSE 'ok' END AS status,
CASE WHEN quota IS NULL THEN NULL WHEN quota = 0 THEN 100.0 ELSE round(least(100.0, used * 100.0 / quota), 4) END AS percent FROM lim"""
)
def quota_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One project in five has no limit; many have a limit of 0."""
    use = _usage(spark, sf_dir).withColumn("quota", F.when(F.col("project_id") % 5 != 0, F.col("quota")))
    return use.select("project_id", "quota", "used", A.quota_status(F.col("used"), F.col("quota"), F.lit(80)).alias("status"), F.round(A.quota_percent(F.col("used"), F.col("quota")), 4).alias("percent"))


@register(f"WITH {_USE} SELECT project_id, n_name, {_STATUS} AS state, concat('quota:2024-01:', CAST(project_id AS VARCHAR), ':documents:', {_STATUS}) AS dedupe_key FROM use JOIN nation ON c_nationkey = n_nationkey WHERE {_STATUS} IN ('warning', 'exceeded')")
def quota_alert_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    use = _usage(spark, sf_dir).withColumn("state", A.alert_state(F.col("used"), F.col("quota"), F.lit(80))).filter("state <> 'none'")
    return use.join(n, use.c_nationkey == n.n_nationkey).select("project_id", "n_name", "state", F.concat(F.lit("quota:2024-01:"), F.col("project_id").cast("string"), F.lit(":documents:"), "state").alias("dedupe_key"))


_LEFT = "(epoch_us(TIMESTAMP '1998-06-01') - epoch_us(o_orderdate)) / -86400000000.0"


@register(f"SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN d < -1 THEN 'none' WHEN d <= 0 THEN 'expired' WHEN d <= 1 THEN '1d' WHEN d <= 7 THEN '7d' ELSE 'none' END AS bucket FROM (SELECT {_LEFT} AS d FROM orders) x) y GROUP BY bucket")
def key_expiry_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = A.expiry_bucket(F.col("o_orderdate").cast("timestamp"), F.lit("1998-06-01").cast("timestamp"))
    return table(spark, sf_dir, "orders").groupBy(b.alias("bucket")).agg(F.count("*").alias("n"))


@register(EV + "SELECT project, strftime(created_at, '%Y-%m') AS period, count(*) AS searches, count(*) FILTER (WHERE event_type = 'view') AS crawl_pages FROM ev GROUP BY 1, 2")
def monthly_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ev(spark, sf_dir).groupBy("project", F.date_format("created_at", "yyyy-MM").alias("period")).agg(F.count("*").alias("searches"), F.count_if(F.col("event_type") == "view").alias("crawl_pages"))


@register(EV + "SELECT project, CAST(floor(epoch_us(created_at) / 60000000.0) AS BIGINT) AS minute, count(*) AS requests, CAST(greatest(0, count(*) - 1) AS BIGINT) AS rejected FROM ev GROUP BY 1, 2")
def rate_limit_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.rate_windows(_ev(spark, sf_dir), "project", "created_at", 1).withColumn("rejected", F.col("rejected").cast("long"))


@register(EV + "SELECT quantile_disc(latency_ms, 0.5) AS p50, quantile_disc(latency_ms, 0.95) AS p95, quantile_disc(latency_ms, 0.99) AS p99, max(latency_ms) AS max FROM ev")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.percentiles(_ev(spark, sf_dir), "latency_ms")


@register(EV + "SELECT event_type, le, count(*) FILTER (WHERE le = '+Inf' OR latency_ms <= TRY_CAST(le AS DOUBLE)) AS n FROM ev, (VALUES ('5'), ('10'), ('25'), ('50'), ('100'), ('250'), ('500'), ('1000'), ('2500'), ('+Inf')) b(le) GROUP BY event_type, le")
def latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.latency_histogram(_ev(spark, sf_dir), ["event_type"])


@register(EV + "SELECT event_type AS status, count(*) AS requests, round(count(*) / (epoch_us(max(created_at)) - epoch_us(min(created_at))) * 1000000.0, 9) AS per_second FROM ev GROUP BY event_type")
def throughput_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = (F.max(F.unix_micros("created_at")) - F.min(F.unix_micros("created_at"))).cast("double")
    return _ev(spark, sf_dir).groupBy(F.col("event_type").alias("status")).agg(F.count("*").alias("requests"), F.round(F.count("*") / span * 1000000.0, 9).alias("per_second"))


@register("SELECT o_orderkey, CAST(least(360, pow(2, greatest(1, least(8, o_orderkey % 12)))) AS BIGINT) AS minutes FROM orders")
def delivery_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", A.backoff_minutes(F.col("o_orderkey") % 12).alias("minutes"))


@register(EV + "SELECT user_id, event_id, query, created_at FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, event_id DESC) AS n FROM ev) x WHERE n = 1")
def latest_event_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain_time(J.latest_upsert(_ev(spark, sf_dir), ["user_id"], ["created_at", "event_id"]).select("user_id", "event_id", "query", "created_at"), "created_at")


@register(EV + ", s AS (SELECT event_id, project, query FROM ev WHERE event_type <> 'click'), c AS (SELECT event_id - 1 AS search_event_id, event_id AS click_id, project, query FROM ev WHERE event_type = 'click') SELECT click_id, CASE WHEN s.event_id IS NULL THEN 'unknown' WHEN s.project <> c.project THEN 'unknown' WHEN s.query <> c.query THEN 'mismatch' ELSE 'ok' END AS verdict FROM c LEFT JOIN s ON s.event_id = c.search_event_id")
def click_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A click must name a search of its own project with the same query."""
    ev = _ev(spark, sf_dir)
    s = ev.filter("event_type <> 'click'").select(F.col("event_id").alias("search_id"), F.col("project").alias("p"), F.col("query").alias("q"))
    c = _clicks(ev).select((F.col("event_id") - 1).alias("search_id"), F.col("event_id").alias("click_id"), "project", "query")
    verdict = F.when(F.col("p").isNull() | (F.col("p") != F.col("project")), "unknown").when(F.col("q") != F.col("query"), "mismatch").otherwise("ok")
    return c.join(s, "search_id", "left").select("click_id", verdict.alias("verdict"))


@register(f"WITH {_JOBS} SELECT source_id, job_id FROM (SELECT source_id, job_id, row_number() OVER (PARTITION BY source_id ORDER BY created_at, job_id) AS n FROM jobs WHERE state <> 'running' AND source_id NOT IN (SELECT source_id FROM jobs WHERE state = 'running')) x WHERE n = 1")
def enqueue_coalesced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first job of each source that has none running."""
    jobs = jobs_table(spark, sf_dir)
    first = jobs.filter("state <> 'running'").groupBy("source_id").agg(F.min_by("job_id", F.struct("created_at", "job_id")).alias("job_id"))
    return J.enqueue(jobs, first).select("source_id", "job_id")


@register(f"WITH {_JOBS} SELECT o.job_id, o.dispatched_at FROM outbox o ORDER BY dispatched_at, job_id LIMIT 25")
def dispatch_oldest(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = outbox_table(spark, sf_dir).withColumnRenamed("dispatched_at", "created_at").withColumn("dispatched_at", F.lit(None).cast("timestamp"))
    return plain_time(J.to_dispatch(box).select("job_id", F.col("created_at").alias("dispatched_at")), "dispatched_at")


@register(f"WITH {_JOBS} SELECT o.job_id FROM outbox o JOIN jobs j ON j.job_id = o.job_id WHERE state = 'running' AND o.job_id % 6 <> 0 AND epoch_us(dispatched_at) <= epoch_us(TIMESTAMP '1998-01-01') - 30000000")
def reconcile_lost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One job in six was asked to cancel."""
    jobs = jobs_table(spark, sf_dir).withColumns({"state": F.when(F.col("state") == "running", "queued").otherwise(F.col("state")), "cancel_requested": F.col("job_id") % 6 == 0})
    return J.lost(outbox_table(spark, sf_dir).withColumn("updated_at", F.col("dispatched_at")), jobs, F.lit("1998-01-01").cast("timestamp")).select("job_id")


@register(f"WITH {_JOBS} SELECT job_id FROM jobs WHERE state = 'running' AND job_id % 6 <> 0 AND job_id % 5 <> 0 AND epoch_us(created_at) <= epoch_us(TIMESTAMP '1997-01-01') - 120000000")
def recover_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One job in six was asked to cancel, and one in five is of another kind."""
    jobs = jobs_table(spark, sf_dir).withColumns({"updated_at": F.col("created_at"), "cancel_requested": F.col("job_id") % 6 == 0, "type": F.when(F.col("job_id") % 5 == 0, "cleanup").otherwise("crawl")})
    return J.stale(jobs, F.lit("1997-01-01").cast("timestamp")).select("job_id")


@register(f"WITH {_JOBS} SELECT job_id, n_lines FROM outbox WHERE job_id NOT IN (SELECT job_id FROM jobs WHERE state IN ('failed', 'completed') AND epoch_us(created_at) <= epoch_us(TIMESTAMP '1998-01-01') - 7 * 86400000000)")
def purge_outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = jobs_table(spark, sf_dir).withColumn("finished_at", F.col("created_at"))
    return J.purged(outbox_table(spark, sf_dir), jobs, F.lit("1998-01-01").cast("timestamp")).select("job_id", "n_lines")


@register("SELECT c_custkey AS source_id, epoch_us(TIMESTAMP '2024-01-31') + 21600000000 AS next_run FROM customer WHERE c_acctbal > 0 AND c_custkey % 3 = 0")
def schedule_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    sources = c.select(F.col("c_custkey").alias("source_id"), (F.col("c_acctbal") > 0).alias("enabled"), F.lit(None).cast("timestamp").alias("deletion_requested_at"))
    due = F.when(F.col("c_custkey") % 3 == 0, F.lit("2024-01-30")).otherwise(F.lit("2024-02-28")).cast("timestamp")
    plans = c.select(F.col("c_custkey").alias("source_id"), F.lit(True).alias("enabled"), F.lit(21600).alias("interval_seconds"), due.alias("next_run_at"))
    return J.due_schedules(plans, sources, F.lit(NOW).cast("timestamp")).select("source_id", F.unix_micros("next_run_at").alias("next_run"))


@register(f"WITH {_JOBS} SELECT job_id, state, CASE WHEN state IN ('failed', 'cancelled') THEN 'queued' END AS next_state FROM jobs")
def job_retry_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.transition(jobs_table(spark, sf_dir), "retry").select("job_id", "state", "next_state")
