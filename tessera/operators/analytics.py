"""Search analytics over event tables (project, query, result_count, latency_ms, created_at).

Each dashboard question is one scan with conditional aggregates, or one grouped scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .evaluation import nearest_rank

PRIVACY_THRESHOLD = 3
#: Bounds of the latency histogram, in milliseconds.
LATENCY_BOUNDS = (5, 10, 25, 50, 100, 250, 500, 1000, 2500)


def rate(part: F.Column, whole: F.Column) -> F.Column:
    """A share that is 0 of nothing."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def summary(events: DataFrame, clicks: DataFrame, keys: list[str]) -> DataFrame:
    """Searches, mean latency, zero results, clicks, click-through and zero-result rate by ``keys``."""
    s = events.groupBy(*keys).agg(F.count("*").alias("searches"), F.avg("latency_ms").alias("avg_latency"), F.count_if(F.col("result_count") == 0).alias("zero_results"))
    c = clicks.groupBy(*keys).agg(F.count("*").alias("clicks"))
    out = s.join(c, keys, "left") if keys else s.crossJoin(c)
    n = F.coalesce("clicks", F.lit(0))
    return out.select(*keys, "searches", "avg_latency", "zero_results", n.alias("clicks"), rate(n, F.col("searches")).alias("ctr"), rate(F.col("zero_results"), F.col("searches")).alias("zero_rate"))


def day(column: str = "created_at") -> F.Column:
    return F.date_format(column, "yyyy-MM-dd")


def timeline(events: DataFrame, clicks: DataFrame) -> DataFrame:
    """By UTC day with searches: counts, mean latency, zero results and clicks; days with clicks only are absent."""
    s = events.groupBy(day().alias("day")).agg(F.count("*").alias("searches"), F.avg("latency_ms").alias("avg_latency"), F.count_if(F.col("result_count") == 0).alias("zero_results"))
    c = clicks.groupBy(day().alias("day")).agg(F.count("*").alias("clicks"))
    return s.join(c, "day", "left").withColumn("clicks", F.coalesce("clicks", F.lit(0)))


def top_queries(events: DataFrame, k: int = 20, threshold: int = PRIVACY_THRESHOLD) -> DataFrame:
    """The most frequent exact query texts, none that fewer than ``threshold`` searches had."""
    counts = events.groupBy("query").agg(F.count("*").alias("searches"), F.avg("latency_ms").alias("avg_latency"))
    return counts.filter(F.col("searches") >= threshold).orderBy(F.desc("searches"), "query").limit(k)


def bar_heights(rows: DataFrame, metric: str) -> DataFrame:
    """``height``: a metric's percentage of the largest one, between 2 and 100."""
    most = rows.agg(F.greatest(F.max(metric), F.lit(1)).alias("most"))
    share = F.col(metric) * 100.0 / F.col("most")
    return rows.crossJoin(F.broadcast(most)).withColumn("height", F.greatest(F.lit(2.0), F.least(F.lit(100.0), share))).drop("most")  # one row


def quota_status(used: F.Column, limit: F.Column, warn: F.Column) -> F.Column:
    """Only no limit at all is unlimited: a limit of 0 is exceeded from the start."""
    return F.when(limit.isNull(), "unlimited").when(used >= limit, "exceeded").when(quota_percent(used, limit) >= warn, "warning").otherwise("ok")


def quota_percent(used: F.Column, limit: F.Column) -> F.Column:
    """Share of the limit in use, at most 100; null without a limit."""
    return F.when(limit == 0, F.lit(100.0)).when(limit.isNotNull(), F.least(F.lit(100.0), used * 100.0 / F.when(limit != 0, limit)))


def alert_state(used: F.Column, limit: F.Column, warn: F.Column) -> F.Column:
    """What to notify of; limits of 0 and below notify of nothing."""
    s = F.when(limit > 0, quota_status(used, limit, warn))
    return F.when(s.isin("exceeded", "warning"), s).otherwise("none")


def expiry_bucket(expires: F.Column, now: F.Column) -> F.Column:
    """expired (up to a day ago), 1d, 7d or none."""
    left = (F.unix_micros(expires) - F.unix_micros(now)) / 86_400_000_000.0
    return F.when(left < -1, "none").when(left <= 0, "expired").when(left <= 1, "1d").when(left <= 7, "7d").otherwise("none")


def backoff_minutes(attempts: F.Column) -> F.Column:
    return F.least(F.lit(360.0), F.pow(F.lit(2.0), F.greatest(F.lit(1), F.least(F.lit(8), attempts)))).cast("long")


def rate_windows(events: DataFrame, key: str, at: str, limit: int) -> DataFrame:
    """Requests of each key in epoch-aligned minutes, and those over the limit."""
    minute = F.floor(F.unix_seconds(at) / 60).alias("minute")
    return events.groupBy(key, minute).agg(F.count("*").alias("requests")).withColumn("rejected", F.greatest(F.lit(0), F.col("requests") - limit))


def percentiles(events: DataFrame, column: str) -> DataFrame:
    return events.agg(*(nearest_rank(column, p).alias(n) for n, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))), F.max(column).alias("max"))


def latency_histogram(events: DataFrame, keys: list[str], column: str = "latency_ms") -> DataFrame:
    """Cumulative counts by upper bound."""
    bounds = F.array(*(F.struct(F.lit(str(b)).alias("le"), (F.col(column) <= b).alias("inside")) for b in LATENCY_BOUNDS), F.struct(F.lit("+Inf").alias("le"), F.lit(True).alias("inside")))
    rows = events.select(*keys, F.explode(bounds).alias("x"))
    return rows.groupBy(*keys, "x.le").agg(F.count_if(F.col("x.inside")).alias("n"))


def evidence_checks(runs: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """``consistent``: a load run's counts add up and its percentiles and rates agree."""
    ok = (F.col("successes") + F.col("failures") == F.col("requests")) & (F.col("p50") <= F.col("p95")) & (F.col("p95") <= F.col("p99")) & (F.col("p99") <= F.col("max"))
    ok = ok & (F.abs(F.col("error_rate") - F.col("failures") / F.greatest("requests", F.lit(1))) <= tolerance)
    ok = ok & (F.abs(F.col("throughput") - F.col("successes") / F.col("seconds")) <= tolerance * F.greatest(F.lit(1.0), F.col("throughput")))
    return runs.withColumn("consistent", ok)


def project_overview(projects: DataFrame, docs: DataFrame, events: DataFrame, jobs: DataFrame, sources: DataFrame, indexes: DataFrame) -> DataFrame:
    """Live documents of indexes that aren't being deleted, searches, mean latency, zero-result rate, active jobs and live sources; 0 where there are none."""
    zero = F.count_if(F.col("result_count") == 0)
    kept = indexes.filter("deletion_requested_at IS NULL").select("index_id", "project")
    parts = [
        docs.filter("deleted_at IS NULL").join(kept, "index_id").groupBy("project").agg(F.count("*").alias("documents")),
        events.groupBy("project").agg(F.count("*").alias("searches"), F.avg("latency_ms").alias("avg_latency"), rate(zero, F.count("*")).alias("zero_rate")),
        jobs.filter(F.col("state").isin("queued", "running")).groupBy("project").agg(F.count("*").alias("active_jobs")),
        sources.filter("deletion_requested_at IS NULL").groupBy("project").agg(F.count("*").alias("sources")),
    ]
    out = projects
    for part in parts:
        out = out.join(part, "project", "left")
    return out.fillna(0)


def active_versions(indexes: DataFrame, versions: DataFrame) -> DataFrame:
    """Each index that isn't being deleted with its active version's number, documents, bytes and time; nulls where none is active."""
    own = versions.select(F.col("version_id").alias("active_version_id"), "sequence", "document_count", "indexed_bytes", "activated_at")
    kept = indexes.filter("deletion_requested_at IS NULL")
    return kept.join(own, "active_version_id", "left").select("project", "index_id", "name", "sequence", "document_count", "indexed_bytes", "activated_at")
