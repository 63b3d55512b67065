"""Job queue and scheduling steps as pure transformations of job, outbox and schedule tables.

A single writer applies them per tick (see ``streaming.outbox``); row locks of a
transactional queue have no counterpart here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DISPATCH_BATCH = 25
STALE_SECONDS, LOST_SECONDS, RETENTION_DAYS = 120, 30, 7
TERMINAL = ("completed", "failed", "cancelled")
#: Intervals in seconds at which sources may be crawled.
INTERVALS = (3600, 21600, 86400, 604800)


def enqueue(existing: DataFrame, wanted: DataFrame, key: str = "source_id") -> DataFrame:
    """Wanted jobs that coalesce onto no queued or running job of the same key; one per key."""
    busy = existing.filter(F.col("state").isin("queued", "running")).select(key)
    return wanted.dropDuplicates([key]).join(busy, key, "left_anti")


def to_dispatch(outbox: DataFrame, k: int = DISPATCH_BATCH) -> DataFrame:
    """The next entries to deliver, oldest first; those of jobs that can't run any more are among them and only marked."""
    return outbox.filter(F.col("dispatched_at").isNull()).orderBy("created_at", "job_id").limit(k)


def _before(at: str, now: Column, seconds: int) -> Column:
    return F.unix_micros(at) <= F.unix_micros(now) - seconds * 1_000_000


def old_entries(outbox: DataFrame, now: Column, seconds: int = LOST_SECONDS) -> DataFrame:
    """Delivered entries that weren't touched for a while."""
    return outbox.filter(F.col("dispatched_at").isNotNull() & _before("updated_at", now, seconds))


def lost(outbox: DataFrame, jobs: DataFrame, now: Column, seconds: int = LOST_SECONDS, k: int | None = None) -> DataFrame:
    """Deliveries to look at: not touched for a while, of jobs still queued that nobody asked to cancel.

    All of them, or the ``k`` longest untouched, the longest first.  Whoever looks at them sets
    ``updated_at``, also where nothing is wrong, so the next look takes others.
    """
    old = old_entries(outbox, now, seconds)
    waiting = jobs.filter("state = 'queued' AND NOT cancel_requested").select("job_id")
    found = old.join(waiting, "job_id", "left_semi")
    return found if k is None else found.orderBy("updated_at", "job_id").limit(k)


def execution(now: Column) -> Column:
    """The id of an execution begun at ``now``: the same when a failed tick is repeated."""
    return F.sha2(F.concat_ws(":", "job_id", F.unix_seconds(now).cast("string")), 256)


def stale(jobs: DataFrame, now: Column, seconds: int = STALE_SECONDS, k: int | None = None) -> DataFrame:
    """Running crawls and index builds without a heartbeat, to be queued anew under a new execution id.

    Jobs that were asked to cancel are left to their worker.  All of them, or the ``k`` longest silent.
    """
    old = jobs.filter("state = 'running' AND NOT cancel_requested").filter(F.col("type").isin("crawl", "index") & _before("updated_at", now, seconds))
    first = old if k is None else old.orderBy("updated_at", "job_id").limit(k)
    return first.withColumns({"state": F.lit("queued"), "execution_id": execution(now), "updated_at": now})


def ended(jobs: DataFrame, now: Column, days: int = RETENTION_DAYS) -> DataFrame:
    """(job_id, finished_at) of jobs that ended long ago."""
    return jobs.filter(F.col("state").isin(*TERMINAL) & _before("finished_at", now, days * 86400)).select("job_id", "finished_at")


def ended_entries(outbox: DataFrame, jobs: DataFrame, now: Column, days: int = RETENTION_DAYS, k: int | None = None) -> DataFrame:
    """Delivered entries of jobs that ended long ago, the longest first."""
    gone = outbox.filter(F.col("dispatched_at").isNotNull()).join(ended(jobs, now, days), "job_id").orderBy("finished_at", "job_id")
    return (gone if k is None else gone.limit(k)).select("job_id")


def purged(outbox: DataFrame, jobs: DataFrame, now: Column, days: int = RETENTION_DAYS) -> DataFrame:
    """The outbox without deliveries of jobs that ended long ago."""
    return outbox.join(ended_entries(outbox, jobs, now, days), "job_id", "left_anti")


def due_schedules(schedules: DataFrame, sources: DataFrame, now: Column) -> DataFrame:
    """Enabled schedules of live sources that are due, with the next run one interval from now."""
    live = sources.filter("enabled AND deletion_requested_at IS NULL").select("source_id")
    due = schedules.filter(F.col("enabled") & (F.col("next_run_at") <= now)).join(live, "source_id", "left_semi")
    return due.withColumn("next_run_at", F.timestamp_seconds(F.unix_seconds(now) + F.col("interval_seconds")))


def due_retries(retries: DataFrame, now: Column, k: int | None = None) -> DataFrame:
    due = retries.filter(F.col("retry_at") <= now).orderBy("retry_at", "normalized_url")
    return due if k is None else due.limit(k)


def transition(jobs: DataFrame, action: str) -> DataFrame:
    """``next_state`` after ``retry`` or ``cancel``; null where the action isn't allowed."""
    s = F.col("state")
    if action == "retry":
        nxt = F.when(s.isin("failed", "cancelled"), "queued")
    elif action == "cancel":
        nxt = F.when(s == "queued", "cancelled").when(s == "running", "running")
    else:
        raise ValueError(action)
    out = jobs.withColumn("next_state", nxt)
    return out.withColumn("cancel_requested", (F.lit(action == "cancel") & (s == "running")))


def run_verdicts(jobs: DataFrame, runs: DataFrame) -> DataFrame:
    """What a worker (``runs``: job_id, execution_id) may do with its job.

    ``claim``: the execution is current, the job queued or failed and not cancelled;
    ``heartbeat``: it is running; ``fenced``: another execution has replaced this one.
    """
    both = runs.join(jobs.select("job_id", "state", "cancel_requested", F.col("execution_id").alias("current")), "job_id", "left")
    own = F.col("current").eqNullSafe(F.col("execution_id")) & F.col("current").isNotNull()
    going = own & ~F.col("cancel_requested")
    return both.select(
        "job_id",
        "execution_id",
        F.coalesce(going & F.col("state").isin("queued", "failed"), F.lit(False)).alias("claim"),
        F.coalesce(going & (F.col("state") == "running"), F.lit(False)).alias("heartbeat"),
        F.coalesce(~own, F.lit(True)).alias("fenced"),
    )


def finish_cancelled(jobs: DataFrame) -> DataFrame:
    """Jobs with those that were asked to stop while queued or running now cancelled."""
    stop = F.col("cancel_requested") & F.col("state").isin("queued", "running")
    return jobs.withColumn("state", F.when(stop, "cancelled").otherwise(F.col("state")))


def deferred(retries: DataFrame, put: DataFrame, cleared: DataFrame) -> DataFrame:
    """Deferred retries after upserts and clearings; the key is (source_id, normalized_url), the last write wins."""
    key = ["source_id", "normalized_url"]
    last = latest_upsert(put, key, ["updated_at"])
    return retries.join(last.select(*key), key, "left_anti").unionByName(last).join(cleared.select(*key), key, "left_anti")


def dead_letters(jobs: DataFrame, outbox: DataFrame) -> DataFrame:
    """Failed jobs with what is known of their delivery."""
    failed = jobs.filter("state = 'failed'").join(outbox.select("job_id", "n_lines"), "job_id", "left")
    return failed.withColumn("retryable", F.col("n_lines").isNotNull())


def latest_upsert(rows: DataFrame, key: list[str], at: list[str]) -> DataFrame:
    """Last write of each key."""
    last = Window.partitionBy(*key).orderBy(*(F.desc(c) for c in at))
    return rows.withColumn("__n", F.row_number().over(last)).filter("__n = 1").drop("__n")
