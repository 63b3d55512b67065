"""The queue's tick: six steps, each on what the one before left.

``Queue`` holds the tables as they are: jobs (job_id, type, source_id, state, execution_id,
cancel_requested, updated_at, finished_at), outbox (job_id, created_at, dispatched_at,
updated_at), schedules (source_id, enabled, interval_seconds, next_run_at), sources
(source_id, enabled, deletion_requested_at), retries (source_id, retry_at), delivered
(execution_id: what the broker still holds) and held (job_id: executions whose lock is taken).

A step picks a bounded number of rows, the oldest first.  Where they depend on a second table,
the first ``AHEAD`` times as many are looked up there by broadcast, so large tables are read but not
shuffled; only if too few of these pass are the tables joined whole.  Picks are written once and joined
to the tables by broadcast, since their number is the step's limit; so the plan of a table
grows by one join for each step and not by itself.  New ids are hashes of what they stand
for and the tick's time: a tick that is repeated over the same tables makes the same rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import checkpointed, stored
from . import jobs as J

STEP_LIMIT, PURGE_LIMIT = 25, 250
AHEAD = 8
TABLES = ("jobs", "outbox", "schedules", "sources", "retries", "delivered", "held")


@dataclass(frozen=True)
class Queue:
    jobs: DataFrame
    outbox: DataFrame
    schedules: DataFrame
    sources: DataFrame
    retries: DataFrame
    delivered: DataFrame
    held: DataFrame


def cut(q: Queue) -> Queue:
    """The queue with the tables that a tick changes written and read again, so plans don't grow from tick to tick."""
    return replace(q, **{name: stored(getattr(q, name), name) for name in ("jobs", "outbox", "schedules", "delivered")})


def _among(df: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """The rows of ``df`` that have a key of ``few``, which is small."""
    return df.join(F.broadcast(few.select(key)), key, "left_semi")


def _first(rows: DataFrame, order: list[str], passing: Callable[[DataFrame, bool], DataFrame], k: int) -> DataFrame:
    """The first ``k`` that ``passing`` leaves of ``rows``, which it is given in part, with True, or whole."""
    head = checkpointed(rows.orderBy(*order).limit(AHEAD * k))
    picked = checkpointed(passing(head, True).orderBy(*order).limit(k))
    if picked.count() == k or head.count() < AHEAD * k:
        return picked
    return checkpointed(passing(rows, False).orderBy(*order).limit(k))


def _live(sources: DataFrame) -> DataFrame:
    return sources.filter("enabled AND deletion_requested_at IS NULL").select("source_id")


def _update(df: DataFrame, picked: DataFrame, key: str, **new: Column) -> DataFrame:
    """``df`` with columns set in the rows of ``picked`` (a step's few rows, and the new values may use its columns)."""
    few = F.broadcast(picked.select(key, F.struct(*picked.columns).alias("__pick")))
    out = df.join(few, key, "left")
    hit = F.col("__pick").isNotNull()
    return out.select(*(F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in df.columns))


def _enqueued(q: Queue, wanted: DataFrame, now: Column) -> Queue:
    """Queues a crawl for each wanted source (a few distinct ones) that has none queued or running."""
    busy = q.jobs.filter("type = 'crawl'").filter(F.col("state").isin("queued", "running")).join(F.broadcast(wanted), "source_id", "left_semi")
    at = F.unix_seconds(now).cast("string")
    new = wanted.join(busy.select("source_id"), "source_id", "left_anti").select("source_id", F.sha2(F.concat_ws(":", F.lit("crawl"), "source_id", at), 256).alias("job_id"))
    new = checkpointed(new)
    none = F.lit(None).cast("timestamp")
    job = new.select("job_id", F.lit("crawl").alias("type"), "source_id", F.lit("queued").alias("state"), J.execution(now).alias("execution_id"), F.lit(False).alias("cancel_requested"), now.alias("updated_at"), none.alias("finished_at"))
    entry = new.select("job_id", now.alias("created_at"), none.alias("dispatched_at"), now.alias("updated_at"))
    return replace(q, jobs=q.jobs.select(*job.columns).unionByName(job), outbox=q.outbox.select(*entry.columns).unionByName(entry))


def deferred(q: Queue, now: Column, k: int = STEP_LIMIT) -> Queue:
    """Crawls for live sources with retries that are due: of the ``k`` longest due retries, each source once."""
    due = q.retries.filter(F.col("retry_at") <= now).join(_live(q.sources), "source_id", "left_semi").orderBy("retry_at", "source_id").limit(k)
    return _enqueued(q, checkpointed(due.select("source_id").distinct()), now)


def schedule(q: Queue, now: Column, k: int = STEP_LIMIT) -> Queue:
    """Crawls for live sources whose schedule is due.  A schedule of a source that isn't live moves on too; runs missed meanwhile count as one."""
    due = checkpointed(q.schedules.filter(F.col("enabled") & (F.col("next_run_at") <= now)).orderBy("next_run_at", "source_id").limit(k).select("source_id"))
    on = _update(q.schedules, due, "source_id", next_run_at=F.timestamp_seconds(F.unix_seconds(now) + F.col("interval_seconds")))
    return _enqueued(replace(q, schedules=on), due.join(_among(_live(q.sources), due, "source_id"), "source_id", "left_semi"), now)


def recover(q: Queue, now: Column, k: int = STEP_LIMIT) -> Queue:
    """Stale running jobs queued anew and undelivered, but for those whose lock is still held."""
    old = J.stale(q.jobs.withColumn("since", F.col("updated_at")), now).select("job_id", "execution_id", "since")
    entries = q.outbox.select("job_id")
    old = _first(old, ["since", "job_id"], lambda rows, few: rows.join(_among(entries, rows, "job_id") if few else entries, "job_id", "left_semi"), k)
    picked = checkpointed(old.join(_among(q.held, old, "job_id"), "job_id", "left_anti").select("job_id", "execution_id"))
    jobs = _update(q.jobs, picked, "job_id", state=F.lit("queued"), execution_id=F.col("__pick.execution_id"), updated_at=now, finished_at=F.lit(None).cast("timestamp"))
    return replace(q, jobs=jobs, outbox=_update(q.outbox, picked, "job_id", dispatched_at=F.lit(None).cast("timestamp"), updated_at=now))


def dispatch(q: Queue, now: Column, k: int = STEP_LIMIT) -> tuple[Queue, DataFrame]:
    """Delivers undelivered entries; those of jobs that ended or were asked to cancel are marked without being sent."""
    picked = checkpointed(J.to_dispatch(q.outbox, k).select("job_id"))
    waiting = q.jobs.filter("state = 'queued' AND NOT cancel_requested")
    sent = checkpointed(waiting.join(F.broadcast(picked), "job_id", "left_semi").select("job_id", "execution_id"))
    return _delivered(replace(q, outbox=_update(q.outbox, picked, "job_id", dispatched_at=now, updated_at=now)), sent), sent


def reconcile(q: Queue, now: Column, k: int = STEP_LIMIT) -> tuple[Queue, DataFrame]:
    """Sends again what the broker no longer holds.  All entries looked at go to the back of the line."""
    old = J.old_entries(q.outbox, now).select("job_id", "dispatched_at", "updated_at")
    picked = _first(old, ["updated_at", "job_id"], lambda rows, few: J.lost(rows, _among(q.jobs, rows, "job_id") if few else q.jobs, now), k).select("job_id")
    looked = checkpointed(_among(q.jobs, picked, "job_id").select("job_id", "execution_id"))
    sent = checkpointed(looked.join(_among(q.delivered, looked, "execution_id"), "execution_id", "left_anti").select("job_id", "execution_id"))
    return _delivered(replace(q, outbox=_update(q.outbox, picked, "job_id", updated_at=now)), sent), sent


def _delivered(q: Queue, sent: DataFrame) -> Queue:
    fresh = sent.select("execution_id").join(_among(q.delivered, sent, "execution_id"), "execution_id", "left_anti")
    return replace(q, delivered=q.delivered.select("execution_id").unionByName(fresh))


def purge(q: Queue, now: Column, k: int = PURGE_LIMIT) -> Queue:
    """Drops delivered entries of jobs that ended a week ago."""
    sent = q.outbox.filter(F.col("dispatched_at").isNotNull()).select("job_id")
    ended = J.ended(q.jobs, now)
    picked = _first(ended, ["finished_at", "job_id"], lambda rows, few: (_among(sent, rows, "job_id") if few else sent).join(rows, "job_id"), k).select("job_id")
    return replace(q, outbox=q.outbox.join(F.broadcast(picked), "job_id", "left_anti"))


def tick(q: Queue, now: Column, purging: bool = True) -> tuple[Queue, DataFrame]:
    """The queue after one tick, and what it sent: job_id, execution_id, step."""
    q = recover(schedule(deferred(q, now), now), now)
    q, first = dispatch(q, now)
    q, again = reconcile(q, now)
    if purging:
        q = purge(q, now)
    return q, first.withColumn("step", F.lit("dispatch")).unionByName(again.withColumn("step", F.lit("reconcile")))


#: Changes of a job by one command; ``s`` is the job as it is, ``c`` the command.
_NEXT = """named_struct(
  'state', CASE WHEN c.kind = 'start' AND s.own AND NOT s.cancel AND s.state IN ('queued', 'failed') THEN 'running'
    WHEN c.kind IN ('complete', 'fail') AND s.own AND s.state = 'running' THEN CASE WHEN s.cancel THEN 'cancelled' WHEN c.kind = 'fail' THEN 'failed' ELSE 'completed' END
    WHEN c.kind = 'cancel' AND s.state = 'queued' THEN 'cancelled' ELSE s.state END,
  'cancel', s.cancel OR (c.kind = 'cancel' AND s.state = 'running'),
  'at', CASE WHEN (c.kind = 'start' AND s.own AND NOT s.cancel AND s.state IN ('queued', 'failed')) OR (c.kind = 'beat' AND s.own AND NOT s.cancel AND s.state = 'running')
    OR (c.kind IN ('complete', 'fail') AND s.own AND s.state = 'running') OR (c.kind = 'cancel' AND s.state IN ('queued', 'running')) THEN c.at ELSE s.at END,
  'finished', CASE WHEN (c.kind IN ('complete', 'fail') AND s.own AND s.state = 'running') OR (c.kind = 'cancel' AND s.state = 'queued') THEN c.at
    WHEN c.kind = 'start' AND s.own AND NOT s.cancel AND s.state = 'failed' THEN NULL ELSE s.finished END)"""


def commanded(jobs: DataFrame, commands: DataFrame) -> DataFrame:
    """Jobs after commands (job_id, execution_id, kind, at), each job's own in order of time.

    ``start``, ``beat``, ``complete`` and ``fail`` count only from the current execution, so a
    worker that was replaced changes nothing; ``cancel`` ends a queued job and asks a running one.
    A job's commands of one batch are folded over in one row.
    """
    rank = F.expr("array_position(array('start', 'beat', 'complete', 'fail', 'cancel'), kind)")
    own = commands.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("at", rank.alias("rank"), "kind", F.col("execution_id").alias("run")))).alias("__c"))
    both = jobs.join(own, "job_id", "left")
    start = "named_struct('state', state, 'cancel', cancel_requested, 'at', updated_at, 'finished', finished_at)"
    step = _NEXT.replace("s.own", "c.run <=> execution_id")
    both = both.withColumn("__s", F.expr(f"CASE WHEN __c IS NOT NULL THEN aggregate(__c, {start}, (s, c) -> {step}) ELSE {start} END"))
    new = {"state": "__s.state", "cancel_requested": "__s.cancel", "updated_at": "__s.at", "finished_at": "__s.finished"}
    return both.select(*(F.col(new.get(c, c)).alias(c) for c in jobs.columns))
