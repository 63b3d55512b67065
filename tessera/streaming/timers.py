"""Watching jobs one by one: arbitrary state with event-time timers.

Each job has its own state and at most one timer: a running job without a heartbeat is
recovered under a new execution, a queued one that nobody starts is delivered again with
doubling waits, and an ended one is forgotten after a while.  A running job that was asked
to cancel has no timer; its worker ends it.

Timers are those of event time.  A command that comes after a job's timer was due sets it off
first, at the time when it was due, so results don't depend on how commands are cut into
batches.  State is a few values for each job that isn't forgotten.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE = "state string, since long, execution long, cancel boolean, repeats long"
ACTIONS = "job_id long, at long, action string, execution long"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class JobTimers(StatefulProcessor):
    """Commands (seq, kind, at in microseconds) of one job in, actions out.

    A job is (state, since, execution, cancel, repeats): since when it is in its state or was
    last heard of, and how often its delivery was repeated since.  ``silent``, ``lost`` and
    ``kept`` are microseconds; Spark keeps timers in milliseconds, so they are set to the next one.
    """

    def __init__(self, silent: int, lost: int, kept: int) -> None:
        self.silent, self.lost, self.kept = silent, lost, kept

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", STATE)

    def due(self, job: tuple) -> int | None:
        state, since, _, cancel, repeats = job
        if state == "running":
            return None if cancel else since + self.silent
        return since + (self.lost * (2 ** (repeats + 1) - 1) if state == "queued" else self.kept)

    def passed(self, key: int, job: tuple | None, until: int) -> tuple[tuple | None, list[Row]]:
        """The job after all timers due up to ``until``, and what they did."""
        out = []
        while job is not None and (at := self.due(job)) is not None and at <= until:
            state, since, execution, _, repeats = job
            if state == "running":
                action, execution = "recover", execution + 1
                job = ("queued", at, execution, False, 0)
            elif state == "queued":
                action, job = "redeliver", (state, since, execution, False, repeats + 1)
            else:
                action, job = "purge", None
            out.append(Row(job_id=key, at=at, action=action, execution=execution))
        return job, out

    @staticmethod
    def commanded(job: tuple | None, kind: str, at: int) -> tuple | None:
        """The job after a command; one that doesn't fit its state changes nothing."""
        if job is None:
            return ("queued", at, 1, False, 0) if kind == "enqueue" else None
        state, since, execution, cancel, _ = job
        if (kind == "start" and state == "queued") or (kind == "beat" and state == "running" and not cancel):
            return ("running", at, execution, False, 0)
        if (kind == "finish" and state == "running") or (kind == "cancel" and state == "queued"):
            return ("ended", at, execution, cancel, 0)
        if kind == "cancel" and state == "running":
            return (state, since, execution, True, 0)
        return job

    def _held(self) -> tuple | None:
        return tuple(self.job.get()) if self.job.exists() else None

    def _keep(self, job: tuple | None) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if job is None:
            self.job.clear()
            return
        self.job.update(job)
        at = self.due(job)
        if at is not None:
            self.handle.registerTimer(-(-at // 1000))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        job, actions = self._held(), []
        for r in sorted(rows, key=lambda r: (r.at, r.seq)):
            job, own = self.passed(key[0], job, r.at)
            actions += own
            job = self.commanded(job, r.kind, r.at)
        self._keep(job)
        yield from actions

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        job, actions = self.passed(key[0], self._held(), timerValues.getCurrentWatermarkInMs() * 1000)
        self._keep(job)
        yield from actions

    def close(self) -> None:
        pass


def watched(commands: DataFrame, silent: int = 120, lost: int = 30, kept: int = 7 * 86400, late: str = "0 seconds") -> DataFrame:
    """Actions (job_id, at in microseconds, action, execution) due on a stream of commands (job_id, seq, kind, at).

    Kinds are enqueue, start, beat, finish and cancel; commands later than ``late`` are dropped.
    The three waits are in seconds.  The state store must be the RocksDB one (``with_rocks``).
    """
    rows = commands.withWatermark("at", late).select("job_id", "seq", "kind", F.col("at").alias("event_time"), F.unix_micros("at").alias("at"))
    second = 1_000_000
    return rows.groupBy("job_id").transformWithState(JobTimers(silent * second, lost * second, kept * second), outputStructType=ACTIONS, outputMode="Append", timeMode="EventTime")


@contextmanager
def with_rocks(spark: SparkSession) -> Iterator[None]:
    """Queries started inside use the state store that timers and typed state need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)
