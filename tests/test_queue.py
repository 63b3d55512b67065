"""The queue's tick, its stream, timers of jobs, and monthly counters."""

import datetime

import pytest
from pyspark.sql import functions as F

from tessera.operators import control as C
from tessera.operators import jobs as J
from tessera.operators import queue as Q
from tessera.streaming import outbox
from tessera.streaming.timers import JobTimers

T0 = datetime.datetime(2024, 3, 1, 12, 0, 0)


def ago(seconds):
    return T0 - datetime.timedelta(seconds=seconds)


def queue(spark, jobs=(), outbox=(), schedules=(), sources=(), retries=(), delivered=(), held=()):
    """jobs: (id, type, source, state, execution, cancel, updated, finished)."""
    make = lambda rows, kinds: spark.createDataFrame(list(rows), kinds)
    return Q.Queue(
        make(jobs, "job_id string, type string, source_id long, state string, execution_id string, cancel_requested boolean, updated_at timestamp, finished_at timestamp"),
        make(outbox, "job_id string, created_at timestamp, dispatched_at timestamp, updated_at timestamp"),
        make(schedules, "source_id long, enabled boolean, interval_seconds int, next_run_at timestamp"),
        make(sources, "source_id long, enabled boolean, deletion_requested_at timestamp"),
        make(retries, "source_id long, retry_at timestamp"),
        make([(d,) for d in delivered], "execution_id string"),
        make([(h,) for h in held], "job_id string"),
    )


def now(at=T0):
    return F.lit(at).cast("timestamp")


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def job(name, state="queued", cancel=False, updated=0, kind="crawl", source=1, finished=None):
    return (name, kind, source, state, f"e-{name}", cancel, ago(updated), finished)


def entry(name, created=0, dispatched=None, updated=0):
    return (name, ago(created), None if dispatched is None else ago(dispatched), ago(updated))


def test_steps_see_what_earlier_ones_did(spark):
    # Source 1 has a deferred retry and a due schedule: one crawl, sent in the same tick.  Source 2's
    # stale run is recovered, sent under its new execution and not reconciled again.
    q = queue(
        spark,
        jobs=[job("b", "running", updated=500, source=2), job("d", "running", updated=500, kind="cleanup", source=3)],
        outbox=[entry("b", 900, 800, 800), entry("d", 900, 800, 800)],
        schedules=[(1, True, 3600, ago(5)), (4, True, 3600, ago(5)), (5, True, 3600, ago(-5))],
        sources=[(1, True, None), (2, True, None), (4, False, None), (5, True, None), (6, True, ago(1))],
        retries=[(1, ago(1)), (1, ago(2)), (6, ago(1)), (2, ago(1))],
    )
    after, sent = Q.tick(q, now())
    jobs = {r.job_id: r for r in after.jobs.collect()}
    new = [r for r in jobs.values() if r.job_id not in ("b", "d")]
    assert [(r.source_id, r.state, r.type) for r in new] == [(1, "queued", "crawl")]  # source 2 is busy
    assert jobs["b"].state == "queued" and jobs["b"].execution_id != "e-b"
    assert jobs["d"].state == "running"
    assert rows(sent, "job_id", "execution_id", "step") == sorted([(r.job_id, r.execution_id, "dispatch") for r in (new[0], jobs["b"])])
    assert rows(after.schedules, "source_id", "next_run_at") == [(1, ago(-3600)), (4, ago(-3600)), (5, ago(-5))]
    assert rows(after.delivered, "execution_id") == sorted((r.execution_id,) for r in (new[0], jobs["b"]))


def test_cancelled_jobs_are_left_alone(spark):
    q = queue(
        spark,
        jobs=[job("run", "running", True, 500), job("lost", "queued", True, 500), job("new", "queued", True), job("own", "running", False, 500), job("ok", "queued")],
        outbox=[entry("run", 900, 800, 800), entry("lost", 900, 800, 800), entry("new"), entry("own", 900, 800, 800), entry("ok", 1)],
        held=["own"],
    )
    after, sent = Q.tick(q, now())
    assert rows(sent, "job_id", "step") == [("ok", "dispatch")]
    assert rows(after.jobs, "job_id", "state") == [("lost", "queued"), ("new", "queued"), ("ok", "queued"), ("own", "running"), ("run", "running")]
    # What can't be sent is marked all the same, so it doesn't stand in the way.
    assert rows(after.outbox.filter("dispatched_at IS NULL"), "job_id") == []


def test_limits_and_rotation(spark):
    names = [f"j{i:02}" for i in range(60)]
    q = queue(spark, jobs=[job(n) for n in names], outbox=[entry(n, 900, 800, 700 - i) for i, n in enumerate(names)], delivered=[f"e-{n}" for n in names if n != "j40"])
    looked = []
    for k in range(3):
        at = T0 + datetime.timedelta(seconds=10 * k)
        q, sent = Q.tick(q, now(at))
        q = Q.cut(q)
        looked.append({r.job_id for r in q.outbox.filter(F.col("updated_at") == F.lit(at)).collect()})
        assert rows(sent, "job_id", "step") == ([("j40", "reconcile")] if k == 1 else [])
    assert [len(x) for x in looked] == [25, 25, 10]
    assert set.union(*looked) == set(names)


def test_purge_takes_the_oldest(spark):
    week = 7 * 86400
    jobs = [job(f"j{i}", "completed" if i % 2 else "failed", finished=ago(week - 2 + i)) for i in range(6)]
    q = Q.purge(queue(spark, jobs=jobs, outbox=[entry(f"j{i}", 9, None if i == 3 else 8) for i in range(6)]), now(), k=2)
    assert rows(q.outbox, "job_id") == [("j0",), ("j1",), ("j2",), ("j3",)]


def test_commands_in_order_and_fences(spark):
    q = queue(spark, jobs=[job(n) for n in "abcdefg"] + [job("h", "running"), job("i", "failed", finished=ago(9))])
    at = lambda s: T0 + datetime.timedelta(seconds=s)
    commands = [("a", "e-a", "start", at(1)), ("a", "e-a", "complete", at(3)), ("a", "e-a", "beat", at(2)), ("b", "other", "start", at(1)), ("c", None, "cancel", at(1)), ("c", "e-c", "start", at(2)),
        ("d", "e-d", "start", at(1)), ("d", None, "cancel", at(2)), ("d", "e-d", "beat", at(3)), ("e", "e-e", "beat", at(1)), ("f", "e-f", "start", at(1)), ("f", "e-f", "fail", at(2)), ("f", "e-f", "start", at(3)),
        ("h", None, "cancel", at(1)), ("h", "e-h", "complete", at(2)), ("i", "e-i", "start", at(1))]
    after = Q.commanded(q.jobs, spark.createDataFrame(commands, "job_id string, execution_id string, kind string, at timestamp"))
    assert [(n, s, c, (u - T0).seconds, f and int((f - T0).total_seconds())) for n, s, c, u, f in rows(after, "job_id", "state", "cancel_requested", "updated_at", "finished_at")] == [
        ("a", "completed", False, 3, 3), ("b", "queued", False, 0, None), ("c", "cancelled", False, 1, 1), ("d", "running", True, 2, None), ("e", "queued", False, 0, None), ("f", "running", False, 3, None),
        ("g", "queued", False, 0, None), ("h", "cancelled", True, 2, 2), ("i", "running", False, 1, None)]


def state(store, spark, v):
    q = outbox.stored(spark, f"{store}/v={v}")
    return {n: sorted(map(str, getattr(q, n).collect())) for n in Q.TABLES}


def test_stream_of_ticks_can_be_repeated(spark, tmp_path):
    store = str(tmp_path / "q")
    names = [f"j{i:02}" for i in range(30)]
    outbox.written(queue(spark, jobs=[job(n, updated=50) for n in names], outbox=[entry(n, 60 - i) for i, n in enumerate(names)], sources=[(1, True, None)]), f"{store}/v=0")
    kinds = "job_id string, execution_id string, kind string, at timestamp"
    batches = [[("j00", None, "cancel", T0)], [("j01", "e-j01", "start", T0 + datetime.timedelta(seconds=31))]]
    sink, sent = outbox.tick_sink(store), []
    for n, b in enumerate(batches):
        sink(spark.createDataFrame(b, kinds), n)
    first = state(store, spark, 2)
    sent = sorted(map(str, spark.read.parquet(f"{store}/sent/v=2").collect()))
    # The batch is repeated after a failure: nothing changes, though a later version is there already.
    sink(spark.createDataFrame(batches[1], kinds), 1)
    assert state(store, spark, 2) == first
    assert sorted(map(str, spark.read.parquet(f"{store}/sent/v=2").collect())) == sent
    assert spark.read.parquet(f"{store}/sent/v=1").count() == 24  # one of 25 was cancelled
    # Five are left to dispatch; all that were delivered a while ago are still with the broker.
    assert {r.step for r in spark.read.parquet(f"{store}/sent/v=2").collect()} == {"dispatch"}
    assert spark.read.parquet(f"{store}/sent/v=2").count() == 5
    # The same batches as a stream.
    again = str(tmp_path / "again")
    outbox.written(outbox.stored(spark, f"{store}/v=0"), f"{again}/v=0")
    for n, b in enumerate(batches):
        spark.createDataFrame(b, kinds).coalesce(1).write.parquet(f"{tmp_path}/in", mode="append")
        stream = spark.readStream.schema(kinds).parquet(f"{tmp_path}/in")
        stream.writeStream.foreachBatch(outbox.tick_sink(again)).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert state(again, spark, 2) == first


def test_timers_of_a_job():
    m = JobTimers(120, 30, 1000)
    enqueued = m.commanded(None, "enqueue", 0)
    waiting, actions = m.passed(1, enqueued, 100)
    assert [(a.at, a.action) for a in actions] == [(30, "redeliver"), (90, "redeliver")]
    running = m.commanded(waiting, "start", 100)
    assert m.passed(1, running, 219) == (running, [])
    silent, actions = m.passed(1, running, 260)
    assert [(a.at, a.action, a.execution) for a in actions] == [(220, "recover", 2), (250, "redeliver", 2)] and silent[0] == "queued"
    asked = m.commanded(running, "cancel", 110)
    assert m.due(asked) is None and m.commanded(asked, "beat", 115) == asked
    ended = m.commanded(asked, "finish", 400)
    assert m.passed(1, ended, 1400)[0] is None
    assert m.commanded(ended, "start", 500) == ended and m.commanded(None, "beat", 1) is None


@pytest.mark.parametrize("zone", ["UTC", "Pacific/Auckland"])
def test_single_requests_are_refused(spark, zone):
    end = datetime.datetime(2024, 1, 31, 23, 59)
    requests = [(1, i, T0) for i in range(3)] + [(2, i, T0) for i in range(3)] + [(3, 9, T0), (None, 1, T0), (1, 5, None), (4, 1, end), (4, 2, end + datetime.timedelta(minutes=2))]
    r = spark.createDataFrame(requests, "project_id long, n long, at timestamp_ntz")
    counters = spark.createDataFrame([(1, "2024-03", 14, 15), (2, "2024-03", 20, 15), (5, "2024-03", 7, 9), (4, "2024-01", 0, 1), (4, "2024-02", 0, 0)], "project_id long, period string, used long, most long")
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        verdicts = C.admitted_requests(r, counters, ["at", "n"])
        found = sorted(map(tuple, verdicts.select("project_id", "n", "admitted").collect()), key=str)
        assert found == sorted([(1, 0, True), (1, 1, False), (1, 2, False), (2, 0, False), (2, 1, False), (2, 2, False), (3, 9, True), (None, 1, False), (1, 5, False), (4, 1, True), (4, 2, False)], key=str)
        assert rows(C.add_usage(counters, verdicts), "project_id", "period", "used", "rejected") == [(1, "2024-03", 15, 2), (2, "2024-03", 20, 3), (3, "2024-03", 1, 0), (4, "2024-01", 1, 0), (4, "2024-02", 0, 1), (5, "2024-03", 7, 0)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_reconcile_lost_looks_at_all(spark):
    long_ago = ago(500)
    jobs = spark.range(80).select(F.col("id").alias("job_id"), F.lit("queued").alias("state"), (F.col("id") % 4 == 0).alias("cancel_requested"))
    box = spark.range(80).select(F.col("id").alias("job_id"), *(F.lit(long_ago).cast("timestamp").alias(c) for c in ("dispatched_at", "updated_at")))
    assert rows(J.lost(box, jobs, now()), "job_id") == [(i,) for i in range(80) if i % 4]
    assert rows(J.lost(box, jobs, now(), k=3), "job_id") == [(1,), (2,), (3,)]


def test_recover_stale_takes_all(spark):
    jobs = spark.range(80).select(F.col("id").alias("job_id"), F.lit("crawl").alias("type"), F.lit("running").alias("state"), F.lit("e").alias("execution_id"), (F.col("id") % 4 == 0).alias("cancel_requested"), F.lit(ago(500)).cast("timestamp").alias("updated_at"))
    assert rows(J.stale(jobs, now()), "job_id", "state") == [(i, "queued") for i in range(80) if i % 4]
    assert rows(J.stale(jobs, now(), k=3), "job_id") == [(1,), (2,), (3,)]


def test_steps_look_ahead_without_shuffling_tables(spark, monkeypatch):
    """Where the first entries aren't to be picked, later ones are; a tick joins no table whole as long as enough of the first pass."""
    monkeypatch.setattr(Q, "AHEAD", 2)
    ended, T = "completed", ago(30 * 86400)
    jobs = [job(f"a{i}", "cancelled" if i < 6 else "queued", finished=ago(8 * 86400)) for i in range(9)] + [job(f"r{i}", "running", updated=900 - i) for i in range(9)] + [job(f"z{i}", ended, finished=T) for i in range(6)]
    outbox = [entry(f"a{i}", 900, 900, 900 - i) for i in range(9)] + [entry(f"r{i}", 900, 900, 0) for i in range(5, 9)]
    q = queue(spark, jobs=jobs, outbox=outbox, held=["r5"])
    assert rows(Q.reconcile(q, now(), k=2)[1], "job_id") == [("a6",), ("a7",)]
    after = Q.recover(q, now(), k=2)
    assert rows(after.jobs.filter("state = 'queued' AND job_id LIKE 'r%'"), "job_id") == [("r6",)]
    left = {r[0] for r in rows(Q.purge(q, now(), k=2).outbox, "job_id")}
    assert left == {e[0] for e in outbox} - {"a0", "a1"}
    monkeypatch.setattr(Q, "AHEAD", 100)
    seen = []
    monkeypatch.setattr(Q, "_first", lambda rows, order, passing, k, plain=Q._first: plain(rows, order, lambda r, few: (seen.append(few), passing(r, few))[1], k))
    Q.tick(q, now())
    assert seen == [True] * 3
