"""The control plane as pure transformations of its tables: audit, deliveries, keys, sessions,
versions, write fences and erasure.

A single writer applies them one after the other; each returns the table as it is
afterwards, or the rows that it admits.  All joins are equi-joins on ids, so they scale
with their tables, and no step collects anything.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hmac_by_version
from .lifecycle import upsert

DELIVERY_BATCH, INTERRUPTED_SECONDS = 20, 15 * 60
#: States from which a version may become active.
ACTIVATABLE = ("ready", "retired", "active")
#: What follows a key's product name: its kind, prefix and secret.
KEY = r"_(search|indexing|admin)_([A-Za-z0-9_-]{12})_([A-Za-z0-9_-]+)$"


def _seconds(at: Column | str) -> Column:
    return F.unix_seconds(at)


# Events and audit


def captured(events: DataFrame, projects: DataFrame) -> DataFrame:
    """Events of projects that have analytics switched on; the others aren't stored."""
    return events.join(projects.filter("analytics_enabled").select("project_id"), "project_id", "left_semi")


def audit_rows(changed: DataFrame, before: list[str], after: list[str], action: str, target: str) -> DataFrame:
    """One audit row for each changed object: what it was and what it is, as JSON.

    ``before`` and ``after`` are columns by the same names in order; rows whose values
    are all equal leave no trace.
    """
    same = F.lit(True)
    for a, b in zip(before, after, strict=True):
        same = same & F.col(a).eqNullSafe(F.col(b))
    pack = lambda names: F.struct(*(F.col(c).alias(n) for c, n in zip(names, before, strict=True)))
    metadata = F.to_json(F.struct(pack(before).alias("previous"), pack(after).alias("current")))
    return changed.filter(~same).select(F.lit(action).alias("action"), F.col(target).cast("string").alias("target_id"), metadata.alias("metadata"))


def inserted(existing: DataFrame, wanted: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows of ``wanted`` that an insert which ignores known keys would add: the first of each new key."""
    first = wanted.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("__n = 1").drop("__n")
    return first.join(existing.select(key), key, "left_anti")


# Deliveries


def claim_due(rows: DataFrame, now: Column, k: int = DELIVERY_BATCH) -> DataFrame:
    """The next deliveries, now being sent: pending or failed ones that are due, oldest first."""
    due = rows.filter(F.col("state").isin("pending", "failed") & (F.col("next_attempt_at") <= now)).orderBy("next_attempt_at", "created_at", "id").limit(k)
    return due.withColumns({"state": F.lit("sending"), "claimed_at": now, "attempts": F.col("attempts") + 1})


def recover_interrupted(rows: DataFrame, now: Column, seconds: int = INTERRUPTED_SECONDS) -> DataFrame:
    """The table with claims that were never finished made due again."""
    lost = (F.col("state") == "sending") & (_seconds("claimed_at") < _seconds(now) - seconds)
    return rows.withColumns({"state": F.when(lost, "failed").otherwise(F.col("state")), "next_attempt_at": F.when(lost, now).otherwise(F.col("next_attempt_at")), "claimed_at": F.when(~lost, F.col("claimed_at"))})


# Keys, sessions, quotas


def key_verdicts(requests: DataFrame, keys: DataFrame, now: Column, allowed: tuple[str, ...], peppers: dict[int, bytes], projects: DataFrame | None = None, product: str = "[a-z]+") -> DataFrame:
    """``verdict`` of each request (key, ip) against the keys: ok, forbidden or unauthenticated.

    ``keys`` has prefix, kind, digest, version, revoked_at, expires_at, ips and project_id.  Digests are
    keyed: ``peppers`` has the key of each version, so keys can be rotated while older digests
    stay valid; digests are computed only for requests whose prefix is known.  With ``projects``
    (project_id, deletion_requested_at, deleted_at) keys of others than live projects are unknown.
    ``product`` is the pattern of what keys begin with.
    """
    pattern = f"^{product}{KEY}"
    kind, prefix, secret = (F.regexp_extract("key", pattern, i) for i in (1, 2, 3))
    asked = requests.withColumns({"asked_kind": kind, "prefix": prefix, "asked_secret": secret})
    known = keys.filter("revoked_at IS NULL")
    if projects is not None:
        known = known.join(projects.filter("deletion_requested_at IS NULL AND deleted_at IS NULL").select("project_id"), "project_id", "left_semi")
    both = asked.join(known.select("prefix", "kind", "digest", "version", "expires_at", "ips"), "prefix", "left")
    same = F.coalesce(F.col("digest") == hmac_by_version(F.col("asked_secret"), F.col("version"), peppers), F.lit(False))
    verdict = (
        F.when(F.col("asked_kind") == "", "unauthenticated")
        .when(~F.col("asked_kind").isin(*allowed), "forbidden")
        .when(F.col("kind").isNull() | (F.col("kind") != F.col("asked_kind")), "unauthenticated")
        .when(F.col("expires_at") <= now, "unauthenticated")
        .when((F.size("ips") > 0) & ~F.coalesce(F.array_contains("ips", F.col("ip")), F.lit(False)), "forbidden")
        .when(~same, "unauthenticated")
        .otherwise("ok")
    )
    return both.select(*requests.columns, verdict.alias("verdict"))


def revoke_families(sessions: DataFrame, used: DataFrame, now: Column) -> DataFrame:
    """Sessions after tokens (``used``: token) were presented: one that was rotated or revoked before takes its whole family along."""
    reused = sessions.filter("revoked_at IS NOT NULL OR rotated_at IS NOT NULL").join(used.select("token"), "token", "left_semi").select("family_id").distinct()
    marked = sessions.join(reused.withColumn("reused", F.lit(True)), "family_id", "left")
    return marked.withColumn("revoked_at", F.when(F.col("reused") & F.col("revoked_at").isNull(), now).otherwise(F.col("revoked_at"))).drop("reused")


def crawl_admission(pages: DataFrame, quotas: DataFrame, order: list[str]) -> DataFrame:
    """``admitted`` for each page in order: blocked ones are free, the others count against their project's quota.

    A project's pages are numbered by a running count, which has the project as key and
    so one task a project; quotas are monthly, which bounds it.
    """
    counts = (F.col("status") != "blocked").cast("long")
    so_far = F.sum(counts).over(Window.partitionBy("project_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    rows = pages.withColumn("__n", so_far).join(quotas.select("project_id", "pages_quota", "used"), "project_id", "left")
    free = (F.col("status") == "blocked") | F.col("pages_quota").isNull()
    return rows.withColumn("admitted", free | (F.coalesce("used", F.lit(0)) + F.col("__n") <= F.col("pages_quota"))).drop("__n", "pages_quota", "used")


def month_of(rows: DataFrame, at: str) -> Column:
    """The UTC month of a time, as ``yyyy-MM``, in any session zone; times without a zone are in UTC."""
    time = F.col(at) if dict(rows.dtypes)[at] == "timestamp_ntz" else F.convert_timezone(None, F.lit("UTC"), F.col(at))
    return F.date_format(time, "yyyy-MM")


def admitted_requests(requests: DataFrame, counters: DataFrame, order: list[str], at: str = "at") -> DataFrame:
    """``period`` and ``admitted`` for each request, counted in order against its project's monthly counter.

    Every request adds one; one that would pass the limit is refused and not counted, so those
    admitted are the first ones that fit.  ``counters`` (project_id, period, used, most) holds what was
    used before and the limits; a missing one starts from 0 without a limit.  Requests without
    a project or a time aren't admitted.  A project with a third of all requests is dealt to many tasks.
    """
    from .ranks import ranked

    rows = requests.withColumn("period", month_of(requests, at))
    known = rows.filter("project_id IS NOT NULL AND period IS NOT NULL")
    own = counters.select("project_id", "period", F.col("used").alias("__used"), F.col("most").alias("__most"))
    placed = ranked(known, ["project_id", "period"], order, of_group=own)
    fits = F.col("__most").isNull() | (F.coalesce("__used", F.lit(0)) + F.col("rank") + 1 <= F.col("__most"))
    placed = placed.withColumn("admitted", fits).select(*rows.columns, "admitted")
    return placed.unionByName(rows.filter("project_id IS NULL OR period IS NULL").withColumn("admitted", F.lit(False)))


def add_usage(counters: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Counters (project_id, period, used, most) after ``verdicts`` of ``admitted_requests``, and how many were refused."""
    n = verdicts.filter("project_id IS NOT NULL AND period IS NOT NULL").groupBy("project_id", "period").agg(F.count_if("admitted").alias("__in"), F.count_if(~F.col("admitted")).alias("rejected"))
    rows = counters.join(n, ["project_id", "period"], "full")
    zero = F.lit(0)
    return rows.select("project_id", "period", (F.coalesce("used", zero) + F.coalesce("__in", zero)).alias("used"), "most", F.coalesce("rejected", zero).alias("rejected"))


# Versions


def begun(versions: DataFrame, fences: DataFrame) -> DataFrame:
    """``versions`` with one being built for each index of ``fences``, numbered above all before and the fence."""
    from .lifecycle import next_sequence

    new = next_sequence(versions, fences).select("index_id", F.col("next_sequence").alias("sequence"), F.lit("building").alias("state"))
    return versions.select("index_id", "sequence", "state").unionByName(new)


def ended(versions: DataFrame, results: DataFrame) -> DataFrame:
    """Builds that ended (index_id, sequence, ok): ready or failed.  Only versions being built change."""
    own = versions.join(results, ["index_id", "sequence"], "left")
    done = (F.col("state") == "building") & F.col("ok").isNotNull()
    return own.withColumn("state", F.when(done, F.when(F.col("ok"), "ready").otherwise("failed")).otherwise(F.col("state"))).drop("ok")


def may_activate(versions: DataFrame, fences: DataFrame) -> DataFrame:
    """Versions that may become active, now or by going back: of a fit state, and not older than their index's fence."""
    return versions.filter(F.col("state").isin(*ACTIVATABLE)).join(fences, "index_id").filter("sequence >= minimum_sequence").select("index_id", "sequence", "state")


def listed(versions: DataFrame) -> DataFrame:
    """Versions by name, last first: names are compared as strings, so 9 stands before 10."""
    return versions.orderBy("index_id", F.desc(F.col("version").cast("string")))


# Fences and erasure


def writable(rows: DataFrame, **deleting: DataFrame) -> DataFrame:
    """Rows that may be written: those under nothing that is being deleted (``index_id=...``, ``source_id=...``)."""
    for key, gone in deleting.items():
        rows = rows.join(gone.select(key), key, "left_anti")
    return rows


def tombstoned(docs: DataFrame, ids: DataFrame, now: Column, key: str = "doc_id") -> DataFrame:
    """Documents with ``deleted_at`` set for ``ids``; a document deleted before keeps its time."""
    hit = docs.join(ids.select(key).withColumn("__hit", F.lit(True)), key, "left")
    return hit.withColumn("deleted_at", F.when(F.col("__hit") & F.col("deleted_at").isNull(), now).otherwise(F.col("deleted_at"))).drop("__hit")


def fenced(versions: DataFrame, fences: DataFrame) -> DataFrame:
    """Fences raised above every version there is, so none that may hold erased documents can be activated."""
    latest = versions.groupBy("index_id").agg((F.max("sequence") + 1).alias("above"))
    raised = F.greatest(F.col("minimum_sequence"), F.coalesce("above", F.lit(1)))
    return fences.join(latest, "index_id", "left").select("index_id", raised.cast("long").alias("minimum_sequence"))


def erased(docs: DataFrame, gone: DataFrame, source: str = "source_id") -> DataFrame:
    """Documents without those of erased sources; documents without a source stay."""
    return docs.join(gone.select(source), source, "left_anti")


def purged_versions(versions: DataFrame, fences: DataFrame) -> DataFrame:
    """Versions that are kept after an erasure; those below the fence are removed with their folders."""
    return versions.join(fences, "index_id", "left").filter("sequence >= coalesce(minimum_sequence, 0)").select(*versions.columns)


def cascaded(tables: dict[str, DataFrame], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """Every table that has ``key`` without the rows of what is deleted."""
    return {name: df.join(gone.select(key), key, "left_anti") if key in df.columns else df for name, df in tables.items()}


def scrubbed(projects: DataFrame, gone: DataFrame, now: Column) -> DataFrame:
    """Projects with those deleted kept as rows without a name or settings, so receipts and audit rows still resolve."""
    hit = projects.join(gone.select("project_id").withColumn("__hit", F.lit(True)), "project_id", "left")
    clean = {c: F.when(F.col("__hit").isNull(), F.col(c)) for c in ("name", "settings") if c in projects.columns}
    return hit.withColumns(clean | {"deleted_at": F.when(F.col("__hit"), now).otherwise(F.col("deleted_at"))}).drop("__hit")


def edited(docs: DataFrame, changes: DataFrame, key: str, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """Documents after an edit, and its audit rows."""
    old = docs.select(key, *fields)
    pairs = changes.select(key, *(F.col(f).alias(f"new_{f}") for f in fields)).join(old, key)
    return upsert(docs, changes, key), audit_rows(pairs, fields, [f"new_{f}" for f in fields], "document.updated", key)


# Ledgers


def pending_steps(files: dict[str, str], applied: dict[str, str]) -> list[str]:
    """Names of migration files to apply, in order; one that was applied and has changed since is an error."""
    todo = []
    for name in sorted(f for f in files if f[:1].isdigit() and f.endswith(".sql")):
        digest = hashlib.sha256(files[name].encode()).hexdigest()
        if name not in applied:
            todo.append(name)
        elif applied[name] != digest:
            raise ValueError(f"an applied migration was modified: {name}")
    return todo
