"""Queries for the control plane, with tables of orders, customers and events in the places of its own."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.hashing import hmac_by_version
from ..operators import control as C
from ..operators import jobs as J
from ..operators import lifecycle as L
from ..operators import queue as Q
from .common import EVENTS_SQL, Registry, plain_time, search_events, table

register = Registry()

EV = f"WITH {EVENTS_SQL} "


def _now() -> Column:
    return F.lit("1997-06-01").cast("timestamp")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))


@register(EV + "SELECT event_id, project, query FROM ev WHERE project <> 1")
def captured_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    projects = spark.createDataFrame([(0, True), (1, False), (2, True)], "project_id long, analytics_enabled boolean")
    ev = search_events(spark, sf_dir).withColumn("project_id", F.col("project").cast("long"))
    return C.captured(ev, projects).select("event_id", "project", "query")


@register(
    """SELECT 'quota.updated' AS action, CAST(c_custkey AS VARCHAR) AS target_id,
'{"previous":{"segment":"' || c_mktsegment || '","nation":' || c_nationkey || '},"current":{"segment":"' || CASE WHEN c_custkey % 3 = 0 THEN 'BUILDING' ELSE c_mktsegment END || '","nation":' || (CASE WHEN c_custkey % 5 = 0 THEN 7 ELSE c_nationkey END) || '}}' AS metadata
FROM customer WHERE (c_custkey % 3 = 0 AND c_mktsegment <> 'BUILDING') OR (c_custkey % 5 = 0 AND c_nationkey <> 7)"""
)
def audit_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(
        k, F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"), F.when(k % 3 == 0, "BUILDING").otherwise(F.col("c_mktsegment")).alias("s2"), F.when(k % 5 == 0, 7).otherwise(F.col("c_nationkey")).cast("long").alias("n2")
    )
    return C.audit_rows(rows.withColumn("nation", F.col("nation").cast("long")), ["segment", "nation"], ["s2", "n2"], "quota.updated", "c_custkey")


@register("SELECT o_custkey % 400 AS k, min(o_orderkey) AS o_orderkey FROM orders WHERE o_custkey % 400 NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) GROUP BY 1")
def insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"))
    wanted = _orders(spark, sf_dir).select((F.col("o_custkey") % 400).alias("k"), "o_orderkey")
    return C.inserted(known, wanted, "k", ["o_orderkey"])


_DELIVERIES = """d AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'failed' WHEN 2 THEN 'sending' ELSE 'sent' END AS state, CAST(o_orderkey % 8 AS INTEGER) AS attempts, o_orderdate AS next_attempt_at, o_orderdate AS claimed_at FROM orders)"""


def _deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    state = F.when(k % 4 == 0, "pending").when(k % 4 == 1, "failed").when(k % 4 == 2, "sending").otherwise("sent")
    return _orders(spark, sf_dir).select(k.alias("id"), state.alias("state"), (k % 8).cast("int").alias("attempts"), F.col("o_orderdate").alias("next_attempt_at"), F.col("o_orderdate").alias("claimed_at"), F.col("o_orderdate").alias("created_at"))


@register(f"WITH {_DELIVERIES} SELECT id, 'sending' AS state, attempts + 1 AS attempts FROM d WHERE state IN ('pending', 'failed') AND next_attempt_at <= TIMESTAMP '1997-06-01' ORDER BY next_attempt_at, id LIMIT 20")
def claim_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.claim_due(_deliveries(spark, sf_dir), _now()).select("id", "state", "attempts")


@register(f"WITH {_DELIVERIES} SELECT id, CASE WHEN lost THEN 'failed' ELSE state END AS state, CASE WHEN lost THEN TIMESTAMP '1997-06-01' ELSE next_attempt_at END AS next_attempt_at FROM (SELECT *, state = 'sending' AND claimed_at < TIMESTAMP '1997-06-01' - INTERVAL 15 MINUTE AS lost FROM d) x")
def recover_interrupted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain_time(C.recover_interrupted(_deliveries(spark, sf_dir), _now()).select("id", "state", "next_attempt_at"), "next_attempt_at")


#: Keys of digests by version, for these queries only; version 3 has been retired.
_PEPPERS = {1: b"first pepper", 2: b"second pepper, which is longer than one block of the digest and so is hashed before it is used"}


def _block(key: bytes, pad: int) -> str:
    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    return "unhex('" + bytes(k ^ pad for k in key.ljust(64, b"\0")).hex() + "')"


def _hmac_sql(message: str, key: bytes) -> str:
    return f"sha256({_block(key, 0x5C)} || unhex(sha256({_block(key, 0x36)} || encode({message}))))"


@register(f"SELECT c_custkey, CASE c_custkey % 3 WHEN 1 THEN {_hmac_sql('c_name', _PEPPERS[1])} WHEN 2 THEN {_hmac_sql('c_name', _PEPPERS[2])} END AS digest FROM customer")
def keyed_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k, hmac_by_version(F.col("c_name"), k % 3, _PEPPERS).alias("digest"))


@register(
    """SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN 'unauthenticated' WHEN c_custkey % 3 = 2 THEN 'forbidden' WHEN c_custkey % 7 = 0 OR c_custkey % 17 = 0 THEN 'unauthenticated' WHEN c_custkey % 13 = 0 THEN 'unauthenticated'
WHEN c_custkey % 4 = 0 AND c_custkey % 8 <> 0 THEN 'forbidden' WHEN c_custkey % 9 = 0 OR c_custkey % 5 = 3 THEN 'unauthenticated' ELSE 'ok' END AS verdict FROM customer"""
)
def key_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revoked, expired, restricted, wrong and retired keys of three kinds, of which two are allowed, and keys of projects being deleted."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.lpad(k.cast("string"), 12, "p").alias("prefix"), F.when(k % 3 == 0, "search").when(k % 3 == 1, "admin").otherwise("indexing").alias("kind"))
    version = F.when(k % 5 == 3, 3).when(k % 2 == 0, 1).otherwise(2)
    keys = rows.select(
        "prefix", "kind", k.alias("project_id"), version.alias("version"), hmac_by_version(F.concat(F.lit("s"), k.cast("string")), version, _PEPPERS | {3: b"retired"}).alias("digest"), F.when(k % 7 == 0, _now()).alias("revoked_at"),
        F.when(k % 13 == 0, _now()).alias("expires_at"), F.when(k % 4 == 0, F.array(F.lit("192.0.2.7"))).otherwise(F.array().cast("array<string>")).alias("ips"),
    )
    projects = rows.select(k.alias("project_id"), F.when(k % 17 == 0, _now()).alias("deletion_requested_at"), F.lit(None).cast("timestamp").alias("deleted_at"))
    secret = F.concat(F.when(k % 9 == 0, "x").otherwise("s"), k.cast("string"))
    sent = F.when(k % 11 == 0, "nonsense").otherwise(F.concat_ws("_", F.lit("ts"), "kind", "prefix", secret))
    asked = rows.select("c_custkey", sent.alias("key"), F.when(k % 8 == 0, "192.0.2.7").alias("ip"))
    return C.key_verdicts(asked, keys, _now(), ("search", "admin"), _PEPPERS, projects, product="ts").select("c_custkey", "verdict")


@register(
    """WITH s AS (SELECT o_orderkey AS token, o_custkey AS family_id, o_orderkey % 3 = 0 AS rotated, o_orderkey % 50 = 0 AS used FROM orders),
r AS (SELECT DISTINCT family_id FROM s WHERE rotated AND used) SELECT token, family_id IN (SELECT family_id FROM r) AS revoked FROM s"""
)
def revoked_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    s = _orders(spark, sf_dir).select(k.alias("token"), F.col("o_custkey").alias("family_id"), F.when(k % 3 == 0, _now()).alias("rotated_at"), F.lit(None).cast("timestamp").alias("revoked_at"))
    return C.revoke_families(s, s.filter("token % 50 = 0"), _now()).select("token", F.col("revoked_at").isNotNull().alias("revoked"))


_CRAWL = "p AS (SELECT o_orderkey, o_custkey % 100 AS project_id, CASE WHEN o_orderstatus = 'F' THEN 'blocked' ELSE 'indexed' END AS status FROM orders)"


@register(
    f"""WITH {_CRAWL}, n AS (SELECT *, sum(CASE WHEN status = 'blocked' THEN 0 ELSE 1 END) OVER (PARTITION BY project_id ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS n FROM p)
SELECT o_orderkey, status = 'blocked' OR project_id % 10 = 0 OR n + 2 <= project_id AS admitted FROM n"""
)
def crawl_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects have quotas of their number less two pages used before; one in ten has none."""
    pages = _orders(spark, sf_dir).select("o_orderkey", (F.col("o_custkey") % 100).alias("project_id"), F.when(F.col("o_orderstatus") == "F", "blocked").otherwise("indexed").alias("status"))
    quotas = spark.range(100).select(F.col("id").alias("project_id"), F.when(F.col("id") % 10 != 0, F.col("id")).alias("pages_quota"), F.lit(2).alias("used"))
    return C.crawl_admission(pages, quotas, ["o_orderkey"]).select("o_orderkey", "admitted")


_USAGE = """r AS (SELECT click_id, client_id AS project_id, strftime(arrived_at, '%Y-%m') AS period, arrived_at FROM clicks),
n AS (SELECT *, row_number() OVER (PARTITION BY project_id, period ORDER BY arrived_at, click_id) AS n FROM r),
v AS (SELECT *, project_id IS NOT NULL AND period IS NOT NULL AND (project_id % 4 = 0 OR n + CASE WHEN project_id % 3 = 0 THEN 14 ELSE 0 END <= 15) AS admitted FROM n)"""


def usage_counters(requests: DataFrame) -> DataFrame:
    """Three in four projects may make 15 requests a month, and one in three made 14 before."""
    k = F.col("project_id")
    months = requests.filter("project_id IS NOT NULL AND period IS NOT NULL").select("project_id", "period").distinct()
    return months.select("*", F.when(k % 3 == 0, 14).otherwise(0).cast("long").alias("used"), F.when(k % 4 != 0, 15).cast("long").alias("most"))


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "clicks").select("click_id", F.col("client_id").alias("project_id"), "arrived_at")


def _admitted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    r = _requests(spark, sf_dir)
    counters = usage_counters(r.withColumn("period", C.month_of(r, "arrived_at")))
    return counters, C.admitted_requests(r, counters, ["arrived_at", "click_id"], at="arrived_at")


@register(f"WITH {_USAGE} SELECT click_id, project_id, period, admitted FROM v")
def usage_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each click as a request against its client's monthly limit."""
    return _admitted(spark, sf_dir)[1].select("click_id", "project_id", "period", "admitted")


@register(f"WITH {_USAGE} SELECT project_id, period, CAST(any_value(CASE WHEN project_id % 3 = 0 THEN 14 ELSE 0 END) + count(*) FILTER (WHERE admitted) AS BIGINT) AS used, count(*) FILTER (WHERE NOT admitted) AS rejected FROM v WHERE project_id IS NOT NULL AND period IS NOT NULL GROUP BY project_id, period")
def usage_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters after a month: single requests are refused, and those before them stay counted."""
    counters, verdicts = _admitted(spark, sf_dir)
    return C.add_usage(counters, verdicts).select("project_id", "period", "used", "rejected")


_VERSIONS = "v AS (SELECT o_custkey % 40 AS index_id, o_orderkey AS sequence, CASE o_orderkey % 5 WHEN 0 THEN 'building' WHEN 1 THEN 'ready' WHEN 2 THEN 'retired' WHEN 3 THEN 'failed' ELSE 'active' END AS state FROM orders)"


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    state = F.when(k % 5 == 0, "building").when(k % 5 == 1, "ready").when(k % 5 == 2, "retired").when(k % 5 == 3, "failed").otherwise("active")
    return _orders(spark, sf_dir).select((F.col("o_custkey") % 40).alias("index_id"), k.alias("sequence"), state.alias("state"))


def _fences(spark: SparkSession) -> DataFrame:
    return spark.range(40).select(F.col("id").alias("index_id"), (F.col("id") * 10).alias("minimum_sequence"))


@register(
    f"""WITH {_VERSIONS} SELECT index_id, sequence, CASE WHEN state = 'building' AND sequence % 10 = 0 THEN CASE WHEN sequence % 20 = 0 THEN 'ready' ELSE 'failed' END ELSE state END AS state FROM v
UNION ALL SELECT f.i, greatest(coalesce(max(sequence), 0) + 1, f.i * 10), 'building' FROM range(40) f(i) LEFT JOIN v ON index_id = f.i GROUP BY f.i"""
)
def version_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new version of each index, after some builds have ended."""
    v = _versions(spark, sf_dir)
    results = v.filter("sequence % 10 = 0").select("index_id", "sequence", (F.col("sequence") % 20 == 0).alias("ok"))
    return C.begun(C.ended(v, results), _fences(spark))


@register(f"WITH {_VERSIONS} SELECT index_id, sequence, state FROM v WHERE state IN ('ready', 'retired', 'active') AND sequence >= index_id * 10")
def rollback_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.may_activate(_versions(spark, sf_dir), _fences(spark))


@register(f"WITH {_VERSIONS} SELECT index_id, version, row_number() OVER (PARTITION BY index_id ORDER BY version DESC) AS place FROM (SELECT index_id, CAST(sequence AS VARCHAR) AS version FROM v) x")
def registry_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = C.listed(_versions(spark, sf_dir).select("index_id", F.col("sequence").cast("string").alias("version")))
    return v.withColumn("place", F.row_number().over(Window.partitionBy("index_id").orderBy(F.desc("version"))).cast("long"))


@register("SELECT doc_id, source FROM documents WHERE source NOT IN ('src3', 'src4') AND doc_id % 13 <> 0")
def write_fence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", (F.col("doc_id") % 13).alias("index_id"))
    gone = spark.createDataFrame([("src3",), ("src4",)], "source string")
    return C.writable(docs, source=gone, index_id=spark.createDataFrame([(0,)], "index_id long")).select("doc_id", "source")


@register("SELECT doc_id, doc_id % 17 = 0 OR doc_id % 10 = 0 AS deleted, CASE WHEN doc_id % 17 = 0 THEN TIMESTAMP '1996-01-01' WHEN doc_id % 10 = 0 THEN TIMESTAMP '1997-06-01' END AS deleted_at FROM documents")
def tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 17 == 0, F.lit("1996-01-01").cast("timestamp")).alias("deleted_at"))
    out = C.tombstoned(docs, docs.filter("doc_id % 10 = 0").select("doc_id"), _now())
    return plain_time(out.select("doc_id", F.col("deleted_at").isNotNull().alias("deleted"), "deleted_at"), "deleted_at")


@register(f"WITH {_VERSIONS} SELECT f.i AS index_id, greatest(f.i * 10, coalesce(max(sequence) + 1, 1)) AS minimum_sequence FROM range(40) f(i) LEFT JOIN v ON index_id = f.i GROUP BY f.i")
def erasure_fence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.fenced(_versions(spark, sf_dir), _fences(spark))


@register(f"WITH {_VERSIONS} SELECT index_id, sequence, state FROM v WHERE sequence >= index_id * 10")
def version_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.purged_versions(_versions(spark, sf_dir), _fences(spark))


@register(
    """SELECT 'customer' AS name, count(*) AS n FROM customer WHERE c_nationkey NOT IN (3, 4) UNION ALL SELECT 'supplier', count(*) FROM supplier WHERE s_nationkey NOT IN (3, 4) UNION ALL SELECT 'part', count(*) FROM part"""
)
def delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables under a deleted index lose its rows, others keep theirs."""
    tables = {
        "customer": table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("index_id")),
        "supplier": table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("index_id")),
        "part": table(spark, sf_dir, "part").select("p_partkey"),
    }
    left = C.cascaded(tables, spark.createDataFrame([(3,), (4,)], "index_id long"), "index_id")
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in left.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@register("SELECT c_custkey AS project_id, CASE WHEN c_nationkey <> 3 THEN c_name END AS name, c_nationkey = 3 AS deleted FROM customer")
def project_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("project_id"), F.col("c_name").alias("name"), "c_nationkey", F.lit(None).cast("timestamp").alias("deleted_at"))
    return C.scrubbed(p, p.filter("c_nationkey = 3"), _now()).select("project_id", "name", F.col("deleted_at").isNotNull().alias("deleted"))


@register("""SELECT 'document.updated' AS action, CAST(doc_id AS VARCHAR) AS target_id, '{"previous":{"source":"' || source || '"},"current":{"source":"src0"}}' AS metadata FROM documents WHERE doc_id % 9 = 0 AND source <> 'src0'""")
def console_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return C.edited(docs, docs.filter("doc_id % 9 = 0").withColumn("source", F.lit("src0")), "doc_id", ["source"])[1]


_RUNS = "j AS (SELECT o_orderkey AS job_id, CASE o_orderkey % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'failed' ELSE 'completed' END AS state, o_orderkey % 6 = 0 AS cancel, 'e' || (o_orderkey % 7) AS current FROM orders)"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    state = F.when(k % 4 == 0, "queued").when(k % 4 == 1, "running").when(k % 4 == 2, "failed").otherwise("completed")
    return _orders(spark, sf_dir).select(k.alias("job_id"), state.alias("state"), (k % 6 == 0).alias("cancel_requested"), F.concat(F.lit("e"), (k % 7).cast("string")).alias("execution_id"))


@register(f"WITH {_RUNS} SELECT job_id, 'e3' AS execution_id, current = 'e3' AND NOT cancel AND state IN ('queued', 'failed') AS claim, current = 'e3' AND NOT cancel AND state = 'running' AS heartbeat, current <> 'e3' AS fenced FROM j")
def job_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = _runs(spark, sf_dir)
    return J.run_verdicts(jobs, jobs.select("job_id", F.lit("e3").alias("execution_id")))


@register(f"WITH {_RUNS} SELECT job_id, CASE WHEN cancel AND state IN ('queued', 'running') THEN 'cancelled' ELSE state END AS state FROM j")
def job_cancelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.finish_cancelled(_runs(spark, sf_dir)).select("job_id", "state")


@register(f"WITH {_RUNS} SELECT job_id, CASE state WHEN 'queued' THEN 'cancelled' WHEN 'running' THEN 'running' END AS next_state, state = 'running' AS cancel_requested FROM j")
def job_cancel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.transition(_runs(spark, sf_dir), "cancel").select("job_id", "next_state", "cancel_requested")


@register(
    """WITH p AS (SELECT o_custkey AS source_id, o_orderpriority AS normalized_url, arg_max(o_orderkey, o_orderkey) AS attempt FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1, 2),
o AS (SELECT c_custkey AS source_id, '1-URGENT' AS normalized_url, -1 AS attempt FROM customer)
SELECT * FROM (SELECT * FROM p UNION ALL SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.source_id = o.source_id AND p.normalized_url = o.normalized_url)) x WHERE NOT (source_id % 5 = 0 AND normalized_url = '1-URGENT')"""
)
def deferred_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("source_id"), F.lit("1-URGENT").alias("normalized_url"))
    old = c.select("*", F.lit(-1).cast("long").alias("attempt"), F.lit(0).cast("long").alias("updated_at"))
    put = _orders(spark, sf_dir).filter("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("source_id"), F.col("o_orderpriority").alias("normalized_url"), F.col("o_orderkey").alias("attempt"), F.col("o_orderkey").alias("updated_at"))
    return J.deferred(old, put, c.filter("source_id % 5 = 0")).select("source_id", "normalized_url", "attempt")


_PAGES = "p AS (SELECT o_custkey AS source_id, o_orderpriority AS normalized_url, CASE o_orderkey % 3 WHEN 0 THEN 'indexed' WHEN 1 THEN 'unchanged' ELSE 'failed' END AS status, o_orderkey AS crawled_at FROM orders)"


def _crawled(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    status = F.when(k % 3 == 0, "indexed").when(k % 3 == 1, "unchanged").otherwise("failed")
    return _orders(spark, sf_dir).select(
        F.col("o_custkey").alias("source_id"), F.col("o_orderpriority").alias("normalized_url"), status.alias("status"), k.alias("crawled_at"), F.concat(F.lit("e"), k.cast("string")).alias("etag"),
        F.lit(None).cast("string").alias("last_modified"), F.concat(F.lit("u"), (k % 10).cast("string")).alias("canonical_url"), F.array(F.concat(F.lit("l"), (k % 5).cast("string")), F.lit("same")).alias("links"),
    )


@register(
    f"""WITH {_PAGES}, l AS (SELECT source_id, normalized_url, max(crawled_at) AS k FROM p WHERE status IN ('indexed', 'unchanged') GROUP BY 1, 2)
SELECT q.source_id, q.normalized_url, CASE WHEN k % 10 < 4 THEN 'e' || k END AS if_none_match, CAST(NULL AS VARCHAR) AS if_modified_since FROM (SELECT DISTINCT source_id, normalized_url FROM p) q LEFT JOIN l USING (source_id, normalized_url)"""
)
def conditional_recrawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _crawled(spark, sf_dir)
    live = spark.range(4).select(F.left(F.sha2(F.concat(F.lit("u"), F.col("id").cast("string")), 256), F.lit(32)).alias("document_id"))
    return L.recrawl(pages.select("source_id", "normalized_url").distinct(), pages, live)


@register(
    f"""WITH {_PAGES}, l AS (SELECT source_id, normalized_url, max(crawled_at) AS k FROM p WHERE status IN ('indexed', 'unchanged') GROUP BY 1, 2),
f AS (SELECT source_id, normalized_url, CAST(source_id % 3 AS INTEGER) AS depth FROM l WHERE source_id % 2 = 0)
SELECT DISTINCT source_id, unnest(['l' || (k % 5), 'same']) AS normalized_url, depth + 1 AS depth FROM f JOIN l USING (source_id, normalized_url) WHERE depth < 2"""
)
def unchanged_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _crawled(spark, sf_dir)
    s = F.col("source_id")
    fetched = pages.select("source_id", "normalized_url").distinct().select("*", F.when(s % 2 == 0, 304).otherwise(200).alias("http"), (s % 3).cast("int").alias("depth"))
    return L.unchanged_links(fetched, pages, 2)


@register(
    """SELECT substr(sha256(u), 1, 32) AS doc_id, u AS url, title, language, '{' || concat_ws(',', '"author":"a ""' || page_id || '"', '"description":"d\\"' || page_id || '"', CASE WHEN page_id % 2 = 0 THEN '"openGraph":{"og:title":"T' || page_id || '"}' END,
  CASE WHEN page_id % 3 = 0 THEN '"structuredData":[{"@type":"Page","n":' || page_id || '}]' END, '"sourceId":"s1"') || '}' AS metadata FROM
(SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'https://h.example/c/' || page_id ELSE url END AS u, 'T' || page_id AS title, CASE WHEN page_id % 3 = 0 THEN 'auto' ELSE 'en' END AS language FROM pages) x""".replace('a ""', "a ")
)
def crawl_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose own metadata have a description, which the extracted one replaces, and nested JSON."""
    p = F.col("page_id")
    name = lambda s: F.concat(F.lit(s), p.cast("string"))
    pages = table(spark, sf_dir, "pages").select(
        F.col("url").alias("normalized_url"), F.when(p % 2 == 0, name("https://h.example/c/")).alias("canonical_url"), name("T").alias("title"), F.col("html").alias("content"), F.array().cast("array<string>").alias("headings"),
        F.when(p % 3 != 0, "en").alias("language"), name('d"').alias("description"), F.concat(F.lit('{"description":"old","author":"a '), p.cast("string"), F.lit('"}')).alias("metadata"),
        F.when(p % 2 == 0, F.concat(F.lit('{"og:title":"T'), p.cast("string"), F.lit('"}'))).alias("open_graph"), F.when(p % 3 == 0, F.concat(F.lit('[{"@type":"Page","n":'), p.cast("string"), F.lit("}]"))).alias("structured_data"), F.lit("s1").alias("source_id"),
    )
    return L.crawl_document(pages).select("doc_id", "url", "title", "language", "metadata")


_INDEXES = "i AS (SELECT s_suppkey AS index_id, s_suppkey % 3 AS project, s_name AS name, s_suppkey % 4 = 1 AS deleting, CASE WHEN s_suppkey % 5 <> 2 THEN s_suppkey * 2 END AS active FROM supplier)"


def _indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("index_id"), (k % 3).alias("project"), F.col("s_name").alias("name"), F.when(k % 4 == 1, _now()).alias("deletion_requested_at"), F.when(k % 5 != 2, k * 2).alias("active_version_id"))


@register(
    EV
    + f""", {_INDEXES}, d AS (SELECT project, count(*) AS documents FROM documents JOIN i ON index_id = doc_id % 10 WHERE NOT deleting AND doc_id % 11 <> 0 GROUP BY 1), j AS (SELECT o_custkey % 3 AS project, count(*) AS active_jobs FROM orders WHERE o_orderstatus = 'P' GROUP BY 1),
s AS (SELECT c_custkey % 3 AS project, count(*) AS sources FROM customer WHERE c_acctbal >= 0 GROUP BY 1)
SELECT project, coalesce(documents, 0) AS documents, count(*) AS searches, round(avg(latency_ms), 6) AS avg_latency, round(count(*) FILTER (WHERE result_count = 0) / count(*), 6) AS zero_rate, coalesce(active_jobs, 0) AS active_jobs, sources FROM ev LEFT JOIN d USING (project) LEFT JOIN j USING (project) JOIN s USING (project) GROUP BY project, documents, active_jobs, sources"""
)
def project_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A project's live documents in indexes that stay, searches, active jobs and live sources."""
    from ..operators.analytics import project_overview as overview

    docs = table(spark, sf_dir, "documents").select((F.col("doc_id") % 10).alias("index_id"), F.when(F.col("doc_id") % 11 == 0, _now()).alias("deleted_at"))
    jobs = _orders(spark, sf_dir).select((F.col("o_custkey") % 3).alias("project"), F.when(F.col("o_orderstatus") == "P", "running").otherwise("completed").alias("state"))
    sources = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 3).alias("project"), F.when(F.col("c_acctbal") < 0, _now()).alias("deletion_requested_at"))
    out = overview(spark.range(3).select(F.col("id").alias("project")), docs, search_events(spark, sf_dir), jobs, sources, _indexes(spark, sf_dir))
    return out.select("project", "documents", "searches", F.round("avg_latency", 6).alias("avg_latency"), F.round("zero_rate", 6).alias("zero_rate"), "active_jobs", "sources")


@register(
    f"""WITH {_INDEXES}, v AS (SELECT p_partkey AS version_id, p_size AS sequence, p_partkey * 3 AS document_count, p_partkey * 1000 AS indexed_bytes FROM part)
SELECT project, index_id, name, sequence, document_count, indexed_bytes FROM i LEFT JOIN v ON version_id = active WHERE NOT deleting"""
)
def active_index_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The active version of each index that stays."""
    from ..operators.analytics import active_versions

    p = F.col("p_partkey")
    versions = table(spark, sf_dir, "part").select(p.alias("version_id"), F.col("p_size").alias("sequence"), (p * 3).alias("document_count"), (p * 1000).alias("indexed_bytes"), _now().alias("activated_at"))
    return active_versions(_indexes(spark, sf_dir), versions).drop("activated_at")


_TICKS, _EVERY, _START = 3, 40, "1999-02-01 00:00:00"


def _queue(spark: SparkSession, sf_dir: str) -> Q.Queue:
    """Orders as jobs in all states and customers as sources, schedules and retries."""
    k, c = F.col("o_orderkey"), F.col("c_custkey")
    orders, customers = _orders(spark, sf_dir), table(spark, sf_dir, "customer")
    state = F.when(k % 8 <= 2, "queued").when(k % 8 <= 4, "running").when(k % 8 == 5, "completed").when(k % 8 == 6, "failed").otherwise("cancelled")
    ident, at = k.cast("string").alias("job_id"), F.col("o_orderdate")
    begin = F.unix_seconds(F.lit("1999-01-01").cast("timestamp"))
    return Q.Queue(
        jobs=orders.select(ident, F.when(k % 25 == 0, "cleanup").when(k % 5 == 0, "index").otherwise("crawl").alias("type"), F.col("o_custkey").alias("source_id"), state.alias("state"), F.concat(F.lit("e"), k.cast("string")).alias("execution_id"), (k % 6 == 0).alias("cancel_requested"), at.alias("updated_at"), F.when(k % 8 >= 5, at).alias("finished_at")),
        outbox=orders.filter(k % 11 != 0).select(ident, at.alias("created_at"), F.when((k % 8 != 0) | (k % 3 == 0), at).alias("dispatched_at"), at.alias("updated_at")),
        schedules=customers.filter(c % 3 == 0).select(c.alias("source_id"), (c % 9 != 0).alias("enabled"), F.lit(21600).alias("interval_seconds"), F.timestamp_seconds(begin + c % 50).alias("next_run_at")),
        sources=customers.select(c.alias("source_id"), (F.col("c_acctbal") > 0).alias("enabled"), F.when(c % 7 == 0, F.timestamp_seconds(begin)).alias("deletion_requested_at")),
        retries=customers.filter(c % 4 == 1).select(c.alias("source_id"), F.timestamp_seconds(begin + c % 40).alias("retry_at")),
        delivered=orders.filter(k % 4 == 1).select(F.concat(F.lit("e"), k.cast("string")).alias("execution_id")),
        held=orders.filter(k % 13 == 0).select(ident),
    )


def _tick_sql(t: int) -> str:
    """Common table expressions of tick ``t``; tables j, o, s, d with its number are those it leaves."""
    p, now = t - 1, f"(TIMESTAMP '{_START}' + INTERVAL {_EVERY * (t - 1)} SECOND)"
    text = f"CAST(CAST(epoch({now}) AS BIGINT) AS VARCHAR)"
    run = lambda job: f"sha256({job} || ':' || {text})"
    new = lambda n, wanted, jobs, box: f"""w{n} AS MATERIALIZED (SELECT source_id, sha256('crawl:' || source_id || ':' || {text}) AS job_id FROM {wanted} WHERE source_id NOT IN (SELECT source_id FROM {jobs} WHERE type = 'crawl' AND state IN ('queued', 'running'))),
j{n} AS MATERIALIZED (SELECT * FROM {jobs} UNION ALL SELECT job_id, 'crawl', source_id, 'queued', {run('job_id')}, false, {now}, NULL FROM w{n}),
o{n} AS MATERIALIZED (SELECT * FROM {box} UNION ALL SELECT job_id, {now}, NULL, {now} FROM w{n})"""  # noqa: E731
    return f"""
due{t} AS MATERIALIZED (SELECT DISTINCT source_id FROM (SELECT source_id FROM retries JOIN live USING (source_id) WHERE retry_at <= {now} ORDER BY retry_at, source_id LIMIT 25) x),
{new(f'{t}a', f'due{t}', f'j{p}', f'o{p}')},
run{t} AS MATERIALIZED (SELECT source_id FROM s{p} WHERE enabled AND next_run_at <= {now} ORDER BY next_run_at, source_id LIMIT 25),
s{t} AS MATERIALIZED (SELECT source_id, enabled, CASE WHEN source_id IN (SELECT source_id FROM run{t}) THEN {now} + INTERVAL 21600 SECOND ELSE next_run_at END AS next_run_at FROM s{p}),
{new(f'{t}b', f'(SELECT source_id FROM run{t} JOIN live USING (source_id)) y', f'j{t}a', f'o{t}a')},
old{t} AS MATERIALIZED (SELECT job_id FROM (SELECT job_id FROM j{t}b JOIN o{t}b USING (job_id) WHERE state = 'running' AND NOT cancel AND type IN ('crawl', 'index') AND j{t}b.updated_at <= {now} - INTERVAL 120 SECOND ORDER BY j{t}b.updated_at, job_id LIMIT 25) z WHERE job_id NOT IN (SELECT job_id FROM held)),
j{t} AS MATERIALIZED (SELECT job_id, type, source_id, CASE WHEN hit THEN 'queued' ELSE state END AS state, CASE WHEN hit THEN {run('job_id')} ELSE execution_id END AS execution_id, cancel, CASE WHEN hit THEN {now} ELSE updated_at END AS updated_at, CASE WHEN NOT hit THEN finished_at END AS finished_at FROM (SELECT *, job_id IN (SELECT job_id FROM old{t}) AS hit FROM j{t}b) h),
o{t}c AS MATERIALIZED (SELECT job_id, created_at, CASE WHEN NOT hit THEN dispatched_at END AS dispatched_at, CASE WHEN hit THEN {now} ELSE updated_at END AS updated_at FROM (SELECT *, job_id IN (SELECT job_id FROM old{t}) AS hit FROM o{t}b) h),
send{t} AS MATERIALIZED (SELECT job_id FROM o{t}c WHERE dispatched_at IS NULL ORDER BY created_at, job_id LIMIT 25),
sent{t} AS MATERIALIZED (SELECT job_id, execution_id FROM j{t} WHERE job_id IN (SELECT job_id FROM send{t}) AND state = 'queued' AND NOT cancel),
o{t}d AS MATERIALIZED (SELECT job_id, created_at, CASE WHEN hit THEN {now} ELSE dispatched_at END AS dispatched_at, CASE WHEN hit THEN {now} ELSE updated_at END AS updated_at FROM (SELECT *, job_id IN (SELECT job_id FROM send{t}) AS hit FROM o{t}c) h),
look{t} AS MATERIALIZED (SELECT o.job_id FROM o{t}d o JOIN j{t} j ON j.job_id = o.job_id WHERE dispatched_at IS NOT NULL AND state = 'queued' AND NOT cancel AND o.updated_at <= {now} - INTERVAL 30 SECOND ORDER BY o.updated_at, o.job_id LIMIT 25),
d{t}a AS MATERIALIZED (SELECT execution_id FROM d{p} UNION SELECT execution_id FROM sent{t}),
again{t} AS MATERIALIZED (SELECT job_id, execution_id FROM j{t} WHERE job_id IN (SELECT job_id FROM look{t}) AND execution_id NOT IN (SELECT execution_id FROM d{t}a)),
d{t} AS MATERIALIZED (SELECT execution_id FROM d{t}a UNION SELECT execution_id FROM again{t}),
o{t}e AS MATERIALIZED (SELECT job_id, created_at, dispatched_at, CASE WHEN job_id IN (SELECT job_id FROM look{t}) THEN {now} ELSE updated_at END AS updated_at FROM o{t}d),
gone{t} AS MATERIALIZED (SELECT job_id FROM o{t}e JOIN j{t} USING (job_id) WHERE dispatched_at IS NOT NULL AND state IN ('completed', 'failed', 'cancelled') AND finished_at <= {now} - INTERVAL 7 DAY ORDER BY finished_at, job_id LIMIT 250),
o{t} AS MATERIALIZED (SELECT * FROM o{t}e WHERE job_id NOT IN (SELECT job_id FROM gone{t}))"""


_QUEUE_SQL = (
    """WITH j0 AS MATERIALIZED (SELECT CAST(o_orderkey AS VARCHAR) AS job_id, CASE WHEN o_orderkey % 25 = 0 THEN 'cleanup' WHEN o_orderkey % 5 = 0 THEN 'index' ELSE 'crawl' END AS type, o_custkey AS source_id,
  CASE WHEN o_orderkey % 8 <= 2 THEN 'queued' WHEN o_orderkey % 8 <= 4 THEN 'running' WHEN o_orderkey % 8 = 5 THEN 'completed' WHEN o_orderkey % 8 = 6 THEN 'failed' ELSE 'cancelled' END AS state, 'e' || o_orderkey AS execution_id, o_orderkey % 6 = 0 AS cancel,
  CAST(o_orderdate AS TIMESTAMP) AS updated_at, CASE WHEN o_orderkey % 8 >= 5 THEN CAST(o_orderdate AS TIMESTAMP) END AS finished_at FROM orders),
o0 AS MATERIALIZED (SELECT CAST(o_orderkey AS VARCHAR) AS job_id, CAST(o_orderdate AS TIMESTAMP) AS created_at, CASE WHEN o_orderkey % 8 <> 0 OR o_orderkey % 3 = 0 THEN CAST(o_orderdate AS TIMESTAMP) END AS dispatched_at, CAST(o_orderdate AS TIMESTAMP) AS updated_at FROM orders WHERE o_orderkey % 11 <> 0),
s0 AS MATERIALIZED (SELECT c_custkey AS source_id, c_custkey % 9 <> 0 AS enabled, TIMESTAMP '1999-01-01' + to_seconds(c_custkey % 50) AS next_run_at FROM customer WHERE c_custkey % 3 = 0),
live AS MATERIALIZED (SELECT c_custkey AS source_id FROM customer WHERE c_acctbal > 0 AND c_custkey % 7 <> 0),
retries AS MATERIALIZED (SELECT c_custkey AS source_id, TIMESTAMP '1999-01-01' + to_seconds(c_custkey % 40) AS retry_at FROM customer WHERE c_custkey % 4 = 1),
d0 AS MATERIALIZED (SELECT 'e' || o_orderkey AS execution_id FROM orders WHERE o_orderkey % 4 = 1),
held AS MATERIALIZED (SELECT CAST(o_orderkey AS VARCHAR) AS job_id FROM orders WHERE o_orderkey % 13 = 0),"""
    + ",".join(_tick_sql(t) for t in range(1, _TICKS + 1))
    + "".join(f"\n{'UNION ALL ' if t > 1 else ''}SELECT 'dispatch' AS what, {t} AS tick, job_id, execution_id AS detail FROM sent{t} UNION ALL SELECT 'reconcile', {t}, job_id, execution_id FROM again{t}" for t in range(1, _TICKS + 1))
    + f"""
UNION ALL SELECT 'job', {_TICKS}, job_id, concat_ws(',', type, source_id, state, execution_id, epoch_us(updated_at), epoch_us(finished_at)) FROM j{_TICKS}
UNION ALL SELECT 'outbox', {_TICKS}, job_id, concat_ws(',', epoch_us(created_at), epoch_us(dispatched_at), epoch_us(updated_at)) FROM o{_TICKS}
UNION ALL SELECT 'schedule', {_TICKS}, CAST(source_id AS VARCHAR), CAST(epoch_us(next_run_at) AS VARCHAR) FROM s{_TICKS}"""
)


@register(_QUEUE_SQL)
def queue_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What three ticks of the queue send, and its tables afterwards."""
    q, out = _queue(spark, sf_dir), None
    for t in range(1, _TICKS + 1):
        now = F.timestamp_seconds(F.unix_seconds(F.lit(_START).cast("timestamp")) + _EVERY * (t - 1))
        q, sent = Q.tick(q, now)
        q = Q.cut(q)
        sent = sent.select(F.col("step").alias("what"), F.lit(t).alias("tick"), "job_id", F.col("execution_id").alias("detail"))
        out = sent if out is None else out.unionByName(sent)
    micros = lambda c: F.unix_micros(c).cast("string")
    last = F.lit(_TICKS).alias("tick")
    jobs = q.jobs.select(F.lit("job").alias("what"), last, "job_id", F.concat_ws(",", "type", F.col("source_id").cast("string"), "state", "execution_id", micros("updated_at"), micros("finished_at")).alias("detail"))
    box = q.outbox.select(F.lit("outbox").alias("what"), last, "job_id", F.concat_ws(",", micros("created_at"), micros("dispatched_at"), micros("updated_at")).alias("detail"))
    plans = q.schedules.select(F.lit("schedule").alias("what"), last, F.col("source_id").cast("string").alias("job_id"), micros("next_run_at").alias("detail"))
    return out.unionByName(jobs).unionByName(box).unionByName(plans)
