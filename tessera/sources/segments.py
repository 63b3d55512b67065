"""Immutable index versions as folders of Parquet tables, with a manifest written last.

A version is published by its manifest: a folder without one isn't a version, so a
failed build leaves nothing that a reader would find.  Versions are never overwritten: a writer
first claims the version's name and its number, and only one can.  The pointer to the active
version is the highest numbered file of a folder; it is swapped by creating the next one, which
only one writer can, so activation and rollback compare what they expect with what is there.
A fence, raised when documents are erased, keeps older versions from becoming active.  Paths go
through Spark, so any store that it can reach will do.

Postings, the deletion dictionary and the prefix table lie in buckets of their keys, sorted by
key: a lookup lists only its keys' buckets, whose size doesn't grow with the vocabulary, and
reads only pages that may hold them.
"""

from __future__ import annotations

import json
import math
import re
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import checkpointed
from ..operators.index import Index, averages, bucket_of, checksum, dictionary, prefix_table, typo_dictionary
from ..settings import Arabic, IndexSettings
from . import claims

_NAME = re.compile(r"[A-Za-z0-9_-]+")
TABLES = ("docs", "postings", "lengths", "dictionary", "averages")
#: Tables for typos and prefixes; they follow from the dictionary and may be added to a version later.
LOOKUPS = ("variants", "prefixes")
MANIFEST = "index_id string, version string, sequence long, n_docs long, settings string, checksums string, buckets string"
#: Keys of tables that are kept in buckets, and rows of a bucket.
KEYS = {"postings": "term", "variants": "variant", "prefixes": "prefix"}
BUCKET_ROWS = 1 << 18
#: Bytes of a row group and of a page: small ones can be passed over.
GROUP_BYTES, PAGE_BYTES = 8 << 20, 64 << 10


def _place(root: str, index_id: str, version: str) -> str:
    for name in (index_id, version):
        if not _NAME.fullmatch(name):
            raise ValueError(f"not a valid name: {name!r}")
    return f"{root}/{index_id}/{version}"


def _sorted_write(df: DataFrame, place: str, by: list[str]) -> None:
    """Writes a table in ranges of its keys, each sorted.

    Ranges are of a key and, where one is frequent, of its documents, so no task has all postings
    of a stop word.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    _written(df.repartitionByRange(tasks, *by).sortWithinPartitions(*by), place, "bucket" in by)


def _write_postings(df: DataFrame, place: str, buckets: int) -> None:
    """Writes postings by bucket, sorted.  A bucket is one task's; one that a frequent term makes larger
    is dealt to several by document, so its parts are sorted each."""
    sizes = df.groupBy("bucket").count()
    large = sizes.select("bucket", F.ceil(F.col("count") / (4 * BUCKET_ROWS)).cast("int").alias("__parts")).filter("__parts > 1")
    dealt = df.join(F.broadcast(large), "bucket", "left")  # at most one row for so many postings
    part = F.pmod(F.xxhash64("doc_id"), F.coalesce("__parts", F.lit(1)))
    tasks = max(buckets, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sorted_ = dealt.repartition(tasks, "bucket", part).drop("__parts").sortWithinPartitions("bucket", "term", "doc_id")
    _written(sorted_, place, True)


def _written(df: DataFrame, place: str, bucketed: bool) -> None:
    out = df.write.mode("errorifexists").option("parquet.block.size", GROUP_BYTES).option("parquet.page.size", PAGE_BYTES)
    (out.partitionBy("bucket") if bucketed else out).parquet(place)


def _buckets(rows: int) -> int:
    return max(1, -(-rows // BUCKET_ROWS))


def write_version(index: Index, root: str, index_id: str, version: str, lookups: tuple[str, ...] = LOOKUPS) -> str:
    """Claims the version's name and number, writes all tables, then the manifest.

    The smaller tables are independent jobs over the written postings and run side by side.
    """
    place, spark = _place(root, index_id, version), index.docs.sparkSession
    if not claims.put(spark, f"{place}/claim", uuid.uuid4().hex):
        raise ValueError(f"the version {version} exists or is being written")
    sequence = claims.next_number(spark, f"{root}/{index_id}/sequence", version)
    most = index.settings.max_distance
    buckets = {"postings": _buckets(index.postings.count())}
    _write_postings(index.postings.withColumn("bucket", bucket_of(F.col("term"), buckets["postings"])), f"{place}/postings", buckets["postings"])
    stored = spark.read.parquet(f"{place}/postings")
    words = checkpointed(dictionary(stored))
    vocabulary = checkpointed(words.groupBy("term").agg(F.sum("df").alias("df")))
    # A term of n letters has at most this many variants, a word's prefixes are its letters.
    n = F.length("term").cast("long")
    variants = F.lit(1) + sum((_choose(n, k) for k in range(1, most + 1)), F.lit(0))
    buckets["variants"], buckets["prefixes"] = (_buckets(int(x or 0)) for x in vocabulary.agg(F.sum(variants), F.sum(n)).first())

    def lengths_and_averages() -> None:
        # As they were made, a text's postings lie together, so counts combine before the shuffle.
        index.lengths.write.mode("errorifexists").parquet(f"{place}/lengths")
        averages(spark.read.parquet(f"{place}/lengths"), index.n_docs).coalesce(1).write.mode("errorifexists").parquet(f"{place}/averages")
        summed("lengths")

    sums: dict[str, str] = {}

    def summed(name: str) -> None:
        sums[name] = checksum(spark.read.parquet(f"{place}/{name}"))

    def sorted_words() -> None:
        _sorted_write(words, f"{place}/dictionary", ["term", "field"])
        summed("dictionary")

    jobs = [
        *(lambda name=name: _write_lookup(vocabulary, place, name, buckets[name], most) for name in lookups),
        lambda: summed("postings"),
        sorted_words,
        lengths_and_averages,
        lambda: index.docs.write.mode("errorifexists").parquet(f"{place}/docs"),
    ]
    with ThreadPoolExecutor(len(jobs)) as pool:
        for done in [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]:
            done.result()
    row = (index_id, version, sequence, index.n_docs, index.settings.json(), json.dumps(sums, sort_keys=True), json.dumps(buckets))
    spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("errorifexists").parquet(f"{place}/manifest")
    return place


def _write_lookup(vocabulary: DataFrame, place: str, name: str, buckets: int, most: int) -> None:
    df, by = (typo_dictionary(vocabulary, most), ["variant", "term"]) if name == "variants" else (prefix_table(vocabulary), ["prefix", "place"])
    df = df.withColumn("bucket", bucket_of(F.col(KEYS[name]), buckets))
    _written(df.repartition("bucket").sortWithinPartitions("bucket", *by), f"{place}/{name}", True)


def _has(spark: SparkSession, place: str, name: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{place}/{name}/_SUCCESS")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def write_lookup(spark: SparkSession, root: str, index_id: str, version: str, name: str) -> None:
    """Adds one of ``LOOKUPS`` to a published version, unless it is there."""
    place = _place(root, index_id, version)
    if _has(spark, place, name):
        return
    index = read_version(spark, root, index_id, version, check=False)
    _write_lookup(checkpointed(index.vocabulary), place, name, index.buckets[name], index.settings.max_distance)


def _choose(n: Column, k: int) -> Column:
    """n over k."""
    out = F.lit(1)
    for i in range(k):
        out = out * (n - i)
    return F.greatest(F.floor(out / math.factorial(k)), F.lit(0))


def manifests(spark: SparkSession, root: str, index_id: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{index_id}/*/manifest")


def read_version(spark: SparkSession, root: str, index_id: str, version: str, check: bool = True) -> Index:
    """An index version; with ``check`` its checksums and document count are compared with the manifest."""
    place = _place(root, index_id, version)
    m = spark.read.parquet(f"{place}/manifest").first()
    raw = json.loads(m.settings)
    raw["arabic"] = Arabic(**raw["arabic"])
    settings = IndexSettings(**raw)
    tables = {name: spark.read.parquet(f"{place}/{name}") for name in (*TABLES, *(name for name in LOOKUPS if _has(spark, place, name)))}
    if check:
        if tables["docs"].count() != m.n_docs:
            raise ValueError("the document count differs from the manifest")
        for name, expected in json.loads(m.checksums).items():
            if checksum(tables[name]) != expected:
                raise ValueError(f"the checksum of {name} differs from the manifest")
    return Index(n_docs=m.n_docs, settings=settings, buckets=json.loads(m.buckets), **tables)


class Conflict(ValueError):
    """Another writer was faster."""


def activate(spark: SparkSession, root: str, index_id: str, version: str, expected: str | None = None) -> None:
    """Makes a published version the active one; also for going back to an older one, unless a fence forbids it.

    With ``expected`` only if that is the active version still; a ``Conflict`` changes nothing.
    """
    own = spark.read.parquet(f"{_place(root, index_id, version)}/manifest").first()
    while True:
        last = max([0, *claims.numbers(spark, f"{root}/{index_id}/active")])
        if expected is not None and active_version(spark, root, index_id) != expected:
            raise Conflict(f"{expected} isn't the active version")
        if own.sequence < minimum_sequence(spark, root, index_id):
            raise ValueError("the version predates an erasure")
        if claims.put(spark, f"{root}/{index_id}/active/{last + 1}", version):
            return


def raise_fence(spark: SparkSession, root: str, index_id: str) -> int:
    """Forbids all versions there are, also those still being written; returns the least number that may become active."""
    least = max([0, *claims.numbers(spark, f"{root}/{index_id}/sequence")]) + 1
    claims.put(spark, f"{root}/{index_id}/fence/{least}", "")
    return least


def minimum_sequence(spark: SparkSession, root: str, index_id: str) -> int:
    return max([0, *claims.numbers(spark, f"{root}/{index_id}/fence")])


def copied(spark: SparkSession, root: str, index_id: str, version: str, to: str) -> str:
    """A version's tables and manifest copied to another root, for a backup or from one, and checked there."""
    source, place = _place(root, index_id, version), _place(to, index_id, version)
    for name in (*TABLES, *(name for name in LOOKUPS if _has(spark, source, name)), "manifest"):
        df = spark.read.parquet(f"{source}/{name}")
        out = df.write.mode("errorifexists")
        (out.partitionBy("bucket") if "bucket" in df.columns else out).parquet(f"{place}/{name}")
    read_version(spark, to, index_id, version)
    return place


def active_version(spark: SparkSession, root: str, index_id: str) -> str | None:
    last = claims.numbers(spark, f"{root}/{index_id}/active")
    return claims.read(spark, f"{root}/{index_id}/active/{last[-1]}") if last else None


class VersionCache:
    """Index versions read and checked before, at most ``size`` of them; the one not used for longest goes first.

    A version is known by what its manifest says of its tables, so one that was replaced by other
    means is read again.
    """

    def __init__(self, size: int = 32):
        self.size, self.held = size, {}

    def get(self, spark: SparkSession, root: str, index_id: str, version: str) -> Index:
        m = spark.read.parquet(f"{_place(root, index_id, version)}/manifest").first()
        key = (root, index_id, version, m.sequence, m.checksums)
        index = self.held.pop(key, None) or read_version(spark, root, index_id, version)
        self.held[key] = index
        while len(self.held) > self.size:
            del self.held[next(iter(self.held))]
        return index
