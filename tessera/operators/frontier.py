"""Crawl order: which pages a crawl visits, in which order, and when each may start.

Pages are scheduled in generations.  The first are retries that are due, addresses of sitemaps
and starts, in this order; the next are links of the last, in order of the page that
has them and of their place in it.  A page is scheduled once, where it is met first,
and takes its depth from there; links are followed up to a depth, and scheduling ends when
the crawl's quota is full.

Every generation is written once and read from there, so a plan doesn't hold the ones before
it, however deep the crawl goes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import checkpointed
from .ranks import ranked

#: Generations that are kept apart before they are written together.
MERGE = 8


def merged(parts: list[DataFrame]) -> list[DataFrame]:
    """Few tables in place of many, so looking up what was seen doesn't list them all."""
    return [checkpointed(reduce(DataFrame.unionByName, parts))] if len(parts) >= MERGE else parts


def crawl_order(seeds: DataFrame, links: DataFrame, most_depth: int, most_pages: int) -> DataFrame:
    """(node, depth, attempt, generation, place): the pages of a crawl; ``place`` counts from 0.

    ``seeds`` has node, kind (0 for due retries, 1 for sitemaps, 2 for starts), at (the order
    within a kind), depth and attempt; ``links`` has a, b and at, the link's place in its page.
    """
    first = F.min(F.struct("kind", "at", "depth", "attempt")).alias("x")
    found = seeds.groupBy("node").agg(first).select("node", "x.kind", "x.at", "x.depth", "x.attempt")
    edge = ranked(found, [], ["kind", "at", "node"]).filter(F.col("rank") < most_pages)
    edge = checkpointed(edge.select("node", F.col("depth").cast("int").alias("depth"), F.col("attempt").cast("int").alias("attempt"), F.lit(0).alias("generation"), F.col("rank").alias("place")))
    parts, count, generation = [edge], edge.count(), 0
    while count < most_pages:
        generation += 1
        out = edge.filter(F.col("depth") < most_depth).select(F.col("node").alias("a"), "depth", "place").join(links, "a")
        met = out.groupBy(F.col("b").alias("node")).agg(F.min(F.struct("place", "at", (F.col("depth") + 1).alias("depth"))).alias("x"))
        for seen in parts:
            met = met.join(seen.select("node"), "node", "left_anti")
        met = checkpointed(met.select("node", F.col("x.place").alias("parent"), "x.at", "x.depth"))
        new = ranked(met, [], ["parent", "at", "node"]).withColumn("place", F.col("rank") + count).filter(F.col("place") < most_pages)
        edge = checkpointed(new.select("node", "depth", F.lit(1).alias("attempt"), F.lit(generation).alias("generation"), "place"))
        n = edge.count()
        if not n:
            break
        count += n
        parts = merged([*parts, edge])
    return reduce(DataFrame.unionByName, parts)


def start_times(pages: DataFrame, delays: DataFrame, order: list[str]) -> DataFrame:
    """``starts`` in milliseconds for each page (host, ready): pages of a host start one after the other.

    A page starts when it is ready and its host's delay has passed since the one before it, that is
    at the largest of ``ready + delay`` times the number of pages in between, over all pages up to it:
    a running maximum.  ``delays`` (host, delay) is in milliseconds; hosts without one have no gate.
    A host with a third of all pages is dealt to many tasks.
    """
    placed = ranked(pages, ["host"], order, of_group=delays.select("host", F.col("delay").alias("__d")))
    delay = F.coalesce("__d", F.lit(0))
    own = placed.withColumns({"__v": F.col("ready") - F.col("rank") * delay, "__gate": F.col("rank") * delay})
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = checkpointed(own.repartitionByRange(n, "host", "rank").withColumn("__part", F.spark_partition_id()))
    earlier = Window.partitionBy("host").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.groupBy("host", "__part").agg(F.max("__v").alias("__m")).select("host", "__part", F.max("__m").over(earlier).alias("__before"))
    run = F.max("__v").over(Window.partitionBy("host", "__part").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    out = parts.withColumn("__run", run).join(before, ["host", "__part"])
    # Without a delay a page starts when it is ready, whatever its host's other pages do.
    starts = F.when(delay > 0, F.greatest("__run", F.coalesce("__before", F.col("__run"))) + F.col("__gate")).otherwise(F.col("ready"))
    return out.select(*pages.columns, F.col("rank").alias("turn"), starts.alias("starts"))
