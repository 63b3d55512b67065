"""Places of rows in ordered groups, without a task for each group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import checkpointed


def ranked(df: DataFrame, group: Sequence[str], order: Sequence[str], of_group: DataFrame | None = None) -> DataFrame:
    """``df`` with ``rank``: how many rows of the same group (columns that aren't null) come before in the given order.

    Equal rows get different ranks, in any order.  Rows are dealt by ranges of group and order,
    so a group with a third of all rows lies in many ranges, and are numbered within their range;
    what other ranges hold before it is a count for each.  Columns of ``of_group``, a table with
    at most one row for each group, come along with these counts (null where it has none), so that
    rows aren't joined by a hot group.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = df.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(n, *group, *order, "__tie").withColumn("__part", F.spark_partition_id())
    parts = checkpointed(parts)  # the ranges are drawn anew by every job
    earlier = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.groupBy("__part", *group).agg(F.count("*").alias("__n")).select("__part", *group, F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    if of_group is not None:
        before = before.join(of_group, [*group], "left")
    own = F.row_number().over(Window.partitionBy("__part", *group).orderBy(*order, "__tie"))
    numbered = parts.withColumn("__own", own).join(before, ["__part", *group])
    return numbered.withColumn("rank", F.col("__before") + F.col("__own") - 1).drop("__tie", "__part", "__own", "__before")
