"""Sessions with the settings that the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, name: str = "tessera", **conf: object) -> SparkSession:
    """A session in UTC with adaptive execution; ``conf`` adds settings (``__`` stands for a dot).

    Shuffle partitions are left to the cluster's own setting and to adaptive
    coalescing, so the same code runs on one machine and on a thousand executors.
    """
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    builder = builder.config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
