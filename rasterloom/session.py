"""Sessions: settings that hold at every size."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Adaptive plans, which size shuffles and split skewed joins as they run; ANSI errors for bad indexes and divisors.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, **settings: str) -> SparkSession:
    """A session with the package's settings; ``settings`` have ``_`` for ``.`` in their names."""
    builder = SparkSession.builder.appName("rasterloom")
    if master:
        builder = builder.master(master)
    for k, v in (SETTINGS | {k.replace("_", "."): v for k, v in settings.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
