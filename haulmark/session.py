"""Session settings that the engine is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC for comparable timestamps; adaptive plans, so that shuffle partitions are coalesced and skewed joins split.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
    # what loops have written goes with the frames that read it
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def session(app: str = "haulmark", master: str | None = None, **more: str) -> SparkSession:
    """A session with SETTINGS; `more` by setting name with '__' for '.'."""
    builder = SparkSession.builder.appName(app).config(map=SETTINGS | {k.replace("__", "."): v for k, v in more.items()})
    return (builder.master(master) if master else builder).getOrCreate()
