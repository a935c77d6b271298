"""Session settings that the plans count on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "tallygraph", **more: str) -> SparkSession:
    """A session in UTC with adaptive plans; ``more`` are further settings, with _ for the dots."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC")
    b = b.config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for key, value in more.items():
        b = b.config(key.replace("_", "."), value)
    return b.getOrCreate()
