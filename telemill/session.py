"""Session settings that results depend on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def configure(spark: SparkSession) -> SparkSession:
    """UTC buckets, and the last of equal map keys wins; projections too long for the JVM's compiler are generated in parts."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


def require_utc(spark: SparkSession) -> None:
    """Buckets of another time zone would silently be wrong."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone not in ("UTC", "Etc/UTC", "Z", "+00:00"):
        raise ValueError(f"spark.sql.session.timeZone has to be UTC, not {zone}")
