"""Session options the plans count on. A cluster sets its own sizes; these are the switches."""

from __future__ import annotations

from pyspark.sql import SparkSession

OPTIONS = {
    "spark.sql.session.timeZone": "UTC",
    # Run-time re-planning: partition sizing, measured broadcast, split of oversized join tasks.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # Drop probe rows before they are shuffled when the other join side is small.
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    # Only the folders that receive rows are replaced by a keyed upsert.
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(app: str = "martwright", **extra: str) -> SparkSession:
    """Session with the library's switches; ``extra`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    for key, value in {**OPTIONS, **{k.replace("__", "."): v for k, v in extra.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
