"""Session settings that suit the operators."""

from __future__ import annotations

# Joins by (document, group) may use data that is already dealt by document; skewed joins are split; small partitions are merged.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Patterns over text cost far more CPU a byte than what the default of 1 MB is meant for.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128k",
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def apply(spark) -> None:
    """Sets the recommended values on a session; the number of shuffle partitions stays the cluster's choice."""
    for key, value in RECOMMENDED.items():
        spark.conf.set(key, value)
