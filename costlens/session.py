"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import SparkSession

# Recommended settings; cluster-sized values (executors, memory, shuffle
# partitions, advisory size) belong to spark-submit.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def builder(app_name: str = "costlens") -> SparkSession.Builder:
    out = SparkSession.builder.appName(app_name)
    for key, value in RECOMMENDED.items():
        out = out.config(key, value)
    return out


@cache
def _local_scratch() -> tempfile.TemporaryDirectory:
    """A folder that goes when this process ends."""
    return tempfile.TemporaryDirectory(prefix="costlens-", ignore_cleanup_errors=True)


def scratch_dir(spark: SparkSession) -> str:
    """A new folder name under the shared folder of ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its own.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        shared = _local_scratch().name
    return f"{shared.rstrip('/')}/{uuid.uuid4().hex}"
