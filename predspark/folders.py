"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

_local: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a temporary folder on a local master."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if sc.applicationId not in _local:
        _local[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="predspark-")
        sc.setCheckpointDir(_local[sc.applicationId])
    return _local[sc.applicationId]
