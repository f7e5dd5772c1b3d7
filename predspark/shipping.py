"""Python workers need this package: by their path, or as a zip that is sent to them."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the session's Python workers, unless the path they start with has it."""
    sc = spark.sparkContext
    path = (sc._jvm.java.lang.System.getenv("PYTHONPATH") or "").split(":")
    local = sc.master.startswith("local") and not sc.master.startswith("local-cluster") and os.getcwd() == _ROOT
    if _ROOT in path or local or sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    target = os.path.join(tempfile.mkdtemp(), "predspark.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(os.path.join(_ROOT, "predspark")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, _ROOT))
    sc.addPyFile(target)
