"""Let Python workers on this machine import the package from where the driver has it.

On a cluster the package is installed or shipped (--py-files); a local session started elsewhere needs only the path.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def reach(spark: SparkSession) -> SparkSession:
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])
    return spark
