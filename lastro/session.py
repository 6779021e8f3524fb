"""Makes the package known to Python workers."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[1])


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder that the driver and all executors see, which goes when the application ends."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if sc.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file:///tmp/lastro-shared"
    own = f"{base.rstrip('/')}/lastro-{sc.applicationId}"
    path = sc._jvm.org.apache.hadoop.fs.Path(own)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(path)
    return f"{own}/{what}-{uuid.uuid4().hex}"
