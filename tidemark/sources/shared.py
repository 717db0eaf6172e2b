"""The folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset and everything runs in one
    process (tests), a temporary folder is made; on a cluster without the setting this raises ValueError."""
    sc = spark.sparkContext
    set_to = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if set_to:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(set_to)
        return set_to.rstrip("/")
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
    return sc.getCheckpointDir().rstrip("/")


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
