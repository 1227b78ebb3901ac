"""Where a job may write what it reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names, which
    driver and executors share. Only a local session may do without one: it
    gets a temporary folder, recorded in the session."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tideloom-"))
        at = sc.getCheckpointDir()
    return f"{at.rstrip('/')}/{uuid.uuid4().hex}"
