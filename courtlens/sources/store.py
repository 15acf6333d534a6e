"""Tables that later plans read again, in the folder that the cluster shares."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in ``spark.checkpoint.dir``; a machine-local one only where that is unset and Spark is local, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) is None:
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{(named or os.path.join(tempfile.gettempdir(), 'checkpoints')).rstrip('/')}/courtlens-{label}-{uuid.uuid4().hex}"
