"""Where intermediate tables live: the shared folder that the cluster names in ``spark.checkpoint.dir``.

Tables written here survive the loss of any executor. A machine-local folder is used only where the setting is absent
and Spark runs within one machine's process, as in tests; on a cluster the setting is required.
"""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    named = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if not named and re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) is None:
        raise ValueError(f"{SETTING} must name a folder that driver and executors share")
    return named or os.path.join(tempfile.gettempdir(), "checkpoints")


def store(df: DataFrame, label: str, by: str | None = None, codec: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return it read back: lineage ends here.

    With ``by``, each value of that column has a folder of its own, and a filter on it reads no other. Without ``codec``,
    the session's compression holds.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/courtlens-{label}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path, compression=codec)
    out = spark.read.schema(df.schema).parquet(path)
    out._courtlens_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by :func:`store` that no later plan reads.

    Spark drops shuffle files when the driver's garbage collector finds their plans gone; asking for a collection here
    keeps the files of finished steps from piling up.
    """
    path = getattr(df, "_courtlens_path", None)
    if path is None:
        return
    context = df.sparkSession.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)
    gc.collect()
    context._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
