"""Session defaults and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(master: str | None = None, app: str = "relievo", **conf) -> SparkSession:
    """A session with the settings the operators are planned for.

    Partition counts are left to AQE: `spark.sql.shuffle.partitions` is only the upper
    bound that AQE coalesces from, so a cluster passes a large one and a laptop a small one.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        # Call-site capture on every column expression costs more than planning itself.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    settings.update({k: str(v) for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def workspace(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under the shared checkpoint directory of this session.

    The folder comes from `spark.checkpoint.dir`. A local folder is made only for a local
    master, where the driver and the executors share one disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return os.path.join(base, f"{purpose}-{uuid.uuid4().hex[:12]}")


def materialise(df, purpose: str):
    """Write `df` to the shared folder and read it back.

    Used where one result feeds several jobs: it cuts lineage and, unlike a cache or a local
    checkpoint, survives the loss of executors.
    """
    spark = df.sparkSession
    path = workspace(spark, purpose)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
