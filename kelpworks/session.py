"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def build_session(master: str = "local[8]", app: str = "kelpworks", **conf: str) -> SparkSession:
    """A session with the settings that all queries assume (UTC, AQE, Arrow)."""
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Parsing is much work for few bytes, so small partitions are worth a task.
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128KB",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    } | ({"spark.sql.shuffle.partitions": "8"} if master.startswith("local") else {}) | conf  # a cluster's own setting stays
    builder = SparkSession.builder.master(master).appName(app)
    for k, v in base.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir.

    Only where neither that setting nor a checkpoint folder exists (tests, local mode) a
    temporary one is made; on a cluster the setting must name shared storage.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        current = sc._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), f"kelpworks-{sc.applicationId}")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(named)
    return named


def cut(df, eager: bool = True):
    """Cuts the lineage of df with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=eager)
