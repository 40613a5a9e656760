"""What every plan needs from the session: tables, lineage cuts and a test session."""

from __future__ import annotations

import os
import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and the bench."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("docsight")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def settle(spark: SparkSession) -> SparkSession:
    """Unions here do not pass on their children's partitioning: adaptive execution may coalesce the children
    differently and the query then fails with "Can't zip RDDs with unequal numbers of partitions" (seen with Spark 4.1.2)."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    return spark


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return settle(spark).read.parquet(f"{directory}/{name}.parquet")


def _folder(spark: SparkSession) -> str:
    """The folder that all machines share: ``spark.checkpoint.dir`` of the session. Only where none is set, as in tests on one machine, it is a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir", "")
        if not folder:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = os.path.join(tempfile.gettempdir(), f"docsight-checkpoints-{os.getpid()}")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for tables of one run below the shared one."""
    return f"{_folder(spark)}/{name}-{uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder of the cluster."""
    _folder(settle(df.sparkSession))
    return df.checkpoint(eager=True)
