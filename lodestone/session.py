"""Session defaults shared by tests, the benchmark and scripts."""

import os
from pathlib import Path

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.cteRecursionLevelLimit": "500",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "6g") -> SparkSession:
    """A local session with the engine's settings; on a cluster, apply SETTINGS to its own builder."""
    builder = SparkSession.builder.master(f"local[{cpus}]").config(map=SETTINGS)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions)).config("spark.driver.memory", memory)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def let_workers_import(spark: SparkSession) -> None:
    """Makes Python workers look for this library where the driver has it; on a cluster ship it with --py-files."""
    environment, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[1])
    found = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in found:
        environment["PYTHONPATH"] = os.pathsep.join([root, *found])
