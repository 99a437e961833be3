"""Tables written in the folder that driver and executors share, to cut lineage and survive lost executors."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.sources.shared import shared_folder

#: Shuffle files of a finished write are of no use; without it they stay until the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Seconds between two collections of the driver's garbage.
TIDY_S = 3
_tidied = 0.0


def tidy(spark: SparkSession) -> None:
    """Gives memory of the driver's finished plans and stages back to the system; its heap would keep all it ever had."""
    global _tidied
    if time.monotonic() - _tidied >= TIDY_S:
        spark._jvm.System.gc()
        _tidied = time.monotonic()


class Workspace:
    """A folder of Parquet tables for one run of an operator.

    Tables that only feed a later table are dropped as soon as that one is written; those that a returned
    DataFrame still reads stay in the shared folder, to be swept with it.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/lodestone-{label}-{uuid.uuid4().hex}"
        self.bucketed: dict[int, tuple[str, str]] = {}
        self.held: list[DataFrame] = []

    def _clean(self, save: Callable[[], None]) -> None:
        before = self.spark.conf.get(CLEANUP)
        self.spark.conf.set(CLEANUP, "true")
        try:
            save()
        finally:
            self.spark.conf.set(CLEANUP, before)
            tidy(self.spark)

    def write(self, df: DataFrame, name: str, *by: str) -> DataFrame:
        """Writes a table, in a folder for each value of the columns `by`, and reads it back."""
        path = f"{self.root}/{name}"
        self._clean(lambda: df.write.option("compression", "zstd").partitionBy(*by).parquet(path))
        return self.spark.read.schema(df.schema).parquet(path)

    def write_bucketed(self, df: DataFrame, name: str, key: str) -> DataFrame:
        """The same, bucketed and sorted by `key`: joins and groupings by it need no exchange.

        The bucketing is known to the session's catalogue; the files are in the workspace as all others.
        """
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        table = f"lodestone_{uuid.uuid4().hex}"
        dealt = df.repartition(buckets, key).sortWithinPartitions(key)
        saved = dealt.write.option("compression", "zstd").option("path", f"{self.root}/{name}").bucketBy(buckets, key).sortBy(key)
        self._clean(lambda: saved.saveAsTable(table, format="parquet"))
        made = self.spark.table(table)
        self.bucketed[id(made)] = (table, name)
        self.held.append(made)
        return made

    def drop_table(self, *tables: DataFrame) -> None:
        """Drops bucketed tables."""
        for made in tables:
            table, name = self.bucketed.pop(id(made))
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
            self.drop(name)

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
