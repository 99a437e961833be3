"""Structured Streaming over event files: tumbling windows with watermarks, deduplication and stateful sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_stream(spark: SparkSession, folder: str, glob: str, schema) -> DataFrame:
    """New Parquet files of a folder, as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).option("recursiveFileLookup", "true").parquet(folder)


def windowed_counts(events: DataFrame, time: str, width: str, late: str, keys: list[str], value: str) -> DataFrame:
    """Counts and sums by tumbling window and keys; windows are final once the watermark passes them."""
    stamped = events.withColumn("__time", F.col(time).cast("timestamp")).withWatermark("__time", late)
    return stamped.groupBy(F.window("__time", width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), *keys, "n", "total")


def session_counts(events: DataFrame, time: str, gap: str, late: str, keys: list[str]) -> DataFrame:
    """Sessions of the keys' events that lie less than the gap apart."""
    stamped = events.withColumn("__time", F.col(time).cast("timestamp")).withWatermark("__time", late)
    return stamped.groupBy(F.session_window("__time", gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, "n")


def without_repeats(events: DataFrame, time: str, late: str, keys: list[str]) -> DataFrame:
    """The first of the events with equal keys, while the watermark allows to remember them."""
    stamped = events.withColumn("__time", F.col(time).cast("timestamp")).withWatermark("__time", late)
    return stamped.dropDuplicatesWithinWatermark(keys).drop("__time")


def run_available(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all input there is, into Parquet files beside its checkpoint, and reads them.

    In append mode only windows that the watermark has passed come out; complete mode goes through a table in memory.
    """
    spark = stream.sparkSession
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{folder}/out").start()
        query.awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{folder}/out")

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out")

    writer.foreachBatch(store).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def joined_within(left: DataFrame, right: DataFrame, key: str, time: str, within: str, late: str) -> DataFrame:
    """Pairs of a key whose right event comes at most `within` after the left one; watermarks bound the state of both."""
    stamp = lambda df, side: df.select(*(F.col(c).alias(f"{side}_{c}") for c in df.columns), F.col(time).cast("timestamp").alias(f"{side}__time")).withWatermark(f"{side}__time", late)
    a, b = stamp(left, "left"), stamp(right, "right")
    on = (F.col(f"left_{key}") == F.col(f"right_{key}")) & (F.col("right__time") >= F.col("left__time")) & (F.col("right__time") <= F.col("left__time") + F.expr(f"INTERVAL {within}"))
    return a.join(b, on).drop("left__time", "right__time")


def run_once(stream: DataFrame, folder: str, name: str) -> dict:
    """Runs a stream over what is new since its checkpoint, into Parquet files, each batch once; tells how it went."""
    writer = stream.writeStream.queryName(f"lodestone_{name}").outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    query = writer.format("parquet").option("path", f"{folder}/out").start()
    query.awaitTermination()
    return {"name": query.name, "ended": not query.isActive, "rows": sum(p["numInputRows"] for p in query.recentProgress)}
