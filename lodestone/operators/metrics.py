"""Metrics of models and samples, by counts that are summed within ranges and then over the ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cumulative(df: DataFrame, value: str, positive: str, partitions: int | None = None) -> DataFrame:
    """(value, p, n, below_p, below_n): rows with a value, those up to it; by ranges of values, so that no task has all.

    positive: a boolean column; rows with a null in either are left out.
    """
    counted = df.filter(F.col(value).isNotNull() & F.col(positive).isNotNull()).groupBy(value).agg(F.count_if(positive).alias("p"), F.count_if(~F.col(positive)).alias("n"))
    ranged = counted.repartitionByRange(partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), value).withColumn("range", F.spark_partition_id())
    sums = ranged.groupBy("range").agg(F.sum("p").alias("sp"), F.sum("n").alias("sn"))
    # a row for each partition
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("range", F.coalesce(F.sum("sp").over(before), F.lit(0)).alias("bp"), F.coalesce(F.sum("sn").over(before), F.lit(0)).alias("bn"))
    within = Window.partitionBy("range").orderBy(value)
    upto = ranged.select(value, "p", "n", "range", F.sum("p").over(within).alias("wp"), F.sum("n").over(within).alias("wn"))
    return upto.join(bases, "range").select(value, "p", "n", (F.col("wp") + F.col("bp")).alias("below_p"), (F.col("wn") + F.col("bn")).alias("below_n"))


def ks(df: DataFrame, value: str, positive: str) -> DataFrame:
    """The Kolmogorov-Smirnov statistic of the values of both kinds of rows."""
    upto = cumulative(df, value, positive)
    totals = df.filter(F.col(value).isNotNull()).agg(F.count_if(positive).alias("tp"), F.count_if(~F.col(positive)).alias("tn"))
    return upto.crossJoin(F.broadcast(totals)).agg(F.round(F.max(F.abs(F.col("below_p") / F.col("tp") - F.col("below_n") / F.col("tn"))), 8).alias("ks"))


def roc_curve(df: DataFrame, score: str, positive: str) -> DataFrame:
    """(threshold, recall, false_positive_rate, true_positives, false_positives, true_negatives, false_negatives) for each score as threshold."""
    upto = cumulative(df, score, positive)
    totals = df.filter(F.col(score).isNotNull()).agg(F.count_if(positive).alias("tp"), F.count_if(~F.col(positive)).alias("tn"))
    # rows at or over the threshold count as positive
    hit, false = F.col("tp") - F.col("below_p") + F.col("p"), F.col("tn") - F.col("below_n") + F.col("n")
    return upto.crossJoin(F.broadcast(totals)).select(
        F.col(score).alias("threshold"), (hit / F.col("tp")).alias("recall"), (false / F.col("tn")).alias("false_positive_rate"),
        hit.alias("true_positives"), false.alias("false_positives"), (F.col("tn") - false).alias("true_negatives"), (F.col("tp") - hit).alias("false_negatives"),
    )


def confusion_matrix(df: DataFrame, expected: str, predicted: str, labels: list) -> DataFrame:
    """A row for each expected label, a column for each predicted one."""
    counted = df.groupBy(F.col(expected).alias("expected_label"))
    return counted.agg(*(F.count_if(F.col(predicted) == F.lit(x)).alias(f"_{x}") for x in labels))


def class_metrics(df: DataFrame, expected: str, predicted: str) -> DataFrame:
    """(precision, recall, accuracy, f1_score) over classes, each class weighing the same."""
    sums = df.groupBy(F.col(expected).alias("e"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    by = lambda side: sums.groupBy(F.col(side).alias("label")).agg(F.sum("n").alias(f"n_{side}"), F.sum(F.when(F.col("e") == F.col("p"), F.col("n")).otherwise(0)).alias(f"hit_{side}"))
    both = by("e").join(by("p"), "label", "left")
    precision, recall = F.coalesce(F.col("hit_p") / F.col("n_p"), F.lit(0.0)), F.col("hit_e") / F.col("n_e")
    f1 = F.coalesce(2 * precision * recall / F.nullif(precision + recall, F.lit(0.0)), F.lit(0.0))
    return both.agg(F.avg(precision).alias("precision"), F.avg(recall).alias("recall"), (F.sum("hit_e") / F.sum("n_e")).alias("accuracy"), F.avg(f1).alias("f1_score"))
