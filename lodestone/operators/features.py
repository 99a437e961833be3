"""Feature preparation and closed-form models, from aggregates that are computed once and joined back as one row."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _with_totals(df: DataFrame, totals: dict[str, Column]) -> DataFrame:
    """df beside aggregates over all of it; those are one row, so the broadcast has a fixed size."""
    return df.join(F.broadcast(df.agg(*(c.alias(n) for n, c in totals.items()))))


def _scaled(df: DataFrame, column: str, totals: dict[str, Column], made: Column, output: str) -> DataFrame:
    return _with_totals(df, totals).withColumn(output, made).drop(*totals)


def standard_scaler(df: DataFrame, column: str, output: str) -> DataFrame:
    x = F.col(column)
    return _scaled(df, column, {"__m": F.avg(x), "__s": F.stddev_samp(x)}, F.try_divide(x - F.col("__m"), F.col("__s")), output)


def min_max_scaler(df: DataFrame, column: str, output: str) -> DataFrame:
    x = F.col(column)
    return _scaled(df, column, {"__a": F.min(x), "__b": F.max(x)}, F.try_divide(x - F.col("__a"), F.col("__b") - F.col("__a")), output)


def max_abs_scaler(df: DataFrame, column: str, output: str) -> DataFrame:
    x = F.col(column)
    return _scaled(df, column, {"__m": F.max(F.abs(x))}, F.try_divide(x, F.col("__m")), output)


def robust_scaler(df: DataFrame, column: str, output: str) -> DataFrame:
    """By the median and the distance between the quartiles."""
    x = F.col(column)
    return _scaled(df, column, {"__q": F.percentile(x, [0.25, 0.5, 0.75])}, F.try_divide(x - F.col("__q")[1], F.col("__q")[2] - F.col("__q")[0]), output)


def imputer(df: DataFrame, column: str, output: str, strategy: str = "mean") -> DataFrame:
    x = F.col(column)
    made = {"mean": F.avg(x), "median": F.percentile(x, 0.5), "most_frequent": F.mode(x, True)}[strategy]
    return _scaled(df, column, {"__v": made}, F.coalesce(x, F.col("__v")), output)


def bucketize(x: Column, edges: Sequence[float], exclude_boundaries: bool = False) -> Column:
    """bin_1, bin_2, ... by split points; the first and the last point don't split if boundaries are excluded."""
    points = list(edges)[1:-1] if exclude_boundaries else list(edges)
    place = sum((F.when(x >= p, 1).otherwise(0) for p in points), F.lit(1))
    return F.when(x.isNotNull(), F.concat(F.lit("bin_"), place.cast("string")))


def quantile_bucketize(df: DataFrame, column: str, buckets: int, output: str) -> DataFrame:
    edges = F.percentile(F.col(column), [i / buckets for i in range(1, buckets)])
    place = F.size(F.filter(F.col("__q"), lambda q: q <= F.col(column))) + 1
    return _scaled(df, column, {"__q": edges}, F.when(F.col(column).isNotNull(), F.concat(F.lit("bin_"), place.cast("string"))), output)


def label_encoder(df: DataFrame, column: str, output: str, top_k: int = 32_000, least: int = 0) -> DataFrame:
    """Numbers of the top_k values that come at least `least` times, in their order; 0 for all others and nulls."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).count().filter(F.col("count") >= least)
    kept = counts.orderBy(F.desc("count"), column).limit(top_k)
    # at most top_k values: one row holds them, in order
    return _with_one(df, kept, column).withColumn(output, F.coalesce(F.array_position("__values", F.col(column)), F.lit(0)).cast("long")).drop("__values")


def one_hot_encoder(df: DataFrame, column: str, output: str, top_k: int = 32_000, least: int = 0) -> DataFrame:
    """A sparse vector as [(index, value)], by label_encoder's numbers."""
    return label_encoder(df, column, "__n", top_k, least).withColumn(output, F.array(F.struct(F.col("__n").alias("index"), F.lit(1.0).alias("value")))).drop("__n")


def _with_one(df: DataFrame, kept: DataFrame, column: str) -> DataFrame:
    return df.join(F.broadcast(kept.agg(F.array_sort(F.collect_list(column)).alias("__values"))))


def ngrams(tokens: Column, least: int, most: int, separator: str = " ") -> Column:
    def of(n: int) -> Column:
        starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), separator))

    return F.concat(*map(of, range(least, most + 1)))


def feature_cross(*columns: str) -> Column:
    """All pairs of the columns' values, joined by _."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    return F.struct(*(F.concat_ws("_", F.col(a).cast("string"), F.col(b).cast("string")).alias(f"{a}_{b}") for a, b in pairs))


def polynomial_expand(columns: Sequence[str], degree: int = 2) -> Column:
    from itertools import combinations_with_replacement

    made = []
    for d in range(1, degree + 1):
        for chosen in combinations_with_replacement(columns, d):
            value = F.lit(1.0)
            for c in chosen:
                value = value * F.col(c)
            made.append(value.alias("_".join(chosen)))
    return F.struct(*made)


def normalizer(x: Column, p: float = 2.0) -> Column:
    if p == float("inf"):
        size = F.array_max(F.transform(x, lambda v: F.abs(v.cast("double"))))
    else:
        size = F.pow(F.aggregate(x, F.lit(0.0), lambda s, v: s + F.pow(F.abs(v.cast("double")), F.lit(p))), F.lit(1 / p))
    return F.transform(x, lambda v: F.try_divide(v.cast("double"), size))


def linear_regression(df: DataFrame, features: Sequence[str], label: str, l2: float = 0.0) -> dict[str, float]:
    """Weights by the normal equations; one aggregation gives their (features + 1) squared sums."""
    names = [None, *features]
    value = lambda n: F.lit(1.0) if n is None else F.col(n).cast("double")
    rows = df.select(*features, label).dropna()
    sums = [F.sum(value(a) * value(b)).alias(f"x{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names)]
    sums += [F.sum(value(a) * F.col(label)).alias(f"y{i}") for i, a in enumerate(names)]
    row = rows.agg(*sums).first()
    n = len(names)
    left = np.array([[row[f"x{i}_{j}"] or 0.0 for j in range(n)] for i in range(n)]) + l2 * np.diag([0.0] + [1.0] * (n - 1))
    weights = np.linalg.lstsq(left, np.array([row[f"y{i}"] or 0.0 for i in range(n)]), rcond=None)[0]
    return dict(zip(["__INTERCEPT__", *features], map(float, weights)))


def predict_linear(df: DataFrame, weights: dict[str, float], output: str = "predicted_label") -> DataFrame:
    made = F.lit(weights["__INTERCEPT__"])
    for name, w in weights.items():
        if name != "__INTERCEPT__":
            made = made + F.col(name) * w
    return df.withColumn(output, made)


def evaluate_regression(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """mean_absolute_error, mean_squared_error and r2_score in one pass."""
    y, p = F.col(label), F.col(predicted)
    return df.agg(F.avg(F.abs(y - p)).alias("mean_absolute_error"), F.avg((y - p) * (y - p)).alias("mean_squared_error"), (1 - F.sum((y - p) * (y - p)) / (F.var_pop(y) * F.count(y))).alias("r2_score"))


def confusion_matrix(df: DataFrame, label: str, predicted: str) -> DataFrame:
    return df.groupBy(label, predicted).agg(F.count(F.lit(1)).alias("n"))


def point_in_time(features: DataFrame, entities: DataFrame, entity: str, feature_time: str, time: str, columns: Sequence[str]) -> DataFrame:
    """Each entity's latest features at or before its time."""
    from .relational import as_of_join

    return as_of_join(entities, features, [entity], time, feature_time, columns)
