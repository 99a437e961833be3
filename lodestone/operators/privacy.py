"""Differentially private aggregates: contributions of each privacy unit are bounded, then noise is added.

Epsilon is split evenly among the aggregates and the choice of groups, delta pays for the groups: a group shows only
if its noisy number of units reaches a threshold that a single unit passes with probability delta at most.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _laplace(scale: float, seed: int | None) -> Column:
    """Noise by the inverse distribution; the uniform is kept off its ends."""
    u = F.least(F.greatest(F.rand(seed), F.lit(1e-12)), F.lit(1 - 1e-12)) - 0.5
    return -scale * F.signum(u) * F.log(1 - 2 * F.abs(u))


def private_aggregate(df: DataFrame, unit: str, keys: Sequence[str], epsilon: float, delta: float, groups: int, aggregates: dict[str, tuple], seed: int | None = None) -> DataFrame:
    """By keys; aggregates: name -> ("count",), ("sum", column, low, high), ("avg", column, low, high) or ("percentile_cont", column, low, high, share).

    groups: how many groups a unit may contribute to, chosen by a hash. A unit's sums and values within a group are
    clamped to low..high, its count to 1.
    """
    parts = len(aggregates) + sum(1 for a in aggregates.values() if a[0] == "avg") + 1
    share = epsilon / parts
    values = []
    for name, (kind, *more) in aggregates.items():
        if kind != "count":
            column, low, high, *_ = more
            inner = F.sum(column) if kind == "sum" else F.avg(column)
            values.append(F.least(F.greatest(inner, F.lit(float(low))), F.lit(float(high))).alias(f"__{name}"))
    own = df.filter(F.col(unit).isNotNull()).groupBy(*keys, unit).agg(F.count(F.lit(1)).alias("__rows"), *values)
    # of a unit's groups a bounded number, by a hash that has nothing to do with the data's order
    place = F.row_number().over(Window.partitionBy(unit).orderBy(F.xxhash64(unit, *keys, F.lit(17))))
    bounded = own.withColumn("__place", place).filter(F.col("__place") <= groups)
    sums = [F.count(F.lit(1)).alias("__units")]
    for name, (kind, *more) in aggregates.items():
        if kind == "percentile_cont":
            sums.append(F.percentile(f"__{name}", float(more[3])).alias(f"__s_{name}"))
        elif kind != "count":
            sums.append(F.sum(f"__{name}").alias(f"__s_{name}"))
    grouped = bounded.groupBy(*keys).agg(*sums)
    noise = lambda size, i: _laplace(size * groups / share, None if seed is None else seed + i)
    bar = 1 + groups / share * math.log(groups / (2 * delta)) if delta < 1 else 0.0
    seen = grouped.withColumn("__shown", F.col("__units") + noise(1.0, 0)).filter(F.col("__shown") >= bar)
    out = []
    for i, (name, (kind, *more)) in enumerate(aggregates.items()):
        if kind == "count":
            made = F.round(F.col("__units") + noise(1.0, 2 * i + 1)).cast("long")
        else:
            low, high = float(more[1]), float(more[2])
            size = max(abs(low), abs(high))
            total = F.col(f"__s_{name}") + noise(size if kind != "percentile_cont" else high - low, 2 * i + 1)
            made = total if kind == "sum" else F.least(F.greatest(total if kind == "percentile_cont" else total / F.greatest(F.col("__units") + noise(1.0, 2 * i + 2), F.lit(1.0)), F.lit(low)), F.lit(high))
        out.append(made.alias(name))
    return seen.select(*keys, *out)
