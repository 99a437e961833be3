"""Sketches and approximate aggregates, by the built-in ones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .library import FUNCTIONS, col, function

#: The logarithm of an HLL sketch's registers, and the size of a KLL sketch.
PRECISION, QUANTILE_SIZE = 15, 1_000


@function
def hll_count_init(x, precision: int = PRECISION):
    """An aggregate: a sketch of the different values."""
    return F.hll_sketch_agg(col(x), precision)


@function
def hll_count_merge(x):
    """An aggregate over sketches: how many different values they have seen."""
    return F.hll_sketch_estimate(F.hll_union_agg(col(x), True))


@function
def hll_count_merge_partial(x):
    """An aggregate over sketches: their union."""
    return F.hll_union_agg(col(x), True)


@function
def hll_count_extract(x):
    """How many different values a sketch has seen; of no sketch none."""
    return F.coalesce(F.hll_sketch_estimate(col(x)), F.lit(0))


def _quantiles(name: str, sketch: Column, number: int) -> Column:
    places = F.array(*(F.lit(i / number) for i in range(number + 1)))
    return F.call_function(f"kll_sketch_get_quantile_{name}", sketch, places)


def _kll(kind: str, name: str, cast: str) -> None:
    made = lambda x, size=QUANTILE_SIZE: F.call_function(f"kll_sketch_agg_{name}", col(x).cast(cast), F.lit(size))
    merged = lambda x: F.call_function(f"kll_merge_agg_{name}", col(x))
    point = lambda x, phi: F.call_function(f"kll_sketch_get_quantile_{name}", x, F.lit(float(phi)))
    FUNCTIONS[f"kll_quantiles_init_{kind}"] = made
    FUNCTIONS[f"kll_quantiles_extract_{kind}"] = lambda x, number: _quantiles(name, col(x), number)
    FUNCTIONS[f"kll_quantiles_extract_point_{kind}"] = lambda x, phi: point(col(x), phi)
    FUNCTIONS[f"kll_quantiles_merge_{kind}"] = lambda x, number: _quantiles(name, merged(x), number)
    FUNCTIONS[f"kll_quantiles_merge_point_{kind}"] = lambda x, phi: point(merged(x), phi)
    FUNCTIONS[f"kll_quantiles_merge_partial_{kind}"] = merged


_kll("int64", "bigint", "bigint")
_kll("float64", "double", "double")


@function
def approx_top_count(x, number: int):
    """The most frequent values, with their counts, by a sketch of frequent items."""
    found = F.call_function("approx_top_k", col(x), F.lit(number))
    return F.transform(found, lambda f: F.struct(f["item"].alias("value"), f["count"].alias("count")))


def approx_top_sum(df, keys: list[str], value: str, weight: str, number: int):
    """By keys, the values with the largest sums of weights, as an array `top` of (value, sum); ties go by value.

    The sums are exact, by two groupings, and only `number` of them are kept for a group while it is read.
    """
    sums = df.groupBy(*keys, value).agg(F.sum(weight).alias("sum"))
    ranked = F.struct((-F.col("sum")).alias("low"), F.col(value).alias("value"), F.col("sum").alias("sum"))
    from pyspark.sql import Window

    best = Window.partitionBy(*keys).orderBy(F.desc("sum"), value)
    kept = sums.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= number)
    return kept.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(ranked)), lambda s: F.struct(s["value"].alias("value"), s["sum"].alias("sum"))).alias("top"))
