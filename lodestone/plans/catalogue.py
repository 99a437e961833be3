"""Registered queries over the reference-style tables, each with its DuckDB counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
FLAGSHIP = "multi_level_aggregation"
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Adds a query, and the SQL whose result it must equal."""

    def add(query: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = query
        if sql is not None:
            _SQL[name] = sql
        return query

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt to all cores, where a small file would leave most of them without work."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


@register(
    FLAGSHIP,
    """SELECT o_orderpriority, round(avg(total), 2) AS avg_total FROM (
         SELECT o_orderpriority, o_custkey, sum(l_extendedprice) AS total
         FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderpriority, o_custkey)
       GROUP BY o_orderpriority""",
)
def multi_level_aggregation(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    inner = joined.groupBy("o_orderpriority", "o_custkey").agg(F.sum("l_extendedprice").alias("total"))
    return inner.groupBy("o_orderpriority").agg(F.round(F.avg("total"), 2).alias("avg_total"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
