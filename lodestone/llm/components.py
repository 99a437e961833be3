"""Connected components by alternating large-star and small-star steps, all distributed; of few edges in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_arrow
from .workspace import Workspace


def united(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, the smallest id that each reaches) of the edges from a to b."""
    ids, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = list(range(len(ids)))
    for x, y in codes.reshape(2, -1).T.tolist():
        while root[x] != x:
            root[x] = x = root[root[x]]
        while root[y] != y:
            root[y] = y = root[root[y]]
        root[max(x, y)] = min(x, y)
    # no root is larger than its node, so smaller nodes are settled first
    for k, up in enumerate(root):
        root[k] = root[up]
    return ids, ids[np.array(root, np.int64)]


def _in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[x.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b")] for x in batches if x.num_rows]
        if parts:
            ids, low = united(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(low, pa.int64())], ["id", "component"])

    return map_arrow(edges.coalesce(1), run, "id long, component long")


def components(edges: DataFrame, space: Workspace, label: str, few: int = 0) -> DataFrame:
    """(id, component) of every node of edges (a, b): the smallest id reachable. Isolated ids have no row.

    Both steps keep connectivity and move edges towards each component's smallest node, until every other node has
    one edge, to that node. A node with very many neighbours is a pre-aggregated minimum and a join that AQE splits.

    few: so many edges at most, counted with repetitions, are united in one task instead: a round costs some seven
    stages whatever their number.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    if few:
        edges = space.write(edges, f"{label}-given")
        if edges.count() <= few:
            found = space.write(_in_one_task(edges), label)
            space.drop(f"{label}-given")
            return found
    current = space.write(edges.distinct(), f"{label}-0")
    space.drop(f"{label}-given")
    before, step = None, 0
    while True:
        step += 1
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.join(low.hint("merge"), "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low.hint("merge"), "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        small = small.unionByName(low.select("a", F.col("low").alias("b"))).filter("a <> b").distinct()
        done = space.write(small, f"{label}-{step}")
        space.drop(f"{label}-{step - 1}")
        state = done.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        current = done
        if state == before:
            break
        before = state
    roots = current.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return current.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
