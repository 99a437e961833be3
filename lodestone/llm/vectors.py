"""Near-duplicate vectors by a robust-pruned flat graph over overlapping cluster shards.

1. Equal vectors are one node. Centroids are fitted by k-means on a bounded sample; every node goes to the shards of
   its `overlap` nearest centroids. A shard beyond MOST_ROWS is split into blocks, and each pair of blocks is a task,
   so that a task's size is bounded and no pair of a shard is left out.
2. Each task builds adjacency lists from the nearest neighbours in it, pruned robustly: a neighbour is dropped if one
   that was chosen before is closer to it, by a factor, than the node is. A node's lists from all its shards are
   united.
3. Each task searches the united graph, with its edges in both directions, for all its nodes at once: greedily from
   the node itself, the medoids of its clusters and an entry point of each part of the graph that has no medoid (the
   nearest neighbours of a large group can all lie in it). The search expands on from every vector within the range,
   plus a margin, until it finds none that is new.
4. What is found is verified in double precision. A pair that shares several shards counts in the first of them; of
   all the links a task gives, each node keeps their number, one edge towards its component and a signed sum of hashes
   that is zero over all tasks if they found the same, so that the output grows with the nodes and not with the pairs.
   Nodes with another sum are held exactly against all nodes of their shards, so that no link is lost that any task
   has found.
5. An audit holds AUDITED nodes against all others in blocks. If the recall is under the target, the overlap doubles
   and all is done again. Where the overlap would reach every shard, all nodes are compared exactly instead, a pair of
   blocks a task.

Defined results. Vectors that are null, empty, zero or hold null or non-finite components are linked with nothing.
Vectors of another length than the commonest are compared with their own kind. Rows without vec_id count as vectors
but lend no component; rows that share a vec_id are vectors of their own. Other columns are left alone.
"""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import map_slices
from .components import components
from .workspace import Workspace

COSINE, OVERLAP, TARGET = 0.9, 3, 0.98
SAMPLE, SHARD_ROWS, MOST_ROWS, MOST_SHARDS = 20_000, 1_500, 4_096, 4_096
NEAREST, DEGREE, SLACK = 64, 32, 1.2
MEDOIDS, BEAM, MARGIN, AT_A_TIME = 16, 40, 0.1, 8
AUDITED, QUERIES_AT_ONCE = 200, 1_024
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_LOG = logging.getLogger(__name__)


def unit(values: list | None) -> np.ndarray | None:
    """The vector at length 1 in double precision; None if it can't be linked."""
    if not values or any(v is None for v in values):
        return None
    x = np.array(values, np.float64)
    if not np.isfinite(x).all() or not (top := np.abs(x).max()):
        return None
    x = x / top
    return x / np.linalg.norm(x)


def _units(rows: DataFrame) -> DataFrame:
    """(vec_id, unit, size): unit as bytes, null if it can't be linked; size: its length."""

    def run(batch: pa.RecordBatch) -> dict:
        made = [unit(v) for v in batch.column("embedding").to_pylist()]
        return {"vec_id": batch.column("vec_id"), "unit": [m if m is None else m.tobytes() for m in made], "size": [0 if m is None else len(m) for m in made]}

    return map_slices(rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"), run, "vec_id long, unit binary, size int")


def fit_centroids(sample: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means; empty clusters stay where they began."""
    rng = np.random.default_rng(20240611)
    centres = sample[rng.choice(len(sample), min(k, len(sample)), replace=False)]
    for _ in range(rounds):
        own = np.concatenate([(sample[i : i + 4096] @ centres.T).argmax(axis=1) for i in range(0, len(sample), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        norms = np.linalg.norm(sums, axis=1)
        full = norms > 0
        centres[full] = sums[full] / norms[full, None]
    return centres


def neighbour_lists(x: np.ndarray, degree: int = DEGREE, slack: float = SLACK) -> np.ndarray:
    """Robust-pruned neighbours of each row, by place; -1 fills up."""
    n = len(x)
    width = min(NEAREST, n - 1)
    if width < 1:
        return np.full((n, 1), -1)
    near, sims = np.empty((n, width), np.int64), np.empty((n, width), np.float32)
    for i in range(0, n, QUERIES_AT_ONCE):
        block = x[i : i + QUERIES_AT_ONCE] @ x.T
        block[np.arange(len(block)), np.arange(i, i + len(block))] = -2
        top = np.argpartition(-block, width - 1, axis=1)[:, :width]
        own = np.take_along_axis(block, top, axis=1)
        order = np.argsort(-own, axis=1, kind="stable")
        near[i : i + len(block)], sims[i : i + len(block)] = np.take_along_axis(top, order, axis=1), np.take_along_axis(own, order, axis=1)
    alive, chosen, rows = np.ones((n, width), bool), np.full((n, degree), -1), np.arange(n)
    distance = np.sqrt(np.maximum(0, 2 - 2 * sims))
    for k in range(min(degree, width)):
        first = alive.argmax(axis=1)
        has = alive[rows, first]
        picked = np.where(has, near[rows, first], -1)
        chosen[:, k] = picked
        alive[rows, first] = False
        between = np.empty((n, width), np.float32)
        for i in range(0, n, QUERIES_AT_ONCE):
            part = slice(i, i + QUERIES_AT_ONCE)
            between[part] = np.einsum("nd,nwd->nw", x[np.maximum(picked[part], 0)], x[near[part]])
        alive &= ~(has[:, None] & (slack * np.sqrt(np.maximum(0, 2 - 2 * between)) <= distance))
        if not alive.any():
            break
    return chosen


def _lowest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row number that each of n rows reaches over the edges (a, b)."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def both_ways(n: int, owner: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, targets): the neighbours of row i over the edges in both directions are targets[starts[i] : starts[i + 1]]."""
    edges = np.unique(np.concatenate([owner * n + target, target * n + owner]))
    return np.searchsorted(edges, np.arange(n + 1) * n), edges % n


def entry_points(x: np.ndarray, graph: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The medoids, and of each part of the graph without one the row nearest to the part's mean."""
    medoids = np.unique((fit_centroids(x, MEDOIDS, 3) @ x.T).argmax(axis=1))
    starts, targets = graph
    part = _lowest(len(x), np.repeat(np.arange(len(x)), np.diff(starts)), targets)
    sums = np.zeros_like(x)
    np.add.at(sums, part, x)
    order = np.lexsort((-np.einsum("nd,nd->n", x, sums[part]), part))
    parts, first = np.unique(part[order], return_index=True)
    return np.concatenate([medoids, order[first][~np.isin(parts, part[medoids])]])


def range_search(x: np.ndarray, graph: np.ndarray | tuple[np.ndarray, np.ndarray], queries: np.ndarray, bar: float, entries: np.ndarray | None = None) -> np.ndarray:
    """For each query (a row number), which rows it has met with a cosine of at least bar; by expanding greedily from itself and the entry points.

    graph: neighbours by place, -1 where there is none, or what both_ways gives.
    """
    n = len(x)
    if isinstance(graph, np.ndarray):
        owner, place = np.nonzero(graph >= 0)
        graph = both_ways(n, owner, graph[owner, place])
    starts, neighbours = graph
    entries = entry_points(x, graph) if entries is None else entries
    met = np.full((len(queries), n), -2, np.float32)
    met[:, entries] = x[queries] @ x[entries].T
    met[np.arange(len(queries)), queries] = 1
    fresh = np.zeros((len(queries), n), bool)
    fresh[:, entries] = True
    fresh[np.arange(len(queries)), queries] = True
    spent = np.zeros(len(queries), np.int64)
    live = np.arange(len(queries))
    while len(live):
        waiting = np.where(fresh[live], met[live], -3)
        width = min(AT_A_TIME, n)
        top = np.argpartition(-waiting, width - 1, axis=1)[:, :width] if width < n else np.tile(np.arange(n), (len(live), 1))
        best = np.take_along_axis(waiting, top, axis=1)
        highest = best.max(axis=1)
        # within the range plus a margin all are expanded; outside, the best one while the beam lasts
        go = (best >= bar - MARGIN) | ((best == highest[:, None]) & (spent[live] < BEAM)[:, None] & (best > -3))
        rows, spots = np.nonzero(go)
        if not len(rows):
            break
        q, nodes = live[rows], top[rows, spots]
        fresh[q, nodes] = False
        spent += np.bincount(q, minlength=len(spent))
        count = starts[nodes + 1] - starts[nodes]
        q, targets = np.repeat(q, count), neighbours[np.repeat(starts[nodes] - (np.cumsum(count) - count), count) + np.arange(count.sum())]
        new = met[q, targets] == -2
        pairs = np.unique(q[new] * n + targets[new])
        q, targets = pairs // n, pairs % n
        for i in range(0, len(q), 1 << 17):
            part = slice(i, i + (1 << 17))
            met[q[part], targets[part]] = np.einsum("nd,nd->n", x[queries[q[part]]], x[targets[part]])
        fresh[q, targets] = True
        live = live[go.any(axis=1)]
    return met >= bar


def _task_links(ids, copies, shards, block, x, links, i, j, shard, cosine, asks=None):
    """(number of links, edge, check) of a task's nodes; links: united neighbours by id, None to compare exactly.

    asks: the nodes whose links are looked for, all if None. check: the first shard of a pair adds the pair's hash for
    each other shard of both, and each other takes it away.
    """
    n = len(ids)
    asking = np.arange(n) if asks is None else np.flatnonzero(asks)
    small = x.astype(np.float32)
    if links is not None:
        order = np.argsort(ids)
        flat = np.concatenate([np.asarray(v, np.int64) for v in links]) if n else np.empty(0, np.int64)
        owner = np.repeat(np.arange(n), [len(v) for v in links])
        at = np.minimum(np.searchsorted(ids[order], flat), n - 1)
        inside = ids[order][at] == flat
        graph = both_ways(n, owner[inside], order[at[inside]])
        entries = entry_points(small, graph)
    total, check = np.zeros(n, np.int64), np.zeros(n, np.int64)
    edges, own = [], []
    found = np.zeros((n, n), bool)
    for a in range(0, len(asking), QUERIES_AT_ONCE):
        queries = asking[a : a + QUERIES_AT_ONCE]
        found[queries] = small[queries] @ small.T >= cosine - 1e-5 if links is None else range_search(small, graph, queries, cosine - 1e-5, entries)
    found |= found.T
    np.fill_diagonal(found, False)
    if i != j:
        # pairs within a block belong to the task of that block alone
        found &= block[:, None] != block[None, :]
    left, right = np.nonzero(found)
    keep = left < right
    left, right = left[keep], right[keep]
    for k in range(0, len(left), 1 << 17):
        part = slice(k, k + (1 << 17))
        a, b = left[part], right[part]
        true = np.einsum("nd,nd->n", x[a], x[b]) >= cosine
        # the first shard that both are in
        same = (shards[a][:, :, None] == shards[b][:, None, :]).any(axis=2)
        first = np.where(same, shards[a], np.iinfo(np.int64).max).min(axis=1)
        hashed = ((ids[a] ^ ids[b]).view(np.uint64) * _MULTIPLIER >> np.uint64(28)).view(np.int64)
        hashed = np.where(first == shard, hashed * (same.sum(axis=1) - 1), -hashed)[true]
        a, b, first = a[true], b[true], first[true]
        np.add.at(check, a, hashed)
        np.add.at(check, b, hashed)
        edges.append((a, b))
        own.append(first == shard)
    a, b = (np.concatenate(v) for v in zip(*edges)) if edges else (np.empty(0, np.int64),) * 2
    mine = np.concatenate(own) if own else np.empty(0, bool)
    np.add.at(total, a[mine], copies[b[mine]])
    np.add.at(total, b[mine], copies[a[mine]])
    return total, ids[_lowest(n, a, b)], check


def _dealt(nodes: DataFrame, centres: dict[int, np.ndarray], overlap: int, space: Workspace) -> DataFrame:
    """Nodes dealt to tasks: (shard, i, j, block, node, copies, unit, shards)."""

    def run(batch: pa.RecordBatch) -> dict:
        sizes, units = batch.column("size").to_pylist(), batch.column("unit").to_pylist()
        shards = []
        for size, own in zip(sizes, units):
            if size in centres:
                sims = centres[size] @ np.frombuffer(own)
                k = min(overlap, len(sims))
                shards.append(sorted(np.argpartition(-sims, k - 1)[:k].tolist()))
            else:
                shards.append([-size])
        return {c: batch.column(c) for c in ("node", "copies", "unit")} | {"shards": shards}

    placed = space.write(map_slices(nodes, run, "node long, copies long, unit binary, shards array<long>"), f"placed{overlap}")
    each = placed.withColumn("shard", F.explode("shards"))
    sizes = each.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / MOST_ROWS).cast("int").alias("blocks"))
    each = each.join(sizes, "shard").withColumn("block", F.pmod(F.xxhash64("node", F.lit(5)), F.col("blocks")).cast("int"))
    # of the pairs (i, j), i <= j, of blocks: those with the row's own
    each = each.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return each.select("shard", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "copies", "unit", "shards")


LINKED = "node long, n long, root long, check long"


def _linked(dealt: DataFrame, space: Workspace, overlap: int, cosine: float) -> DataFrame:
    """(node, n, root, check) for each node and task; an overlap of 0 compares all nodes of a task."""
    matrix = lambda column: np.frombuffer(b"".join(column.to_pylist())).reshape(len(column), -1)

    def build(table: pa.Table) -> pa.Table:
        ids, x = table.column("node").to_numpy(), matrix(table.column("unit"))
        lists = neighbour_lists(x.astype(np.float32))
        return pa.table({"node": pa.array(ids), "near": pa.array([ids[r[r >= 0]] for r in lists], pa.list_(pa.int64()))})

    keys = ["shard", "i", "j"]
    if overlap:
        lists = dealt.groupBy(*keys).applyInArrow(build, "node long, near array<long>")
        united = space.write(lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), f"graph{overlap}")

    search = _searching(cosine, bool(overlap))
    return (dealt.join(united, "node") if overlap else dealt).groupBy(*keys).applyInArrow(search, LINKED)


def _searching(cosine: float, by_graph: bool):
    def search(table: pa.Table) -> pa.Table:
        column = lambda c: table.column(c).to_numpy()
        ids = column("node")
        asks = column("asks") if "asks" in table.column_names else None
        shards = np.array(table.column("shards").to_pylist(), np.int64)
        x = np.frombuffer(b"".join(table.column("unit").to_pylist())).reshape(len(ids), -1)
        near = table.column("near").to_pylist() if by_graph else None
        i, j, shard = (int(table.column(c)[0].as_py()) for c in ("i", "j", "shard"))
        n, root, check = _task_links(ids, column("copies"), shards, column("block"), x, near, i, j, shard, cosine, asks)
        if asks is not None:
            n = np.where(asks, n, 0)
        return pa.table({"node": pa.array(ids), "n": pa.array(n), "root": pa.array(root), "check": pa.array(check)})

    return search


def _agreed(found: DataFrame, dealt: DataFrame, space: Workspace, overlap: int, cosine: float) -> DataFrame:
    """found, with the nodes whose tasks differ counted anew by exact comparison in their shards."""
    differ = space.write(found.groupBy("node").agg(F.sum("check").alias("check")).filter("check <> 0").select("node"), f"differ{overlap}")
    asked = differ.withColumn("asks", F.lit(True))
    # only tasks with such a node
    keys = ["shard", "i", "j"]
    tasks = dealt.select(*keys, "node").join(differ, "node", "left_semi").select(*keys).distinct()
    again = dealt.join(tasks, keys, "left_semi").join(asked, "node", "left").withColumn("asks", F.coalesce("asks", F.lit(False)))
    again = again.groupBy(*keys).applyInArrow(_searching(cosine, False), LINKED)
    first = found.join(asked, "node", "left").select("node", F.when(F.col("asks"), 0).otherwise(F.col("n")).alias("n"), "root", "check")
    return space.write(first.unionByName(again.filter("n > 0 OR node <> root")), f"agreed{overlap}")


def audit(nodes: DataFrame, counts: DataFrame, size: int, cosine: float) -> tuple[int, int]:
    """(links found, links there are) of the AUDITED nodes with the lowest hashes, by brute force in blocks."""
    chosen = nodes.filter(F.col("size") == size).orderBy(F.xxhash64("node", F.lit(9))).limit(AUDITED).collect()
    if not chosen:
        return 0, 0
    ids, queries = np.array([r.node for r in chosen]), np.array([np.frombuffer(bytes(r.unit)) for r in chosen])

    def run(batch: pa.RecordBatch) -> dict:
        x = np.frombuffer(b"".join(batch.column("unit").to_pylist())).reshape(batch.num_rows, -1)
        near = (queries @ x.T >= cosine) & (ids[:, None] != batch.column("node").to_numpy()[None, :])
        return {"node": ids, "there": near @ batch.column("copies").to_numpy()}

    there = map_slices(nodes.filter(F.col("size") == size), run, "node long, there long").groupBy("node").agg(F.sum("there").alias("there"))
    row = there.join(counts, "node", "left").agg(F.sum(F.least(F.coalesce("n", F.lit(0)), "there")), F.sum("there")).first()
    return int(row[0] or 0), int(row[1] or 0)


def near_vectors(rows: DataFrame, cosine: float = COSINE, overlap: int = OVERLAP, target: float = TARGET, report: dict | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of rows (vec_id, embedding).

    report: gets what the audits measured, a list `audits` of (overlap, links found, links there are), and the last
    `recall`: 1.0 after the exact comparison, or where the audited nodes have no links.
    """
    report = {} if report is None else report
    report |= {"audits": [], "recall": 1.0}
    space = Workspace(rows.sparkSession, "vectors")
    units = space.write(_units(rows), "units")
    # a node is a set of equal vectors; its number is the smallest vec_id, or a hash where no row has one
    nodes = units.filter(F.col("unit").isNotNull()).groupBy("unit", "size").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("copies"))
    nodes = space.write(nodes.select(F.xxhash64("unit").alias("node"), "low", "copies", "unit", "size"), "nodes")
    common = nodes.groupBy("size").agg(F.sum("copies").alias("n"), F.count(F.lit(1)).alias("k")).orderBy(F.desc("n"), "size").first()
    if common is None:
        own = F.coalesce(F.lit(None).cast("long"), "vec_id")
        return units.select("vec_id", F.lit(0).cast("long").alias("n_links"), own.alias("component_id"), F.lit(True).alias("kept"))
    size = common["size"]
    sample = nodes.filter(F.col("size") == size).orderBy(F.xxhash64("node", F.lit(3))).limit(SAMPLE).select("unit").collect()
    shards = int(min(MOST_SHARDS, max(1, common["k"] * overlap // SHARD_ROWS)))
    centres = {size: fit_centroids(np.array([np.frombuffer(bytes(r.unit)) for r in sample]), shards)}
    used = []
    while True:
        used.append(overlap)
        # without centres all nodes of a size are one shard
        dealt = _dealt(nodes, centres if overlap else {}, overlap, space)
        found = space.write(_linked(dealt, space, overlap, cosine), f"found{overlap}")
        if overlap:
            found = _agreed(found, dealt, space, overlap, cosine)
        counts = found.groupBy("node").agg(F.sum("n").alias("n"))
        if not overlap:
            report["recall"] = 1.0
            break
        got, there = audit(nodes, counts, size, cosine)
        report["audits"].append((overlap, got, there))
        report["recall"] = got / there if there else 1.0
        _LOG.info("overlap %d: the audited vectors have %d of %d links", overlap, got, there)
        if got >= target * there:
            break
        overlap = 2 * overlap if 2 * overlap < len(centres[size]) else 0
    # a node's component is named by the smallest vec_id in it
    reach = components(found.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")), space, "reach")
    whole = nodes.join(reach.select(F.col("id").alias("node"), "component"), "node", "left").join(counts, "node", "left")
    whole = space.write(whole.select("node", "low", F.coalesce("component", "node").alias("part"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "whole")
    names = whole.groupBy("part").agg(F.min("low").alias("component_id"))
    whole = space.write(whole.join(names, "part").select("node", "n_links", "component_id"), "named")
    space.drop("nodes", "whole", *(f"{t}{o}" for t in ("placed", "graph", "found", "differ", "agreed") for o in used))
    out = units.withColumn("node", F.when(F.col("unit").isNotNull(), F.xxhash64("unit"))).join(whole.hint("merge"), "node", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def op9_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
WITH RECURSIVE wide AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
fit AS (
  SELECT vec_id, e FROM wide WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
  AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM fit a JOIN fit b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS d, vec_id AS r FROM embeddings UNION SELECT d, y FROM reach JOIN links ON r = x)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM (SELECT d AS vec_id, min(r) AS component_id FROM reach GROUP BY d)
LEFT JOIN (SELECT x AS vec_id, count(*) AS n FROM links GROUP BY x) USING (vec_id)
"""
