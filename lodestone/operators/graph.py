"""Bounded property-graph patterns over node and edge tables, compiled to joins.

nodes: (id, ...properties); edges: (edge_id, src, dst, ...properties), both with a label column where labels matter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODES = ("walk", "trail", "acyclic", "simple")


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame

    def steps(self, direction: str = "right", where: Column | None = None) -> DataFrame:
        """(from, to, edge_id, ...): edges as steps to the right, left or either way."""
        edges = self.edges if where is None else self.edges.filter(where)
        more = [c for c in edges.columns if c not in ("src", "dst")]
        right = edges.select(F.col("src").alias("from"), F.col("dst").alias("to"), *more)
        left = edges.select(F.col("dst").alias("from"), F.col("src").alias("to"), *more)
        return {"right": right, "left": left, "any": right.unionByName(left)}[direction]

    def match(self, *pattern: tuple) -> DataFrame:
        """A chain (node, edge, node, ...) as columns name.property.

        A node is (name, predicate or None), an edge (name, direction, predicate or None); predicates are over the
        element's own columns. A node name that comes again is the same node.
        """
        found, seen, last = None, set(), ""
        for i, part in enumerate(pattern):
            if i % 2 == 0:
                name, where = part
                if name in seen:
                    found = found.filter(F.col("__to") == F.col(name)["id"]) if found is not None else found
                else:
                    nodes = self.nodes if where is None else self.nodes.filter(where)
                    nodes = nodes.select(F.struct(*nodes.columns).alias(name), F.col("id").alias("__id"))
                    found = nodes.drop("__id") if found is None else found.join(nodes, F.col("__to") == F.col("__id")).drop("__id")
                    seen.add(name)
                found, last = found.drop("__to"), name
            else:
                name, direction, where = part
                steps = self.steps(direction, where)
                steps = steps.select(F.struct("edge_id", *[c for c in steps.columns if c not in ("from", "to", "edge_id")]).alias(name), F.col("from").alias("__from"), F.col("to").alias("__to"))
                found = found.join(steps, F.col(last)["id"] == F.col("__from")).drop("__from")
        return found

    def paths(self, least: int, most: int, mode: str = "walk", direction: str = "right", where: Column | None = None, cost: str | None = None) -> DataFrame:
        """(src, dst, hops, nodes, edges, cost): paths of least to most edges, as unions of fixed lengths.

        mode: walk (anything), trail (no edge again), acyclic (no node again), simple (none but the ends the same).
        """
        if mode not in MODES or not 0 <= least <= most:
            raise ValueError("paths need a mode and bounds")
        value = F.lit(0.0) if cost is None else F.col(cost).cast("double")
        steps = self.steps(direction, where).select("from", "to", F.col("edge_id").alias("__edge"), value.alias("__cost"))
        level = self.nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0).alias("hops"), F.array("id").alias("nodes"), F.array().cast(f"array<{steps.schema['__edge'].dataType.simpleString()}>").alias("edges"), F.lit(0.0).alias("cost"))
        found = level if least == 0 else None
        for hops in range(1, most + 1):
            grown = level.join(steps, level["dst"] == steps["from"])
            if mode == "trail":
                grown = grown.filter(~F.array_contains("edges", F.col("__edge")))
            elif mode == "acyclic":
                grown = grown.filter(~F.array_contains("nodes", F.col("to")))
            elif mode == "simple":
                closed = (F.col("src") == F.col("dst")) & (F.col("hops") > 0)
                grown = grown.filter(~closed & ((F.col("to") == F.col("src")) | ~F.array_contains("nodes", F.col("to"))))
            level = grown.select("src", F.col("to").alias("dst"), F.lit(hops).alias("hops"), F.concat("nodes", F.array("to")).alias("nodes"), F.concat("edges", F.array("__edge")).alias("edges"), (F.col("cost") + F.col("__cost")).alias("cost"))
            if hops >= least:
                found = level if found is None else found.unionByName(level)
        return found

    def shortest(self, most: int, **more) -> DataFrame:
        """(src, dst, hops): the length of a shortest path of 1 to most edges for each pair of ends.

        Each round keeps one row for each pair, so that it grows with the pairs and not with the paths.
        """
        steps = self.steps(more.get("direction", "right"), more.get("where")).select("from", "to").distinct()
        level = steps.select(F.col("from").alias("src"), F.col("to").alias("dst"), F.lit(1).alias("hops"))
        found = level
        for hops in range(2, most + 1):
            grown = level.join(steps, level["dst"] == steps["from"]).select("src", F.col("to").alias("dst")).distinct()
            level = grown.join(found, ["src", "dst"], "left_anti").withColumn("hops", F.lit(hops))
            found = found.unionByName(level)
        return found

    def cheapest(self, cost: str, most: int, **more) -> DataFrame:
        """(src, dst, cost): the least cost of a path of 1 to most edges; costs must be positive and finite."""
        checked = F.when((F.col(cost) > 0) & (F.col(cost) < float("inf")), F.col(cost).cast("double")).otherwise(F.raise_error(F.lit("a cost isn't positive and finite")))
        steps = self.steps(more.get("direction", "right"), more.get("where")).select("from", "to", checked.alias("__cost"))
        steps = steps.groupBy("from", "to").agg(F.min("__cost").alias("__cost"))
        found = steps.select(F.col("from").alias("src"), F.col("to").alias("dst"), F.col("__cost").alias("cost"))
        for _ in range(most - 1):
            grown = found.join(steps, found["dst"] == steps["from"]).select("src", F.col("to").alias("dst"), (F.col("cost") + F.col("__cost")).alias("cost"))
            found = found.unionByName(grown).groupBy("src", "dst").agg(F.min("cost").alias("cost"))
        return found
