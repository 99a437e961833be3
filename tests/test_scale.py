"""What large tables need: plans of bounded size, memory by different values, thresholds between all values."""

import base64
import random

import numpy as np
import pytest
import __spark_entry__ as entry
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.sql import functions as F

from lodestone.functions import geography as G
from lodestone.functions import library as L
from lodestone.functions import texts as X
from lodestone.operators import clusters
from lodestone.operators.models import Models
from oracle import DATA

c = F.col


def analysed(df):
    return df._jdf.queryExecution().analyzed().toString()


@pytest.mark.parametrize("kind,options", [("BOOSTED_TREE_CLASSIFIER", {"max_iterations": 1}), ("RANDOM_FOREST_CLASSIFIER", {"num_trees": 3})])
def test_trees_have_a_threshold_between_any_two_of_fifty_values(spark, kind, options):
    cuts = [5, 19, 25, 40]
    wrong = []
    for k in cuts:
        rows = spark.range(20_000).select((c("id") % 50 + 1).alias("q"), (c("id") % 7).alias("t"), F.when(c("id") % 50 + 1 > k, "large").otherwise("small").alias("size"))
        models = Models(spark)
        models.create("m", kind, rows, "size", seed=3, inputs=["q"], max_tree_depth=1, **options)
        wrong += [k for r in models.evaluate("m", rows).collect() if r.accuracy < 1]
    assert wrong == []


def test_geohashes_and_back_against_halving(spark):
    def halved(lng, lat, length):
        boxes, bits = [[-180.0, 180.0], [-90.0, 90.0]], ""
        for i in range(5 * length):
            box, x = boxes[i % 2], (lng, lat)[i % 2]
            middle = sum(box) / 2
            bits += "1" if x >= middle else "0"
            box[0 if x >= middle else 1] = middle
        return "".join(G.GEOHASH[int(bits[i : i + 5], 2)] for i in range(0, len(bits), 5)), sum(boxes[0]) / 2, sum(boxes[1]) / 2

    draw = random.Random(5)
    points = [(draw.uniform(-180, 180), draw.uniform(-90, 90)) for _ in range(50)] + [(-180.0, -90.0), (0.0, 0.0), (179.999999, 89.999999)]
    rows = spark.createDataFrame(points, "lng double, lat double").select(F.struct("lng", "lat").alias("p"))
    for length in (1, 2, 5, 11, 12):
        hashed = rows.select("p", G.st_geohash("p", length).alias("h"))
        for r in hashed.select("p", "h", G.st_geogpointfromgeohash("h").alias("b")).collect():
            want, lng, lat = halved(r.p.lng, r.p.lat, length)
            assert r.h == want and abs(r.b.lng - lng) < 1e-9 and abs(r.b.lat - lat) < 1e-9
    long = spark.createDataFrame([("u33dc0cppu33dc",), ("u33dc0cppu33dc0cppu33dc0cpp",)], "h string").select(G.st_geogpointfromgeohash("h").alias("b")).collect()
    assert all(abs(r.b.lng - 13.405) < 1e-4 and abs(r.b.lat - 52.52) < 1e-4 for r in long)
    plan = analysed(rows.select(G.st_geogpointfromgeohash(G.st_geohash("p", 12))))
    assert plan.count("p#") < 100


def test_points_along_lines_need_no_plan_that_multiplies(spark):
    line = spark.createDataFrame([([(0.0, 0.0), (10.0, 0.0), (10.0, 30.0)],), ([(5.0, 5.0), (5.0, 5.0)],), ([(5.0, 5.0)],)], "l array<struct<lng: double, lat: double>>")
    made = line.select(G.st_lineinterpolatepoint("l", F.lit(0.5)).alias("m"))
    first, second, third = (r.m for r in made.collect())
    assert abs(first.lng - 10) < 1e-9 and abs(first.lat - 10) < 1e-9 and tuple(second) == (5.0, 5.0) and third is None
    assert analysed(made).count("asin") < 5


def test_base_32_and_code_points_of_long_texts(spark):
    draw = random.Random(7)
    known = [(bytes(draw.randrange(256) for _ in range(n)),) for n in (*range(12), 3_000)]
    rows = spark.createDataFrame(known, "x binary").select("x", X.to_base32("x").alias("t"))
    for r in rows.select("x", "t", X.from_base32("t").alias("b")).collect():
        assert r.t == base64.b32encode(r.x).decode() and bytes(r.b) == bytes(r.x)
    assert analysed(rows.select(X.from_base32(X.to_base32("x")))).count("x#") < 40
    # U+FEFF is a character like others, at any place
    texts = spark.createDataFrame([("﻿a﻿😀",), ("",), (None,)], "x string")
    found = texts.select("x", L.to_code_points("x").alias("p"), L.code_points_to_string(L.to_code_points("x")).alias("y")).collect()
    assert [r.p for r in found] == [[0xFEFF, 97, 0xFEFF, 0x1F600], [], None] and [r.y for r in found] == [r.x for r in found]


def test_small_files_are_dealt_to_all_cores(spark):
    for name in ("fn_text_more", "geo_hashes", "geo_along"):
        assert "RoundRobinPartitioning" in entry.queries()[name](spark, str(DATA / "sf0.001"))._jdf.queryExecution().executedPlan().toString()


def test_runs_stand_for_ordered_values(spark):
    rows = spark.createDataFrame([(1, "b"), (1, "a"), (1, "b"), (1, None), (None, "x"), (2, None)], "k int, v string")
    found = L.value_runs(rows, ["k"], "v").select("k", L.runs_size("runs").alias("n"), L.runs_string("runs", "|").alias("t")).collect()
    gathered = rows.groupBy("k").agg(F.size(L.array_agg("v")).alias("n"), L.string_agg("v", "|", order=["v"]).alias("t")).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(map(tuple, gathered), key=repr) == [(1, 4, "a|b|b"), (2, 1, None), (None, 1, "x")]


def test_fn_aggregate_gathers_counts_and_no_rows(spark):
    plan = entry.queries()["fn_aggregate"](spark, str(DATA / "sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" in plan and not any("collect_list" in line and "l_linestatus" in line.split("Aggregate", 1)[-1] for line in plan.splitlines())


def test_equal_rows_are_one_to_clusters_and_anomalies(spark):
    few = [(float(v), float(v % 3)) for v in (*range(10), *range(100, 110))]
    rows = spark.createDataFrame([r for i, r in enumerate(few) for _ in range(1 + i % 4)] + [(500.0, 1.0)], "a double, b double")
    models = Models(spark)
    made = models.create("m", "KMEANS", rows, num_clusters=3, seed=5)
    # the learner has seen each different row once
    assert made.learner.summary.predictions.count() == len(few) + 1
    centres = sorted(tuple(map(float, v)) for v in made.learner.clusterCenters())
    plain = rows.toPandas()
    want = sorted(tuple(plain[(plain.a >= low) & (plain.a < high)].mean()) for low, high in ((0, 50), (50, 200), (200, 600)))
    assert all(abs(x - y) < 1e-9 for g, w in zip(centres, want) for x, y in zip(g, w))
    marked = models.detect_anomalies("m", rows, 0.1).collect()
    near = [min(((r.a - x) ** 2 + (r.b - y) ** 2) ** 0.5 for x, y in centres) for r in marked]
    bar = sorted(near)[int((len(near) - 1) * 0.9)], sorted(near)[-(-(len(near) - 1) * 9 // 10)]
    assert len(marked) == rows.count() and all(abs(r.distance - d) < 1e-9 for r, d in zip(marked, near))
    assert all(r.is_anomaly for r in marked if r.distance > bar[1] + 1e-9) and not any(r.is_anomaly for r in marked if r.distance < bar[0] - 1e-9)


def test_many_different_rows_are_clustered_in_passes_and_the_learner_holds_centres_only(spark):
    n = clusters.FEW + 10_000
    rows = spark.range(n).select((c("id") % 3 * 1000 + c("id") / n).alias("a"), (c("id") % 7).cast("int").alias("b")).withColumn("a", F.when(F.rand(1) < 0.001, F.lit(None)).otherwise(c("a"))).localCheckpoint()
    models = Models(spark)
    made = models.create("m", "KMEANS", rows, num_clusters=3, seed=5)
    assert made.learner.summary.predictions.count() == 3
    plain = rows.toPandas().dropna()
    plain["kind"] = (plain.a // 1000).astype(int)
    want = sorted(map(tuple, plain.groupby("kind")[["a", "b"]].mean().to_numpy()))
    centres = sorted(tuple(map(float, v)) for v in made.learner.clusterCenters())
    assert all(abs(x - y) < 1e-6 for g, w in zip(centres, want) for x, y in zip(g, w))
    found = models.evaluate("m", rows).first()
    cost = sum(((plain[plain.kind == k][["a", "b"]].to_numpy() - w) ** 2).sum() for k, w in enumerate(want))
    index = ClusteringEvaluator(featuresCol="__features").evaluate(made.stages.transform(clusters_input(rows)))
    assert abs(found.training_cost - cost) < 1e-6 * cost and abs(found.silhouette - index) < 1e-6
    assert models.predict("m", rows.dropna()).groupBy("centroid_id").agg(F.min("a"), F.max("a")).filter("`max(a)` - `min(a)` > 2").count() == 0


def clusters_input(rows):
    return rows.dropna().select(*(c(n).cast("double").alias(f"{n}__number") for n in rows.columns))


def test_silhouette_is_the_evaluators(spark):
    rows = spark.createDataFrame([(float(v) ** 1.5 + far, float(v * 7 % 5)) for far in (0, 300, 1e6) for v in range(20)] + [(-5e5, 0.0)], "a double, b double")
    centres = [[40.0, 2.0], [340.0, 2.0], [1e6, 2.0], [-5e5, 0.0]]
    x = rows.toPandas().to_numpy()
    apart = ((x[:, None] - x[None]) ** 2).sum(2)
    at = ((x[:, None] - np.array(centres)[None]) ** 2).sum(2).argmin(1)
    values = []
    for i, k in enumerate(at):
        if (at == k).sum() == 1:
            values.append(0.0)
            continue
        own = apart[i, at == k].sum() / ((at == k).sum() - 1)
        other = min(apart[i, at == j].mean() for j in set(at) - {k})
        values.append((other - own) / max(own, other))
    assert abs(clusters.silhouette(rows, centres) - np.mean(values)) < 1e-6


@pytest.mark.parametrize("share", [0.0, 0.001, 0.3, 0.5, 0.9, 0.99, 1.0])
def test_percentile_is_exact_where_values_are_many(spark, monkeypatch, share):
    monkeypatch.setattr(clusters, "FEW", 50)
    ids = spark.range(4001)
    for values in (ids.select(F.rand(3).alias("distance")), ids.select(F.floor(F.rand(3) * 4).cast("double")), ids.select(F.exp(F.rand(3) * 600)), ids.select(F.when(c("id") % 2 == 0, 1.0).otherwise(c("id").cast("double"))), ids.select(F.when(c("id") % 3 > 0, c("id").cast("double")))):
        values = values.toDF("v").localCheckpoint()
        assert clusters.percentile(values, share) == values.agg(F.percentile("v", share).alias("p")).first().p
    assert clusters.percentile(values.filter("v < 0"), share) is None


def test_united_rows_have_the_centres_of_all_rows(spark):
    rows = spark.range(3000).select((c("id") % 3 * 100 + c("id") % 11).cast("double").alias("a"), (c("id") % 5).cast("double").alias("b"))
    (one, cost), (other, same) = (clusters.centres_of(rows, 3, seed=5, grouped=g) for g in (True, False))
    assert np.allclose(sorted(map(tuple, one)), sorted(map(tuple, other)), atol=1e-9) and abs(cost - same) < 1e-6 * cost
    assert clusters.repeats(rows) == (False, True)
