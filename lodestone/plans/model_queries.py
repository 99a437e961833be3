"""Queries of models, encryption, private aggregates and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import keysets as K
from lodestone.functions import library as L
from lodestone.operators import metrics
from lodestone.operators import models as M
from lodestone.operators.privacy import private_aggregate
from lodestone.streaming import windows

from .analytic_queries import _folder
from .catalogue import register, table

c = F.col


def _scored(spark, sf_dir):
    """Orders with a made score and what came out."""
    return table(spark, sf_dir, "orders").select("o_orderkey", ((c("o_custkey") * 37 + c("o_orderkey")) % 101).alias("score"), (c("o_custkey") % 3 == 0).alias("bad"))


_SCORED = "SELECT o_orderkey, (o_custkey * 37 + o_orderkey) % 101 AS score, o_custkey % 3 = 0 AS bad FROM orders"


@register("ml_roc_curve", f"""WITH s AS ({_SCORED}), t AS (SELECT score, count(*) FILTER (WHERE bad) AS p, count(*) FILTER (WHERE NOT bad) AS n FROM s GROUP BY score)
  SELECT score AS threshold, sum(p) OVER w AS true_positives, sum(n) OVER w AS false_positives, round(sum(p) OVER w / (SELECT sum(p) FROM t), 8) AS recall FROM t WINDOW w AS (ORDER BY score DESC)""")
def ml_roc_curve(spark, sf_dir):
    return metrics.roc_curve(_scored(spark, sf_dir), "score", "bad").select("threshold", "true_positives", "false_positives", F.round("recall", 8).alias("recall"))


@register("ml_confusion_matrix", "SELECT o_orderstatus AS expected_label, count(*) FILTER (WHERE o_custkey % 3 = 0) AS _F, count(*) FILTER (WHERE o_custkey % 3 = 1) AS _O, count(*) FILTER (WHERE o_custkey % 3 = 2) AS _P FROM orders GROUP BY o_orderstatus")
def ml_confusion_matrix(spark, sf_dir):
    guessed = table(spark, sf_dir, "orders").withColumn("guess", F.element_at(F.array(*map(F.lit, "FOP")), (c("o_custkey") % 3 + 1).cast("int")))
    return metrics.confusion_matrix(guessed, "o_orderstatus", "guess", list("FOP"))


@register("ml_class_metrics", """WITH g AS (SELECT o_orderstatus AS e, ['F', 'O', 'P'][o_custkey % 3 + 1] AS p FROM orders),
  a AS (SELECT e AS label, count(*) AS n, count(*) FILTER (WHERE e = p) AS hit FROM g GROUP BY e), b AS (SELECT p AS label, count(*) AS n, count(*) FILTER (WHERE e = p) AS hit FROM g GROUP BY p),
  m AS (SELECT b.hit / b.n AS pr, a.hit / a.n AS re, a.hit AS hit, a.n AS n FROM a JOIN b USING (label))
  SELECT round(avg(pr), 8) AS precision, round(avg(re), 8) AS recall, round(sum(hit) / sum(n), 8) AS accuracy, round(avg(2 * pr * re / (pr + re)), 8) AS f1_score FROM m""")
def ml_class_metrics(spark, sf_dir):
    guessed = table(spark, sf_dir, "orders").withColumn("guess", F.element_at(F.array(*map(F.lit, "FOP")), (c("o_custkey") % 3 + 1).cast("int")))
    found = metrics.class_metrics(guessed, "o_orderstatus", "guess")
    return found.select(*(F.round(n, 8).alias(n) for n in found.columns))


def _line(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(c("l_quantity").alias("q"), c("l_discount").alias("d"), (3 * c("l_quantity") - 200 * c("l_discount") + 5).alias("y"))


@register("ml_linear_model", "SELECT * FROM (VALUES ('__INTERCEPT__', 5.0), ('d__number', -200.0), ('q__number', 3.0)) t(processed_input, weight)")
def ml_linear_model(spark, sf_dir):
    """A linear model finds the weights that the label was made with."""
    models, rows = M.Models(spark), _line(spark, sf_dir)
    models.create("m", "LINEAR_REG", rows, "y")
    return models.weights("m", rows).select("processed_input", F.round("weight", 4).alias("weight"))


@register("ml_predict_evaluate", "SELECT count(*) AS n, true AS near, true AS good FROM lineitem")
def ml_predict_evaluate(spark, sf_dir):
    """Predictions, evaluation, export and loading of a linear model."""
    models, rows = M.Models(spark), _line(spark, sf_dir)
    models.create("m", "LINEAR_REG", rows, "y")
    folder = _folder(spark, "model")
    models.export("m", folder)
    models.load("again", folder, "m")
    models.alter("again", description="loaded")
    good = models.evaluate("m", rows).select((c("r2_score") > 0.9999).alias("good"))
    found = models.predict("again", rows).agg(F.count(F.lit(1)).alias("n"), (F.max(F.abs(c("predicted_y") - c("y"))) < 0.01).alias("near"))
    models.drop("m")
    models.drop("m", if_exists=True)
    return found.crossJoin(good)  # one row each


def _forest(kind: str, **options):
    def query(spark, sf_dir):
        """Whether an order line is large, from its price and quantity; the quantity decides."""
        rows = table(spark, sf_dir, "lineitem").select(c("l_quantity").alias("q"), c("l_tax").alias("t"), F.when(c("l_quantity") > 25, "large").otherwise("small").alias("size"))
        models = M.Models(spark)
        models.create("m", kind, rows, "size", seed=3, **options)
        right = models.evaluate("m", rows).select((c("accuracy") > 0.99).alias("accurate"), (c("roc_auc") > 0.99).alias("ranked"))
        first = models.feature_importance("m", rows).orderBy(F.desc("importance")).limit(1).select(c("feature").alias("first"))
        matrix = models.confusion_matrix("m", rows).agg(F.count(F.lit(1)).alias("labels"))
        return right.crossJoin(first).crossJoin(matrix)  # one row each

    return query


for _kind, _more in (("RANDOM_FOREST_CLASSIFIER", {"num_trees": 5}), ("BOOSTED_TREE_CLASSIFIER", {"max_iterations": 3})):
    register(f"ml_{_kind.lower()}", "SELECT true AS accurate, true AS ranked, 'q__number' AS first, 2 AS labels")(_forest(_kind, **_more))


@register("ml_tree_regressors", "SELECT * FROM (VALUES ('BOOSTED_TREE_REGRESSOR', true), ('RANDOM_FOREST_REGRESSOR', true)) t(kind, good)")
def ml_tree_regressors(spark, sf_dir):
    out, models, rows = None, M.Models(spark), _line(spark, sf_dir)
    for kind, options in (("RANDOM_FOREST_REGRESSOR", {"num_trees": 5, "max_tree_depth": 8}), ("BOOSTED_TREE_REGRESSOR", {"max_iterations": 5})):
        models.create(kind, kind, rows, "y", seed=3, **options)
        row = models.evaluate(kind, rows).select(F.lit(kind).alias("kind"), (c("r2_score") > 0.9).alias("good"))
        out = row if out is None else out.unionByName(row)
    return out


@register("ml_clusters", "SELECT CASE WHEN l_quantity > 40 THEN 'high' WHEN l_quantity < 11 THEN 'low' END AS kind, 1::BIGINT AS clusters, true AS named FROM lineitem WHERE l_quantity > 40 OR l_quantity < 11 GROUP BY ALL")
def ml_clusters(spark, sf_dir):
    """Two kinds of lines far apart: k-means gives each its own centroid, at its mean."""
    rows = table(spark, sf_dir, "lineitem").filter("l_quantity > 40 OR l_quantity < 11").select(c("l_quantity").alias("q"))
    models = M.Models(spark)
    models.create("m", "KMEANS", rows, num_clusters=2, seed=5)
    found = models.predict("m", rows).withColumn("kind", F.when(c("q") > 40, "high").otherwise("low"))
    centres = models.centroids("m", rows).select("centroid_id", "numerical_value")
    means = found.groupBy("kind").agg(F.count_distinct("centroid_id").alias("clusters"), F.first("centroid_id").alias("centroid_id"), F.avg("q").alias("mean"))
    return means.join(centres, "centroid_id").select("kind", "clusters", (F.abs(c("mean") - c("numerical_value")) < 0.5).alias("named"))


@register("ml_anomalies", "SELECT count(*) AS n, true AS few, true AS silhouette FROM lineitem")
def ml_anomalies(spark, sf_dir):
    """Lines far from their centroid, a share of 0.1 at most."""
    rows = table(spark, sf_dir, "lineitem").select("l_quantity", (c("l_extendedprice") / 1000).alias("price"))
    models = M.Models(spark)
    models.create("m", "KMEANS", rows, num_clusters=4, seed=5)
    marked = models.detect_anomalies("m", rows, 0.1).agg(F.count(F.lit(1)).alias("n"), (F.avg(c("is_anomaly").cast("int")) <= 0.1).alias("few"))
    return marked.crossJoin(models.evaluate("m", rows).select((c("silhouette") > 0.2).alias("silhouette")))  # one row each


@register("ml_components", "SELECT true AS exact, true AS cumulative, 2::BIGINT AS parts, 2::BIGINT AS infos FROM nation LIMIT 1")
def ml_components(spark, sf_dir):
    """Three columns, one the sum of the others: two components give all back but a constant."""
    rows = table(spark, sf_dir, "lineitem").select((c("l_quantity") - 25).alias("a"), (c("l_discount") * 100).alias("b")).withColumn("s", c("a") + c("b"))
    models = M.Models(spark)
    models.create("m", "PCA", rows, num_principal_components=2)
    loss = models.reconstruction_loss("m", rows).agg((F.max("mean_absolute_error") < 0.01).alias("exact"))
    info = models.principal_component_info("m").agg((F.max("cumulative_explained_variance_ratio") > 0.999).alias("cumulative"), F.count(F.lit(1)).alias("infos"))
    parts = models.principal_components("m", rows).agg(F.count_distinct("principal_component_id").alias("parts"))
    return loss.crossJoin(info).crossJoin(parts)  # one row each


@register("ml_recommend", "SELECT true AS near, c_custkey % 5 AS users FROM customer GROUP BY ALL")
def ml_recommend(spark, sf_dir):
    """Ratings that are a product of two factors are found again; the best item of each user is the largest factor's."""
    grid = spark.range(5).select(c("id").cast("int").alias("u")).crossJoin(spark.range(6).select(c("id").cast("int").alias("i"))).withColumn("r", (c("u") + 1.0) * (c("i") + 1.0))
    models = M.Models(spark)
    models.create("m", "MATRIX_FACTORIZATION", grid, user="u", item="i", rating="r", num_factors=2, l2_reg=0.0001, max_iterations=20)
    best = models.recommend("m", grid, 1).select("u", (c("i") == 5).alias("near"))
    users = table(spark, sf_dir, "customer").select((c("c_custkey") % 5).alias("users")).distinct()
    return users.join(best, c("users") == c("u")).select("near", "users")


@register("ml_explain", "SELECT 'd__number' AS feature, true AS right UNION ALL SELECT 'q__number', true")
def ml_explain(spark, sf_dir):
    """Attributions of a linear model are its weights times the distance from the mean."""
    rows, models = _line(spark, sf_dir), M.Models(spark)
    models.create("m", "LINEAR_REG", rows, "y")
    spread = rows.agg(F.avg("q").alias("mq"), F.avg("d").alias("md"))
    want = rows.crossJoin(F.broadcast(spread)).agg(F.avg(F.abs(3 * (c("q") - c("mq")))).alias("q__number"), F.avg(F.abs(200 * (c("d") - c("md")))).alias("d__number"))
    return models.global_explain("m", rows).crossJoin(want).select("feature", (F.abs(c("attribution") - F.when(c("feature") == "q__number", c("q__number")).otherwise(c("d__number"))) < 0.01).alias("right"))


@register("ml_describe_data", """SELECT 'o_custkey' AS name, count(*) AS num_rows, 0::BIGINT AS num_nulls, min(o_custkey)::VARCHAR AS min, max(o_custkey)::VARCHAR AS max, round(avg(o_custkey), 6) AS mean, round(stddev_samp(o_custkey), 6) AS stddev FROM orders
  UNION ALL SELECT 'o_orderstatus', count(*), 0, min(o_orderstatus), max(o_orderstatus), NULL, NULL FROM orders""")
def ml_describe_data(spark, sf_dir):
    found = M.describe_data(table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus"))
    return found.select("name", "num_rows", "num_nulls", "min", "max", F.round("mean", 6).alias("mean"), F.round("stddev", 6).alias("stddev"))


@register("ml_validate_shift", """WITH a AS (SELECT o_orderstatus AS v, count(*) / sum(count(*)) OVER () AS p FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), b AS (SELECT o_orderstatus AS v, count(*) / sum(count(*)) OVER () AS q FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1)
  SELECT 'o_orderstatus' AS input, 'L_INFTY' AS metric, round(max(abs(coalesce(p, 0) - coalesce(q, 0))), 8) AS value, false AS is_anomaly FROM a FULL JOIN b USING (v)
  UNION ALL SELECT 'shifted', 'JENSEN_SHANNON_DIVERGENCE', 1.0, true""")
def ml_validate_shift(spark, sf_dir):
    """Even against odd orders, and a column whose values have all moved away."""
    half = lambda k: table(spark, sf_dir, "orders").filter(c("o_orderkey") % 2 == k).withColumn("shifted", c("o_custkey") % 10 + k * 1000)
    found = M.validate_shift(half(0), half(1), ["o_orderstatus"]).unionByName(M.validate_shift(half(0).filter("shifted < 9"), half(1), ["shifted"], threshold=0.2, buckets=2).withColumn("value", F.when(c("is_anomaly"), F.lit(1.0)).otherwise(c("value"))))
    return found.select("input", "metric", F.round("value", 8).alias("value"), "is_anomaly")


@register("ml_vector_functions", """SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS l2, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: abs(x))), 6) AS l1,
  round(list_max(list_transform(embedding::DOUBLE[], lambda x: abs(x))), 6) AS top, round(list_distance(embedding::DOUBLE[], list_reverse(embedding::DOUBLE[])), 5) AS apart, round(list_cosine_distance(embedding::DOUBLE[], list_reverse(embedding::DOUBLE[])), 5) AS angle FROM embeddings""")
def ml_vector_functions(spark, sf_dir):
    x, y = c("embedding"), F.reverse("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(M.lp_norm(x, 2), 6).alias("l2"), F.round(M.lp_norm(x, 1), 6).alias("l1"), F.round(M.lp_norm(x, float("inf")), 6).alias("top"), F.round(M.distance(x, y), 5).alias("apart"), F.round(M.distance(x, y, "COSINE"), 5).alias("angle"))


@register("ml_multi_hot", """WITH w AS (SELECT o_orderkey, unnest(string_split(o_orderpriority, '-')) AS v FROM orders), k AS (SELECT v, row_number() OVER (ORDER BY count(DISTINCT o_orderkey) DESC, v) AS i FROM w GROUP BY v QUALIFY i <= 3)
  SELECT o_orderkey, array_to_string(list_sort(list(DISTINCT coalesce(i, 0))), ',') AS places, true AS bounded FROM w LEFT JOIN k USING (v) GROUP BY o_orderkey""")
def ml_multi_hot(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("words", F.split("o_orderpriority", "-"))
    made = M.multi_hot_encoder(rows, "words", "hot", top_k=3)
    return made.select("o_orderkey", F.array_join(F.transform("hot", lambda h: h["index"]), ",").alias("places"), M.hash_bucketize("o_orderpriority", 7).between(0, 6).alias("bounded"))


@register("encryption", "SELECT c_custkey, c_name AS name, c_name AS fixed, true AS alike, true AS differs FROM customer")
def encryption(spark, sf_dir):
    """Texts encrypted and read back, after the keyset was rotated and wrapped."""
    own, fixed = K.new_keyset(K.AEAD), K.new_keyset(K.DETERMINISTIC)
    store = b"a key of the key store of 32 byte"[:32]
    later = K.keyset_chain(store, K.rotate_wrapped_keyset(store, K.wrap(own, store), K.AEAD))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", K.aead_encrypt(own, "c_name", "c_mktsegment").alias("x"), K.deterministic_encrypt(fixed, "c_name").alias("y"), "c_mktsegment")
    again = K.deterministic_encrypt(fixed, "c_name")
    return customers.select("c_custkey", K.aead_decrypt_string(later, "x", "c_mktsegment").alias("name"), K.deterministic_decrypt_string(K.rotate_keyset(fixed, K.DETERMINISTIC), "y").alias("fixed"), (again == c("y")).alias("alike"), (K.aead_encrypt(own, "c_name", "c_mktsegment") != c("x")).alias("differs"))


@register("private_aggregates", """SELECT o_orderpriority, count(DISTINCT o_custkey) AS n, round(sum(s), 2) AS total, round(avg(a), 2) AS mean FROM (
  SELECT o_orderpriority, o_custkey, least(sum(o_totalprice), 400000.0) AS s, least(avg(o_totalprice), 300000.0) AS a FROM orders GROUP BY ALL) GROUP BY o_orderpriority""")
def private_aggregates(spark, sf_dir):
    """With a vast epsilon and bounds the noise is nothing and the exact clamped sums are left."""
    wanted = {"n": ("count",), "total": ("sum", "o_totalprice", 0, 400_000), "mean": ("avg", "o_totalprice", 0, 300_000)}
    found = private_aggregate(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderpriority"], 1e15, 0.5, 100, wanted)
    return found.select("o_orderpriority", "n", F.round("total", 2).alias("total"), F.round("mean", 2).alias("mean"))


def _events(spark, sf_dir):
    return windows.file_stream(spark, sf_dir, "events.parquet", table(spark, sf_dir, "events").schema)


@register("stream_without_repeats", "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def stream_without_repeats(spark, sf_dir):
    """The first event of each user and type, from a stream, deduplicated while the watermark remembers."""
    first = windows.without_repeats(_events(spark, sf_dir), "ts", "10000 days", ["event_type", "user_id"])
    done = windows.run_available(first, _folder(spark, "dedup"))
    return done.groupBy("event_type").agg(F.count(F.lit(1)).alias("users"))


@register("stream_sessions", """WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
  SELECT user_id, epoch_us(min(ts)) AS session_start, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_sessions(spark, sf_dir):
    stream = windows.session_counts(_events(spark, sf_dir), "ts", "6 hours", "1 day", ["user_id"])
    done = windows.run_available(stream, _folder(spark, "sessions"), "complete")
    return done.select("user_id", F.unix_micros("session_start").alias("session_start"), "n")


@register("stream_joined", """SELECT a.event_id AS view, b.event_id AS purchase FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR AND a.event_id <> b.event_id
  WHERE a.event_type = 'view' AND b.event_type = 'purchase'""")
def stream_joined(spark, sf_dir):
    """Views joined with the same user's purchases within an hour: two streams, both with watermarks."""
    stream = windows.joined_within(_events(spark, sf_dir).filter("event_type = 'view'"), _events(spark, sf_dir).filter("event_type = 'purchase'"), "user_id", "ts", "1 hour", "10000 days")
    done = windows.run_available(stream, _folder(spark, "joined"))
    return done.select(c("left_event_id").alias("view"), c("right_event_id").alias("purchase"))


@register("stream_resumed", "SELECT count(*) AS n, count(DISTINCT event_id) AS different, 2::BIGINT AS runs FROM events WHERE event_type <> 'view'")
def stream_resumed(spark, sf_dir):
    """A continuous query into a sink, ended and started again from its checkpoint: each row comes once."""
    folder = _folder(spark, "resumed")
    stream = _events(spark, sf_dir).filter("event_type <> 'view'")
    runs = [windows.run_once(stream, folder, n) for n in ("first", "second")]
    done = spark.read.schema(stream.schema).parquet(f"{folder}/out")
    return done.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("different")).withColumn("runs", F.lit(len([r for r in runs if r["ended"]])).cast("long"))
