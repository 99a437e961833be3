"""Queries of graphs, row patterns, text and vector search, feature preparation, models, streams and files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators import features as X
from lodestone.operators import search as S
from lodestone.operators.graph import Graph
from lodestone.operators.row_patterns import match_recognize
from lodestone.sources import files
from lodestone.sources.shared import shared_folder
from lodestone.streaming import windows

from .catalogue import register, table


def _folder(spark: SparkSession, label: str) -> str:
    """A new folder that driver and executors share."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


# a graph of nations: two edges from each, with costs

_EDGES = """(SELECT n_nationkey * 2 AS edge_id, n_nationkey AS src, (n_nationkey * 7 + 3) % 25 AS dst, n_nationkey % 4 + 1 AS cost FROM nation
   UNION ALL SELECT n_nationkey * 2 + 1, n_nationkey, (n_nationkey * 3 + 1) % 25, n_nationkey % 3 + 1 FROM nation)"""


def _graph(spark: SparkSession, sf_dir: str) -> Graph:
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    k = F.col("id")
    one = nation.select((k * 2).alias("edge_id"), k.alias("src"), ((k * 7 + 3) % 25).alias("dst"), (k % 4 + 1).alias("cost"))
    two = nation.select((k * 2 + 1).alias("edge_id"), k.alias("src"), ((k * 3 + 1) % 25).alias("dst"), (k % 3 + 1).alias("cost"))
    return Graph(nation, one.unionByName(two))


@register("graph_match", f"SELECT a.n_name AS x, e.cost AS cost, b.n_name AS y FROM {_EDGES} e JOIN nation a ON a.n_nationkey = src JOIN nation b ON b.n_nationkey = dst WHERE a.n_regionkey = 1 AND e.cost > 1")
def graph_match(spark, sf_dir):
    found = _graph(spark, sf_dir).match(("a", F.col("region") == 1), ("e", "right", F.col("cost") > 1), ("b", None))
    return found.select(F.col("a.name").alias("x"), F.col("e.cost").alias("cost"), F.col("b.name").alias("y"))


@register("graph_triangle", f"WITH e AS {_EDGES} SELECT a.src AS x, b.src AS y, c.src AS z FROM e a JOIN e b ON a.dst = b.src JOIN e c ON b.dst = c.src AND c.dst = a.src")
def graph_triangle(spark, sf_dir):
    found = _graph(spark, sf_dir).match(("a", None), ("e", "right", None), ("b", None), ("f", "right", None), ("c", None), ("g", "right", None), ("a", None))
    return found.select(F.col("a.id").alias("x"), F.col("b.id").alias("y"), F.col("c.id").alias("z"))


@register("graph_any_direction", f"WITH e AS {_EDGES} SELECT src AS x, dst AS y FROM e UNION ALL SELECT dst, src FROM e")
def graph_any_direction(spark, sf_dir):
    found = _graph(spark, sf_dir).match(("a", None), ("e", "any", None), ("b", None))
    return found.select(F.col("a.id").alias("x"), F.col("b.id").alias("y"))


_PATHS = f"""WITH RECURSIVE e AS {_EDGES}, p AS (SELECT n_nationkey AS src, n_nationkey AS dst, 0 AS hops, [n_nationkey] AS nodes, CAST([] AS INT[]) AS edges, 0 AS cost FROM nation
   UNION ALL SELECT p.src, e.dst, hops + 1, list_append(nodes, e.dst), list_append(edges, e.edge_id), p.cost + e.cost FROM p JOIN e ON p.dst = e.src WHERE hops < 3 AND ...)"""


@register("graph_walks", _PATHS.replace("...", "true") + " SELECT src, dst, hops, count(*) AS n FROM p WHERE hops BETWEEN 1 AND 3 GROUP BY ALL")
def graph_walks(spark, sf_dir):
    return _graph(spark, sf_dir).paths(1, 3).groupBy("src", "dst", "hops").agg(F.count(F.lit(1)).alias("n"))


@register("graph_trails", _PATHS.replace("...", "NOT list_contains(edges, e.edge_id)") + " SELECT src, dst, hops, count(*) AS n FROM p WHERE hops = 3 GROUP BY ALL")
def graph_trails(spark, sf_dir):
    return _graph(spark, sf_dir).paths(3, 3, "trail").groupBy("src", "dst", "hops").agg(F.count(F.lit(1)).alias("n"))


@register("graph_acyclic", _PATHS.replace("...", "NOT list_contains(nodes, e.dst)") + " SELECT src, dst, hops, count(*) AS n FROM p WHERE hops >= 2 GROUP BY ALL")
def graph_acyclic(spark, sf_dir):
    return _graph(spark, sf_dir).paths(2, 3, "acyclic").groupBy("src", "dst", "hops").agg(F.count(F.lit(1)).alias("n"))


@register("graph_shortest", _PATHS.replace("...", "true").replace("hops < 3", "hops < 5") + " SELECT src, dst, CAST(min(hops) AS INT) AS hops FROM p WHERE hops > 0 GROUP BY src, dst")
def graph_shortest(spark, sf_dir):
    return _graph(spark, sf_dir).shortest(5)


@register("graph_cheapest", _PATHS.replace("...", "true").replace("hops < 3", "hops < 4") + " SELECT src, dst, CAST(min(cost) AS DOUBLE) AS cost FROM p WHERE hops > 0 GROUP BY src, dst")
def graph_cheapest(spark, sf_dir):
    return _graph(spark, sf_dir).cheapest("cost", 4)


@register(
    "match_recognize",
    """WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, event_type = 'view' AS v FROM events),
       g AS (SELECT *, i - row_number() OVER (PARTITION BY user_id, v ORDER BY i) AS k FROM r)
       SELECT user_id, min(event_id) FILTER (WHERE i = low) AS first_event, n FROM (SELECT *, min(i) OVER (PARTITION BY user_id, k) AS low, count(*) OVER (PARTITION BY user_id, k) AS n FROM g WHERE v)
       WHERE n >= 2 GROUP BY user_id, k, n""",
)
def match_recognize_views(spark, sf_dir):
    """Runs of at least two views in a row of a user."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    found = match_recognize(events, ["user_id"], ["ts", "event_id"], {"V": F.col("event_type") == "view"}, "V V+")
    return found.groupBy("user_id", "match_number").agg(F.min_by("event_id", "match_row_number").alias("first_event"), F.count(F.lit(1)).alias("n")).drop("match_number")


_TERMS = "SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z]{4,}')) AS term FROM documents"


@register("bag_of_words", f"SELECT doc_id, term, count(*) AS count FROM ({_TERMS}) GROUP BY doc_id, term")
def bag_of_words(spark, sf_dir):
    return S.term_counts(table(spark, sf_dir, "documents"), "doc_id", S.text_analyze(F.col("text"), "PATTERN", "[a-z]{4,}")).drop("size")


@register(
    "tf_idf",
    f"""WITH t AS ({_TERMS}), c AS (SELECT doc_id, term, count(*) AS n FROM t GROUP BY ALL), s AS (SELECT doc_id, count(*) AS size FROM t GROUP BY doc_id), d AS (SELECT term, count(*) AS df FROM c GROUP BY term)
       SELECT doc_id, term, round(n / size * ln(1 + (SELECT count(*) FROM documents) / (1 + df)), 6) AS tf_idf FROM c JOIN s USING (doc_id) JOIN d USING (term) WHERE df >= 5""",
)
def tf_idf(spark, sf_dir):
    found = S.tf_idf(table(spark, sf_dir, "documents"), "doc_id", S.text_analyze(F.col("text"), "PATTERN", "[a-z]{4,}"), 5)
    return found.withColumn("tf_idf", F.round("tf_idf", 6))


@register("search", "SELECT item_id, len(regexp_extract_all(' ' || lower(text) || ' ', '[^a-z]the[^a-z]')) > 0 AND NOT regexp_matches(' ' || lower(text) || ' ', '[^a-z]was[^a-z]') AS found FROM benchmark")
def search(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", S.search(F.col("text"), "the -was").alias("found"))


@register(
    "vector_search",
    """SELECT query_id, base_id, round(distance, 4) AS distance FROM (SELECT q.vec_id AS query_id, b.vec_id AS base_id, list_distance(q.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS distance,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.embedding::DOUBLE[], b.embedding::DOUBLE[]), b.vec_id) AS k FROM embeddings q, embeddings b WHERE q.vec_id % 20 = 0) WHERE k <= 10""",
)
def vector_search(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    found = S.vector_search(rows, rows.filter("vec_id % 20 = 0"))
    # a vector's distance to itself is not exactly 0 by the expanded square
    return found.select("query_id", "base_id", F.when(F.col("query_id") == F.col("base_id"), 0.0).otherwise(F.round("distance", 4)).alias("distance"))


@register(
    "scalers",
    """SELECT c_custkey, round((c_acctbal - (SELECT avg(c_acctbal) FROM customer)) / (SELECT stddev_samp(c_acctbal) FROM customer), 6) AS standard,
         round((c_acctbal - (SELECT min(c_acctbal) FROM customer)) / (SELECT max(c_acctbal) - min(c_acctbal) FROM customer), 6) AS min_max,
         round(c_acctbal / (SELECT max(abs(c_acctbal)) FROM customer), 6) AS max_abs,
         round((c_acctbal - (SELECT quantile_cont(c_acctbal, 0.5) FROM customer)) / (SELECT quantile_cont(c_acctbal, 0.75) - quantile_cont(c_acctbal, 0.25) FROM customer), 6) AS robust FROM customer""",
)
def scalers(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    for make, name in ((X.standard_scaler, "standard"), (X.min_max_scaler, "min_max"), (X.max_abs_scaler, "max_abs"), (X.robust_scaler, "robust")):
        df = make(df, "c_acctbal", name)
    return df.select("c_custkey", *(F.round(c, 6).alias(c) for c in ("standard", "min_max", "max_abs", "robust")))


@register(
    "encoders",
    """WITH k AS (SELECT c_mktsegment, row_number() OVER (ORDER BY c_mktsegment) AS n FROM (SELECT DISTINCT c_mktsegment FROM customer)), q AS (SELECT quantile_cont(c_acctbal, [0.25, 0.5, 0.75]) AS e FROM customer)
       SELECT c_custkey, n AS label, 'bin_' || (1 + (c_acctbal >= 0)::INT + (c_acctbal >= 5000)::INT) AS bin, 'bin_' || (1 + (c_acctbal >= e[1])::INT + (c_acctbal >= e[2])::INT + (c_acctbal >= e[3])::INT) AS quarter,
         c_mktsegment || '_' || c_nationkey AS crossed, coalesce(nullif(c_acctbal, 0), 0) AS imputed FROM customer JOIN k USING (c_mktsegment), q""",
)
def encoders(spark, sf_dir):
    df = X.label_encoder(table(spark, sf_dir, "customer"), "c_mktsegment", "label")
    df = X.imputer(X.quantile_bucketize(df, "c_acctbal", 4, "quarter"), "c_acctbal", "imputed")
    return df.select("c_custkey", "label", X.bucketize(F.col("c_acctbal"), [0, 5000]).alias("bin"), "quarter", X.feature_cross("c_mktsegment", "c_nationkey")["c_mktsegment_c_nationkey"].alias("crossed"), "imputed")


@register(
    "ngrams_and_polynomials",
    """SELECT p_partkey, array_to_string(list_concat(string_split(p_type, ' '), list_transform(range(1, len(string_split(p_type, ' '))), lambda i: string_split(p_type, ' ')[i] || ' ' || string_split(p_type, ' ')[i + 1])), ',') AS grams,
         round(p_size * p_retailprice, 4) AS product, round(p_retailprice * p_retailprice, 4) AS square FROM part""",
)
def ngrams_and_polynomials(spark, sf_dir):
    poly = X.polynomial_expand(["p_size", "p_retailprice"])
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(X.ngrams(F.split("p_type", " "), 1, 2), ",").alias("grams"), F.round(poly["p_size_p_retailprice"], 4).alias("product"), F.round(poly["p_retailprice_p_retailprice"], 4).alias("square"))


@register("linear_regression", "SELECT round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_r2(l_extendedprice, l_quantity), 5) AS r2 FROM lineitem")
def linear_regression(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice")
    weights = X.linear_regression(rows, ["l_quantity"], "l_extendedprice")
    scored = X.evaluate_regression(X.predict_linear(rows, weights), "l_extendedprice", "predicted_label")
    return scored.select(F.lit(round(weights["__INTERCEPT__"], 3)).alias("intercept"), F.lit(round(weights["l_quantity"], 4)).alias("slope"), F.round("r2_score", 5).alias("r2"))


@register("ml_kmeans")
def ml_kmeans(spark, sf_dir):
    """Clusters of the embeddings; sizes by cluster."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = table(spark, sf_dir, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    return KMeans(k=8, seed=7).fit(rows).transform(rows).groupBy("prediction").agg(F.count(F.lit(1)).alias("n"))


@register("ml_logistic_regression")
def ml_logistic_regression(spark, sf_dir):
    """Whether a customer's balance is negative, from nation and segment; the counts of the confusion matrix."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler

    rows = table(spark, sf_dir, "customer").withColumn("label", (F.col("c_acctbal") < 2000).cast("double"))
    stages = [StringIndexer(inputCol="c_mktsegment", outputCol="s"), OneHotEncoder(inputCols=["s", "c_nationkey"], outputCols=["a", "b"]), VectorAssembler(inputCols=["a", "b"], outputCol="features"), LogisticRegression(regParam=0.01)]
    scored = Pipeline(stages=stages).fit(rows).transform(rows)
    return X.confusion_matrix(scored, "label", "prediction")


@register("ml_pca")
def ml_pca(spark, sf_dir):
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = table(spark, sf_dir, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    model = PCA(k=2, inputCol="features", outputCol="p").fit(rows)
    return model.transform(rows).select("vec_id", F.round(F.abs(vector_to_array("p")[0]), 4).alias("first"))


@register(
    "psi",
    """WITH q AS (SELECT quantile_cont(o_totalprice, [0.2, 0.4, 0.6, 0.8]) AS e FROM orders WHERE o_orderkey % 2 = 0),
       b AS (SELECT (o_totalprice >= e[1])::INT + (o_totalprice >= e[2])::INT + (o_totalprice >= e[3])::INT + (o_totalprice >= e[4])::INT AS bin, o_orderkey % 2 AS half FROM orders, q),
       s AS (SELECT bin, sum(1 - half) / (SELECT count(*) FROM orders WHERE o_orderkey % 2 = 0) AS x, sum(half) / (SELECT count(*) FROM orders WHERE o_orderkey % 2 = 1) AS y FROM b GROUP BY bin)
       SELECT round(sum((y - x) * ln(y / x)), 8) AS psi FROM s""",
)
def psi(spark, sf_dir):
    """Population stability between even and odd orders, over the fifths of the even ones."""
    orders = table(spark, sf_dir, "orders").select("o_totalprice", (F.col("o_orderkey") % 2).alias("half"))
    edges = orders.filter("half = 0").agg(F.percentile("o_totalprice", [0.2, 0.4, 0.6, 0.8]).alias("e"), F.count(F.lit(1)).alias("n"))
    counted = orders.join(F.broadcast(edges)).withColumn("bin", F.size(F.filter("e", lambda q: q <= F.col("o_totalprice"))))
    shares = counted.groupBy("bin").agg(F.sum(1 - F.col("half")).alias("a"), F.sum("half").alias("b"))
    whole = Window.partitionBy(F.lit(1))
    x, y = F.col("a") / F.sum("a").over(whole), F.col("b") / F.sum("b").over(whole)
    return shares.select(x.alias("x"), y.alias("y")).agg(F.round(F.sum((F.col("y") - F.col("x")) * F.log(F.col("y") / F.col("x"))), 8).alias("psi"))


@register("stream_tumbling_window", "SELECT epoch_us(date_trunc('hour', ts)) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling_window(spark, sf_dir):
    """Hourly windows of the event stream, run over all files there are."""
    schema = table(spark, sf_dir, "events").schema
    stream = windows.windowed_counts(windows.file_stream(spark, sf_dir, "events.parquet", schema), "ts", "1 hour", "10 minutes", ["event_type"], "value")
    done = windows.run_available(stream, _folder(spark, "stream"), "complete")
    return done.select(F.unix_micros("window_start").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


def _round_trip(name: str, format_: str, **options) -> None:
    @register(f"files_{format_}", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        given, folder = table(spark, sf_dir, name), _folder(spark, f"files-{format_}")
        files.export(given, folder, format_, **options)
        return files.load(spark, folder, format_, given.schema, **options)


_round_trip("customer", "csv", header="true")
_round_trip("customer", "json")
_round_trip("customer", "orc")
