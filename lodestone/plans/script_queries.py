"""Procedural statements, user functions, JSON, sketches, sampling and prose metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import text_metrics

from .catalogue import register, table


def script(name: str, text: str, oracle: str) -> None:
    """A SQL script; its last statement gives the rows."""

    def query(spark, sf_dir):
        for t in ("orders", "nation", "customer"):
            if t in text:
                table(spark, sf_dir, t).createOrReplaceTempView(t)
        return spark.sql(text)

    register(name, oracle)(query)


script("script_declare_set", "BEGIN DECLARE n BIGINT DEFAULT 3; SET n = n * 14; SELECT n AS n; END", "SELECT 42::BIGINT AS n")
script("script_if", "BEGIN DECLARE n BIGINT; SET n = (SELECT count(*) FROM nation); IF n > 20 THEN SELECT 'many' AS size; ELSE SELECT 'few' AS size; END IF; END", "SELECT CASE WHEN count(*) > 20 THEN 'many' ELSE 'few' END AS size FROM nation")
script("script_case", "BEGIN DECLARE n BIGINT DEFAULT 2; CASE n WHEN 1 THEN SELECT 'one' AS v; WHEN 2 THEN SELECT 'two' AS v; ELSE SELECT 'more' AS v; END CASE; END", "SELECT 'two' AS v")
script("script_while", "BEGIN DECLARE i BIGINT DEFAULT 0; DECLARE s BIGINT DEFAULT 0; WHILE i < 10 DO SET i = i + 1; SET s = s + i * i; END WHILE; SELECT s AS s; END", "SELECT 385::BIGINT AS s")
script("script_repeat", "BEGIN DECLARE i BIGINT DEFAULT 1; REPEAT SET i = i * 3; UNTIL i > 100 END REPEAT; SELECT i AS i; END", "SELECT 243::BIGINT AS i")
script("script_loop_leave_iterate", "BEGIN DECLARE i BIGINT DEFAULT 0; DECLARE s BIGINT DEFAULT 0; a: LOOP SET i = i + 1; IF i > 20 THEN LEAVE a; END IF; IF i % 2 = 1 THEN ITERATE a; END IF; SET s = s + i; END LOOP a; SELECT s AS s; END", "SELECT 110::BIGINT AS s")
script("script_for", "BEGIN DECLARE s BIGINT DEFAULT 0; FOR r AS SELECT n_regionkey AS k FROM nation DO SET s = s + r.k; END FOR; SELECT s AS s; END", "SELECT sum(n_regionkey)::BIGINT AS s FROM nation")
script("script_handler", "BEGIN DECLARE v STRING DEFAULT 'none'; DECLARE EXIT HANDLER FOR DIVIDE_BY_ZERO BEGIN SELECT 'caught' AS v; END; SELECT 1 / 0 AS v; END", "SELECT 'caught' AS v")
script("script_execute_immediate", "BEGIN DECLARE q STRING DEFAULT 'SELECT count(*) AS n FROM orders WHERE o_totalprice > ?'; EXECUTE IMMEDIATE q USING 100000; END", "SELECT count(*) AS n FROM orders WHERE o_totalprice > 100000")


@register("user_scalar_function", "SELECT o_orderkey, o_totalprice * 2 + 1 AS gross FROM orders")
def user_scalar_function(spark, sf_dir):
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION lodestone_gross(x DOUBLE) RETURNS DOUBLE RETURN x * 2 + 1")
    return spark.sql("SELECT o_orderkey, lodestone_gross(o_totalprice) AS gross FROM orders")


@register("user_table_function", "SELECT n_name, n_nationkey FROM nation WHERE n_regionkey = 2")
def user_table_function(spark, sf_dir):
    table(spark, sf_dir, "nation").createOrReplaceTempView("nation")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION lodestone_nations(r INT) RETURNS TABLE (n_name STRING, n_nationkey INT) RETURN SELECT n_name, n_nationkey FROM nation WHERE n_regionkey = r")
    return spark.sql("SELECT * FROM lodestone_nations(2)")


@register("json_build_and_read", """SELECT n_nationkey, n_name AS name, n_regionkey::BIGINT AS region, 2::BIGINT AS size FROM nation""")
def json_build_and_read(spark, sf_dir):
    """Objects written as JSON text, parsed to variants and read by path."""
    made = table(spark, sf_dir, "nation").select("n_nationkey", F.to_json(F.struct(F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")).alias("nation"), F.array(F.lit(1), F.lit(2)).alias("list"))).alias("j"))
    v = F.parse_json("j")
    return made.select("n_nationkey", F.variant_get(v, "$.nation.name", "string").alias("name"), F.variant_get(v, "$.nation.region", "bigint").alias("region"), F.json_array_length(F.get_json_object("j", "$.list")).cast("long").alias("size"))


@register("json_each_key", "SELECT event_id, unnest(json_keys(props)) AS key FROM events")
def json_each_key(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.explode(F.json_object_keys("props")).alias("key"))


@register("sketch_union")
def sketch_union(spark, sf_dir):
    """Distinct users by HLL sketches made by event type and merged; checked to two per cent in the tests."""
    parts = table(spark, sf_dir, "events").groupBy("event_type").agg(F.hll_sketch_agg("user_id", 14).alias("s"))
    return parts.agg(F.hll_sketch_estimate(F.hll_union_agg("s")).alias("users"))


@register("tablesample")
def tablesample(spark, sf_dir):
    """A Bernoulli sample of a tenth of the rows; the feature is the sampling itself."""
    return table(spark, sf_dir, "lineitem").sample(0.1, seed=5).select("l_orderkey", "l_linenumber")


@register("prose_metrics")
def prose_metrics(spark, sf_dir):
    """Words, sentences and burstiness of each document; look-around patterns have no counterpart in the oracle."""
    return text_metrics.prose_metrics(table(spark, sf_dir, "documents"), "doc_id")
