"""Clauses and operators of queries that need only Spark SQL or a few column expressions, and pipes that it lacks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import pipes

from .catalogue import register, table

c = F.col


def sql(name: str, text: str, oracle: str | None = None, views: str = "orders customer nation region lineitem events part") -> None:
    def query(spark, sf_dir):
        for view in views.split():
            if view in text:
                table(spark, sf_dir, view).createOrReplaceTempView(view)
        return spark.sql(text)

    register(name, oracle or text)(query)


sql("select_all", "SELECT ALL o_orderstatus FROM orders")
sql("select_as_struct", "SELECT s.n AS n, s.k AS k FROM (SELECT struct(n_name AS n, n_nationkey AS k) AS s FROM nation) WHERE s.k > 3", "SELECT n_name AS n, n_nationkey AS k FROM nation WHERE n_nationkey > 3")
sql("value_table", "SELECT v.* FROM (SELECT explode(array(named_struct('a', n_nationkey, 'b', n_name), named_struct('a', n_regionkey, 'b', 'r'))) AS v FROM nation)", "SELECT n_nationkey AS a, n_name AS b FROM nation UNION ALL SELECT n_regionkey, 'r' FROM nation")
sql("with_expression", "SELECT o_orderkey, w.y * w.y AS square FROM orders, LATERAL (SELECT x + 1 AS y FROM (SELECT o_custkey % 10 AS x)) AS w", "SELECT o_orderkey, (o_custkey % 10 + 1) * (o_custkey % 10 + 1) AS square FROM orders")
sql("is_distinct_from", "SELECT o_orderkey, nullif(o_orderstatus, 'F') IS DISTINCT FROM nullif(o_orderstatus, 'O') AS differ, nullif(o_custkey % 2, 0) IS NOT DISTINCT FROM NULL AS same FROM orders")
sql("like_any", "SELECT p_partkey FROM part WHERE p_type LIKE ANY ('%STEEL%', 'ECONOMY%')", "SELECT p_partkey FROM part WHERE p_type LIKE '%STEEL%' OR p_type LIKE 'ECONOMY%'")
sql("like_all", "SELECT p_partkey FROM part WHERE p_name LIKE ALL ('%a%', '%e%') AND NOT (p_type LIKE ANY ('X%', 'Y%'))", "SELECT p_partkey FROM part WHERE p_name LIKE '%a%' AND p_name LIKE '%e%'")
sql("datetime_subtraction", "SELECT event_id, CAST(extract(DAY FROM (ts - TIMESTAMP_NTZ'2020-01-01 00:00:00')) AS BIGINT) AS days FROM events", "SELECT event_id, extract('day' FROM (ts - TIMESTAMP '2020-01-01'))::BIGINT AS days FROM events")
sql("interval_arithmetic", "SELECT event_id, ts + INTERVAL '2' DAY * 3 - INTERVAL '90' MINUTE AS later FROM events", "SELECT event_id, ts + INTERVAL 6 DAY - INTERVAL 90 MINUTE AS later FROM events")
sql("bitwise_operators", "SELECT o_orderkey, o_custkey & 12 AS both, o_custkey | 5 AS either, o_custkey ^ 9 AS one, ~o_custkey AS flipped, shiftleft(o_custkey, 2) AS up, shiftright(o_custkey, 1) AS down FROM orders", "SELECT o_orderkey, o_custkey & 12 AS both, o_custkey | 5 AS either, xor(o_custkey, 9) AS one, ~o_custkey AS flipped, o_custkey * 4 AS up, o_custkey // 2 AS down FROM orders")
sql("correlated_join", "SELECT n_name, t.c_custkey AS c_custkey FROM nation, LATERAL (SELECT c_custkey FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9000) AS t", "SELECT n_name, c_custkey FROM nation JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9000")
sql("struct_subscript", "SELECT s.a AS a, s['b'] AS b FROM (SELECT named_struct('a', n_nationkey, 'b', n_name) AS s FROM nation)", "SELECT n_nationkey AS a, n_name AS b FROM nation")
sql("mandatory_aggregation", "SELECT count(*) AS n, max(o_totalprice) AS top FROM orders WHERE o_orderkey < 0")
sql("explicit_unnest", "SELECT o_orderkey, e.pos AS place, e.col AS word FROM orders, LATERAL posexplode(split(o_orderpriority, '-')) AS e", "SELECT o_orderkey, unnest(range(len(string_split(o_orderpriority, '-')))) AS place, unnest(string_split(o_orderpriority, '-')) AS word FROM orders")
sql("unpivot_multiple", "SELECT * FROM (SELECT n_nationkey, n_regionkey AS a, n_nationkey + 1 AS b, n_nationkey + 2 AS c, n_nationkey + 3 AS d FROM nation) UNPIVOT INCLUDE NULLS ((x, y) FOR pair IN ((a, b) AS first, (c, d) AS second))", "SELECT n_nationkey, 'first' AS pair, n_regionkey AS x, n_nationkey + 1 AS y FROM nation UNION ALL SELECT n_nationkey, 'second', n_nationkey + 2, n_nationkey + 3 FROM nation")
sql("pipe_intersect", "FROM orders |> SELECT o_custkey |> INTERSECT DISTINCT (SELECT c_custkey FROM customer WHERE c_acctbal > 0)", "SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
sql("pipe_unpivot", "FROM (SELECT n_nationkey AS k, n_regionkey AS a, n_nationkey * 2 AS b FROM nation) |> UNPIVOT (v FOR name IN (a, b))", "SELECT n_nationkey AS k, 'a' AS name, n_regionkey AS v FROM nation UNION ALL SELECT n_nationkey, 'b', n_nationkey * 2 FROM nation")
sql("pipe_with", "WITH rich AS (FROM customer |> WHERE c_acctbal > 5000) FROM rich |> AGGREGATE count(*) AS n GROUP BY c_mktsegment", "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > 5000 GROUP BY c_mktsegment")
sql("pipe_equals_classic", "FROM lineitem |> WHERE l_quantity > 30 |> AGGREGATE sum(l_quantity) AS q GROUP BY l_suppkey |> WHERE q > 100 |> ORDER BY q DESC, l_suppkey |> LIMIT 20", "SELECT l_suppkey, sum(l_quantity) AS q FROM lineitem WHERE l_quantity > 30 GROUP BY l_suppkey HAVING q > 100 ORDER BY q DESC, l_suppkey LIMIT 20")
sql("script_raise", "BEGIN DECLARE n BIGINT; DECLARE EXIT HANDLER FOR SQLEXCEPTION BEGIN SELECT 'raised' AS v; END; SET n = (SELECT count(*) FROM nation WHERE n_nationkey > 24); IF n = 0 THEN SELECT raise_error('none') AS v; END IF; SELECT 'passed' AS v; END", "SELECT 'raised' AS v")
sql("script_assert", "BEGIN DECLARE EXIT HANDLER FOR SQLEXCEPTION BEGIN SELECT 'failed' AS v; END; SELECT assert_true((SELECT count(*) FROM nation) = 25) AS t; SELECT 'held' AS v; END", "SELECT CASE WHEN count(*) = 25 THEN 'held' ELSE 'failed' END AS v FROM nation")
sql("script_return", "BEGIN a: BEGIN DECLARE n BIGINT; SET n = (SELECT count(*) FROM region); SELECT n AS n; LEAVE a; END a; END", "SELECT count(*) AS n FROM region")
sql("script_break_continue", "BEGIN DECLARE s BIGINT DEFAULT 0; a: FOR r AS SELECT n_nationkey AS k FROM nation ORDER BY n_nationkey DO IF r.k > 20 THEN LEAVE a; END IF; IF r.k % 2 = 1 THEN ITERATE a; END IF; SET s = s + r.k; END FOR a; SELECT s AS s; END", "SELECT sum(n_nationkey)::BIGINT AS s FROM nation WHERE n_nationkey <= 20 AND n_nationkey % 2 = 0")


@register("pipe_rename", "SELECT n_nationkey AS key, n_name AS name, n_regionkey FROM nation")
def pipe_rename(spark, sf_dir):
    table(spark, sf_dir, "nation").createOrReplaceTempView("nation")
    return pipes.run(spark, "FROM nation |> RENAME n_nationkey AS key, n_name AS name")


@register("pipe_distinct", "SELECT DISTINCT o_orderstatus FROM orders")
def pipe_distinct(spark, sf_dir):
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    return pipes.run(spark, "FROM orders |> SELECT o_orderstatus |> DISTINCT")


@register("pipe_call", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2 AND n_nationkey > 8")
def pipe_call(spark, sf_dir):
    """A function of a table and arguments; then plain pipes again."""
    table(spark, sf_dir, "nation").createOrReplaceTempView("nation")
    made = {"in_region": lambda df, region: df.filter(c("n_regionkey") == region)}
    return pipes.run(spark, "FROM nation |> CALL in_region(2) |> WHERE n_nationkey > 8 |> SELECT n_nationkey, n_name", made)


@register("pipe_call_match", "SELECT customer, count(*) AS n FROM (SELECT o_custkey AS customer, o_totalprice < lead(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS up FROM orders) WHERE up GROUP BY customer")
def pipe_call_match(spark, sf_dir):
    """Rows followed by a dearer one: a window function called from a pipe."""
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    text = """FROM orders |> EXTEND lead(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS next
              |> WHERE o_totalprice < next |> AGGREGATE count(*) AS n GROUP BY o_custkey |> RENAME o_custkey AS customer"""
    return pipes.run(spark, text)


@register("anti_join_left", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 45)")
def anti_join_left(spark, sf_dir):
    """Parts without a large order line: some stay, some go."""
    large = table(spark, sf_dir, "lineitem").filter("l_quantity >= 45")
    return table(spark, sf_dir, "part").join(large, c("p_partkey") == c("l_partkey"), "left_anti").select("p_partkey")


@register("ks_statistic", """WITH s AS (SELECT o_totalprice AS v, (o_custkey % 3 = 0)::INT AS bad FROM orders),
  t AS (SELECT v, sum(sum(bad)) OVER (ORDER BY v) / (SELECT sum(bad) FROM s) AS x, sum(sum(1 - bad)) OVER (ORDER BY v) / (SELECT sum(1 - bad) FROM s) AS y FROM s GROUP BY v)
  SELECT round(max(abs(x - y)), 8) AS ks FROM t""")
def ks_statistic(spark, sf_dir):
    """The largest distance of two distributions, by counts within ranges of values and then over the ranges."""
    from lodestone.operators.metrics import ks

    return ks(table(spark, sf_dir, "orders").select(c("o_totalprice").alias("v"), (c("o_custkey") % 3 == 0).alias("bad")), "v", "bad")


@register("correlation_matrix", "SELECT round(corr(l_quantity, l_extendedprice), 8) AS q_p, round(corr(l_discount, l_tax), 8) AS d_t FROM lineitem")
def correlation_matrix(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 8).alias("q_p"), F.round(F.corr("l_discount", "l_tax"), 8).alias("d_t"))


@register("listing_filter", """SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' OR starts_with(lower(o_orderpriority), '1-u')) AND o_totalprice >= 100000 AND o_orderpriority <> '5-LOW' AND NOT contains(lower(o_orderpriority), 'medium')
  AND regexp_matches(o_orderpriority, '^[1-4]-[A-Z]') AND o_orderdate > TIMESTAMP '1998-01-01' - INTERVAL 1000 DAY""")
def listing_filter(spark, sf_dir):
    """All operators of a filter expression, with a duration before a fixed now."""
    from lodestone.operators import listing

    built = listing.build_filter({"o_orderstatus": "F"})
    text = f"({built} OR o_orderpriority:1-u*) AND o_totalprice >= 100000 o_orderpriority!=5-LOW AND NOT o_orderpriority:medium AND o_orderpriority ~ \"^[1-4]-[A-Z]\" AND o_orderdate > -P1000D"
    return listing.where(table(spark, sf_dir, "orders"), text, F.lit("1998-01-01").cast("timestamp")).select("o_orderkey")


@register("listing_projection", """SELECT url AS "LINK", regexp_extract(url, '([^/]*)$', 1) AS "LAST", string_split(url, '/')[3] AS host, CASE WHEN page_id % 2 = 0 THEN 'even' ELSE 'odd' END AS kind FROM pages""")
def listing_projection(spark, sf_dir):
    from lodestone.operators import listing

    pages = table(spark, sf_dir, "pages").withColumn("even", c("page_id") % 2 == 0)
    return listing.project(pages, ["url:label=LINK:sort=-1", "url.basename():label=LAST", "url.segment(2):label=host", "even.yesno(yes=even, no=odd):label=kind"])


@register("listing_flatten_formats", """SELECT n_nationkey || ',' || w AS line, 'n_nationkey,words' AS header FROM (SELECT n_nationkey, unnest(string_split(n_name, ' ')) AS w FROM nation)
  UNION ALL SELECT n_nationkey || chr(9) || w, NULL FROM (SELECT n_nationkey, unnest(string_split(n_name, ' ')) AS w FROM nation)
  UNION ALL SELECT '{"n_nationkey":' || n_nationkey || ',"words":"' || w || '"}', NULL FROM (SELECT n_nationkey, unnest(string_split(n_name, ' ')) AS w FROM nation)
  UNION ALL SELECT '- n_nationkey: ' || n_nationkey || chr(10) || '  words: ' || w, NULL FROM (SELECT n_nationkey, unnest(string_split(n_name, ' ')) AS w FROM nation)
  UNION ALL SELECT rpad(n_nationkey::VARCHAR, 11, ' ') || '  ' || lpad(w, (SELECT greatest(5, max(len(x)))::INT FROM (SELECT unnest(string_split(n_name, ' ')) AS x FROM nation)), ' '), 'n_nationkey  ' || lpad('words', (SELECT greatest(5, max(len(x)))::INT FROM (SELECT unnest(string_split(n_name, ' ')) AS x FROM nation)), ' ') FROM (SELECT n_nationkey, unnest(string_split(n_name, ' ')) AS w FROM nation)""")
def listing_flatten_formats(spark, sf_dir):
    """An array flattened in its place, in all five formats."""
    from lodestone.operators import listing

    nested = table(spark, sf_dir, "nation").select("n_nationkey", F.split("n_name", " ").alias("words"))
    flat, out = listing.flatten(nested, "words[]"), None
    for kind in ("csv", "value", "json", "yaml", "table"):
        part = listing.lines(flat, kind, ["left", "right"])
        out = part if out is None else out.unionByName(part)
    return out
