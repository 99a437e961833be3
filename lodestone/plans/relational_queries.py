"""Queries of the relational surface: clauses and pipes as SQL text, and the operators of operators.relational."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators import relational as R

from .catalogue import register, table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def sql(name: str, text: str, oracle: str | None = None) -> None:
    """A query given as SQL text over views of the tables."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        for t in TABLES:
            if t in text:
                table(spark, sf_dir, t).createOrReplaceTempView(t)
        return spark.sql(text)

    register(name, oracle or text)(query)


sql("select_star_except", "SELECT * EXCEPT (c_name) FROM customer", "SELECT * EXCLUDE (c_name) FROM customer")
sql("select_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
sql("where_predicates", """SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 20000 AND 90000 AND o_orderpriority LIKE '%-%'
    AND (o_orderstatus IN ('O', 'F') OR NOT o_custkey % 2 = 0) AND o_orderstatus IS DISTINCT FROM 'P'""")
sql("case_expressions", """SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 ELSE 3 END AS a,
    CASE WHEN o_totalprice > 100000 THEN 'high' WHEN o_totalprice > 50000 THEN 'mid' END AS b,
    coalesce(nullif(o_custkey % 4, 0), -1) AS d, if(o_custkey > 500, 'x', 'y') AS e FROM orders""",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 ELSE 3 END AS a,
    CASE WHEN o_totalprice > 100000 THEN 'high' WHEN o_totalprice > 50000 THEN 'mid' END AS b,
    coalesce(nullif(o_custkey % 4, 0), -1) AS d, CASE WHEN o_custkey > 500 THEN 'x' ELSE 'y' END AS e FROM orders""")  # fmt: skip
sql("join_inner", """SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON c_custkey = o_custkey
    JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
sql("join_left", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 100000 GROUP BY c_custkey")
sql("join_right", "SELECT n_name, count(c_custkey) AS n FROM customer RIGHT JOIN nation ON c_nationkey = n_nationkey AND c_acctbal < 0 GROUP BY n_name")
sql("join_full", "SELECT c.k AS a, s.k AS b FROM (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal > 9000) c FULL OUTER JOIN (SELECT DISTINCT s_nationkey AS k FROM supplier) s ON c.k = s.k")
sql("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
sql("join_comma", "SELECT r_name, n_name FROM region, nation WHERE r_regionkey = n_regionkey")
sql("join_theta", "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey")
sql("join_using", "SELECT k, a, b FROM (SELECT o_custkey AS k, max(o_totalprice) AS a FROM orders GROUP BY o_custkey) JOIN (SELECT c_custkey AS k, c_acctbal AS b FROM customer) USING (k)",
    "SELECT k, a, b FROM (SELECT o_custkey AS k, max(o_totalprice) AS a FROM orders GROUP BY o_custkey) x JOIN (SELECT c_custkey AS k, c_acctbal AS b FROM customer) y USING (k)")
sql("join_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
sql("join_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
sql("in_subquery", "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
sql("scalar_subquery", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)")
sql("correlated_subquery", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer")
sql("table_subquery", "SELECT avg(n) AS mean FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey) t")
sql("group_by_ordinal", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
sql("group_by_all", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
sql("group_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
sql("group_grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping(o_orderstatus) AS BIGINT) AS g FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderpriority), ())")
sql("group_rollup", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
sql("group_cube", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
sql("aggregate_filter_distinct", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS d, count(*) FILTER (WHERE l_discount > 0.05) AS n FROM lineitem GROUP BY l_returnflag")
sql("window_ranking", """SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS rk,
    dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS dr, ntile(4) OVER w AS nt, round(percent_rank() OVER w, 6) AS pr, round(cume_dist() OVER w, 6) AS cd
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
sql("window_navigation", """SELECT o_orderkey, lag(o_totalprice, 1) OVER w AS a, lead(o_totalprice, 2) OVER w AS b, first_value(o_orderkey) OVER w AS c,
    last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS d,
    nth_value(o_orderkey, 2) OVER w AS e FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
sql("window_frames", """SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 2) AS s,
    count(*) OVER (PARTITION BY o_orderpriority ORDER BY o_custkey RANGE BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS n FROM orders""")
sql("order_limit_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5")
sql("union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
sql("union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
sql("intersect_distinct", "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9500 INTERSECT SELECT s_nationkey FROM supplier")
sql("except_distinct", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
sql("cte", "WITH big AS (SELECT * FROM orders WHERE o_totalprice > 150000), names AS (SELECT c_custkey, c_name FROM customer) SELECT c_name, count(*) AS n FROM big JOIN names ON o_custkey = c_custkey GROUP BY c_name")
sql("cte_recursive", "WITH RECURSIVE r(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM r WHERE n < 15) SELECT n, f FROM r")
sql("array_subquery", "SELECT n_regionkey, array_join(array_sort(collect_list(n_name)), ',') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
sql("unnest_offset", "SELECT p_partkey, pos AS at, word FROM part LATERAL VIEW posexplode(split(p_type, ' ')) AS pos, word", "SELECT p_partkey, CAST(unnest(range(len(string_split(p_type, ' ')))) AS INT) AS at, unnest(string_split(p_type, ' ')) AS word FROM part")
sql("struct_fields", "SELECT s.a AS a, s.b AS b FROM (SELECT named_struct('a', n_name, 'b', n_regionkey) AS s FROM nation)", "SELECT s.a AS a, s.b AS b FROM (SELECT {'a': n_name, 'b': n_regionkey} AS s FROM nation) t")
sql("date_arithmetic", "SELECT o_orderkey, date_format(date_add(CAST(o_orderdate AS DATE), 7), 'yyyy-MM-dd') AS a, datediff(DATE '1998-12-01', CAST(o_orderdate AS DATE)) AS b FROM orders",
    "SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE) + 7, '%Y-%m-%d') AS a, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-12-01') AS INT) AS b FROM orders")

sql("pipe_select_where_order", "FROM orders |> WHERE o_totalprice > 100000 |> SELECT o_orderkey, o_totalprice |> ORDER BY o_totalprice DESC, o_orderkey |> LIMIT 10",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
sql("pipe_extend_set_drop", "FROM customer |> EXTEND c_acctbal * 2 AS twice |> SET c_name = lower(c_name) |> DROP c_mktsegment |> AS x |> WHERE x.twice > 0",
    "SELECT c_custkey, lower(c_name) AS c_name, c_nationkey, c_acctbal, c_acctbal * 2 AS twice FROM customer WHERE c_acctbal * 2 > 0")
sql("pipe_aggregate_join", "FROM lineitem |> JOIN orders ON l_orderkey = o_orderkey |> AGGREGATE round(sum(l_extendedprice), 2) AS total, count(*) AS n GROUP BY o_orderpriority",
    "SELECT o_orderpriority, round(sum(l_extendedprice), 2) AS total, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderpriority")
sql("pipe_set_operations", "FROM nation |> SELECT n_nationkey |> UNION ALL (SELECT r_regionkey FROM region) |> EXCEPT DISTINCT (SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000)",
    "(SELECT n_nationkey FROM nation UNION ALL SELECT r_regionkey FROM region) EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000")
sql("pipe_pivot", "FROM orders |> SELECT o_orderpriority, o_orderstatus, o_totalprice |> PIVOT (count(o_totalprice) FOR o_orderstatus IN ('O' AS o, 'F' AS f))",
    "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'F') AS f FROM orders GROUP BY o_orderpriority")

sql("tpch_pricing_summary", """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc,
    round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""")
sql("tpch_revenue_by_nation", """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey
    JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey GROUP BY n_name""")
sql("tpch_discount_change", "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")


@register("select_star_replace", "SELECT * REPLACE (upper(n_name) AS n_name) FROM nation")
def select_star_replace(spark, sf_dir):
    return R.select_replace(table(spark, sf_dir, "nation"), {"n_name": F.upper("n_name")})


@register("qualify", "SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def qualify(spark, sf_dir):
    best = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return R.qualify(table(spark, sf_dir, "orders"), {"rn": best}, F.col("rn") == 1)


@register("pivot", "SELECT o_orderpriority, max(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS top_O, max(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS top_F FROM orders GROUP BY o_orderpriority")
def pivot(spark, sf_dir):
    given = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderstatus", "o_totalprice")
    return R.pivot(given, {"top": F.max("o_totalprice")}, "o_orderstatus", ["O", "F"])


@register("unpivot", "SELECT s_suppkey, unnest(['key', 'nation']) AS what, unnest([s_suppkey, s_nationkey]) AS value FROM supplier")
def unpivot(spark, sf_dir):
    given = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_suppkey").alias("a"), F.col("s_nationkey").cast("long").alias("b"))
    return R.unpivot(given, {"a": "key", "b": "nation"}, "what", "value")


@register("having_max", "SELECT o_custkey, count(*) AS n, min(o_orderkey) AS first FROM orders o WHERE o_orderpriority = (SELECT max(i.o_orderpriority) FROM orders i WHERE i.o_custkey = o.o_custkey) GROUP BY o_custkey")
def having_max(spark, sf_dir):
    return R.having_extreme(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderpriority", {"n": F.count(F.lit(1)), "first": F.min("o_orderkey")})


@register("having_min", "SELECT o_custkey, count(*) AS n FROM orders o WHERE o_orderpriority = (SELECT min(i.o_orderpriority) FROM orders i WHERE i.o_custkey = o.o_custkey) GROUP BY o_custkey")
def having_min(spark, sf_dir):
    return R.having_extreme(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderpriority", {"n": F.count(F.lit(1))}, greatest=False)


@register("aggregation_threshold", "SELECT p_brand, count(*) AS n FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY p_brand HAVING count(DISTINCT l_suppkey) >= 90")
def aggregation_threshold(spark, sf_dir):
    joined = table(spark, sf_dir, "part").join(table(spark, sf_dir, "lineitem"), F.col("p_partkey") == F.col("l_partkey"))
    return R.aggregation_threshold(joined, ["p_brand"], "l_suppkey", 90, {"n": F.count(F.lit(1))})


def _merge_source(spark, sf_dir):
    """A tenth of the orders repriced, and some with new keys."""
    orders = table(spark, sf_dir, "orders")
    old = orders.filter("o_orderkey % 10 = 3").select("o_orderkey", (F.col("o_totalprice") * 2).alias("price"))
    return old.unionByName(orders.filter("o_orderkey % 10 = 4").select((F.col("o_orderkey") + 10_000_000).alias("o_orderkey"), F.col("o_totalprice").alias("price")))


@register(
    "merge",
    """WITH src AS (SELECT o_orderkey, o_totalprice * 2 AS price FROM orders WHERE o_orderkey % 10 = 3
         UNION ALL SELECT o_orderkey + 10000000, o_totalprice FROM orders WHERE o_orderkey % 10 = 4),
       tgt AS (SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders)
       SELECT coalesce(t.o_orderkey, s.o_orderkey) AS o_orderkey,
         CASE WHEN t.o_orderkey IS NULL THEN s.price WHEN s.o_orderkey IS NOT NULL AND t.o_orderstatus <> 'P' THEN s.price ELSE t.o_totalprice END AS o_totalprice,
         CASE WHEN t.o_orderkey IS NULL THEN 'N' ELSE t.o_orderstatus END AS o_orderstatus
       FROM tgt t FULL JOIN src s ON t.o_orderkey = s.o_orderkey
       WHERE NOT (t.o_orderkey IS NOT NULL AND s.o_orderkey IS NULL AND t.o_orderkey % 10 = 5)
         AND NOT (t.o_orderkey IS NOT NULL AND s.o_orderkey IS NOT NULL AND t.o_orderstatus = 'P')""",
)
def merge(spark, sf_dir):
    target = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    clauses = [
        R.When("matched", "delete", condition=F.col("t.o_orderstatus") == "P"),
        R.When("matched", "update", {"o_totalprice": F.col("s.price")}),
        R.When("not matched", "insert", {"o_orderkey": F.col("s.o_orderkey"), "o_totalprice": F.col("s.price"), "o_orderstatus": F.lit("N")}),
        R.When("not matched by source", "delete", condition=F.col("t.o_orderkey") % 10 == 5),
    ]
    return R.merge(target, _merge_source(spark, sf_dir), F.col("t.o_orderkey") == F.col("s.o_orderkey"), clauses)


@register(
    "as_of_join",
    """SELECT e.event_id, max_by(p.value, p.ts) AS price FROM events e LEFT JOIN events p ON p.user_id = e.user_id AND p.ts <= e.ts AND p.event_type = 'purchase'
       WHERE e.event_type = 'click' GROUP BY e.event_id""",
)
def as_of_join(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    clicks = events.filter("event_type = 'click'").select("event_id", "user_id", "ts")
    bought = events.filter("event_type = 'purchase'").select("user_id", "ts", F.col("value").alias("price"))
    return R.as_of_join(clicks, bought, ["user_id"], "ts", "ts", ["price"]).select("event_id", "price")


@register(
    "range_join",
    """SELECT a.o_orderkey AS x, b.o_orderkey AS y FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey
       AND epoch_us(a.o_orderdate) // 86400000000 < epoch_us(b.o_orderdate) // 86400000000 + 30 AND epoch_us(b.o_orderdate) // 86400000000 < epoch_us(a.o_orderdate) // 86400000000 + 30""",
)
def range_join(spark, sf_dir):
    """Pairs of a customer's orders whose thirty days overlap."""
    day = F.unix_date(F.to_date("o_orderdate")).cast("long")
    side = lambda k, a, b: table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias(k), day.alias(a), (day + 30).alias(b))
    pairs = R.range_join(side("x", "a", "b"), side("y", "c", "d"), ("a", "b"), ("c", "d"), 60, ["o_custkey"])
    return pairs.filter("x < y").select("x", "y")


@register(
    "sessionize",
    """WITH r AS (SELECT event_id, user_id, epoch_us(ts) AS a, epoch_us(ts) + 7200000000 AS b FROM events),
       g AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM r),
       s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k FROM g)
       SELECT event_id, min(a) OVER (PARTITION BY user_id, k) AS session_start, max(b) OVER (PARTITION BY user_id, k) AS session_end FROM s""",
)
def sessionize(spark, sf_dir):
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    given = table(spark, sf_dir, "events").select("event_id", "user_id", at.alias("a"), (at + 7_200_000_000).alias("b"))
    return R.sessionize(given, ["user_id"], "a", "b").select("event_id", "session_start", "session_end")


@register(
    "gap_fill",
    """WITH p AS (SELECT event_type, epoch_us(date_trunc('hour', ts)) AS us, max(value) AS v FROM events GROUP BY ALL),
       e AS (SELECT event_type, min(us) AS a, max(us) AS b FROM p GROUP BY event_type),
       g AS (SELECT event_type, unnest(range(a, b + 1, 1800000000)) AS us FROM e)
       SELECT g.event_type, g.us, round(r.v, 6) AS v FROM g ASOF JOIN p r ON g.event_type = r.event_type AND g.us >= r.us""",
)
def gap_fill(spark, sf_dir):
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp"))
    hourly = table(spark, sf_dir, "events").groupBy("event_type", hour.alias("ts")).agg(F.max("value").alias("v"))
    filled = R.gap_fill(hourly, "ts", 1_800_000_000, ["event_type"], {"v": "locf"})
    return filled.select("event_type", F.unix_micros("ts").alias("us"), F.round("v", 6).alias("v"))


@register(
    "change_history",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'DELETE' ELSE 'UPDATE' END AS _change_type FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 5 = 0
       UNION ALL SELECT o_orderkey + 10000000, 'INSERT' FROM orders WHERE o_orderkey % 11 = 0""",
)
def change_history(spark, sf_dir):
    before = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    after = before.filter("o_orderkey % 7 <> 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 5 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    after = after.unionByName(before.filter("o_orderkey % 11 = 0").withColumn("o_orderkey", F.col("o_orderkey") + 10_000_000))
    return R.changes(before, after, ["o_orderkey"]).select("o_orderkey", "_change_type")


@register(
    "scorecard_auc",
    """WITH s AS (SELECT c_acctbal AS score, (c_nationkey < 8)::INT AS bad FROM customer),
       g AS (SELECT score, sum(bad) AS b, count(*) - sum(bad) AS g FROM s GROUP BY score),
       k AS (SELECT sum(b) OVER (ORDER BY score) AS cb, sum(g) OVER (ORDER BY score) AS cg, g, b, sum(b) OVER () AS tb, sum(g) OVER () AS tg FROM g)
       SELECT round(sum((cb - b / 2.0) * g) / max(tb * tg), 6) AS auc, round(max(abs(cb / tb - cg / tg)), 6) AS ks FROM k""",
)
def scorecard_auc(spark, sf_dir):
    """ROC-AUC by trapezoids and the Kolmogorov-Smirnov statistic, over scores aggregated before the windows.

    The running sums are per range of scores and then over the ranges, so that no window holds all scores.
    """
    scored = table(spark, sf_dir, "customer").select(F.col("c_acctbal").alias("score"), (F.col("c_nationkey") < 8).cast("int").alias("bad"))
    grouped = scored.groupBy("score").agg(F.sum("bad").alias("b"), F.sum(1 - F.col("bad")).alias("g"))
    ranged = grouped.withColumn("range", F.floor(F.col("score") / 100))
    totals = ranged.groupBy("range").agg(F.sum("b").alias("rb"), F.sum("g").alias("rg"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0)
    totals = totals.select("range", F.coalesce(F.sum("rb").over(before), zero).alias("pb"), F.coalesce(F.sum("rg").over(before), zero).alias("pg"), F.sum("rb").over(whole).alias("tb"), F.sum("rg").over(whole).alias("tg"))
    inside = Window.partitionBy("range").orderBy("score")
    run = ranged.join(totals, "range").select("b", "g", "tb", "tg", (F.sum("b").over(inside) + F.col("pb")).alias("cb"), (F.sum("g").over(inside) + F.col("pg")).alias("cg"))
    area = F.sum((F.col("cb") - F.col("b") / 2) * F.col("g")) / F.max(F.col("tb") * F.col("tg"))
    return run.agg(F.round(area, 6).alias("auc"), F.round(F.max(F.abs(F.col("cb") / F.col("tb") - F.col("cg") / F.col("tg"))), 6).alias("ks"))
