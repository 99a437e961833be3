import pytest
from pyspark.sql import functions as F

from lodestone.operators import relational as R
from lodestone.operators import search as S
from lodestone.operators.graph import Graph
from lodestone.operators.row_patterns import match_at, match_recognize, parse, program
from lodestone.sources.files import fields_from_schema, schema_from_fields
from lodestone.streaming import windows


def test_pivot_names():
    names = [R.pivot_name(v) for v in (None, "Q1", 1, -1, 1.5, "a b", True)]
    assert names == ["NULL", "Q1", "_1", "minus_1", "_1_point_5", "a_b", "TRUE"]


def test_merge_refuses_several_sources(spark):
    target = spark.createDataFrame([(1, "a")], "k long, v string")
    source = spark.createDataFrame([(1, "x"), (1, "y")], "k long, v string")
    clause = R.When("matched", "update", {"v": F.col("s.v")})
    with pytest.raises(Exception, match="several source rows"):
        R.merge(target, source, F.col("t.k") == F.col("s.k"), [clause]).collect()


def test_merge_first_clause_wins(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k long, v string")
    source = spark.createDataFrame([(1, "x"), (4, "n")], "k long, v string")
    clauses = [
        R.When("matched", "update", {"v": F.lit("first")}),
        R.When("matched", "delete"),
        R.When("not matched", "insert", {"k": F.col("s.k"), "v": F.col("s.v")}),
        R.When("not matched by source", "delete", condition=F.col("t.k") == 3),
    ]
    assert sorted(map(tuple, R.merge(target, source, F.col("t.k") == F.col("s.k"), clauses).collect())) == [(1, "first"), (2, "b"), (4, "n")]


def test_as_of_join_forward(spark):
    left = spark.createDataFrame([("a", 5), ("a", 9)], "k string, t long")
    right = spark.createDataFrame([("a", 5, 1), ("a", 8, 2), ("b", 1, 3)], "k string, t long, v long")
    back = R.as_of_join(left, right, ["k"], "t", "t", ["v"])
    ahead = R.as_of_join(left, right, ["k"], "t", "t", ["v"], "forward")
    assert sorted((r.t, r.v) for r in back.collect()) == [(5, 1), (9, 2)]
    assert [(r.t, r.v) for r in sorted(ahead.collect())] == [(5, 1), (9, None)]


def test_gap_fill_ways(spark):
    rows = spark.createDataFrame([("2023-11-01 09:34:01", 74), ("2023-11-01 09:36:00", 77), ("2023-11-01 09:37:00", 78), ("2023-11-01 09:38:01", 80)], "t string, v long").withColumn("t", F.to_timestamp("t"))
    filled = {how: [r.v for r in R.gap_fill(rows, "t", 60_000_000, [], {"v": how}).orderBy("t").collect()] for how in ("null", "locf", "linear")}
    assert filled["null"] == [None, 77, 78, None] and filled["locf"] == [74, 77, 78, 78]
    assert filled["linear"][0] == pytest.approx(75.487, abs=1e-3) and filled["linear"][3] == pytest.approx(79.967, abs=1e-3)


def matched(pattern, text):
    rows = [{c: True} for c in text]
    found = match_at(program(parse(pattern)), rows, 0)
    return "".join(found) if found else None


@pytest.mark.parametrize(("pattern", "text", "want"), [("A* B+", "AAB", "AAB"), ("A+?", "AAA", "A"), ("A{2}", "AAA", "AA"), ("A{1,2} A", "AAA", "AAA"), ("(A | B)* C", "ABAC", "ABAC"), ("A? B", "B", "B"), ("A B", "AC", None), ("A{2,}", "A", None), ("A | A B", "AB", "A"), ("(A B)+", "ABABA", "ABAB")])
def test_patterns(pattern, text, want):
    assert matched(pattern, text) == want


@pytest.mark.parametrize("pattern", ["(A", "A)", "+", "A |)"])
def test_bad_patterns(pattern):
    with pytest.raises(ValueError):
        parse(pattern)


def test_match_recognize_next_row(spark):
    rows = spark.createDataFrame([("p", i, v) for i, v in enumerate([1, 2, 3, 1])], "k string, i long, v long")
    up = F.col("v") > 1
    found = match_recognize(rows, ["k"], ["i"], {"S": F.lit(True), "U": up}, "S U", to_next_row=True)
    assert sorted((r.match_number, r.i, r.classifier) for r in found.collect()) == [(1, 0, "S"), (1, 1, "U"), (2, 1, "S"), (2, 2, "U")]


def test_graph_modes(spark):
    nodes = spark.createDataFrame([(i,) for i in range(4)], "id long")
    edges = spark.createDataFrame([(1, 0, 1, 1.0), (2, 1, 0, 1.0), (3, 1, 2, 5.0), (4, 0, 2, 9.0)], "edge_id long, src long, dst long, w double")
    graph = Graph(nodes, edges)
    count = {m: graph.paths(1, 3, m).count() for m in ("walk", "trail", "acyclic", "simple")}
    assert count["walk"] > count["trail"] > count["simple"] > count["acyclic"]
    assert {(r.src, r.dst): r.cost for r in graph.cheapest("w", 3).collect()}[0, 2] == 6.0
    with pytest.raises(Exception, match="positive"):
        Graph(nodes, edges.withColumn("w", F.lit(-1.0))).cheapest("w", 2).collect()


def test_search_grammar(spark):
    df = spark.createDataFrame([("the Blue-green car",), ("a red car",), (None,)], "t string")
    hits = lambda q: [r.h for r in df.select(S.search(F.col("t"), q).alias("h")).collect()]
    assert hits("car") == [True, True, False] and hits('"green car"') == [True, False, False]
    assert hits("blue OR red") == [True, True, False] and hits("(blue OR red) AND -green") == [False, True, False]


def test_schemas():
    fields = [{"name": "id", "type": "INTEGER", "mode": "REQUIRED"}, {"name": "items", "type": "RECORD", "mode": "REPEATED", "fields": [{"name": "tags", "type": "STRING", "mode": "REPEATED"}]}, {"name": "price", "type": "NUMERIC", "mode": "NULLABLE", "description": "net"}]
    assert fields_from_schema(schema_from_fields(fields)) == fields


def test_streams(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:10", "a"), (1, "2024-01-01 00:00:10", "a"), (2, "2024-01-01 00:20:00", "a")]
    given = spark.createDataFrame(rows, "id long, t string, k string").withColumn("t", F.to_timestamp("t"))
    given.write.parquet(f"{tmp_path}/in")
    stream = lambda: windows.file_stream(spark, f"{tmp_path}/in", "*.parquet", given.schema)
    once = windows.run_available(windows.without_repeats(stream(), "t", "1 hour", ["id"]), f"{tmp_path}/once")
    assert once.count() == 2
    sessions = windows.run_available(windows.session_counts(stream(), "t", "5 minutes", "1 minute", ["k"]), f"{tmp_path}/sessions", "complete")
    assert sorted(r.n for r in sessions.collect()) == [1, 2]
