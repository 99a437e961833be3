"""Edges of the function families, the store, pipes, graphs, encryption and private aggregates, that whole-table queries don't reach."""

import math

import pytest
from pyspark.sql import functions as F

from lodestone.functions import geography as G
from lodestone.functions import json as J
from lodestone.functions import keysets as K
from lodestone.functions import library as L
from lodestone.functions import texts as X
from lodestone.functions import times as T
from lodestone.operators import models, pipes
from lodestone.operators import property_graph as P
from lodestone.operators.privacy import private_aggregate
from lodestone.operators.relational import changes
from lodestone.sources.store import Store, StoreError


@pytest.fixture(scope="module")
def value(spark):
    one = spark.range(1)
    return lambda column: one.select(column.alias("v")).first()["v"]


def test_changes_see_moved_nulls_and_null_keys(spark):
    schema = "k int, a string, b string"
    before = spark.createDataFrame([(1, None, "x"), (2, "y", None), (None, "n", "n")], schema)
    after = spark.createDataFrame([(1, "x", None), (2, "y", None), (None, "n", "m"), (3, "z", "z")], schema)
    found = sorted(((r.k, r.a, r.b, r._change_type) for r in changes(before, after, ["k"]).collect()), key=str)
    assert found == sorted([(1, "x", None, "UPDATE"), (None, "n", "m", "UPDATE"), (3, "z", "z", "INSERT")], key=str)


def test_json_edges(value):
    text = F.lit
    assert value(J.json_value(text('{"a": "[x]"}'), "$.a")) == "[x]"
    assert value(J.json_query(text('{"a": "x"}'), "$.a")) == '"x"' and value(J.json_query(text('{"a": null}'), "$.a")) is None
    with pytest.raises(Exception, match="MALFORMED"):
        value(F.to_json(J.parse_json(text("{broken"))))
    assert value(F.to_json(J.safe_parse_json(text("{broken")))) is None
    with pytest.raises(Exception, match="not a whole number"):
        value(J.json_int64(text("1.5")))
    assert value(J.json_int64(text("10.0"))) == 10 and value(J.json_int64(text("null"))) is None
    assert value(J.lax_int64(text('"x"'))) is None and value(J.lax_bool(text("0"))) is False
    assert J.steps('$.a[0]["b c"]') == ["a", 0, "b c"]
    with pytest.raises(ValueError):
        J.steps("a.b")
    assert value(J.json_set(text("[1]"), "$.a", F.lit(1))) == "[1]"
    assert value(J.json_remove(text('{"a":{"b":1,"c":2}}'), "$.a.b")) == '{"a":{"c":2}}'


def test_library_probes(value):
    assert value(L.trim(F.lit("\t a \n"))) == "a"
    assert value(L.code_points_to_string(F.array(F.lit(0x1F600)))) == "\U0001f600" and value(L.to_code_points(F.lit(""))) == []
    assert value(L.net_host(F.lit("::bad"))) is None and value(L.net_host(F.lit("https://[::1]:80/x"))) == "[::1]"
    with pytest.raises(Exception, match="not an IP address"):
        value(L.net_ip_from_string(F.lit("300.1.1.1")))
    assert value(F.hex(L.net_safe_ip_from_string(F.lit("::1")))) == "0" * 31 + "1" and value(L.net_safe_ip_from_string(F.lit("1:2"))) is None
    day = lambda n: F.lit(f"2024-01-0{n}").cast("date")
    with pytest.raises(Exception, match="no intersection"):
        value(L.range_intersect(L.range_(day(1), day(2)), L.range_(day(3), day(4))))
    assert value(L.range_intersect(F.lit(None).cast("struct<start: date, end: date>"), L.range_(day(3), day(4)))) is None
    with pytest.raises(Exception, match="0 to 255"):
        value(X.code_points_to_bytes(F.array(F.lit(256))))
    assert value(X.to_base32(F.lit("").cast("binary"))) == "" and value(X.from_base32(F.lit("")).cast("string")) == ""
    with pytest.raises(Exception, match="not a number"):
        value(X.parse_numeric(F.lit("1x")))
    assert value(X.format("%s|%T|%t", F.lit(None).cast("string"), F.lit("a"), F.lit(1))) is None
    assert value(X.format("%'d %5.1f", F.lit(1234567), F.lit(2.25))) == "1,234,567   2.3"


def test_times(value):
    assert value(T.time_add(F.lit("23:59:59.5"), 1, "SECOND")) == "00:00:00.5"
    assert value(T.time_diff(F.lit("00:00:00"), F.lit("23:00:00"), "HOUR")) == -23
    assert value(T.datetime_add(F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"), 1, "MONTH")).isoformat() == "2024-02-29T00:00:00"
    justified = value(T.justify_interval(T.make_interval(0, 1, -35, 0, 0, -1)))
    assert (justified.months, justified.days, justified.micros) == (0, -5, -1_000_000)
    with pytest.raises(ValueError):
        T.datetime_diff(F.lit("2024-01-01"), F.lit("2024-01-01"), "FORTNIGHT")


def test_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    store.create_schema("s")
    with pytest.raises(StoreError, match="exists"):
        store.create_schema("s")
    store.create_table("s.t", "a int not null, b string", defaults={"b": "'none'"})
    with pytest.raises(Exception, match="must not be null"):
        store.insert("s.t", spark.createDataFrame([(None, "x")], "a int, b string"))
    store.insert("s.t", spark.createDataFrame([(i, str(i)) for i in range(6)], "a int, b string").repartition(3))
    files = set(store._version("s.t")["files"])
    assert store.delete("s.t", "a = 2") == 1 and store.update("s.t", {"b": "DEFAULT"}, "a = 1") == 1
    # only the files with those rows are new
    assert files & set(store._version("s.t")["files"]) and store.delete("s.t", "a = 77") == 0
    assert sorted(map(tuple, store.read("s.t").collect())) == [(0, "0"), (1, "none"), (3, "3"), (4, "4"), (5, "5")]
    source = spark.createDataFrame([(3, "c"), (3, "d")], "k int, v string")
    with pytest.raises(StoreError, match="several rows"):
        store.update_from("s.t", source, "t.a = s.k", {"b": "s.v"})
    for bad in (lambda: store.set_data_type("s.t", "b", "int"), lambda: store.read("s.u"), lambda: store.rename_column("s.t", "x", "y"), lambda: store.drop("s.t", "VIEW"), lambda: store.commit(), lambda: store.drop_schema("s")):
        with pytest.raises(StoreError):
            bad()
    with pytest.raises(StoreError, match="as of"):
        store.read("s.t", 0.0)
    again = Store(spark, f"file://{tmp_path}/store")
    assert again.read("s.t").count() == 5 and len(again.version_times("s.t")) == 4


def test_pipes(spark):
    assert pipes.steps("FROM t |> WHERE x = '|>' |> SELECT (1 |> 2)") == ["FROM t", "WHERE x = '|>'", "SELECT (1 |> 2)"]
    spark.range(5).createOrReplaceTempView("five")
    assert pipes.run(spark, "FROM five |> RENAME id AS n |> WHERE n > 2 |> DISTINCT").count() == 2
    with pytest.raises(KeyError):
        pipes.run(spark, "FROM five |> RENAME no AS n")
    with pytest.raises(KeyError):
        pipes.run(spark, "FROM five |> CALL nothing()")


def test_graphs(spark):
    people = spark.createDataFrame([(1, "a"), (2, "b"), (None, "x")], "k int, name string")
    knows = spark.createDataFrame([(1, 1, 2), (2, None, 2)], "e int, x int, y int")
    graphs = P.Graphs()
    graphs.create("g", {"p": P.Nodes(people, "k")}, {"knows": P.Edges(knows, ["e"], ("p", "x"), ("p", "y"))})
    with pytest.raises(ValueError):
        graphs.create("g", {}, {})
    with pytest.raises(KeyError):
        graphs.drop("h")
    found = graphs.query("g").match(("a", None), ("e", "right", None), ("b", None)).return_(F.col("a.name").alias("x"), F.col("b.name").alias("y")).collect()
    assert [tuple(r) for r in found] == [("a", "b")] and graphs.known["g"].nodes.count() == 2
    for bad in ("a |", "(a", "a b", "&"):
        with pytest.raises(ValueError):
            P.label_is(bad)


def test_keysets(spark, value):
    own, other = K.new_keyset(K.AEAD), K.new_keyset(K.AEAD)
    sealed = bytes(value(K.aead_encrypt(own, F.lit("text"))))
    assert value(K.aead_decrypt_string(K.rotate_keyset(own, K.AEAD), F.lit(bytearray(sealed)))) == "text"
    with pytest.raises(Exception, match="no key"):
        value(K.aead_decrypt_string(other, F.lit(bytearray(sealed))))
    with pytest.raises(Exception):
        value(K.aead_decrypt_string(own, F.lit(bytearray(sealed)), F.lit("more")))
    assert value(K.aead_decrypt_string(own, F.lit(None).cast("binary"))) is None
    assert K.keyset_length(K.add_key_from_raw_bytes(own, K.AEAD, b"k" * 32)) == 2
    wrapped = K.new_wrapped_keyset(b"store", K.AEAD)
    assert K.keyset_length(K.unwrap(K.rewrap_keyset(b"store", b"next", wrapped), b"next")) == 1
    with pytest.raises(ValueError):
        K.unwrap(wrapped, b"wrong")
    with pytest.raises(ValueError):
        K.keyset_from_json('{"primaryKeyId": 1, "key": []}')


def test_private_aggregates(spark):
    rows = [(u, g, 1.0) for u in range(2000) for g in ("a", "b")] + [(9999, "rare", 5.0)]
    df = spark.createDataFrame(rows, "u int, g string, x double")
    found = {r.g: r.n for r in private_aggregate(df, "u", ["g"], 2.0, 1e-6, 2, {"n": ("count",)}, seed=3).collect()}
    # one unit's group stays hidden, the others are near the truth but not exact
    assert set(found) == {"a", "b"} and all(abs(n - 2000) < 60 for n in found.values())
    bounded = private_aggregate(df, "u", ["g"], 1e12, 1.0, 1, {"n": ("count",), "s": ("sum", "x", 0, 1)}).collect()
    # each unit gives to one of its groups only
    assert sum(r.n for r in bounded) == 2001 and all(math.isclose(r.s, r.n, abs_tol=0.01) for r in bounded)


def test_geography(value):
    point = lambda x, y: F.struct(F.lit(float(x)).alias("lng"), F.lit(float(y)).alias("lat"))
    ring = [point(0, 0), point(10, 0), point(10, 10), point(0, 10)]
    square = G.st_shape("POLYGON", F.array(*ring))
    assert value(G.st_contains(square, point(5, 5))) is True and value(G.st_contains(square, point(11, 5))) is False
    across = G.st_shape("POLYGON", F.array(point(175, -5), point(-175, -5), point(-175, 5), point(175, 5)))
    assert value(G.st_contains(across, point(179, 0))) is True and value(G.st_contains(across, point(-179, 1))) is True and value(G.st_contains(across, point(0, 0))) is False
    assert value(G.st_angle(point(0, 1), point(0, 0), point(1, 0))) == pytest.approx(math.pi / 2, abs=1e-3)
    assert value(G.st_isring(F.array(*ring))) is False
    with pytest.raises(Exception, match="closed"):
        value(G.st_makepolygon(F.array(*ring)))
    assert value(G.st_dimension(G.st_boundary(square))) == 1


def test_models(spark):
    made = models.Models(spark)
    rows = spark.createDataFrame([(float(i), float(2 * i)) for i in range(50)], "x double, y double")
    made.create("m", "LINEAR_REG", rows, "y")
    with pytest.raises(ValueError, match="exists"):
        made.create("m", "LINEAR_REG", rows, "y")
    for bad in (lambda: made.create("n", "NO_SUCH", rows, "y"), lambda: made.create("n", "LINEAR_REG", rows, "y", nonsense=1), lambda: made.centroids("m", rows)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(KeyError):
        made.predict("none", rows)
    assert made.training_info("m").count() >= 1 and {r.name for r in made.feature_info("m", rows).collect()} == {"x"}
    explained = made.explain_predict("m", rows).filter("x = 49").first()
    assert explained.attribution == pytest.approx(2 * (49 - 24.5), abs=0.01)
    hot = models.multi_hot_encoder(spark.createDataFrame([(["a", "b", "a", None],), (["c"],), (None,)], "t array<string>"), "t", "h", top_k=1).collect()
    assert [None if r.h is None else [h["index"] for h in r.h] for r in hot] == [[0, 1], [0], None]


def test_entry_without_training_queries(monkeypatch):
    """Whatever import of the subpackage fails, the other queries are there."""
    import sys

    import __spark_entry__ as entry

    for name in [m for m in sys.modules if m.startswith("lodestone.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "xxhash", None)
    monkeypatch.setitem(sys.modules, "lodestone.llm", None)
    assert "pivot" in entry.queries() and "op1_pitman_yor" not in entry.queries() and entry.oracle_sql()


def test_listings(spark):
    from lodestone.operators import listing

    rows = [("web-1", [{"members": ["a", "b"], "role": "x"}], {"k": 1}), ("db", [{"members": ["c"], "role": "y"}], None)]
    df = spark.createDataFrame(rows, "name string, bindings array<struct<members: array<string>, role: string>>, labels struct<k: int>")
    names = lambda text: sorted(r.name for r in listing.where(df, text).collect())
    assert names("name:WEB*") == ["web-1"] and names("name:b") == ["db", "web-1"] and names("") == ["db", "web-1"]
    assert names("labels.k=1") == ["web-1"] and names("labels.k!=1") == ["db"] and names("bindings[0].role=y") == ["db"] and names("bindings.role=x") == ["web-1"]
    for bad in ("name", "name=", "(name=a", "name=a)", "name<>a"):
        with pytest.raises(ValueError):
            listing.where(df, bad)
    flat = listing.flatten(df, "bindings[].members[]")
    found = listing.project(flat, ["name:sort=1", "bindings.role", "bindings.members:label=M"]).collect()
    assert sorted(tuple(r) for r in found) == [("db", "y", "c"), ("web-1", "x", "a"), ("web-1", "x", "b")]
    for bad in ("name.nothing()", "name:align=up"):
        with pytest.raises(ValueError):
            listing.shown(df, bad)
    assert [r.NAME for r in listing.project(df, ["name.color(green=db)"]).collect()] == ["web-1", "\x1b[32mdb\x1b[39m"]
