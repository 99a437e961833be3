"""Statements that define tables and change rows, run on stores of their own, beside what their results must be."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestone.sources.shared import shared_folder
from lodestone.sources.store import Store, StoreError

from .catalogue import register, table

c = F.col


def _store(spark, sf_dir: str, *names: str) -> Store:
    """A new store with schema shop and tables of the given names."""
    store = Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    store.create_schema("shop")
    for name in names:
        store.create_table(f"shop.{name}", query=table(spark, sf_dir, name))
    return store


_ORDERS = "o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice, o_orderpriority"


@register("dml_update", f"""SELECT o_orderkey, o_custkey, o_orderstatus, round(CASE WHEN o_orderstatus = 'F' THEN o_totalprice * 1.1 ELSE o_totalprice END, 2) AS o_totalprice,
  CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM orders""")
def dml_update(spark, sf_dir):
    store = _store(spark, sf_dir, "orders")
    store.update("shop.orders", {"o_totalprice": "o_totalprice * 1.1", "o_orderpriority": "DEFAULT"}, "o_orderstatus = 'F'")
    return store.read("shop.orders").selectExpr(*_ORDERS.split(", ", 3)[:3], "round(o_totalprice, 2) AS o_totalprice", "o_orderpriority")


@register("dml_update_from", """SELECT o_orderkey, round(CASE WHEN c_mktsegment = 'BUILDING' THEN o_totalprice + c_acctbal ELSE o_totalprice END, 2) AS total
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def dml_update_from(spark, sf_dir):
    store = _store(spark, sf_dir, "orders")
    building = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'")
    store.update_from("shop.orders", building, "t.o_custkey = s.c_custkey", {"o_totalprice": "t.o_totalprice + s.c_acctbal"})
    return store.read("shop.orders").select("o_orderkey", F.round("o_totalprice", 2).alias("total"))


@register("dml_delete", "SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT (o_custkey % 3 = 0 AND o_orderstatus <> 'P')")
def dml_delete(spark, sf_dir):
    store = _store(spark, sf_dir, "orders")
    store.delete("shop.orders", "o_custkey % 3 = 0 AND o_orderstatus <> 'P'")
    return store.read("shop.orders").select("o_orderkey", "o_orderstatus")


@register("dml_insert", """SELECT product, quantity, supply_constrained FROM (VALUES ('top load washer', 10::BIGINT, NULL::BOOLEAN), ('front load washer', 20, NULL), ('dryer', 30, NULL), ('oven', 5, NULL))
  t(product, quantity, supply_constrained) UNION ALL SELECT n_name, n_regionkey, false FROM nation""")
def dml_insert(spark, sf_dir):
    """Values for some columns, others by default; then a query's rows."""
    store = _store(spark, sf_dir)
    store.create_table("shop.inventory", "product string not null, quantity bigint, supply_constrained boolean", defaults={"quantity": "5"})
    store.insert("shop.inventory", spark.createDataFrame([("top load washer", 10), ("front load washer", 20), ("dryer", 30)], "p string, q bigint"), ["product", "quantity"])
    store.insert("shop.inventory", spark.createDataFrame([("oven",)], "p string"), ["product"])
    store.insert("shop.inventory", table(spark, sf_dir, "nation").select("n_name", "n_regionkey", F.lit(False)))
    return store.read("shop.inventory")


@register("dml_truncate", "SELECT count(*) AS n FROM nation WHERE false")
def dml_truncate(spark, sf_dir):
    store = _store(spark, sf_dir, "nation")
    store.truncate("shop.nation")
    return store.read("shop.nation").agg(F.count(F.lit(1)).alias("n"))


@register("time_travel", """SELECT (SELECT count(*) FROM orders) AS before, (SELECT count(*) FROM orders WHERE o_orderstatus <> 'F') AS after,
  (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS deleted, (SELECT count(*) FROM nation) AS appended, (SELECT count(*) FROM orders) AS snapshot, (SELECT count(*) FROM orders) AS cloned""")
def time_travel(spark, sf_dir):
    """FOR SYSTEM_TIME AS OF, APPENDS, CHANGES, snapshots and clones."""
    store = _store(spark, sf_dir, "orders", "nation")
    old = store.version_times("shop.orders")[-1]
    store.create_snapshot("shop.kept", "shop.orders")
    store.delete("shop.orders", "o_orderstatus = 'F'")
    store.create_clone("shop.clone", "shop.orders", as_of=old)
    then = store.version_times("shop.nation")[-1]
    store.insert("shop.nation", table(spark, sf_dir, "nation"))
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    deleted = store.changes("shop.orders", ["o_orderkey"], old).filter("_change_type = 'DELETE'")
    parts = [
        count(store.read("shop.orders", old), "before"), count(store.read("shop.orders"), "after"), count(deleted, "deleted"),
        count(store.appends("shop.nation", then), "appended"), count(store.read("shop.kept"), "snapshot"), count(store.read("shop.clone"), "cloned"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.crossJoin(part)  # one row each
    return out


@register("transactions", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey <> 1")
def transactions(spark, sf_dir):
    """One that is committed, one that an error undoes, one that is rolled back."""
    store = _store(spark, sf_dir, "nation")
    with store.transaction():
        store.delete("shop.nation", "n_regionkey = 1")
    try:
        with store.transaction():
            store.truncate("shop.nation")
            store.insert("shop.nothing", table(spark, sf_dir, "nation"))
    except StoreError:
        pass
    store.begin()
    store.truncate("shop.nation")
    store.rollback()
    return Store(spark, store.root).read("shop.nation").select("n_nationkey", "n_name")


@register("ddl_columns", "SELECT c_custkey AS id, c_acctbal::DECIMAL(38,9)::DOUBLE AS balance, CASE WHEN c_custkey < 0 THEN '' END AS note, 'new' AS state FROM customer WHERE false UNION ALL SELECT c_custkey, c_nationkey::DOUBLE, NULL, 'new' FROM customer")
def ddl_columns(spark, sf_dir):
    """Columns added, dropped, renamed, widened, and one of a dropped column's name, which stays empty."""
    store = _store(spark, sf_dir, "customer")
    name = "shop.customer"
    for column in ("c_name", "c_acctbal", "c_mktsegment"):
        store.drop_column(name, column)
    store.rename_column(name, "c_custkey", "id")
    store.set_data_type(name, "c_nationkey", "double")
    store.rename_column(name, "c_nationkey", "balance")
    store.add_column(name, "c_name", "string")
    store.rename_column(name, "c_name", "note")
    store.add_column(name, "state", "string", default="'new'")
    store.update(name, {"state": "DEFAULT"}, "true")
    store.rename(name, "clients")
    return store.read("shop.clients")


@register("ddl_views", """SELECT o_orderstatus, count(*) AS n, (SELECT count(*) FROM orders)::BIGINT AS stale, (SELECT count(*) FROM orders WHERE o_custkey % 2 = 0)::BIGINT AS fresh
  FROM orders WHERE o_custkey % 2 = 0 GROUP BY o_orderstatus""")
def ddl_views(spark, sf_dir):
    """A view follows its table, a materialized one when it is refreshed."""
    store = _store(spark, sf_dir, "orders")
    store.create_view("shop.by_status", "SELECT o_orderstatus, count(*) AS n FROM {shop.orders} GROUP BY o_orderstatus")
    for name in ("shop.whole", "shop.again"):
        store.create_materialized_view(name, "SELECT count(*) AS n FROM {shop.orders}")
    store.delete("shop.orders", "o_custkey % 2 <> 0")
    store.refresh_materialized_view("shop.again")
    stale, fresh = (store.read(n).withColumnRenamed("n", a) for n, a in (("shop.whole", "stale"), ("shop.again", "fresh")))
    return store.read("shop.by_status").crossJoin(stale).crossJoin(fresh)  # one row each


@register("ddl_external", "SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 3")
def ddl_external(spark, sf_dir):
    store = _store(spark, sf_dir)
    store.create_external_table("shop.outside", f"{sf_dir}/customer.parquet")
    return store.sql("SELECT c_custkey, c_name FROM {shop.outside} WHERE c_nationkey = 3")


@register("ddl_copies", "SELECT n_nationkey, n_name, 'copy' AS kind FROM nation WHERE n_regionkey = 2 UNION ALL SELECT n_nationkey, n_name, 'like' FROM nation WHERE n_regionkey = 4")
def ddl_copies(spark, sf_dir):
    """CREATE TABLE COPY and LIKE, OR REPLACE and IF NOT EXISTS; a copy's changes don't reach its source."""
    store = _store(spark, sf_dir, "nation")
    store.create_table_copy("shop.copied", "shop.nation")
    store.delete("shop.copied", "n_regionkey <> 2")
    nations = table(spark, sf_dir, "nation")
    store.create_table_like("shop.alike", "shop.nation", nations.filter("n_regionkey = 3"))
    store.create_table_like("shop.alike", "shop.nation", nations.filter("n_regionkey = 0"), if_not_exists=True)
    store.create_table_like("shop.alike", "shop.nation", nations.filter("n_regionkey = 4"), or_replace=True)
    part = lambda name, kind: store.read(name).select("n_nationkey", "n_name", F.lit(kind).alias("kind"))
    return part("shop.copied", "copy").unionByName(part("shop.alike", "like"))


@register("ddl_schemas", "SELECT 'shop' AS schema_name, 'und:ci' AS default_collation_name, 'goods' AS description, 2::BIGINT AS tables UNION ALL SELECT 'spare', '', NULL, 0")
def ddl_schemas(spark, sf_dir):
    """Schemas created, altered, dropped and brought back."""
    store = _store(spark, sf_dir, "nation", "region")
    store.create_schema("spare")
    store.create_schema("gone")
    store.alter_schema("shop", collation="und:ci", description="goods")
    store.drop_schema("shop", cascade=True)
    store.undrop_schema("shop")
    store.drop_schema("gone")
    store.drop_schema("gone", if_exists=True)
    tables = store.information("tables").groupBy(c("table_schema").alias("schema_name")).agg(F.count(F.lit(1)).alias("tables"))
    options = store.information("schemata_options").filter("option_name = 'description'").select("schema_name", c("option_value").alias("description"))
    found = store.information("schemata").join(tables, "schema_name", "left").join(options, "schema_name", "left")
    return found.select("schema_name", "default_collation_name", "description", F.coalesce("tables", F.lit(0)).alias("tables"))


@register("ddl_policies", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey IN (1, 2)")
def ddl_policies(spark, sf_dir):
    """A user sees the rows that one of the policies grants; others see none."""
    store = _store(spark, sf_dir, "nation")
    store.create_row_access_policy("one", "shop.nation", ["ann"], "n_regionkey = 1")
    store.create_row_access_policy("two", "shop.nation", ["ann", "bob"], "n_regionkey = 2")
    store.create_row_access_policy("old", "shop.nation", ["ann"], "true")
    store.drop_row_access_policy("old")
    nobody = store.read("shop.nation", user="eve")
    return store.read("shop.nation", user="ann").unionByName(nobody).select("n_nationkey", "n_name")


@register("ddl_routines", "SELECT n_nationkey * 2 + 1 AS doubled, 25::BIGINT AS total FROM nation WHERE n_regionkey = 3")
def ddl_routines(spark, sf_dir):
    """Scalar and table functions, and a procedure with an argument out."""
    store = _store(spark, sf_dir, "nation")
    table(spark, sf_dir, "nation").createOrReplaceTempView("nation")
    store.create_function("lodestone_double", "x INT", "INT", "x * 2 + 1")
    store.create_function("lodestone_region", "r INT", "n_nationkey INT", "SELECT n_nationkey FROM nation WHERE n_regionkey = r", table=True)
    store.create_procedure("count_rows", lambda s, name: {"n": s.read(name).count()}, "name string")
    total = store.call("count_rows", name="shop.nation")["n"]
    return spark.sql("SELECT lodestone_double(n_nationkey) AS doubled FROM lodestone_region(3)").withColumn("total", F.lit(total))


def _described(spark, sf_dir):
    store = _store(spark, sf_dir, "nation")
    store.create_table("shop.line", "id bigint not null, nation int, at struct<lat: double, lon: double>, tags array<string>", partition_by=["nation"], cluster_by=["id"], defaults={"nation": "0"}, description="lines", labels="x")
    store.add_primary_key("shop.nation", "n_nationkey")
    store.add_primary_key("shop.line", "id")
    store.add_foreign_key("shop.line", "to_nation", ["nation"], "shop.nation", ["n_nationkey"])
    store.add_foreign_key("shop.line", "extra", ["nation"], "shop.nation", ["n_nationkey"])
    store.drop_constraint("shop.line", "extra")
    store.create_view("shop.names", "SELECT n_name FROM {shop.nation}", description="names")
    store.create_snapshot("shop.old", "shop.nation")
    store.create_materialized_view("shop.regions", "SELECT DISTINCT n_regionkey FROM {shop.nation}")
    store.create_function("lodestone_half", "x DOUBLE, y INT", "DOUBLE", "x / 2 + y")
    return store


@register("catalogue_columns", """SELECT * FROM (VALUES ('line', 'id', 1, 'NO', 'bigint', NULL, 'NO', 1), ('line', 'nation', 2, 'YES', 'int', '0', 'YES', NULL),
  ('line', 'at', 3, 'YES', 'struct<lat:double,lon:double>', NULL, 'NO', NULL), ('line', 'tags', 4, 'YES', 'array<string>', NULL, 'NO', NULL), ('names', 'n_name', 1, 'YES', 'string', NULL, 'NO', NULL))
  t(table_name, column_name, ordinal_position, is_nullable, data_type, column_default, is_partitioning_column, clustering_ordinal_position)""")
def catalogue_columns(spark, sf_dir):
    return _described(spark, sf_dir).information("columns").filter("table_name IN ('line', 'names')").drop("table_schema")


@register("catalogue_objects", """SELECT * FROM (VALUES ('tables', 'line', 'BASE TABLE'), ('tables', 'names', 'VIEW'), ('tables', 'nation', 'BASE TABLE'), ('tables', 'old', 'SNAPSHOT'), ('tables', 'regions', 'MATERIALIZED VIEW'),
  ('views', 'names', 'SELECT n_name FROM {shop.nation}'), ('materialized_views', 'regions', 'SELECT DISTINCT n_regionkey FROM {shop.nation}'), ('snapshots', 'old', 'shop.nation'),
  ('table_constraints', 'line', 'FOREIGN KEY'), ('table_constraints', 'line', 'PRIMARY KEY'), ('table_constraints', 'nation', 'PRIMARY KEY'),
  ('key_column_usage', 'line', 'id'), ('key_column_usage', 'line', 'nation'), ('key_column_usage', 'nation', 'n_nationkey'),
  ('constraint_column_usage', 'line', 'id'), ('constraint_column_usage', 'nation', 'n_nationkey'), ('constraint_column_usage', 'nation', 'n_nationkey'),
  ('column_field_paths', 'line', 'at'), ('column_field_paths', 'line', 'at.lat'), ('column_field_paths', 'line', 'at.lon'), ('column_field_paths', 'line', 'id'), ('column_field_paths', 'line', 'nation'), ('column_field_paths', 'line', 'tags'),
  ('table_options', 'line', 'description=lines'), ('table_options', 'line', 'labels=x'), ('table_options', 'names', 'description=names'), ('partitions', 'line', 'nation'),
  ('routines', 'lodestone_half', 'FUNCTION'), ('parameters', 'lodestone_half', 'x'), ('parameters', 'lodestone_half', 'y'), ('table_storage', 'line', '0')) t(view, name, value)""")
def catalogue_objects(spark, sf_dir):
    """What the catalogue views say of a schema's objects."""
    store = _described(spark, sf_dir)
    picked = {
        "tables": ("table_name", "table_type"), "views": ("table_name", "view_definition"), "materialized_views": ("table_name", "view_definition"), "snapshots": ("table_name", "base_table"),
        "table_constraints": ("table_name", "constraint_type"), "key_column_usage": ("table_name", "column_name"), "constraint_column_usage": ("table_name", "column_name"),
        "column_field_paths": ("table_name", "field_path"), "table_options": ("table_name", "concat(option_name, '=', option_value)"), "partitions": ("table_name", "partitioned_by"),
        "routines": ("routine_name", "routine_type"), "parameters": ("specific_name", "parameter_name"), "table_storage": ("table_name", "string(total_files)"),
    }
    out = None
    for view, (name, value) in picked.items():
        rows = store.information(view)
        if view in ("column_field_paths", "table_storage"):
            rows = rows.filter("table_name = 'line'")
        part = rows.selectExpr(f"'{view}' AS view", f"{name} AS name", f"{value} AS value")
        out = part if out is None else out.unionByName(part)
    return out
