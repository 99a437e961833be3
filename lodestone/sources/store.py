"""A store of versioned tables: definitions, changes of rows, time travel, and views of the catalogue.

A table's version is a list of Parquet files; a change writes new files and a new list, and only files with rows that
change are rewritten, so that the rest of a large table isn't touched. Older versions stay readable. The catalogue is
a JSON file beside the tables, written whole at each commit; one writer at a time is assumed.
"""

from __future__ import annotations

import copy
import json
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

#: Changes of a column's type that lose nothing.
WIDER = {"int": ("bigint", "double", "decimal(38,9)"), "bigint": ("decimal(38,9)",), "float": ("double",), "date": ("timestamp_ntz",)}


class StoreError(ValueError):
    """A statement that the state of the store doesn't allow."""


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.expr(x)


class Store:
    """Names are "schema.table"; all changes go through methods, which return the store's own counts where SQL does."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.catalogue = json.loads(self._read() or '{"schemas": {}, "dropped": {}, "routines": {}, "policies": {}}')
        self.procedures: dict[str, Callable] = {}
        self._saved: dict | None = None

    # files

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def _files(self):
        return self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _read(self) -> str | None:
        path = self._path(f"{self.root}/catalogue.json")
        if not self._files().exists(path):
            return None
        return "\n".join(r.value for r in self.spark.read.text(f"{self.root}/catalogue.json", wholetext=True).collect())

    def _commit(self) -> None:
        if self._saved is None:
            out = self._files().create(self._path(f"{self.root}/catalogue.json"), True)
            out.write(bytearray(json.dumps(self.catalogue).encode()))
            out.close()

    def _written(self, df: DataFrame) -> list[str]:
        """The files of a new folder with the rows."""
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(folder)
        found = self._files().listStatus(self._path(folder))
        return [f.getPath().toString() for f in found if f.getPath().getName().endswith(".parquet")]

    # names

    def _schema(self, name: str) -> dict:
        if name not in self.catalogue["schemas"]:
            raise StoreError(f"there is no schema {name}")
        return self.catalogue["schemas"][name]

    def _entry(self, name: str) -> dict:
        schema, _, table = name.partition(".")
        if table not in self._schema(schema)["tables"]:
            raise StoreError(f"there is no table {name}")
        return self._schema(schema)["tables"][table]

    def _put(self, name: str, entry: dict, or_replace: bool, if_not_exists: bool) -> bool:
        schema, _, table = name.partition(".")
        tables = self._schema(schema)["tables"]
        if table in tables and not or_replace:
            if if_not_exists:
                return False
            raise StoreError(f"{name} exists")
        tables[table] = entry
        self._commit()
        return True

    # schemas

    def create_schema(self, name: str, if_not_exists: bool = False, **options) -> None:
        if name in self.catalogue["schemas"]:
            if if_not_exists:
                return
            raise StoreError(f"schema {name} exists")
        self.catalogue["schemas"][name] = {"tables": {}, "options": options, "collation": "", "created": time.time()}
        self._commit()

    def alter_schema(self, name: str, collation: str | None = None, **options) -> None:
        schema = self._schema(name)
        schema["options"] |= options
        schema["collation"] = schema["collation"] if collation is None else collation
        self._commit()

    def drop_schema(self, name: str, cascade: bool = False, if_exists: bool = False) -> None:
        if if_exists and name not in self.catalogue["schemas"]:
            return
        if self._schema(name)["tables"] and not cascade:
            raise StoreError(f"schema {name} isn't empty")
        self.catalogue["dropped"][name] = self.catalogue["schemas"].pop(name)
        self._commit()

    def undrop_schema(self, name: str) -> None:
        if name not in self.catalogue["dropped"] or name in self.catalogue["schemas"]:
            raise StoreError(f"schema {name} can't be brought back")
        self.catalogue["schemas"][name] = self.catalogue["dropped"].pop(name)
        self._commit()

    # tables

    def _new(self, kind: str, schema: StructType, files: list[str], **more) -> dict:
        version = {"at": time.time(), "files": files, "schema": json.loads(schema.json())}
        return {"kind": kind, "versions": [version], "options": {}, "defaults": {}, "keys": [], "partition": [], "cluster": [], "collation": "", "created": time.time()} | more

    def create_table(self, name: str, columns: str | None = None, query: DataFrame | None = None, or_replace: bool = False, if_not_exists: bool = False, partition_by=(), cluster_by=(), defaults: dict | None = None, **options) -> bool:
        """Of column definitions as in Spark SQL, of a query, or of both."""
        schema = _parse_datatype_string(columns) if columns else query.schema
        if not isinstance(schema, StructType):
            raise StoreError("columns must be name type pairs")
        entry = self._new("BASE TABLE", schema, [], partition=list(partition_by), cluster=list(cluster_by), options=options, defaults=defaults or {})
        if not self._put(name, entry, or_replace, if_not_exists):
            return False
        if query is not None:
            self.insert(name, query)
        return True

    def create_table_like(self, name: str, source: str, query: DataFrame | None = None, **how) -> bool:
        old = self._entry(source)
        entry = self._new("BASE TABLE", self.schema(source), [], **{k: copy.deepcopy(old[k]) for k in ("options", "defaults", "partition", "cluster")})
        made = self._put(name, entry, how.get("or_replace", False), how.get("if_not_exists", False))
        if made and query is not None:
            self.insert(name, query)
        return made

    def create_table_copy(self, name: str, source: str, kind: str = "BASE TABLE", as_of: float | None = None, **how) -> bool:
        """A copy shares its files with the source until either is changed."""
        old, version = self._entry(source), self._version(source, as_of)
        entry = copy.deepcopy(old) | {"kind": kind, "versions": [copy.deepcopy(version) | {"at": time.time()}], "created": time.time(), "base": source, "keys": []}
        return self._put(name, entry, how.get("or_replace", False), how.get("if_not_exists", False))

    def create_snapshot(self, name: str, source: str, as_of: float | None = None, **how) -> bool:
        return self.create_table_copy(name, source, "SNAPSHOT", as_of, **how)

    def create_clone(self, name: str, source: str, as_of: float | None = None, **how) -> bool:
        return self.create_table_copy(name, source, "CLONE", as_of, **how)

    def create_external_table(self, name: str, path: str, format: str = "parquet", schema: str | None = None, or_replace: bool = False, if_not_exists: bool = False, **options) -> bool:  # noqa: A002
        read = self._external({"path": path, "format": format, "options": options, "columns": schema})
        entry = self._new("EXTERNAL", read.schema, [], path=path, format=format, options=options, columns=schema)
        return self._put(name, entry, or_replace, if_not_exists)

    def _external(self, entry: dict) -> DataFrame:
        reader = self.spark.read.format(entry["format"]).options(**entry["options"])
        return (reader.schema(entry["columns"]) if entry["columns"] else reader).load(entry["path"])

    def create_view(self, name: str, sql: str, or_replace: bool = False, if_not_exists: bool = False, **options) -> bool:
        """sql names tables of the store in braces: SELECT * FROM {shop.orders}."""
        entry = self._new("VIEW", self.sql(sql).schema, [], sql=sql, options=options)
        return self._put(name, entry, or_replace, if_not_exists)

    def create_materialized_view(self, name: str, sql: str, or_replace: bool = False, if_not_exists: bool = False, **options) -> bool:
        made = self.sql(sql)
        entry = self._new("MATERIALIZED VIEW", made.schema, self._written(made), sql=sql, options=options)
        return self._put(name, entry, or_replace, if_not_exists)

    def refresh_materialized_view(self, name: str) -> None:
        entry = self._kind(name, "MATERIALIZED VIEW")
        self._add_version(entry, self._written(self.sql(entry["sql"])))

    def _kind(self, name: str, *kinds: str) -> dict:
        entry = self._entry(name)
        if entry["kind"] not in kinds:
            raise StoreError(f"{name} is a {entry['kind']}")
        return entry

    def drop(self, name: str, kind: str | None = None, if_exists: bool = False) -> None:
        """A table, snapshot, external table, view or materialized view; kind: which it must be."""
        schema, _, table = name.partition(".")
        if if_exists and table not in self._schema(schema)["tables"]:
            return
        if kind:
            self._kind(name, kind)
        self._entry(name)
        self.catalogue["schemas"][schema]["tables"].pop(table)
        self.catalogue["policies"] = {k: p for k, p in self.catalogue["policies"].items() if p["table"] != name}
        self._commit()

    # reading

    def _version(self, name: str, as_of: float | datetime | None = None) -> dict:
        versions = self._entry(name)["versions"]
        if as_of is None:
            return versions[-1]
        at = as_of.timestamp() if isinstance(as_of, datetime) else as_of
        if at < versions[0]["at"]:
            raise StoreError(f"{name} has no version as of then")
        return max((v for v in versions if v["at"] <= at), key=lambda v: v["at"])

    def schema(self, name: str) -> StructType:
        return StructType.fromJson(self._version(name)["schema"])

    def _rows(self, version: dict) -> DataFrame:
        schema = StructType.fromJson(version["schema"])
        stored = StructType([StructField(f.metadata.get("stored", f.name), f.dataType, True) for f in schema])
        if not version["files"]:
            return self.spark.createDataFrame([], StructType([StructField(f.name, f.dataType) for f in schema]))
        # a column that files lack was added later: null; one of a narrower type is widened by the reader
        read = self.spark.read.schema(stored).parquet(*version["files"])
        return read.select(*(F.col(f"`{s.name}`").alias(f.name) for s, f in zip(stored, schema)))

    def read(self, name: str, as_of: float | datetime | None = None, user: str | None = None) -> DataFrame:
        """A table or view, as of a moment; for a user only rows that one of the table's policies grants, if it has any."""
        entry = self._entry(name)
        rows = self.sql(entry["sql"]) if entry["kind"] == "VIEW" else self._external(entry) if entry["kind"] == "EXTERNAL" else self._rows(self._version(name, as_of))
        policies = [p for p in self.catalogue["policies"].values() if p["table"] == name]
        if user is None or not policies:
            return rows
        granted = [_col(p["filter"]) for p in policies if user in p["grantees"]]
        return rows.filter(reduce(Column.__or__, granted)) if granted else rows.limit(0)

    def sql(self, text: str) -> DataFrame:
        """Spark SQL over the store's tables, named in braces."""
        names, parts, at = {}, [], 0
        while (start := text.find("{", at)) >= 0:
            end = text.index("}", start)
            name = text[start + 1 : end]
            names.setdefault(name, f"t{len(names)}")
            parts += [text[at:start], "{" + names[name] + "}"]
            at = end + 1
        return self.spark.sql("".join(parts) + text[at:], **{alias: self.read(name) for name, alias in names.items()})

    # changes of rows

    def _add_version(self, entry: dict, files: list[str], schema: StructType | None = None) -> None:
        last = entry["versions"][-1]
        at = max(time.time(), last["at"] + 1e-6)
        entry["versions"].append({"at": at, "files": files, "schema": json.loads(schema.json()) if schema else last["schema"]})
        self._commit()

    def _fitted(self, name: str, rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
        """rows as the table's columns: given ones by place, others by default; NOT NULL holds."""
        entry, schema = self._entry(name), self.schema(name)
        given = dict(zip(columns or schema.names, rows.columns))
        if len(columns or schema.names) != len(rows.columns):
            raise StoreError("the numbers of columns differ")
        made = []
        for f in schema:
            value = F.col(f"`{given[f.name]}`") if f.name in given else F.expr(entry["defaults"].get(f.name, "NULL"))
            value = value.cast(f.dataType)
            if not f.nullable:
                value = F.when(value.isNull(), F.raise_error(F.lit(f"{f.name} must not be null")).cast(f.dataType)).otherwise(value)
            made.append(value.alias(f.metadata.get("stored", f.name)))
        return rows.select(*made)

    def insert(self, name: str, rows: DataFrame, columns: list[str] | None = None) -> None:
        entry = self._kind(name, "BASE TABLE", "CLONE")
        new = self._fitted(name, rows, columns)
        if entry["partition"]:
            new = new.repartition(*(F.expr(p) for p in entry["partition"]))
        if entry["cluster"]:
            new = new.sortWithinPartitions(*entry["cluster"])
        self._add_version(entry, entry["versions"][-1]["files"] + self._written(new))

    def truncate(self, name: str) -> None:
        self._add_version(self._kind(name, "BASE TABLE", "CLONE"), [])

    def _rewritten(self, name: str, touched: DataFrame, changed: Callable[[DataFrame], DataFrame]) -> int:
        """A version in which the files of the touched rows are replaced by changed(their rows); gives the number touched."""
        entry, version = self._entry(name), self._version(name)
        found = {r.file: r.n for r in touched.groupBy(F.col("__file").alias("file")).agg(F.count(F.lit(1)).alias("n")).collect()}
        if not found:
            return 0
        plain = lambda p: p.split(":", 1)[-1].lstrip("/")
        hit = {plain(f) for f in found}
        old = [f for f in version["files"] if plain(f) in hit]
        rows = changed(self._rows(version | {"files": old}))
        stored = {f.name: f.metadata.get("stored", f.name) for f in self.schema(name)}
        files = self._written(rows.select(*(F.col(f"`{c}`").alias(stored[c]) for c in self.schema(name).names)))
        self._add_version(entry, [f for f in version["files"] if plain(f) not in hit] + files)
        return sum(found.values())

    def _marked(self, name: str) -> DataFrame:
        return self._rows(self._version(name)).withColumn("__file", F.input_file_name())

    def delete(self, name: str, where: Column | str) -> int:
        self._kind(name, "BASE TABLE", "CLONE")
        gone = F.coalesce(_col(where), F.lit(False))
        return self._rewritten(name, self._marked(name).filter(gone), lambda rows: rows.filter(~gone))

    def update(self, name: str, values: dict[str, Column | str], where: Column | str) -> int:
        """All new values are of the old row."""
        self._kind(name, "BASE TABLE", "CLONE")
        schema, hit = self.schema(name), F.coalesce(_col(where), F.lit(False))
        defaults = self._entry(name)["defaults"]
        new = {c: F.expr(defaults.get(c, "NULL")) if isinstance(v, str) and v.upper() == "DEFAULT" else _col(v) for c, v in values.items()}

        def changed(rows: DataFrame) -> DataFrame:
            return rows.select(*(F.when(hit, new[f.name].cast(f.dataType)).otherwise(F.col(f"`{f.name}`")).alias(f.name) if f.name in new else F.col(f"`{f.name}`") for f in schema))

        return self._rewritten(name, self._marked(name).filter(hit), changed)

    def update_from(self, name: str, source: DataFrame, on: Column | str, values: dict[str, Column | str]) -> int:
        """UPDATE ... FROM: on and values name the table t and the source s; a row that several source rows match is an error."""
        names = self.schema(name).names
        keyed = self._marked(name).withColumn("__row", F.struct("__file", F.monotonically_increasing_id().alias("id"))).alias("t")
        pairs = keyed.join(source.alias("s"), _col(on))
        if not pairs.groupBy("t.__row").count().filter("count > 1").isEmpty():
            raise StoreError("a row matches several rows of the source")

        def changed(rows: DataFrame) -> DataFrame:
            joined = rows.alias("t").join(source.withColumn("__hit", F.lit(True)).alias("s"), _col(on), "left")
            kind = {f.name: f.dataType for f in self.schema(name)}
            return joined.select(*(F.when(F.col("s.__hit"), _col(values[c]).cast(kind[c])).otherwise(F.col(f"t.`{c}`")).alias(c) if c in values else F.col(f"t.`{c}`") for c in names))

        return self._rewritten(name, pairs.select("t.*"), changed)

    # changes of definitions

    def _altered(self, name: str, change: Callable[[StructType], StructType]) -> None:
        entry = self._entry(name)
        new = change(self.schema(name))
        if len({f.name.lower() for f in new}) != len(new.fields):
            raise StoreError("column names must differ")
        self._add_version(entry, entry["versions"][-1]["files"], new)

    def _field(self, name: str, column: str) -> StructField:
        for f in self.schema(name):
            if f.name == column:
                return f
        raise StoreError(f"{name} has no column {column}")

    def add_column(self, name: str, column: str, kind: str, if_not_exists: bool = False, default: str | None = None) -> None:
        if column in self.schema(name).names:
            if if_not_exists:
                return
            raise StoreError(f"{name} has a column {column}")
        # its name in the files is its own, lest an older column of the name come back
        field = StructField(column, _parse_datatype_string(kind), True, {"stored": f"{column}_{uuid.uuid4().hex[:8]}"})
        self._altered(name, lambda s: StructType([*s.fields, field]))
        if default is not None:
            self.set_default(name, column, default)

    def drop_column(self, name: str, column: str, if_exists: bool = False) -> None:
        if if_exists and column not in self.schema(name).names:
            return
        self._field(name, column)
        self._altered(name, lambda s: StructType([f for f in s if f.name != column]))

    def rename_column(self, name: str, column: str, new: str) -> None:
        self._field(name, column)
        self._altered(name, lambda s: StructType([StructField(new, f.dataType, f.nullable, {"stored": f.metadata.get("stored", f.name)}) if f.name == column else f for f in s]))

    def set_data_type(self, name: str, column: str, kind: str) -> None:
        """To a wider type only; the files are rewritten once."""
        old = self._field(name, column)
        if kind not in WIDER.get(old.dataType.simpleString(), ()):
            raise StoreError(f"{old.dataType.simpleString()} can't become {kind}")
        rows = self._rows(self._version(name))
        schema = StructType([StructField(f.name, _parse_datatype_string(kind) if f.name == column else f.dataType, f.nullable) for f in self.schema(name)])
        files = self._written(rows.select(*(F.col(f"`{f.name}`").cast(f.dataType) for f in schema)))
        self._add_version(self._entry(name), files, schema)

    def drop_not_null(self, name: str, column: str) -> None:
        self._altered(name, lambda s: StructType([StructField(f.name, f.dataType, f.nullable or f.name == column, f.metadata) for f in s]))

    def set_default(self, name: str, column: str, sql: str | None) -> None:
        """None takes the default away."""
        self._field(name, column)
        defaults = self._entry(name)["defaults"]
        defaults.pop(column, None)
        if sql is not None:
            defaults[column] = sql
        self._commit()

    def set_column_options(self, name: str, column: str, **options) -> None:
        self._altered(name, lambda s: StructType([StructField(f.name, f.dataType, f.nullable, f.metadata | {"options": json.dumps(options)}) if f.name == column else f for f in s]))

    def set_options(self, name: str, collation: str | None = None, **options) -> None:
        entry = self._entry(name)
        entry["options"] |= options
        entry["collation"] = entry["collation"] if collation is None else collation
        self._commit()

    def rename(self, name: str, new: str) -> None:
        schema, _, table = name.partition(".")
        entry = self._entry(name)
        self._put(f"{schema}.{new}", entry, False, False)
        self.catalogue["schemas"][schema]["tables"].pop(table)
        self._commit()

    def add_primary_key(self, name: str, *columns: str) -> None:
        if any(k["kind"] == "PRIMARY KEY" for k in self._entry(name)["keys"]):
            raise StoreError(f"{name} has a primary key")
        self._add_key(name, {"name": "pk$", "kind": "PRIMARY KEY", "columns": list(columns)})

    def add_foreign_key(self, name: str, constraint: str, columns: list[str], table: str, other: list[str]) -> None:
        for c in other:
            self._field(table, c)
        self._add_key(name, {"name": constraint, "kind": "FOREIGN KEY", "columns": columns, "table": table, "other": other})

    def _add_key(self, name: str, key: dict) -> None:
        for c in key["columns"]:
            self._field(name, c)
        self._entry(name)["keys"].append(key)
        self._commit()

    def drop_constraint(self, name: str, constraint: str = "pk$", if_exists: bool = False) -> None:
        """Keys aren't enforced; the planner's users read them in the catalogue views."""
        entry = self._entry(name)
        left = [k for k in entry["keys"] if k["name"] != constraint]
        if len(left) == len(entry["keys"]) and not if_exists:
            raise StoreError(f"{name} has no constraint {constraint}")
        entry["keys"] = left
        self._commit()

    def create_row_access_policy(self, policy: str, table: str, grantees: list[str], where: str, or_replace: bool = False) -> None:
        self._entry(table)
        if policy in self.catalogue["policies"] and not or_replace:
            raise StoreError(f"policy {policy} exists")
        self.catalogue["policies"][policy] = {"table": table, "grantees": grantees, "filter": where}
        self._commit()

    def drop_row_access_policy(self, policy: str, if_exists: bool = False) -> None:
        if self.catalogue["policies"].pop(policy, None) is None and not if_exists:
            raise StoreError(f"there is no policy {policy}")
        self._commit()

    # routines

    def create_function(self, name: str, arguments: str, returns: str, body: str, or_replace: bool = False, if_not_exists: bool = False, table: bool = False) -> None:
        """A SQL function, or a table function, of the session and the catalogue."""
        if name in self.catalogue["routines"] and not or_replace:
            if if_not_exists:
                return
            raise StoreError(f"function {name} exists")
        made = f"RETURNS TABLE ({returns}) RETURN {body}" if table else f"RETURNS {returns} RETURN {body}"
        self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) {made}")
        self.catalogue["routines"][name] = {"kind": "TABLE FUNCTION" if table else "FUNCTION", "arguments": arguments, "returns": returns, "body": body}
        self._commit()

    def create_procedure(self, name: str, body: Callable[..., dict | None], arguments: str = "", or_replace: bool = False) -> None:
        """body(store, **arguments) gives its OUT arguments; bodies belong to the session."""
        if name in self.catalogue["routines"] and not or_replace:
            raise StoreError(f"procedure {name} exists")
        self.procedures[name] = body
        self.catalogue["routines"][name] = {"kind": "PROCEDURE", "arguments": arguments, "returns": "", "body": ""}
        self._commit()

    def call(self, name: str, /, **arguments) -> dict:
        if name not in self.procedures:
            raise StoreError(f"there is no procedure {name}")
        return self.procedures[name](self, **arguments) or {}

    def drop_routine(self, name: str, kind: str, if_exists: bool = False) -> None:
        found = self.catalogue["routines"].get(name)
        if found is None or found["kind"] != kind:
            if if_exists:
                return
            raise StoreError(f"there is no {kind} {name}")
        if kind != "PROCEDURE":
            self.spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {name}")
        self.procedures.pop(name, None)
        self.catalogue["routines"].pop(name)
        self._commit()

    # transactions

    @contextmanager
    def transaction(self) -> Iterator[Store]:
        """All changes inside are committed together at its end, or undone by an error."""
        self.begin()
        try:
            yield self
        except BaseException:
            self.rollback()
            raise
        self.commit()

    def begin(self) -> None:
        if self._saved is not None:
            raise StoreError("a transaction is open")
        self._saved = copy.deepcopy(self.catalogue)

    def commit(self) -> None:
        if self._saved is None:
            raise StoreError("no transaction is open")
        self._saved = None
        self._commit()

    def rollback(self) -> None:
        if self._saved is None:
            raise StoreError("no transaction is open")
        self.catalogue, self._saved = self._saved, None

    # change history

    def appends(self, name: str, start: float | None = None, end: float | None = None) -> DataFrame:
        """Rows that were added between two moments; those of files that are new, as a change of other rows adds none."""
        from lodestone.operators.relational import appends

        before = self.read(name, start) if start is not None else self.read(name).limit(0)
        return appends(before, self.read(name, end))

    def changes(self, name: str, keys: list[str], start: float, end: float | None = None) -> DataFrame:
        from lodestone.operators.relational import changes

        return changes(self.read(name, start), self.read(name, end), keys)

    def version_times(self, name: str) -> list[float]:
        return [v["at"] for v in self._entry(name)["versions"]]

    # catalogue views

    def information(self, view: str) -> DataFrame:
        """A catalogue view by its name in lower case; the store's metadata, which is small, as rows."""
        if view not in _VIEWS:
            raise StoreError(f"there is no view {view}")
        columns, rows = _VIEWS[view]
        return self.spark.createDataFrame(list(rows(self)), columns)

    def _tables(self) -> Iterator[tuple[str, str, dict]]:
        for schema, s in self.catalogue["schemas"].items():
            for table, entry in s["tables"].items():
                yield schema, table, entry

    def _fields(self) -> Iterator[tuple[str, str, int, StructField, dict]]:
        for schema, table, entry in self._tables():
            for i, f in enumerate(StructType.fromJson(entry["versions"][-1]["schema"])):
                yield schema, table, i + 1, f, entry


def _paths(prefix: str, kind) -> Iterator[tuple[str, str]]:
    yield prefix, kind.simpleString()
    inner = getattr(kind, "elementType", kind)
    if isinstance(inner, StructType):
        for f in inner:
            yield from _paths(f"{prefix}.{f.name}", f.dataType)


def _when(at: float) -> datetime:
    return datetime.fromtimestamp(at, timezone.utc).replace(tzinfo=None)


def _size(store: Store, entry: dict) -> int:
    files = store._files()
    return sum(files.getFileStatus(store._path(f)).getLen() for f in entry["versions"][-1]["files"])


def _kinds(*kinds: str):
    return lambda store: ((s, t, e["options"].get("description"), e.get("sql")) for s, t, e in store._tables() if e["kind"] in kinds)


def _keys(store: Store):
    return ((s, t, k) for s, t, e in store._tables() for k in e["keys"])


_PLACE = "table_schema string, table_name string"
_VIEWS: dict[str, tuple[str, Callable[[Store], Iterator]]] = {
    "schemata": ("schema_name string, default_collation_name string, creation_time timestamp_ntz", lambda x: ((n, s["collation"], _when(s["created"])) for n, s in x.catalogue["schemas"].items())),
    "schemata_options": ("schema_name string, option_name string, option_value string", lambda x: ((n, k, str(v)) for n, s in x.catalogue["schemas"].items() for k, v in s["options"].items())),
    "tables": (f"{_PLACE}, table_type string, creation_time timestamp_ntz, base_table string, default_collation_name string", lambda x: ((s, t, e["kind"], _when(e["created"]), e.get("base"), e["collation"]) for s, t, e in x._tables())),
    "table_options": (f"{_PLACE}, option_name string, option_value string", lambda x: ((s, t, k, str(v)) for s, t, e in x._tables() for k, v in e["options"].items())),
    "columns": (f"{_PLACE}, column_name string, ordinal_position int, is_nullable string, data_type string, column_default string, is_partitioning_column string, clustering_ordinal_position int", lambda x: ((s, t, f.name, i, "YES" if f.nullable else "NO", f.dataType.simpleString(), e["defaults"].get(f.name), "YES" if f.name in e["partition"] else "NO", e["cluster"].index(f.name) + 1 if f.name in e["cluster"] else None) for s, t, i, f, e in x._fields())),
    "column_field_paths": (f"{_PLACE}, column_name string, field_path string, data_type string", lambda x: ((s, t, f.name, p, k) for s, t, _, f, _ in x._fields() for p, k in _paths(f.name, f.dataType))),
    "views": (f"{_PLACE}, description string, view_definition string", _kinds("VIEW")),
    "materialized_views": (f"{_PLACE}, description string, view_definition string", _kinds("MATERIALIZED VIEW")),
    "snapshots": (f"{_PLACE}, base_table string, snapshot_time timestamp_ntz", lambda x: ((s, t, e["base"], _when(e["created"])) for s, t, e in x._tables() if e["kind"] == "SNAPSHOT")),
    "table_constraints": (f"constraint_name string, {_PLACE}, constraint_type string, enforced string", lambda x: ((f"{t}.{k['name']}", s, t, k["kind"], "NO") for s, t, k in _keys(x))),
    "key_column_usage": (f"constraint_name string, {_PLACE}, column_name string, ordinal_position int", lambda x: ((f"{t}.{k['name']}", s, t, c, i + 1) for s, t, k in _keys(x) for i, c in enumerate(k["columns"]))),
    "constraint_column_usage": (f"{_PLACE}, column_name string, constraint_name string", lambda x: ((*(k.get("table") or f"{s}.{t}").split("."), c, f"{t}.{k['name']}") for s, t, k in _keys(x) for c in k.get("other") or k["columns"])),
    "partitions": (f"{_PLACE}, partitioned_by string, total_files int, last_modified_time timestamp_ntz", lambda x: ((s, t, ",".join(e["partition"]), len(e["versions"][-1]["files"]), _when(e["versions"][-1]["at"])) for s, t, e in x._tables() if e["partition"])),
    "table_storage": (f"{_PLACE}, total_files int, total_physical_bytes bigint, versions int", lambda x: ((s, t, len(e["versions"][-1]["files"]), _size(x, e), len(e["versions"])) for s, t, e in x._tables() if e["kind"] not in ("VIEW", "EXTERNAL"))),
    "routines": ("routine_name string, routine_type string, data_type string, routine_definition string", lambda x: ((n, r["kind"], r["returns"], r["body"]) for n, r in x.catalogue["routines"].items())),
    "parameters": ("specific_name string, ordinal_position int, parameter_name string, data_type string", lambda x: ((n, i + 1, *a.split(None, 1)) for n, r in x.catalogue["routines"].items() for i, a in enumerate(a.strip() for a in r["arguments"].split(",") if a.strip()))),
    "row_access_policies": (f"policy_name string, {_PLACE}, grantees string, filter string", lambda x: ((n, *p["table"].split("."), ",".join(p["grantees"]), p["filter"]) for n, p in x.catalogue["policies"].items())),
}
