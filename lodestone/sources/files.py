"""Loading and exporting files, and schemas as JSON field lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

FORMATS = ("parquet", "orc", "csv", "json", "avro", "text")

_KINDS = {
    "STRING": T.StringType(), "BYTES": T.BinaryType(), "INTEGER": T.LongType(), "INT64": T.LongType(), "FLOAT": T.DoubleType(), "FLOAT64": T.DoubleType(),
    "BOOLEAN": T.BooleanType(), "BOOL": T.BooleanType(), "DATE": T.DateType(), "DATETIME": T.TimestampNTZType(), "TIMESTAMP": T.TimestampType(),
    "NUMERIC": T.DecimalType(38, 9), "BIGNUMERIC": T.DecimalType(38, 18), "JSON": T.StringType(), "TIME": T.StringType(), "GEOGRAPHY": T.StringType(),
}


def load(spark: SparkSession, path: str | list[str], format_: str, schema: T.StructType | str | None = None, **options) -> DataFrame:
    """Files of a format; hive-partitioned folders give their partition columns. A given schema saves a pass over the data."""
    if format_ not in FORMATS:
        raise ValueError(f"there is no format {format_}")
    reader = spark.read.format(format_).options(**options)
    reader = reader if schema is None else reader.schema(schema)
    return reader.load(path)


def export(df: DataFrame, path: str, format_: str, overwrite: bool = False, partition_by: list[str] | None = None, **options) -> None:
    if format_ not in FORMATS:
        raise ValueError(f"there is no format {format_}")
    writer = df.write.format(format_).options(**options).mode("overwrite" if overwrite else "errorifexists")
    writer = writer.partitionBy(*partition_by) if partition_by else writer
    writer.save(path)


def schema_from_fields(fields: list[dict]) -> T.StructType:
    """A schema from [{name, type, mode, fields}]; REPEATED is an array, RECORD a struct."""
    made = []
    for f in fields:
        kind, mode = f["type"].upper(), f.get("mode", "NULLABLE").upper()
        if kind in ("RECORD", "STRUCT"):
            data: T.DataType = schema_from_fields(f["fields"])
        elif kind in _KINDS:
            data = _KINDS[kind]
        else:
            raise ValueError(f"there is no type {f['type']}")
        data = T.ArrayType(data) if mode == "REPEATED" else data
        made.append(T.StructField(f["name"], data, mode != "REQUIRED", {"description": f["description"]} if f.get("description") else {}))
    return T.StructType(made)


def fields_from_schema(schema: T.StructType) -> list[dict]:
    """The reverse; types get their usual names."""
    names = {T.StringType: "STRING", T.BinaryType: "BYTES", T.LongType: "INTEGER", T.IntegerType: "INTEGER", T.ShortType: "INTEGER", T.DoubleType: "FLOAT", T.FloatType: "FLOAT", T.BooleanType: "BOOLEAN", T.DateType: "DATE", T.TimestampNTZType: "DATETIME", T.TimestampType: "TIMESTAMP", T.DecimalType: "NUMERIC"}
    out = []
    for f in schema.fields:
        data, mode = f.dataType, "NULLABLE" if f.nullable else "REQUIRED"
        if isinstance(data, T.ArrayType):
            data, mode = data.elementType, "REPEATED"
        one = {"name": f.name, "type": "RECORD" if isinstance(data, T.StructType) else names[type(data)], "mode": mode}
        if isinstance(data, T.StructType):
            one["fields"] = fields_from_schema(data)
        if f.metadata.get("description"):
            one["description"] = f.metadata["description"]
        out.append(one)
    return out
