import math

import pytest
from pyspark.sql import functions as F

from lodestone.functions import json as J
from lodestone.functions import library as L


@pytest.fixture(scope="module")
def value(spark):
    one = spark.range(1)
    return lambda column: one.select(column.alias("v")).first()["v"]


def test_numbers(value):
    assert value(L.int64(F.lit(1.5))) == 2 and value(L.int64(F.lit(-2.5))) == -3
    assert value(L.ceil(F.lit(1.2))) == 2.0 and isinstance(value(L.floor(F.lit(1.2))), float)
    assert value(L.greatest(F.lit(1), F.lit(None).cast("int"))) is None
    assert value(L.log(F.lit(8.0), F.lit(2.0))) == pytest.approx(3)
    assert math.isnan(value(L.ieee_divide(F.lit(0), F.lit(0)))) and value(L.ieee_divide(F.lit(-1), F.lit(0))) == -math.inf
    assert value(L.safe_divide(F.lit(1), F.lit(0))) is None
    assert value(L.range_bucket(F.lit(20), [0, 10, 20, 30])) == 3
    assert value(L.range_bucket(F.lit(None).cast("int"), [0])) is None
    for bad in (L.ln(F.lit(0.0)), L.sqrt(F.lit(-1.0)), L.log10(F.lit(-1.0))):
        with pytest.raises(Exception, match="number"):
            value(bad)
    assert value(L.float_equal(F.lit(float("nan")), F.lit(float("nan")))) is False


def test_texts(value):
    assert value(L.substr(F.lit("apple"), -30, 2)) == "ap" and value(L.substr(F.lit("apple"), 0, 2)) == "ap" and value(L.substr(F.lit("apple"), -2)) == "le"
    assert value(L.split(F.lit("a.b|c"), ".")) == ["a", "b|c"]
    assert value(L.regexp_extract(F.lit("abc"), "x")) is None and value(L.regexp_extract(F.lit("abc"), "b(c)")) == "c"
    assert value(L.initcap(F.lit("HELLO wORLD-every(body)"))) == "Hello World-Every(Body)"
    assert value(L.edit_distance(F.lit("abcdefgh"), F.lit("zzz"), 2)) == 2
    assert value(L.instr(F.lit("banana"), "an", 1, 2)) == 4 and value(L.instr(F.lit("banana"), "an", 1, 3)) == 0
    assert value(L.code_points_to_string(L.to_code_points(F.lit("né")))) == "né"
    assert value(L.regexp_replace(F.lit("abc"), "(b)", r"<\1>")) == "a<b>c"


def test_dates(value):
    d = lambda s: F.to_date(F.lit(s))
    assert value(L.date_diff(d("2017-10-15"), d("2017-10-14"), "WEEK")) == 1
    assert value(L.date_diff(d("2017-12-31"), d("2014-12-30"), "YEAR")) == 3
    assert value(L.date_diff(d("2024-02-29"), d("2024-01-31"), "MONTH")) == 1
    assert str(value(L.date_trunc(d("2008-12-25"), "MONTH"))) == "2008-12-01"
    assert str(value(L.date_trunc(d("2017-11-07"), "WEEK(MONDAY)"))) == "2017-11-06"
    assert str(value(L.date_trunc(d("2015-06-15"), "ISOYEAR"))) == "2014-12-29"
    assert str(value(L.date_add(d("2024-01-31"), F.lit(1), "MONTH"))) == "2024-02-29"
    t = lambda s: F.to_timestamp(F.lit(s))
    assert value(L.timestamp_diff(t("2001-02-01 01:00:00"), t("2001-02-01 00:00:01"), "HOUR")) == 0


def test_arrays_and_json(value):
    assert value(L.generate_array(F.lit(5), F.lit(1))) == [] and value(L.generate_array(F.lit(5), F.lit(1), F.lit(-2))) == [5, 3, 1]
    assert value(L.array_slice(F.array(*map(F.lit, "abcde")), 1, -2)) == ["b", "c", "d"]
    assert value(L.array_at(F.array(F.lit(1)), 5, safe=True)) is None
    with pytest.raises(Exception, match="INVALID_ARRAY_INDEX"):
        value(L.array_at(F.array(F.lit(1)), 5))
    assert value(J.json_value(F.lit('{"a": {"b": 1}}'), "$.a")) is None and value(J.json_value(F.lit('{"a": {"b": 1}}'), "$.a.b")) == "1"
    assert value(J.json_query(F.lit('{"a": [1]}'), "$.a")) == "[1]"


def test_aggregates(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double")
    row = df.agg(L.min_("x").alias("low"), F.max("x").alias("high"), L.array_agg("x").alias("all"), L.approx_quantiles("x", 2).alias("q")).first()
    assert math.isnan(row.low) and math.isnan(row.high) and len(row["all"]) == 3 and len(row.q) == 3
    assert df.filter("false").agg(L.array_agg("x").alias("v")).first().v is None
    order = [r.x for r in df.orderBy(*L.float_order("x")).collect()]
    assert order[0] is None and math.isnan(order[1]) and order[2] == 1.0
