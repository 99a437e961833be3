"""Queries of whole families of functions over whole tables, each expression beside its DuckDB counterpart."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import json as J
from lodestone.functions import library as L
from lodestone.functions import sketches as S
from lodestone.functions import texts as X
from lodestone.functions import times as T

from .catalogue import register, table
from .function_queries import scalar

c = F.col


def _doc():
    """A JSON text of an order, made from its columns."""
    return J.json_object(id=c("o_orderkey"), status=c("o_orderstatus"), tags=F.array(c("o_orderpriority"), F.lit("x\"y")), total=c("o_custkey") / 4.0, none=F.lit(None).cast("string"), sub=F.named_struct(F.lit("a"), c("o_custkey"), F.lit("ok"), c("o_custkey") % 2 == 0))


_DOC = """json_object('id', o_orderkey, 'status', o_orderstatus, 'tags', json_array(o_orderpriority, 'x"y'), 'total', o_custkey / 4.0, 'none', NULL,
                     'sub', json_object('a', o_custkey, 'ok', o_custkey % 2 = 0))"""

scalar("fn_json_read", "orders", "o_orderkey", {
    "type_root": (lambda: J.json_type(_doc()), "'object'"),
    "type_tags": (lambda: J.json_type(J.json_query(_doc(), "$.tags")), "'array'"),
    "type_status": (lambda: J.json_type(J.json_query(_doc(), "$.status")), "'string'"),
    "type_number": (lambda: J.json_type(J.json_query(_doc(), "$.id")), "'number'"),
    "type_bool": (lambda: J.json_type(J.json_query(_doc(), "$.sub.ok")), "'boolean'"),
    "type_null": (lambda: J.json_type(F.lit("null")), "'null'"),
    "type_broken": (lambda: J.json_type(F.lit("{a")), "NULL"),
    "value_status": (lambda: J.json_value(_doc(), "$.status"), "o_orderstatus"),
    "value_deep": (lambda: J.json_value(_doc(), "$.sub.a"), "o_custkey::VARCHAR"),
    "value_of_array": (lambda: J.json_value(_doc(), "$.tags"), "NULL"),
    "value_brackets": (lambda: J.json_value(J.json_array(F.concat(F.lit("["), c("o_orderstatus"), F.lit("]"))), "$[0]"), "'[' || o_orderstatus || ']'"),
    "query_scalar": (lambda: J.json_query(_doc(), "$.status"), "'\"' || o_orderstatus || '\"'"),
    "query_tags": (lambda: J.json_query(_doc(), "$.tags"), f"json_extract({_DOC}, '$.tags')::VARCHAR"),
    "extract_": (lambda: L.call("json_extract", _doc(), "$.sub.a"), "o_custkey::VARCHAR"),
    "extract_scalar": (lambda: L.call("json_extract_scalar", _doc(), "$.tags[1]"), "'x\"y'"),
    "array_query": (lambda: F.array_join(J.json_query_array(_doc(), "$.tags"), ";"), "'\"' || o_orderpriority || '\";\"x\\\"y\"'"),
    "array_value": (lambda: F.array_join(J.json_value_array(_doc(), "$.tags"), ";"), "o_orderpriority || ';x\"y'"),
    "array_strings": (lambda: F.array_join(L.call("json_extract_string_array", _doc(), "$.tags"), ";"), "o_orderpriority || ';x\"y'"),
    "array_of_object": (lambda: J.json_value_array(_doc(), "$.sub"), "NULL"),
    "subscript_": (lambda: J.json_subscript(_doc(), "sub"), f"json_extract({_DOC}, '$.sub')::VARCHAR"),
    "int_": (lambda: J.json_int64(J.json_query(_doc(), "$.id")), "o_orderkey"),
    "float_": (lambda: J.json_float64(J.json_query(_doc(), "$.total")), "o_custkey / 4.0"),
    "bool_": (lambda: J.json_bool(J.json_query(_doc(), "$.sub.ok")), "o_custkey % 2 = 0"),
    "string_": (lambda: J.json_string(J.json_query(_doc(), "$.status")), "o_orderstatus"),
    "lax_int": (lambda: J.lax_int64(J.json_array(c("o_custkey")).substr(F.lit(2), F.char_length(J.json_array(c("o_custkey"))) - 2)), "o_custkey"),
    "lax_int_text": (lambda: J.lax_int64(F.concat(F.lit('"'), c("o_custkey"), F.lit('"'))), "o_custkey"),
    "lax_int_bool": (lambda: J.lax_int64(F.lit("true")), "1"),
    "lax_float": (lambda: J.lax_float64(F.concat(F.lit('"'), c("o_custkey"), F.lit('.5"'))), "o_custkey + 0.5"),
    "lax_bool": (lambda: J.lax_bool(F.concat(F.lit('"'), F.when(c("o_custkey") % 2 == 0, "TRUE").otherwise("no"), F.lit('"'))), "CASE WHEN o_custkey % 2 = 0 THEN true END"),
    "lax_string": (lambda: J.lax_string(J.json_query(_doc(), "$.sub.ok")), "CASE WHEN o_custkey % 2 = 0 THEN 'true' ELSE 'false' END"),
    "lax_string_object": (lambda: J.lax_string(_doc()), "NULL"),
})

scalar("fn_json_write", "orders", "o_orderkey", {
    "object_": (lambda: _doc(), f"{_DOC}::VARCHAR"),
    "array_": (lambda: J.json_array(c("o_orderkey"), c("o_orderstatus"), F.lit(None).cast("string")), "json_array(o_orderkey, o_orderstatus, NULL)::VARCHAR"),
    "to_json_": (lambda: F.to_json(J.to_json(F.struct(c("o_custkey").alias("a"), F.lit(None).cast("string").alias("b")))), "json_object('a', o_custkey, 'b', NULL)::VARCHAR"),
    "set_old": (lambda: J.json_set(J.json_object(a=c("o_custkey"), b=F.lit("z")), "$.a", c("o_orderstatus")), "json_object('a', o_orderstatus, 'b', 'z')::VARCHAR"),
    "set_new": (lambda: J.json_set(J.json_object(a=c("o_custkey")), "$.b.c", F.lit(1)), "json_object('a', o_custkey, 'b', json_object('c', 1))::VARCHAR"),
    "set_element": (lambda: J.json_set(J.json_object(a=F.array(F.lit(1), F.lit(2))), "$.a[3]", c("o_custkey")), "json_object('a', json_array(1, 2, NULL, o_custkey))::VARCHAR"),
    "set_no_new": (lambda: J.json_set(J.json_object(a=c("o_custkey")), "$.b", F.lit(1), False), "json_object('a', o_custkey)::VARCHAR"),
    "remove_member": (lambda: J.json_remove(J.json_object(a=c("o_custkey"), b=F.lit(1)), "$.b"), "json_object('a', o_custkey)::VARCHAR"),
    "remove_element": (lambda: J.json_remove(J.json_object(a=F.array(F.lit(1), F.lit(2), F.lit(3))), "$.a[1]"), "json_object('a', json_array(1, 3))::VARCHAR"),
    "append_": (lambda: J.json_array_append(J.json_object(a=F.array(F.lit(1))), "$.a", c("o_custkey")), "json_object('a', json_array(1, o_custkey))::VARCHAR"),
    "append_each": (lambda: J.json_array_append(J.json_array(F.lit(1)), "$", F.array(F.lit(2), F.lit(3))), "json_array(1, 2, 3)::VARCHAR"),
    "append_whole": (lambda: J.json_array_append(J.json_array(F.lit(1)), "$", F.array(F.lit(2)), False), "json_array(1, json_array(2))::VARCHAR"),
    "insert_": (lambda: J.json_array_insert(J.json_array(F.lit("a"), F.lit("b")), "$[1]", c("o_custkey")), "json_array('a', o_custkey, 'b')::VARCHAR"),
    "insert_far": (lambda: J.json_array_insert(J.json_array(F.lit("a")), "$[2]", c("o_custkey")), "json_array('a', NULL, o_custkey)::VARCHAR"),
    "strip_": (lambda: J.json_strip_nulls(F.lit('{"a":null,"b":[null,1],"c":{"d":null}}')), "'{\"b\":[1],\"c\":{}}'"),
    "strip_empty": (lambda: J.json_strip_nulls(F.lit('{"a":null,"b":[null],"c":{"d":null},"e":2}'), True, True), "'{\"e\":2}'"),
    "flatten_": (lambda: F.array_join(J.json_flatten(F.lit('[1,[2,[3]],"x"]')), ";"), "'1;2;[3];\"x\"'"),
})

TS = "ts"
scalar("fn_datetime", "events", "event_id", {
    "parts_": (lambda: T.datetime(F.year("ts"), F.month("ts"), F.lit(1), 2, 3, 4), "make_timestamp(year(ts), month(ts), 1, 2, 3, 4)"),
    "of_date": (lambda: T.datetime(F.to_date("ts"), F.lit("01:02:03")), "CAST(ts AS DATE) + INTERVAL '01:02:03'"),
    "add_month": (lambda: T.datetime_add("ts", 1, "MONTH"), "ts + INTERVAL 1 MONTH"),
    "add_hour": (lambda: T.datetime_add("ts", 30, "HOUR"), "ts + INTERVAL 30 HOUR"),
    "sub_quarter": (lambda: T.datetime_sub("ts", 1, "QUARTER"), "ts - INTERVAL 3 MONTH"),
    "sub_week": (lambda: T.datetime_sub("ts", 2, "WEEK"), "ts - INTERVAL 14 DAY"),
    **{f"diff_{p.lower()}": (lambda p=p: T.datetime_diff("ts", F.lit("2020-02-29 13:14:15").cast("timestamp_ntz"), p), f"date_diff('{p.lower()}', TIMESTAMP '2020-02-29 13:14:15', ts)") for p in ("SECOND", "MINUTE", "HOUR", "DAY", "MONTH", "QUARTER", "YEAR")},
    "diff_isoweek": (lambda: T.datetime_diff("ts", F.lit("2020-02-29 13:14:15").cast("timestamp_ntz"), "ISOWEEK"), "((epoch(date_trunc('week', ts)) - epoch(DATE '2020-02-24')) / 604800)::BIGINT"),
    "diff_week": (lambda: T.datetime_diff("ts", F.lit("2020-02-29 13:14:15").cast("timestamp_ntz"), "WEEK"), "((epoch(date_trunc('week', ts + INTERVAL 1 DAY)) - epoch(DATE '2020-02-24')) / 604800)::BIGINT"),
    **{f"trunc_{p.lower()}": (lambda p=p: T.datetime_trunc("ts", p), f"date_trunc('{p.lower()}', ts)::TIMESTAMP") for p in ("SECOND", "MINUTE", "HOUR", "DAY", "MONTH", "QUARTER", "YEAR")},
    "trunc_isoweek": (lambda: T.datetime_trunc("ts", "ISOWEEK"), "date_trunc('week', ts)::TIMESTAMP"),
    "trunc_week": (lambda: T.datetime_trunc("ts", "WEEK"), "(date_trunc('week', ts + INTERVAL 1 DAY) - INTERVAL 1 DAY)::TIMESTAMP"),
    "bucket_hours": (lambda: T.datetime_bucket("ts", 12, "HOUR"), "time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '1950-01-01')"),
    "bucket_days": (lambda: T.datetime_bucket("ts", 7, "DAY"), "time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1950-01-01')"),
    "bucket_months": (lambda: T.datetime_bucket("ts", 5, "MONTH"), "time_bucket(INTERVAL 5 MONTH, ts, TIMESTAMP '1950-01-01')"),
    "parse_": (lambda: T.parse_datetime("%Y-%m-%d %H:%M:%S", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")), "date_trunc('second', ts)"),
    "format_": (lambda: T.format_datetime("%d/%m/%Y %H:%M", "ts"), "strftime(ts, '%d/%m/%Y %H:%M')"),
    "string_": (lambda: F.substring(T.string("ts"), 1, 19), "strftime(ts, '%Y-%m-%d %H:%M:%S')"),
    "date_parts": (lambda: T.date(F.year("ts"), F.lit(2), F.lit(3)), "make_date(year(ts), 2, 3)"),
    "timestamp_zone": (lambda: F.date_format(T.timestamp(F.lit("2024-01-02 03:04:05"), "America/New_York"), "yyyy-MM-dd HH:mm:ss"), "'2024-01-02 08:04:05'"),
    "array_": (lambda: F.size(T.generate_timestamp_array(F.date_trunc("DAY", "ts"), F.col("ts"), "1 HOUR")).cast("long"), "hour(ts) + 1"),
    "now_is_one": (lambda: (L.call("current_date") == L.call("current_timestamp").cast("date")) & (L.call("current_datetime").cast("date") == L.call("current_date")) & (F.char_length(L.call("current_time")) >= 8), "true"),
})

_CLOCK = "strftime(ts, '%H:%M:%S')"
_t = lambda: T.time(F.date_trunc("SECOND", "ts"))
scalar("fn_time", "events", "event_id", {
    "time_": (lambda: _t(), _CLOCK),
    "parts_": (lambda: T.time(F.hour("ts"), F.minute("ts"), F.lit(7)), "strftime(date_trunc('minute', ts) + INTERVAL 7 SECOND, '%H:%M:%S')"),
    "add_": (lambda: T.time_add(_t(), 100, "MINUTE"), "strftime(ts + INTERVAL 100 MINUTE, '%H:%M:%S')"),
    "sub_": (lambda: T.time_sub(_t(), 13, "HOUR"), "strftime(ts - INTERVAL 13 HOUR, '%H:%M:%S')"),
    "diff_hour": (lambda: T.time_diff(_t(), F.lit("12:30:00"), "HOUR"), "hour(ts) - 12"),
    "diff_minute": (lambda: T.time_diff(_t(), F.lit("12:30:00"), "MINUTE"), "hour(ts) * 60 + minute(ts) - 750"),
    "trunc_": (lambda: T.time_trunc(_t(), "HOUR"), "strftime(date_trunc('hour', ts), '%H:%M:%S')"),
    "hour_": (lambda: T.extract_time("HOUR", _t()), "hour(ts)"),
    "minute_": (lambda: T.extract_time("MINUTE", _t()), "minute(ts)"),
    "second_": (lambda: T.extract_time("SECOND", _t()), "second(ts)"),
    "millis_": (lambda: T.extract_time("MILLISECOND", F.lit("01:02:03.4567")), "456"),
    "parse_": (lambda: T.parse_time("%H.%M", F.date_format("ts", "HH.mm")), "strftime(date_trunc('minute', ts), '%H:%M:%S')"),
    "format_": (lambda: T.format_time("%H-%M", _t()), "strftime(ts, '%H-%M')"),
})


def _i():
    return T.make_interval(0, c("o_custkey") % 40 - 20, c("o_custkey") % 97 - 40, c("o_custkey") % 60 - 30, 5, 6)


# the counterparts go by total numbers, with the sign rules worked out from the definition
_M, _D, _H = "(o_custkey % 40 - 20)", "(o_custkey % 97 - 40)", "((o_custkey % 60 - 30) * 3600000000 + 306000000)"
scalar("fn_interval", "orders", "o_orderkey", {
    "years_": (lambda: T.extract_interval("YEAR", _i()), f"trunc({_M} / 12.0)::BIGINT"),
    "months_": (lambda: T.extract_interval("MONTH", _i()), f"{_M} - 12 * trunc({_M} / 12.0)::BIGINT"),
    "days_": (lambda: T.extract_interval("DAY", _i()), _D),
    "hours_": (lambda: T.extract_interval("HOUR", _i()), f"trunc({_H} / 3600000000.0)::BIGINT"),
    "seconds_": (lambda: T.extract_interval("SECOND", _i()), f"trunc({_H} / 1000000.0)::BIGINT - 60 * trunc(trunc({_H} / 1000000.0) / 60)::BIGINT"),
    "justified_days_total": (lambda: T.justify_days(_i())["months"] * 30 + T.justify_days(_i())["days"], f"{_M} * 30 + {_D}"),
    "justified_days_small": (lambda: (F.abs(T.justify_days(_i())["days"]) < 30) & (T.justify_days(_i())["months"] * T.justify_days(_i())["days"] >= 0), "true"),
    "justified_hours_total": (lambda: T.justify_hours(_i())["days"] * T.DAY_MICROS + T.justify_hours(_i())["micros"], f"{_D} * 86400000000 + {_H}"),
    "justified_hours_small": (lambda: F.abs(T.justify_hours(_i())["micros"]) < T.DAY_MICROS, "true"),
    "justified_total": (lambda: (T.justify_interval(_i())["months"] * 30 + T.justify_interval(_i())["days"]) * T.DAY_MICROS + T.justify_interval(_i())["micros"], f"({_M} * 30 + {_D}) * 86400000000 + {_H}"),
    "sum_months": (lambda: T.interval_add(_i(), T.interval_multiply(_i(), F.lit(2)))["months"], f"3 * {_M}"),
    "moved_": (lambda: T.datetime_plus("o_orderdate", T.make_interval(1, 2, 3, 4, 5, 6)), "o_orderdate + INTERVAL 14 MONTH + INTERVAL 3 DAY + INTERVAL '04:05:06'"),
    "apart_": (lambda: T.datetime_minus("o_orderdate", F.lit("1995-01-01").cast("timestamp_ntz"))["days"], "trunc(epoch(o_orderdate - TIMESTAMP '1995-01-01') / 86400)::BIGINT"),
})

_IP = "((o_custkey % 223 + 1) || '.' || (o_orderkey % 256) || '.0.' || (o_custkey % 256))"


def _ip():
    return F.concat_ws(".", c("o_custkey") % 223 + 1, c("o_orderkey") % 256, F.lit(0), c("o_custkey") % 256)


scalar("fn_net_addresses", "orders", "o_orderkey", {
    "from_": (lambda: F.hex(L.net_ip_from_string(_ip())), "printf('%02X%02X00%02X', o_custkey % 223 + 1, o_orderkey % 256, o_custkey % 256)"),
    "safe_": (lambda: F.hex(L.net_safe_ip_from_string(F.concat(_ip(), F.lit("9999")))), "NULL"),
    "six_": (lambda: F.hex(L.net_ip_from_string(F.concat(F.lit("2001:db8::"), F.lower(F.hex(c("o_custkey") % 256)), F.lit(":1")))), "'20010DB80000000000000000' || printf('%04X0001', o_custkey % 256)"),
    "mask_": (lambda: F.hex(L.net_ip_net_mask(4, (c("o_custkey") % 33).cast("int"))), "printf('%08X', (4294967296 - (1::BIGINT << (32 - o_custkey % 33))))"),
    "trunc_": (lambda: F.hex(L.net_ip_trunc(L.net_ip_from_string(_ip()), 12)), "printf('%02X%02X0000', o_custkey % 223 + 1, (o_orderkey % 256) // 16 * 16)"),
    "host_": (lambda: L.net_host(F.concat(F.lit(" //u:p@Www.X"), c("o_custkey"), F.lit(".co.uk:80/a?b"))), "'Www.X' || o_custkey || '.co.uk'"),
    "host_plain": (lambda: L.net_host(F.concat(c("o_custkey"), F.lit(".example.com/x"))), "o_custkey || '.example.com'"),
    "host_none": (lambda: L.net_host(F.lit("/a/b")), "NULL"),
    "suffix_": (lambda: L.net_public_suffix(F.concat(F.lit("http://www.x"), c("o_custkey"), F.lit(".co.uk/"))), "'co.uk'"),
    "suffix_one": (lambda: L.net_public_suffix(F.concat(F.lit("http://x"), c("o_custkey"), F.lit(".example.com/"))), "'com'"),
    "domain_": (lambda: L.net_reg_domain(F.concat(F.lit("http://a.b.x"), c("o_custkey"), F.lit(".co.uk/"))), "'x' || o_custkey || '.co.uk'"),
    "domain_none": (lambda: L.net_reg_domain(F.lit("http://co.uk")), "NULL"),
})

scalar("fn_text_more", "part", "p_partkey", {
    "trim_": (lambda: L.trim(F.concat(F.lit("\t\n 　"), c("p_name"), F.lit(" \r\n"))), "p_name"),
    "ltrim_": (lambda: L.ltrim(F.concat(F.lit("\t "), c("p_name"))), "p_name"),
    "rtrim_": (lambda: L.rtrim(F.concat(c("p_name"), F.lit(" \n"))), "p_name"),
    "nfc_": (lambda: X.normalize(F.concat(c("p_brand"), F.lit("é"))), "p_brand || 'é'"),
    "nfd_": (lambda: F.char_length(X.normalize(F.concat(c("p_brand"), F.lit("é")), "NFD")), "length(p_brand) + 2"),
    "nfkc_": (lambda: X.normalize(F.concat(c("p_brand"), F.lit("ﬁ")), "NFKC"), "p_brand || 'fi'"),
    "fold_": (lambda: X.normalize_and_casefold(F.concat(c("p_brand"), F.lit("STRASSE ß"))), "lower(p_brand) || 'strasse ss'"),
    "points_": (lambda: L.code_points_to_string(L.to_code_points(F.concat(c("p_name"), F.lit("\U0001f600é")))), "p_name || '😀é'"),
    "no_points": (lambda: F.size(L.to_code_points(F.lit(""))).cast("long"), "0"),
    "base32_": (lambda: X.from_base32(X.to_base32(c("p_name").cast("binary"))).cast("string"), "p_name"),
    "base32_known": (lambda: X.to_base32(F.lit("abcde\xff").cast("binary")), "'MFRGGZDFYO7Q===='"),
    "bytes_": (lambda: F.hex(X.code_points_to_bytes(F.array(F.lit(0), F.lit(255), (c("p_size") % 50).cast("int")))), "'00FF' || printf('%02X', p_size % 50)"),
    "collate_": (lambda: X.collate(c("p_brand"), "und:ci") == F.lower("p_brand"), "true"),
    "contains_": (lambda: X.contains_substr(F.struct("p_name", "p_brand"), "BRAND#1"), "contains(lower(p_name), 'brand#1') OR contains(lower(p_brand), 'brand#1')"),
    "format_": (lambda: X.format("%05d|%s|%-8s|%.2f|%x|%%|%T", c("p_size"), c("p_brand"), F.lit("ab"), c("p_retailprice"), c("p_size"), c("p_brand")), "printf('%05d|%s|ab      |%.2f|%x|%%|\"%s\"', p_size, p_brand, p_retailprice, p_size, p_brand)"),
    "format_null": (lambda: X.format("%d", F.lit(None).cast("int")), "NULL"),
    "numeric_": (lambda: X.parse_numeric(F.concat(F.lit(" - 1,"), F.lpad((c("p_size") % 1000).cast("string"), 3, "0"), F.lit(".5 "))).cast("double"), "-(1000 + p_size % 1000 + 0.5)"),
    "numeric_after": (lambda: X.parse_numeric(F.concat(c("p_size"), F.lit("e2-"))).cast("double"), "-(p_size * 100)::DOUBLE"),
    "big_": (lambda: L.call("parse_bignumeric", F.concat(c("p_size"), F.lit(".25"))).cast("double"), "p_size + 0.25"),
    "type_": (lambda: L.call("typeof", c("p_name")), "'string'"),
    "uuid_": (lambda: F.char_length(L.call("generate_uuid")), "36"),
})

scalar("fn_range_more", "orders", "o_orderkey", {
    "pieces_": (lambda: F.size(L.generate_range_array(L.range_(F.lit("2024-01-01").cast("date"), F.date_add(F.lit("2024-01-01").cast("date"), (c("o_custkey") % 50 + 1).cast("int"))), "7 DAY")).cast("long"), "ceil((o_custkey % 50 + 1) / 7.0)::BIGINT"),
    "whole_pieces": (lambda: F.size(L.generate_range_array(L.range_(F.lit("2024-01-01").cast("date"), F.date_add(F.lit("2024-01-01").cast("date"), (c("o_custkey") % 50 + 1).cast("int"))), "7 DAY", False)).cast("long"), "(o_custkey % 50 + 1) // 7"),
    "inside_": (lambda: L.range_contains_range(L.range_(F.lit(10), F.lit(1000)), L.range_(c("o_custkey"), c("o_custkey") + 5)), "o_custkey >= 10 AND o_custkey + 5 <= 1000"),
    "both_": (lambda: L.range_intersect(L.range_(F.lit(0), c("o_custkey") + 9), L.range_(c("o_custkey"), F.lit(None).cast("long")))["end"], "o_custkey + 9"),
})


@register("aggregate_arguments", """SELECT o_orderpriority, string_agg(DISTINCT o_orderstatus, '|' ORDER BY o_orderstatus) AS statuses,
  array_to_string((list(o_orderkey ORDER BY o_totalprice DESC, o_orderkey DESC))[1:3], ',') AS dearest,
  (array_agg(o_custkey ORDER BY o_orderkey))[1] AS first_customer, len(list(DISTINCT o_custkey % 7))::BIGINT AS sevens
  FROM orders GROUP BY o_orderpriority""")
def aggregate_arguments(spark, sf_dir):
    """DISTINCT, ORDER BY and LIMIT inside aggregate calls."""
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(
        L.string_agg(c("o_orderstatus"), "|", distinct=True, order=["o_orderstatus"]).alias("statuses"),
        F.array_join(L.array_agg("o_orderkey", order=[("o_totalprice", "desc"), ("o_orderkey", "desc")], limit=3), ",").alias("dearest"),
        F.get(L.array_agg("o_custkey", order=["o_orderkey"], limit=1), F.lit(0)).alias("first_customer"),
        F.size(L.array_agg(c("o_custkey") % 7, distinct=True)).cast("long").alias("sevens"),
    )


@register("fn_percentile_disc", "SELECT l_returnflag, quantile_disc(l_extendedprice, 0.3) AS low, quantile_disc(l_quantity, 0.5) AS middle FROM lineitem GROUP BY l_returnflag")
def fn_percentile_disc(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(L.percentile_disc("l_extendedprice", 0.3).alias("low"), L.percentile_disc("l_quantity", 0.5).alias("middle"))


@register("approx_top_sum", """SELECT l_returnflag, array_to_string(list(l_suppkey || ':' || n ORDER BY n DESC, l_suppkey), ',') AS top FROM (
  SELECT * FROM (SELECT l_returnflag, l_suppkey, sum(l_quantity)::BIGINT AS n FROM lineitem GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY n DESC, l_suppkey) <= 5) GROUP BY l_returnflag""")
def approx_top_sum(spark, sf_dir):
    found = S.approx_top_sum(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_suppkey", "l_quantity", 5)
    return found.select("l_returnflag", F.array_join(F.transform("top", lambda t: F.concat_ws(":", t["value"], t["sum"].cast("long"))), ",").alias("top"))


@register("approx_top_count", """SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type LIMIT 3""")
def approx_top_count(spark, sf_dir):
    """There are fewer event types than the sketch keeps, so its counts are exact."""
    top = table(spark, sf_dir, "events").agg(S.approx_top_count("event_type", 3).alias("top"))
    return top.select(F.inline(F.transform("top", lambda t: F.struct(t["value"].alias("event_type"), t["count"].alias("n")))))


@register("sketch_quantiles", """SELECT l_returnflag, true AS near, true AS near_merged, true AS near_point, 5 AS places FROM lineitem GROUP BY l_returnflag""")
def sketch_quantiles(spark, sf_dir):
    """KLL sketches by line status, merged by return flag; quantiles within two per cent of the exact ranks."""
    lines = table(spark, sf_dir, "lineitem")
    parts = lines.groupBy("l_returnflag", "l_linestatus").agg(L.call("kll_quantiles_init_float64", "l_extendedprice").alias("s"), L.call("kll_quantiles_init_int64", "l_quantity").alias("q"))
    merged = parts.groupBy("l_returnflag").agg(
        L.call("kll_quantiles_merge_float64", "s", 4).alias("all"), L.call("kll_quantiles_merge_point_float64", "s", 0.5).alias("middle"),
        L.call("kll_quantiles_merge_partial_float64", "s").alias("again"), L.call("kll_quantiles_merge_int64", "q", 4).alias("whole"),
    )
    merged = merged.withColumn("point", L.call("kll_quantiles_extract_point_float64", "again", 0.25)).withColumn("each", L.call("kll_quantiles_extract_float64", "again", 4))
    ranks = lines.join(merged, "l_returnflag").groupBy("l_returnflag").agg(
        F.avg((c("l_extendedprice") <= F.get("all", F.lit(2))).cast("int")).alias("r1"), F.avg((c("l_extendedprice") <= c("middle")).cast("int")).alias("r2"),
        F.avg((c("l_extendedprice") <= c("point")).cast("int")).alias("r3"), F.max(F.size("each")).alias("places"), F.max(F.size("whole")).alias("places2"),
    )
    near = lambda r, x: F.abs(c(r) - x) < 0.02
    return ranks.select("l_returnflag", near("r1", 0.5).alias("near"), near("r2", 0.5).alias("near_merged"), near("r3", 0.25).alias("near_point"), "places")


@register("sketch_distinct", "SELECT event_type, true AS near, true AS near_merged FROM events GROUP BY event_type")
def sketch_distinct(spark, sf_dir):
    """HLL sketches by type and day, merged in two steps; within two per cent of the exact numbers."""
    events = table(spark, sf_dir, "events")
    parts = events.groupBy("event_type", F.to_date("ts").alias("day")).agg(L.call("hll_count_init", "user_id").alias("s"))
    merged = parts.groupBy("event_type").agg(L.call("hll_count_merge", "s").alias("n"), L.call("hll_count_merge_partial", "s").alias("all"))
    exact = events.groupBy("event_type").agg(F.count_distinct("user_id").alias("x"))
    near = lambda n: F.abs(n - c("x")) <= F.greatest(F.lit(1.0), 0.02 * c("x"))
    return merged.join(exact, "event_type").select("event_type", near(c("n")).alias("near"), near(L.call("hll_count_extract", "all")).alias("near_merged"))
