"""Functions on JSON, as texts or as variants, under the surface's names and rules.

Paths are literals such as $.a.b[0]. A value is told by its JSON type, read from the variant at the path.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .library import FUNCTIONS, col, failing, function


def _variant(x) -> Column:
    return F.try_parse_json(col(x))


def _at(x, path: str) -> Column:
    """The variant at a path of a text; null where there is none."""
    return F.try_variant_get(_variant(x), path, "variant")


def _kind(found: Column) -> Column:
    return F.schema_of_variant(found)


def _is(found: Column, *kinds: str) -> Column:
    """Whether the variant's type begins with one of the names."""
    own = _kind(found)
    out = F.lit(False)
    for kind in kinds:
        out = out | own.startswith(kind)
    return F.coalesce(out, F.lit(False))


@function
def json_value(x, path: str = "$"):
    """The scalar at a path, as text; null for objects, arrays and JSON nulls."""
    found = _at(x, path)
    return F.when(found.isNotNull() & ~_is(found, "OBJECT", "ARRAY", "VOID"), F.get_json_object(col(x), path))


@function
def json_query(x, path: str = "$"):
    """The value at a path, as JSON; null for JSON nulls."""
    found = _at(x, path)
    return F.when(_is(found, "STRING"), F.to_json(found)).when(found.isNotNull() & ~_is(found, "VOID"), F.get_json_object(col(x), path))


FUNCTIONS["json_extract"] = json_query
FUNCTIONS["json_extract_scalar"] = json_value


@function
def json_query_array(x, path: str = "$"):
    """The elements of the array at a path, each as JSON; null where there is no array."""
    found = _at(x, path)
    return F.when(_is(found, "ARRAY"), F.transform(F.try_variant_get(_variant(x), path, "array<variant>"), lambda v: F.to_json(v)))


FUNCTIONS["json_extract_array"] = json_query_array


@function
def json_value_array(x, path: str = "$"):
    """The scalars of the array at a path, as texts; null where there is no array, or one with other elements."""
    found = _at(x, path)
    parts = F.try_variant_get(_variant(x), path, "array<variant>")
    odd = F.exists(parts, lambda v: _is(v, "OBJECT", "ARRAY"))
    return F.when(_is(found, "ARRAY") & ~odd, F.transform(parts, lambda v: F.try_variant_get(v, "$", "string")))


FUNCTIONS["json_extract_string_array"] = json_value_array


@function
def parse_json(x):
    """A variant; an error for broken texts."""
    return F.parse_json(col(x))


@function
def safe_parse_json(x):
    return F.try_parse_json(col(x))


@function
def to_json_string(x):
    return F.to_json(col(x), {"ignoreNullFields": "false"})


@function
def to_json(x):
    """A struct, map, array or variant as a variant, nulls included."""
    return F.parse_json(to_json_string(x))


@function
def json_keys(x):
    return F.json_object_keys(col(x))


@function
def json_type(x):
    """object, array, string, number, boolean or null, of a JSON text; SQL null of broken ones."""
    found = _variant(x)
    number = _is(found, "BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT")
    named = F.when(_is(found, "OBJECT"), "object").when(_is(found, "ARRAY"), "array").when(_is(found, "STRING"), "string").when(_is(found, "BOOLEAN"), "boolean")
    return named.when(number, "number").when(_is(found, "VOID"), "null")


def _text(x) -> Column:
    """The JSON text of a value: strings in quotes, nulls as null."""
    whole = F.to_json(F.struct(col(x).alias("v")), {"ignoreNullFields": "false"})
    return F.substr(whole, F.lit(6), F.char_length(whole) - 6)


@function
def json_array(*values):
    """A JSON text of the values."""
    return F.concat(F.lit("["), F.concat_ws(",", *(_text(v) for v in values)), F.lit("]"))


@function
def json_object(**values):
    """A JSON text of names and values, in the order given."""
    return F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(json.dumps(k, ensure_ascii=False) + ":"), _text(v)) for k, v in values.items())), F.lit("}"))


def _scalar(x, kind: str, types: tuple[str, ...], message: str) -> Column:
    """The variant as a type; null of JSON null, an error for other JSON types."""
    found = _variant(x)
    return F.when(_is(found, *types), F.try_variant_get(found, "$", kind)).when(found.isNull() | _is(found, "VOID"), None).otherwise(failing(message).cast(kind))


@function
def json_bool(x):
    return _scalar(x, "boolean", ("BOOLEAN",), "the JSON value is not a boolean")


@function
def json_string(x):
    return _scalar(x, "string", ("STRING",), "the JSON value is not a string")


@function
def json_float64(x):
    return _scalar(x, "double", ("BIGINT", "DECIMAL", "DOUBLE"), "the JSON value is not a number")


@function
def json_int64(x):
    """Whole numbers only."""
    found = _variant(x)
    number = F.try_variant_get(found, "$", "double")
    whole = _is(found, "BIGINT") | (_is(found, "DECIMAL", "DOUBLE") & (number == F.floor(number)))
    return F.when(whole, number.cast("decimal(38,0)").cast("long")).when(found.isNull() | _is(found, "VOID"), None).otherwise(failing("the JSON value is not a whole number").cast("long"))


@function
def lax_bool(x):
    """Booleans, texts "true" and "false" in any case, and numbers; null of others."""
    found = _variant(x)
    text = F.lower(F.try_variant_get(found, "$", "string"))
    return F.when(_is(found, "BOOLEAN") | _is(found, "STRING"), F.when(text == "true", True).when(text == "false", False)).when(
        _is(found, "BIGINT", "DECIMAL", "DOUBLE"), F.try_variant_get(found, "$", "double") != 0
    )


@function
def lax_float64(x):
    """Numbers and texts of numbers; null of others."""
    found = _variant(x)
    return F.when(_is(found, "BIGINT", "DECIMAL", "DOUBLE"), F.try_variant_get(found, "$", "double")).when(_is(found, "STRING"), F.try_variant_get(found, "$", "string").try_cast("double"))


@function
def lax_int64(x):
    """Numbers, rounded, booleans, and texts of numbers; null of others."""
    found = _variant(x)
    number = F.coalesce(lax_float64(x), F.when(_is(found, "BOOLEAN"), F.try_variant_get(found, "$", "boolean").cast("double")))
    return F.round(number).cast("decimal(38,0)").try_cast("long")


@function
def lax_string(x):
    """Scalars as texts; null of others."""
    found = _variant(x)
    return F.when(found.isNotNull() & ~_is(found, "OBJECT", "ARRAY", "VOID"), F.try_variant_get(found, "$", "string"))


_STEP = re.compile(r"""\.([A-Za-z_]\w*)|\[(\d+)\]|\["([^"]*)"\]|\['([^']*)'\]|\."([^"]*)\"""")


def steps(path: str) -> list[str | int]:
    """The keys and places of a path."""
    out: list[str | int] = []
    at = 1
    while at < len(path):
        found = _STEP.match(path, at)
        if path[0] != "$" or found is None:
            raise ValueError(f"{path} isn't a JSON path")
        key = next(g for g in found.groups() if g is not None)
        out.append(int(key) if found.group(2) else key)
        at = found.end()
    return out


def _members(text: Column) -> Column:
    """A map of an object's members, as JSON texts."""
    return F.transform_values(F.try_variant_get(_variant(text), "$", "map<string,variant>"), lambda k, v: F.to_json(v))


def _elements(text: Column) -> Column:
    return F.transform(F.try_variant_get(_variant(text), "$", "array<variant>"), lambda v: F.to_json(v))


def _object(members: Column) -> Column:
    return F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(members), lambda e: F.concat(_text(e["key"]), F.lit(":"), e["value"])), ","), F.lit("}"))


def _array(parts: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(parts, ","), F.lit("]"))


def _changed(text: Column, path: list, change, create: bool) -> Column:
    """The JSON text with the value at the path replaced by change(old text or null); null means: take it out."""
    if not path:
        return change(text)
    step, found = path[0], _variant(text)
    if isinstance(step, str):
        members = F.coalesce(_members(text), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
        inner = F.get(F.transform(F.filter(F.map_entries(members), lambda e: e["key"] == step), lambda e: e["value"]), F.lit(0))
        new = _changed(inner, path[1:], change, create)
        others = F.map_filter(members, lambda k, v: k != step)
        # a member keeps its place; a new one comes last
        entries = F.map_entries(members)
        kept = F.transform(F.filter(entries, lambda e: (e["key"] != step) | new.isNotNull()), lambda e: F.struct(e["key"].alias("key"), F.when(e["key"] == step, new).otherwise(e["value"]).alias("value")))
        added = F.concat(kept, F.array(F.struct(F.lit(step).alias("key"), new.alias("value"))))
        has = F.exists(entries, lambda e: e["key"] == step)
        whole = F.when(has, _object(F.map_from_entries(kept))).when(F.lit(create) & new.isNotNull(), _object(F.map_from_entries(added))).otherwise(_object(others))
        fits = _is(found, "OBJECT") | (F.lit(create) & (text.isNull() | _is(found, "VOID")))
        return F.when(fits, whole).otherwise(text)
    parts = F.coalesce(_elements(text), F.array().cast("array<string>"))
    inner = F.get(parts, F.lit(step))
    new = _changed(inner, path[1:], change, create)
    replaced = F.transform(parts, lambda p, i: F.when(i == step, new).otherwise(p))
    longer = F.concat(parts, F.array_repeat(F.lit("null"), F.greatest(F.lit(step) - F.size(parts), F.lit(0))), F.array(new))
    whole = F.when(F.size(parts) > step, _array(F.filter(replaced, lambda p: p.isNotNull()))).when(F.lit(create) & new.isNotNull(), _array(longer)).otherwise(text)
    fits = _is(found, "ARRAY") | (F.lit(create) & (text.isNull() | _is(found, "VOID")))
    return F.when(fits, whole).otherwise(text)


@function
def json_set(x, path: str, value, create_if_missing: bool = True):
    """The JSON text with a value put at a path; what the path lacks is made, where it can be."""
    new = _text(value)
    change = (lambda old: new) if create_if_missing else (lambda old: F.when(old.isNotNull(), new))
    return _changed(col(x), steps(path), change, create_if_missing)


@function
def json_remove(x, path: str):
    """The JSON text without the member or element at a path."""
    return _changed(col(x), steps(path), lambda old: F.lit(None).cast("string"), False)


@function
def json_array_append(x, path: str, value, each_value: bool = True):
    """The JSON text with a value appended to the array at a path; an array value gives its elements."""
    return _spliced(x, path, None, value, each_value)


@function
def json_array_insert(x, path: str, value, each_value: bool = True):
    """The JSON text with a value inserted before the element that the path names."""
    *whole, place = steps(path)
    if not isinstance(place, int):
        raise ValueError(f"{path} doesn't name an element")
    return _spliced(x, "$" + "".join(f"[{k}]" if isinstance(k, int) else f'["{k}"]' for k in whole), place, value, each_value)


def _spliced(x, path: str, place: int | None, value, each_value: bool) -> Column:
    new = _text(value)
    parts = F.when(_is(_variant(new), "ARRAY"), _elements(new)).otherwise(F.array(new)) if each_value else F.array(new)

    def change(old: Column) -> Column:
        own = _elements(old)
        at = F.size(own) if place is None else F.lit(place)
        filled = F.concat(own, F.array_repeat(F.lit("null"), F.greatest(at - F.size(own), F.lit(0))))
        rest = F.when(F.size(filled) > at, F.slice(filled, at + 1, F.greatest(F.size(filled) - at, F.lit(1)))).otherwise(F.array().cast("array<string>"))
        first = F.when(at > 0, F.slice(filled, 1, F.greatest(at, F.lit(1)))).otherwise(F.array().cast("array<string>"))
        made = _array(F.concat(first, parts, rest))
        return F.when(_is(_variant(old), "ARRAY"), made).when(_is(_variant(old), "VOID"), _array(parts)).otherwise(old)

    return _changed(col(x), steps(path), change, False)


@function
def json_strip_nulls(x, include_arrays: bool = True, remove_empty: bool = False, depth: int = 4):
    """The JSON text without nulls, and if wanted without what that leaves empty; down to `depth` levels."""

    def strip(text: Column, left: int) -> Column:
        found = _variant(text)
        if not left:
            return text
        bare = lambda t: F.when(t == "null", None).when(F.lit(remove_empty) & t.isin("{}", "[]"), None).otherwise(t)
        members = F.transform_values(_members(text), lambda k, v: bare(strip(v, left - 1)))
        parts = F.transform(_elements(text), lambda v: strip(v, left - 1))
        parts = F.filter(F.transform(parts, bare), lambda v: v.isNotNull()) if include_arrays else parts
        return F.when(_is(found, "OBJECT"), _object(F.map_filter(members, lambda k, v: v.isNotNull()))).when(_is(found, "ARRAY"), _array(parts)).otherwise(text)

    return strip(col(x), depth)


@function
def json_flatten(x):
    """The elements of an array and of the arrays in it, as JSON texts; of another value the value itself."""
    found = _variant(x)
    nested = F.transform(_elements(col(x)), lambda p: F.when(_is(_variant(p), "ARRAY"), _elements(p)).otherwise(F.array(p)))
    return F.when(_is(found, "ARRAY"), F.flatten(nested)).when(found.isNotNull(), F.array(col(x)))


@function
def json_subscript(x, key):
    """x[key] of a JSON text, as JSON text: a member by name, an element by place; null where there is none."""
    found = F.try_variant_get(_variant(x), f"$[{key}]" if isinstance(key, int) else f"$['{key}']", "variant")
    return F.to_json(found)
