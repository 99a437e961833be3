"""Listings of records: filter expressions, flattening, projections with transforms, and text formats.

A filter compares keys (paths into structs, arrays by place) with texts: = != : (a prefix with a star, else a part, in any
case; of an array, of some element) ~ (a regular expression), < <= > >= (as numbers, or as times with a duration such as
-P7D before now), joined by AND, OR, NOT and parentheses. Missing values match nothing but !=.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

_TOKEN = re.compile(r"""\s*(\(|\)|"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|!=|<=|>=|[=<>:~]|[^\s()=<>:~!"']+)""")
_DURATION = re.compile(r"(-?)P(?:(\d+)W)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?)?")
# The escape codes of colours.
COLOURS = {"black": 30, "red": 31, "green": 32, "yellow": 33, "blue": 34, "magenta": 35, "cyan": 36, "white": 37}


def _member(name: str):
    return lambda x: x[name]


def _key(df: DataFrame, path: str) -> tuple[Column, bool]:
    """The column of a path, and whether it is an array."""
    kind, column = df.schema, None
    for name, place in re.findall(r"([^.\[\]]+)(?:\[(\d*)\])?", path):
        if isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType):
            kind = kind.elementType
            column, kind = F.transform(column, _member(name)), ArrayType(kind[name].dataType)
        else:
            column = F.col(f"`{name}`") if column is None else column[name]
            kind = kind[name].dataType
        if place:
            column, kind = F.get(column, F.lit(int(place))), kind.elementType
    return column, isinstance(kind, ArrayType)


def _moment(text: str, now: Column) -> Column | None:
    """A duration as the moment that far from now."""
    found = _DURATION.fullmatch(text)
    if not found or not any(found.groups()[1:]):
        return None
    sign = -1 if found[1] else 1
    weeks, days, hours, minutes, seconds = (int(g or 0) for g in found.groups()[1:])
    return now + F.make_dt_interval(F.lit(sign * (7 * weeks + days)), F.lit(sign * hours), F.lit(sign * minutes), F.lit(sign * seconds))


def _term(df: DataFrame, path: str, operator: str, text: str, now: Column) -> Column:
    column, many = _key(df, path)
    if many:
        return F.coalesce(F.exists(column, lambda x: F.coalesce(_compared(x, operator, text, now), F.lit(False))), F.lit(False))
    return _compared(column, operator, text, now)


def _compared(column: Column, operator: str, text: str, now: Column) -> Column:
    value = column.cast("string")
    if operator in "=":
        return F.coalesce(value == text, F.lit(False))
    if operator == "!=":
        return F.coalesce(value != text, F.lit(True))
    if operator == ":":
        wanted = text.lower()
        return F.coalesce(F.startswith(F.lower(value), F.lit(wanted[:-1])) if wanted.endswith("*") else F.contains(F.lower(value), F.lit(wanted)), F.lit(False))
    if operator == "~":
        return F.coalesce(value.rlike(text), F.lit(False))
    moment = _moment(text, now)
    left, right = (column.cast("timestamp"), moment) if moment is not None else (value.try_cast("double"), F.lit(text).try_cast("double"))
    return F.coalesce({"<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[operator], F.lit(False))


def where(df: DataFrame, expression: str, now: Column | None = None) -> DataFrame:
    """The rows that a filter expression matches; all for an empty one."""
    parts, at, now = [], 0, F.current_timestamp() if now is None else now
    while expression[at:].strip():
        found = _TOKEN.match(expression, at)
        if not found:
            raise ValueError(f"{expression[at:]} isn't a filter")
        parts.append(found[1])
        at = found.end()
    if not parts:
        return df
    place = 0

    def take() -> str:
        nonlocal place
        if place >= len(parts):
            raise ValueError(f"{expression} ends too early")
        place += 1
        return parts[place - 1]

    def either() -> Column:
        nonlocal place
        found = both()
        while place < len(parts) and parts[place] == "OR":
            place += 1
            found = found | both()
        return found

    def both() -> Column:
        nonlocal place
        found = single()
        while place < len(parts) and parts[place] != "OR" and parts[place] != ")":
            place += parts[place] == "AND"
            found = found & single()
        return found

    def single() -> Column:
        part = take()
        if part == "NOT":
            return ~single()
        if part == "(":
            found = either()
            if take() != ")":
                raise ValueError(f"{expression} lacks a parenthesis")
            return found
        operator, text = take(), take()
        if operator not in ("=", "!=", ":", "~", "<", "<=", ">", ">="):
            raise ValueError(f"there is no operator {operator}")
        return _term(df, part, operator, ast.literal_eval(text) if text[0] in "\"'" else text, now)

    found = either()
    if place < len(parts):
        raise ValueError(f"{expression} has something after its end")
    return df.filter(found)


def build_filter(terms: dict[str, str]) -> str:
    """key=value terms, key:value where the value has a star, joined by AND."""
    return " AND ".join(f"{k}:{v}" if "*" in v else f"{k}={v}" for k, v in terms.items())


def flatten(df: DataFrame, path: str) -> DataFrame:
    """A row for each element of the array at a path such as "bindings[].members"; the element takes the array's place."""
    names = [n for n in re.split(r"\.|\[\]\.?", path) if n]

    def placed(column: Column, kind, left: list[str], value: Column) -> Column:
        if not left:
            return value
        return F.struct(*((placed(column[f.name], f.dataType, left[1:], value) if f.name == left[0] else column[f.name]).alias(f.name) for f in kind))

    done: list[str] = []
    for name in names:
        done.append(name)
        column, kind = F.col(f"`{done[0]}`"), df.schema[done[0]].dataType
        for n in done[1:]:
            column, kind = column[n], kind[n].dataType
        if isinstance(kind, ArrayType):
            df = df.withColumn("__element", F.explode_outer(column))
            df = df.withColumn(done[0], placed(F.col(f"`{done[0]}`"), df.schema[done[0]].dataType, done[1:], F.col("__element"))).drop("__element")
    return df


# transforms


def basename(x: Column) -> Column:
    """What follows the last slash."""
    return F.element_at(F.split(x, "/"), -1)


def segment(x: Column, place: int = 0) -> Column:
    return F.get(F.split(x, "/"), F.lit(place))


def date(x: Column, format: str = "%Y-%m-%dT%H:%M:%S") -> Column:  # noqa: A002
    from lodestone.functions.library import pattern_of

    return F.date_format(x.cast("timestamp"), pattern_of(format))


def yesno(x: Column, yes: str = "Yes", no: str = "No") -> Column:
    return F.when(x.cast("string").isin("true", "True", "TRUE", "1"), yes).otherwise(no)


def color(x: Column, **values: str) -> Column:
    """Text in the colour under which its value is named."""
    found = x
    for name, value in values.items():
        found = F.when(x == value, F.concat(F.lit(f"\x1b[{COLOURS[name]}m"), x, F.lit("\x1b[39m"))).otherwise(found)
    return found


TRANSFORMS = {"basename": basename, "segment": segment, "date": date, "yesno": yesno, "color": color}


@dataclass(frozen=True)
class Shown:
    label: str
    column: Column
    sort: int
    align: str


_CALL = re.compile(r"\.(\w+)\(([^()]*)\)")


def shown(df: DataFrame, text: str) -> Shown:
    """One key of a projection: path, transforms, then :label=, :sort=, :align=."""
    body, *attributes = re.split(r":(?=label=|sort=|align=)", text.strip())
    given = dict(a.split("=", 1) for a in attributes)
    path = _CALL.split(body)[0]
    column = _key(df, path)[0]
    for name, arguments in _CALL.findall(body):
        if name not in TRANSFORMS:
            raise ValueError(f"there is no transform {name}")
        values = [a.strip() for a in arguments.split(",") if a.strip()]
        bare = lambda v: ast.literal_eval(v) if re.fullmatch(r"-?\d+|'.*'|\".*\"", v) else v
        named = dict(v.split("=", 1) for v in values if re.match(r"\w+=", v))
        column = TRANSFORMS[name](column, *(bare(v) for v in values if not re.match(r"\w+=", v)), **{k: bare(v.strip()) for k, v in named.items()})
    if given.get("align", "left") not in ("left", "center", "right"):
        raise ValueError(f"there is no alignment {given['align']}")
    return Shown(given.get("label", re.split(r"[.\[]", path)[-1].upper() or path), column, int(given.get("sort", 0)), given.get("align", "left"))


def project(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys as columns by their labels, in the order of their sort numbers; negative ones fall."""
    made = [shown(df, k) for k in keys]
    order = sorted((m for m in made if m.sort), key=lambda m: abs(m.sort))
    rows = df.orderBy(*(F.desc_nulls_last(m.column) if m.sort < 0 else F.asc_nulls_last(m.column) for m in order)) if order else df
    return rows.select(*(m.column.alias(m.label) for m in made))


def _cell(column: Column, name: str) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def lines(df: DataFrame, kind: str, align: Sequence[str] = ()) -> DataFrame:
    """Rows as texts (line): json, yaml, csv, value or table; the first of a csv or table is in the column `header`.

    A table's columns are as wide as their longest text, which one aggregation finds.
    """
    names = df.columns
    cells = [_cell(F.col(f"`{n}`"), n) for n in names]
    if kind == "json":
        return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("line"), F.lit(None).cast("string").alias("header"))
    if kind == "yaml":
        each = [F.concat(F.lit(("- " if i == 0 else "  ") + f"{n}: "), F.coalesce(F.col(f"`{n}`").cast("string"), F.lit("null"))) for i, n in enumerate(names)]
        return df.select(F.concat_ws("\n", *each).alias("line"), F.lit(None).cast("string").alias("header"))
    if kind == "value":
        return df.select(F.concat_ws("\t", *cells).alias("line"), F.lit(None).cast("string").alias("header"))
    if kind == "csv":
        quoted = [F.when(c.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c) for c in cells]
        return df.select(F.concat_ws(",", *quoted).alias("line"), F.lit(",".join(names)).alias("header"))
    if kind != "table":
        raise ValueError(f"there is no format {kind}")
    longest = df.agg(*(F.max(F.char_length(c)).alias(f"w{i}") for i, c in enumerate(cells))).first()
    widths = [max(len(n), longest[f"w{i}"] or 0) for i, n in enumerate(names)]
    ways = [*align, *["left"] * (len(names) - len(align))]

    def padded(c: Column, width: int, way: str) -> Column:
        if way == "center":
            return F.rpad(F.lpad(c, (F.char_length(c) + F.floor((width - F.char_length(c)) / 2)).cast("int"), F.lit(" ")), F.lit(width), F.lit(" "))
        return F.lpad(c, F.lit(width), F.lit(" ")) if way == "right" else F.rpad(c, F.lit(width), F.lit(" "))

    head = "  ".join({"left": n.ljust, "right": n.rjust, "center": n.center}[way](w) for n, w, way in zip(names, widths, ways))
    return df.select(F.rtrim(F.concat_ws("  ", *(padded(c, w, way) for c, w, way in zip(cells, widths, ways)))).alias("line"), F.lit(head.rstrip()).alias("header"))
