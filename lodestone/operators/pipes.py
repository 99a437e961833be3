"""Pipe steps that Spark's own pipe syntax lacks: RENAME, DISTINCT and CALL; all others are passed on to it."""

from __future__ import annotations

import ast
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Function = Callable[..., DataFrame]


def steps(text: str) -> list[str]:
    """The parts between |>, but for those in parentheses and quotes."""
    out, depth, quote, at = [], 0, "", 0
    for i, char in enumerate(text):
        if quote:
            quote = "" if char == quote else quote
        elif char in "'\"`":
            quote = char
        elif char in "()":
            depth += 1 if char == "(" else -1
        elif text.startswith("|>", i) and not depth:
            out.append(text[at:i].strip())
            at = i + 2
    return [*out, text[at:].strip()]


def _own(step: str, functions: dict[str, Function]) -> Function | None:
    """The step as a function of a DataFrame; None if Spark knows it."""
    word, _, rest = step.partition(" ")
    if word.upper() == "DISTINCT" and not rest:
        return DataFrame.distinct
    if word.upper() == "RENAME":
        names = dict(re.fullmatch(r"\s*`?(\w+)`?\s+(?:AS\s+)?`?(\w+)`?\s*", part, re.I).groups() for part in rest.split(","))
        return lambda df: df.withColumnsRenamed(_known(df, names))
    if word.upper() == "CALL":
        name, arguments = re.fullmatch(r"\s*(\w+)\s*\((.*)\)\s*", rest, re.S).groups()
        if name not in functions:
            raise KeyError(f"there is no table function {name}")
        values = ast.literal_eval(f"({arguments},)") if arguments.strip() else ()
        return lambda df: functions[name](df, *values)
    return None


def _known(df: DataFrame, names: dict[str, str]) -> dict[str, str]:
    if missing := names.keys() - set(df.columns):
        raise KeyError(f"there is no column {', '.join(sorted(missing))}")
    return names


def run(spark: SparkSession, text: str, functions: dict[str, Function] | None = None) -> DataFrame:
    """The pipe's result; functions: those that CALL may name. Arguments are literals."""
    first, *more = steps(text)
    pending, df = [first], None

    def plain() -> DataFrame:
        if df is None:
            return spark.sql(" |> ".join(pending))
        if not pending:
            return df
        view = f"pipe_{uuid.uuid4().hex}"
        df.createOrReplaceTempView(view)
        try:
            return spark.sql(" |> ".join([f"FROM {view}", *pending]))
        finally:
            spark.catalog.dropTempView(view)

    for step in more:
        if (own := _own(step, functions or {})) is None:
            pending.append(step)
        else:
            df = own(plain())
            pending = []
    return plain()
