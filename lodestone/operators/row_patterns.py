"""Row pattern recognition: a pattern over row symbols, matched in order within partitions.

Patterns: symbols, concatenation by blanks, | for alternatives, parentheses, and the quantifiers * + ? {m} {m,} {m,n},
reluctant with a further ?. Where several matches start at a row, the preferred one wins: earlier alternatives, and
more rows for greedy quantifiers. Symbols are boolean columns, made beforehand by lag and lead where they look around.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from lodestone.session import let_workers_import

_TOKEN = re.compile(r"\s*(?:([A-Za-z_]\w*)|(\{\d+(?:,\d*)?\}|[*+?])(\??)|([()|]))")


def parse(pattern: str):
    """The syntax tree: ("symbol", s), ("then", parts), ("or", parts), ("repeat", part, least, most, greedy)."""
    tokens, at = [], 0
    pattern = pattern.strip()
    while at < len(pattern):
        if not (m := _TOKEN.match(pattern, at)):
            raise ValueError(f"can't read {pattern[at:]!r}")
        tokens.append(m)
        at = m.end()
    spot = 0

    def either():
        nonlocal spot
        parts = [sequence()]
        while spot < len(tokens) and tokens[spot][4] == "|":
            spot += 1
            parts.append(sequence())
        return parts[0] if len(parts) == 1 else ("or", parts)

    def sequence():
        nonlocal spot
        parts = []
        while spot < len(tokens) and tokens[spot][4] not in ("|", ")"):
            m = tokens[spot]
            spot += 1
            if m[1]:
                node = ("symbol", m[1])
            elif m[4] == "(":
                node = either()
                if spot == len(tokens):
                    raise ValueError("a parenthesis isn't closed")
                spot += 1
            else:
                raise ValueError("a quantifier has nothing before it")
            if spot < len(tokens) and tokens[spot][2]:
                q, lazy = tokens[spot][2], tokens[spot][3]
                spot += 1
                low, _, high = q.strip("{}").partition(",")
                least, most = {"*": (0, None), "+": (1, None), "?": (0, 1)}.get(q) or (int(low), int(high) if high else (int(low) if "," not in q else None))
                node = ("repeat", node, least, most, not lazy)
            parts.append(node)
        return ("then", parts)

    tree = either()
    if spot < len(tokens):
        raise ValueError("a parenthesis is too much")
    return tree


def program(tree) -> list[tuple]:
    """Instructions: ("row", symbol), ("split", first, second) by preference, ("jump", to), ("match",)."""
    code: list[tuple] = []

    def emit(node):
        kind = node[0]
        if kind == "symbol":
            code.append(("row", node[1]))
        elif kind == "then":
            for part in node[1]:
                emit(part)
        elif kind == "or":
            ends = []
            for part in node[1][:-1]:
                fork = len(code)
                code.append(())
                emit(part)
                ends.append(len(code))
                code.append(())
                code[fork] = ("split", fork + 1, len(code))
            emit(node[1][-1])
            for end in ends:
                code[end] = ("jump", len(code))
        else:
            _, part, least, most, greedy = node
            for _ in range(least):
                emit(part)
            fork_to = lambda fork, out: ("split", fork + 1, out) if greedy else ("split", out, fork + 1)
            if most is None:
                fork = len(code)
                code.append(())
                emit(part)
                code.append(("jump", fork))
                code[fork] = fork_to(fork, len(code))
            else:
                forks = []
                for _ in range(most - least):
                    forks.append(len(code))
                    code.append(())
                    emit(part)
                for fork in forks:
                    code[fork] = fork_to(fork, len(code))

    emit(tree)
    return [*code, ("match",)]


def match_at(code: list[tuple], rows: Sequence[dict[str, bool]], start: int) -> list[str] | None:
    """The symbols of the preferred match that starts at a row; None if there is none."""

    def follow(pc: int, taken, into: list, seen: set) -> None:
        todo = [pc]
        while todo:
            pc = todo.pop()
            if pc in seen:
                continue
            seen.add(pc)
            op = code[pc]
            if op[0] == "split":
                todo += [op[2], op[1]]
            elif op[0] == "jump":
                todo.append(op[1])
            else:
                into.append((pc, taken))

    threads: list = []
    follow(0, None, threads, set())
    best, at = None, start
    while threads:
        following: list = []
        seen: set = set()
        for pc, taken in threads:
            op = code[pc]
            if op[0] == "match":
                # what comes after is less preferred
                best = taken
                found = True
                break
            if at < len(rows) and rows[at].get(op[1]):
                follow(pc + 1, (op[1], taken), following, seen)
        else:
            found = False
        if not found and not following:
            break
        threads, at = following, at + 1
    symbols = []
    while best is not None:
        symbols.append(best[0])
        best = best[1]
    return symbols[::-1] or None


def match_recognize(df: DataFrame, partition_by: Sequence[str], order_by: Sequence[str], define: dict[str, Column], pattern: str, to_next_row: bool = False) -> DataFrame:
    """The matched rows with match_number, match_row_number and classifier; measures are aggregates over match_number.

    Empty matches give no rows. A match needs its partition in order, so each partition is one task's work.
    """
    code, columns = program(parse(pattern)), df.columns
    unknown = {op[1] for op in code if op[0] == "row"} - define.keys()
    if unknown:
        raise ValueError(f"{unknown.pop()} isn't defined")
    marks, symbols = {f"__is_{s}": c.cast("boolean") for s, c in define.items()}, list(define)
    extra = [StructField("match_number", LongType()), StructField("match_row_number", IntegerType()), StructField("classifier", StringType())]
    schema = StructType([*df.schema.fields, *extra])
    fields = to_arrow_schema(schema)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in order_by])
        flags = {s: table.column(f"__is_{s}").to_pylist() for s in symbols}
        rows = [{s: v[i] for s, v in flags.items()} for i in range(table.num_rows)]
        picked, numbers, places, taken, start, number = [], [], [], [], 0, 0
        while start < len(rows):
            found = match_at(code, rows, start)
            if found:
                number += 1
                picked += range(start, start + len(found))
                numbers += [number] * len(found)
                places += range(1, len(found) + 1)
                taken += found
            start += len(found) if found and not to_next_row else 1
        out = table.select(columns).take(pa.array(picked, pa.int64()))
        for name, values, kind in (("match_number", numbers, pa.int64()), ("match_row_number", places, pa.int32()), ("classifier", taken, pa.string())):
            out = out.append_column(name, pa.array(values, kind))
        return out.cast(fields)

    let_workers_import(df.sparkSession)
    return df.withColumns(marks).groupBy(*partition_by).applyInArrow(run, schema)
