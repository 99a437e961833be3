"""Relational operators that Spark has no single call for, as compositions of DataFrame operations."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def qualify(df: DataFrame, columns: dict[str, Column], predicate: Column) -> DataFrame:
    """Rows whose window expressions (by name) meet the predicate; the expressions don't stay."""
    kept = df.columns
    return df.withColumns(columns).filter(predicate).select(*kept)


def select_except(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"there is no column {missing[0]}")
    return df.drop(*names)


def select_replace(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Columns replaced in place."""
    missing = [n for n in columns if n not in df.columns]
    if missing:
        raise ValueError(f"there is no column {missing[0]}")
    return df.select(*(columns[n].alias(n) if n in columns else F.col(n) for n in df.columns))


def pivot_name(value, prefix: str = "") -> str:
    """The column of a pivoted value: numbers are spelled with _, minus_ and _point_, NULL is NULL."""
    if value is None:
        text = "NULL"
    elif isinstance(value, bool):
        text = str(value).upper()
    elif isinstance(value, (int, float)):
        text = ("minus_" if value < 0 else "_") + str(abs(value)).replace(".", "_point_")
    else:
        text = re.sub(r"\W", "_", str(value))
        text = f"_{text}" if text[:1].isdigit() else text
    return f"{prefix}_{text.lstrip('_') if prefix and text.startswith('_') else text}" if prefix else text


def pivot(df: DataFrame, aggregates: dict[str, Column], by: str, values: Sequence, aliases: dict | None = None) -> DataFrame:
    """Rows to columns. All columns that neither `by` nor an aggregate uses are keys; the values are constants.

    One aggregate may have an empty prefix. Each cell is a conditional aggregate, so one pass and one shuffle do.
    """
    used = {by}
    for made in aggregates.values():
        used |= set(re.findall(r"\w+", str(made)))
    keys = [c for c in df.columns if c not in used]
    cells = []
    for value in values:
        match = F.col(by).eqNullSafe(F.lit(value))
        for prefix, made in aggregates.items():
            label = (aliases or {}).get(value)
            cells.append((f"{prefix}_{label}" if prefix and label else label or pivot_name(value, prefix), made, match))
    grouped = df.groupBy(*keys, by).agg(*(m.alias(f"__{p}") for p, m in aggregates.items()))
    out = grouped.groupBy(*keys).agg(*(F.max(F.when(match, F.col(f"__{p}"))).alias(name) for (name, _, match), p in zip(cells, list(aggregates) * len(values))))
    return out


def unpivot(df: DataFrame, columns: dict[str, str] | Sequence[str], name: str, value: str, include_nulls: bool = False) -> DataFrame:
    """Columns to rows; columns may be given with the labels they get. Rows without a value go, unless included."""
    labels = columns if isinstance(columns, dict) else {c: c for c in columns}
    kept = [c for c in df.columns if c not in labels]
    parts = F.array(*(F.struct(F.lit(label).alias(name), F.col(c).alias(value)) for c, label in labels.items()))
    out = df.select(*kept, F.explode(parts).alias("__cell")).select(*kept, f"__cell.{name}", f"__cell.{value}")
    return out if include_nulls else out.filter(F.col(value).isNotNull())


def multi_level(df: DataFrame, keys: Sequence[str], inner_keys: Sequence[str], inner: dict[str, Column], outer: dict[str, Column], having: Column | None = None) -> DataFrame:
    """Aggregates of aggregates: `inner` by keys + inner_keys, then `outer` over the results by keys."""
    grouped = df.groupBy(*keys, *inner_keys).agg(*(c.alias(n) for n, c in inner.items()))
    grouped = grouped if having is None else grouped.filter(having)
    return grouped.groupBy(*keys).agg(*(c.alias(n) for n, c in outer.items()))


def having_extreme(df: DataFrame, keys: Sequence[str], by: str, aggregates: dict[str, Column], greatest: bool = True) -> DataFrame:
    """Aggregates over the rows of each group at the greatest (or least) value of `by`; all ties count.

    The extreme is a pre-aggregated group joined back, so a large group isn't buffered as a window would.
    """
    best = df.groupBy(*keys).agg((F.max if greatest else F.min)(by).alias("__best"))
    match = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys] + [F.col(f"l.{by}") == F.col("r.__best")]
    rows = df.alias("l").join(best.alias("r"), reduce(Column.__and__, match)).select("l.*")
    return rows.groupBy(*keys).agg(*(c.alias(n) for n, c in aggregates.items()))


def aggregation_threshold(df: DataFrame, keys: Sequence[str], unit: str, least: int, aggregates: dict[str, Column]) -> DataFrame:
    """Groups with under `least` different privacy units are dropped."""
    out = df.groupBy(*keys).agg(F.count_distinct(unit).alias("__units"), *(c.alias(n) for n, c in aggregates.items()))
    return out.filter(F.col("__units") >= least).drop("__units")


@dataclass(frozen=True)
class When:
    """A clause of merge().

    kind: "matched", "not matched" (by target) or "not matched by source"; action: "update", "insert" or "delete";
    values: new values by column, over the aliases t and s; condition: over the same.
    """

    kind: str
    action: str
    values: dict[str, Column] | None = None
    condition: Column | None = None


def merge(target: DataFrame, source: DataFrame, on: Column, clauses: Sequence[When]) -> DataFrame:
    """The target after a MERGE; `on` and the clauses speak of t.column and s.column.

    For each row the first clause that fits acts. A target row that several source rows update or delete is an error.
    With no clause for a side, the join leaves that side's unmatched rows out of its work.
    """
    t = target.withColumn("__t", F.monotonically_increasing_id()).alias("t")
    s = source.withColumn("__s", F.lit(True)).alias("s")
    how = "full" if any(c.kind == "not matched" for c in clauses) else "left"
    both = t.join(s, on, how)
    fits = {"matched": F.col("t.__t").isNotNull() & F.col("s.__s").isNotNull(), "not matched": F.col("t.__t").isNull(), "not matched by source": F.col("s.__s").isNull()}
    number = F.lit(-1)
    for i, clause in reversed(list(enumerate(clauses))):
        test = fits[clause.kind]
        test = test if clause.condition is None else test & F.coalesce(clause.condition, F.lit(False))
        number = F.when(test, i).otherwise(number)
    both = both.withColumn("__clause", number)
    names = target.columns
    new = []
    for name in names:
        value = F.col(f"t.{name}")
        for i, clause in reversed(list(enumerate(clauses))):
            if clause.action != "delete" and name in (clause.values or {}):
                value = F.when(F.col("__clause") == i, clause.values[name].cast(target.schema[name].dataType)).otherwise(value)
            elif clause.action == "insert":
                value = F.when(F.col("__clause") == i, F.lit(None).cast(target.schema[name].dataType)).otherwise(value)
        new.append(value.alias(name))
    deleted = reduce(Column.__or__, (F.col("__clause") == i for i, c in enumerate(clauses) if c.action == "delete"), F.lit(False))
    # source rows that nothing inserts have no row in the result
    kept = both.filter(~deleted & (F.col("t.__t").isNotNull() | (F.col("__clause") >= 0)))
    rows = kept.select(*new, F.col("t.__t").alias("__t"), (F.col("__clause") >= 0).alias("__acted"))
    window = Window.partitionBy("__t")
    acted = F.sum(F.col("__acted").cast("int")).over(window)
    old = rows.filter(F.col("__t").isNotNull()).withColumn("__n", acted).withColumn("__k", F.row_number().over(window.orderBy(F.desc("__acted"))))
    checked = F.when(F.col("__n") > 1, F.raise_error(F.lit("several source rows act on one target row"))).otherwise(F.col("__k"))
    old = old.filter(checked == 1)
    return old.select(*names).unionByName(rows.filter(F.col("__t").isNull()).select(*names))


def as_of_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, columns: Sequence[str], direction: str = "backward") -> DataFrame:
    """left with the columns of right's latest row of the same keys at or before its time (or the first at or after).

    Both sides are united and swept once by a window over the keys: one shuffle and a sort, no pairs.
    """
    backward = direction == "backward"
    values = F.struct(*(F.col(c) for c in columns))
    one = left.select(*keys, F.col(left_time).alias("__time"), F.lit(1 if backward else 0).alias("__side"), F.struct(*left.columns).alias("__left"), F.lit(None).cast(right.select(values.alias("v")).schema["v"].dataType).alias("__right"))
    two = right.select(*keys, F.col(right_time).alias("__time"), F.lit(0 if backward else 1).alias("__side"), F.lit(None).cast(one.schema["__left"].dataType).alias("__left"), values.alias("__right"))
    window = Window.partitionBy(*keys).orderBy("__time", "__side")
    window = window.rowsBetween(Window.unboundedPreceding, 0) if backward else window.rowsBetween(0, Window.unboundedFollowing)
    found = (F.last if backward else F.first)("__right", ignorenulls=True).over(window)
    both = one.unionByName(two).withColumn("__found", found).filter(F.col("__left").isNotNull())
    return both.select("__left.*", *(F.col(f"__found.{c}").alias(c) for c in columns))


def range_join(left: DataFrame, right: DataFrame, left_range: tuple[str, str], right_range: tuple[str, str], width: int, keys: Sequence[str] = ()) -> DataFrame:
    """Pairs whose half-open integer ranges overlap. Ranges are dealt to buckets of `width`, and a pair is made in the
    first bucket that both are in, so that no pair comes twice. Columns of the two sides must differ but for keys."""
    (a, b), (c, d) = left_range, right_range
    spread = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor((F.col(hi) - 1) / width)))
    one = left.filter(F.col(a) < F.col(b)).withColumn("__bucket", spread(a, b))
    two = right.filter(F.col(c) < F.col(d)).withColumn("__bucket", spread(c, d))
    pairs = one.join(two, ["__bucket", *keys]).filter((F.col(a) < F.col(d)) & (F.col(c) < F.col(b)))
    return pairs.filter(F.col("__bucket") == F.floor(F.greatest(a, c) / width)).drop("__bucket")


def sessionize(df: DataFrame, keys: Sequence[str], start: str, end: str, meets: bool = True) -> DataFrame:
    """Adds session_start and session_end: ranges of the same keys that touch (or, without meets, overlap) are one."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.col(start) > reach if meets else F.col(start) >= reach
    numbered = df.withColumn("__new", F.coalesce(apart, F.lit(True)).cast("int"))
    numbered = numbered.withColumn("__session", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy(*keys, "__session")
    out = numbered.withColumn("session_start", F.min(start).over(whole)).withColumn("session_end", F.max(end).over(whole))
    return out.drop("__new", "__session")


def gap_fill(df: DataFrame, time: str, micros: int, keys: Sequence[str], values: dict[str, str], origin: str = "1950-01-01 00:00:00") -> DataFrame:
    """A row for each bucket boundary from the first at or after a key's first point to the last at or before its last.

    values: column to "null" (only from a point exactly there), "locf" (the last point at or before) or "linear"
    (between the points around, by time).
    """
    zero = F.unix_micros(F.to_timestamp(F.lit(origin)))
    at = F.unix_micros(F.col(time).cast("timestamp"))
    points = df.select(*keys, at.alias("__at"), *values).filter(F.col("__at").isNotNull())
    ends = points.groupBy(*keys).agg(F.min("__at").alias("__a"), F.max("__at").alias("__b"))
    first = F.ceil((F.col("__a") - zero) / micros) * micros + zero
    last = F.floor((F.col("__b") - zero) / micros) * micros + zero
    grid = ends.filter(first <= last).select(*keys, F.explode(F.sequence(first, last, F.lit(micros).cast("long"))).alias("__at"))
    marked = points.select(*keys, "__at", F.lit(0).alias("__grid"), F.struct("__at", *values).alias("__point"))
    none = F.lit(None).cast(marked.schema["__point"].dataType)
    both = marked.unionByName(grid.select(*keys, "__at", F.lit(1).alias("__grid"), none.alias("__point")))
    back = Window.partitionBy(*keys).orderBy("__at", "__grid").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys).orderBy("__at", F.desc("__grid")).rowsBetween(0, Window.unboundedFollowing)
    swept = both.withColumn("__prev", F.last("__point", ignorenulls=True).over(back)).withColumn("__next", F.first("__point", ignorenulls=True).over(ahead)).filter("__grid = 1")
    made = []
    for name, how in values.items():
        a, b = F.col(f"__prev.{name}"), F.col(f"__next.{name}")
        if how == "null":
            made.append(F.when(F.col("__prev.__at") == F.col("__at"), a).alias(name))
        elif how == "locf":
            made.append(a.alias(name))
        elif how == "linear":
            share = (F.col("__at") - F.col("__prev.__at")) / (F.col("__next.__at") - F.col("__prev.__at"))
            made.append(F.when(F.col("__prev.__at") == F.col("__at"), a.cast("double")).otherwise(a + (b - a) * share).alias(name))
        else:
            raise ValueError(f"there is no way {how} to fill a gap")
    return swept.select(*keys, F.timestamp_micros("__at").alias(time), *made)


def changes(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """after's rows that are new or differ, and before's that are gone, with _change_type INSERT, UPDATE or DELETE.

    Nulls equal one another, in keys and in other columns.
    """
    columns = after.columns
    one, two = (df.withColumn("__here", F.lit(True)) for df in (before, after))
    one, two = one.alias("o"), two.alias("n")
    both = one.join(two, reduce(Column.__and__, (F.col(f"o.`{k}`").eqNullSafe(F.col(f"n.`{k}`")) for k in keys)), "full")
    same = reduce(Column.__and__, (F.col(f"o.`{c}`").eqNullSafe(F.col(f"n.`{c}`")) for c in columns))
    kind = F.when(F.col("o.__here").isNull(), "INSERT").when(F.col("n.__here").isNull(), "DELETE").when(~same, "UPDATE")
    picked = [F.when(F.col("n.__here").isNull(), F.col(f"o.`{c}`")).otherwise(F.col(f"n.`{c}`")).alias(c) for c in columns]
    return both.select(*picked, kind.alias("_change_type")).filter(F.col("_change_type").isNotNull())


def appends(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows that after has more often than before, each as often as it was added, with _change_type INSERT."""
    return after.exceptAll(before).withColumn("_change_type", F.lit("INSERT"))
