"""k-means, silhouettes and exact percentiles of many different rows of numbers, in passes over all of them.

Spark's learner holds an object for each row and takes minutes where tens of millions of rows differ. Here rows are
packed once into blocks of columns that stay in Spark's storage (memory, then disk), and a pass adds up each task's
blocks by numpy; the driver gets a table of k centres from each task.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import let_workers_import

#: Values that may come to the driver at once.
FEW = 65_536
#: Rounds in which candidates for the first centres are drawn, as in Spark's learner.
ROUNDS = 2
#: What Spark sends a Python worker at once; it looks at a batch's size after each row where there is a bound.
BATCH_SETTING, BATCH_BYTES, UNBOUND = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20, 2**31 - 1
#: Ranges of equal width that values are counted in.
RANGES = 4096
#: One in so many hashes is kept where different rows are counted.
THINNED = 64
#: Times that a row is seen on average from which equal rows are united.
REPEATED = 8


@contextlib.contextmanager
def _blocks(rows: DataFrame) -> Iterator[DataFrame]:
    """rows, all columns double and without nulls, as (id, columns): a block's values column by column, the weights last."""
    spark = rows.sparkSession
    let_workers_import(spark)
    before = spark.conf.get(BATCH_SETTING, None)

    def pack(batches):
        part = TaskContext.get().partitionId()
        for i, batch in enumerate(b for b in batches if b.num_rows):
            columns = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            yield pa.RecordBatch.from_pydict({"id": pa.array([(part << 32) + i], pa.int64()), "columns": pa.array([columns.tobytes()], pa.binary())})

    spark.conf.set(BATCH_SETTING, str(UNBOUND))  # batches of numbers are bounded by their rows
    made = rows.mapInArrow(pack, "id bigint, columns binary").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        made.count()
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
        yield made
    finally:
        made.unpersist()
        spark.conf.unset(BATCH_SETTING) if before is None else spark.conf.set(BATCH_SETTING, before)


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centre, squared distance from it) of each column of x."""
    least, at = np.full(x.shape[1], np.inf), np.zeros(x.shape[1], np.int64)
    for j, centre in enumerate(centres):
        d = x[0] - centre[0]
        d *= d
        for a, v in zip(x[1:], centre[1:]):
            step = a - v
            step *= step
            d += step
        if j:
            np.copyto(at, j, where=d < least)
        least = np.minimum(least, d, out=d)
    return at, least


def _drawn(keys: np.ndarray, x: np.ndarray, number: int) -> np.ndarray:
    """The key and the values of the `number` columns of x with the largest finite keys."""
    best = np.argsort(-keys, kind="stable")[:number] if len(keys) <= number else np.argpartition(-keys, number - 1)[:number]
    best = best[np.isfinite(keys[best])]
    return np.vstack([keys[best], x[:, best]]).T


def _pass(blocks: DataFrame, width: int, each: Callable, join: Callable) -> np.ndarray:
    """A pass over the blocks: each(id, values) is a block's table of numbers, join(a, b) unites two."""

    def run(batches):
        found = None
        for batch in batches:
            for i, columns in zip(batch.column(0).to_pylist(), batch.column(1)):
                one = each(i, np.frombuffer(columns.as_buffer()).reshape(width, -1))
                found = one if found is None else join(found, one)
        if found is not None:
            yield pa.RecordBatch.from_pydict({"rows": pa.array([len(found)], pa.int64()), "table": pa.array([np.ascontiguousarray(found, float).tobytes()], pa.binary())})

    found = None
    for r in blocks.mapInArrow(run, "rows bigint, table binary").collect():
        one = np.frombuffer(bytes(r.table)).reshape(r.rows, -1)
        found = one if found is None else join(found, one)
    if found is None:
        raise ValueError("there are no rows to cluster")
    return found


def _sums(blocks: DataFrame, centres: np.ndarray) -> np.ndarray:
    """For each centre: its rows' number, sum of squared distances and sums of values."""

    def each(_, x):
        x, mass = x[:-1], x[-1]
        at, least = _nearest(x, centres)
        return np.stack([np.bincount(at, weights, len(centres)) for weights in (mass, least * mass, *(x * mass))], axis=1)

    return _pass(blocks, centres.shape[1] + 1, each, np.add)


def _first(blocks: DataFrame, width: int, k: int, seed: int) -> np.ndarray:
    """k-means||: rows drawn by their squared distance from those drawn before, then k of them by their rows' numbers."""
    candidates = np.empty((0, width))
    for n, wanted in enumerate([1, *[2 * k] * ROUNDS]):

        def each(i, x, n=n, wanted=wanted, candidates=candidates):
            chance = np.random.default_rng([seed & 0xFFFFFFFF, n, i]).exponential(size=x.shape[1])
            x, mass = x[:-1], x[-1]
            weight = _nearest(x, candidates)[1] * mass if len(candidates) else mass
            with np.errstate(divide="ignore"):
                return _drawn(-chance / weight, x, wanted)  # the first arrivals at rates by weight; never at none

        join = lambda a, b, wanted=wanted: _drawn((t := np.concatenate([a, b]))[:, 0], t[:, 1:].T, wanted)
        drawn = _pass(blocks, width + 1, each, join)
        candidates = np.unique(np.concatenate([candidates, drawn[:, 1:]]), axis=0)
    if len(candidates) <= k:
        return candidates
    weights, chance = _sums(blocks, candidates)[:, 0], np.random.default_rng([seed & 0xFFFFFFFF])
    picked = candidates[[chance.choice(len(candidates), p=weights / weights.sum())]]
    while len(picked) < k:
        p = weights * _nearest(candidates.T, picked)[1]
        if not p.sum() > 0:
            p = _nearest(candidates.T, picked)[1]
        picked = np.vstack([picked, candidates[chance.choice(len(candidates), p=p / p.sum())]])
    for _ in range(30):
        at, _ = _nearest(candidates.T, picked)
        mass = np.bincount(at, weights, k)
        moved = np.stack([np.bincount(at, weights * x, k) for x in candidates.T], axis=1)
        moved = np.where(mass[:, None] > 0, moved / np.maximum(mass, 1e-300)[:, None], picked)
        if np.array_equal(moved, picked):
            break
        picked = moved
    return picked


def centres_of(rows: DataFrame, k: int, most: int = 20, tolerance: float = 1e-4, seed: int = 1, grouped: bool = False) -> tuple[np.ndarray, float]:
    """(centres, sum of the rows' squared distances from the nearest) of k-means over all rows.

    rows: all columns double and without nulls. Passes end after `most`, or when no centre has moved more than `tolerance`.
    grouped: equal rows are first united as one with a weight, which pays where most rows repeat.
    """
    width, count = len(rows.columns), F.count(F.lit(1)).cast("double").alias("__weight")
    with _blocks(rows.groupBy(*(F.col(f"`{n}`") for n in rows.columns)).agg(count) if grouped else rows.withColumn("__weight", F.lit(1.0))) as blocks:
        centres = _first(blocks, width, k, seed)
        for _ in range(most):
            found = _sums(blocks, centres)
            moved = np.where(found[:, :1] > 0, found[:, 2:] / np.maximum(found[:, :1], 1), centres)  # one without rows stays
            still = (((moved - centres) ** 2).sum(1) <= tolerance**2).all()
            centres = moved
            if still:
                break
        return centres, float(_sums(blocks, centres)[:, 1].sum())


def repeats(rows: DataFrame) -> tuple[bool, bool]:
    """Whether rows have more than FEW different ones, and whether these are seen more than REPEATED times on average; estimates."""
    hashed = rows.select(F.xxhash64(*(F.col(f"`{n}`") for n in rows.columns)).alias("hash"))
    kept = hashed.filter(F.pmod("hash", F.lit(THINNED)) == 0).agg(F.approx_count_distinct("hash", 0.02).alias("n"), F.count(F.lit(1)).alias("rows"))
    found = kept.first()
    return found.n * THINNED > FEW, found["rows"] > REPEATED * found.n


def squares(xs: Sequence, centres: Sequence[Sequence[float]]) -> list:
    """The squared distances of columns from each centre, in generated code."""
    return [sum(((x - F.lit(float(v))) * (x - F.lit(float(v))) for x, v in zip(xs, centre)), F.lit(0.0)) for centre in centres]


def silhouette(rows: DataFrame, centres: Sequence[Sequence[float]]) -> float:
    """The mean silhouette by squared distances of rows, all columns double and without nulls: two passes.

    The mean squared distance from a cluster's n rows comes from their sum y and their sum of squares s: x.x + s/n - 2x.y/n.
    Values are taken from the centres' mean, which keeps digits where they lie far from 0.
    """
    middle = [float(v) for v in np.mean(np.asarray(centres, float), axis=0)]
    names = [f"x{i}" for i in range(len(middle))]
    xs = [F.col(n) for n in names]
    moved = rows.toDF(*names).select(*((x - F.lit(v)).alias(n) for x, n, v in zip(xs, names, middle)))
    apart = [f"d{j}" for j in range(len(centres))]
    far = moved.select("*", *(d.alias(n) for n, d in zip(apart, squares(xs, [[a - b for a, b in zip(centre, middle)] for centre in centres]))))
    near = far.withColumn("near", F.least(*apart) if len(apart) > 1 else F.col(apart[0]))
    at = F.coalesce(*(F.when(F.col(d) == F.col("near"), F.lit(j)) for j, d in enumerate(apart)))
    square = sum((x * x for x in xs), F.lit(0.0))
    dealt = near.select(*names, at.alias("at"), square.alias("square"))
    found = dealt.groupBy("at").agg(F.count(F.lit(1)).alias("n"), F.sum("square").alias("s"), *(F.sum(n).alias(n) for n in names)).collect()
    if len(found) < 2:
        raise ValueError("a silhouette needs two clusters with rows")
    mean = {r["at"]: F.col("square") + F.lit(r.s / r.n) - sum((F.lit(2 * r[n] / r.n) * F.col(n) for n in names), F.lit(0.0)) for r in found}
    means = dealt.select("at", *(m.alias(f"m{j}") for j, m in mean.items()))
    case = lambda value: F.coalesce(*(F.when(F.col("at") == r["at"], value(r)) for r in found))
    others = lambda r: [F.col(f"m{o['at']}") for o in found if o["at"] != r["at"]]
    own = case(lambda r: F.col(f"m{r['at']}") * F.lit(r.n / max(r.n - 1, 1)))
    other = case(lambda r: F.least(*others(r)) if len(found) > 2 else others(r)[0])
    single = case(lambda r: F.lit(r.n == 1))
    each = means.select(single.alias("single"), own.alias("own"), other.alias("other"))
    value = F.when(F.col("single"), 0.0).when(F.col("own") < F.col("other"), 1 - F.col("own") / F.col("other")).when(F.col("own") > F.col("other"), F.col("other") / F.col("own") - 1).otherwise(0.0)
    return each.agg(F.avg(value).alias("v")).first().v


def _split(values: DataFrame, n: int, ranks: list[int], by_width: bool) -> list[tuple]:
    """(condition's maker, number of values, whether they are all equal) of parts that the column v falls into, in rising order."""
    v = F.col("v")
    least, most = values.agg(F.min("v"), F.max("v")).first()
    if least == most:
        return [(lambda: F.lit(True), n, True)]
    if by_width and np.isfinite(most - least):
        place = F.floor((v - F.lit(least)) / F.lit(most - least) * F.lit(float(RANGES)))
        counted = values.groupBy(place.alias("place")).agg(F.count(F.lit(1)).alias("n")).collect()
        return [(lambda at=r.place: place == F.lit(at), r.n, False) for r in sorted(counted, key=lambda r: r.place)]
    share = lambda r, by: min(1.0, max(0.0, r / n + by))
    low, high = values.agg(F.percentile_approx(v, [share(min(ranks), -2e-4), share(max(ranks), 2e-4)], 10_000).alias("e")).first().e
    low, high = F.lit(float(low)), F.lit(float(high))
    parts = [(v < low, False), (v == low, True), ((v > low) & (v < high), False), ((v == high) & (v > low), True), (v > high, False)]
    counts = values.agg(*(F.count_if(part) for part, _ in parts)).first()
    return [(lambda part=part: part, m, equal) for (part, equal), m in zip(parts, counts)]


def _ranked(values: DataFrame, n: int, ranks: list[int], by_width: bool = True) -> dict[int, float]:
    """The values of the one column v, n of them and none null, at ranks from 0: narrowed until few are left to sort.

    By ranges of equal width; where most values fall into one range, next by values of about the ranks.
    """
    if n <= FEW:
        kept = [r.v for r in values.sort("v").collect()]
        return {r: kept[r] for r in ranks}
    found, before = {}, 0
    for part, m, equal in _split(values, n, ranks, by_width):
        here = [r for r in ranks if before <= r < before + m]
        if here and equal:
            found |= dict.fromkeys(here, values.filter(part()).first().v)
        elif here:
            found |= {r + before: x for r, x in _ranked(values.filter(part()), m, [r - before for r in here], m <= n // 2).items()}
        before += m
    return found


def percentile(values: DataFrame, share: float) -> float | None:
    """What F.percentile gives of a table's one column, without a map of all different values; null where there are none."""
    if not 0 <= share <= 1:
        raise ValueError(f"a percentile's share is from 0 to 1, not {share}")
    kept = values.toDF("v").filter("v IS NOT NULL").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if not (n := kept.count()):
            return None
        place = (n - 1) * share
        low, high = int(place), int(-(-place // 1))
        found = _ranked(kept, n, sorted({low, high}))
        if low == high or found[low] == found[high]:
            return found[low]
        return (high - place) * found[low] + (place - low) * found[high]
    finally:
        kept.unpersist()
