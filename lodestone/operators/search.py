"""Text analysis and search, and exact vector search."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters that the default analyzer splits at (fixed by the analyzer's definition).
DELIMITERS = "[](){}<>|!;,'\"*&?+/:=@.-$%\\_ \n\r\t"


def text_analyze(text: Column, analyzer: str = "LOG", pattern: str = r"\b\w{2,}\b") -> Column:
    """Tokens by an analyzer: NO_OP (the text), LOG (split at delimiters, ASCII lower case) or PATTERN (matches)."""
    if analyzer == "NO_OP":
        return F.array(text)
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    if analyzer == "PATTERN":
        return F.regexp_extract_all(lowered, F.lit(pattern), F.lit(0))
    if analyzer != "LOG":
        raise ValueError(f"there is no analyzer {analyzer}")
    quoted = "".join("\\" + c if c in "[]\\^-&" else c for c in DELIMITERS)
    return F.filter(F.split(lowered, f"[{quoted}]+"), lambda t: t != "")


def bag_of_words(tokens: Column) -> Column:
    """(term, count) of each different token, by term."""
    return F.transform(F.array_sort(F.array_distinct(tokens)), lambda t: F.struct(t.alias("term"), F.size(F.filter(tokens, lambda x: x == t)).cast("long").alias("count")))


def term_counts(df: DataFrame, key: str, tokens: Column) -> DataFrame:
    """(key, term, count, size): the bag of words as rows, which suits long texts better."""
    # explode(array(...)) works the tokens out once a row, not once a token
    once = df.select(key, F.explode(F.array(tokens)).alias("tokens"))
    each = once.select(key, F.size("tokens").alias("size"), F.explode("tokens").alias("term"))
    return each.groupBy(key, "size", "term").agg(F.count(F.lit(1)).alias("count"))


def tf_idf(df: DataFrame, key: str, tokens: Column, least_docs: int = 1) -> DataFrame:
    """(key, term, tf_idf): count / size * ln(1 + documents / (1 + document frequency)), of terms in least_docs documents."""
    n = df.agg(F.count(F.lit(1)).alias("n"))
    counts = term_counts(df, key, tokens)
    # it reads the counts too, so that both sides need the same columns of one exchange
    frequency = counts.groupBy("term").agg(F.count_if(F.col("count") > 0).alias("df")).filter(F.col("df") >= least_docs)
    # n is one row
    joined = counts.join(frequency, "term").join(F.broadcast(n))
    return joined.select(key, "term", (F.col("count") / F.col("size") * F.log(1 + F.col("n") / (1 + F.col("df")))).alias("tf_idf"))


def search(text: Column, query: str) -> Column:
    """Whether a text meets a search query: terms (all needed), "phrases", OR, AND, parentheses and a minus for NOT."""
    tokens = text_analyze(text)
    parts = re.findall(r'"[^"]*"|\(|\)|[^\s()"]+', query)
    spot = 0

    def analyzed(part: str) -> list[str]:
        return [t for t in re.split("[" + re.escape(DELIMITERS) + "]+", part.lower()) if t]

    def either() -> Column:
        nonlocal spot
        made = both()
        while spot < len(parts) and parts[spot] == "OR":
            spot += 1
            made = made | both()
        return made

    def both() -> Column:
        nonlocal spot
        made = one()
        while spot < len(parts) and parts[spot] not in ("OR", ")"):
            spot += parts[spot] == "AND"
            made = made & one()
        return made

    def one() -> Column:
        nonlocal spot
        part = parts[spot]
        spot += 1
        if part == "(":
            made = either()
            spot += 1
            return made
        if part.startswith("-") and len(part) > 1:
            return ~F.arrays_overlap(tokens, F.array(*map(F.lit, analyzed(part[1:]))))
        words = analyzed(part)
        if part.startswith('"') and len(words) > 1:
            joined = F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))
            return F.contains(joined, F.lit(f" {' '.join(words)} "))
        made = F.lit(True)
        for w in words:
            made = made & F.array_contains(tokens, w)
        return made

    return F.coalesce(either(), F.lit(False))


QUERIES_AT_ONCE = 1_000


def vector_search(base: DataFrame, queries: DataFrame, top_k: int = 10, distance: str = "EUCLIDEAN", key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, base_id, distance) of each query's top_k nearest base rows, exactly; ties by id.

    The queries are a stated set, held against all rows in blocks of QUERIES_AT_ONCE. Each batch of base rows gives
    top_k candidates a query at most, so what is shuffled grows with batches and queries, not with pairs.
    """
    if distance not in ("EUCLIDEAN", "COSINE", "DOT_PRODUCT"):
        raise ValueError(f"there is no distance {distance}")
    rows = queries.select(key, vector).filter(F.col(vector).isNotNull()).toLocalIterator()
    found = None
    while block := [r for _, r in zip(range(QUERIES_AT_ONCE), rows)]:
        ids, x = np.array([r[0] for r in block]), np.array([list(r[1]) for r in block], np.float64)

        def run(batches, ids=ids, x=x):
            for batch in batches:
                batch = batch.filter(batch.column(1).is_valid())
                if not batch.num_rows:
                    continue
                own, y = batch.column(0).to_numpy(), np.array(batch.column(1).to_pylist(), np.float64)
                dots = x @ y.T
                if distance == "EUCLIDEAN":
                    far = np.sqrt(np.maximum(0, (x**2).sum(1)[:, None] + (y**2).sum(1)[None, :] - 2 * dots))
                elif distance == "COSINE":
                    far = 1 - dots / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None, :])
                else:
                    far = -dots
                k = min(top_k, len(own)) if top_k >= 0 else len(own)
                best = np.argsort(far, axis=1, kind="stable")[:, :k]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, k)), pa.array(own[best].ravel()), pa.array(np.take_along_axis(far, best, 1).ravel())], names=["query_id", "base_id", "distance"])

        part = base.select(key, vector).mapInArrow(run, "query_id long, base_id long, distance double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return base.sparkSession.createDataFrame([], "query_id long, base_id long, distance double")
    if top_k < 0:
        return found
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "base_id"))
    return found.withColumn("__rank", rank).filter(F.col("__rank") <= top_k).drop("__rank")
