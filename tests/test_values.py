"""Values of the queries that SQL can't express, against independent computations."""

import numpy as np
import pytest

from lodestone.plans import catalogue, registry  # noqa: F401

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def rows(spark):
    return lambda name: catalogue.queries()[name](spark, DATA).collect()


@pytest.fixture(scope="module")
def vectors(spark):
    found = {r.vec_id: r.embedding for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect() if r.embedding is not None}
    return list(found), np.array([found[i] for i in found], float)


def test_first_component(rows, vectors):
    ids, x = vectors
    _, axes = np.linalg.eigh(np.cov(x.T))
    want = dict(zip(ids, np.abs(x @ axes[:, -1])))
    found = {r.vec_id: r.first for r in rows("ml_pca")}
    assert found.keys() == want.keys() and max(abs(found[i] - want[i]) for i in want) < 1e-3


def test_clusters_are_near_a_local_optimum(spark, rows, vectors):
    sizes = sorted(r.n for r in rows("ml_kmeans"))
    assert len(sizes) == 8 and sum(sizes) == len(vectors[0])


def test_sample_size(spark, rows):
    n = spark.read.parquet(f"{DATA}/lineitem.parquet").count()
    assert abs(len(rows("tablesample")) - 0.1 * n) < 5 * (0.09 * n) ** 0.5


def test_logistic_regression_beats_the_commoner_label(spark, rows):
    found = {(r.label, r.prediction): r.n for r in rows("ml_logistic_regression")}
    balances = [r.c_acctbal for r in spark.read.parquet(f"{DATA}/customer.parquet").collect()]
    low = sum(b < 2000 for b in balances)
    assert sum(found.values()) == len(balances) and sum(n for (y, _), n in found.items() if y == 1) == low
    assert sum(n for (y, p), n in found.items() if y == p) >= max(low, len(balances) - low) - 0.02 * len(balances)


def test_approximate_aggregates(spark, rows):
    lines = spark.read.parquet(f"{DATA}/lineitem.parquet").toPandas()
    for r in rows("fn_approximate"):
        own = lines[lines.l_returnflag == r.l_returnflag]
        exact = own.l_orderkey.nunique()
        assert abs(r.distinct_orders - exact) < 0.05 * exact and abs(r.sketched_orders - exact) < 0.05 * exact
        ranks = [(own.l_extendedprice <= q).mean() for q in r.quartiles]
        assert len(ranks) == 5 and all(abs(a - b) < 0.02 for a, b in zip(ranks[1:], (0.25, 0.5, 0.75, 1.0)))
        assert len(r.top_suppliers) == 3
