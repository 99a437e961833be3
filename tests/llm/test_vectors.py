import numpy as np
import pytest

from lodestone.llm import vectors


def brute(rows):
    ids, units = [r[0] for r in rows], [vectors.unit(r[1]) for r in rows]
    near = {i: set() for i in range(len(rows))}
    for i, a in enumerate(units):
        for j, b in enumerate(units):
            if i != j and a is not None and b is not None and len(a) == len(b) and a @ b >= 0.9:
                near[i].add(j)
    out = {}
    for i in near:
        seen, todo = {i}, [i]
        while todo:
            for k in near[todo.pop()] - seen:
                seen.add(k)
                todo.append(k)
        out[ids[i]] = (len(near[i]), min(ids[k] for k in seen))
    return out


def corpus(n=700, seed=1):
    rng, rows = np.random.default_rng(seed), []
    while len(rows) < n:
        base = rng.normal(size=16)
        for _ in range(int(rng.choice([1, 1, 2, 5, 60]))):
            rows.append((len(rows) * 2 + 1, (base + rng.normal(size=16) * 0.28 * rng.random()).tolist()))
    rows += [(0, None), (2, []), (4, [0.0] * 16), (6, [1.0, None] * 8), (8, [float("nan")] + [1.0] * 15), (10, rows[5][1]), (12, rows[5][1]), (14, [2 * v for v in rows[5][1]])]
    return rows + [(16, [1.0, 2.0]), (18, [1.0, 2.1]), (20, [1e300, 1e300])]


@pytest.mark.parametrize("most", [4096, 90])
def test_equals_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(vectors, "MOST_ROWS", most)
    rows = corpus()
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<double>, node string")
    found = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(frame).collect()}
    want = brute(rows)
    assert len(found) == len(want)
    links = sum(n for n, _ in want.values())
    assert sum(min(found[k][0], n) for k, (n, _) in want.items()) >= 0.97 * links
    assert all(found[k][0] <= n for k, (n, _) in want.items())
    assert sum(found[k][1] == c for k, (_, c) in want.items()) >= 0.98 * len(want)


def test_search_reaches_what_is_in_range():
    rng = np.random.default_rng(2)
    x = np.repeat(rng.normal(size=(60, 16)), 10, axis=0) + rng.normal(size=(600, 16)) * 0.2
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    found = vectors.range_search(x, vectors.neighbour_lists(x), np.arange(600), 0.9)
    want = x @ x.T >= 0.9
    assert (found & ~want).sum() == 0 and found.sum() >= 0.98 * want.sum()


def groups(n, size, dim, noise, seed=3):
    rng = np.random.default_rng(seed)
    x = np.repeat(rng.normal(size=(n, dim)), size, axis=0)
    return x + noise * rng.normal(size=x.shape)


def test_search_enters_groups_wider_than_the_lists():
    """40 groups of 70, whose 64 nearest never leave them: more groups than medoids."""
    x = groups(40, 70, 64, 0.05)
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    found = vectors.range_search(x, vectors.neighbour_lists(x), np.arange(len(x)), 0.9)
    assert (found == (x @ x.T >= 0.9)).all()


def test_parts_of_a_group_that_lists_do_not_join():
    """20 groups of two clumps of 80 each; a clump's lists stay in it, but the clumps are linked."""
    rng = np.random.default_rng(5)
    x = np.repeat(np.repeat(rng.normal(size=(20, 64)), 2, axis=0) + 0.2 * rng.normal(size=(40, 64)), 80, axis=0)
    x += 0.01 * rng.normal(size=x.shape)
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    found, want = vectors.range_search(x, vectors.neighbour_lists(x), np.arange(len(x)), 0.9), x @ x.T >= 0.9
    assert want.sum() > 1.5 * len(x) * 80 and (found == want).all()


@pytest.mark.parametrize("target", [0.98, 1.1])
def test_large_groups_are_whole(spark, monkeypatch, target):
    """Every group of 70 is linked throughout; also by the exact comparison, which an audit that can't pass leads to."""
    monkeypatch.setattr(vectors, "MOST_ROWS", 4096 if target < 1 else 500)
    x = groups(30, 70, 64, 0.05)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(frame, target=target).collect()}
    assert found == {i: (69, i // 70 * 70) for i in range(len(x))}


def test_links_that_only_a_later_shard_finds(spark):
    """All nodes are in the shards 0 and 1; the search of shard 0 finds nothing."""
    x = groups(3, 4, 16, 0.05)
    x = x / np.linalg.norm(x, axis=1)[:, None]
    ids, n = np.arange(100, 112), len(x)
    shards, ones = np.tile([0, 1], (n, 1)), np.ones(n, np.int64)
    rows = [(s, 0, 0, 0, int(i), 1, v.tobytes(), [0, 1]) for s in (0, 1) for i, v in zip(ids, x)]
    dealt = spark.createDataFrame(rows, "shard long, i int, j int, block int, node long, copies long, unit binary, shards array<long>")
    total, root, check = vectors._task_links(ids, ones, shards, ones, x, None, 0, 0, 1, 0.9)
    assert not total.any() and root.tolist() == np.repeat([100, 104, 108], 4).tolist() and check.all()
    found = [(int(i), 0, int(i), 0) for i in ids] + [tuple(map(int, r)) for r in zip(ids, total, root, check)]
    agreed = vectors._agreed(spark.createDataFrame(found, vectors.LINKED), dealt, vectors.Workspace(spark, "test"), 2, 0.9)
    assert sorted(map(tuple, agreed.groupBy("node").sum("n").collect())) == [(i, 3) for i in ids]
    both = vectors._task_links(ids, ones, shards, ones, x, None, 0, 0, 0, 0.9)
    assert (both[0] == 3).all() and not (both[2] + check).any()


def test_odd_rows(spark):
    rows = [(None, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [2.0, 0.1]), (2, None)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = sorted(map(tuple, vectors.near_vectors(frame).collect()), key=str)
    assert found == sorted([(None, 2, 1, True), (1, 2, 1, True), (1, 2, 1, True), (2, 0, 2, True)], key=str)
    assert vectors.near_vectors(frame.limit(0)).collect() == []
    assert [tuple(r) for r in vectors.near_vectors(frame.filter("vec_id = 2")).collect()] == [(2, 0, 2, True)]


def test_the_audit_is_reported(spark):
    for sf in ("sf0.001", "sf0.01"):
        report = {}
        found = vectors.near_vectors(spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet"), report=report)
        assert found.count() > 0 and report["audits"] and report["recall"] >= vectors.TARGET, report
