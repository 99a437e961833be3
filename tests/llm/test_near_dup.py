import random

import numpy as np

from lodestone.llm import near_dup
from lodestone.llm.components import components
from lodestone.llm.workspace import Workspace


def brute(rows, percent=85):
    sets = {}
    for d, text in rows:
        w = [x for x in (text or "").lower().replace("\t", " ").split(" ") if x]
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def corpus(seed):
    rng, rows = random.Random(seed), []
    for g in range(25):
        n = rng.choice([1, 3, 5, 6, 7, 12, 40, 150, 500])
        base = [f"w{rng.randrange(5000)}" for _ in range(n)]
        for _ in range(rng.randrange(1, 9)):
            text = list(base)
            for _ in range(rng.randrange(0, 1 + n // 40 + 1)):
                text[rng.randrange(n)] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows) * 3 + 1, " ".join(text)))
    rng.shuffle(rows)
    return rows + [(0, None), (2, ""), (5, " \t "), (8, "A b C"), (11, "a B c")]


def test_equals_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, component string")
        found = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(docs).collect()}
        assert found == brute(rows)


def test_a_chain_through_a_common_base(spark):
    """Copies that are near their base but not near one another are still one component."""
    rng = random.Random(7)
    base = [f"b{i}" for i in range(400)]
    rows = [(1000, " ".join(base))]
    for i in range(60):
        text = list(base)
        for _ in range(6):
            text[rng.randrange(400)] = f"z{rng.randrange(10**6)}"
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_dup.near_duplicates(docs).collect()} == {d: c for d, (_, c) in brute(rows).items()}


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (None, None)], "doc_id long, text string")
    rows = sorted(map(tuple, near_dup.near_duplicates(docs).collect()), key=str)
    assert rows == sorted([(None, 2, None, True), (1, 2, 1, True), (1, 2, 1, True), (None, 0, None, True)], key=str)
    assert near_dup.near_duplicates(docs.limit(0)).collect() == []


def test_one_id_with_two_texts(spark):
    """Each row is linked by its own text, whatever other rows have its doc_id."""
    one, two = (" ".join(f"{x}{i}" for i in range(300)) for x in "pq")
    for rows, want in (
        ([(1, one), (5, one), (5, two), (7, two + " z")], [(1, 1), (5, 1), (5, 5), (7, 5)]),
        ([(5, one), (5, two), (7, one + " z"), (9, two + " z")], [(5, 5), (5, 5), (7, 5), (9, 5)]),
    ):
        found = near_dup.near_duplicates(spark.createDataFrame(rows + rows[:2], "doc_id long, text string")).collect()
        assert sorted({(r.doc_id, r.component_id) for r in found}) == sorted(set(want)) and len(found) == len(rows) + 2


def test_blocks_find_what_stars_miss(spark):
    """Groups without a common centre, in blocks smaller than they are, at both thresholds."""
    rng, rows = random.Random(11), []
    for g in range(3):
        text = [f"g{g}w{i}" for i in range(200)]
        for step in range(40):
            # each is near the ones right before it alone
            text = list(text)
            for _ in range(2):
                text[rng.randrange(200)] = f"n{rng.randrange(10**9)}"
            rows.append((1000 * g + step, " ".join(text)))
    rng.shuffle(rows)
    near_dup.BLOCK, near_dup.QUERIES, before = 12, 5, (near_dup.BLOCK, near_dup.QUERIES)
    try:
        for percent in (85, 80):
            found = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent).collect()
            assert {r.doc_id: r.component_id for r in found} == {d: c for d, (_, c) in brute(rows, percent).items()}
    finally:
        near_dup.BLOCK, near_dup.QUERIES = before


def test_sketches_agree_as_sets_do():
    rng = np.random.default_rng(1)
    for n in (30, 300, 3000):
        pool = np.unique(rng.integers(0, 2**64, 2 * n, np.uint64, endpoint=False))
        a, b = pool[: n + n // 4], pool[n // 4 : n + n // 2]
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        same = np.mean(np.frombuffer(near_dup.sketch(a), np.uint8) == np.frombuffer(near_dup.sketch(b), np.uint8))
        assert abs(same - true) < 0.2


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    found = components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "test"), "c").collect()
    assert {r.id: r.component for r in found} == {**{i: 1 for i in range(1, 61)}, **{i: 100 for i in range(100, 140)}}


def test_few_edges_in_one_task(spark):
    """One task, rounds and one edge too many for a task agree, with repeated edges, loops and a long chain."""
    rng = random.Random(5)
    edges = [(rng.randrange(-200, 200), rng.randrange(-200, 200)) for _ in range(150)]
    edges += edges[:20] + [(3, 3)] + [(1000 + 7 * i % 301, 1000 + 7 * (i + 1) % 301) for i in range(250)]
    given = spark.createDataFrame(edges, "a long, b long").repartition(5)
    kept = sum(a != b for a, b in edges)
    ways = [{(r.id, r.component) for r in components(given, Workspace(spark, "test"), "c", few).collect()} for few in (kept, kept - 1, 0)]
    assert ways[0] == ways[1] == ways[2] and len(ways[0]) == len({x for a, b in edges if a != b for x in (a, b)})
    assert components(given.limit(0), Workspace(spark, "test"), "c", 10).collect() == []


def test_few_links_take_no_rounds(spark, monkeypatch):
    """Each graph of few links is written twice, and once with all texts; of many it takes rounds, with the same result."""
    rng, text, rows, written, write = random.Random(3), [f"w{i}" for i in range(200)], [], [], Workspace.write
    for i in range(30):
        # each is near the ones right before it alone
        for _ in range(2):
            text[rng.randrange(200)] = f"n{rng.randrange(10**9)}"
        rows.append((100 - i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {d: c for d, (_, c) in brute(rows).items()}
    monkeypatch.setattr(Workspace, "write", lambda self, df, name, *by: written.append(name) or write(self, df, name, *by))
    assert {r.doc_id: r.component_id for r in near_dup.near_duplicates(docs).collect()} == want
    assert all(sum(x.split("-")[0] == label for x in written) <= 3 for label in ("parts1", "parts2", "parts3", "regions"))
    monkeypatch.setattr(near_dup, "FEW", 0)
    assert {r.doc_id: r.component_id for r in near_dup.near_duplicates(docs).collect()} == want
