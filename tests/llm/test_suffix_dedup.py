import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import suffix_dedup as sd


def brute(texts):
    n, seen = sd.LENGTH, Counter()
    for t in texts:
        seen.update(t[i : i + n] for i in range(len(t) - n + 1))
    out = []
    for t in texts:
        spans = [(i, i + n) for i in range(len(t) - n + 1) if seen[t[i : i + n]] > 1]
        out.append(sd.cut_out(t, spans))
    return out


def corpus(seed):
    rng = random.Random(seed)
    noise = lambda n: "".join(rng.choice("abcdefghij klé\n") for _ in range(n))
    passages = [noise(rng.choice([40, 150, 199, 200, 201, 230, 400, 900])) for _ in range(14)]
    texts = []
    for _ in range(60):
        text = ""
        for _ in range(rng.randrange(0, 6)):
            p = rng.choice(passages)
            a = rng.randrange(0, max(1, len(p) // 3))
            text += noise(rng.randrange(0, 300)) + p[a : rng.randrange(a, len(p) + 1)]
        texts.append(text)
    return texts + ["", "a" * 150, "b" * 700, "xy" * 400, texts[3], texts[3], passages[0] * 7]


def run(spark, texts, **more):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, gram string").repartition(3)
    return {r.doc_id: r for r in sd.remove_repeats(docs, **more).collect()}


@pytest.mark.parametrize(("seed", "at_once"), [(1, 40_000), (2, 40_000), (3, 2), (4, 7)])
def test_equals_brute_force(spark, monkeypatch, seed, at_once):
    """at_once: so few suffixes at a time that most windows are found across boundaries."""
    monkeypatch.setattr(sd, "AT_ONCE", at_once)
    texts = corpus(seed)
    found = run(spark, texts)
    for i, (kept, spans) in enumerate(brute([t.encode() for t in texts])):
        assert (bytes(found[i].kept), found[i].n_spans) == (kept, spans), i
        assert found[i].n_removed == len(texts[i].encode()) - len(kept)


def test_a_passage_after_many_beginnings(spark, monkeypatch):
    """One gram with very many contexts, split over parts; parts of the passage repeat in different lengths."""
    monkeypatch.setattr(sd, "AT_ONCE", 16)
    rng = random.Random(8)
    noise = lambda n: "".join(rng.choice("abcdefghij kl") for _ in range(n))
    passage = noise(260)
    texts = [noise(rng.randrange(0, 120)) + passage[rng.randrange(0, 50) : rng.randrange(180, 261)] + noise(rng.randrange(0, 120)) for _ in range(150)]
    found = run(spark, texts)
    for i, (kept, spans) in enumerate(brute([t.encode() for t in texts])):
        assert (bytes(found[i].kept), found[i].n_spans) == (kept, spans), i


def test_repeated_rows(spark):
    """Rows alike in id and text are documents of their own, so their strings repeat."""
    text = "".join(chr(97 + i * i % 23) for i in range(260))
    docs = spark.createDataFrame([(1, text), (1, text), (2, "x" * 199)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in sd.remove_repeats(docs).collect()) == [(1, 260), (1, 260), (2, 0)]


def test_chunks(spark, monkeypatch):
    import numpy as np

    data = np.random.default_rng(1).integers(97, 101, 9000).astype(np.uint8)
    ends = np.array([10, 3000, 3150, 9000])
    want = sd.anchors(data, ends)
    monkeypatch.setattr(sd, "CHUNK", 512)
    for a, b in zip(want, sd.anchors(data, ends)):
        assert (a == b).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(1, 30)), max_size=12))
def test_cut_out(pairs):
    text = bytes(range(80))
    spans = [(a, a + n) for a, n in pairs]
    gone = {i for a, b in spans for i in range(a, b)}
    kept, runs = sd.cut_out(text, spans)
    assert kept == bytes(i for i in range(80) if i not in gone)
    merged = sum(1 for i in gone if i - 1 not in gone)
    # spans that only touch cover one run
    assert runs == merged


def test_odd_rows(spark):
    text = "".join(chr(97 + i * i % 23) for i in range(260))
    rows = [(None, text), (1, text), (2, None), (1, "short"), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((r.n_bytes, r.n_removed) for r in sd.remove_repeats(docs).collect())
    assert found == [(0, 0), (0, 0), (5, 0), (260, 260), (260, 260)]
    assert sd.remove_repeats(docs.limit(0)).collect() == []
