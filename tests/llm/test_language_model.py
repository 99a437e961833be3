import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa

from lodestone.llm import language_model as lm
from lodestone.llm import seating


def test_alone_by_enumeration():
    """U(c, t) against all seatings of up to six customers, weighted by the Pitman-Yor process."""
    d = 0.4

    def seatings(c):
        if not c:
            yield (), 1.0
            return
        for sizes, w in seatings(c - 1):
            for k, size in enumerate(sizes):
                yield (*sizes[:k], size + 1, *sizes[k + 1 :]), w * (size - d)
            yield (*sizes, 1), w

    for c in range(2, 7):
        for t in range(1, c + 1):
            found = [(s, w) for s, w in seatings(c) if len(s) == t]
            want = sum(w * sum(1 for x in s if x == 1) / c for s, w in found) / sum(w for _, w in found)
            assert math.isclose(seating.alone(d)[c, t], want, rel_tol=1e-9, abs_tol=1e-12)


def test_moves_sample_the_posterior():
    """One restaurant, one dish of five customers: tables by Gibbs against the exact distribution."""
    d, low, c = 0.5, 0.2, 5
    weight = {}
    log_s = {(0, 0): 1.0}
    for n in range(1, c + 1):
        for t in range(1, n + 1):
            log_s[n, t] = log_s.get((n - 1, t - 1), 0) + (n - 1 - d * t) * log_s.get((n - 1, t), 0)
    for t in range(1, c + 1):
        weight[t] = log_s[c, t] * low**t * math.prod(seating.STRENGTH + d * j for j in range(t))
    exact = sum(t * w for t, w in weight.items()) / sum(weight.values())
    rng, mean = np.random.default_rng(4), []
    level = seating.Level(4000, np.arange(4000), np.zeros(4000, np.int64), d)
    level.seat(np.full(4000, c))
    for _ in range(40):
        level.moves(np.full(4000, low), rng, 5)
        mean.append(level.t.mean())
    assert abs(np.mean(mean[10:]) - exact) < 0.02


def test_cells_of_many_customers():
    """Tables of a cell of 20,000 customers beside 4,000 other tables, against the exact distribution."""
    d, low, c, others, most = 0.5, 0.1, 20_000, 4_000, 1_500
    log_s, t = np.full(most + 1, -np.inf), np.arange(most + 1)
    log_s[0] = 0
    with np.errstate(divide="ignore", invalid="ignore"):
        for n in range(1, c + 1):
            seated = n - 1 - d * t
            stay = np.where((t < n) & (seated > 0), log_s + np.log(np.maximum(seated, 1e-300)), -np.inf)
            stay[1:] = np.logaddexp(stay[1:], log_s[:-1])
            log_s = stay
    log_p = log_s + t * np.log(low) + np.r_[0, np.cumsum(np.log(seating.STRENGTH + d * (others + t[:-1])))]
    p = np.exp(log_p - log_p.max())
    exact = (t * p).sum() / p.sum()
    rng, mean = np.random.default_rng(7), []
    level = seating.Level(1, np.zeros(others + 1, np.int64), np.arange(others + 1), d)
    level.seat(np.r_[c, np.ones(others, np.int64)])
    for _ in range(60):
        level.moves(np.full(others + 1, low), rng, 8)
        mean.append(level.t[0])
    assert abs(np.mean(mean[14:]) - exact) < 0.03 * exact


def test_a_restaurant_of_many_customers():
    """100 restaurants of one dish that alone is served, 10^5 customers each: the expected tables in closed form."""
    d, c, rooms = 0.5, 100_000, 100
    log_k = math.lgamma(1 + c + d) + math.lgamma(2) - math.log(d) - math.lgamma(1 + c) - math.lgamma(1 + d)
    exact = math.exp(log_k) - 1 / d
    rng, mean = np.random.default_rng(8), []
    level = seating.Level(rooms, np.arange(rooms), np.zeros(rooms, np.int64), d)
    level.begin(np.full(rooms, c), np.ones(rooms), rng)
    for _ in range(40):
        level.moves(np.ones(rooms), rng, 8)
        mean.append(level.t.mean())
    assert abs(np.mean(mean) - exact) < 0.15 * exact


def test_tables_against_exact_posteriors():
    """One dish of c customers in a restaurant of its own: mean tables by Gibbs against the exact distribution."""
    for c, low, d in ((1_000, 0.3, 0.6), (20_000, 0.3, 0.8), (100_000, 0.01, 0.5)):
        most = min(c, 3_000)
        log_s, t = np.full(most + 1, -np.inf), np.arange(most + 1)
        log_s[0] = 0
        with np.errstate(divide="ignore", invalid="ignore"):
            for n in range(1, c + 1):
                seated = n - 1 - d * t
                stay = np.where((t < n) & (seated > 0), log_s + np.log(np.maximum(seated, 1e-300)), -np.inf)
                stay[1:] = np.logaddexp(stay[1:], log_s[:-1])
                log_s = stay
        log_p = log_s + t * np.log(low) + np.r_[0, np.cumsum(np.log(seating.STRENGTH + d * t[:-1]))]
        p = np.exp(log_p - log_p.max())
        exact = (t * p).sum() / p.sum()
        rooms, rng, mean = 400, np.random.default_rng(9), []
        level = seating.Level(rooms, np.arange(rooms), np.zeros(rooms, np.int64), d)
        level.begin(np.full(rooms, c), np.full(rooms, low), rng)
        for _ in range(60):
            level.moves(np.full(rooms, low), rng, 8)
            mean.append(level.t.mean())
        assert abs(np.mean(mean[20:]) - exact) < 0.1 * exact, (c, low, d, np.mean(mean[20:]), exact)


def bucket(seed):
    rng = np.random.default_rng(seed)
    cell = np.unique(rng.integers(0, 12 * 30, 150))
    room, dish = np.divmod(cell, 30)
    used, room = np.unique(room, return_inverse=True)
    count = rng.geometric(0.2, len(room)) * rng.choice([1, 1, 50], len(room))
    kinds = rng.integers(0, 4, len(used))
    return seating.Bucket(room, dish, count, kinds, np.bincount(room, count), np.ones(len(used)), 30), kinds


def test_predictive_probabilities_sum_to_one():
    given, kinds = bucket(1)
    made = seating.Restaurants(given)
    prior = np.random.default_rng(2).dirichlet(np.ones(31))[:30]
    kept = made.sweeps(prior, 3, keep=4)
    # every known context, an unknown one of a known class, one of an unknown class
    rooms, classes = np.r_[np.arange(len(kinds)), -1, -1], np.r_[kinds, kinds[0], 77]
    at, dish = np.repeat(np.arange(len(rooms)), 30), np.tile(np.arange(30), len(rooms))
    share, rest = made.shares(kept, rooms, classes, dish, at)
    p = share.reshape(-1, 30) + rest[:, None] * prior
    assert (p > 0).all() and np.allclose(p.sum(axis=1) + rest * (1 - prior.sum()), 1)


def test_level_one_has_the_tables_of_level_two():
    given, kinds = bucket(5)
    made = seating.Restaurants(given)
    made.sweeps(np.full(30, 1 / 31), 3)
    made._sample()
    assert (made.t2 >= 1).all() and (made.t2 <= given.count).all()
    assert made.c1.sum() == made.t2.sum() and (made.t1 <= made.c1).all() and (made.t1 >= 1).all()
    assert made.sent_up().sum() == made.t1.sum()


def test_counts_reach_the_buckets_whole(spark):
    """Cells of all buckets against the pairs of the texts, with and without split contexts."""
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["the", "a", *(f"w{k}" for k in range(30))]) for _ in range(rng.randrange(30)))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = Counter()
    for i, text in rows:
        if not lm.held_out(i):
            own = [lm.BEGINNING, *lm.tokens(text.encode())]
            want.update(zip(own[:-1], own[1:]))
    blocks = lm._blocks(docs, 4).filter(f"kind = {lm.BLOCK}").cache()
    number = lambda w: int(lm.hashes_of([w])[0])
    for split in ({}, {number(b"the"): 3}):
        found = Counter()
        for row in lm._cells(lm._pairs(blocks, 4, split), 4).filter(f"kind = {lm.CELLS}").collect():
            rooms, kinds, runs, dishes, dish, count = lm.unpacked(bytes(row.body))
            found.update(dict(zip(zip(np.repeat(rooms, runs).tolist(), dishes[dish].tolist()), count.tolist())))
        plain = Counter({(number(a), number(b)): n for (a, b), n in want.items()})
        if not split:
            assert found == plain
        else:
            the = number(b"the")
            assert sum(found.values()) == sum(plain.values()) and len(found) == len(plain)
            assert {k: n for k, n in plain.items() if k[0] != the}.items() <= found.items()


def test_scores(spark):
    rng, rows = random.Random(2), []
    follows = {w: [f"w{rng.randrange(40)}" for _ in range(3)] for w in [f"w{i}" for i in range(40)]}
    for i in range(600):
        text, word = [], f"w{rng.randrange(40)}"
        for _ in range(rng.randrange(0, 60)):
            text.append(word if rng.random() > 0.05 else f"rare{rng.randrange(10**6)}")
            word = rng.choice(follows[word])
        rows.append((i, " ".join(text)))
    rows += [(600, None), (601, ""), (602, " \t\n"), (None, "w1 NEVER"), (603, "W1 w1 É")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, word string").repartition(3)
    found = lm.score_documents(docs, bucket_bytes=9000).cache()
    assert found.count() == len(rows)
    train = [lm.tokens((t or "").encode()) for i, t in rows if not lm.held_out(i)]
    counts = Counter(w for t in train for w in t)
    total, kinds = sum(counts.values()), len(counts)
    texts = dict(rows)
    for r in found.collect():
        own = lm.tokens((texts[r.doc_id] or "").encode())
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in own)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(counts[w] > 0 for w in own), total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0
        assert r.held_out == lm.held_out(r.doc_id)
    held = found.filter("held_out").agg({"score": "sum", "base_score": "sum", "n_tokens": "sum"}).first()
    assert held["sum(score)"] > 0.75 * held["sum(base_score)"]
    assert lm.perplexity(found) < 40
    assert lm.score_documents(docs.limit(0)).collect() == []


def test_split_contexts_score_alike(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, " ".join(x for _ in range(40) for x in ("the", f"w{int(rng.paretovariate(1))}"))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    whole = {r.doc_id: r.score for r in lm.score_documents(docs, bucket_bytes=20_000).collect()}
    monkeypatch.setattr(lm, "SPLIT_TOKENS", 3_000)
    parts = {r.doc_id: r.score for r in lm.score_documents(docs, bucket_bytes=20_000).collect()}
    assert np.mean([abs(parts[i] / whole[i] - 1) for i in whole]) < 0.06


def test_a_text_that_occurs_twice_scores_higher(spark):
    rng = random.Random(5)
    texts = [" ".join(f"v{rng.randrange(400)}" for _ in range(60)) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate([*texts, *texts[:30]])]
    found = {r.doc_id: r.score for r in lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    trained = lambda i: not lm.held_out(i)
    twice = [found[i] for i in range(30) if trained(i) and trained(300 + i)]
    once = [found[i] for i in range(30, 300) if trained(i)]
    assert min(twice) > max(once)


def test_very_long_text_and_only_held_out(spark):
    long = " ".join(f"w{i % 5000}" for i in range(400_000))
    found = lm.score_documents(spark.createDataFrame([(1, long), (2, "w1 w2")], "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_tokens for r in found} == {1: 400_001, 2: 3}
    only = lm.score_documents(spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in only) == [(1, 0, 0, 0.0, 0.0), (3, 0, 0, 0.0, 0.0)]


def test_memory_of_a_bucket():
    """What sampling and answering take at most, for each cell; 201 bytes when every cell had a state."""
    rng = np.random.default_rng(12)
    room, dish = np.divmod(np.unique(np.minimum(rng.zipf(1.3, 300_000), 30_000) * 40_000 + rng.integers(0, 40_000, 300_000)), 40_000)
    used, room = np.unique(room, return_inverse=True)
    count, kinds = np.minimum(rng.zipf(2.5, len(room)), 10_000), rng.integers(0, 500, len(used))
    body = [used.astype(np.uint64), kinds.astype(np.int16), np.bincount(room).astype(np.uint32), np.arange(40_000, dtype=np.uint64), dish.astype(np.int32), count]
    prior = rng.dirichlet(np.ones(40_001))[:-1]
    seating.alone(0.5)
    tracemalloc.start()
    made = seating.Restaurants(lm._bucket(body, {}))
    kept = made.sweeps(prior, 3, keep=4)
    rooms = np.arange(len(used))
    for part in np.array_split(np.arange(len(room)), 20):
        share, rest = made.shares(kept, rooms, kinds, dish[part].astype(np.int64), room[part])
        assert (share > 0).all() and (rest <= 1).all()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 160 * len(room), most / len(room)


def test_words_are_split_at_the_same_bytes():
    """Blocks' tokens by Arrow against tokens(): white space of other kinds, bytes that are no UTF-8, nulls, parts of arrays."""
    rng = random.Random(1)
    some = [9, 10, 11, 12, 13, 32, 0, 28, 31, 65, 90, 97, 122, 0xC3, 0x80, 0xA0, 0x85, 0xFF]
    for _ in range(200):
        raw = [None if rng.random() < 0.05 else bytes(rng.choices(some, k=rng.randrange(25))) for _ in range(rng.randrange(1, 9))]
        for texts in (pa.array(raw, pa.binary()), pa.array([b"x", *raw], pa.binary()).view(pa.string()).slice(1), pa.array(raw, pa.large_binary())):
            words, flat, lengths = lm.numbered([lm.split_words(texts.slice(0, 1)), lm.split_words(texts.slice(1))])
            own = np.split(flat, np.cumsum(lengths)[:-1])
            assert [[words[i] for i in x] for x in own] == [lm.tokens(x or b"") for x in raw] and len(set(words)) == len(words)


def test_pairs_of_a_block():
    """Pairs against plain counting, in the order of their hashes, with split contexts, the beginning among them."""
    rng = random.Random(3)
    texts = [" ".join(f"w{int(rng.paretovariate(0.7)) % 90}" for _ in range(rng.randrange(40))) for _ in range(200)]
    words, flat, lengths = lm.numbered([lm.split_words(pa.array(texts))])
    hashed, kinds = lm.hashes_of(words), np.array([lm.word_class(w) for w in words], np.int16)
    body = lm.packed(np.arange(200), np.ones(200, bool), lengths, flat, hashed, kinds)
    number = lambda w: int(lm.hashes_of([w])[0])
    own = [[lm.BEGINNING, *lm.tokens(t.encode())] for t in texts]
    want = Counter((number(a), number(b)) for i, t in enumerate(own) if not lm.held_out(i) for a, b in zip(t[:-1], t[1:]))
    for split in ({}, {number(b"w1"): 3, number(b"w2"): 1, number(lm.BEGINNING): 4, 17: 2}):
        found = lm.Pairs(lm.opened_block(body), split)
        name = {a: a for a in map(number, {w for t in own for w in t})}
        for a, parts in split.items():
            name |= dict.fromkeys(lm.part_names(a, np.arange(parts)).tolist(), a)
        room, at = np.repeat(found.rooms, found.runs), found.hashed[found.word]
        assert (np.diff(found.rooms.astype(object)) > 0).all() and (np.lexsort((at, room)) == np.arange(len(at))).all()
        assert {(name[a], b): n for a, b, n in zip(room.tolist(), at.tolist(), found.count.tolist()) if n} == want
        assert ((found.kinds == seating.SPLIT) == [name[a] in split for a in found.rooms.tolist()]).all()
        pairs = [(number(a), number(b)) for t in own for a, b in zip(t[:-1], t[1:])]
        assert [(name[int(room[i])], int(at[i])) for i in found.place] == pairs
