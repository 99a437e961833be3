import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestone.llm import packing


def layout(phases, totals):
    """Sequence -> its tokens as (queue, place), from pieces of random documents."""
    rng, found = np.random.default_rng(3), {}
    for q, n in totals.items():
        at = 0
        while at < n:
            length = min(int(rng.integers(1, 3000)), n - at)
            done = 0
            for a, size, sequence, offset in packing.pieces_of(phases, q, at, length).tolist():
                assert a == done and size > 0
                done += size
                found.setdefault(sequence, []).append((offset, size, q, at + a))
            assert done == length
            at += length
    return found


@settings(max_examples=25, deadline=None)
@given(st.dictionaries(st.integers(0, 6), st.integers(0, 400_000), max_size=6), st.booleans())
def test_every_token_once(totals, weighted):
    phases = packing.schedule(totals, {q: 1.0 + q for q in totals} if weighted else None)
    found, sizes = layout(phases, totals), []
    for pieces in found.values():
        at = 0
        for offset, size, _, _ in sorted(pieces):
            assert offset == at
            at += size
        sizes.append(at)
    assert sorted(found) == list(range(len(found)))
    assert sum(sizes) == sum(totals.values())
    assert all(s == 2048 or s & (s - 1) == 0 and s < 2048 for s in sizes)
    assert sum(s < 2048 for s in sizes) <= 11


def test_windows_follow_the_mixture():
    totals = {0: 3_000_000, 1: 1_500_000, 2: 700_000, 3: 11}
    found = layout(packing.schedule(totals), totals)
    whole, n = sum(totals.values()), len(found)
    for q in (0, 1, 2):
        served = np.cumsum([sum(size for _, size, k, _ in found[i] if k == q) for i in range(n - 80)])
        wanted = totals[q] / whole * 2048 * np.arange(1, n - 79)
        assert np.abs(served - wanted).max() < 2 * 2048
        shares = np.diff(served) / 2048
        assert np.abs(shares - totals[q] / whole).max() < 0.3


def test_given_weights():
    totals = {0: 1_000_000, 1: 200_000}
    found = layout(packing.schedule(totals, {0: 1, 1: 1}), totals)
    first = [sum(size for _, size, k, _ in found[i] if k == 1) for i in range(100)]
    assert abs(sum(first) - 50 * 2048) < 2048


@pytest.mark.parametrize("text", ["", "a b", " " * 3000 + "x", "<|endoftext|>x", "né\n\n"])
def test_encoder_equals_the_library(text):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert packing.encoder(path).encode(text).tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_frames(spark):
    rng = np.random.default_rng(5)
    words = ["alpha", "beta", "gamma", "été", "<|endoftext|>"]
    rows = [(i, " ".join(rng.choice(words, int(rng.integers(0, 900)))), ["a", "b", None][i % 3], "clash") for i in range(40)]
    rows += [(40, None, "a", None), (41, "", "c", None), (41, "", "c", None), (None, "x", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, part string").repartition(3)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = packing.packed_pieces(docs).toPandas()
    for doc_id, text, _, _ in rows[:41]:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        own = found[found.doc_id == doc_id].sort_values("start")
        assert own.doc_tokens.eq(len(ids)).all() and own.length.sum() == len(ids)
        for r in own.itertuples():
            assert zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
    for _, own in found.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == (own.length.cumsum() - own.length).tolist()
        size = own.length.sum()
        assert size == 2048 or size & (size - 1) == 0
    assert packing.packed_pieces(docs.limit(0)).collect() == []
    pieces = packing.pack_documents(docs)
    assert sum(len(r.ids) for r in packing.sequences(pieces).collect()) == 4 * found.length.sum()


def served(pieces, source_of, window=2048):
    """Tokens of each source in each sequence, in order."""
    out = {}
    for r in pieces:
        own = out.setdefault(r.sequence_id, {})
        source = source_of[r.doc_id]
        own[source] = own.get(source, 0) + len(r.ids) // 4
    return [out[i] for i in sorted(out)]


def test_more_sources_than_queues(spark, monkeypatch):
    """Sources of the shared queue keep their proportions, by size and by given weights, over several slots."""
    monkeypatch.setattr(packing, "SLOT_TOKENS", 9_000)
    rows = [(i, " alpha" * 99, f"s{i % 10}") for i in range(1000)] + [(5000 + i, " beta" * 99, "big") for i in range(1500)]
    source_of = {d: s for d, _, s in rows}
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    for weights in (None, {"big": 5.0, "s0": 4.0, **{f"s{k}": 1.0 for k in range(1, 9)}}):
        pieces = packing.pack_documents(docs, weights=weights, queues=2).collect()
        lengths = {}
        for r in sorted(pieces, key=lambda r: (r.doc_id, r.start)):
            assert r.start == lengths.get(r.doc_id, 0)
            lengths[r.doc_id] = r.start + len(r.ids) // 4
        assert lengths == {d: 100 for d in source_of}
        by_sequence = {}
        for r in pieces:
            by_sequence.setdefault(r.sequence_id, []).append((r.offset, len(r.ids) // 4))
        for parts in by_sequence.values():
            assert [o for o, _ in sorted(parts)] == list(np.cumsum([0, *(n for _, n in sorted(parts))])[:-1])
        first = served(pieces, source_of)[:20]
        share = {s: sum(w.get(s, 0) for w in first) / (20 * 2048) for s in set(source_of.values())}
        want = {"big": 0.6, **{f"s{k}": 0.04 for k in range(10)}} if weights is None else {"big": 5 / 17, "s0": 4 / 17, **{f"s{k}": 1 / 17 for k in range(1, 9)}, "s9": 0.0}
        assert all(abs(share[s] - want[s]) < 0.03 for s in want), share


def test_encoder_lets_other_errors_through():
    made = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert len(made.encode("a" + " " * 1_500_000 + "b")) > 1

    class Broken:
        def encode_to_numpy(self, text, allowed_special):
            raise ValueError("out of order")

    made.fast = Broken()
    with pytest.raises(ValueError, match="out of order"):
        made.encode("a")


def test_the_query(spark):
    """op4_packing's own rows against the library."""
    found = packing.op4_packing(spark, "/root/testdata/sf0.001").toPandas()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert set(found.doc_id) == set(texts)
    for doc_id, own in found.sort_values("start").groupby("doc_id"):
        ids = [*library.encode(texts[doc_id] or "", add_special_tokens=False).ids, 1]
        assert own.doc_tokens.eq(len(ids)).all() and own.start.tolist() == (own.length.cumsum() - own.length).tolist() and own.length.sum() == len(ids)
        for r in own.itertuples():
            assert zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
