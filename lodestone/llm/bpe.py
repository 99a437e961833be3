"""Byte-level BPE encoding and decoding by batched numpy merge rounds.

The symbols of many words lie in one flat array. In each round every adjacent pair is looked up by binary search
in the sorted array of mergeable pairs, each word's pair of lowest rank is merged wherever it occurs, from left to
right, and finished words leave the array. Encoded words are kept in a bounded per-process dictionary.

Defined results. A null text is an empty one: no ids, decoded to an empty text. Special tokens inside a text become
their own ids, as the tokenizers library has it, and decode to their strings. Ids that don't decode to valid UTF-8
give U+FFFD. Very long texts are encoded whole; very long words take as many rounds as they have different merges.
"""

from __future__ import annotations

import functools
import hashlib
import json

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .arrow import map_slices
from .workspace import documents

VOCABULARY = "byte_bpe_50k.json"
#: Words kept in a process; beyond it the dictionary starts anew.
KEPT_WORDS = 400_000
#: How a byte-level tokenizer splits text (fixed by the file format).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
NONE = np.iinfo(np.int64).max


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary file."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteBPE:
    """Encodes and decodes by a tokenizers file with a byte-level BPE model."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, before = spec["model"], spec["pre_tokenizer"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        odd += [k for t in spec["added_tokens"] for k in ("lstrip", "rstrip", "single_word") if t.get(k)]
        odd += ["use_regex"] if before and not before.get("use_regex", True) else []
        if model["type"] != "BPE" or (before or {}).get("type") != "ByteLevel" or before["add_prefix_space"] or spec["normalizer"] or odd:
            raise ValueError(f"{path} isn't a plain byte-level BPE")
        alphabet, vocabulary = byte_alphabet(), model["vocab"]
        spell = lambda token: bytes(alphabet[c] for c in token)
        self.pieces = [b""] * (1 + max([*vocabulary.values(), *(t["id"] for t in spec["added_tokens"])]))
        for token, i in vocabulary.items():
            self.pieces[i] = spell(token)
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_ids = np.array(sorted(self.specials.values()), np.int64)
        for content, i in self.specials.items():
            self.pieces[i] = content.encode()
        self.byte_ids = np.array([vocabulary[c] for c, _ in sorted(alphabet.items(), key=lambda x: x[1])], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocabulary[a] << 32 | vocabulary[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], np.arange(len(pairs))[order]
        self.merged = np.array([vocabulary[a + b] for a, b in pairs], np.int64)[order]
        self.split = regex.compile(SPLIT)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.widths = np.array([len(p) for p in self.pieces], np.int64)
        self.spelled = np.frombuffer(b"".join(self.pieces), np.uint8)
        self.starts = np.cumsum(self.widths) - self.widths
        self.known: dict[str, bytes] = {}

    def merge_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word (not empty), as little-endian unsigned 32-bit numbers."""
        sizes = np.array([len(w) for w in words], np.int64)
        symbols = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), sizes)
        out: list[bytes] = [b""] * len(words)
        while len(symbols):
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            rank, at = np.full(len(symbols), NONE), np.zeros(len(symbols), np.int64)
            key = symbols[:-1] << 32 | symbols[1:]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            fits = (self.keys[place] == key) & (owner[1:] == owner[:-1])
            rank[:-1][fits], at[:-1][fits] = self.ranks[place[fits]], place[fits]
            lengths = np.diff(np.r_[first, len(symbols)])
            lowest = np.minimum.reduceat(rank, first)
            if (done := lowest == NONE).any():
                flat, ends = symbols.astype("<u4").tobytes(), first + lengths
                for w, a, b in zip(owner[first[done]].tolist(), (4 * first[done]).tolist(), (4 * ends[done]).tolist()):
                    out[w] = flat[a:b]
                live = np.repeat(~done, lengths)
                symbols, owner, rank, at = symbols[live], owner[live], rank[live], at[live]
                lowest, lengths = lowest[~done], lengths[~done]
            hit = rank == np.repeat(lowest, lengths)
            spots = np.flatnonzero(hit)
            # of touching hits (one symbol repeated) every second one merges, counted from the left
            run = np.cumsum(np.r_[True, np.diff(spots) != 1][: len(spots)]) - 1
            begin = spots[np.searchsorted(run, np.arange(run[-1] + 1))] if len(spots) else spots
            spots = spots[(spots - begin[run]) % 2 == 0] if len(spots) else spots
            symbols[spots] = self.merged[at[spots]]
            stays = np.ones(len(symbols), bool)
            stays[spots + 1] = False
            symbols, owner = symbols[stays], owner[stays]
        return out

    def words(self, text: str) -> list[str]:
        """Pre-tokens in order; special tokens are items of their own."""
        if self.cut is None or not any(s in text for s in self.specials):
            return self.split.findall(text)
        found: list[str] = []
        for i, part in enumerate(self.cut.split(text)):
            found += [part] if i % 2 else self.split.findall(part)
        return found

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        split = [self.words(t) for t in texts]
        known = self.known
        if len(known) > KEPT_WORDS:
            known.clear()
        fresh = {w for words in split for w in words if w not in known}
        known |= {w: np.array([self.specials[w]], "<u4").tobytes() for w in fresh & self.specials.keys()}
        plain = [w for w in fresh if w not in self.specials]
        known |= dict(zip(plain, self.merge_words([w.encode() for w in plain])))
        return [np.frombuffer(b"".join([known[w] for w in words]), "<u4") for words in split]

    def decode(self, ids: np.ndarray, skip_special_tokens: bool = False) -> str:
        ids = np.asarray(ids, np.int64)
        if skip_special_tokens:
            ids = ids[~np.isin(ids, self.special_ids)]
        widths = self.widths[ids]
        shift = self.starts[ids] - (np.cumsum(widths) - widths)
        return self.spelled[np.repeat(shift, widths) + np.arange(widths.sum())].tobytes().decode("utf-8", "replace")


@functools.cache
def tokenizer(path: str) -> ByteBPE:
    """One per process and path."""
    return ByteBPE(path)


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids): each text's token ids."""
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batch: pa.RecordBatch) -> dict:
        texts = [x or "" for x in batch.column("text").to_pylist()]
        return {"doc_id": batch.column("doc_id"), "ids": [x.astype(np.int32) for x in tokenizer(path).encode_batch(texts)]}

    return map_slices(docs.select("doc_id", "text"), run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str | None = None, skip_special_tokens: bool = False) -> DataFrame:
    """(doc_id, text): the texts of (doc_id, ids); null ids: an empty text."""
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batch: pa.RecordBatch) -> dict:
        texts = [tokenizer(path).decode(np.array(x or [], np.int64), skip_special_tokens) for x in batch.column("ids").to_pylist()]
        return {"doc_id": batch.column("doc_id"), "text": texts}

    return map_slices(encoded.select("doc_id", "ids"), run, "doc_id long, text string")


def op2_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Encodes and decodes in one pass over the texts; only digests of the ids and of the decoded text leave it."""
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batch: pa.RecordBatch) -> dict:
        coder = tokenizer(path)
        encoded = coder.encode_batch([x or "" for x in batch.column("text").to_pylist()])
        sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
        numbers = coder.__dict__.setdefault("numbers", [str(i) for i in range(len(coder.pieces))])
        return {
            "doc_id": batch.column("doc_id"),
            "n_tokens": [len(ids) for ids in encoded],
            "ids_sha256": [sha(",".join([numbers[i] for i in ids.tolist()])) for ids in encoded],
            "decoded_sha256": [sha(coder.decode(ids)) for ids in encoded],
        }

    return map_slices(documents(spark, sf_dir).select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
