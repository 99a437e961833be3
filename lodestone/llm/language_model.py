"""Language-model scores of documents under a hierarchical Pitman-Yor model, beside an add-0.1 unigram base.

Tokens are words and one end; a token's context is the word before it. Every word of the training documents is a dish,
and every one that another follows has a restaurant of its own, so that the model grows with the corpus. seating.py
has the restaurants: contexts, their classes (by the last three bytes of the context word, within a bucket of
contexts) and the root, where each word has one table: (c - d) / (theta + n) for a word with c customers, and
(theta + d * v) / (theta + n) for all unseen words together. These are one outcome, as in the base, so over the
training words and that outcome probabilities sum to 1.

All data are sent as messages of packed arrays. 1. Blocks of documents become arrays of word numbers; each block sends
its words and counts to buckets of words, by hash. 2. Each block sends its pairs (context, word) to buckets of
contexts, which sum them to cells; contexts of very many tokens are split by word. 3. Buckets of contexts send the
numbers of their tables to the buckets of words, which answer with the root's probabilities, then sample seatings by
Gibbs sweeps, and send their tables again. 4. With the root that these give they sample anew, average the predictive
probabilities over samples, and answer each block's pairs. 5. Each block adds up its documents' tokens.

The numbers of blocks and of buckets follow the input, and a bucket's size stays the same. The driver has sums and the
list of split contexts, at most 2^17.

Defined results. A null or empty text is an end. Rows without doc_id are scored and never learned from. Repeated
rows are learned from each time. A very long text is a block of its own. Words are known by 64-bit hashes. Without
training tokens all words are the unseen one, with a score of 0. Of an empty table nothing comes. Columns other than
doc_id and text are left alone, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import seating
from .arrow import map_arrow, release_memory, slices
from .workspace import Workspace, documents

FOLDS, CLASSES, ADDED = 10, 512, 0.1
#: Bytes of text in a block and, of the whole corpus, to a bucket; training tokens from which a context is split.
BLOCK_BYTES, BUCKET_BYTES, SPLIT_TOKENS, MOST_SPLIT = 24 << 20, 32 << 20, 500_000, 1 << 17
#: The end of a text, and what stands before its first word; no word holds white space.
END, BEGINNING = b"\n", b"\t"
_ODD = np.uint64(0x9E3779B97F4A7C15)

MESSAGE = "place long, kind int, origin long, n long, x double, body binary"
BLOCK, WORDS, COUNTS, PAIRS, CELLS, TABLES, PRIOR, KNOWN, SHARES = range(9)


def held_out(doc_id: int | None) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % FOLDS == 0


def tokens(text: bytes) -> list[bytes]:
    """bytes.lower() and split() treat A-Z and the bytes 0x20 and 0x09-0x0D only; blocks get the same from split_words()."""
    return [*text.lower().split(), END]


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words of all texts, words of each text), as tokens() has them, but with empty words beside white space at a text's ends. Null: empty."""
    large = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    lower = pc.ascii_lower(texts.view(pa.large_string() if large else pa.string()).fill_null(""))
    found = pc.ascii_split_whitespace(lower)
    return found.flatten(), pc.list_value_length(found).to_numpy(zero_copy_only=False)


def numbered(parts: list[tuple[pa.Array, np.ndarray]]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(different tokens as they come, numbers of all texts' tokens, tokens of each text) of what split_words() gave."""
    coded = pa.chunked_array([words for words, _ in parts]).dictionary_encode().combine_chunks()
    words, flat = coded.dictionary.cast(pa.large_binary()).to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
    # the end takes the number of the empty word
    end = words.index(b"") if b"" in words else len(words)
    words[end : end + 1] = [END]
    real = flat != end
    ends = np.r_[0, np.cumsum(real, dtype=np.int32)][np.cumsum(np.concatenate([n for _, n in parts]))]
    return words, np.insert(flat[real], ends, end), np.diff(ends, prepend=0).astype(np.int32) + 1


def word_class(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % CLASSES


def hashes_of(words) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64)


def packed(*arrays: np.ndarray) -> bytes:
    """The arrays, compressed; unpacked() gives them back.

    Values go by byte planes, all first bytes, then all second ones; ascending hashes as differences.
    """
    head, parts = [], []
    for x in arrays:
        rising = x.dtype == np.uint64 and len(x) > 1 and bool((x[1:] >= x[:-1]).all())
        head.append(f"{x.dtype.str}:{len(x)}:{int(rising)}")
        x = np.diff(x, prepend=np.uint64(0)) if rising else x
        parts.append(np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T).tobytes())
    return zstandard.ZstdCompressor(level=3).compress(",".join(head).encode() + b"\n" + b"".join(parts))


def unpacked(body: bytes) -> list[np.ndarray]:
    whole = zstandard.ZstdDecompressor().decompress(body)
    at, out = whole.index(b"\n") + 1, []
    for spec in whole[: at - 1].decode().split(","):
        name, n, rising = spec.split(":")
        kind, n = np.dtype(name), int(n)
        flat = np.frombuffer(whole, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        values = np.ascontiguousarray(flat.T).view(kind).ravel() if n else np.empty(0, kind)
        out.append(np.cumsum(values, dtype=np.uint64) if rising == "1" else values)
        at += n * kind.itemsize
    return out


def short_floats(values: np.ndarray) -> np.ndarray:
    """The three high bytes of 32-bit floats: relative errors under 2^-15."""
    return np.ascontiguousarray(values.astype("<f4").view(np.uint8).reshape(-1, 4)[:, 1:].T).ravel()


def long_floats(flat: np.ndarray) -> np.ndarray:
    whole = np.zeros((len(flat) // 3, 4), np.uint8)
    whole[:, 1:] = flat.reshape(3, -1).T
    return whole.reshape(-1).view("<f4").astype(np.float64)


def different(values: np.ndarray) -> np.ndarray:
    """In ascending order."""
    values = np.sort(values)
    return values[np.r_[True, values[1:] != values[:-1]][: len(values)]]


def hash_order(hashed: np.ndarray) -> np.ndarray:
    """The places of different hashes in ascending order."""
    low = np.uint64((1 << len(hashed).bit_length()) - 1)
    # the place stands in the low bits; hashes that the high ones don't tell apart are rare
    order = (np.sort(hashed & ~low | np.arange(len(hashed), dtype=np.uint64)) & low).astype(np.int64)
    found = hashed[order]
    return order if (found[1:] > found[:-1]).all() else np.argsort(hashed, kind="stable")


def bucket_of(hashed: np.ndarray, buckets: int) -> np.ndarray:
    """Ascending with the hash."""
    return ((hashed >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def ranges(hashed: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, first, end) of each bucket with some of the ascending hashes."""
    own = bucket_of(hashed, buckets)
    heads = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.empty(0, np.int64)
    return zip(own[heads].tolist(), heads.tolist(), [*heads[1:].tolist(), len(own)])


def message(place: int, kind: int, origin: int, *arrays: np.ndarray, n: int = 0, x: float = 0.0) -> tuple:
    return place, kind, origin, n, x, packed(*arrays)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.binary())
    columns = zip(*rows) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["place", "kind", "origin", "n", "x", "body"])


def _messages(df: DataFrame, function) -> DataFrame:
    """Each message's answers, by mapInArrow; function takes (place, kind, origin, body)."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                place, kind, origin, body = (batch.column(c)[i].as_py() for c in ("place", "kind", "origin", "body"))
                yield _batch(function(place, kind, origin, body))

    return map_arrow(df, run, MESSAGE)


def _gathered(df: DataFrame, function, schema: str = MESSAGE) -> DataFrame:
    """The answers of all messages to a place together; function takes (place, kind, origin and body of each, in order)."""

    def run(table: pa.Table) -> pa.Table:
        kinds, origins, body = table.column("kind").to_pylist(), table.column("origin").to_pylist(), table.column("body")
        order = sorted(range(len(kinds)), key=lambda i: (kinds[i], origins[i]))
        found = function(table.column("place")[0].as_py(), ((kinds[i], origins[i], body[i].as_buffer()) for i in order))
        release_memory()
        return found if isinstance(found, pa.Table) else pa.Table.from_batches([_batch(found)])

    return df.groupBy("place").applyInArrow(run, schema)


def _blocks(docs: DataFrame, buckets: int) -> DataFrame:
    """BLOCK messages: texts as word numbers, words by hash; WORDS: each block's words and their training counts."""

    def run(batches):
        part, number, size, ids, texts = TaskContext.get().partitionId(), 0, 0, [], []

        def flush() -> pa.RecordBatch:
            # words are numbered as they come, so that frequent ones have small numbers
            words, flat, lengths = numbered(texts)
            texts.clear()
            hashed = hashes_of(words)
            order = hash_order(hashed)
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order), dtype=np.int32)
            train = np.repeat([not held_out(i) for i in ids], lengths)
            count = np.bincount(rank[flat[train]], minlength=len(order)).astype(np.uint32)
            by_appearance, hashed, kinds = hashed, hashed[order], np.fromiter(map(word_class, words), np.int16, len(words))
            known = np.array([i is not None for i in ids])
            block = part << 24 | number
            rows = [message(block, BLOCK, 0, np.array([i or 0 for i in ids], np.int64), known, lengths, flat, by_appearance, kinds)]
            rows += [message(b, WORDS, block, hashed[i:j], count[i:j]) for b, i, j in ranges(hashed, buckets)]
            return _batch(rows)

        for batch in slices(batches):
            doc_ids, column = batch.column("doc_id").to_pylist(), batch.column("text")
            first = 0
            for i, n in enumerate(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
                if size and size + n > BLOCK_BYTES:
                    if i > first:
                        texts.append(split_words(column.slice(first, i - first)))
                        ids += doc_ids[first:i]
                    yield flush()
                    number, size, ids, first = number + 1, 0, [], i
                size += n + 1
            texts.append(split_words(column.slice(first)))
            ids += doc_ids[first:]
        if texts:
            yield flush()

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, MESSAGE)


def part_names(context: int | np.ndarray, part: np.ndarray) -> np.ndarray:
    """The hashes that parts of a split context go by."""
    return (np.atleast_1d(np.asarray(context, np.uint64)) ^ (part.astype(np.uint64) + np.uint64(1)) * _ODD) * _ODD


def opened_block(body: bytes) -> list[np.ndarray]:
    """(ids, whether there is one, lengths, words by number, hashes, classes); numbers are the hashes' order."""
    ids, known, lengths, flat, hashed, kinds = unpacked(body)
    order = hash_order(hashed)
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    return [ids, known, lengths, rank[flat], hashed[order], kinds[order]]


class Pairs:
    """The different pairs of a block, by context and word; split contexts have a hash for each part."""

    def __init__(self, arrays: list[np.ndarray], split: dict[int, int]):
        ids, known, lengths, flat, hashed, kinds = arrays
        starts = np.cumsum(lengths) - lengths
        # contexts are numbered by hash, as words are; the beginning is a word of its own among them
        begin = int(np.searchsorted(hashed, hashes_of([BEGINNING])[0]))
        contexts = np.insert(hashed, begin, hashes_of([BEGINNING]))
        classes = np.insert(kinds.astype(np.int16), begin, word_class(BEGINNING))
        before = np.empty(len(flat), np.int32)
        before[1:] = flat[:-1] + (flat[:-1] >= begin)
        before[starts] = begin
        width = max(1, len(hashed))
        key, order = seating.ordered(before * np.int64(width) + flat, len(contexts) * width)
        head = np.ones(len(key), bool)
        np.not_equal(key[1:], key[:-1], out=head[1:])
        del key
        first = order[head]
        context, word = before[first], flat[first]
        del before, first
        place = np.empty(len(flat), np.int32)
        place[order] = np.cumsum(head, dtype=np.int32) - 1
        del order, head
        train = np.repeat([k and not held_out(int(i)) for i, k in zip(ids, known)], lengths)
        count = np.bincount(place[train], minlength=len(word)).astype(np.uint32)
        # runs of pairs with one context, or one part of it; words are numbered by hash, so their order is the words'
        new = np.r_[True, context[1:] != context[:-1]][: len(context)]
        parts = np.zeros(len(contexts), np.uint64)
        if split:
            many = np.flatnonzero(np.isin(contexts, np.array(list(split), np.uint64)))
            parts[many] = [split[c] for c in contexts[many].tolist()]
        own = np.flatnonzero(parts[context])
        part = bucket_of(hashed[word[own]] * _ODD, parts[context[own]])
        moved = np.arange(len(word))
        if len(own):
            dealt = np.lexsort((part, context[own]))
            moved[own], part = own[dealt], part[dealt]
            new[own[1:]] |= part[1:] != part[:-1]
        self.heads = np.flatnonzero(new)
        self.rooms, self.kinds = contexts[context[self.heads]], classes[context[self.heads]]
        at = np.searchsorted(self.heads, own[new[own]])
        self.rooms[at], self.kinds[at] = part_names(self.rooms[at], part[new[own]]), seating.SPLIT
        self.runs = np.diff(np.r_[self.heads, len(word)])
        if len(own):
            runs = np.argsort(self.rooms)
            self.rooms, self.kinds, self.runs, heads = self.rooms[runs], self.kinds[runs], self.runs[runs], self.heads[runs]
            self.heads = np.cumsum(self.runs) - self.runs
            moved = moved[np.repeat(heads - self.heads, self.runs) + np.arange(len(word))]
            rank = np.empty(len(moved), np.int32)
            rank[moved] = np.arange(len(moved), dtype=np.int32)
            place, word, count = rank[place], word[moved], count[moved]
        self.runs = self.runs.astype(np.uint32)
        self.place, self.word, self.count, self.hashed = place, word, count, hashed


def _pairs(blocks: DataFrame, buckets: int, split: dict[int, int]) -> DataFrame:
    def run(block, kind, origin, body):
        own = Pairs(opened_block(body), split)
        ends, number = np.append(own.heads, len(own.word)), np.empty(len(own.hashed), np.uint32)
        rows = []
        for b, i, j in ranges(own.rooms, buckets):
            pairs = slice(ends[i], ends[j])
            # the words once, then their places
            words = different(own.word[pairs])
            number[words] = np.arange(len(words), dtype=np.uint32)
            place = number[own.word[pairs]]
            rows.append(message(b, PAIRS, block, own.rooms[i:j], own.kinds[i:j], own.runs[i:j], own.hashed[words], place, own.count[pairs]))
        return rows

    return _messages(blocks, run)


def _counts(words: DataFrame) -> DataFrame:
    """COUNTS: a bucket's training words, by hash, and their counts; n: tokens, x: words."""

    def run(place, messages):
        words, counts = zip(*(unpacked(body) for _, _, body in messages))
        kinds, at = np.unique(np.concatenate(words), return_inverse=True)
        total = np.bincount(at, np.concatenate(counts), len(kinds)).astype(np.int64)
        kinds, total = kinds[total > 0], total[total > 0]
        return [message(place, COUNTS, 0, kinds, total, n=int(total.sum()), x=float(len(kinds)))]

    return _gathered(words, run)


def _split(counts: DataFrame, total: int) -> dict[int, int]:
    """The contexts to split and their parts; the beginning is as frequent as the end."""
    bar = max(SPLIT_TOKENS, total // MOST_SPLIT)

    def run(batches):
        for batch in batches:
            for body in batch.column("body"):
                words, count = unpacked(body.as_py())
                large = count >= bar
                yield pa.RecordBatch.from_arrays([pa.array(words[large].view(np.int64)), pa.array(count[large])], names=["word", "c"])

    found = {r.word & (2**64 - 1): -(-r.c // bar) for r in map_arrow(counts.select("body"), run, "word long, c long").collect()}
    end, begin = (int(hashes_of([w])[0]) for w in (END, BEGINNING))
    return found | ({begin: found[end]} if end in found else {})


def _cells(pairs: DataFrame, buckets: int) -> DataFrame:
    """CELLS: a bucket's contexts and the training counts of their words; TABLES: a table for each class and word."""

    def run(place, messages):
        rooms, kinds, dishes, parts = [], [], [], []
        for _, _, body in messages:
            own, classes, runs, words, at, n = unpacked(body)
            # only what training documents have: the words, the contexts and their pairs
            seen = np.flatnonzero(n)
            used = np.zeros(len(words), bool)
            used[at[seen]] = True
            room = np.repeat(np.arange(len(own), dtype=np.int32), runs)[seen]
            there = np.zeros(len(own), bool)
            there[room] = True
            rooms.append(own[there])
            kinds.append(classes[there])
            dishes.append(words[used])
            parts.append(((np.cumsum(there, dtype=np.int32) - 1)[room], (np.cumsum(used, dtype=np.int32) - 1)[at[seen]], n[seen]))
        own, words = rooms, dishes
        rooms, first = np.unique(np.concatenate(own), return_index=True)
        kinds, dishes = np.concatenate(kinds)[first], different(np.concatenate(words))
        width, counts = max(1, len(dishes)), np.concatenate([n for _, _, n in parts])
        key, end = np.empty(len(counts), np.int64), 0
        for i, (a, w) in enumerate(zip(own, words)):
            room, dish, n = parts[i]
            parts[i], end = None, end + len(n)
            key[end - len(n) : end] = np.searchsorted(rooms, a)[room] * width + np.searchsorted(dishes, w)[dish]
        key, order = seating.ordered(key, len(rooms) * width)
        head = np.ones(len(key), bool)
        np.not_equal(key[1:], key[:-1], out=head[1:])
        counts, heads, key = counts[order], np.flatnonzero(head), key[head]
        del order, head
        total = np.add.reduceat(counts, heads, dtype=np.int64) if len(heads) else np.empty(0, np.int64)
        total = total.astype(np.uint32) if total.max(initial=0) < 2**32 else total
        del counts, heads
        room, dish = np.divmod(key, width)
        del key
        bodies = rooms, kinds, np.bincount(room, minlength=len(rooms)).astype(np.uint32), dishes, dish.astype(np.int32), total
        del room, dish
        own = _bucket(bodies, {})
        return [message(place, CELLS, 0, *bodies), *_tables(place, own, seating.first_tables(own), dishes, buckets)]

    return _gathered(pairs, run)


def _bucket(arrays: list[np.ndarray], whole: dict[int, tuple[int, int]]) -> seating.Bucket:
    """whole: customers and cells in all parts of each split context, by part."""
    rooms, kinds, runs, dishes, dish, count = arrays
    room = np.repeat(np.arange(len(rooms), dtype=np.int32), runs)
    customers, cells = np.bincount(room, count, len(rooms)), np.asarray(runs, float)
    scale = np.ones(len(rooms))
    for i in np.flatnonzero(kinds == seating.SPLIT):
        if (known := whole.get(int(rooms[i]))) is not None:
            customers[i], scale[i] = known[0], known[1] / cells[i]
    return seating.Bucket(room, dish, count, kinds.astype(np.int64), customers, scale, len(dishes))


def _tables(place: int, own: seating.Bucket, up: np.ndarray, dishes: np.ndarray, buckets: int) -> list[tuple]:
    """TABLES messages to the buckets of words; need: words that can move, whose probabilities are asked for."""
    need = np.bincount(own.dish, own.count, len(dishes)) > 1
    return [message(b, TABLES, place, dishes[i:j], up[i:j], need[i:j], n=int(up[i:j].sum())) for b, i, j in ranges(dishes, buckets)]


def _wholes(cells: DataFrame, split: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Customers and cells of each split context in all its parts, by part; there are few."""
    if not split:
        return {}

    def run(batches):
        for batch in batches:
            for body in batch.column("body"):
                rooms, kinds, runs, _, _, count = unpacked(body.as_py())
                runs, own = runs.astype(np.int64), kinds == seating.SPLIT
                customers = np.add.reduceat(count, np.cumsum(runs) - runs, dtype=np.int64) if len(runs) else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(rooms[own].view(np.int64)), pa.array(customers[own]), pa.array(runs[own])], names=["room", "c", "cells"])

    found = {r.room & (2**64 - 1): (r.c, r.cells) for r in map_arrow(cells.select("body"), run, "room long, c long, cells long").collect()}
    out = {}
    for word, parts in split.items():
        names = part_names(word, np.arange(parts)).tolist()
        sums = [sum(x) for x in zip(*(found[n] for n in names if n in found))]
        out |= {n: tuple(sums) for n in names if n in found}
    return out


def _root(messages: DataFrame, customers: int) -> DataFrame:
    """PRIOR: the root's probabilities of the words that TABLES ask for; KNOWN: counts and probabilities of a block's words; x: discounts."""

    def run(place, messages):
        words, count, up, asked, blocks, rows = np.empty(0, np.uint64), np.empty(0, np.int64), None, [], [], []
        for kind, origin, body in messages:
            arrays = unpacked(body)
            if kind == WORDS:
                blocks.append((origin, body))
            elif kind == COUNTS:
                words, count = arrays
                up = np.zeros(len(words), np.int64)
            else:
                at = np.searchsorted(words, arrays[0])
                up[at] += arrays[1]
                asked.append((origin, at[arrays[2]]))
        if up is None:
            up = np.zeros(0, np.int64)
        d = seating.discount(up)
        p = (up - d) / (seating.STRENGTH + customers)
        for origin, at in asked:
            rows.append(message(origin, PRIOR, place, p[at].astype(np.float32)))
        for origin, body in blocks:
            own = unpacked(body)[0]
            at = seating._found(words, own)
            rows.append(message(origin, KNOWN, place, np.append(count, 0)[at], np.append(p, 0)[at].astype(np.float32)))
        # kept apart from the answers: what all words' tables leave to unseen ones
        rows.append(message(-1, COUNTS, place, x=d * len(words)))
        return rows

    return _gathered(messages, run)


def _opened(messages) -> tuple[list[np.ndarray], np.ndarray, Iterator]:
    """Cells, P(dish | root) and the rest of the messages to a bucket of contexts."""
    cells, prior, rest = None, [], []
    for kind, origin, body in messages:
        if kind == CELLS:
            cells = unpacked(body)
        elif kind == PRIOR:
            prior.append(unpacked(body)[0])
        else:
            rest.append((origin, body))
    if cells is None:
        none = np.empty(0, np.int64)
        cells = [none.astype(np.uint64), none.astype(np.int16), none.astype(np.uint32), none.astype(np.uint64), none.astype(np.int32), none]
    need = np.bincount(cells[4], cells[5], len(cells[3])) > 1
    p = np.zeros(len(need))
    p[need] = np.concatenate(prior) if prior else 0.0
    return cells, p, rest


def _resampled(messages: DataFrame, buckets: int, whole: dict) -> DataFrame:
    """TABLES of the contexts' buckets after Gibbs sweeps."""

    def run(place, messages):
        cells, prior, _ = _opened(messages)
        made = seating.Restaurants(_bucket(cells, whole))
        made.sweeps(prior, place)
        return _tables(place, made.bucket, made.sent_up(), cells[3], buckets)

    return _gathered(messages, run)


def _answers(messages: DataFrame, whole: dict) -> DataFrame:
    """SHARES: averaged probabilities of each block's pairs, as share + rest * P(word | root)."""

    def run(place, messages):
        cells, prior, asked = _opened(messages)
        rooms, _, _, dishes, _, _ = cells
        made = seating.Restaurants(_bucket(cells, whole))
        kept = made.sweeps(prior, place + (1 << 40), seating.KEPT)
        made.close()
        release_memory()
        rows = []
        for origin, body in asked:
            own, kinds, runs, words, at, _ = unpacked(body)
            share, rest = made.shares(kept, seating._found(rooms, own), kinds.astype(np.int64), seating._found(dishes, words)[at], np.repeat(np.arange(len(own)), runs))
            rows.append(message(origin, SHARES, place, short_floats(share), short_floats(rest)))
        return rows

    return _gathered(messages, run)


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scores(messages: DataFrame, split: dict[int, int], total: int, kinds: int, unseen: float) -> DataFrame:
    def run(place, messages):
        known, shares, arrays = [], [], None
        for kind, _, body in messages:
            if kind == BLOCK:
                arrays = opened_block(body)
            elif kind == KNOWN:
                known.append(unpacked(body))
            else:
                shares.append([long_floats(x) for x in unpacked(body)])
        count, prior = (np.concatenate(v) for v in zip(*known))
        share, rest = (np.concatenate(v) for v in zip(*shares))
        ids, has_id, lengths, flat, _, _ = arrays
        own = Pairs(arrays, split)
        prior = np.where(count > 0, prior, unseen)
        score = np.log10(share + np.repeat(rest, own.runs) * prior[own.word])
        base = np.log10((count + ADDED) / (total + ADDED * (kinds + 1)))
        starts = np.cumsum(lengths) - lengths
        return pa.table({
            "doc_id": pa.array(ids, mask=~has_id),
            "held_out": [not k or held_out(int(i)) for i, k in zip(ids, has_id)],
            "n_tokens": lengths.astype(np.int64),
            "n_known": np.add.reduceat((count > 0)[flat].astype(np.int64), starts),
            "train_tokens": np.full(len(ids), total),
            "base_score": np.add.reduceat(base[flat], starts),
            "score": np.add.reduceat(score[own.place], starts),
        })

    return _gathered(messages, run, SCORED)


def score_documents(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of documents (doc_id, text)."""
    space = Workspace(docs.sparkSession, "model")
    buckets = max(1, -(-int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // bucket_bytes))
    read = space.write(_blocks(docs, buckets), "read", "kind")
    blocks, words = read.filter(F.col("kind") == BLOCK), read.filter(F.col("kind") == WORDS)
    counts = space.write(_counts(words), "counts")
    total, kinds = (int(v or 0) for v in counts.agg(F.sum("n"), F.sum("x")).first())
    split = _split(counts, total)
    # pairs are worked out anew each time they are sent: keeping them would take more disk than anything else
    made = space.write(_cells(_pairs(blocks, buckets, split), buckets), "cells", "kind")
    cells, tables = made.filter(F.col("kind") == CELLS), made.filter(F.col("kind") == TABLES)
    whole = _wholes(cells, split)
    sums = lambda sent: int(sent.agg(F.sum("n")).first()[0] or 0)
    prior = space.write(_root(counts.unionByName(tables), sums(tables)).filter("place >= 0"), "prior1")
    space.drop(f"cells/kind={TABLES}")
    tables = space.write(_resampled(cells.unionByName(prior), buckets, whole), "tables")
    space.drop("prior1")
    customers = sums(tables)
    root = space.write(_root(counts.unionByName(tables).unionByName(words), customers), "root", "kind")
    space.drop("tables", "counts", f"read/kind={WORDS}")
    left = root.filter(F.col("kind") == COUNTS).agg(F.sum("x")).first()[0] or 0.0
    asked = cells.unionByName(root.filter(F.col("kind") == PRIOR)).unionByName(_pairs(blocks, buckets, split))
    shares = space.write(_answers(asked, whole), "shares")
    space.drop("cells")
    unseen = (seating.STRENGTH + left) / (seating.STRENGTH + customers)
    return _scores(blocks.unionByName(root.filter(F.col("kind") == KNOWN)).unionByName(shares), split, total, kinds, unseen)


def perplexity(scored: DataFrame) -> float:
    """Of the held-out documents, a token."""
    row = scored.filter("held_out").agg(F.sum("score"), F.sum("n_tokens")).first()
    return 10 ** (-row[0] / row[1])


def op1_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir))
