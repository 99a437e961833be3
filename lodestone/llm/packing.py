"""Mixture-controlled packing by deficit round-robin over source queues.

Each source is a queue, the token stream of its documents. Windows of 2048 tokens are filled from the queues in
proportion to target weights: every window adds each queue's share to its deficit, queues whose deficit reaches
min_piece are served in turn, and what a window couldn't serve is carried on to the next.

A schedule is a list of phases. In a phase every active queue gives a whole number of tokens to each cycle of
windows, so deficits are back at zero when a cycle ends and all cycles of a phase are alike; a phase lasts until a
queue can't fill its share of a cycle, and the next one goes on with the rest. The window of any token therefore
follows from its place in its queue by arithmetic, and partitions are packed without waiting for one another: the
place is the queue's tokens in earlier partitions, a running sum over (partition, source) totals, plus those before
it in its own. The schedule's size is bounded by the number of queues and of windows in a cycle.

Every window is full; the last tokens, under a window, make sequences whose lengths are powers of two, so nothing is
padded. Without given weights the weights are what each queue has left, the mixture of the whole corpus.

The `queues` - 1 largest sources have queues of their own; all others, however many, share one that serves them by
weighted fair queueing: their documents come in the order of (source tokens before the document) / weight, so that
every stretch of the queue has its sources in proportion to their weights (their sizes, if none are given) as long as
they last. The queue's weight is the sum of theirs. Its places are running sums over slots of that order.

Defined results. A null or empty text is a document of one token, the end id. A null source is the source "". Rows
that share a doc_id, or are alike, are packed as documents of their own. A very long text is cut into pieces as any
other. Of an empty table nothing comes. Columns other than doc_id, source and text are left alone, whatever their
names.
"""

from __future__ import annotations

import functools
import json
import zlib
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrow import map_arrow, map_slices, slices
from .bpe import SPLIT, VOCABULARY, byte_alphabet
from .workspace import Workspace, documents

WINDOW, CYCLE, MIN_PIECE, QUEUES, END_ID = 2048, 64, 256, 256, 1
#: Tokens to a slot of the shared queue, and the most slots.
SLOT_TOKENS, MOST_SLOTS = 1 << 20, 1 << 16


@dataclass(frozen=True)
class Part:
    """What one queue gives to a phase: its tokens from `start` on, `share` to each cycle.

    cuts: where the pieces of a cycle begin, in the queue's tokens of the cycle; sequence, offset: where they go.
    """

    start: int
    share: int
    cuts: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray


@dataclass(frozen=True)
class Phase:
    first: int
    cycles: int
    windows: int
    parts: dict[int, Part]


def apportion(total: int, weights: dict[int, float]) -> dict[int, int]:
    """Whole shares of total by largest remainders."""
    whole = sum(weights.values())
    exact = {k: total * w / whole for k, w in weights.items()}
    shares = {k: int(x) for k, x in exact.items()}
    for k in sorted(exact, key=lambda k: (shares[k] - exact[k], k))[: total - sum(shares.values())]:
        shares[k] += 1
    return shares


def serve_cycle(sizes: list[int], shares: dict[int, int], min_piece: int) -> list[tuple[int, int, int, int, int]]:
    """(queue, place in its share, length, window, offset) of each piece, by deficit round-robin."""
    total = sum(sizes)
    order, left, turn = sorted(shares), dict(shares), 0
    deficit = dict.fromkeys(order, 0.0)
    pieces = []
    for window, size in enumerate(sizes):
        for q in order:
            deficit[q] += shares[q] * size / total
        offset = 0
        while offset < size:
            for i in range(len(order)):
                q = order[(turn + i) % len(order)]
                if left[q] and deficit[q] >= min_piece:
                    turn = (turn + i + 1) % len(order)
                    break
            else:
                q = max((q for q in order if left[q]), key=lambda q: deficit[q])
            length = min(size - offset, left[q], max(int(deficit[q]), min_piece))
            pieces.append((q, shares[q] - left[q], length, window, offset))
            left[q] -= length
            deficit[q] -= length
            offset += length
    return pieces


def schedule(totals: dict[int, int], weights: dict[int, float] | None = None, window: int = WINDOW, cycle: int = CYCLE, min_piece: int = MIN_PIECE) -> list[Phase]:
    """The phases that use up all tokens of the queues."""
    left, phases, first = {q: n for q, n in totals.items() if n}, [], 0
    while left:
        rest = sum(left.values())
        if rest <= window * cycle:
            # the end: whole windows, then powers of two
            sizes = [window] * (rest // window) + [1 << b for b in reversed(range(window.bit_length())) if rest % window >> b & 1]
            shares, cycles = dict(left), 1
        else:
            sizes = [window] * cycle
            wanted = {q: (weights or left).get(q, 0) for q in left}
            wanted = wanted if any(wanted.values()) else dict(left)
            shares = apportion(window * cycle, wanted)
            if any(shares[q] > left[q] for q in left):
                # some queue ends within the next cycle: it gives what it has, the others the rest
                short = {q: left[q] for q in left if shares[q] >= left[q]}
                others = {q: wanted[q] for q in left if q not in short}
                others = others if any(others.values()) else {q: left[q] for q in others}
                room = window * cycle - sum(short.values())
                shares = short | apportion(room, others)
                if any(shares[q] > left[q] for q in left):
                    shares = apportion(window * cycle, left)
            cycles = min(left[q] // shares[q] for q in left if shares[q])
        shares = {q: n for q, n in shares.items() if n}
        pieces = serve_cycle(sizes, shares, min_piece)
        parts = {}
        for q in shares:
            own = np.array([p[1:] for p in pieces if p[0] == q], np.int64)
            parts[q] = Part(totals[q] - left[q], shares[q], own[:, 0], own[:, 2], own[:, 3])
            left[q] -= shares[q] * cycles
        phases.append(Phase(first, cycles, len(sizes), parts))
        first += len(sizes) * cycles
        left = {q: n for q, n in left.items() if n}
    return phases


def pieces_of(phases: list[Phase], queue: int, start: int, length: int) -> np.ndarray:
    """Rows (place in the document, length, sequence, offset) of a document at `start` of its queue."""
    rows = []
    for phase in phases:
        if (part := phase.parts.get(queue)) is None:
            continue
        a, b = max(start, part.start), min(start + length, part.start + part.share * phase.cycles)
        if a >= b:
            continue
        low, high = a - part.start, b - part.start
        begun = low // part.share
        span = np.arange(begun, (high - 1) // part.share + 1)
        cuts = (span[:, None] * part.share + part.cuts).ravel()
        sequence = (phase.first + span[:, None] * phase.windows + part.sequence).ravel()
        offset = np.tile(part.offset, len(span))
        i, j = np.searchsorted(cuts, low, "right") - 1, np.searchsorted(cuts, high, "left")
        begins = np.maximum(cuts[i:j], low)
        ends = np.minimum(np.append(cuts[i + 1 : j], high), high)
        rows.append(np.stack([begins - low + a - start, ends - begins, sequence[i:j], offset[i:j] + begins - cuts[i:j]], axis=1))
    return np.concatenate(rows)


class Encoder:
    """Token ids as the tokenizers library gives them for a file, by tiktoken where the file is a rank-ordered byte-level BPE."""

    def __init__(self, path: str):
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocabulary, alphabet = spec["model"]["vocab"], byte_alphabet()
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"].get("merges", [])]
        made = [vocabulary.get(a + b, -1) for a, b in merges]
        before = spec["pre_tokenizer"] or {}
        self.size = 1 + max([*vocabulary.values(), *(t["id"] for t in spec["added_tokens"])])
        self.fast = None
        if made == sorted(made) and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and not spec["normalizer"]:
            ranks = {bytes(alphabet[c] for c in token): i for token, i in vocabulary.items()}
            pattern = SPLIT.replace(r"\p{White_Space}", r"\s").replace(r"\P{White_Space}", r"\S")
            specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
            self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=specials)

    @functools.cached_property
    def library(self):
        """Loaded where it is needed only: its tables are large."""
        import tokenizers

        made = tokenizers.Tokenizer.from_file(self.path)
        made.no_truncation()
        made.no_padding()
        return made

    def encode(self, text: str) -> np.ndarray:
        if self.fast is not None:
            try:
                return self.fast.encode_to_numpy(text, allowed_special="all")
            except ValueError as error:
                # the backtracking limit, on very long runs of white space
                if "backtracking" not in str(error):
                    raise
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _tokens(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, source, part, place, n_tokens, ids): place counts the source's tokens before it in its partition."""

    def run(batches):
        part, places = TaskContext.get().partitionId(), {}
        kind = "<u2" if encoder(path).size < 1 << 16 else "<u4"
        for batch in slices(batches):
            ids = [np.append(encoder(path).encode(x or ""), END_ID).astype(kind) for x in batch.column("text").to_pylist()]
            sources = [x or "" for x in batch.column("source").to_pylist()]
            place = []
            for source, own in zip(sources, ids):
                place.append(places.get(source, 0))
                places[source] = place[-1] + len(own)
            columns = [batch.column("doc_id"), pa.array(sources), pa.array([part] * len(ids), pa.int32()), pa.array(place, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "source", "part", "place", "n_tokens", "ids"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text")
    return map_arrow(chosen, run, "doc_id long, source string, part int, place long, n_tokens long, ids binary")


def _shared(placed: DataFrame, sources: DataFrame, tokens: int, queue: int, space: Workspace) -> DataFrame:
    """placed documents of the sources (source, n, weight), with queue and start, by weighted fair queueing."""
    slots = max(1, min(MOST_SLOTS, tokens // SLOT_TOKENS))
    # a source without a weight waits until those that have one are through
    last = sources.agg(F.max(F.when(F.col("weight") > 0, F.col("n") / F.col("weight")))).first()[0] or 0.0
    turn = F.when(F.col("weight") > 0, F.col("at") / F.col("weight")).otherwise(last + F.col("at") / F.col("n"))
    timed = placed.join(sources, "source").withColumn("turn", turn)
    timed = timed.withColumn("slot", F.least(F.lit(slots - 1), F.floor(F.col("turn") / (last + 1) * slots)).cast("int")).drop("n", "weight")
    sums = {r.slot: r.n for r in timed.groupBy("slot").agg(F.sum("n_tokens").alias("n")).collect()}
    before, bases = 0, []
    for slot in sorted(sums):
        bases.append((slot, before))
        before += sums[slot]
    base = placed.sparkSession.createDataFrame(bases, "slot int, base long")
    earlier = Window.partitionBy("slot").orderBy("turn", "source", "part", "place").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("base") + F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0))
    # at most MOST_SLOTS pairs of numbers: a proven bound for a broadcast
    return timed.join(F.broadcast(base), "slot").withColumn("start", start).withColumn("queue", F.lit(queue)).drop("turn", "slot", "base")


def pack_documents(docs: DataFrame, path: str | None = None, weights: dict[str, float] | None = None, queues: int = QUEUES) -> DataFrame:
    """The pieces of all documents (doc_id, source, text): (doc_id, start, ids, doc_tokens, sequence_id, offset).

    weights: target token proportions by source; while other sources last, one without a weight isn't served.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    space = Workspace(docs.sparkSession, "packing")
    tokens = space.write(_tokens(docs, path), "tokens")
    sums = space.write(tokens.groupBy("part", "source").agg(F.sum("n_tokens").alias("n")), "sums")
    by_source = space.write(sums.groupBy("source").agg(F.sum("n").alias("n")), "sources")
    largest = by_source.orderBy(F.desc("n"), "source").limit(queues).collect()
    own = {r.source: (i, r.n) for i, r in enumerate(largest if len(largest) < queues else largest[: queues - 1])}
    totals, given = {i: n for i, n in own.values()}, weights and {i: float(weights.get(s, 0)) for s, (i, _) in own.items()}
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("part", "source", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # read back from a file, so that its size is known: small, it is broadcast; large, it is joined by its keys
    placed = tokens.join(space.write(bases, "bases"), ["part", "source"]).withColumn("at", F.col("base") + F.col("place")).drop("base")
    number = F.create_map(*(F.lit(x) for s, (i, _) in own.items() for x in (s, i)))[F.col("source")] if own else F.lit(None).cast("int")
    alone = placed.withColumn("queue", number)
    chosen = alone.filter(F.col("queue").isNotNull()).withColumnRenamed("at", "start").select("doc_id", "queue", "start", "n_tokens", "ids")
    if len(largest) == queues:
        rest = by_source.filter(~F.col("source").isin(list(own)))
        weight = F.coalesce(F.create_map(*(F.lit(x) for s, w in weights.items() for x in (s, float(w))))[F.col("source")], F.lit(0.0)) if weights else F.col("n").cast("double")
        rest = space.write(rest.withColumn("weight", weight), "rest")
        total, whole = rest.agg(F.sum("n"), F.sum("weight")).first()
        totals[queues - 1] = total
        if given is not None:
            given[queues - 1] = whole
        pooled = alone.filter(F.col("queue").isNull()).drop("queue")
        chosen = chosen.unionByName(_shared(pooled, rest, total, queues - 1, space).select("doc_id", "queue", "start", "n_tokens", "ids"))
    phases = schedule(totals, given)
    wide = 2 if encoder(path).size < 1 << 16 else 4

    def cut(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset")}
        for doc_id, queue, start, n, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "queue", "start", "n_tokens", "ids"))):
            values = np.frombuffer(ids, f"<u{wide}").astype("<u4")
            for a, length, sequence, offset in pieces_of(phases, queue, start, n).tolist():
                for k, x in zip(out, (doc_id, a, values[a : a + length].tobytes(), n, sequence, offset)):
                    out[k].append(x)
        return out

    return map_slices(chosen, cut, "doc_id long, start long, ids binary, doc_tokens long, sequence_id long, offset long")


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids): each sequence's pieces joined, as little-endian unsigned 32-bit ids."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids"))))
    return pieces.groupBy("sequence_id").agg(F.unhex(F.array_join(F.transform(ordered, lambda x: x["ids"]), "")).alias("ids"))


def packed_pieces(docs: DataFrame) -> DataFrame:
    """The pieces' places and checksums."""

    def run(batch: pa.RecordBatch) -> dict:
        ids = batch.column("ids").to_pylist()
        same = {c: batch.column(c) for c in ("doc_id", "start", "doc_tokens", "sequence_id", "offset")}
        return same | {"length": [len(x) // 4 for x in ids], "ids_crc32": [zlib.crc32(x) for x in ids]}

    return map_slices(pack_documents(docs), run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_pieces(documents(spark, sf_dir).select("doc_id", "source", "text"))
