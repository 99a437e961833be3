"""Near-duplicates by one-permutation hashing, optimal densification, banded buckets and star-shaped candidates.

1. A text's set of 5-word shingle hashes falls into 384 bins by its high bits; each bin keeps the low byte of its
   smallest hash. Every empty bin copies a filled bin: the first in a random order of bins of its own, the same for
   all texts (optimal densification). Texts with equal sets are one class, represented by the smallest doc_id.
2. Eight bins are a band, and a band's eight bytes a bucket key. At a similarity of 0.85 a pair misses all 48 bands
   with a probability of 3e-7. For lower thresholds six bins are a band: at 0.80 a pair misses all 64 with 4e-9.
3. In each bucket one member, by a hash of its own for each bucket, is compared with all others: a star.
4. Links are confirmed on whole shingle sets. Pairs whose sketches agree in under 60 % of the bins (0.85 lies over
   eight standard deviations above) aren't compared in full.
5. In the buckets whose members aren't all connected yet, the member with the most links so far is compared with all
   of other components. The members that still are outside their surroundings' largest component are a query set,
   held against all members in blocks of bounded size: first by sketches alone, then, with texts, those rows of a
   block that have a promising counterpart in another component. Members that are connected need no comparison, so no
   link that matters is lost, and no pairs are listed.

A class has a number of its own, so that rows that share a doc_id are each placed by their own text; a component is
named by the smallest doc_id of its classes at the end.

Defined results. A null, empty or blank text has an empty set, is linked with nothing and forms its own component.
Rows without doc_id are linked with nothing and have no component; they are kept. Rows that share a doc_id but not a
text can be of different components; a row is kept if its doc_id is its component's. Columns other than doc_id and
text are not looked at, whatever their names. Of an empty table nothing comes.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import map_slices, text_bytes
from .components import components
from .workspace import Workspace, documents

WORDS, PERCENT = 5, 85
BINS, ROWS, LOW_ROWS = 384, 8, 6
SKETCH_SHARE = 0.6
#: Members, queries and shingles of either that one task compares in the last step.
BLOCK, QUERIES, BLOCK_SHINGLES = 2000, 500, 4_000_000
SALTS = 32
#: Links that one task unites, and that are broadcast with the two components of each: a few MB.
FEW = 65_536
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the different shingles; bytes.lower() and split() treat ASCII letters and blanks only."""
    found = text.lower().split()
    if not found:
        return np.empty(0, np.uint64)
    codes = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    width = min(words, len(codes))
    count = len(codes) - width + 1
    hashed = np.full(count, width, np.uint64)
    for k in range(width):
        hashed = hashed * _MULTIPLIER + codes[k : k + count]
    return np.unique(_mixed(hashed))


@functools.cache
def _orders() -> np.ndarray:
    """Row i: each bin's rank in the order in which bin i, if empty, looks for a filled one (fixed by the seed)."""
    return np.random.default_rng(20240229).permuted(np.tile(np.arange(BINS, dtype=np.uint16), (BINS, 1)), axis=1)


def sketch(hashes: np.ndarray) -> bytes:
    """One byte a bin; hashes: sorted, at least one."""
    bins = ((hashes >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)
    filled, first = np.unique(bins, return_index=True)
    out = np.zeros(BINS, np.uint8)
    out[filled] = (hashes[first] & np.uint64(255)).astype(np.uint8)
    empty = np.ones(BINS, bool)
    empty[filled] = False
    if empty.any():
        spots = np.flatnonzero(empty)
        out[spots] = out[filled[_orders()[np.ix_(spots, filled)].argmin(axis=1)]]
    return out.tobytes()


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, print, n_shingles, same, sketch): same is a 128-bit hash of the set; both null where the set is empty.

    print: a hash of the text, which tells rows with one doc_id apart.
    """

    def run(batch: pa.RecordBatch) -> dict:
        sets = [shingles(t) for t in text_bytes(batch.column("text"))]
        return {
            "doc_id": batch.column("doc_id"),
            "print": batch.column("print"),
            "n_shingles": [len(s) for s in sets],
            "same": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
            "sketch": [sketch(s) if len(s) else None for s in sets],
        }

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("print"), "text")
    return map_slices(chosen, run, "doc_id long, print long, n_shingles long, same binary, sketch binary")


def buckets(classes: DataFrame, rows: int = ROWS) -> DataFrame:
    """(key, id) of each class and band of `rows` bins, eight at most."""
    salt = _mixed(np.arange(1, BINS // rows + 1, dtype=np.uint64))

    def run(batch: pa.RecordBatch) -> dict:
        cut = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(batch.num_rows, -1, rows)
        bands = np.pad(cut, ((0, 0), (0, 0), (0, 8 - rows))).view("<u8")[:, :, 0]
        ids = np.repeat(batch.column("id").to_numpy(zero_copy_only=False), bands.shape[1])
        return {"key": _mixed(bands ^ salt).view(np.int64).ravel(), "id": ids}

    return map_slices(classes.select("id", "sketch"), run, "key long, id long")


def _promising(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sketches agree in enough bins."""

    def run(batch: pa.RecordBatch) -> dict:
        one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("x", "y"))
        near = pa.array((one == two).mean(axis=1) >= SKETCH_SHARE)
        return {c: batch.column(c).filter(near) for c in ("a", "b")}

    left = sketches.select(F.col("id").alias("a"), F.col("sketch").alias("x"))
    right = sketches.select(F.col("id").alias("b"), F.col("sketch").alias("y"))
    return map_slices(pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "x", "y"), run, "a long, b long")


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs whose whole shingle sets are similar enough."""

    def run(batch: pa.RecordBatch) -> dict:
        zip_, near, last, own = zstandard.ZstdDecompressor(), [], None, None
        for a, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "x", "y"))):
            if a != last:
                last, own = a, shingles(zip_.decompress(x))
            other = shingles(zip_.decompress(y))
            both = len(np.intersect1d(own, other, assume_unique=True))
            near.append(100 * both >= percent * (len(own) + len(other) - both))
        return {c: batch.column(c).filter(pa.array(near, pa.bool_())) for c in ("a", "b")}

    left = texts.select(F.col("id").alias("a"), F.col("packed").alias("x"))
    right = texts.select(F.col("id").alias("b"), F.col("packed").alias("y"))
    return map_slices(pairs.join(right.hint("merge"), "b").join(left.hint("merge"), "a").select("a", "b", "x", "y"), run, "a long, b long")


def _open(members: DataFrame, links: DataFrame, found: DataFrame, space: Workspace, label: str) -> DataFrame:
    """Members of the buckets that links don't connect yet: (key, id, component, degree, top: the one with most links)."""
    ends = links.select(F.col("a").alias("id")).unionAll(links.select(F.col("b").alias("id")))
    degrees = ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    placed = members.join(found.hint("merge"), "id").join(degrees.hint("merge"), "id", "left")
    placed = placed.select("key", "id", "component", F.coalesce("degree", F.lit(0)).alias("degree"))
    spread = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max(F.struct("degree", "id", "component")).alias("top"), F.count(F.lit(1)).alias("n"))
    # the star has compared the two members of a bucket of two
    return space.write(placed.join(spread.filter("low <> high AND n > 2").select("key", "top").hint("merge"), "key"), f"open{label}")


def _dealt(open_: DataFrame, sketches: DataFrame, space: Workspace) -> DataFrame:
    """(region, i, j, id, component, query): queries and members of the tasks (region, i, j).

    Buckets that share members form a region. In a region, the members outside its largest component are a query set
    that is held against all members, a block of queries and a block of members a task.
    """
    regions = components(open_.select(F.col("top.id").alias("a"), F.col("id").alias("b")), space, "regions", FEW).withColumnRenamed("component", "region")
    nodes = open_.select("id", "component").distinct().join(regions.hint("merge"), "id").join(sketches.select("id", "size").hint("merge"), "id")
    nodes = space.write(nodes, "nodes")
    parts = nodes.groupBy("region", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s"))
    parts = parts.groupBy("region").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.max(F.struct("n", "s", "component")).alias("main"))
    blocks = lambda n, s, most: F.greatest(F.ceil(n / most), F.ceil(s / BLOCK_SHINGLES)).cast("int")
    # a very large region's rows meet its sums in SALTS tasks
    salted = parts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    nodes = nodes.withColumn("salt", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(SALTS)).cast("int"))
    split = nodes.join(salted.hint("merge"), ["region", "salt"]).select(
        "region", "id", "component", (F.col("component") != F.col("main.component")).alias("asks"),
        blocks(F.col("n"), F.col("s"), BLOCK).alias("blocks"), blocks(F.col("n") - F.col("main.n"), F.col("s") - F.col("main.s"), QUERIES).alias("query_blocks"),
    )
    place = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    queries = split.filter("asks").select("region", "id", "component", F.lit(True).alias("query"), place("query_blocks", 1).alias("i"), upto("blocks").alias("j"))
    rows = split.filter("query_blocks > 0").select("region", "id", "component", F.lit(False).alias("query"), upto("query_blocks").alias("i"), place("blocks", 2).alias("j"))
    return queries.unionByName(rows).select("region", "i", "j", "id", "component", "query")


def _near_blocks(dealt: DataFrame, sketches: DataFrame) -> DataFrame:
    """Those rows of each task whose sketches agree in enough bins with a counterpart's of another component."""

    def run(table: pa.Table) -> pa.Table:
        parts, query = (table.column(c).to_numpy(zero_copy_only=False) for c in ("component", "query"))
        cut = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(table.num_rows, -1)
        rows, wanted = np.flatnonzero(~query), np.zeros(table.num_rows, bool)
        held, held_parts = cut[rows], parts[rows]
        for q in np.flatnonzero(query):
            near = ((held == cut[q]).mean(axis=1) >= SKETCH_SHARE) & (held_parts != parts[q])
            wanted[q] = near.any()
            wanted[rows[near]] = True
        return table.drop_columns(["sketch"]).filter(pa.array(wanted))

    keyed = dealt.join(sketches.select("id", "sketch").hint("merge"), "id").select("region", "i", "j", "id", "component", "query", "sketch")
    return keyed.groupBy("region", "i", "j").applyInArrow(run, "region long, i int, j int, id long, component long, query boolean")


def _block_links(near: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of the tasks' queries, one to each component that a query reaches in a task."""

    def run(table: pa.Table) -> pa.Table:
        zip_ = zstandard.ZstdDecompressor()
        ids, parts, query = (table.column(c).to_numpy(zero_copy_only=False) for c in ("id", "component", "query"))
        sets = [shingles(zip_.decompress(x)) for x in table.column("packed").to_pylist()]
        rows = np.flatnonzero(~query)
        sizes = np.array([len(sets[r]) for r in rows], np.int64)
        whole = np.concatenate([sets[r] for r in rows]) if len(rows) else np.empty(0, np.uint64)
        order = np.argsort(whole, kind="stable")
        whole, owner = whole[order], np.repeat(np.arange(len(rows)), sizes)[order]
        links = []
        for q in np.flatnonzero(query):
            low, high = np.searchsorted(whole, sets[q], "left"), np.searchsorted(whole, sets[q], "right")
            width = high - low
            spots = np.repeat(low - (np.cumsum(width) - width), width) + np.arange(width.sum())
            both = np.bincount(owner[spots], minlength=len(rows))
            near = rows[(100 * both >= percent * (len(sets[q]) + sizes - both)) & (parts[rows] != parts[q])]
            _, first = np.unique(parts[near], return_index=True)
            links += [(int(ids[q]), int(ids[r])) for r in near[first]]
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    keyed = near.join(texts.hint("merge"), "id").select("region", "i", "j", "id", "component", "query", "packed")
    return keyed.groupBy("region", "i", "j").applyInArrow(run, "a long, b long")


def _extended(found: DataFrame, links: DataFrame, space: Workspace, label: str) -> DataFrame:
    """The components found, of all ids, joined by more links."""
    # what comes of few links is small: each has two ends, and these a component each
    small = "broadcast" if links.count() <= FEW else "merge"
    part = lambda end: found.select(F.col("id").alias(end), F.col("component").alias(f"part_{end}"))
    ends = part("b").join(part("a").join(links.hint(small), "a").hint(small), "b")
    joined = components(ends.select(F.col("part_a").alias("a"), F.col("part_b").alias("b")), space, label, FEW)
    moved = joined.select(F.col("id").alias("component"), F.col("component").alias("onto")).hint(small)
    moved = found.join(moved, "component", "left").select("id", F.coalesce("onto", "component").alias("component"))
    return space.write(moved, f"{label}-all")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of documents (doc_id, text)."""
    space = Workspace(docs.sparkSession, "near")
    signed = space.write(signatures(docs), "signed")
    alike = signed.filter(F.col("same").isNotNull() & F.col("doc_id").isNotNull()).groupBy("same")
    classes = alike.agg(F.min(F.struct("doc_id", "print")).alias("first"), F.first("sketch").alias("sketch"), F.first("n_shingles").alias("size"))
    # numbered as they are written: whoever reads the table sees the same numbers
    classes = space.write(classes.select(F.monotonically_increasing_id().alias("id"), "same", "first.*", "sketch", "size"), "classes")
    every = buckets(classes, ROWS if percent >= PERCENT else LOW_ROWS)
    stars = every.groupBy("key").agg(F.min(F.struct(F.xxhash64("id", "key").alias("order"), "id")).alias("hub"), F.count(F.lit(1)).alias("n"))
    stars = stars.filter("n > 1").select("key", F.col("hub.id").alias("hub"))
    members = space.write(every.join(stars, "key"), "members")
    wanted = members.select("id").distinct()
    sketches = space.write(classes.join(wanted.hint("merge"), "id", "left_semi").select("id", "doc_id", "print", "sketch", "size"), "sketches")
    texts = space.write(_packed(docs, sketches.select("id", "doc_id", "print")), "texts")

    tested = space.write(_promising(_ordered(members.select(F.col("hub").alias("a"), F.col("id").alias("b"))), sketches), "pairs1")
    links = space.write(_confirmed(tested, texts, percent), "links1")
    found = _extended(sketches.select("id", F.col("id").alias("component")), links, space, "parts1")
    open_ = _open(members, links, found, space, "2")
    fresh = _ordered(open_.filter("component <> top.component").select(F.col("top.id").alias("a"), F.col("id").alias("b"))).join(tested.hint("merge"), ["a", "b"], "left_anti")
    fresh = space.write(_promising(fresh, sketches), "pairs2")
    more = space.write(_confirmed(fresh, texts, percent), "links2")
    found = _extended(found, more, space, "parts2")
    # more links open no bucket
    dealt = _dealt(_open(open_.select("key", "id"), links.unionByName(more), found, space, "3"), sketches, space)
    last = _block_links(space.write(_near_blocks(dealt, sketches), "near"), texts, percent)
    found = _extended(found, space.write(last, "links3"), space, "parts3")
    # every text of a class has its component, named by the smallest doc_id of all its classes
    reached = classes.select("same", "id", "doc_id").join(found.hint("merge"), "id", "left").select("same", "doc_id", F.coalesce("component", "id").alias("component"))
    reached = space.write(reached, "reached")
    names = reached.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    reached = space.write(reached.join(names.hint("merge"), "component").select("same", "component_id"), "named")
    space.drop("classes", "members", "sketches", "texts", "open2", "open3", "nodes", "near", "reached", *(f"parts{i}-all" for i in (1, 2, 3)))
    out = signed.join(reached.hint("merge"), "same", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def _packed(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, packed): the texts of classes (id, doc_id, print)."""

    def run(batch: pa.RecordBatch) -> dict:
        zip_ = zstandard.ZstdCompressor(level=1)
        return {"id": batch.column("id"), "packed": [zip_.compress(t) for t in text_bytes(batch.column("text"))]}

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("print"), "text")
    # rows that are alike in id and text are one; they lie together after the join
    found = chosen.join(wanted.hint("merge"), ["doc_id", "print"]).dropDuplicates(["doc_id", "print"])
    return map_slices(found.select("id", "text"), run, "id long, packed binary")


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                             '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
sizes AS (SELECT doc_id, len(s) AS n FROM sets),
items AS (SELECT doc_id, unnest(s) AS t FROM sets),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM items a JOIN items b ON a.t = b.t AND a.doc_id <> b.doc_id
  JOIN sizes m ON m.doc_id = a.doc_id JOIN sizes n ON n.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, m.n, n.n HAVING 100 * count(*) >= 85 * (m.n + n.n - count(*))),
reach AS (SELECT doc_id AS d, doc_id AS r FROM documents UNION SELECT d, y FROM reach JOIN links ON r = x)
SELECT doc_id, n::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM sizes JOIN (SELECT d AS doc_id, min(r) AS component_id FROM reach GROUP BY d) USING (doc_id)
"""
