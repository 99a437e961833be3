"""Removal of repeated byte strings of a text corpus by a sorted sparse suffix array.

A string of LENGTH bytes is repeated if it also starts anywhere else. Sorting the suffixes at all bytes would need
many times the corpus on disk, so suffixes start at anchors only: every window of LENGTH bytes picks the 32-byte gram
in it with the lowest hash (the rightmost of equal ones), so equal windows pick an anchor at the same place in them.
An anchor stands for the run of windows that pick it; its context is the bytes of that run, under 2 * LENGTH.

1. Anchors (gram hash, context hash, place) meet by both hashes. Contexts that occur twice are covered as a whole. Of
   different contexts of one gram hash one of each goes on; how many a gram has is counted with partial sums, so that
   a very common gram is never gathered.
2. These suffixes, with the bytes before them, are range-partitioned by their leading bytes with sampled splitters,
   and each bucket is sorted locally by multikey quicksort (eight bytes a key, ties only are refined), a bounded number
   of suffixes at a time, cut where the leading gram changes. The runs of suffixes that agree in their first b bytes
   are read off the common prefixes of neighbours, and the bytes before them are sorted likewise, backwards. For each
   split of LENGTH into a bytes before an anchor and b after it, suffixes of one run with the same a bytes before them
   repeat that window. All these decisions compare bytes.
3. Across boundaries: a gram with over AT_ONCE contexts is dealt to parts, in as many ranges. Windows that a part
   doesn't find repeated, and one row of each that it does, are dealt out by their hashes and counted over all parts.
   No other gram lies on both sides of a boundary.
4. The windows found are merged for each document and cut out.

Equal contexts are told by two independent 64-bit hashes (of the gram and of the whole context), windows across
boundaries by 128 bits: to meet their bytes would mean sending each context once more.

Defined results. Texts are UTF-8 bytes; null is empty. Matches don't cross documents. Rows that share a doc_id are
documents of their own, so a repeated row repeats all its strings. Rows without doc_id are treated alike. Texts under
LENGTH bytes stay whole. Long texts are read in chunks. Of ties (equal strings) all go. Other columns are left alone,
whatever their names. Of an empty table nothing comes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import map_arrow, map_slices, text_bytes
from .workspace import Workspace, documents

LENGTH, GRAM = 200, 32
SPAN = LENGTH - GRAM + 1
CHUNK = 1 << 20
#: Suffixes that are compared at once, and contexts of a gram from which it is dealt to parts.
AT_ONCE = 40_000
_RANDOM = np.random.default_rng(20240417)
_BYTE = _RANDOM.integers(1, 2**63, 256, np.uint64)
_ODD = _RANDOM.integers(1, 2**63, 16, np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD[14]
    x = (x ^ (x >> np.uint64(29))) * _ODD[15]
    return x ^ (x >> np.uint64(32))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Of the gram at each place, by doubling."""
    out, size, step = _BYTE[data], 1, 0
    while size < GRAM:
        out = out[:-size] * _ODD[step] + out[size:]
        size, step = 2 * size, step + 1
    return _mixed(out)


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, first window, last window, gram hash) of each anchor in texts laid end to end; ends: where each ends."""
    parts = []
    for at in range(0, len(data) - LENGTH + 1, CHUNK):
        hashes = gram_hashes(data[at : at + CHUNK + LENGTH - 1])
        places = np.arange(len(hashes), dtype=np.uint64)
        low = hashes & np.uint64(0xFFFFFFFF00000000) | np.uint64(0xFFFFFFFF) - places
        size = 1
        while 2 * size <= SPAN:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        low = np.minimum(low[: len(low) - (SPAN - size)], low[SPAN - size :])
        starts = np.arange(at, at + len(low))
        whole = starts + LENGTH <= ends[np.searchsorted(ends, starts, "right")]
        starts, chosen = starts[whole], (np.uint64(0xFFFFFFFF) - (low[whole] & np.uint64(0xFFFFFFFF))).astype(np.int64)
        if len(starts):
            new = np.flatnonzero(np.r_[True, chosen[1:] != chosen[:-1]])
            parts.append((chosen[new] + at, starts[new], starts[np.r_[new[1:], len(starts)] - 1], hashes[chosen[new]]))
    if not parts:
        none = np.empty(0, np.int64)
        return none, none, none, np.empty(0, np.uint64)
    place, first, last, gram = (np.concatenate(x) for x in zip(*parts))
    # an anchor whose windows lie on both sides of a chunk's end
    new = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    return place[new], first[new], last[np.r_[new[1:], len(place)] - 1], gram[new]


def _with_print(docs: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, print, text): print tells apart rows that share a doc_id; carried columns go into one struct."""
    more = [F.struct(*(docs[c] for c in carried)).alias("carried")] if carried else []
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("print"), "text", *more)


ANCHOR = "gram long, context long, doc_id long, print long, at int, low int, high int"
#: What a slice of the input tells of an anchor: nothing; covered as a whole; one of several alike.
NEW, COVERED, COMPARE_MANY = range(3)


def _anchors(docs: DataFrame) -> DataFrame:
    """Each anchor with the hash of its context, which is the bytes from at - low to at + high.

    Contexts that a slice has several times are covered without meeting others, but for one of them, so that a very
    common passage isn't gathered in one task.
    """

    def run(batch: pa.RecordBatch) -> dict:
        texts = text_bytes(batch.column("text"))
        whole, ends = b"".join(texts), np.cumsum([len(t) for t in texts])
        place, first, last, gram = anchors(np.frombuffer(whole, np.uint8), ends)
        view = memoryview(whole)
        cuts = zip(first.tolist(), (last + LENGTH).tolist(), (place - first).tolist())
        context = np.fromiter((xxhash.xxh3_64_intdigest(view[a:b], seed=s) for a, b, s in cuts), np.uint64, len(place))
        doc = np.searchsorted(ends, place, "right")
        rows = pa.array(doc)
        order = np.lexsort((context, gram))
        fresh = np.r_[True, (gram[order[1:]] != gram[order[:-1]]) | (context[order[1:]] != context[order[:-1]])][: len(order)]
        several = (np.bincount(np.cumsum(fresh) - 1) > 1)[np.cumsum(fresh) - 1] if len(order) else fresh
        kind = np.empty(len(order), np.int32)
        kind[order] = np.where(several, np.where(fresh, COMPARE_MANY, COVERED), NEW)
        return {
            "kind": kind,
            "gram": gram.view(np.int64),
            "context": context.view(np.int64),
            "doc_id": batch.column("doc_id").take(rows),
            "print": batch.column("print").take(rows),
            "at": (place - np.r_[0, ends][doc]).astype(np.int32),
            "low": (place - first).astype(np.int32),
            "high": (last + LENGTH - place).astype(np.int32),
        }

    return map_slices(_with_print(docs), run, f"kind int, {ANCHOR}")


def _contexts(found: DataFrame) -> DataFrame:
    """(gram, context, many, first): the different contexts of the anchors, whether each occurs several times, and one place of it."""
    place = F.struct("doc_id", "print", "at", "low", "high")
    groups = found.filter(F.col("kind") != COVERED).groupBy("gram", "context")
    contexts = groups.agg(F.count(F.lit(1)).alias("n"), F.max("kind").alias("kind"), F.min(place).alias("first"))
    return contexts.select("gram", "context", ((F.col("n") > 1) | (F.col("kind") == COMPARE_MANY)).alias("many"), "first")


def _covered(found: DataFrame, contexts: DataFrame) -> DataFrame:
    """The anchors to cover as a whole."""
    several = contexts.filter("many").select("gram", "context").hint("merge")
    rest = found.filter(F.col("kind") != COVERED).join(several, ["gram", "context"], "left_semi")
    return found.filter(F.col("kind") == COVERED).unionByName(rest.select(*found.columns))


def _to_compare(contexts: DataFrame) -> DataFrame:
    """Contexts of grams that have several; parts: how many parts the gram is dealt to."""
    grams = contexts.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("gram", F.ceil(F.col("n") / AT_ONCE).cast("int").alias("parts"))
    return contexts.join(grams.hint("merge"), "gram").select("many", "parts", "first.*")


def _schema(df: DataFrame, *more: str) -> str:
    own = f"carried {df.schema['carried'].dataType.simpleString()}" if "carried" in df.columns else None
    return ", ".join(["doc_id long, print long", *([own] if own else []), *more])


def _packed(docs: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """Texts compressed before they are shuffled."""
    given = _with_print(docs, carried)

    def run(batch: pa.RecordBatch) -> dict:
        zip_ = zstandard.ZstdCompressor(level=1)
        same = {c: batch.column(c) for c in batch.schema.names if c != "text"}
        return same | {"packed": [zip_.compress(t) for t in text_bytes(batch.column("text"))]}

    return map_slices(given, run, _schema(given, "packed binary"))


def _joined(docs: DataFrame, lists: DataFrame, how: str, carried: tuple[str, ...] = ()) -> DataFrame:
    """Packed texts with the lists of their (doc_id, print); a merge join, as both sides grow with the corpus."""
    lists = lists.select(F.col("doc_id").alias("d"), F.col("print").alias("p"), "list").hint("merge")
    return _packed(docs, carried).join(lists, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("print") == F.col("p")), how)


SUFFIX = "lead binary, part int, doc_id long, print long, at int, low int, bytes binary, many boolean"


def _suffixes(docs: DataFrame, compare: DataFrame) -> DataFrame:
    """The contexts to compare, as bytes."""
    lists = compare.groupBy("doc_id", "print").agg(F.collect_list(F.struct("at", "low", "high", "many", "parts")).alias("list"))

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        zip_ = zstandard.ZstdDecompressor()
        for doc_id, print_, packed, wanted in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "print", "packed", "list"))):
            text = zip_.decompress(packed)
            at, low = [w["at"] for w in wanted], [w["low"] for w in wanted]
            cut = [text[w["at"] - w["low"] : w["at"] + w["high"]] for w in wanted]
            yield {
                "lead": [text[a : a + GRAM] for a in at],
                # -1: the gram isn't dealt to parts
                "part": [xxhash.xxh3_64_intdigest(x) % w["parts"] if w["parts"] > 1 else -1 for x, w in zip(cut, wanted)],
                "doc_id": [doc_id] * len(at),
                "print": [print_] * len(at),
                "at": at,
                "low": low,
                "bytes": cut,
                "many": [w["many"] for w in wanted],
            }

    return map_slices(_joined(docs, lists, "inner").select("doc_id", "print", "packed", "list"), run, SUFFIX)


def multikey_order(keys: np.ndarray) -> np.ndarray:
    """The order of rows by columns of unsigned keys: each column sorts only rows that tie in all before it."""
    order = np.argsort(keys[:, 0], kind="stable")
    group = np.cumsum(np.r_[False, np.diff(keys[order, 0]) != 0]) if len(order) else order
    for k in range(1, keys.shape[1]):
        tied = np.flatnonzero(np.r_[group[1:] == group[:-1], False] | np.r_[False, group[1:] == group[:-1]])
        if not len(tied):
            break
        rows = order[tied]
        again = np.lexsort((keys[rows, k], group[tied]))
        order[tied] = rows[again]
        step = np.r_[False, (np.diff(group) != 0)]
        value = keys[order, k]
        step[1:] |= value[1:] != value[:-1]
        group = np.cumsum(step)
    return order


def _common(sorted_rows: np.ndarray) -> np.ndarray:
    """How many leading bytes each row has in common with the one before it; the first row: none."""
    differs = sorted_rows[1:] != sorted_rows[:-1]
    return np.r_[0, np.where(differs.any(axis=1), differs.argmax(axis=1), sorted_rows.shape[1])] if len(sorted_rows) else np.empty(0, np.int64)


def repeated_windows(contexts: list[bytes], lows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(repeated, witness) of each row, by the bytes before the anchor at which a window starts.

    repeated: whether other rows repeat it; witness: one row of each repeated window.
    """
    n, width, side = len(contexts), -(-LENGTH // 8) * 8, -(-SPAN // 8) * 8
    sizes = np.array([len(c) for c in contexts], np.int64)
    highs = sizes - lows
    flat, begins = np.frombuffer(b"".join(contexts), np.uint8), np.cumsum(sizes) - sizes
    columns = np.arange(width)
    right = np.where(columns < highs[:, None], flat[np.minimum((begins + lows)[:, None] + columns, len(flat) - 1)], 0).astype(np.uint8)
    order = multikey_order(right.view(">u8").astype(np.uint64))
    right, lows, highs, begins = right[order], lows[order], highs[order], begins[order]
    common = _common(right)
    columns = np.arange(side)
    left = np.where(columns < lows[:, None], flat[np.maximum((begins + lows)[:, None] - 1 - columns, 0)], 0).astype(np.uint8)
    by_left = multikey_order(left.view(">u8").astype(np.uint64))
    common_left = _common(left[by_left])
    del left, right
    repeated, witness = np.zeros((n, SPAN + 1), bool), np.zeros((n, SPAN + 1), bool)
    near = np.maximum(common, np.r_[common[1:], 0])
    kind = np.empty(n, np.int64)
    for a in range(SPAN):
        b = LENGTH - a
        rows = np.flatnonzero((lows >= a) & (highs >= b) & (near >= b))
        if len(rows) < 2:
            continue
        kind[by_left] = np.cumsum(common_left < a)
        key = np.cumsum(common < b)[rows] * (n + 1) + kind[rows]
        by = np.argsort(key)
        same = key[by[1:]] == key[by[:-1]]
        place = order[rows[by]]
        repeated[place, a] = np.r_[same, False] | np.r_[False, same]
        witness[place, a] = np.r_[same, False] & ~np.r_[False, same]
    return repeated, witness


def stretches(repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, a, b): the windows from a down to b bytes before the row's anchor, for each run of repeated ones."""
    edges = np.diff(repeated.astype(np.int8), axis=1, prepend=0)
    row, begin = np.nonzero(edges == 1)
    _, end = np.nonzero(edges == -1)
    return row, end - 1, begin


COVER = "doc_id long, print long, begin int, end int"


def _parts(suffixes: DataFrame, partitions: int) -> DataFrame:
    """Windows that different contexts of a part share, in those that aren't covered as a whole; and, with a hash, those to be counted across parts.

    known: the row is covered already, and tells of the window alone.
    """

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            # the last place in the batch where the gram or the part changes
            cut = 0
            if rows + batch.num_rows >= AT_ONCE:
                lead, part = batch.column("lead").to_pylist(), batch.column("part").to_pylist()
                cut = len(lead) - 1
                while cut and (lead[cut - 1], part[cut - 1]) == (lead[-1], part[-1]):
                    cut -= 1
                if not cut and held and (held[-1].column("lead")[-1].as_py(), held[-1].column("part")[-1].as_py()) != (lead[0], part[0]):
                    yield from compared(pa.Table.from_batches(held))
                    held, rows = [], 0
            if cut:
                yield from compared(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held, rows, batch = [], 0, batch.slice(cut)
            held.append(batch)
            rows += batch.num_rows
        if held:
            yield from compared(pa.Table.from_batches(held))

    def compared(table: pa.Table) -> Iterator[pa.RecordBatch]:
        contexts, lows, at = table.column("bytes").to_pylist(), table.column("low").to_numpy().astype(np.int64), table.column("at").to_numpy()
        many, dealt = table.column("many").to_numpy(), table.column("part").to_numpy() >= 0
        repeated, witness = repeated_windows(contexts, lows)
        row, far, near = stretches(repeated)
        single = ~many[row]
        row, far, near = row[single], far[single], near[single]
        yield rows_of(table, row, at[row] - far, at[row] - near + LENGTH, None)
        for part in np.array_split(np.flatnonzero(dealt), 1 + int(dealt.sum()) // 2000):
            rows, begins, hashes, known = [], [], [], []
            for i in part.tolist():
                low, text = int(lows[i]), contexts[i]
                # of windows repeated here one row tells
                first, last = LENGTH - min(len(text) - low, LENGTH), min(low, SPAN - 1)
                for a in (first + np.flatnonzero(~repeated[i, first : last + 1] | witness[i, first : last + 1])).tolist():
                    rows.append(i)
                    begins.append(at[i] - a)
                    hashes.append(hashlib.blake2b(text[low - a : low - a + LENGTH], digest_size=16).digest())
                    known.append(many[i] or witness[i, a])
            if rows:
                begins = np.array(begins)
                yield rows_of(table, np.array(rows), begins, begins + LENGTH, hashes, np.array(known, bool))

    def rows_of(table, row, begin, end, hashes, known=None) -> pa.RecordBatch:
        rows = pa.array(row)
        doc, mark = (table.column(c).take(rows).combine_chunks() for c in ("doc_id", "print"))
        doc, mark = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (doc, mark))
        known = pa.array(np.zeros(len(row), bool) if known is None else known, pa.bool_())
        found = [doc, mark, pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array([None] * len(row) if hashes is None else hashes, pa.binary()), known]
        return pa.RecordBatch.from_arrays(found, names=["doc_id", "print", "begin", "end", "window", "known"])

    sorted_ = suffixes.repartitionByRange(partitions, "lead", "part").sortWithinPartitions("lead", "part")
    return map_arrow(sorted_, run, f"{COVER}, window binary, known boolean")


def covers(docs: DataFrame, space: Workspace) -> DataFrame:
    """(doc_id, print, begin, end): stretches of bytes that repeated strings cover; they may overlap."""
    found = space.write(_anchors(docs), "anchors")
    contexts = space.write(_contexts(found), "contexts")
    whole = _covered(found, contexts).select("doc_id", "print", (F.col("at") - F.col("low")).alias("begin"), (F.col("at") + F.col("high")).alias("end"))
    whole = space.write(whole, "whole")
    space.drop("anchors")
    suffixes = space.write(_suffixes(docs, _to_compare(contexts)), "suffixes")
    space.drop("contexts")
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = space.write(_parts(suffixes, partitions), "parts")
    asked = parts.filter(F.col("window").isNotNull())
    repeated = asked.groupBy("window").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("window")
    across = asked.filter(~F.col("known")).join(repeated.hint("merge"), "window", "left_semi")
    columns = ["doc_id", "print", "begin", "end"]
    out = space.write(whole.unionByName(parts.filter(F.col("window").isNull()).select(*columns)).unionByName(across.select(*columns)), "covers")
    space.drop("whole", "suffixes", "parts")
    return out


def cut_out(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int]:
    """The text without the spans, which may overlap, and the number of maximal runs cut."""
    kept, at, runs, end = [], 0, 0, -1
    for a, b in sorted(spans):
        if a > end:
            kept.append(text[at:a])
            runs += 1
            at = end = b
        elif b > end:
            at = end = b
    kept.append(text[at:])
    return b"".join(kept), runs


def remove_repeats(docs: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, kept, n_bytes, n_removed, n_spans): each text's remaining bytes; carried columns in a struct `carried`."""
    space = Workspace(docs.sparkSession, "suffix")
    lists = covers(docs, space).groupBy("doc_id", "print").agg(F.collect_list(F.struct("begin", "end")).alias("list"))
    joined = _joined(docs, lists, "left", carried).drop("d", "p")

    def run(batch: pa.RecordBatch) -> dict:
        zip_ = zstandard.ZstdDecompressor()
        texts = [zip_.decompress(x) for x in batch.column("packed").to_pylist()]
        made = [cut_out(t, [(x["begin"], x["end"]) for x in spans or ()]) for t, spans in zip(texts, batch.column("list").to_pylist())]
        same = {c: batch.column(c) for c in batch.schema.names if c not in ("packed", "list")}
        return same | {
            "kept": [m[0] for m in made],
            "n_bytes": [len(t) for t in texts],
            "n_removed": [len(t) - len(m[0]) for t, m in zip(texts, made)],
            "n_spans": [m[1] for m in made],
        }

    return map_slices(joined, run, _schema(joined, "kept binary, n_bytes long, n_removed long, n_spans long"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with repeated byte strings cut out of text; parts of characters at the cuts go too."""
    carried = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    cut = remove_repeats(docs, carried=carried).select("doc_id", "kept", *(["carried"] if carried else []))

    def run(batch: pa.RecordBatch) -> dict:
        same = {c: batch.column(c) for c in batch.schema.names if c != "kept"}
        return same | {"text": [x.decode("utf-8", "ignore") for x in batch.column("kept").to_pylist()]}

    fields = ["doc_id long", *([f"carried {cut.schema['carried'].dataType.simpleString()}"] if carried else []), "text string"]
    made = map_slices(cut, run, ", ".join(fields))
    place = {"doc_id": F.col("doc_id"), "text": F.col("text")} | {c: F.col("carried").getField(c) for c in carried}
    return made.select(*(place[c].alias(c) for c in docs.columns))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(documents(spark, sf_dir))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


SQL = """
WITH bytes AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
starts AS (SELECT doc_id, unnest(range(length(x) // 2 - 199)) AS i, x FROM bytes WHERE length(x) >= 400),
hashed AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 400)) AS k FROM starts),
repeated AS (SELECT k FROM hashed GROUP BY k HAVING count(*) > 1),
covered AS (SELECT doc_id, i FROM hashed SEMI JOIN repeated USING (k)),
marked AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS fresh FROM covered),
numbered AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked),
runs AS (SELECT doc_id, run, min(i) AS a, max(i) + 200 AS b FROM numbered GROUP BY doc_id, run),
pieces AS (
  SELECT doc_id, a AS z, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p, a AS q FROM runs
  UNION ALL SELECT doc_id, length(x) // 2, coalesce(max(b), 0), length(x) // 2 FROM bytes LEFT JOIN runs USING (doc_id) GROUP BY doc_id, x),
kept AS (SELECT doc_id, string_agg(substr(x, 2 * p + 1, 2 * (q - p)), '' ORDER BY z, p) AS y FROM pieces JOIN bytes USING (doc_id) GROUP BY doc_id)
SELECT doc_id, length(x) // 2 AS n_bytes, (length(x) - length(y)) // 2 AS n_removed,
       (SELECT count(*) FROM runs r WHERE r.doc_id = b.doc_id) AS n_spans, sha256(unhex(y)) AS kept_sha256
FROM bytes b JOIN kept USING (doc_id)
"""
