"""Line deduplication over levelled sorted runs of line hashes, all in DataFrame operations.

A run is a table bucketed and sorted by line hash; each entry has the number of documents seen with the line and the
largest of their ids. Documents come in batches by a hash of doc_id, whatever files they are in, so that a document
is in one batch. Each batch is merge-joined with the runs: the lines that no run has (the anti-join's side) are the
fresh entries of its own run, the others are updates that its table carries beside them. `fanout` tables of a level
are compacted into one of the next. All these merges join buckets with buckets: a batch is shuffled, never a run.

Defined results. A null or empty text is one empty line. Documents are distinct doc_ids: rows that share one are one
document, and a line that a document repeats counts once; all its repetitions go or stay together, and all rows with
the largest doc_id of a line keep it. Rows without doc_id count as no document and keep all their lines. Of an empty
table nothing comes. Other columns are carried along, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import Workspace, documents

#: The bytes 0x20 and 0x09-0x0D, which count as white space.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_CHARS, MIN_DOCS, FANOUT, BATCHES = 40, 5, 2, 3


def line_key(line: Column, min_chars: int) -> Column:
    """The 128-bit hash of a stripped, lower-cased line; null if it has under min_chars code points."""
    bare = F.btrim(line, F.lit(BLANKS))
    # lower() treats ASCII as wanted, and is much faster than translate()
    lowered = F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))
    return F.when(F.char_length(bare) >= min_chars, F.unhex(F.md5(lowered)))


def keyed(docs: DataFrame, min_chars: int) -> DataFrame:
    """A row (doc_id, print, at, key) for each line that has a key, of rows with doc_id.

    at: the line's place; print: a hash of the whole text, which tells rows with one doc_id apart.
    """
    keys = F.transform(F.split("text", "\n", -1), lambda x: line_key(x, min_chars))
    # explode(array(...)) works the keys out once a row; a projection would be merged into what reads it
    once = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("text").alias("print"), F.explode(F.array(keys)).alias("keys"))
    return once.select("doc_id", "print", F.posexplode("keys").alias("at", "key")).filter(F.col("key").isNotNull())


class LineRuns:
    """The levelled runs; add() merges a batch of keyed() lines, totals() has the sums of each line.

    A table has the entries of a run and, not fresh, updates of lines that other runs have. Documents must not be
    spread over batches: each batch counts the documents it has.
    """

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.space, self.fanout = Workspace(spark, "lines"), fanout
        self.levels: list[list[DataFrame]] = [[]]
        self.written = 0

    def tables(self) -> list[DataFrame]:
        return [table for level in self.levels for table in level]

    def _write(self, entries: DataFrame) -> DataFrame:
        self.written += 1
        return self.space.write_bucketed(entries.select("key", "n_docs", "last_doc", "fresh"), f"run{self.written}", "key")

    def add(self, lines: DataFrame) -> None:
        """Merges a batch into the runs; compacts each level that has become full."""
        # count_distinct first meets the lines of a document, so that a very common line is many small groups
        batch = lines.groupBy("key").agg(F.count_distinct("doc_id").alias("n_docs"), F.max("doc_id").alias("last_doc"))
        self.levels[0].append(self._write(self.marked(batch)))
        for level in range(len(self.levels)):
            if len(self.levels[level]) >= self.fanout:
                self._compact(level)

    def marked(self, batch: DataFrame) -> DataFrame:
        """batch, with `fresh`: whether no run has the line; a merge join with each run, whose unmatched side it is."""
        flags = []
        for i, run in enumerate(self.tables()):
            flags.append(f"in{i}")
            batch = batch.join(run.filter("fresh").select("key", F.lit(True).alias(flags[-1])).hint("merge"), "key", "left")
        return batch.withColumn("fresh", F.coalesce(*flags, F.lit(False)) == F.lit(False)).drop(*flags)

    @staticmethod
    def _merged(tables: list[DataFrame]) -> DataFrame:
        """The fresh entries, each brought up to date; their keys differ, so that nothing needs grouping."""
        merged = []
        for run in tables:
            entries = run.filter("fresh").drop("fresh")
            for other in tables:
                if other is not run:
                    update = other.filter("NOT fresh").select("key", F.col("n_docs").alias("more"), F.col("last_doc").alias("later"))
                    entries = entries.join(update.hint("merge"), "key", "left")
                    entries = entries.select("key", (F.col("n_docs") + F.coalesce("more", F.lit(0))).alias("n_docs"), F.greatest("last_doc", "later").alias("last_doc"))
            merged.append(entries)
        return reduce(DataFrame.unionByName, merged)

    def _compact(self, level: int) -> None:
        """One table of all of the level's; updates of lines that other levels have stay updates."""
        old, others = self.levels[level], [run for run in self.tables() if not any(run is x for x in self.levels[level])]
        entries = self._merged(old).withColumn("fresh", F.lit(True))
        if others:
            strays = []
            for update in (table.filter("NOT fresh") for table in old):
                for run in old:
                    update = update.join(run.filter("fresh").select("key").hint("merge"), "key", "left_anti")
                strays.append(update.drop("fresh"))
            summed = reduce(DataFrame.unionByName, strays).repartition("key").groupBy("key").agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))
            entries = entries.unionByName(summed.withColumn("fresh", F.lit(False)))
        if len(self.levels) == level + 1:
            self.levels.append([])
        self.levels[level + 1].append(self._write(entries))
        self.levels[level] = []
        self.space.drop_table(*old)

    def totals(self) -> DataFrame:
        return self._merged(self.tables())

    def drop(self) -> None:
        self.space.drop_table(*self.tables())


def drop_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """docs, with text's repeated lines dropped, and columns n_lines and n_dropped.

    Lines of at least min_chars code points that at least min_docs documents have stay only in the one with the
    largest doc_id. The counts come from LineRuns over all documents, fed in `batches` batches.
    """
    runs = LineRuns(docs.sparkSession)
    dealt = keyed(docs, min_chars).withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int"))
    lines = runs.space.write(dealt, "lines", "batch")
    for i in range(batches):
        runs.add(lines.filter(F.col("batch") == i).select("key", "doc_id"))
    repeated = runs.totals().filter(F.col("n_docs") >= min_docs).select("key", "last_doc")
    lost = lines.join(repeated.hint("merge"), "key").filter(F.col("doc_id") != F.col("last_doc"))
    # rows that are alike in id and text lose the same places
    lost = lost.groupBy(F.col("doc_id").alias("__doc"), F.col("print").alias("__print")).agg(F.collect_set("at").alias("__lost"))
    lost = runs.space.write(lost, "lost")
    runs.drop()
    runs.space.drop("lines")
    columns = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    # a merge join at every size: the lost lines grow with the input, so they are never broadcast
    joined = docs.join(lost.hint("merge"), (docs["doc_id"] == lost["__doc"]) & (F.xxhash64(docs["text"]) == lost["__print"]), "left")
    # explode(array(...)) splits once a row; places are kept or lost by hash, so that long texts take linear time
    split = joined.select(*(docs[c].alias(f"__{i}") for i, c in enumerate(columns)), "text", "__lost", F.explode(F.array(F.split(F.coalesce("text", F.lit("")), "\n", -1))).alias("__lines"))
    places = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), "__lost")
    left = F.array_join(F.transform(places, lambda i: F.get("__lines", i)), "\n")
    return split.select(
        *(F.col(f"__{i}").alias(c) for i, c in enumerate(columns)),
        F.when(F.col("__lost").isNotNull(), left).otherwise(F.coalesce("text", F.lit(""))).alias("text"),
        F.size("__lines").cast("long").alias("n_lines"),
        F.when(F.col("__lost").isNull(), F.lit(0)).otherwise(F.size("__lost")).cast("long").alias("n_dropped"),
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_repeated_lines(documents(spark, sf_dir))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
repeated AS (
  SELECT key, max(doc_id) AS last_doc FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT k.*, r.key IS NOT NULL AND doc_id <> last_doc AS gone FROM keyed k LEFT JOIN repeated r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
