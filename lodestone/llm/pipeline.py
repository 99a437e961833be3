"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all but the last return the
columns of documents, with n_chars brought up to date. run() writes each stage's result as Parquet in the shared
folder and reads it again for the next, so that a lost executor costs a stage at most.

Documents that a stage leaves without text stay, as empty ones. Rows without doc_id pass the filters. Rows that
repeat a doc_id stay or go together in the near-duplicate stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .line_dedup import drop_repeated_lines
from .near_dup import near_duplicates
from .packing import packed_pieces
from .suffix_dedup import without_repeats
from .toxicity import score, train
from .workspace import Workspace, documents

#: Shingle similarity of near-duplicates in a corpus, in per cent; the query op5_minhash has its own.
PERCENT = 80

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _recounted(docs: DataFrame, columns: list[str]) -> DataFrame:
    return docs.select(*(F.char_length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in columns))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score(docs, train(docs, labels)).filter("predicted = 0").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one."""
    return _recounted(drop_repeated_lines(docs), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays."""
    kept = near_duplicates(docs, PERCENT).filter("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(kept.hint("merge"), docs["doc_id"].eqNullSafe(kept["kept_id"]), "left_semi")


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings that repeat anywhere are cut out."""
    return _recounted(without_repeats(docs), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packed_pieces(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("packing", packing),
]

#: SQL expresses neither the learned grammar nor the tokenizer; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    space, docs = Workspace(spark, "pipeline"), documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = space.write(stage(spark, docs, sf_dir), name)
    return docs
