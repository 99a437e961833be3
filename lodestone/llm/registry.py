"""The queries of this subpackage and, where SQL can express them, their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, language_model, line_dedup, media, near_dup, packing, pipeline, suffix_dedup, toxicity, vectors


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pitman_yor": language_model.op1_pitman_yor,
        "op2_bpe": bpe.op2_bpe,
        "op3_chat": chat.op3_chat,
        "op4_packing": packing.op4_packing,
        "op5_minhash": near_dup.op5_minhash,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_line_dedup": line_dedup.op7_line_dedup,
        "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
        "op9_vectors": vectors.op9_vectors,
        "op10_media": media.op10_media,
        "pipeline": pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return ({"pipeline": pipeline.ORACLE_SQL} if pipeline.ORACLE_SQL else {}) | {
        "op5_minhash": near_dup.SQL,
        "op7_line_dedup": line_dedup.SQL,
        "op8_suffix_dedup": suffix_dedup.SQL,
        "op9_vectors": vectors.SQL,
    }
