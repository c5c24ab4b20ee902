"""Queries of the training-data operators and their DuckDB oracles."""

from __future__ import annotations

from vectide.llm import decontaminate, exact_dedup, language_id, line_dedup, ngram_join, pieces, pii, repeats, toxicity, warc


def queries():
    """Name -> callable(spark, sf_dir)."""
    return {
        "op1_warc": warc.op1_warc,
        "op2_pii": pii.op2_pii,
        "op3_language_id": language_id.op3_language_id,
        "op4_pieces": pieces.op4_pieces,
        "op5_line_dedup": line_dedup.op5_line_dedup,
        "op5_line_dedup_every": line_dedup.op5_line_dedup_every,
        "op6_ngram_join": ngram_join.op6_ngram_join,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_repeats": repeats.op8_repeats,
        "op9_decontaminate": decontaminate.op9_decontaminate,
        "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    }


def oracle_sql():
    """Name -> DuckDB SQL, where SQL can express the operator."""
    return {
        "op1_warc": warc.SQL,
        "op5_line_dedup": line_dedup.SQL,
        "op5_line_dedup_every": line_dedup.EVERY_SQL,
        "op6_ngram_join": ngram_join.SQL,
        "op9_decontaminate": decontaminate.SQL,
        "op10_exact_dedup": exact_dedup.SQL,
    }
