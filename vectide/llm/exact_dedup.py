"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Two texts are equal when they are identical after every run of space, tab, newline,
vertical tab, form feed or carriage return is replaced by one space. Null counts as
the empty text. Of equal texts the row with the smallest id stays.

Defined results for odd input: an empty table gives no rows; empty and null texts
form one group; ids are expected to be unique, and rows that repeat an id and its
text count one by one in group_size and share the verdict; further columns of the
input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectide.llm.common import materialize

#: Only runs that the replacement changes match, so single spaces cost nothing.
_RUNS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalized(text: Column) -> Column:
    """The text with each white-space run as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _RUNS, " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 256, digest_all: bool = False) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Step 1 groups by normalised length and leaves lengths that occur once. Step 2
    groups the rest by (length, hash of the first prefix_chars characters). Only rows
    of surviving groups reach step 3, the full SHA-256. With digest_all the digest is
    taken for every row in the first pass, which a caller that must return all digests
    needs anyway; without it a second pass reads the texts of survivors alone and
    text_sha256 is null elsewhere. No step moves a text through a shuffle with
    digest_all; without it only survivors' texts move.
    """
    norm = normalized(F.col(text_col))
    texts = docs.select(F.col(id_col).alias("id"), norm.alias("t"))
    keys = [F.octet_length("t").cast("long").alias("n"), F.xxhash64(F.substring("t", 1, prefix_chars)).alias("head")]
    full = F.sha2("t", 256).alias("full")
    table = materialize(texts.select("id", *keys, *([full] if digest_all else [])), "exact-keys")
    lengths = table.groupBy("n").agg(F.count("*").alias("c")).where("c > 1").select("n")
    prefixes = table.groupBy("n", "head").agg(F.count("*").alias("c"))
    heads = prefixes.join(lengths, "n", "left_semi").where("c > 1").select("n", "head")
    if digest_all:
        survivors = table.groupBy("n", "head", "full").agg(F.min("id").alias("id"), F.count("*").alias("rows")).join(heads, ["n", "head"], "left_semi")
    else:
        survivors = table.join(heads, ["n", "head"], "left_semi")
        wanted = texts.join(survivors.select("id").distinct(), "id", "left_semi")
        table = table.join(wanted.select("id", *keys, full).distinct(), ["id", "n", "head"], "left")
        table = materialize(table, "exact-digests")
        survivors = table.where("full is not null").withColumn("rows", F.lit(1))
    groups = survivors.groupBy("n", "head", "full").agg(F.min("id").alias("keep"), F.sum("rows").alias("c")).where("c > 1")
    return table.join(groups, ["n", "head", "full"], "left").select(
        F.col("id").alias(id_col),
        F.coalesce("keep", "id").alias("keep_id"),
        F.coalesce("c", F.lit(1)).cast("long").alias("group_size"),
        (F.coalesce("keep", "id") == F.col("id")).alias("kept"),
        F.col("full").alias("text_sha256"),
    )


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Exact dedup of the whole documents table, with every row's digest."""
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest_all=True)


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""
