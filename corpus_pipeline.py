"""A corpus-cleaning pipeline over documents, stage by stage.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's docs. All but the last return the columns of
docs, whatever else than the five of documents these are; doc_id is expected to be unique
and not null. Null texts have no language and go in the first stage, as texts without a
letter do; given to a later stage they stay as they are. Rows that repeat a doc_id and its
text share every verdict. Ties go by the smallest doc_id, or for lines (doc_id, line
number). An empty table stays empty.

Stages that run Python set spark.sql.execution.arrow.maxBytesPerBatch in the session if it
is not set there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.llm.common import materialize, quoted, small_batches, small_side, unused
from vectide.llm.decontaminate import leaking_documents
from vectide.llm.language_id import identify
from vectide.llm.line_dedup import line_dedup
from vectide.llm.ngram_join import similar_groups
from vectide.llm.pieces import encode

#: A text whose likeliest language has a lower score is not in any known language.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows; texts without a letter go."""
    small_batches(spark)
    clash = {c: unused(f"own_{c}", docs.columns) for c in docs.columns if c.lower() in ("lang_pred", "lang_score")}
    got = identify(docs.withColumnsRenamed(clash))
    got = got.where((F.col("lang_pred") != "und") & (F.col("lang_score") >= LEAST_SCORE))
    return got.select(*[quoted(clash.get(c, c)).alias(c) for c in docs.columns])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated lines; documents of which no line with text is left go.

    n_chars follows the new text.
    """
    clash = {c: unused(f"own_{c}", docs.columns) for c in docs.columns if c.lower() in ("n_lines", "n_removed")}
    got = line_dedup(docs.withColumnsRenamed(clash), every_line=True)
    gone = F.col("n_removed") > 0
    got = got.where(~gone | (F.length(F.trim("text")) > 0))
    size = F.when(gone, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return got.select(*[size.alias(c) if c == "n_chars" else quoted(clash.get(c, c)).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each near-duplicate component."""
    small_batches(spark)
    groups = similar_groups(docs).where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.join(small_side(materialize(groups, "pipeline-near"), 16), "doc_id", "left_anti")


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    leaks = materialize(leaking_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(F.col("id").alias("doc_id")), "pipeline-leaks")
    return docs.join(small_side(leaks, 16), "doc_id", "left_anti")


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text, the scores of its best segmentations, and whether the ids decode to the text."""
    small_batches(spark)
    got = encode(docs.select("doc_id", "text"))
    return got.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", F.transform("nbest", lambda x: x["score"]).alias("scores"), "decoded_ok")


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("pieces", pieces)]

#: The language model, components and segmentation have no SQL form; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
