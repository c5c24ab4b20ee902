"""Benchmark decontamination by spaced-seed hashing.

Tokens are the runs of letters and digits of the lower-cased text. A document leaks an
item if, on some alignment, a window of WINDOW item tokens agrees with the document in
all but MISMATCHES places. Candidates come from spaced seeds: masks of care positions
whose ignored positions tolerate substitutions. The two masks are lossless for the
window: every placement of up to two mismatches in 13 tokens leaves at least one mask
untouched somewhere (tests enumerate them all), so the seeds lose no leak.

Documents are tokenised, hashed and walked position by position inside one generated
stage. The hash over the care positions common to all masks is looked up in the item
side first, so only the few positions that pass meet the masks. What may move is a
position's id, number and three hashes, never the document. Hits on one (document, item,
diagonal) fold into one row; only documents with hits are read again, and the window
count is verified on the aligned slice of at most one item's length.

The item side is broadcast only if its measured size is within BROADCAST_BYTES; a larger
benchmark leaves Spark to shuffle the positions.

Defined results for odd input: null and empty texts, and items of fewer than WINDOW
tokens, never match; repeated items match each under its id; documents that share an id
share a verdict; empty tables give no rows or no leaks; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectide.llm.common import materialize, maybe_in, quoted, small_side

WINDOW, MISMATCHES = 13, 2
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 4, 5, 6, 7))
COMMON = tuple(sorted(set(MASKS[0]).intersection(*MASKS[1:])))
SPAN = 1 + max(map(max, MASKS))


def tokens(text: Column) -> Column:
    """Hashes of a text's tokens, in order."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.transform(words, lambda w: F.xxhash64(w))


def _seed(hw: str, i: str, care: tuple[int, ...], salt: int) -> Column:
    return F.xxhash64(F.lit(salt), *[F.col(hw)[F.col(i) + c] for c in care])


def _positions(hw: str) -> Column:
    n = F.size(hw)
    return F.explode(F.when(n >= SPAN, F.sequence(F.lit(0), n - SPAN)))


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Verified alignments as (id, item, diagonal, agreeing): agreeing is the most equal tokens in a window."""
    bench = items.select(F.col(item_col).alias("item"), tokens(F.col(item_text)).alias("bw")).where(F.size("bw") >= WINDOW)
    bench = materialize(bench, "leak-items")
    spots = bench.select("item", "bw", _positions("bw").alias("j"))
    first = materialize(spots.select(_seed("bw", "j", COMMON, 0).alias("c")).distinct(), "leak-common")
    seeds = spots.select("item", "j", F.explode(F.array(*[_seed("bw", "j", m, k + 1) for k, m in enumerate(MASKS)])).alias("s"))
    seeds = materialize(seeds.distinct(), "leak-seeds")
    walked = docs.select(quoted(id_col).alias("id"), tokens(quoted(text_col)).alias("hw"))
    walked = walked.select("id", "hw", _positions("hw").alias("i"))
    keys = [_seed("hw", "i", m, k + 1) for k, m in enumerate(MASKS)]
    walked = walked.select("id", "i", _seed("hw", "i", COMMON, 0).alias("c"), F.array(*keys).alias("keys"))
    near = walked.join(small_side(first, 24), "c", "left_semi").select("id", "i", F.explode("keys").alias("s"))
    hit = near.join(small_side(seeds, 48), "s").select("id", "item", (F.col("i") - F.col("j")).alias("diagonal")).distinct()
    hit = materialize(hit, "leak-hits")
    ids = materialize(hit.select("id").distinct(), "leak-ids")
    again = maybe_in(docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("t")), "id", ids)
    rows = again.select("id", tokens(F.col("t")).alias("hw")).join(hit, "id").join(small_side(bench, 40 + 8 * F.size("bw")), "item")
    start = F.greatest("diagonal", F.lit(0))
    stop = F.least(F.col("diagonal") + F.size("bw"), F.size("hw"))
    both = rows.select("id", "item", "bw", "diagonal", F.slice("hw", start + 1, F.greatest(stop - start, F.lit(0))).alias("part"))
    off = F.greatest(-F.col("diagonal"), F.lit(0))
    part = F.slice("bw", off + 1, F.size("part"))
    same = F.zip_with("part", part, lambda a, b: (a == b).cast("int"))
    both = both.select("id", "item", "diagonal", same.alias("same"))
    n = F.size("same")
    sums = F.transform(F.sequence(F.lit(0), F.greatest(n - WINDOW, F.lit(0))), lambda s: F.aggregate(F.slice("same", s + 1, WINDOW), F.lit(0), lambda a, x: a + x))
    return both.select("id", "item", "diagonal", F.array_max(sums).alias("agreeing")).where(F.col("agreeing") >= WINDOW - MISMATCHES)


def leaking_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document that leaks: id, items (sorted ids), agreeing (most in a window)."""
    return find_leaks(docs, items, id_col, text_col).groupBy("id").agg(F.sort_array(F.collect_set("item")).alias("items"), F.max("agreeing").alias("agreeing"))


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Which benchmark items each document of the whole table leaks."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    leaks = materialize(leaking_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), "leaks")
    out = docs.select("doc_id").join(leaks.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    return out.select(
        "doc_id",
        F.col("items").isNotNull().alias("contaminated"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce(F.array_join(F.transform("items", lambda x: x.cast("string")), ","), F.lit("")).alias("items"),
        F.coalesce("agreeing", F.lit(0)).cast("long").alias("agreeing"),
    )


SQL = rf"""
WITH dt AS (
  SELECT doc_id, unnest(tok) AS w, unnest(range(len(tok))) AS p
  FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS tok FROM documents)),
bt AS (
  SELECT item_id, unnest(tok) AS w, unnest(range(len(tok))) AS p
  FROM (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS tok FROM benchmark)
  WHERE len(tok) >= {WINDOW}),
m AS (SELECT doc_id, item_id, dt.p - bt.p AS g, bt.p AS p FROM dt JOIN bt USING (w)),
d AS (SELECT doc_id, item_id, g FROM m GROUP BY ALL HAVING count(*) >= {WINDOW - MISMATCHES}),
r AS (SELECT doc_id, item_id, count(*) OVER (PARTITION BY doc_id, item_id, g ORDER BY p
        RANGE BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS c FROM m SEMI JOIN d USING (doc_id, item_id, g)),
x AS (SELECT doc_id, list_sort(list(DISTINCT item_id)) AS i, max(c) AS c FROM r WHERE c >= {WINDOW - MISMATCHES} GROUP BY doc_id)
SELECT doc_id, i IS NOT NULL AS contaminated, CAST(coalesce(len(i), 0) AS BIGINT) AS n_items,
       coalesce(array_to_string(i, ','), '') AS items, CAST(coalesce(c, 0) AS BIGINT) AS agreeing
FROM documents LEFT JOIN x USING (doc_id)
"""
