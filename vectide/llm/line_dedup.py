"""Line dedup by a deletion-neighbourhood join with an edit bound of one.

A line is a stretch of text between newline characters. Lines of min_chars code points
or more (spaces at both ends not counted) take part. With every_line, shorter lines that
hold anything but ASCII white space take part in the first rule; else they always stay.
Two rules, judged on the input: of equal lines the earliest occurrence, by (id, line
number), stays; and a line goes in all its occurrences if another line within one edit
(insert, delete or substitute one code point) first occurs earlier.

Method. Equal lines fold into one row by a 128-bit hash. Two different lines within one
edit agree in their first or in their last half, so each line emits four half keys and
only lines that share one go on; these agree with a partner in all but one of BLOCKS
blocks, which is keyed and matched likewise. Neither filter loses a pair. What is left
emits all its variants with one code point deleted in the blocks that may differ, as
hashed keys (variant, position), and itself as (variant, none). Lines that meet in
(variant, position) differ by one substitution there; a line that equals a variant is one
deletion away. So the earliest partner is a grouped minimum of the key, and no pairs
within a group are ever listed. The partner found is verified by edit distance.

Defined results for odd input: null texts stay null and have no lines; empty texts have
one empty line, which stays; ids are expected to be unique, rows that repeat an id and
text are folded together; an empty table gives no rows; further columns pass through,
whatever their names, but n_lines and n_removed, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectide.llm.common import materialize, quoted, small_side, unused

#: Blocks of the second, finer filter.
BLOCKS = 16


def _lines(docs: DataFrame, min_chars: int, every_line: bool) -> DataFrame:
    rows = docs.select("id", F.posexplode(F.split("t", "\n", -1)).alias("no", "line"))
    long = F.length(F.trim("line")) >= min_chars
    return rows.where(long | F.col("line").rlike(r"[^ \t\r\x0b\x0c]") if every_line else long)


def _hashes(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(7), line).alias("h2")]


def _half_keys(line: str) -> list[Column]:
    """Four keys: the first and the last half for a partner as long, and for one shorter by one."""
    n = F.length(line)
    out = []
    for short in (0, 1):
        m = n - short
        h = (m / 2).cast("int")
        out.append(F.xxhash64(F.lit(1), m, F.substring(F.col(line), F.lit(1), h)).alias(f"p{short}"))
        out.append(F.xxhash64(F.lit(2), m, F.right(F.col(line), m - h)).alias(f"s{short}"))
    return out


def _block_keys(line: str) -> Column:
    """Keys of all but one block, with the positions that an edit in that block can have.

    m is the shorter length of a pair: the line's own, or one less for a shorter partner.
    """

    def keys(short: int) -> Column:
        m = F.length(line) - short

        def one(j: Column) -> Column:
            lo, hi = (j * m / BLOCKS).cast("int"), ((j + 1) * m / BLOCKS).cast("int")
            key = F.xxhash64(F.lit(3), m, j, F.substring(F.col(line), F.lit(1), lo), F.right(F.col(line), m - hi))
            return F.struct(key.alias("key"), lo.alias("lo"), (hi - 1 + short).alias("hi"))

        return F.transform(F.sequence(F.lit(0), F.lit(BLOCKS - 1)), one)

    return F.concat(keys(0), keys(1))


def dropped_lines(docs: DataFrame, min_chars: int = 20, every_line: bool = False) -> DataFrame:
    """The lines of docs (id, t) to drop, as (id, no)."""
    line = F.col("line")
    halves = ["p0", "s0", "p1", "s1"]
    classes = _lines(docs, min_chars, every_line).select("id", "no", *_hashes(line), *_half_keys("line"), (F.length(F.trim(line)) >= min_chars).alias("long")).groupBy("h1", "h2")
    classes = classes.agg(F.min(F.struct("id", "no")).alias("first"), F.count("*").alias("c"), *[F.min(k).alias(k) for k in [*halves, "long"]])
    classes = materialize(classes, "line-classes")
    keys = classes.where("long").select("h1", F.explode(F.array(*halves)).alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    live = materialize(keys.join(shared, "key", "left_semi").select("h1").distinct(), "line-live")
    wanted = classes.where("long").select("h1", "first").join(small_side(live, 24), "h1", "left_semi")
    wanted = materialize(wanted.groupBy(F.col("first.id").alias("id")).agg(F.collect_list("first.no").alias("nos")), "line-wanted")
    texts = docs.join(small_side(wanted, 24 + 4 * F.size("nos")), "id").select("id", F.split("t", "\n", -1).alias("ls"), F.explode("nos").alias("no"))
    texts = materialize(texts.select(F.struct("id", "no").alias("at"), F.col("ls")[F.col("no")].alias("line")).dropDuplicates(["at"]), "line-texts")
    blocks = texts.select("at", F.explode(_block_keys("line")).alias("k")).select("at", "k.*")
    common = blocks.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    open_ = blocks.join(common, "key", "left_semi").groupBy("at").agg(F.collect_set(F.struct("lo", "hi")).alias("open"))
    texts = materialize(texts.join(open_, "at"), "line-open")
    spots = F.array_distinct(F.flatten(F.transform("open", lambda r: F.when(r["hi"] >= r["lo"], F.sequence(r["lo"], r["hi"])).otherwise(F.array().cast("array<int>")))))

    def variant(x: Column) -> Column:
        v = F.concat(F.substring(line, F.lit(1), x), F.substring(line, x + 2, F.length(line)))
        return F.struct(F.xxhash64(v).alias("v1"), F.xxhash64(F.lit(7), v).alias("v2"), x.alias("x"))

    own = F.array(F.struct(F.xxhash64(line).alias("v1"), F.xxhash64(F.lit(7), line).alias("v2"), F.lit(-1).alias("x")))
    variants = texts.select("at", F.explode(F.concat(own, F.transform(spots, variant))).alias("v")).select("at", "v.*")
    variants = materialize(variants, "line-variants")
    at_spot = variants.where("x >= 0").groupBy("v1", "v2", "x").agg(F.min("at").alias("to"), F.max("at").alias("hi")).where("to < hi").drop("hi")
    itself = variants.groupBy("v1", "v2").agg(F.min("at").alias("to"), F.max(F.when(F.col("x") == -1, F.col("at"))).alias("own"), F.max("x").alias("x")).where("own is not null and x >= 0").drop("x")
    pairs = (
        variants.where("x >= 0").join(at_spot, ["v1", "v2", "x"]).select("at", "to")
        .unionByName(variants.where("x >= 0").join(itself, ["v1", "v2"]).select("at", F.col("own").alias("to")))
        .unionByName(itself.select(F.col("own").alias("at"), "to"))
        .where("to < at").distinct()
    )
    both = texts.select("at", "line")
    near = (
        pairs.join(both, "at").join(both.select(F.col("at").alias("to"), F.col("line").alias("other")), "to")
        .where(F.levenshtein("line", "other", 1) == 1).select("at").distinct()
    )
    near = materialize(near, "line-near")
    gone = classes.select("h1", "h2", "first", "c").join(small_side(near, 48), F.col("first") == F.col("at"), "left").where("c > 1 or at is not null")
    gone = materialize(gone.select("h1", "h2", "first", F.col("at").isNotNull().alias("all")), "line-hashes")
    lines = _lines(docs, min_chars, every_line).select("id", "no", *_hashes(line))
    return lines.join(gone, ["h1", "h2"]).where(F.col("all") | (F.struct("id", "no") != F.col("first"))).select("id", "no")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, every_line: bool = False) -> DataFrame:
    """docs with the dropped lines taken out of the text, plus n_lines and n_removed."""
    names = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    key, nos = unused("gone_id", names), unused("gone_lines", names)
    slim = docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("t"))
    gone = dropped_lines(slim, min_chars, every_line).groupBy("id").agg(F.sort_array(F.collect_set("no")).alias(nos))
    gone = materialize(gone, "line-gone").withColumnRenamed("id", key)
    out = docs.join(small_side(gone, 24 + 4 * F.size(nos)), quoted(id_col) == F.col(key), "left").drop(key)
    none = F.array().cast("array<int>")
    ls = F.split(quoted(text_col), "\n", -1)
    last = F.concat(F.array(F.lit(-1)), F.slice(nos, F.lit(1), F.size(nos) - 1))
    gaps = F.zip_with(nos, last, lambda a, b: a - b - 1)
    stays = F.flatten(F.transform(gaps, lambda n: F.concat(F.array_repeat(F.lit(True), n), F.array(F.lit(False)))))
    kept = F.zip_with(ls, stays, lambda x, y: F.when(F.coalesce(y, F.lit(True)), x))  # array_join skips nulls
    text = F.when(F.col(nos).isNull(), quoted(text_col)).otherwise(F.array_join(kept, "\n"))
    return out.select(
        *[text.alias(text_col) if c == text_col else quoted(c) for c in names],
        F.coalesce(F.size(ls), F.lit(0)).cast("long").alias("n_lines"),
        F.size(F.coalesce(nos, none)).cast("long").alias("n_removed"),
    )


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Line dedup of the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return line_dedup(docs)


def op5_line_dedup_every(spark, sf_dir: str) -> DataFrame:
    """Line dedup of the whole documents table, equal lines of any length included."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return line_dedup(docs, every_line=True)


SQL = """
WITH l AS (
  SELECT doc_id, i - 1 AS no, string_split(text, chr(10))[i] AS line
  FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
q AS (SELECT *, min((doc_id, no)) OVER (PARTITION BY line) AS f FROM l WHERE length(trim(line, ' ')) >= 20),
c AS (SELECT DISTINCT line, f, length(line) AS n FROM q),
near AS (
  SELECT DISTINCT a.line FROM c a JOIN c b ON b.n BETWEEN a.n - 1 AND a.n + 1
   AND (left(a.line, least(a.n, b.n) // 2) = left(b.line, least(a.n, b.n) // 2)
        OR right(a.line, least(a.n, b.n) - least(a.n, b.n) // 2) = right(b.line, least(a.n, b.n) - least(a.n, b.n) // 2))
  WHERE a.line <> b.line AND b.f < a.f AND levenshtein(a.line, b.line) = 1),
gone AS (SELECT doc_id, no FROM q LEFT JOIN near USING (line) WHERE near.line IS NOT NULL OR (doc_id, no) <> f),
s AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.no) AS n_removed,
         string_agg(CASE WHEN g.no IS NULL THEN line END, chr(10) ORDER BY l.no) AS t
  FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.no = l.no GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(t, '') END AS text,
       coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed
FROM documents d LEFT JOIN s USING (doc_id)
"""

_LONG = "WHERE length(trim(line, ' ')) >= 20"
EVERY_SQL = SQL.replace(_LONG, rf"{_LONG} OR regexp_matches(line, '[^ \t\r\x0b\x0c]')").replace("AS n FROM q)", f"AS n FROM q {_LONG})")
