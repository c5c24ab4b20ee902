"""Personal data by base patterns plus bootstrapped contextual extraction.

Base: leftmost non-overlapping matches of four patterns, kept if they pass a check
(an address part of at most 255, 12 to 19 digits and Luhn for cards, 9 to 15 digits
for phones). Spans count code points, the end is exclusive.

Bootstrapping. Instances are whole base spans (of spans that overlap, the first and
longest) and runs of words that look like identifiers (a digit or an at sign) and overlap
no base span, less the punctuation at their ends and what stands before the last =, : or
quote of their first word. Seeds are the base spans and, as kind secret, runs of SECRET
shape: 16 or more letters, digits, _ and -, two letters and two digits among them.

Lexical patterns of an instance are the two tokens before it (words without digits, = and
:, lower-cased, also those inside its word as in password=...) and, marked ^, its own first
four letters. A pattern's background is how often its tokens stand anywhere in the texts,
so common words are poor patterns however many identifiers they meet. Rounds of scoring over the
pattern-instance graph alternate until no score moves: a pattern's confidence is the
summed score of its occurrences over its background plus one; an unseen instance's score
is the noisy-or of its patterns' confidences; seeds keep 1. Instances beside the base
spans that score min_score or more, next to a pattern of min_seeds distinct seeds, of
confidence min_conf or more, and of whose background min_share or more are seeds, are added as
spans of kind ctx_<kind>.

Positions come from pairing regexp_extract_all with split: a match starts where the
pieces and matches before it end, summed by a window, so cost is linear in the text.
All of it is DataFrame functions. The patterns are possessive and anchored at run
starts, which yields the same leftmost matches without quadratic backtracking.

Defined results for odd input: null and empty texts have no spans; rows that repeat an
id and a text get the same result each; an empty table gives no rows; further columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectide.llm.common import materialize, small_side

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A cheap test that a text can hold a match at all.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
_WS = r"\x20\x09-\x0D"
#: A word with a digit or an at sign.
IDENTIFIER = rf"(?<![^{_WS}])(?=[^{_WS}]*[0-9@])[^{_WS}]++"
#: Runs that are seeds though no base pattern matches them.
SECRET = r"^(?=.*[0-9].*[0-9])(?=.*[A-Za-z].*[A-Za-z])[A-Za-z0-9_-]{16,}$"
#: What contexts are made of.
TOKEN = r"[\p{L}_]+|[=:]"


def _found(text: Column, pattern: str, needs: str) -> Column:
    return F.when(text.rlike(needs), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    back = F.reverse(digits)

    def add(acc: Column, j: Column) -> Column:
        d = F.substring(back, j + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return acc + F.when(j % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _valid(kind: Column, m: Column) -> Column:
    part = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
    n = F.length(_digits(m))
    return (
        F.when(kind == "ip", F.forall(F.split(m, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.substring(part(p), 1, 4).cast("int") <= 255)))
        .when(kind == "card", n.between(12, 19) & F.when(n.between(12, 19), luhn(_digits(m))).otherwise(F.lit(False)))
        .when(kind == "phone", n.between(9, 15))
        .otherwise(F.lit(True))
    )


def matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One scan of the texts: (id, h, found), found holding (kind, i, gap, sep, left, m) of every raw match.

    sep is the text between a word and the one matched before it if that is spaces and tabs only; left holds the last three words, last first, of the text between a word and the one matched before it.
    """
    t = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    patterns = {**PATTERNS, "word": IDENTIFIER}
    needs = {**NEEDS, "word": "[0-9@]"}
    t = t.select("id", F.xxhash64("t").alias("h"), "t", *[_found(F.col("t"), p, needs[k]).alias(f"m_{k}") for k, p in patterns.items()])
    t = t.select("id", "h", *[f"m_{k}" for k in patterns], *[F.when(F.size(f"m_{k}") > 0, F.split("t", p, -1)).alias(f"p_{k}") for k, p in patterns.items()])

    def rows(k: str) -> Column:
        gap = lambda i: F.element_at(f"p_{k}", i + 1)
        last = lambda i: F.transform(F.slice(F.regexp_extract_all(F.regexp_extract(F.reverse(gap(i)), rf"^[{_WS}]*+(?:[^{_WS}]++[{_WS}]*+){{0,3}}", 0), F.lit(rf"[^{_WS}]++"), F.lit(0)), 1, 3), F.reverse)
        left = last if k == "word" else (lambda i: F.lit(None).cast("array<string>"))
        sep = (lambda i: F.when((i > 0) & gap(i).rlike(r"^[\x20\x09]++\z"), gap(i))) if k == "word" else (lambda i: F.lit(None).cast("string"))
        return F.transform(f"m_{k}", lambda m, i: F.struct(F.lit(k).alias("kind"), i.alias("i"), F.length(gap(i)).alias("gap"), sep(i).alias("sep"), left(i).alias("left"), m.alias("m")))

    return t.select("id", "h", F.concat(*[rows(k) for k in patterns]).alias("found"))


def placed(found: DataFrame) -> DataFrame:
    """Raw matches with their code-point spans: (id, h, kind, start, end, sep, pattern, m).

    pattern is the text of up to three words before a word, be they matched words or not.
    """
    rows = found.where(F.size("found") > 0).select("id", "h", F.explode("found").alias("x")).select("id", "h", "x.*").dropDuplicates(["id", "h", "kind", "i"])
    so_far = Window.partitionBy("id", "h", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum((F.col("gap") + F.length("m")).cast("long")).over(so_far)
    order = Window.partitionBy("id", "h", "kind").orderBy("i")
    back = lambda c, k: F.when(F.col("kind") == "word", F.lag(c, k).over(order))
    none = F.array().cast("array<string>")
    one = lambda c: F.when(c.isNotNull(), F.array(c)).otherwise(none)
    before = F.concat(F.coalesce("left", none), one(back("m", 1)), F.coalesce(back("left", 1), none), one(back("m", 2)), F.coalesce(back("left", 2), none), one(back("m", 3)))
    pattern = F.when(F.col("kind") == "word", F.concat_ws(" ", F.reverse(F.slice(before, 1, 3))))
    rows = rows.withColumn("end", end).withColumn("pattern", pattern)
    return rows.select("id", "h", "kind", (F.col("end") - F.length("m")).alias("start"), "end", "sep", "pattern", "m")


def background(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, uses): how often the tokens of patterns stand in texts (t)."""
    tokens = texts.select(F.regexp_extract_all(F.lower(F.coalesce("t", F.lit(""))), F.lit(TOKEN), F.lit(0)).alias("w"))
    each = F.transform(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.struct(F.when(i > 0, F.col("w")[i - 1]).alias("a"), F.col("w")[i].alias("b")))
    each = tokens.where(F.size("w") > 0).select(F.explode(each).alias("x")).select("x.a", "x.b")
    pairs = patterns.where(~F.col("pattern").startswith("^")).select("pattern", F.split("pattern", " ")[0].alias("a"), F.split("pattern", " ")[1].alias("b"))
    starts = patterns.where(F.col("pattern").startswith("^")).select("pattern", F.substring("pattern", 2, 4).alias("s"))
    met = each.join(small_side(pairs, 96), ["a", "b"]).select("pattern")
    met = met.unionByName(each.join(small_side(starts, 64), F.substring("b", 1, 4) == F.col("s")).select("pattern"))
    return met.groupBy("pattern").agg(F.count("*").alias("uses"))


def induce(texts: DataFrame, spans: DataFrame, words: DataFrame, rounds: int = 50, min_seeds: int = 3, min_conf: float = 0.7, min_score: float = 0.7, min_share: float = 0.5) -> DataFrame:
    """Spans that high-confidence contexts add: (id, h, kind, start, end).

    texts (t) give the background, spans are the checked base spans with their text m,
    words the placed identifier words.
    """
    none = lambda *cs: [F.lit(None).cast("string").alias(c) for c in cs]
    both = words.select("id", "h", "start", "end", "sep", "m", "pattern", *none("kind")).unionByName(spans.select("id", "h", "start", "end", "m", "kind", *none("sep", "pattern")))
    part = Window.partitionBy("id", "h")
    base = F.col("kind").isNotNull()
    on = part.orderBy("start", F.col("kind").isNotNull(), F.desc("end"), "kind")
    so_far = on.rowsBetween(Window.unboundedPreceding, 0)
    both = both.select(
        "*",
        F.last(F.when(~base, F.struct("pattern")), ignorenulls=True).over(so_far)["pattern"].alias("lead"),
        F.max(F.when(base, F.col("end"))).over(on.rowsBetween(Window.unboundedPreceding, -1)).alias("reach"),
        F.min(F.when(base, F.col("start"))).over(on.rowsBetween(0, Window.unboundedFollowing)).alias("next"),
    )
    both = materialize(both, "pii-both")
    clear = F.coalesce(F.col("reach") <= F.col("start"), F.lit(True))
    seeds = both.where(base & clear).select("id", "h", "start", "end", F.col("m").alias("inst"), F.col("lead").alias("pattern"), F.col("kind").alias("seed"))
    free = both.where(~base & clear & F.coalesce(F.col("next") >= F.col("end"), F.lit(True)))
    on = part.orderBy("start")
    joined = F.col("sep").isNotNull() & (F.lag("end").over(on) + F.length("sep") == F.col("start"))
    free = free.withColumn("new", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1))
    free = free.withColumn("run", F.sum("new").over(on.rowsBetween(Window.unboundedPreceding, 0)))
    item = F.struct("start", F.when(F.col("new") == 0, F.concat("sep", "m")).otherwise(F.col("m")).alias("m"))
    runs = free.groupBy("id", "h", "run").agg(F.array_sort(F.collect_list(item)).alias("ms"), F.max(F.when(F.col("new") == 1, F.col("pattern"))).alias("pattern"))
    runs = runs.select("id", "h", F.col("ms")[0]["start"].alias("from"), F.array_join(F.transform("ms", lambda x: x["m"]), "").alias("m"), "pattern")
    inner = F.regexp_extract("m", rf"^(?:[^{_WS}]*[=:\"'](?=[A-Za-z0-9+]))?[^A-Za-z0-9+]*+", 0)
    core = F.reverse(F.regexp_replace(F.reverse("tail"), r"^[^A-Za-z0-9]++", ""))
    runs = runs.withColumn("inner", inner).withColumn("tail", F.substring("m", F.length("inner") + 1, F.length("m")))
    runs = runs.select("id", "h", (F.col("from") + F.length("inner")).alias("start"), core.alias("inst"), F.concat_ws(" ", "pattern", "inner").alias("pattern")).where("inst <> ''")
    secret = F.when(F.col("inst").rlike(SECRET), F.lit("secret"))
    runs = runs.select("id", "h", "start", (F.col("start") + F.length("inst")).alias("end"), "inst", "pattern", secret.alias("seed"))
    seen = seeds.unionByName(runs)
    context = F.slice(F.reverse(F.regexp_extract_all(F.lower(F.coalesce("pattern", F.lit(""))), F.lit(TOKEN), F.lit(0))), 1, 2)
    before = F.when(F.size(context) == 2, F.array_join(F.reverse(context), " "))
    begin = F.when(F.col("inst").rlike("^[A-Za-z]{4}"), F.concat(F.lit("^"), F.lower(F.substring("inst", 1, 4))))
    seen = materialize(seen.select("id", "h", "start", "end", "inst", "seed", F.array_compact(F.array(before, begin)).alias("patterns")), "pii-words")
    edges = seen.select("inst", "seed", F.explode("patterns").alias("pattern")).groupBy("pattern", "inst").agg(F.max("seed").alias("seed"), F.count("*").alias("n"))
    edges = materialize(edges, "pii-edges")
    known = materialize(edges.groupBy("inst").agg(F.max("seed").alias("kind")), "pii-known")
    edges = edges.drop("seed").join(small_side(known, 128), "inst")
    told = F.when(F.col("kind").isNotNull(), F.col("n")).otherwise(0)
    able = edges.groupBy("pattern").agg(F.count("kind").alias("seeds"), F.sum(told).alias("told"), F.sum("n").alias("n"), F.max("kind").alias("pattern_kind"))
    able = materialize(able.where((F.col("seeds") >= min_seeds) & (F.col("told") >= min_share * F.col("n"))), "pii-able")
    uses = materialize(background(texts, able), "pii-uses")
    able = able.drop("n").join(small_side(uses, 64), "pattern").where(F.col("told") >= min_share * F.col("uses"))
    able = materialize(able, "pii-able")
    edges = materialize(edges.join(small_side(able.select("pattern", "uses"), 64), "pattern"), "pii-edges")
    score = edges.select("inst", F.when(F.col("kind").isNotNull(), 1.0).otherwise(0.0).alias("score")).distinct()
    last = -1.0
    for _ in range(rounds):
        conf = edges.join(small_side(materialize(score, "pii-scores"), 96), "inst").groupBy("pattern", "uses").agg(F.sum(F.col("n") * F.col("score")).alias("s"))
        conf = materialize(conf.select("pattern", F.least(F.col("s") / (F.col("uses") + 1), F.lit(0.999999)).alias("conf")), "pii-conf")
        lifted = 1 - F.exp(F.sum(F.log1p(-F.col("conf"))))
        score = edges.join(small_side(conf, 64), "pattern").groupBy("inst", "kind").agg(lifted.alias("lifted"))
        score = score.select("inst", F.when(F.col("kind").isNotNull(), 1.0).otherwise(F.col("lifted")).alias("score"))
        now = conf.agg(F.sum("conf")).first()[0] or 0.0
        if now - last < 1e-3:
            break
        last = now
    sure = materialize(able.join(conf.where(F.col("conf") >= min_conf), "pattern").select("pattern", "pattern_kind"), "pii-sure")
    good = materialize(score.where(F.col("score") >= min_score).select("inst"), "pii-good")
    rest = seen.where("seed is null or seed = 'secret'").select("id", "h", "start", "end", "inst", F.explode("patterns").alias("pattern"))
    rest = rest.join(small_side(sure, 64), "pattern").join(small_side(good, 64), "inst", "left_semi")
    return rest.groupBy("id", "h", "start", "end").agg(F.concat(F.lit("ctx_"), F.max("pattern_kind")).alias("kind"))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **bootstrap) -> DataFrame:
    """One row per document: id, spans as (kind, start, end) arrays, base and all.

    base holds the checked pattern matches, extra what contexts add. Both are sorted by
    start, then kind in the order listed.
    """
    found = materialize(matches(docs, id_col, text_col), "pii-found")
    spots = materialize(placed(found), "pii-placed")
    spans = spots.where((F.col("kind") != "word") & _valid(F.col("kind"), F.col("m"))).select("id", "h", "kind", "start", "end", "m")
    extra = induce(docs.select(F.col(text_col).alias("t")), spans, spots.where("kind = 'word'"), **bootstrap)
    order = F.array_position(F.array(*map(F.lit, [*KINDS, "secret"])), F.regexp_replace("kind", "^ctx_", "")) + F.when(F.col("kind").startswith("ctx_"), len(KINDS)).otherwise(0)
    every = spans.drop("m").withColumn("base", F.lit(True)).unionByName(extra.withColumn("base", F.lit(False)))
    item = F.struct("start", order.alias("order"), "kind", "end")
    per_doc = every.groupBy("id", "h").agg(
        F.array_sort(F.collect_list(F.when(F.col("base"), item))).alias("base"),
        F.array_sort(F.collect_list(item)).alias("all"),
    )
    out = found.select("id", "h").join(per_doc, ["id", "h"], "left")
    none = F.array().cast("array<struct<start:bigint,order:bigint,kind:string,end:bigint>>")
    fill = lambda c: F.coalesce(F.col(c).cast("array<struct<start:bigint,order:bigint,kind:string,end:bigint>>"), none).alias(c)
    return out.select(F.col("id").alias(id_col), fill("base"), fill("all"))


def _joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data in every whole text of documents."""
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    every = F.size("all").cast("long")
    return found.select("doc_id", *map(count, KINDS), F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("all").alias("spans"), (every - F.size("base")).alias("n_context"), every.alias("n_found"), (every > 0).alias("found"))
