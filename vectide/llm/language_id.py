"""Language identification with a linear-chain conditional random field over words.

Each word of a text gets a label distribution by forward-backward; features of a word are
its character n-grams of 1 to 4 bytes with the word's edges as a symbol (so prefixes and
suffixes are among them) and its whole form (the lexicon), transitions between labels of
neighbouring words are learned. A text's score for a language is the mean posterior of
its words, which also fits code-switched text.

Training: a bounded sample of per_label labelled texts a language (smallest hash of the
id among texts of at most max_chars characters) on the driver. Word labels are the
text's language; sequences chain segments of several texts, so that switches occur and
their weights are learned. Prediction reads whole texts: a chain is a text, or a part of
textbuf.PART characters of a longer one.

Defined results for odd input: null texts and texts without a letter give und and score
0; so do all texts if no labelled text exists; rows that repeat an id get the same
result each if their texts agree; ties go to the first label in order; an empty table
gives no rows; further columns pass through in identify(), whatever their names, unless
they are named like its output, which replaces them, and are ignored in the query.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectide.llm import textbuf
from vectide.llm.common import arrow_map, materialize, quoted
from vectide.llm.ngram_join import lots

BITS = 16
ORDERS = 4
#: Words and padding that are scored at once, but for a longer chain by itself.
AT_ONCE = 1 << 17
#: Words whose features are held at once.
SLICE = 1 << 14
_MULT = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)
_POWERS = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(64)], np.uint64)


def held_out(id_col: str) -> Column:
    """Rows kept out of all learning."""
    return F.crc32(F.col(id_col).cast("string")) % 3 == 1


def features(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Table slots (ORDERS + 1 tables) and the word each belongs to.

    Returns (slots, bounds): slots is positions x (ORDERS + 1) with slot 0 for nothing,
    bounds the first position of each word. A word's positions are its bytes and the
    edge after it; the lexicon slot stands at the edge.
    """
    size = ends - starts + 1
    bounds = np.cumsum(size) - size
    word = np.repeat(np.arange(len(starts)), size)
    depth = np.arange(len(word)) - bounds[word]
    pos = starts[word] + depth
    gram = buf[pos].astype(np.uint32)
    slots = np.zeros((len(pos), ORDERS + 1), np.int32)
    top = np.uint32(32 - BITS)
    for k in range(ORDERS):
        if k:
            gram = gram + (buf[np.maximum(pos - k, 0)].astype(np.uint32) << np.uint32(8 * k))
        slots[:, k] = np.where(depth >= k - 1, ((gram + np.uint32(k)) * np.uint32(_MULT[k])) >> top, 0)
    slots[depth == (ends - starts)[word], 0] = 0
    with np.errstate(over="ignore"):
        mixed = (buf[pos].astype(np.uint64) + np.uint64(1)) * _POWERS[depth & 63]
        total = np.add.reduceat(mixed, bounds) if len(bounds) else mixed[:0]
        total = (total ^ (total >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    slots[bounds + size - 1, ORDERS] = (total >> np.uint64(64 - BITS)).astype(np.int32)
    return slots, bounds


class Crf:
    """Weights of the chain: tables of slot x label, and label x label transitions."""

    def __init__(self, labels: list[str]):
        self.labels = labels
        self.w = np.zeros((ORDERS + 1, 1 << BITS, len(labels)), np.float32)
        self.a = np.zeros((len(labels), len(labels)), np.float32)

    def emissions(self, slots: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Word x label scores."""
        e = self.w[0][slots[:, 0]]
        for k in range(1, ORDERS + 1):
            e += self.w[k][slots[:, k]]
        return np.add.reduceat(e, bounds, axis=0) if len(bounds) else e[:0]

    def scores(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Word x label scores of words of a buffer, features being held for SLICE words at a time."""
        some = [slice(a, a + SLICE) for a in range(0, max(1, len(starts)), SLICE)]
        return np.concatenate([self.emissions(*features(buf, starts[s], ends[s])) for s in some])

    def posteriors(self, e: np.ndarray, on: np.ndarray, pairs: bool = False):
        """Label posteriors of padded chains e (time, chain, label), on (time, chain) marking words.

        With pairs also the expected counts of label pairs.
        """
        steps, chains, n = e.shape
        p = np.exp(np.clip(e - e.max(axis=2, keepdims=True), -30, 0))
        p[~on] = 1.0
        t = np.exp(self.a - self.a.max())
        back = np.ascontiguousarray(t.T)
        fwd, bwd = np.empty_like(p), np.empty_like(p)
        cur = p[0] / p[0].sum(1, keepdims=True)
        fwd[0] = cur
        for i in range(1, steps):
            cur = (cur @ t) * p[i]
            cur /= cur.sum(1, keepdims=True)
            if not on[i].all():
                cur = np.where(on[i][:, None], cur, fwd[i - 1])
            fwd[i] = cur
        cur = np.ones((chains, n), np.float32)
        bwd[-1] = cur
        for i in range(steps - 2, -1, -1):
            nxt = (cur * p[i + 1]) @ back
            nxt /= nxt.sum(1, keepdims=True)
            cur = np.where(on[i + 1][:, None], nxt, cur)
            bwd[i] = cur
        post = fwd * bwd
        post /= post.sum(2, keepdims=True)
        if not pairs:
            return post
        x = fwd[:-1][on[1:]][:, :, None] * t[None] * (p[1:] * bwd[1:])[on[1:]][:, None, :]
        return post, (x / x.sum((1, 2), keepdims=True)).sum(0)


def train(texts: list[str], langs: list[str], epochs: int = 4, segment: int = 30, joined: int = 4, chains: int = 256, rate: float = 0.15, seed: int = 7) -> Crf | None:
    """Fit a Crf by AdaGrad on chains of segments of labelled texts."""
    labels = sorted(set(langs))
    if not labels:
        return None
    crf, rng = Crf(labels), np.random.default_rng(seed)
    seg: list[tuple[int, int, int]] = []
    all_slots, all_bounds, held, base = [], [], 0, 0
    for at, lot in textbuf.parts(texts):
        buf, starts, ends, part = textbuf.words(lot)
        slots, bounds = features(buf, starts, ends)
        all_slots.append(slots)
        all_bounds.append(bounds + held)
        held += len(slots)
        lang = np.array([labels.index(langs[i]) for i in at])[part]
        for a in range(0, len(starts), segment):
            b = min(a + segment, len(starts))
            if (lang[a:b] == lang[a]).all():
                seg.append((base + a, base + b, int(lang[a])))
        base += len(starts)
    if not seg:
        return None
    slots, bounds = np.concatenate(all_slots), np.concatenate(all_bounds)
    size = np.diff(np.append(bounds, len(slots)))
    gw, ga = np.full_like(crf.w, 1e-3), np.full_like(crf.a, 1e-3)
    steps, n = segment * joined, len(labels)
    for _ in range(epochs):
        order = rng.permutation(len(seg))
        for lo in range(0, len(order), chains * joined):
            pick = order[lo : lo + chains * joined]
            rows = [pick[i : i + joined] for i in range(0, len(pick), joined)]
            ids = np.full((steps, len(rows)), -1)
            y = np.zeros((steps, len(rows)), int)
            for c, row in enumerate(rows):
                got = np.concatenate([np.arange(seg[s][0], seg[s][1]) for s in row])
                ids[: len(got), c] = got
                y[: len(got), c] = np.concatenate([np.full(seg[s][1] - seg[s][0], seg[s][2]) for s in row])
            on = ids >= 0
            used = ids[on]
            pos = np.concatenate([np.arange(bounds[w], bounds[w] + size[w]) for w in used])
            own = np.cumsum(size[used]) - size[used]
            e = np.zeros((steps, len(rows), n), np.float32)
            e[on] = crf.emissions(slots[pos], own)
            post, pair = crf.posteriors(e, on, pairs=True)
            grad = -post[on]
            grad[np.arange(len(used)), y[on]] += 1
            spread = np.repeat(grad, size[used], axis=0)
            for k in range(ORDERS + 1):
                s = slots[pos, k]
                for lab in range(n):
                    g = np.bincount(s, spread[:, lab], 1 << BITS).astype(np.float32)
                    g[0] = 0
                    gw[k, :, lab] += g * g
                    crf.w[k, :, lab] += rate * g / np.sqrt(gw[k, :, lab])
            seen = np.zeros((n, n), np.float32)
            both = on[1:]
            np.add.at(seen, (y[:-1][both], y[1:][both]), 1)
            g = (seen - pair).astype(np.float32)
            ga += g * g
            crf.a += rate * g / np.sqrt(ga)
    return crf


def classify(crf: Crf | None, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(language, score, share of words per label) of whole texts."""
    n = len(crf.labels) if crf else 1
    total, count = np.zeros((len(texts), n)), np.zeros(len(texts))
    for at, lot in textbuf.parts(texts) if crf else ():
        buf, starts, ends, part = textbuf.words(lot)
        if not len(starts):
            continue
        e = crf.scores(buf, starts, ends)
        first = np.flatnonzero(np.diff(part, prepend=-1))
        chain = sorted(zip(first.tolist(), np.append(first[1:], len(part)).tolist()), key=lambda x: x[0] - x[1])
        lo = 0
        while lo < len(chain):
            steps = chain[lo][1] - chain[lo][0]
            some = chain[lo : lo + max(1, min(256, AT_ONCE // steps))]
            lo += len(some)
            ids = np.full((steps, len(some)), -1)
            for c, (a, b) in enumerate(some):
                ids[: b - a, c] = np.arange(a, b)
            on = ids >= 0
            post = crf.posteriors(e[ids], on)
            post[~on] = 0
            where = np.array([at[part[a]] for a, _ in some])
            np.add.at(total, where, post.sum(0))
            np.add.at(count, where, on.sum(0))
    share = total / np.maximum(count, 1)[:, None]
    best = share.argmax(1)
    names, score = [], np.zeros(len(texts))
    for i, text in enumerate(texts):
        if count[i] == 0 or not textbuf.has_letter(text):
            names.append("und")
        else:
            names.append(crf.labels[best[i]])
            score[i] = min(1.0, max(0.0, share[i, best[i]]))
    return names, score, share


def training_sample(docs: DataFrame, id_col: str, text_col: str, label_col: str, per_label: int, max_chars: int) -> list:
    """At most per_label labelled rows a label that are not held out, by smallest id hash.

    A first pass counts a label's rows and keeps those below a hash that twice the wanted
    number is expected to fall under, so only a bounded sample is ranked.
    """
    ok = docs.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col) & (F.length(text_col) <= max_chars))
    ids = materialize(ok.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.xxhash64(F.col(id_col)).alias("h")), "language-ids")
    share = ids.groupBy("label").agg(F.least(F.lit(1.0), (2.0 * per_label + 100) / F.count("*")).alias("share"))
    low = ids.join(F.broadcast(share), "label").where(F.col("h") / 2.0**64 + 0.5 <= F.col("share"))
    order = Window.partitionBy("label").orderBy("h", "id")
    few = low.withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_label).select("id", "label").distinct()
    text = ok.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(text_col).alias("text"))
    return text.join(F.broadcast(few), ["id", "label"]).orderBy("label", "id").collect()


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_label: int = 200, max_chars: int = 20000) -> DataFrame:
    """docs with lang_pred and lang_score added."""
    docs = docs.select(*[quoted(c) for c in docs.columns if c.lower() not in ("lang_pred", "lang_score")])
    sample = training_sample(docs, id_col, text_col, lang_col, per_label, max_chars)
    crf = train([r.text for r in sample], [r.label for r in sample])
    shared = docs.sparkSession.sparkContext.broadcast(crf)
    at = docs.columns.index(text_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part in lots(batches, at, 1 << 22):
            names, scores, _ = classify(model, part.column(at).to_pylist())
            columns = [*part.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names, "lang_pred", "lang_score"])

    more = [T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())]
    return arrow_map(docs, score, more)


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of every whole text of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    got = identify(docs)
    return got.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def crc_held_out(doc_id: int) -> bool:
    """held_out for a plain value."""
    return zlib.crc32(str(doc_id).encode()) % 3 == 1
