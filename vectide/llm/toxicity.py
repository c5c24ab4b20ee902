"""Toxicity by weak supervision: voters, a generative label model, a linear classifier.

1. Voters. Single words (lexicon voters) and word beginnings or ends of 3 to 7 bytes
   (pattern voters) that are far likelier in labelled toxic texts vote toxic where they
   occur, those likelier in the others vote clean; four more speak where none, few, many or
   very many of the toxic ones occur, so a passing mention is a vote for clean; elsewhere
   they abstain. Each rule reads a text alone; the labels pick the rules and are no votes.
2. Label model. A latent class model of the votes is fitted by expectation maximisation
   over labelled and unlabelled texts, labels weighing the rates and never the posterior: per
   class each voter's rate (its accuracy) and, along a maximum spanning tree of
   conditional mutual information, its dependence on one other voter (the correlations),
   so that voters that fire together do not count twice. Abstaining says nothing.
3. Classifier. Logistic regression on hashed word, beginning and end features, trained
   on the posterior labels.

Training uses a bounded sample, per_class labelled rows a class and as many unlabelled
ones (smallest id hash) of texts of at most max_chars characters, never held-out rows. Its
features are counted a lot of texts at a time; only those that a rule uses are held.
Scoring reads whole texts.

Defined results for odd input: null and empty texts get the classifier's prior; with no
labelled row of both classes every score is 0; several labels of an id count as toxic if
one is; of ties in the hash the smaller id is taken; rows that repeat an id get equal
scores for equal texts; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.llm import textbuf
from vectide.llm.common import materialize, release, tidy
from vectide.llm.language_id import held_out
from vectide.llm.ngram_join import lots

BITS = 20
EDGES = (3, 4, 5, 6, 7)
_M = np.uint64(0x9E3779B97F4A7C15)
_KINDS = 1 + 2 * len(EDGES)
TIMES = (1, 2, 3)


def word_features(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashed features of words, one column a kind: whole word, beginnings, ends; -1 for none."""
    size = ends - starts
    out = np.full((len(starts), _KINDS), -1, np.int32)
    if not len(starts):
        return out
    with np.errstate(over="ignore"):

        def slot(h: np.ndarray, kind: int) -> np.ndarray:
            h = (h ^ (h >> np.uint64(31))) * (_M + np.uint64(2 * kind))
            return (h >> np.uint64(64 - BITS)).astype(np.int32)

        for side in (0, 1):
            h = np.zeros(len(starts), np.uint64)
            for k in range(1, max(EDGES) + 1):
                at = starts + (k - 1) if side == 0 else ends - k
                h = (h + buf[np.clip(at, 0, len(buf) - 1)].astype(np.uint64) + np.uint64(1)) * _M
                if k in EDGES:
                    c = 1 + side * len(EDGES) + EDGES.index(k)
                    out[:, c] = np.where(size > k, slot(h, c), -1)
        longest = int(min(size.max(), 64))
        h = np.zeros(len(starts), np.uint64)
        live = np.arange(len(starts))
        for k in range(longest):
            live = live[size[live] > k]
            h[live] = (h[live] + buf[starts[live] + k].astype(np.uint64) + np.uint64(1)) * _M
        out[:, 0] = slot(h + size.astype(np.uint64), 0)
    return out


def again(slot: np.ndarray, times: int) -> np.ndarray:
    """Slot of the feature that a feature occurs in at least times different words."""
    if times == 1:
        return slot
    return ((slot.astype(np.int64) + 1) * (2654435761 + 2 * times) >> 7 & ((1 << BITS) - 1)).astype(np.int32)


def counted(texts: list[str | None], wanted: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sorted (text, slot, in how many different words) of the features whose slot is wanted, some whole texts at a time."""
    kept, mask = np.zeros(0, np.int64), (1 << BITS) - 1

    def tally(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key, count = np.unique(key >> BITS, return_counts=True)
        return key >> BITS, (key & mask).astype(np.int32), count

    for at, lot in textbuf.parts(texts, limit):
        f = word_features(*(w := textbuf.words(lot))[:3])
        word, kind = np.nonzero((f >= 0) & wanted[f])
        key = np.asarray(at, np.int64)[w[3][word]] << (2 * BITS) | f[word, kind].astype(np.int64) << BITS | f[word, 0]
        key = np.unique(np.concatenate([kept, key]))
        last = np.searchsorted(key, at[-1] << (2 * BITS))  # that text may go on in the next lot
        kept = key[last:].copy()
        yield tally(key[:last])
    yield tally(kept)


def presence(texts: list[str | None], wanted: np.ndarray, limit: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(text, slot) pairs, each once: features in one, two and three or more different words.

    Only features whose slot is wanted are counted.
    """
    rows, slots = ([[] for _ in TIMES] for _ in range(2))
    for row, slot, count in counted(texts, wanted, limit):
        for i, t in enumerate(TIMES):
            rows[i].append(row[count >= t])
            slots[i].append(again(slot[count >= t], t))
    return np.concatenate(sum(rows, [])), np.concatenate(sum(slots, []))


def sources(slots: np.ndarray) -> np.ndarray:
    """Which slots a word's features must have to end, once or more often in a text, in the marked slots."""
    every = np.arange(1 << BITS, dtype=np.int32)
    return np.logical_or.reduce([slots[again(every, t)] for t in TIMES])


def class_counts(texts: list[str | None], y: np.ndarray, limit: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """In how many toxic and in how many other labelled texts each slot stands; holds a lot of texts at a time."""
    told = np.flatnonzero(np.isfinite(y))
    mark = y[told] == 1
    found = np.zeros((2, 1 << BITS))
    for row, slot, count in counted([texts[i] for i in told], np.ones(1 << BITS, bool), limit):
        for t in TIMES:
            some = count >= t
            at, toxic = again(slot[some], t), mark[row[some]]
            found[0] += np.bincount(at[toxic], minlength=1 << BITS)
            found[1] += np.bincount(at[~toxic], minlength=1 << BITS)
    return found[0], found[1]


@dataclass
class LabelModel:
    """Class prior and, per voter and class, firing rates given the parent voter's state."""

    prior: float
    parent: np.ndarray
    rate: np.ndarray  # class x parent state x voter

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(toxic | votes) of rows of votes, 1 where a voter speaks and 0 where it abstains."""
        state = np.where(self.parent >= 0, votes[:, self.parent], 0).astype(int)
        logs = []
        for y in (0, 1):
            r = np.where(state == 1, self.rate[y, 1], self.rate[y, 0])
            told = np.where(votes == 1, np.log(r), 0).sum(1)
            logs.append(told + np.log(self.prior if y else 1 - self.prior))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -60, 60)))


def _tree(votes: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Parent of each voter in the maximum spanning tree of mutual information given the class."""
    n = votes.shape[1]
    info = np.zeros((n, n))
    for w in (q, 1 - q):
        total = w.sum() + 1e-9
        p1 = (votes * w[:, None]).sum(0) / total
        p11 = (votes * w[:, None]).T @ votes / total
        for a, b, joint in ((p1, p1, p11), (p1, 1 - p1, p1[:, None] - p11), (1 - p1, p1, p1[None, :] - p11), (1 - p1, 1 - p1, 1 - p1[:, None] - p1[None, :] + p11)):
            joint = np.clip(joint, 1e-12, 1)
            info += total * joint * np.log(joint / np.clip(np.outer(a, b), 1e-12, 1))
    parent, best, src = np.full(n, -1), info[0].copy(), np.zeros(n, int)
    left = set(range(1, n))
    while left:
        v = max(left, key=lambda j: best[j])
        left.discard(v)
        parent[v] = src[v]
        better = info[v] > best
        best[better], src[better] = info[v][better], v
    return parent


def rates(votes: np.ndarray, q: np.ndarray) -> LabelModel:
    """The label model that posteriors q suggest."""
    parent = _tree(votes, q)
    state = np.where(parent >= 0, votes[:, parent], 0)
    rate = np.zeros((2, 2, votes.shape[1]))
    for y, w in ((0, 1 - q), (1, q)):
        alone = ((votes * w[:, None]).sum(0) + 0.5) / (w.sum() + 1)
        for s in (0, 1):
            m = (state == s) * w[:, None]
            rate[y, s] = ((votes * m).sum(0) + 2 * alone) / (m.sum(0) + 2)
    return LabelModel(float(np.clip(q.mean(), 0.01, 0.99)), parent, np.clip(rate, 1e-4, 1 - 1e-4))


def fit_label_model(votes: np.ndarray, y: np.ndarray, rounds: int = 15) -> LabelModel:
    """Expectation maximisation over all rows of votes; y is nan where no label is.

    Labels, where given, weigh the rates; posteriors are of the votes alone.
    """
    told = np.isfinite(y)
    model, q = rates(votes[told], y[told]), y.copy()
    for _ in range(rounds):
        new = model.posterior(votes[~told])
        moved = np.abs(new - np.nan_to_num(q[~told], nan=-1.0)).max(initial=0.0)
        if moved < 1e-3:
            break
        q[~told] = new
        model = rates(votes, q)
    return model


@dataclass
class Model:
    """The linear classifier: a weight per slot and an intercept."""

    weight: np.ndarray
    bias: float

    def __post_init__(self):
        self.wanted = sources(self.weight != 0)

    def score(self, texts: list[str | None]) -> np.ndarray:
        row, slot = presence(texts, self.wanted)
        z = self.bias + np.bincount(row, self.weight[slot], len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def panel(c1: np.ndarray, c0: np.ndarray, y: np.ndarray, voters: int, least: int, lift_min: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(toxic lexicon, slots that vote toxic, slots that vote clean, z) from class_counts; y is nan where no label is."""
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    p1, p0 = (c1 + 0.5) / (n1 + 1), (c0 + 0.5) / (n0 + 1)
    z = (np.log(p1 / (1 - p1)) - np.log(p0 / (1 - p0))) / np.sqrt(1 / (c1 + 0.5) + 1 / (c0 + 0.5))
    lift = np.log(p1 / p0)
    strong = (c1 >= least) & (lift > lift_min)
    toxic = np.flatnonzero(strong & (z > min(4.0, 0.7 * z.max())))
    clean = np.flatnonzero((c0 >= least) & (lift < -1.0) & (z < -2.5))
    pick = lambda some, key, most: some[np.argsort(key[some], kind="stable")[:most]]
    return toxic, pick(toxic, -z, voters), pick(clean, z, voters // 4), np.where(strong, z, 0)


def hits(row: np.ndarray, slot: np.ndarray, rows: int, lexicon: np.ndarray) -> np.ndarray:
    """How many features of the lexicon each text has."""
    known = np.zeros(1 << BITS, bool)
    known[lexicon] = True
    return np.bincount(row[known[slot]], minlength=rows)


def cast(row: np.ndarray, slot: np.ndarray, count: np.ndarray, cut: int, toxic: np.ndarray, clean: np.ndarray) -> np.ndarray:
    """Votes, rows x voters: the rules' own, then those on the count of toxic features (none, few, many, very many)."""
    place = np.full(1 << BITS, -1)
    speak = np.concatenate([toxic, clean])
    place[speak] = np.arange(len(speak))
    votes = np.zeros((len(count), len(speak)))
    mine = place[slot] >= 0
    votes[row[mine], place[slot[mine]]] = 1
    return np.column_stack([votes, count == 0, (count > 0) & (count < cut), count >= cut, count >= 2 * cut]).astype(float)


def train(texts: list[str | None], toxic: list[int | None], voters: int = 200, least: int = 3, steps: int = 400, l2: float = 1.0, lift_min: float = 3.0, z_min: float = 3.0) -> Model:
    """Voters, label model and classifier from texts, some of them labelled."""
    y = np.array([np.nan if v is None else v for v in toxic], float)
    if not (y == 1).any() or not (y == 0).any():
        return Model(np.zeros(1 << BITS, np.float32), -60.0)
    lexicon, pro, con, z = panel(*class_counts(texts, y), y, voters, least, lift_min)
    used = np.flatnonzero(z > z_min)
    need = np.zeros(1 << BITS, bool)
    need[np.concatenate([lexicon, pro, con, used])] = True
    row, slot = presence(texts, sources(need), 1 << 18)
    count = hits(row, slot, len(y), lexicon)
    cut = max(range(1, 100), key=lambda t: (count[y == 1] >= t).mean() + (count[y == 0] < t).mean())
    votes = cast(row, slot, count, cut, pro, con)
    q = fit_label_model(votes, y).posterior(votes)
    place = np.full(1 << BITS, -1)
    place[used] = np.arange(len(used))
    mine = place[slot] >= 0
    r, f = row[mine], place[slot[mine]]
    w, b = np.zeros(len(used)), float(np.log(q.mean() / (1 - q.mean())))
    g2, gb = np.full(len(used), 1e-6), 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(r, w[f], len(y)), -40, 40)))
        err = q - p
        g = np.bincount(f, err[r], len(used)) - l2 * w
        g2, gb = g2 + g * g, gb + err.sum() ** 2
        w += 0.3 * g / np.sqrt(g2)
        b += 0.3 * err.sum() / np.sqrt(gb)
    weight = np.zeros(1 << BITS, np.float32)
    weight[used] = np.where(np.abs(w) > 0.02, w, 0)
    return Model(weight, b)


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int, max_chars: int) -> list:
    """At most per_class rows of each class and without a label that are not held out, by smallest id hash."""
    marks = labels.where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    able = docs.where((F.length(F.coalesce("text", F.lit(""))) <= max_chars) & ~held_out("doc_id")).select("doc_id").distinct().join(marks, "doc_id", "left")
    able = materialize(able.where(F.col("doc_id").isNotNull()), "toxic-able")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    some = lambda which: able.where(which).orderBy(*order).limit(per_class)
    ids = some("toxic = 1").unionByName(some("toxic = 0")).unionByName(some("toxic is null"))
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").orderBy("doc_id").collect()


def score_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = 2000, max_chars: int = 8000) -> DataFrame:
    """(doc_id, score) for every row of docs."""
    sample = training_rows(docs, labels, per_class, max_chars)
    model = train([r.text for r in sample], [None if r.toxic is None else int(r.toxic) for r in sample])
    del sample
    release()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in lots([batch], limit=1 << 22):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shared.value.score(part.column(1).to_pylist()), pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(tidy(score), "doc_id long, score double")


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    """A toxicity score for every whole text of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = score_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return got.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
