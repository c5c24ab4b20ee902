"""N-best segmentation into the pieces of a given vocabulary, and decoding.

A text's lattice has an arc for every substring that is a piece, scored as in the
vocabulary file; a character that no piece covers gets one arc of a penalty score and is
written as byte pieces. The text gets one leading space and spaces are the piece mark;
every other character, a literal mark included, stays itself, so decoding gives back the
text exactly. The vocabulary is read from a file, never trained.

N-best: a forward Viterbi pass gives the best score from the start to every position. A
backward A-star search from the end uses it as its heuristic; as that is exact, complete
paths leave the queue in order of score. No piece crosses a position before a space that
follows another character (checked when the file is read), so the lattice falls into
blocks there and a text's N best paths combine its blocks' N best paths: another backward
A-star over the blocks whose best change costs least, with the heuristic that all blocks
before are at their best. Blocks of up to WIDE characters are scored for the whole batch
at once, each distinct block once.

Ties: of equal scores the partial path that is nearest to the start goes on first, in
both searches, so many equal paths do not multiply the work.

Defined results for odd input: null texts give null ids; empty texts give no ids and one
path of score 0; fewer than N paths are returned if the lattice has fewer; rows that
repeat are each encoded; an empty table gives no rows; further columns pass through in
encode() unless they are named like its output, which replaces them.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectide.llm.common import arrow_map, quoted
from vectide.llm.ngram_join import lots

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
WIDE = 24
_P = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary:
    """Pieces, scores and a cuckoo table from substring hashes to piece ids."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.bytes_id = np.zeros(256, np.int32)
        self.piece_bytes: list[bytes] = []
        self.ids: dict[str, int] = {}
        scores = np.zeros(n)
        for i in range(n):
            piece, scores[i] = sp.id_to_piece(i), sp.get_score(i)
            if sp.is_byte(i):
                self.bytes_id[int(piece[3:5], 16)] = i
                self.piece_bytes.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.piece_bytes.append(b"")
            else:
                text = piece.replace("▁", " ")
                self.ids[text] = i
                self.piece_bytes.append(text.encode("utf-8"))
        self.score = scores
        self.longest = max(map(len, self.ids))
        ordinary = [scores[i] for i in self.ids.values() if scores[i] > -1e8]
        self.unknown = min(ordinary) - 10.0
        if any(re.search("[^ ] ", p) for p in self.ids):
            raise ValueError("a piece crosses a block's edge")
        self.breaks = [c for c in "\n\t" if not any(c in p for p in self.ids)]
        inner = "".join(map(re.escape, self.breaks))
        self.blocks = re.compile(rf" *[^ {inner}]+| +|[{inner}]" if inner else r" *[^ ]+| +")
        self._table(list(self.ids.items()))

    @staticmethod
    def hashes(code: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Hash after one more character."""
        return (h ^ (code + np.uint64(1))) * _P + (h >> np.uint64(33))

    def _slots(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (h >> np.uint64(47)).astype(np.int64), ((h * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(47)).astype(np.int64)

    def _table(self, items: list[tuple[str, int]]) -> None:
        with np.errstate(over="ignore"):
            keys = []
            for text, _ in items:
                h = np.zeros(1, np.uint64)
                for c in text:
                    h = self.hashes(np.array([ord(c)], np.uint64), h)
                keys.append(int(h[0]))
            if len(set(keys)) != len(keys):
                raise ValueError("two pieces share a hash")
            one, two = self._slots(np.array(keys, np.uint64))
        self.key, self.val = np.zeros(1 << 17, np.uint64), np.full(1 << 17, -1, np.int32)
        held = [-1] * (1 << 17)
        for k in range(len(keys)):
            cur, at = k, int(one[k])
            for _ in range(500):
                held[at], cur = cur, held[at]
                if cur < 0:
                    break
                at = int(two[cur]) if at == one[cur] else int(one[cur])
            else:
                raise ValueError("the piece table is too small")
        for at, k in enumerate(held):
            if k >= 0:
                self.key[at], self.val[at] = keys[k], items[k][1]

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Piece ids of hashes, -1 for none."""
        a, b = self._slots(h)
        return np.where(self.key[a] == h, self.val[a], np.where(self.key[b] == h, self.val[b], -1))


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, read once a process."""
    return Vocabulary(path)


def arcs_into(v: Vocabulary, text: str, end: int) -> list[tuple[int, int]]:
    """(start, piece id) of the arcs that end at a position, longest first; id -1 for an unknown character."""
    got = []
    for start in range(max(0, end - v.longest), end):
        i = v.ids.get(text[start:end])
        if i is not None:
            got.append((start, i))
    if not got or got[-1][0] != end - 1:
        got.append((end - 1, -1))
    return got


def forward(v: Vocabulary, text: str) -> np.ndarray:
    """Best score from the start to every position."""
    f = [0.0] * (len(text) + 1)
    for end in range(1, len(text) + 1):
        f[end] = max(f[s] + (v.score[i] if i >= 0 else v.unknown) for s, i in arcs_into(v, text, end))
    return np.array(f)


def spelled(v: Vocabulary, text: str, path: tuple) -> list[int]:
    """Piece ids of a path of (start, end, id), unknown characters as byte pieces."""
    out: list[int] = []
    for s, e, i in path:
        out += [i] if i >= 0 else v.bytes_id[list(text[s:e].encode("utf-8", "replace"))].tolist()
    return out


def nbest_block(v: Vocabulary, text: str, n: int) -> list[tuple[float, list[int]]]:
    """The n best paths of one lattice by backward A-star, best first."""
    f = forward(v, text)
    queue, out, tick = [(-f[len(text)], len(text), 0, 0.0, None)], [], 0
    while queue and len(out) < n:
        _, at, _, done, path = heapq.heappop(queue)
        if at == 0:
            steps = []
            while path:
                steps.append(path[0])
                path = path[1]
            out.append((done, spelled(v, text, tuple(steps))))
            continue
        for start, i in arcs_into(v, text, at):
            tick += 1
            score = done + (v.score[i] if i >= 0 else v.unknown)
            heapq.heappush(queue, (-(f[start] + score), start, tick, score, ((start, at, i), path)))
    return out


def nbest_chain(losses: list[list[float]], n: int) -> list[tuple[float, list[int]]]:
    """The n least total losses over a chain of blocks, each list of losses rising from 0.

    Backward A-star; the blocks still to come are at loss 0, which is exact.
    """
    queue, out, tick = [(0.0, len(losses), 0, ())], [], 0
    while queue and len(out) < n:
        loss, k, _, chosen = heapq.heappop(queue)
        if k == 0:
            out.append((loss, list(chosen)))
            continue
        for c, x in enumerate(losses[k - 1]):
            tick += 1
            heapq.heappush(queue, (loss + x, k - 1, tick, (c, *chosen)))
    return out


class Encoder:
    """Encodes texts, keeping what it learned of distinct blocks until there are more than keep of them."""

    def __init__(self, path: str, n: int, keep: int = 100_000):
        self.v, self.n, self.keep = vocabulary(path), n, keep
        self.reset()

    def reset(self) -> None:
        """Forget all blocks."""
        self.index: dict[str, int] = {}
        self.best, self.gap = np.zeros(0), np.zeros(0)
        self.count, self.first, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.lists: dict[int, list] = {}
        self.names: list[str] = []

    def _group(self, words: list[str], n: int) -> tuple:
        """Best score, loss of the second best, ids and counts of blocks of n characters."""
        v, b = self.v, len(words)
        code = np.array(words, dtype=f"<U{n}").view(np.uint32).reshape(b, n).astype(np.uint64)
        f = np.full((n + 1, b), -np.inf)
        f[0] = 0
        back, piece = np.zeros((n + 1, b), np.int64), np.full((n + 1, b), -1, np.int32)
        arcs = {}
        with np.errstate(over="ignore"):
            for i in range(n):
                h = np.zeros(b, np.uint64)
                for j in range(i + 1, min(n, i + v.longest) + 1):
                    h = v.hashes(code[:, j - 1], h)
                    ids = v.lookup(h)
                    if j == i + 1:
                        s = np.where(ids >= 0, v.score[ids], v.unknown)
                    else:
                        if not (ids >= 0).any():
                            continue
                        s = np.where(ids >= 0, v.score[ids], -np.inf)
                    arcs[i, j] = s
                    t = f[i] + s
                    up = t > f[j]
                    f[j][up], back[j][up], piece[j][up] = t[up], i, ids[up]
        g = np.full((n + 1, b), -np.inf)
        g[n] = 0
        for (i, j), s in sorted(arcs.items(), key=lambda x: -x[0][0]):
            np.maximum(g[i], g[j] + s, out=g[i])
        out, on, at = np.full((b, n), -2, np.int32), np.zeros((n + 1, b), bool), np.full(b, n)
        rows = np.arange(b)
        while (live := at > 0).any():
            r, e = rows[live], at[live]
            on[e, r] = True
            s = back[e, r]
            out[r, s] = piece[e, r]
            at[live] = s
        second = np.full(b, -np.inf)
        for (i, j), s in arcs.items():
            second = np.maximum(second, np.where(on[j] & (back[j] == i), -np.inf, f[i] + s + g[j]))
        return f[n], f[n] - second, out

    def learn(self, new: list[str]) -> None:
        """Add distinct blocks."""
        v = self.v
        best, gap, count = np.zeros(len(new)), np.zeros(len(new)), np.zeros(len(new), np.int64)
        ids: list = [None] * len(new)
        by_size: dict[int, list[int]] = {}
        for k, w in enumerate(new):
            by_size.setdefault(len(w) if len(w) <= WIDE else 0, []).append(k)
        for size, ks in by_size.items():
            if size:
                for lo in range(0, len(ks), 20_000):
                    some = ks[lo : lo + 20_000]
                    words = [new[k] for k in some]
                    best[some], gap[some], out = self._group(words, size)
                    odd = (out == -1).any(1)
                    keep = out >= 0
                    n = keep.sum(1)
                    flat, ends = out[keep], np.cumsum(n)
                    for r, k in enumerate(some):
                        if odd[r]:
                            path, last = [], size
                            for s in range(size - 1, -1, -1):
                                if out[r, s] != -2:
                                    path.append((s, last, int(out[r, s])))
                                    last = s
                            ids[k] = np.array(spelled(v, words[r], tuple(reversed(path))), np.int32)
                        else:
                            ids[k] = flat[ends[r] - n[r] : ends[r]]
            else:
                for k in ks:
                    two = nbest_block(v, new[k], 2)
                    best[k], gap[k] = two[0][0], two[0][0] - two[1][0] if len(two) > 1 else np.inf
                    ids[k] = np.array(two[0][1], np.int32)
        count[:] = [len(x) for x in ids]
        base = len(self.flat)
        for w in new:
            self.index[w] = len(self.index)
        self.names += new
        self.first = np.append(self.first, base + np.cumsum(count) - count)
        self.count, self.best, self.gap = np.append(self.count, count), np.append(self.best, best), np.append(self.gap, gap)
        self.flat = np.concatenate([self.flat, *ids])

    def block_paths(self, k: int) -> list[tuple[float, list[int]]]:
        """The n best paths of block k."""
        if k not in self.lists:
            self.lists[k] = nbest_block(self.v, self.names[k], self.n)
        return self.lists[k]

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, list]]:
        """Per text: ids of the best path, and the n best as (score, changes).

        A change is (first piece, pieces replaced, new ids) against the best path.
        """
        if len(self.index) > self.keep:
            self.reset()
        split = [self.v.blocks.findall(" " + t) if t else [] for t in texts]
        new = list(dict.fromkeys(w for ws in split for w in ws if w not in self.index))
        if new:
            self.learn(new)
        out = []
        for ws in split:
            k = np.fromiter(map(self.index.__getitem__, ws), np.int64, len(ws))
            count = self.count[k]
            ends = np.cumsum(count)
            total = int(ends[-1]) if len(ws) else 0
            ids = self.flat[np.repeat(self.first[k] - (ends - count), count) + np.arange(total)]
            best = float(self.best[k].sum())
            gap = self.gap[k]
            if len(k) > self.n:
                bar = np.partition(gap, self.n - 2)[self.n - 2] if self.n > 1 else -np.inf
                near = np.flatnonzero(gap <= bar)
                near = np.sort(near[np.argsort(gap[near], kind="stable")[: max(self.n - 1, 0)]])
            else:
                near = np.arange(len(k))
            paths = [self.block_paths(int(k[b])) for b in near]
            ranked = nbest_chain([[p[0][0] - x[0] for x in p] for p in paths], self.n)
            nbest = []
            for loss, chosen in ranked:
                edits = [(int(ends[b] - count[b]), int(count[b]), paths[m][c][1]) for m, (b, c) in enumerate(zip(near, chosen)) if c]
                nbest.append((best - loss, edits))
            out.append((ids, nbest))
        return out


def decode(v: Vocabulary, ids) -> str:
    """The text of piece ids, without the leading space that encoding adds."""
    text = b"".join(map(v.piece_bytes.__getitem__, ids)).decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


_EDIT = pa.struct([("at", pa.int32()), ("drop", pa.int32()), ("ids", pa.list_(pa.int32()))])
_PATH = pa.struct([("score", pa.float64()), ("edits", pa.list_(_EDIT))])
_IDS = T.ArrayType(T.IntegerType())
_EDITS = T.ArrayType(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("drop", T.IntegerType()), T.StructField("ids", _IDS)]))
_PATHS = T.ArrayType(T.StructType([T.StructField("score", T.DoubleType()), T.StructField("edits", _EDITS)]))
_ADDED = T.StructType([T.StructField("ids", _IDS), T.StructField("nbest", _PATHS), T.StructField("decoded_ok", T.BooleanType())])


def encode(docs: DataFrame, text_col: str = "text", n: int = 4, model: str = MODEL) -> DataFrame:
    """docs with ids (best path), nbest (scores and changes to ids) and decoded_ok (ids decode to the text)."""
    taken = {"ids", "nbest", "decoded_ok"}
    docs = docs.select(*[quoted(c) for c in docs.columns if c.lower() not in taken])
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(model, n)
        for part in lots(batches, at):
            some = part.column(at).to_pylist()
            got = enc.encode([t or "" for t in some])
            offsets = np.zeros(len(some) + 1, np.int32)
            np.cumsum([len(g[0]) for g in got], out=offsets[1:])
            flat = np.concatenate([g[0] for g in got]) if got else np.zeros(0, np.int32)
            none = pa.array([t is None for t in some])
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()), mask=none)
            nbest = pa.array(
                [None if t is None else [{"score": s, "edits": [{"at": a, "drop": d, "ids": x} for a, d, x in e]} for s, e in g[1]] for t, g in zip(some, got)],
                pa.list_(_PATH),
            )
            ok = pa.array([None if t is None else decode(enc.v, g[0].tolist()) == t.encode("utf-8", "replace").decode("utf-8") for t, g in zip(some, got)], pa.bool_())
            yield pa.RecordBatch.from_arrays([*part.columns, ids, nbest, ok], names=[*part.schema.names, "ids", "nbest", "decoded_ok"])

    return arrow_map(docs, run, _ADDED.fields)


def decode_ids(df: DataFrame, ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """df with a column decoded: the text of its piece ids, null for null; a column of that name is replaced."""
    df = df.select(*[quoted(c) for c in df.columns if c.lower() != "decoded"])
    at = df.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for batch in batches:
            texts = pa.array([None if x is None else decode(v, x) for x in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, "decoded"])

    return arrow_map(df, run, [T.StructField("decoded", T.StringType())])


def op4_pieces(spark, sf_dir: str) -> DataFrame:
    """Encode every whole text of documents, four best paths, and decode the best again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = encode(docs)
    return got.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "nbest", "decoded_ok")
