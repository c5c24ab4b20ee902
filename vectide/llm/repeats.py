"""Removal of repeated byte strings by a sparse enhanced suffix array.

A byte goes if it lies in a string of `length` bytes that also starts at another place,
in another text or the same; strings are judged on the input and matches never cross
texts. Beside that, runs of PASSAGE words or more that also stand in another text are
found by the same method over words; they are reported, not removed.

Anchors. A text is a row of units, bytes or hashed words. Of every window of `length`
units the position of the least hashed k-gram inside it is an anchor (the leftmost of
equals). The choice depends on the window's units alone, so two equal windows have the
same anchor at the same offset, and comparing what surrounds equal anchors finds every
repeat. About one byte in 120 and one word in 16 is an anchor.

Suffix array. Anchors whose k-gram occurs once are done. The others fall into classes by
their whole context (all units that a window on the anchor can cover). A class of two or
more places repeats throughout: it is a repeat group by itself. Where classes of one
k-gram differ, one context of each goes to the task of that k-gram: their right parts are
sorted (the suffix array at the anchors), neighbours' common prefixes taken, and a stack
scan turns these into the tree of common-prefix intervals. An interval of depth d is a
repeat group of all its members, not of neighbours alone; it is tested for left
extension: members are sorted by their reversed left parts, and a run of common left
extension e with e + d >= length is a group whose members are covered from e before the
anchor to d behind it. A run whose members all agree in one more unit on the right is not
maximal and is left to the deeper interval. A context lies in at most length - gram + 1
intervals that are deep enough, so the work of a task is linear in its contexts but for
the sorting. Only texts that hold a repeat move to be cut.

A k-gram with more than TREE_MOST classes (a passage inside very many different texts)
is not collected in a task: the windows of its contexts are hashed and counted instead,
an aggregation that splits over any number of tasks and is exact, too.

Defined results for odd input: null counts as empty; texts shorter than `length` lose
nothing; ids are expected to be unique and not null, rows that repeat an id and text
count as copies of each other for bytes and as one text for passages; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.llm.common import discard, materialize, maybe_in, tidy
from vectide.llm.ngram_join import _long_words, _mix, _Powers, _word_hashes, lots

GRAM = 160
#: Words of the least passage that is reported, and of its k-grams.
PASSAGE, PASSAGE_GRAM = 50, 20
TREE_MOST = 50_000
_PIECE = 1 << 19
_MASK = np.uint64((1 << 20) - 1)
_C = np.array([0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)


@dataclass(frozen=True)
class Kind:
    """What a text is a row of: number, bytes a unit, window and k-gram in units."""

    no: int
    unit: int
    length: int
    gram: int


def byte_kind(length: int = 400, gram: int = GRAM) -> Kind:
    """Repeats of bytes."""
    return Kind(0, 1, length, gram)


WORDS = Kind(1, 4, PASSAGE, PASSAGE_GRAM)


def word_units(texts: list[bytes]) -> list[np.ndarray]:
    """The 32-bit hashes of each text's words."""
    out: list[np.ndarray] = []
    lot: list[bytes] = []
    held = 0

    def close() -> None:
        nonlocal lot, held
        if len(lot) == 1:
            out.append((_long_words(lot[0]) >> np.uint64(32)).astype("<u4"))
        elif lot:
            w, starts = _word_hashes(np.frombuffer(b" " + b" ".join(lot) + b" ", np.uint8))
            first = np.cumsum([1] + [len(t) + 1 for t in lot])
            cut = np.searchsorted(starts, first)
            w = (w >> np.uint64(32)).astype("<u4")
            out.extend(w[a:b] for a, b in zip(cut, cut[1:]))
        lot, held = [], 0

    for t in texts:
        if held and held + len(t) > _PIECE:
            close()
        lot.append(t)
        held += len(t) + 1
    close()
    return out


def units(texts: list[bytes], kind: Kind) -> list[np.ndarray]:
    """Each text as an array of its units."""
    return word_units(texts) if kind.no else [np.frombuffer(t, np.uint8) for t in texts]


class Lot:
    """Stretches of several texts in one buffer, with range hashes and anchors."""

    def __init__(self, kind: Kind):
        self.kind, self.length, self.gram, self.window = kind, kind.length, kind.gram, kind.length - kind.gram + 1
        self.parts: list[tuple[int, int, np.ndarray, int, int]] = []
        self.size = 0

    def add(self, row: int, at: int, data: np.ndarray, first: int, last: int) -> None:
        """A stretch that starts at unit `at` of a row's text; window starts first..last-1 count."""
        self.parts.append((row, at, data, first, last))
        self.size += len(data)

    def _hash(self) -> None:
        buf = np.concatenate([p[2] for p in self.parts])
        self.up, self.down = _Powers.get(len(buf) + 1)
        self.total = np.append(np.uint64(0), np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * self.up[: len(buf)]))

    def ranges(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Hashes of ranges of the buffer."""
        return (self.total[hi] - self.total[lo]) * self.down[lo]

    def anchors(self):
        """(row, position in text, gram hash, context hash, units left, units right)."""
        with np.errstate(over="ignore"):
            self._hash()
            n, w, k = len(self.total) - 1, self.window, self.gram
            m = n - k + 1
            if m < w:
                return None
            h = _mix((self.total[k:] - self.total[:m]) * self.down[:m] + np.uint64(self.kind.no))
            v = (h & ~_MASK) | np.arange(m, dtype=np.uint64)
            blocks = np.append(v, np.full(-m % w, np.uint64(0xFFFFFFFFFFFFFFFF))).reshape(-1, w)
            pre = np.minimum.accumulate(blocks, axis=1).ravel()
            suf = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
            least = (np.minimum(suf[: m - w + 1], pre[w - 1 : m]) & _MASK).astype(np.int32)
            del v, blocks, pre, suf
            base, rows, shift, begin, end, pos = 0, [], [], [], [], []
            for row, off, data, first, last in self.parts:
                lo, hi = base + first - off, base + last - off
                if hi > lo:
                    got = least[lo:hi]
                    p = np.unique(got[np.append(True, got[1:] != got[:-1])]).astype(np.int64)
                    pos.append(p)
                    rows.append(np.full(len(p), row))
                    shift.append(np.full(len(p), off - base))
                    begin.append(np.full(len(p), base))
                    end.append(np.full(len(p), base + len(data)))
                base += len(data)
            if not pos:
                return None
            pos, rows, shift, begin, end = map(np.concatenate, (pos, rows, shift, begin, end))
            lo, hi = np.maximum(pos - (self.length - k), begin), np.minimum(pos + self.length, end)
            left, right = pos - lo, hi - pos
            ctx = _mix(self.ranges(lo, hi) * _C[0] + left.astype(np.uint64) * _C[1] + right.astype(np.uint64) * _C[2])
            return rows, pos + shift, h[pos], ctx, left, right


def _lots(texts: list[np.ndarray], kind: Kind) -> Iterator[Lot]:
    lot, length = Lot(kind), kind.length
    for row, t in enumerate(texts):
        if len(t) < length:
            continue
        for a in range(0, len(t) - length + 1, _PIECE):
            lo, hi = max(0, a - length), min(len(t), a + _PIECE + 2 * length)
            if lot.size + hi - lo >= 1 << 20:
                yield lot
                lot = Lot(kind)
            lot.add(row, lo, t[lo:hi], a, min(a + _PIECE, len(t) - length + 1))
    if lot.parts:
        yield lot


def _places(data: bytes, kind: Kind) -> set[int]:
    """Anchor positions that a string has by itself, whatever surrounds it."""
    lot = Lot(kind)
    lot.add(0, 0, np.frombuffer(data, "<u4" if kind.no else np.uint8), 0, len(data) // kind.unit - kind.length + 1)
    return set(lot.anchors()[1].tolist())


def _anchors(texts: DataFrame, kinds: list[Kind]) -> DataFrame:
    """(kind, h, ctx, id, pos, l, r) of every anchor; l and r are the units of the context before it and from it on."""

    def run(batches):
        for part in lots(batches):
            ids, raw = part.column(0).to_numpy(zero_copy_only=False), part.column(1).to_pylist()
            for kind in kinds:
                for lot in _lots(units(raw, kind), kind):
                    got = lot.anchors()
                    if got is None:
                        continue
                    rows, pos, h, ctx, left, right = got
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(pos), kind.no, np.int8)), pa.array(h.view(np.int64)), pa.array(ctx.view(np.int64)), pa.array(ids[rows], pa.int64()), pa.array(pos, pa.int32()),
                            pa.array(left, pa.int16()), pa.array(right, pa.int16()),
                        ],
                        names=["kind", "h", "ctx", "id", "pos", "l", "r"],
                    )

    return texts.mapInArrow(tidy(run), "kind tinyint, h long, ctx long, id long, pos int, l smallint, r smallint")


def common_prefix(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    hi = min(len(a), len(b))
    if a[:hi] == b[:hi]:
        return hi
    lo = 0
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """Common-prefix intervals (depth, first, last) of suffixes whose neighbours share lcp[i] (i and i + 1).

    A stack scan; children come before parents.
    """
    stack: list[tuple[int, int]] = []
    for i, d in enumerate([*lcp, -1]):
        left = i
        while stack and stack[-1][0] > d:
            depth, left = stack.pop()
            yield depth, left, i
        if d >= 0 and (not stack or stack[-1][0] < d):
            stack.append((d, left))


class _Lcp:
    """Ranks of strings in sorted order and the common prefixes of neighbours, with least values of ranges."""

    def __init__(self, strings: list[bytes], unit: int):
        self.order = np.array(sorted(range(len(strings)), key=strings.__getitem__))
        self.rank = np.empty(len(strings), np.int64)
        self.rank[self.order] = np.arange(len(strings))
        at = self.order.tolist()
        self.near = np.array([common_prefix(strings[a], strings[b]) // unit for a, b in zip(at, at[1:])], np.int32)
        self.levels = [self.near]
        while 1 << len(self.levels) < len(strings):
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[: len(last) - half], last[half:]))

    def between(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Common prefixes of the strings of rank lo and hi > lo."""
        level = np.frexp((hi - lo).astype(float))[1] - 1
        out = np.empty(len(lo), np.int32)
        for k in range(int(level.max()) + 1 if len(level) else 0):
            m = level == k
            if m.any():
                out[m] = np.minimum(self.levels[k][lo[m]], self.levels[k][hi[m] - (1 << k)])
        return out


def repeat_groups(rights: list[bytes], lefts: list[bytes], length: int, unit: int = 1) -> Iterator[tuple[int, int, np.ndarray]]:
    """Groups (left extension, depth, members) of contexts around equal anchors.

    rights are the units from the anchor on, lefts the units before it, reversed. Members
    agree in the group's units, which number length or more; the units before and after
    differ somewhere in the group (or leave the context), so the group's string is
    maximal: a run of common left extension splits off its members where they differ on
    the left, and it is left to a deeper interval where they all agree on the right.
    """
    if len(rights) == 2:
        ext, depth = common_prefix(*lefts) // unit, common_prefix(*rights) // unit
        if ext + depth >= length:
            yield ext, depth, np.arange(2)
        return
    right, left = _Lcp(rights, unit), _Lcp(lefts, unit)
    most = int(left.near.max())
    for depth, first, last in intervals(right.near.tolist()):
        need = length - depth
        if most < need:
            continue
        at = np.sort(left.rank[right.order[first : last + 1]])
        near = left.between(at[:-1], at[1:])
        edges = np.flatnonzero(np.diff((near >= need).astype(np.int8), prepend=0, append=0))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            for ext, lo, hi in intervals(near[a:b].tolist()):
                if ext < need:
                    continue
                group = left.order[at[a + lo : a + hi + 1]]
                ends = right.rank[group]
                if right.near[ends.min() : ends.max()].min() == depth:
                    yield ext, depth, group


def stretches(rights: list[bytes], lefts: list[bytes], ids: list[tuple[int, int]], kind: Kind) -> dict[int, tuple[int, int, int]]:
    """Member -> (units before, units from the anchor on, units of the longest) that its repeat groups cover.

    ids are the least and largest id of each member's class; a group of words counts if it
    has two different ones.
    """
    best = np.zeros((3, len(rights)), np.int64)
    least, most = np.array(ids, np.int64).T
    for ext, depth, group in repeat_groups(rights, lefts, kind.length, kind.unit):
        if kind.no and least[group].min() == most[group].max():
            continue
        best[:, group] = np.maximum(best[:, group], [[ext], [depth], [ext + depth]])
    return {int(m): tuple(best[:, m].tolist()) for m in np.flatnonzero(best[2])}


_FOUND = pa.schema([("kind", pa.int8()), ("id", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("size", pa.int32())])
_CONTEXT = "kind tinyint, h long, id long, pos int, least long, most long, left binary, right binary"


def _trees(contexts: DataFrame, kinds: list[Kind]) -> DataFrame:
    """Covered stretches (kind, id, lo, hi, size of the longest group) of contexts, by k-gram."""
    known = {k.no: k for k in kinds}

    def solve(rows: list[tuple]) -> Iterator[tuple]:
        kind, lefts, rights = known[rows[0][0]], [r[6] for r in rows], [r[7] for r in rows]
        for m, (e, d, size) in stretches(rights, lefts, [r[4:6] for r in rows], kind).items():
            yield kind.no, rows[m][2], rows[m][3] - e, rows[m][3] + d, size

    def run(batches):
        held: list[tuple] = []
        out: list[tuple] = []
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in range(8)]):
                if held and held[0][:2] != row[:2]:
                    if len(held) > 1:
                        out += solve(held)
                    held = []
                held.append(row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), _FOUND.types)], schema=_FOUND)
                out = []
        if len(held) > 1 and (out := list(solve(held))):
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), _FOUND.types)], schema=_FOUND)

    return contexts.repartition("h").sortWithinPartitions("kind", "h").mapInArrow(tidy(run), "kind tinyint, id long, lo int, hi int, size int")


def maximal_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, gram: int = GRAM) -> DataFrame:
    """Repeat groups with all their occurrences: (group, size, id, start), byte offsets.

    A group's string is maximal within the context of its anchor, which reaches
    length - gram bytes before and length bytes behind it; of a longer repeat every
    anchor reports its stretch. group is a hash of the string.
    """
    kind = byte_kind(length, gram)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("t"))
    live, classes, _ = _classes(_anchors(texts, [kind]))
    every = classes.where("mixed").select("kind", "h", "ctx", "at.id", "at.pos", "least", "most")
    name = F.xxhash64("h", "ctx", "l", "r")
    whole = live.where("not mixed").join(classes.where("c > 1").select("h", "ctx"), ["h", "ctx"], "left_semi")
    whole = whole.select(name.alias("group"), (F.col("l") + F.col("r")).cast("int").alias("size"), "id", (F.col("pos") - F.col("l")).alias("start"))

    def run(batches):
        held: list[tuple] = []

        def solve() -> pa.RecordBatch | None:
            lefts, rights = [r[6] for r in held], [r[7] for r in held]
            groups = list(repeat_groups(rights, lefts, length)) if len(held) > 1 else []
            own = [(len(lefts[m]), len(rights[m]), [m]) for m in range(len(held)) if len(lefts[m]) + len(rights[m]) >= length]
            out, seen = [], set()
            for e, d, members in groups + own:  # a class whose own string is no group yet may still have two places
                one = lefts[members[0]][:e][::-1] + rights[members[0]][:d]
                gid = int.from_bytes(hashlib.blake2b(one, digest_size=8).digest(), "little", signed=True)
                if gid not in seen and e in _places(one, kind):  # else some places have another anchor
                    seen.add(gid)
                    out += [(gid, e + d, held[m][1], held[m][2], held[m][3], e) for m in members]
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names=["group", "size", "h", "id", "pos", "ext"]) if out else None

        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in range(8)]):
                if held and held[0][1] != row[1]:
                    if (got := solve()) is not None:
                        yield got
                    held = []
                held.append(row)
        if held and (got := solve()) is not None:
            yield got

    contexts = _contexts(texts, materialize(every, "repeat-places"), [kind])
    groups = contexts.repartition("h").sortWithinPartitions("h").mapInArrow(tidy(run), "group long, size int, h long, id long, pos int, ext int")
    groups = groups.join(every, ["h", "id", "pos"]).select("group", "size", "h", "ctx", "ext")
    spread = live.select("h", "ctx", "id", "pos").join(groups, ["h", "ctx"]).select("group", "size", "id", (F.col("pos") - F.col("ext")).alias("start"))
    every = whole.unionByName(spread).distinct()
    repeated = every.groupBy("group").agg(F.count("*").alias("c")).where("c > 1").select("group")
    return every.join(repeated, "group", "left_semi")


def _counted(contexts: DataFrame, kinds: list[Kind]) -> DataFrame:
    """The same for k-grams of very many classes, by counting hashed windows."""
    known = {k.no: k for k in kinds}

    def run(batches):
        for batch in batches:
            for no, h, ident, pos, least, most, left, right in zip(*[batch.column(c).to_pylist() for c in range(8)]):
                kind = known[no]
                as_units = [np.frombuffer(x, "<u4" if kind.no else np.uint8) for x in (left, right)]
                before, data = len(as_units[0]), np.concatenate([as_units[0][::-1], as_units[1]])
                n = len(data) - kind.length + 1
                if n < 1:
                    continue
                with np.errstate(over="ignore"):
                    up, down = _Powers.get(len(data) + 1)
                    total = np.append(np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)]))
                    at = np.arange(n)
                    x = _mix((total[at + kind.length] - total[at]) * down[at])
                back = before - at
                keep = (back >= 0) & (back <= kind.length - kind.gram)
                m = int(keep.sum())
                same = lambda v, t: pa.array(np.full(m, v), t)  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [same(no, pa.int8()), same(h, pa.int64()), pa.array(x[keep].view(np.int64)), pa.array(back[keep], pa.int32()), same(ident, pa.int64()), same(pos, pa.int32()), same(least, pa.int64()), same(most, pa.int64())],
                    names=["kind", "h", "x", "back", "id", "pos", "least", "most"],
                )

    windows = materialize(contexts.mapInArrow(tidy(run), "kind tinyint, h long, x long, back int, id long, pos int, least long, most long"), "repeat-windows")
    often = windows.groupBy("kind", "h", "x", "back").agg(F.count("*").alias("c"), F.min("least").alias("a"), F.max("most").alias("b"))
    often = materialize(often.where("(kind = 0 and c > 1) or (kind = 1 and a < b)").drop("c", "a", "b"), "repeat-often")
    hit = windows.join(often, ["kind", "h", "x", "back"]).groupBy("kind", "id", "pos").agg(F.max("back").alias("far"), F.min("back").alias("near"))
    length = F.element_at(F.create_map(*[F.lit(v) for k in kinds for v in (k.no, k.length)]), F.col("kind").cast("int"))
    size = F.col("far") - F.col("near") + length
    return hit.select("kind", "id", (F.col("pos") - F.col("far")).alias("lo"), (F.col("pos") - F.col("near") + length).cast("int").alias("hi"), size.cast("int").alias("size"))


def _contexts(texts: DataFrame, places: DataFrame, kinds: list[Kind]) -> DataFrame:
    """The units around places (kind, h, id, pos, least, most), left ones reversed."""
    known = {k.no: k for k in kinds}
    refs = materialize(places.groupBy("id").agg(F.collect_list(F.struct("kind", "h", "pos", "least", "most")).alias("refs")), "repeat-refs")

    def run(batches):
        for part in lots(batches):
            out = []
            for ident, t, refs_ in zip(*[part.column(c).to_pylist() for c in range(3)]):
                rows = {no: units([t], known[no])[0] for no in {r["kind"] for r in refs_}}
                for r in refs_:
                    p, kind, row = r["pos"], known[r["kind"]], rows[r["kind"]]
                    left = row[max(0, p - (kind.length - kind.gram)) : p][::-1]
                    out.append((r["kind"], r["h"], ident, p, r["least"], r["most"], left.tobytes(), row[p : p + kind.length].tobytes()))
                if len(out) >= 4000:
                    yield batch_of(out)
                    out = []
            if out:
                yield batch_of(out)

    def batch_of(out):
        types = (pa.int8(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names=["kind", "h", "id", "pos", "least", "most", "left", "right"])

    return maybe_in(texts, "id", refs.select("id")).join(refs, "id").select("id", "t", "refs").mapInArrow(tidy(run), _CONTEXT)


def _classes(anchors: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Anchors of repeated k-grams, their classes, and one place a class where classes differ."""
    anchors = materialize(anchors, "repeat-anchors")
    grams = anchors.groupBy("h").agg(F.count("*").alias("c"), F.min("ctx").alias("a"), F.max("ctx").alias("b")).where("c > 1")
    grams = materialize(grams.select("h", (F.col("a") != F.col("b")).alias("mixed")), "repeat-grams")
    live = materialize(anchors.join(grams, "h"), "repeat-live")
    discard(anchors, grams)
    at = F.min(F.struct("id", "pos")).alias("at")
    classes = live.groupBy("kind", "h", "ctx").agg(F.count("*").alias("c"), at, F.max("mixed").alias("mixed"), F.min("id").alias("least"), F.max("id").alias("most"))
    classes = materialize(classes, "repeat-classes")
    alone = F.when(F.col("kind") == 0, F.col("c") == 1).otherwise(F.col("least") == F.col("most"))
    open_ = classes.where("mixed").groupBy("h").agg(F.max(alone).alias("open"), F.count("*").alias("d")).where("open")
    places = classes.where("mixed").join(open_.select("h", "d"), "h").select("kind", "h", "d", "at.id", "at.pos", "least", "most")
    places = materialize(places, "repeat-places")
    return live, classes, places


def covered(texts: DataFrame, kinds: list[Kind]) -> DataFrame:
    """Stretches (kind, id, lo, hi, size) of texts (id, t binary), which together are what repeats.

    Bytes repeat at another place, words in another text. size is the longest repeat's.
    """
    live, classes, places = _classes(_anchors(texts, kinds))
    again = materialize(classes.where("(kind = 0 and c > 1) or (kind = 1 and least < most)").select("h", "ctx"), "repeat-again")
    whole = live.join(again, ["h", "ctx"])
    whole = whole.select("kind", "id", (F.col("pos") - F.col("l")).alias("lo"), (F.col("pos") + F.col("r")).alias("hi"), (F.col("l") + F.col("r")).cast("int").alias("size"))
    found = whole.unionByName(_trees(_contexts(texts, places.where(F.col("d") <= TREE_MOST), kinds), kinds))
    large = places.where(F.col("d") > TREE_MOST)
    if large.head(1):
        found = found.unionByName(_counted(_contexts(texts, large, kinds), kinds))
    return found


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, with_text: bool = True) -> DataFrame:
    """One row per row of docs: id, n_bytes, n_removed, n_spans, kept_sha256, passage_words, kept.

    kept are the remaining bytes. passage_words is the length of the longest run of PASSAGE
    words or more that also stands in another text, as far as the context of one anchor
    shows it, and 0 without one.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("t"))
    span = F.when(F.col("kind") == 0, F.struct("lo", "hi"))
    marks = covered(texts, [byte_kind(length), WORDS]).groupBy("id").agg(F.collect_set(span).alias("spans"), F.max(F.when(F.col("kind") == 1, F.col("size"))).alias("words"))
    marks = materialize(marks, "repeat-marks")
    def run(batches):
        for part in lots(batches):
            out = []
            for ident, t, cut, words in zip(*[part.column(c).to_pylist() for c in range(4)]):
                keep, removed, runs, at = [], 0, 0, 0
                for lo, hi in sorted((s["lo"], min(s["hi"], len(t))) for s in cut or ()):
                    if hi <= at and runs:
                        continue
                    if lo > at or not runs:
                        keep.append(t[at:lo])
                        runs += 1
                        at = lo
                    removed += hi - at
                    at = hi
                keep.append(t[at:])
                kept = b"".join(keep)
                out.append((ident, len(t), removed, runs, hashlib.sha256(kept).hexdigest(), words or 0, kept if with_text else None))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, ty) for x, ty in zip(zip(*out), types)], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "passage_words", "kept"])

    ids = marks.select("id")
    some = maybe_in(texts, "id", ids).join(marks, "id", "left").select("id", "t", "spans", "words")
    got = some.mapInArrow(tidy(run), "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, passage_words long, kept binary")
    zero = F.lit(0).cast("long")
    rest = maybe_in(texts, "id", ids, yes=False)  # texts without a repeat don't move
    rest = rest.select("id", F.octet_length("t").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2("t", 256).alias("kept_sha256"), zero.alias("passage_words"), F.when(F.lit(with_text), F.col("t")).alias("kept"))
    return got.unionByName(rest).withColumnRenamed("id", id_col)


def op8_repeats(spark, sf_dir: str) -> DataFrame:
    """Remove 400-byte repeats from every whole text of documents; mark passages of 50 words or more that other texts share."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = remove_repeats(docs, with_text=False)
    return got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "passage_words", (F.col("passage_words") > 0).alias("shares_passage"))
