"""Size-aware heavy-light Jaccard join on word shingles, exact, with components.

A text is lower-cased in A-Z and cut at runs of space, tab, newline, vertical tab, form
feed and carriage return; its set holds the hashes of its distinct 5-word shingles, with
fewer words the whole sequence as one. Two texts link when the Jaccard similarity of
their sets is at least num / den; a component is what links connect.

Method. Texts with equal sets fold into one class first. A global token order puts
frequent shingles last (all tokens of all rows are counted, equal sets within a task
once; the HEAVY_MOST most frequent are told apart; the order alone depends on them, never
the result). For sets of at most x tokens (small) all 2-subsets of a prefix
are enumerated and equal subsets meet; sets above x (large) scan inverted lists of their
prefix tokens, in which small sets stand too if they can match a large one. Prefix
lengths follow from the similarity bound, so no linked pair is missed. The boundary x is
the cheapest under a cost model fed with the counted sizes and list lengths.

Lists of up to LIGHT members yield their pairs, if enough of both sets lies behind the
token's places for it to be the first common one. A longer list yields each member with
the list's first only, or with its neighbour where the first is too small; links found
that way nearly always join the list in one component, and then its other pairs cannot
change the result. The list of a token that occurs more than SPLIT times is dealt to
several tasks, and the firsts of its parts meet. Lists that still span several components
are compared block by block across components (exact, and empty for groups of copies), see
`_open_links`. The pairs before are checked by a bitmap bound that never rejects a link, then
by the exact intersection; first one partner a text, then what still lies across components.

Nothing of a text but its prefix hashes is shuffled before pairs exist. Bitmaps, an eighth
of a set or less, move for texts in candidate pairs and open lists; sets are written and
moved only for texts with a partner that the bitmaps leave.

Defined results for odd input: null and empty texts have no shingles and are their own
component; ids are expected to be unique and not null; rows that repeat an id and text
each get a row; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectide.llm.common import components, discard, fits, materialize, maybe_in, small_batches, small_side, tidy

LIGHT = 12
HEAVY_LEAST = 10
#: Most tokens held in the frequency order, the most frequent; the others count as rare. Bounds a broadcast, affects speed alone.
HEAVY_MOST = 1 << 18
#: Leading bits of a token that the frequency order tells apart.
HEAD = 42
#: Lists of more frequent tokens than this are dealt to several tasks.
SPLIT = 4096
#: Tokens of a block of a list that still spans components, and what a member counts for at least.
BLOCK, LEAST = 1 << 20, 512
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_M = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_K = np.array([pow(0xD6E8FEB86659FD93, i + 1, 1 << 64) for i in range(64)], np.uint64)
#: Bytes of text hashed at once; a worker holds about 60 bytes for each.
_PIECE = 1 << 18


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class _Powers:
    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            with np.errstate(over="ignore"):
                cls.up = np.multiply.accumulate(np.append(np.uint64(1), np.full(n, _M)))
                cls.down = np.multiply.accumulate(np.append(np.uint64(1), np.full(n, _INV)))
        return cls.up, cls.down


def _word_hashes(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of the words of a byte buffer that begins and ends with a space."""
    on = ~_SPACE[buf]
    edge = np.flatnonzero(on[1:] != on[:-1]) + 1
    starts, ends = edge[0::2], edge[1::2]
    up, down = _Powers.get(len(buf) + 1)
    with np.errstate(over="ignore"):
        total = np.append(np.uint64(0), np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)]))
        h = (total[ends] - total[starts]) * down[starts]
        return _mix(h + (ends - starts).astype(np.uint64) * _K[0]), starts


def _long_words(raw: bytes) -> np.ndarray:
    """Word hashes of a long text, piece by piece; a piece ends at white space."""
    out, at = [], 0
    while at < len(raw):
        stop = min(at + _PIECE, len(raw))
        while stop < len(raw) and not _SPACE[raw[stop]]:
            stop += 1
        out.append(_word_hashes(np.frombuffer(b" " + raw[at:stop] + b" ", np.uint8))[0])
        at = stop
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_sets(texts: list[bytes | None], words: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    raw = [(t or b"").lower() for t in texts]
    sets: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(raw)
    lot: list[int] = []
    held = 0

    def close() -> None:
        nonlocal lot, held
        if len(lot) == 1 and len(raw[lot[0]]) > _PIECE:
            w = _long_words(raw[lot[0]])
            owner = np.zeros(len(w), np.int64)
        else:
            joined = np.frombuffer(b" " + b" ".join(raw[i] for i in lot) + b" ", np.uint8)
            w, starts = _word_hashes(joined)
            first = np.cumsum([1] + [len(raw[i]) + 1 for i in lot[:-1]])
            owner = np.searchsorted(first, starts, side="right") - 1
        count = np.bincount(owner, minlength=len(lot))
        begin = np.cumsum(count) - count
        with np.errstate(over="ignore"):
            if len(w) >= words:
                s = np.zeros(len(w) - words + 1, np.uint64)
                for j in range(words):
                    s = s + w[j : len(w) - words + 1 + j] * _K[j]
                s = _mix(s)
            for k, i in enumerate(lot):
                b, c = int(begin[k]), int(count[k])
                if c >= words:
                    sets[i] = np.unique(s[b : b + c - words + 1])
                elif c:
                    sets[i] = _mix((w[b : b + c] * _K[:c]).sum(keepdims=True) + np.uint64(c) * _K[9])
        lot, held = [], 0

    for i, r in enumerate(raw):
        if held and held + len(r) > _PIECE:
            close()
        lot.append(i)
        held += len(r) + 1
    if lot:
        close()
    return sets


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("t"))


def lots(batches: Iterator[pa.RecordBatch], column: int = 1, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of batches with about limit bytes of text each, so memory follows the limit and not the batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
        cuts = np.flatnonzero(np.diff(ends // limit, prepend=0, append=-1)) if len(ends) > 1 else np.zeros(0, int)
        cuts = np.unique(np.concatenate([[0], cuts, [batch.num_rows]]))
        for lo, hi in zip(cuts, cuts[1:]):
            yield batch.slice(int(lo), int(hi - lo))


def _batches(batches: Iterator[pa.RecordBatch], words: int):
    """(ids, sets) of some rows at a time."""
    for part in lots(batches):
        yield part.column(0).to_numpy(zero_copy_only=False), shingle_sets(part.column(1).to_pylist(), words)


def _signature(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def _statistics(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray, dict[int, int], float]:
    """(token heads by rising count, their counts, texts by set size, mean list length) over all rows.

    A token's head is its upper HEAD bits. Tasks send the heads of all their tokens, sorted
    and packed by leading bits, equal sets within a task once; a second stage counts them.
    """
    bits = max(10, (8 * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))).bit_length())

    def pack(batches):
        held, size, seen, sizes = [], 0, set(), Counter()

        def flush():
            tok = np.concatenate(held)
            held.clear()
            tok.sort()
            edges = np.append(np.searchsorted(tok, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)), len(tok))
            group = np.flatnonzero(np.diff(edges))
            low = [((tok[a:b] << np.uint64(bits)) >> np.uint64(64 + bits - HEAD)).astype("<u4").tobytes() for a, b in zip(edges[group], edges[group + 1])]
            return pa.RecordBatch.from_arrays([pa.array(group, pa.int32()), pa.array(low, pa.binary()), pa.nulls(len(group), pa.int64())], names=["part", "heads", "n"])

        for _, sets in _batches(batches, words):
            for s in sets:
                if len(s) and (sig := _signature(s)[:8]) not in seen:
                    seen.add(sig)
                    held.append(s)
                    sizes[len(s)] += 1
                    size += len(s)
            if size > 1 << 20:
                yield flush()
                size = 0
        if held:
            yield flush()
        if sizes:
            few = {n: c for n, c in sizes.items() if n <= 64}
            yield pa.RecordBatch.from_arrays([pa.array([-n for n in few], pa.int32()), pa.nulls(len(few), pa.binary()), pa.array(few.values(), pa.int64())], names=["part", "heads", "n"])

    def count(batches):
        held, now, sizes = [], None, Counter()
        every = squares = 0

        def close():
            nonlocal every, squares
            low, n = np.unique(np.concatenate(held), return_counts=True)
            every, squares = every + int(n.sum()), squares + int((n * n).sum())
            often = n >= HEAVY_LEAST
            head = np.int64(now) << np.int64(HEAD - bits) | low[often].astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.zeros(len(head), np.int32)), pa.array(head), pa.array(n[often])], names=["kind", "key", "n"])

        for batch in batches:
            for part, heads, n in zip(*[batch.column(c) for c in range(3)]):
                part = part.as_py()
                if part < 0:
                    sizes[-part] += n.as_py()
                    continue
                if part != now:
                    if held:
                        yield close()
                    held, now = [], part
                held.append(np.frombuffer(heads.as_buffer(), "<u4"))
        if held:
            yield close()
        rest = [(1, n, c) for n, c in sizes.items()] + [(2, 0, squares), (3, 0, every)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rest), (pa.int32(), pa.int64(), pa.int64()))], names=["kind", "key", "n"])

    packed = texts.mapInArrow(tidy(pack), "part int, heads binary, n long")
    got = materialize(packed.repartition("part").sortWithinPartitions("part").mapInArrow(tidy(count), "kind int, key long, n long"), "join-counts")
    level = F.floor(F.log2("n") * 8)
    held, least = 0, None
    for r in got.where("kind = 0").groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        held += r["count"]
        if held > HEAVY_MOST:
            break
        least = r["level"]
    often = got.where((F.col("kind") == 0) & (level >= least) if least is not None else F.lit(False)).select("key", "n").toArrow()
    head, n = (often.column(c).to_numpy().astype(np.int64) for c in range(2))
    order = np.lexsort((head, n))
    sizes = {r.key: r.n for r in got.where("kind = 1").groupBy("key").agg(F.sum("n").alias("n")).collect()}
    total = {r.kind: r.n for r in got.where("kind >= 2").groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    discard(got)
    return head[order].view(np.uint64), n[order], sizes, (total.get(2) or 0) / max(1, total.get(3) or 0)


class Bounds:
    """Prefix lengths under a Jaccard threshold of num / den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def probe(self, n):
        """Tokens that a set must show to meet any partner no longer than itself."""
        return n - (self.num * n + self.den - 1) // self.den + 1

    def index(self, n):
        """Tokens that a set must show to meet any partner at least as long."""
        return n - (2 * self.num * n + self.num + self.den - 1) // (self.num + self.den) + 1


def boundary(sizes: dict[int, int], mean_list: float, bounds: Bounds, most: int = 40) -> int:
    """The size up to which enumerating 2-subsets costs less than scanning lists."""
    best, cost, x = 0, 0.0, 0
    for n in range(1, most + 1):
        c = sizes.get(n, 0)
        p = min(n, bounds.probe(n) + 1)
        cost += c * (p * (p - 1) / 2 - bounds.probe(n) * mean_list)
        if cost < best:
            best, x = cost, n
    return x


def _keys(texts: DataFrame, words: int, heavy: np.ndarray, counts: np.ndarray, x: int, bounds: Bounds) -> DataFrame:
    """(id, n, sig, keys): keys holds (key, flags, salt).

    Flags are 1: in the index prefix, 2: small set, 4: a subset; above these bits a token's
    place in the set's order. salt is 0, or from 1 on which part of a frequent key's list
    the text is dealt to.
    """
    order = np.argsort(heavy, kind="stable")
    parts = np.where(counts > SPLIT, np.minimum(-(-counts // SPLIT), 1 << 20), 0).astype(np.int32)
    shared = texts.sparkSession.sparkContext.broadcast((heavy[order], order.astype(np.int32), parts[order]))

    def run(batches):
        known, rank, deal = shared.value
        for ids, sets in _batches(batches, words):
            sig, sizes, keys, flags, salts, lens = [], [], [], [], [], []
            for ident, s in zip(ids.tolist(), sets):
                n = len(s)
                sizes.append(n)
                sig.append(_signature(s) if n else None)
                if not n:
                    lens.append(0)
                    continue
                pi, pp = bounds.index(n), bounds.probe(n)
                often, spread = None, None
                if len(known):
                    head = s >> np.uint64(64 - HEAD)
                    at = np.minimum(np.searchsorted(known, head), len(known) - 1)
                    often = known[at] == head
                    if often.any():
                        o = np.argsort(rank[at[often]], kind="stable")
                        rare = int(n - often.sum())
                        if rare < pp + 1:
                            spread = np.concatenate([np.zeros(rare, np.int32), deal[at[often][o]]])
                        s = np.concatenate([s[~often], s[often][o]])
                if n > x:
                    k = s[:pp]
                    at = np.arange(len(k), dtype=np.int32)
                    f = (at < pi) | (at << 3)
                    d = spread[: len(k)] if spread is not None else None
                else:
                    p = s[: min(n, pp + 1)]
                    i, j = np.triu_indices(len(p), 1)
                    with np.errstate(over="ignore"):
                        lo, hi = np.minimum(p[i], p[j]), np.maximum(p[i], p[j])
                        k = _mix(lo * _K[11] + hi * _K[12])
                    f = (j < pi + 1).astype(np.int32) | 6
                    d = np.minimum(spread[i], spread[j]) if spread is not None else None
                    if bounds.den * n >= bounds.num * (x + 1):
                        k, f = np.concatenate([k, s[:pi]]), np.concatenate([f, 3 | (np.arange(pi, dtype=np.int32) << 3)])
                        d = np.concatenate([d, spread[:pi]]) if d is not None else None
                keys.append(k)
                flags.append(f)
                lens.append(len(k))
                if d is None:
                    salts.append(np.zeros(len(k), np.int32))
                else:
                    own = int(_mix(np.array([ident], np.int64).view(np.uint64))[0] >> np.uint64(33))
                    salts.append(np.where(d > 0, own % np.maximum(d, 1) + 1, 0).astype(np.int32))
            offsets = np.zeros(len(sets) + 1, np.int32)
            np.cumsum(lens, out=offsets[1:])
            k = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
            f = np.concatenate(flags).astype(np.int32) if flags else np.zeros(0, np.int32)
            d = np.concatenate(salts) if salts else np.zeros(0, np.int32)
            items = pa.StructArray.from_arrays([pa.array(k), pa.array(f), pa.array(d)], names=["key", "flags", "salt"])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(sig, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), items)], names=["id", "n", "sig", "keys"]
            )

    return texts.mapInArrow(tidy(run), "id long, n int, sig binary, keys array<struct<key:bigint,flags:int,salt:int>>")


def _fits(n1, n2, f1, f2, num: int, den: int):
    """Whether members (shorter first) of one list can be a candidate pair with this as their first common token.

    Takes arrays or columns.
    """
    if isinstance(f1, Column):
        both, least, place = lambda x, y: x.bitwiseAND(y), F.least, lambda f: F.shiftright(f, 3)
    else:
        both, least, place = lambda x, y: x & y, np.minimum, lambda f: f >> 3
    one, two, four = (F.lit(1), F.lit(2), F.lit(4)) if isinstance(f1, Column) else (1, 2, 4)
    rest = least(n1 - place(f1), n2 - place(f2))
    return (n1 * den >= n2 * num) & (rest * (num + den) >= (n1 + n2) * num) & (both(f1, one) == 1) & ((both(both(f1, f2), two) == 0) | (both(f1, four) == 4))


def _scan(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Scan lists sorted by (key, salt, n, id): rows (key, a, b, n, flags, salt).

    With b the candidate pair a, b (shorter first); without, a member of a long list. The
    parts of a list that is dealt to several tasks are long whatever their length.
    """

    def emit(key, a, b, n, f, salt):
        return pa.RecordBatch.from_arrays(
            [pa.array(key, pa.int64()), pa.array(a, pa.int64()), b, pa.array(n, pa.int32()), pa.array(f, pa.int32()), pa.array(salt, pa.int32())], names=["key", "a", "b", "n", "flags", "salt"]
        )

    def scan(batches):
        tail, big = None, None
        it = iter(batches)
        while True:
            batch = next(it, None)
            cur = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(5)] if batch is not None else [np.zeros(0, t) for t in (np.int64, np.int64, np.int32, np.int32, np.int32)]
            if tail is not None:
                cur, tail = [np.concatenate(x) for x in zip(tail, cur)], None
            key, ident, n, f, salt = cur
            if not len(key):
                if batch is None:
                    return
                continue
            starts = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])))
            size = np.diff(np.append(starts, len(key)))
            going = big is not None and (key[0], salt[0]) == big[0]
            if not going:
                big = None
            if batch is not None and size[-1] <= LIGHT and not (going and len(starts) == 1):
                tail = [c[starts[-1] :] for c in cur]
                key, ident, n, f, salt = (c[: starts[-1]] for c in cur)
                starts, size = starts[:-1], size[:-1]
            if not len(key):
                continue
            long = (size > LIGHT) | (salt[starts] > 0)
            if going:
                long[0] = True
            group = np.repeat(np.arange(len(starts)), size)
            lone = ~long[group]
            pairs = []
            for d in range(1, LIGHT):
                i = np.flatnonzero((key[d:] == key[:-d]) & (salt[d:] == salt[:-d]) & lone[:-d]) if len(key) > d else np.zeros(0, int)
                if not len(i):
                    break
                i = i[_fits(n[i], n[i + d], f[i], f[i + d], num, den)]
                pairs.append((ident[i], ident[i + d]))
            for g in np.flatnonzero(long):
                m = np.arange(starts[g], starts[g] + size[g])
                rows_ = [c[m] for c in (ident, n, f)]
                if g == 0 and going:
                    rows_ = [np.concatenate([[one, two], r]) for one, two, r in zip(big[1], big[2], rows_)]
                i_, n_, f_ = rows_
                q = np.arange(1, len(i_))
                first = np.zeros(len(q), int)
                ok = _fits(n_[first], n_[q], f_[first], f_[q], num, den)
                pairs.append((i_[first][ok], i_[q][ok]))
                q = q[~ok]
                ok = _fits(n_[q - 1], n_[q], f_[q - 1], f_[q], num, den)
                pairs.append((i_[q - 1][ok], i_[q][ok]))
                yield emit(key[m], ident[m], pa.nulls(len(m), pa.int64()), n[m], f[m], salt[m])
                if g == len(starts) - 1 and batch is not None and tail is None:
                    big = ((key[m[-1]], salt[m[-1]]), (i_[0], n_[0], f_[0]), (i_[-1], n_[-1], f_[-1]))
            if pairs:
                ab = np.unique(np.stack([np.concatenate(x) for x in zip(*pairs)], 1), axis=0)
                ab = ab[ab[:, 0] != ab[:, 1]]
                if len(ab):
                    zero = np.zeros(len(ab), np.int64)
                    yield emit(zero, ab[:, 0], pa.array(ab[:, 1], pa.int64()), zero, zero, zero)
            if batch is None:
                return

    return rows.mapInArrow(tidy(scan), "key long, a long, b long, n int, flags int, salt int")


def _bitmap(s: np.ndarray) -> np.ndarray:
    """Bits of the set's hashes, about four bits a token, at least 64."""
    size = 64
    while size < 4 * len(s):
        size *= 2
    bits = np.zeros(size, np.uint8)
    bits[(s >> np.uint64(7)).astype(np.int64) & (size - 1)] = 1
    return np.packbits(bits, bitorder="little").view(np.int64)


def _of(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts of a materialized table of ids; of many ids also some others, and no text is shuffled."""
    return texts.join(F.broadcast(ids), "id", "left_semi") if fits(ids, 16) else maybe_in(texts, "id", ids)


def _bits(texts: DataFrame, words: int) -> DataFrame:
    def run(batches):
        for ids, sets in _batches(batches, words):
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array([_bitmap(s) for s in sets], pa.list_(pa.int64()))], names=["id", "n", "bits"]
            )

    return texts.mapInArrow(tidy(run), "id long, n int, bits array<bigint>")


def _sets(texts: DataFrame, words: int) -> DataFrame:
    def run(batches):
        for ids, sets in _batches(batches, words):
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["id", "n", "items"]
            )

    return texts.mapInArrow(tidy(run), "id long, n int, items array<bigint>")


def _linked(inter: Column, na: str, nb: str, num: int, den: int) -> Column:
    return inter * den >= (F.col(na).cast("long") + F.col(nb) - inter) * num


def _possible(pairs: DataFrame, bitmaps: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) that the bitmaps do not rule out."""
    side = lambda x: bitmaps.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def fold(x: str, y: str) -> Column:
        half = (F.size(x) / 2).cast("int")
        return F.when(F.size(x) > F.size(y), F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda p, q: p.bitwiseOR(q))).otherwise(F.col(x))

    both = both.select("a", "b", "na", "nb", fold("bits_a", "bits_b").alias("x"), fold("bits_b", "bits_a").alias("y"))
    lost = F.aggregate(F.zip_with("x", "y", lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0), lambda s, c: s + c)
    lost_b = F.aggregate(F.zip_with("y", "x", lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0), lambda s, c: s + c)
    most = F.least(F.col("na") - lost, F.col("nb") - lost_b).cast("long")
    return both.where(_linked(most, "na", "nb", num, den)).select("a", "b")


def _links(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) whose sets reach the threshold."""
    pairs = materialize(pairs, "join-todo")

    def side(x: str) -> DataFrame:
        ids = materialize(pairs.select(F.col(x).alias("id")).distinct(), "join-ids")
        some = sets.join(small_side(ids, 16), "id", "left_semi")
        return some.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("items").alias(f"items_{x}"))

    both = pairs.join(side("a"), "a").join(side("b"), "b")
    inter = F.size(F.array_intersect("items_a", "items_b")).cast("long")
    return both.where(_linked(inter, "na", "nb", num, den)).select("a", "b")


def _mapped(df: DataFrame, col: str, maps: list[DataFrame]) -> DataFrame:
    """df with col taken through maps (node, component) one after the other; what a map lacks stays."""
    for m in maps:
        side = small_side(m.select(F.col("node").alias("_node"), F.col("component").alias("_to")), 40)
        df = df.join(side, F.col(col) == F.col("_node"), "left").withColumn(col, F.coalesce("_to", col)).drop("_node", "_to")
    return df


def _across(pairs: DataFrame, maps: list[DataFrame]) -> DataFrame:
    """Pairs whose ends lie in different components, with the components as ca and cb."""
    both = pairs.withColumns({"ca": F.col("a"), "cb": F.col("b")})
    return _mapped(_mapped(both, "ca", maps), "cb", maps).where("ca <> cb")


def _forest(first: DataFrame) -> DataFrame:
    """Components (node, component) of links (a, b) with a < b and one link a b.

    A text that is no other's partner only takes its partner's label, so rounds run over
    the others alone; of a group around one text nothing is left for them.
    """
    parents = materialize(first.select("a").distinct(), "join-parents")
    inner = first.join(small_side(parents.withColumnRenamed("a", "b"), 16), "b", "left_semi")
    core = materialize(components(inner), "join-core")
    tops = _mapped(parents.select(F.col("a").alias("node"), F.col("a").alias("component")), "component", [core])
    below = _mapped(first.select(F.col("b").alias("node"), F.col("a").alias("component")), "component", [core])
    return materialize(tops.unionByName(below).distinct(), "join-comp")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows that agree in the first three columns, from batches sorted by them."""
    held, now = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(3)], 1)
        edges = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1).tolist(), len(k)]
        for lo, hi in zip(edges, edges[1:]):
            if held and tuple(k[lo]) != now:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            now = tuple(k[lo])
    if held:
        yield pa.Table.from_batches(held)


def _may_link(run: pa.Table, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, second, which) of a run of _open_links: its members of either block, and which pairs of them may link."""
    i, j, block, ident, n, f, c = (run.column(k).to_numpy().astype(np.int64) for k in range(1, 8))
    order = np.lexsort((ident, n))
    first, second = order[block[order] == i[0]], order[block[order] == j[0]]
    which = np.zeros((len(first), len(second)), bool)
    for a in range(0, len(first), 256):
        x = first[a : a + 256, None]
        which[a : a + 256] = (c[x] != c[second]) & _fits(n[x], n[second], f[x], f[second], num, den)
    return first, second, np.triu(which, 1) if i[0] == j[0] else which


def _left_by_bits(which: np.ndarray, first: np.ndarray, second: np.ndarray, n: np.ndarray, bits: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """Those pairs of which, by first and second, that the bitmaps of the members do not rule out, as in _possible."""
    size = np.array([len(b) for b in bits])
    out = np.zeros_like(which)

    def folded(members: np.ndarray, width: int) -> np.ndarray:
        x = np.stack([bits[k] for k in members])
        return np.bitwise_or.reduce(x.reshape(len(x), -1, width), 1)

    for s in np.unique(size[first]):
        rows = np.flatnonzero(size[first] == s)
        for t in np.unique(size[second]):
            cols = np.flatnonzero(size[second] == t)
            part = which[np.ix_(rows, cols)]
            rows_, cols_ = rows[part.any(1)], cols[part.any(0)]
            if not len(rows_):
                continue
            x, y = folded(first[rows_], min(s, t)), folded(second[cols_], min(s, t))
            ny = n[second[cols_]]
            for r, bit in zip(rows_, x):
                at = np.flatnonzero(which[r, cols_])
                some, na = y[at], n[first[r]]
                lost_a, lost_b = (np.bitwise_count(z).sum(1).astype(np.int64) for z in (bit & ~some, some & ~bit))
                most = np.minimum(na - lost_a, ny[at] - lost_b)
                out[r, cols_[at]] = most * den >= (na + ny[at] - most) * num
    return out


def _common(sets: list[np.ndarray], first: np.ndarray, second: np.ndarray, cells: int = 1 << 22) -> np.ndarray:
    """Sizes of the intersections of sets, by first and second; products of 0-1 matrices of at most about cells."""
    token, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.cumsum(n > 1) - 1
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    some = n[at] > 1
    owner, at = owner[some], place[at[some]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    out = np.zeros((len(first), len(second)), np.float32)
    width = max(1, cells // max(1, len(sets)))
    for lo in range(0, int((n > 1).sum()), width):
        a, b = np.searchsorted(at, (lo, lo + width))
        m = np.zeros((len(sets), width), np.float32)
        m[owner[a:b], at[a:b] - lo] = 1
        out += m[first] @ m[second].T
    return out.astype(np.int64)


def _joining(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Which of the links a b join nodes that those before leave apart; the others change no component."""
    pair, at = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0, return_index=True)
    top: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := top.get(x, x)) != x:
            top[x] = top.get(y, y)
            x = y
        return x

    out = []
    for (x, y), i in zip(pair.tolist(), at.tolist()):
        x, y = root(x), root(y)
        if x != y:
            top[max(x, y)] = min(x, y)
            out.append(i)
    return out


def _open_links(members: DataFrame, sets: DataFrame | Callable[[DataFrame], DataFrame], num: int, den: int, bitmaps: DataFrame | None = None) -> DataFrame:
    """Links (a, b) that join components within lists; members are (key, id, n, flags, component).

    A list is cut into blocks by rising size of set, of about BLOCK tokens and at most
    BLOCK / LEAST members; a task meets two of them. Pairs are told apart in arrays and never
    become rows: first what the places allow, then what the bitmaps of the members that still
    have a partner do, then, with the sets of those left, the exact intersections as a product
    of matrices. A set goes to every list and block that its text is met in, so only few may be
    left by then: likely links share many lists, so each member is first compared with its first
    partner in a list, every such pair once, and what that joins is no longer across components.
    sets are (id, n, items), or a function that makes them for a table of ids;
    without bitmaps (id, n, bits) that step is left out. Of a run's links those
    are returned that join what the others leave apart, so the components are those of all
    links. Every pair that may be a link is met in its list, so what is compared grows with
    the square of a list across components, what is moved with its length times its blocks.
    """
    order = Window.partitionBy("key").orderBy("n", "id").rowsBetween(Window.unboundedPreceding, 0)
    block = F.floor((F.sum(F.greatest(F.col("n"), F.lit(LEAST)).cast("long")).over(order) - 1) / BLOCK).cast("int")
    dealt = materialize(members.select("key", block.alias("block"), "id", "n", "flags", "component"), "join-blocks")
    blocks = dealt.groupBy("key", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("component").alias("c"), F.max("component").alias("d"))
    x, y = (blocks.select("key", *[F.col(c).alias(f"{c}{i}") for c in blocks.columns[1:]]) for i in (1, 2))
    met = x.join(y, "key").where("block1 <= block2").where((F.col("hi1").cast("long") * den >= F.col("lo2").cast("long") * num) & (F.least("c1", "c2") < F.greatest("d1", "d2")))
    met = met.select("key", F.col("block1").alias("i"), F.col("block2").alias("j"), F.explode(F.array_distinct(F.array("block1", "block2"))).alias("block"))
    rows = dealt.join(met, ["key", "block"]).select("key", "i", "j", "block", "id", "n", "flags", "component")

    def partners(batches):
        for run in _runs(batches):
            first, second, which = _may_link(run, num, den)
            if run.num_columns > 8 and which.any():
                which = _left_by_bits(which, first, second, run.column(5).to_numpy().astype(np.int64), [b.values.to_numpy().view(np.uint64) for b in run.column(8)], num, den)
            keep = np.unique(np.concatenate([first[which.any(1)], second[which.any(0)]]))
            if len(keep):
                mate = np.zeros(run.num_rows, np.int64)
                mate[first], has = second[which.argmax(1)], which.any(0)
                mate[second[has]] = first[which.argmax(0)[has]]
                yield from run.select(range(8)).append_column("mate", run.column(4).take(mate)).take(keep).to_batches()

    def links(batches):
        for run in _runs(batches):
            first, second, which = _may_link(run, num, den)
            ident, n = (run.column(c).to_numpy().astype(np.int64) for c in (4, 5))
            items = [s.values.to_numpy() for s in run.column(8)]
            inter = _common(items, first, second)
            hit = which & (inter * den >= (n[first][:, None] + n[second] - inter) * num)
            a, b = first[np.nonzero(hit)[0]], second[np.nonzero(hit)[1]]
            some = _joining(*(run.column(7).to_numpy()[z] for z in (a, b)))
            a, b = ident[a[some]], ident[b[some]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    by = ["key", "i", "j"]
    kind = "key long, i int, j int, block int, id long, n int, flags int, component long, mate long"
    dealt_out = lambda df: df.repartition(*by).sortWithinPartitions(*by)
    only = lambda df: materialize(df.select("id").distinct(), "join-ids")
    own = lambda ids: sets(ids) if callable(sets) else sets.join(small_side(ids, 16), "id", "left_semi")

    def likely(some: DataFrame) -> DataFrame:
        ids = only(some)
        own = bitmaps.join(small_side(ids, 16), "id", "left_semi").select("id", "bits")
        near = materialize(dealt_out(some.join(own, "id").select(*rows.columns, "bits")).mapInArrow(tidy(partners), kind), "join-near")
        discard(some, ids)
        return near

    some, early = materialize(dealt_out(rows).mapInArrow(tidy(partners), kind), "join-partners"), None
    if bitmaps is not None and some.head(1):
        some = likely(some)
        pairs = materialize(some.select(F.least("id", "mate").alias("a"), F.greatest("id", "mate").alias("b")).distinct(), "join-mates")
        ids = only(pairs.select(F.explode(F.array("a", "b")).alias("id")))
        mated = materialize(own(ids), "join-mate-sets")
        early = materialize(_links(pairs, mated, num, den), "join-links")
        label = materialize(some.select(F.col("id").alias("node"), "component").distinct(), "join-comp")
        joined = materialize(components(_across(early, [label]), "ca", "cb"), "join-comp")
        after = materialize(_mapped(some, "component", [joined]), "join-near")
        discard(some, pairs, ids, mated, label)
        some = likely(after)
    ids = only(some)
    full = some.join(own(ids).select("id", "items"), "id").select(*rows.columns, "items")
    found = dealt_out(full).mapInArrow(tidy(links), "a long, b long")
    found = found if early is None else found.unionByName(early)
    out = materialize(found.distinct(), "join-links")
    discard(dealt, some, ids)
    return out


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """One row per row of docs: id, n_shingles, class_id (smallest id of an equal set), component_id."""
    bounds = Bounds(num, den)
    texts = _texts(docs, id_col, text_col)
    heavy, counts, sizes, mean_list = _statistics(texts, words)
    x = boundary(sizes, mean_list, bounds)
    table = materialize(_keys(texts, words, heavy, counts, x, bounds), "join-keys")
    classes = materialize(table.where("n > 0").groupBy("sig").agg(F.min("id").alias("rep"), F.count("*").alias("c")).where("c > 1"), "join-classes")
    slim = table.select("id", "n", "sig").join(small_side(classes.select("sig", "rep"), 40), "sig", "left")
    slim = materialize(slim.select("id", "n", F.coalesce("rep", "id").alias("rep")), "join-slim")
    first_of = table.where("n > 0").join(small_side(classes.select("sig", F.col("rep")), 40), "sig", "left")
    reps = first_of.where(F.col("rep").isNull() | (F.col("rep") == F.col("id"))).select("id", "n", "keys")
    rows = reps.select("id", "n", F.explode("keys").alias("k")).select("k.key", "id", "n", "k.flags", "k.salt")
    got = materialize(_scan(rows.repartition("key", "salt").sortWithinPartitions("key", "salt", "n", "id"), num, den), "join-scan")
    discard(table, classes)
    lists = got.where("b is null").select("key", F.col("a").alias("id"), "n", "flags", "salt")
    pairs = got.where("b is not null").select("a", "b")
    head = F.min(F.struct("n", "id", "flags"))
    heads = lists.where("salt > 0").groupBy("key", "salt").agg(head.alias("own"))
    lead = heads.groupBy("key").agg(F.min("own").alias("top"))
    met = heads.join(lead, "key").where("top <> own").where(_fits(F.col("top.n"), F.col("own.n"), F.col("top.flags"), F.col("own.flags"), num, den))
    pairs = pairs.unionByName(met.select(F.col("top.id").alias("a"), F.col("own.id").alias("b")))
    pairs = materialize(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "join-pairs")
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).union(lists.select("id")).distinct()
    wanted = materialize(wanted, "join-wanted")
    bitmaps = materialize(_bits(_of(texts, wanted), words), "join-bits")
    maybe = materialize(_possible(pairs, bitmaps, num, den), "join-possible")
    paired = materialize(maybe.select(F.col("a").alias("id")).union(maybe.select("b")).distinct(), "join-paired")
    sets = materialize(_sets(_of(texts, paired), words), "join-sets")
    first = maybe.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = materialize(_links(first, sets, num, den), "join-links")
    maps = [_forest(links)]
    rest = _across(maybe.join(first, ["a", "b"], "left_anti"), maps).select("a", "b")
    more = materialize(_links(rest, sets, num, den), "join-links")
    maps.append(materialize(components(_across(more, maps), "ca", "cb"), "join-comp"))
    member = materialize(_mapped(lists.withColumn("component", F.col("id")), "component", maps), "join-lists")
    split = materialize(member.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key"), "join-open")
    left = materialize(member.join(small_side(split, 24), "key", "left_semi"), "join-split")
    discard(got, member, split, wanted, paired, sets)
    late = _open_links(left, lambda ids: _sets(_of(texts, ids), words), num, den, bitmaps)
    discard(left, bitmaps, pairs, maybe)
    maps.append(materialize(components(_across(late, maps), "ca", "cb"), "join-comp"))
    out = _mapped(slim.withColumn("component", F.col("rep")), "component", maps)
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.col("rep").alias("class_id"), F.col("component").alias("component_id"))


def op6_ngram_join(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate components of the whole documents table."""
    small_batches(spark)
    return similar_groups(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS t FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(t) = 0 THEN [] WHEN len(t) < 5 THEN [array_to_string(t, ' ')]
        ELSE list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
r(d, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.d)
SELECT d AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(c) AS component_id
FROM r LEFT JOIN n ON n.doc_id = r.d GROUP BY d
"""
