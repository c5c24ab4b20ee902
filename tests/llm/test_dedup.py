"""Exact dedup, line dedup, n-gram join and repeats against brute force."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from vectide.llm import common, exact_dedup, line_dedup, ngram_join, repeats
from vectide.llm.common import components

from .helpers import docs, empty, odd_texts, words


def test_components(spark, monkeypatch):
    r = random.Random(5)
    edges = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(40)] + [(None, 3)]
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    assert got == {x: min(y for y in parent if find(y) == find(x)) for x in parent}
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    assert got == {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("every", [True, False])
def test_exact(spark, every):
    texts = odd_texts()
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(docs(spark, texts), digest_all=every).collect()}
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in texts]
    for i, t in enumerate(norm):
        same = [j for j, u in enumerate(norm) if u == t]
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (same[0], len(same), same[0] == i)
        if every or len(same) > 1:
            assert got[i].text_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert exact_dedup.exact_dedup(empty(spark), digest_all=every).count() == 0


def within_one(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return a == b
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] or a[i + 1 :] == b[i:] or a[i:] == b[i + 1 :]


def brute_lines(texts):
    first = {}
    for d, t in enumerate(texts):
        for n, line in enumerate((t or "").split("\n") if t is not None else ()):
            if len(line.strip(" ")) >= 20:
                first.setdefault(line, (d, n))
    gone = {a for a, b in itertools.permutations(first, 2) if first[b] < first[a] and within_one(a, b)}
    out = []
    for d, t in enumerate(texts):
        keep = [x for n, x in enumerate(t.split("\n")) if x not in first or (x not in gone and first[x] == (d, n))] if t is not None else None
        out.append(None if keep is None else "\n".join(keep))
    return out


def test_lines(spark):
    r = random.Random(1)
    pool = [words(r.randint(4, 9), 50 + i) for i in range(25)] + ["é" * 30, "abcabcabcabcabcabcabcabc"]

    def edited(x):
        k = r.randrange(len(x))
        return r.choice([x, x, x[:k] + x[k + 1 :], x[:k] + "z" + x[k + 1 :], x[:k] + "z" + x[k:], x[:-1], x + "q", "q" + x, x[1:]])

    texts = ["\n".join(edited(r.choice(pool)) for _ in range(r.randint(1, 6))) for _ in range(60)] + [None, "", "short\nshort", "\n"]
    df = docs(spark, texts).drop("n", "no", "at", "key", "c", "t", "h", "id")
    got = {x.doc_id: x.text for x in line_dedup.line_dedup(df).collect()}
    want = brute_lines(texts)
    assert [got[i] for i in range(len(texts))] == want
    assert sum(a != b for a, b in zip(texts, want)) > 20
    odd = odd_texts()
    got = {x.doc_id: x.text for x in line_dedup.line_dedup(docs(spark, odd)).collect()}
    assert [got[i] for i in range(len(odd))] == brute_lines(odd)
    assert line_dedup.line_dedup(empty(spark)).count() == 0


def brute_groups(texts, num=75, den=100):
    sets = []
    for t in texts:
        w = [x for x in re.split(rb"[\x20\x09-\x0D]+", (t or "").encode().lower()) if x]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    comp = list(range(len(texts)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        i = len(sets[a] & sets[b])
        if i and den * i >= num * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            comp[y] = x
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def near(base, r, edits):
    w = base.split(" ")
    for _ in range(edits):
        w[r.randrange(len(w))] = "w%d" % r.randrange(10**6)
    return " ".join(w)


def test_join(spark, monkeypatch):
    r = random.Random(2)
    bases = [words(n, 70 + n) for n in (6, 9, 14, 30, 60, 200)]
    texts = [near(r.choice(bases), r, r.randint(0, 4)) for _ in range(150)]
    hot = words(80, 9)
    texts += [near(hot, r, r.randint(0, 3)) for _ in range(60)] + [words(r.randint(3, 20), 900 + i) + " " + hot for i in range(30)] + odd_texts()
    monkeypatch.setattr(ngram_join, "HEAVY_LEAST", 3)
    for x in (None, 40):
        if x is not None:
            monkeypatch.setattr(ngram_join, "boundary", lambda *a, x=x, **k: x)
            monkeypatch.setattr(ngram_join, "SPLIT", 4)  # frequent lists dealt to many tasks
            monkeypatch.setattr(common, "BROADCAST_BYTES", 0)  # and no side broadcast
        got = {d.doc_id: (d.n_shingles, d.component_id) for d in ngram_join.similar_groups(docs(spark, texts)).collect()}
        assert [got[i] for i in range(len(texts))] == brute_groups(texts)
    assert ngram_join.similar_groups(empty(spark)).count() == 0


def test_prefixes_lose_no_pair():
    b = ngram_join.Bounds(75, 100)
    for n1 in range(1, 60):
        for n2 in range(n1, 80):
            o = next((o for o in range(n1 + 1) if 100 * o >= 75 * (n1 + n2 - o)), None)
            if o:
                assert n1 - o + 1 <= b.index(n1) and n2 - o + 1 <= b.probe(n2)


def brute_repeats(texts, length=400):
    data = [(t or "").encode() for t in texts]
    seen = {}
    for d, t in enumerate(data):
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for t in data:
        on = np.zeros(len(t) + 1, int)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                on[i] += 1
                if i + length <= len(t):
                    on[i + length] -= 1
        cov = np.cumsum(on)[: len(t)] > 0
        kept = bytes(b for b, c in zip(t, cov) if not c)
        out.append((len(t), int(cov.sum()), int((np.diff(np.append(0, cov.astype(int))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def brute_passages(texts, n=50):
    rows = [[w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w] for t in texts]
    places = {}
    for d, w in enumerate(rows):
        for i in range(len(w) - n + 1):
            places.setdefault(tuple(w[i : i + n]), set()).add(d)
    return [any(len(places[tuple(w[i : i + n])]) > 1 for i in range(len(w) - n + 1)) for w in rows]


def repeat_texts():
    r = random.Random(3)
    passage = words(150, 11)
    texts = [words(60, 200 + i) + " " + passage[r.randint(0, 80) : r.randint(500, len(passage))] + " " + words(60, 300 + i) for i in range(25)]
    short = " ".join(words(80, 13).split()[:50])  # under 400 bytes
    texts += [words(30, 400) + " " + short + "\n" + words(30, 401), words(9, 402) + "\t" + short, words(30, 403) + " " + short[:-1], short.replace(" ", "  ", 2) + " " + words(30, 404)]
    return texts + [passage, passage * 2, "y" * 900, "ab" * 500, words(500, 12), words(500, 12)[3:], None, "", "short", "é" * 300]


def test_repeats(spark, monkeypatch):
    texts = repeat_texts()
    want = brute_repeats(texts)
    shared = brute_passages(texts)
    assert 20 < sum(shared) < len(texts)
    for most, piece, limit in ((50_000, 1 << 19, 24 << 20), (2, 1 << 10, 0)):
        monkeypatch.setattr(repeats, "TREE_MOST", most)
        monkeypatch.setattr(repeats, "_PIECE", piece)
        monkeypatch.setattr(common, "BROADCAST_BYTES", limit)
        rows = repeats.remove_repeats(docs(spark, texts)).collect()
        got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in rows}
        assert [got[i] for i in range(len(texts))] == want
        got = {x.doc_id: x.passage_words for x in rows}
        assert [got[i] >= 50 for i in range(len(texts))] == shared and {got[i] for i in range(len(texts)) if not shared[i]} == {0}
    assert repeats.remove_repeats(empty(spark)).count() == 0


def test_maximal_repeats(spark):
    texts = repeat_texts()
    data = [(t or "").encode() for t in texts]
    found = repeats.maximal_repeats(docs(spark, texts)).collect()
    groups = {}
    for r in found:
        groups.setdefault((r.group, r.size), set()).add((r.id, r.start))
    assert groups
    for (_, size), places in groups.items():
        strings = {data[d][s : s + size] for d, s in places}
        assert size >= 400 and len(strings) == 1 and len(places) > 1
        one = strings.pop()
        assert places == {(d, i) for d, t in enumerate(data) for i in range(len(t) - size + 1) if t[i : i + size] == one}
