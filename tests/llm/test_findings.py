"""Cases that the review of round 1 found uncovered."""

import itertools
import math
import os
import random
import re
import tracemalloc
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from vectide.llm import common, language_id, line_dedup, ngram_join, pieces, pii, textbuf, toxicity

from .helpers import docs, odd_texts, words
from .test_dedup import brute_groups, near, within_one

DATA = "/root/testdata/sf0.01"


def brute_every_line(texts):
    first = {}
    for d, t in enumerate(texts):
        for n, line in enumerate((t or "").split("\n")):
            if line.strip(" \t\r\x0b\x0c") or len(line.strip(" ")) >= 20:
                first.setdefault(line, (d, n))
    long = [x for x in first if len(x.strip(" ")) >= 20]
    gone = {a for a, b in itertools.permutations(long, 2) if first[b] < first[a] and within_one(a, b)}
    keep = lambda d, t: [x for n, x in enumerate(t.split("\n")) if x not in first or (x not in gone and first[x] == (d, n))]
    return [None if t is None else "\n".join(keep(d, t)) for d, t in enumerate(texts)]


def test_equal_lines_of_any_length(spark):
    r = random.Random(8)
    pool = ["Wh the.", "x", "ab", "abc", " ", "", "\r", "\t", " x", "short line", "nineteen characters", words(7, 1), words(7, 1) + "q", words(8, 2)]
    texts = ["\n".join(r.choice(pool) for _ in range(r.randint(1, 9))) for _ in range(40)] + ["\n".join(["Wh the."] * 181), "new one\n\n\nnew one\nnew ones", None, ""] + odd_texts()
    got = {x.doc_id: x for x in line_dedup.line_dedup(docs(spark, texts), every_line=True).collect()}
    want = brute_every_line(texts)
    assert [got[i].text for i in range(len(texts))] == want
    assert got[40].n_removed >= 180 and want[41] == "new one\n\n\nnew ones"
    stage = corpus_pipeline.lines(spark, docs(spark, ["some\nshort\nsome", "short\nother"], clash=False), "")
    assert sorted((x.doc_id, x.text, x.n_chars) for x in stage.collect()) == [(0, "some\nshort", 10), (1, "other", 5)]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_equal_lines_match_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    want = con.execute(f"select doc_id, text, n_lines, n_removed from ({line_dedup.EVERY_SQL})").fetchall()
    got = line_dedup.op5_line_dedup_every(spark, DATA).select("doc_id", "text", "n_lines", "n_removed")
    assert sorted(map(tuple, got.collect())) == sorted(want)


def contexts(spark, texts):
    got = {x.doc_id: x["all"] for x in pii.find_pii(docs(spark, texts)).collect()}
    return [[(s["kind"], texts[i][s["start"] : s["end"]]) for s in got[i] if s["kind"].startswith("ctx_")] for i in range(len(texts))]


def test_patterns_of_identifier_words(spark):
    texts = [f"hello id 123456 mail: user{i}@mail.example.com bye" for i in range(12)] + ["see 123456 mail: zed-at-7-example bye", "see 123457 mail: zed-at-9-example bye"]
    got = contexts(spark, texts)
    assert got[12] == [("ctx_email", "zed-at-7-example")] and got[13] == [("ctx_email", "zed-at-9-example")] and not got[0]


def brute_contexts(texts, min_seeds=3, min_conf=0.7, min_score=0.7, min_share=0.5):
    """The bootstrapping for texts whose identifiers are single words."""
    tokens = lambda t: re.findall(r"[^\W\d]+|[=:]", t.lower())
    uses, edges, seen = Counter(), Counter(), []
    for d, t in enumerate(texts):
        w = tokens(t)
        uses.update(" ".join(x) for x in zip(w, w[1:]))
        uses.update("^" + x[:4] for x in w)
        for m in re.finditer(r"\S*[0-9@]\S*", t):
            word = m.group()
            inner = re.match(r"""(?:\S*[=:"'](?=[A-Za-z0-9+]))?[^A-Za-z0-9+]*""", word).group()
            inst = word[len(inner) :].rstrip("\"'.,")
            email = re.fullmatch(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", inst)
            secret = re.fullmatch(r"[A-Za-z0-9_-]{16,}", inst) and sum(c.isdigit() for c in inst) > 1 and sum(c.isalpha() for c in inst) > 1
            before = tokens(" ".join(t[: m.start()].split()[-3:]) + " " + ("" if email else inner))[-2:]
            own = [" ".join(before)] * (len(before) == 2) + ["^" + inst[:4].lower()] * (not email and re.match("[A-Za-z]{4}", inst) is not None)
            for p in own:
                edges[p, inst] += 1
            seen.append((d, inst, "email" if email else "secret" if secret else None, own))
    kind = {i: k for _, i, k, own in seen if own}
    stats = {}
    for p in {p for p, _ in edges}:
        mine = [(i, n) for (q, i), n in edges.items() if q == p]
        told = sum(n for i, n in mine if kind[i])
        if sum(kind[i] is not None for i, _ in mine) >= min_seeds and told >= min_share * max(uses[p], 1):
            stats[p] = (mine, max(kind[i] for i, _ in mine if kind[i]))
    score = {i: float(kind[i] is not None) for _, i in edges}
    for _ in range(200):
        conf = {p: sum(n * score[i] for i, n in mine) / (uses[p] + 1) for p, (mine, _) in stats.items()}
        score = {i: 1.0 if kind[i] else 1 - math.prod(1 - conf[p] for p in stats if (p, i) in edges) for i in score}
    out = [[] for _ in texts]
    for d, inst, k, own in seen:
        sure = [stats[p][1] for p in own if p in stats and conf[p] >= min_conf]
        if k != "email" and sure and score[inst] >= min_score:
            out[d].append(("ctx_" + max(sure), inst))
    return out


def test_bootstrapping_matches_brute_force(spark):
    r = random.Random(12)
    hexes = lambda n: "".join(r.choice("0123456789abcdef" if k % 6 else "abcdef") for k in range(n - 2)) + "a1"  # noqa: E731, no card inside
    item = [lambda: f"u{r.randrange(99)}@m.example.com", lambda: hexes(40), lambda: "KEYX" + hexes(14).upper(), lambda: f"n-{r.randrange(50)}", lambda: f"KEYX{r.randrange(9)}"]
    lead = {"mail to": (8, 0, 0, 3, 0), "token =": (0, 8, 0, 2, 0), "see no": (1, 1, 0, 8, 1), "of the": (2, 2, 2, 2, 0), "it is": (0, 0, 5, 1, 3)}
    texts = []
    for _ in range(150):
        words_ = []
        for _ in range(r.randint(1, 3)):
            k = r.choice(list(lead))
            words_ += ["foo bar of the foo", k, r.choices(item, lead[k])[0]() + r.choice(["", "", "."])]
        texts.append(" ".join(words_) + " end")
    texts += [f'password={hexes(18)} x "{hexes(20)}" y' for _ in range(5)] + ["password=hunter-2 z", "token = abc1", "end: KEYX7.", None, ""]
    want = brute_contexts([t or "" for t in texts])
    got = contexts(spark, [t or "" for t in texts])
    assert [sorted(x) for x in got] == [sorted(x) for x in want]
    assert 60 < sum(map(bool, want)) < 150 and want[155] == [("ctx_secret", "hunter-2")] and want[156]


def test_lead_is_three_words_before(spark):
    texts = ["a b 12345", "a 12345 23456 34567 c 45678", "12345", "x" * 400 + " \t" + "y" * 400 + "\n12345", "é 日本 @12345 z"]
    want = []
    for i, t in enumerate(texts):
        w = t.split()
        want += [(i, x, " ".join(w[max(0, k - 3) : k])) for k, x in enumerate(w) if any(c in "0123456789@" for c in x)]
    got = pii.placed(pii.matches(docs(spark, texts))).where("kind = 'word'").select("id", "m", "pattern").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_identifiers_with_spaces(spark):
    texts = [f"hello please call now: +1 (017) 555-77{i:02d} bye" for i in range(12)] + ["please call now: 017 555 9999 ext", "please call now:\n(017)  555-8888.", "some call later: 017 555 9999 ext"]
    texts += [f"you paid with card: 4111 1111 1111 1111 at a@b{i}.com or  x" for i in range(3)] + ["first call now: +1 (017) 555-7701 0475551234 5 z", "call now: " + "9" * 70 + " x"]
    got = contexts(spark, texts)
    assert got[12:15] == [[("ctx_phone", "017 555 9999")], [("ctx_phone", "017)  555-8888")], []]
    assert not any(got[:12] + got[15:18]) and got[18] == [("ctx_phone", "+1 (017) 555-7701 0475551234 5")]  # 22 digits: no base span
    assert got[19] == [("ctx_phone", "9" * 70)]


def test_toxicity_training_holds_a_lot_at_a_time():
    texts = [words(600, i) + (" zzidiot zzmoron vequx" if i % 4 == 0 else "") for i in range(1200)]
    told = [None if i % 5 == 0 else int(i % 4 == 0) for i in range(1200)]
    tracemalloc.start()
    model = toxicity.train(texts, told)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6
    assert ((model.score(texts) >= 0.7) == [i % 4 == 0 for i in range(1200)]).all()


def test_presence_of_texts_over_several_lots():
    texts = [words(300, 1), None, "", words(4, 2), "again " + words(900, 3) + " again", "aa ab aa"]
    every = np.ones(1 << toxicity.BITS, bool)
    want = toxicity.presence(texts, every)
    for limit in (1, 50, 3000):
        assert all((a == b).all() and len(a) == len(b) for a, b in zip(toxicity.presence(texts, every, limit), want))
    y = np.array([1, 0, np.nan, 1, 0, np.nan])
    row, slot = want
    for got, v in zip(toxicity.class_counts(texts, y, 50), (1, 0)):
        assert (got == np.bincount(slot, y[row] == v, 1 << toxicity.BITS)).all()


def test_language_scoring_holds_a_slice_of_features(monkeypatch):
    crf = language_id.train([words(300, i) for i in range(4)] + ["qrst uvwx yzqr stuv " * 80] * 4, ["a"] * 4 + ["b"] * 4)
    texts = [words(400, i) for i in range(500)] + [None, "", "qrst " * 3000]
    tracemalloc.start()
    names, score, share = language_id.classify(crf, texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30e6
    buf, starts, ends, _ = textbuf.words([t or "" for t in texts])
    whole = crf.emissions(*language_id.features(buf, starts, ends))
    for size in (7, 1000):
        monkeypatch.setattr(language_id, "SLICE", size)
        assert (crf.scores(buf, starts, ends) == whole).all()
    assert names[-1] == "b" and names[-2] == "und"


def grown(links):
    comp = list(range(150))
    for _ in range(150):
        for a, b in links:
            comp[a // 2] = comp[b // 2] = min(comp[a // 2], comp[b // 2])
    return comp


def test_open_lists_make_no_row_a_pair(spark, monkeypatch):
    r = random.Random(4)
    base = words(60, 21)
    texts = [near(base, r, r.randint(1, 6)) for _ in range(300)]
    sets = ngram_join.shingle_sets([t.encode() for t in texts])
    want = {(a, b) for a, b in itertools.combinations(range(300), 2) if 100 * (i := len(np.intersect1d(sets[a], sets[b]))) >= 75 * (len(sets[a]) + len(sets[b]) - i)}
    one = spark.createDataFrame([(i, len(s), s.view(np.int64).tolist()) for i, s in enumerate(sets)], "id long, n int, items array<long>")
    lists = one.selectExpr("explode(array(7L, 9L)) as key", "id", "n", "1 as flags", "id div 2 as component")
    made, write = Counter(), ngram_join.materialize

    def counted(df, name):
        out = write(df, name)
        made[name] += out.count()
        return out

    monkeypatch.setattr(ngram_join, "materialize", counted)
    for least, blocks in ((512, 1), ((1 << 20) // 70, 6)):
        monkeypatch.setattr(ngram_join, "LEAST", least)
        made.clear()
        got = {(x.a, x.b) for x in ngram_join._open_links(lists, one, 75, 100).collect()}
        assert got <= want and grown(got) == grown(want) and len(set(grown(want))) > 1
        assert made["join-partners"] <= 2 * 300 * blocks and len(want) > 700 and len(got) <= 150 * blocks**2


def test_join_near_the_threshold(spark, monkeypatch):
    r = random.Random(6)
    base = words(60, 22)
    texts = [near(base, r, r.randint(0, 5)) for _ in range(200)] + [None, ""]
    monkeypatch.setattr(ngram_join, "LEAST", 1 << 14)
    got = {d.doc_id: (d.n_shingles, d.component_id) for d in ngram_join.similar_groups(docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_groups(texts)
    assert len({c for _, c in got.values()}) > 20


def test_pipeline_hands_small_batches_to_workers(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    df = docs(spark, ["x" * 10_000 + str(i) for i in range(2000)], clash=False).coalesce(1)
    before = spark.conf.get(key, None)
    try:
        for name in ("language", "near_duplicates", "pieces"):
            spark.conf.unset(key)
            dict(corpus_pipeline.STAGES)[name](spark, df.limit(0), "")
            got = df.mapInArrow(lambda bs: (pa.RecordBatch.from_pydict({"n": [b.num_rows], "size": [b.nbytes]}) for b in bs), "n long, size long").collect()
            assert sum(r.n for r in got) == 2000 and max(r.size for r in got) < 1.5 * common.BATCH_BYTES
        spark.conf.set(key, "1000000")
        common.small_batches(spark)
        assert spark.conf.get(key) == "1000000"
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def test_hashing_holds_a_piece_at_a_time(monkeypatch):
    texts = [words(300, i).encode() for i in range(1500)] + [words(150_000, 2).encode(), None, b"", b"one two"]
    for powers in ("up", "down"):
        monkeypatch.setattr(ngram_join._Powers, powers, np.ones(1, np.uint64))
    tracemalloc.start()
    want = ngram_join.shingle_sets(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 35e6
    for piece in (5000, 1 << 20):
        monkeypatch.setattr(ngram_join, "_PIECE", piece)
        assert all((a == b).all() and len(a) == len(b) for a, b in zip(ngram_join.shingle_sets(texts), want))


def test_encoder_forgets_blocks():
    enc, small = pieces.Encoder(pieces.MODEL, 4), pieces.Encoder(pieces.MODEL, 4, keep=10)
    most = 0
    for i in range(9):
        texts = [" ".join(f"q{k * 7919 % 999_983}" for k in range(i * 20_000, (i + 1) * 20_000)), words(30, i), words(30, 0)]
        got = enc.encode(texts)
        most = max(most, len(enc.index))
        assert all((a[0] == b[0]).all() and a[1] == b[1] for a, b in zip(got, small.encode(texts)))
    assert 100_000 < most < 125_000


def test_bitmaps_rule_out_no_link():
    r = random.Random(8)
    texts = [near(words(n, 30 + n), r, r.randint(0, n // 8)) for n in (12, 40, 58, 60, 66, 120, 400) for _ in range(12)]
    sets = ngram_join.shingle_sets([t.encode() for t in texts])
    n, every = np.array([len(s) for s in sets]), np.arange(len(sets))
    first, second = every[::2], every[r.sample(range(len(sets)), len(sets))]
    inter = ngram_join._common(sets, first, second)
    link = inter * 100 >= (n[first][:, None] + n[second] - inter) * 75
    asked = np.random.default_rng(5).random(link.shape) < 0.9
    got = ngram_join._left_by_bits(asked, first, second, n, [ngram_join._bitmap(s).view(np.uint64) for s in sets], 75, 100)
    assert not (got & ~asked).any() and got[link & asked].all() and got.sum() < 2 * (link & asked).sum() < asked.sum()


def test_sets_move_only_for_texts_with_a_likely_partner(spark, monkeypatch):
    r = random.Random(9)
    passage = words(60, 23)
    texts = [words(40, 500 + i) + " " + passage for i in range(200)]
    texts += [near(t, r, 1) for t in texts[:5]]
    made, write = Counter(), ngram_join.materialize

    def counted(df, name):
        out = write(df, name)
        made[name] += out.count()
        return out

    monkeypatch.setattr(ngram_join, "materialize", counted)
    monkeypatch.setattr(ngram_join, "HEAVY_MOST", 0)  # as if more frequent shingles came before those of the passage
    got = {d.doc_id: (d.n_shingles, d.component_id) for d in ngram_join.similar_groups(docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_groups(texts)
    assert made["join-partners"] > 500 and made["join-near"] < 50 and made["join-sets"] < 50


def test_likely_links_of_many_lists_are_compared_once(spark, monkeypatch):
    r = random.Random(10)
    texts = [near(base, r, r.randint(0, 2)) for base in (words(70, 600 + i) + " " + words(40, 24) for i in range(40)) for _ in range(4)]
    sets = ngram_join.shingle_sets([t.encode() for t in texts])
    want = {(a, b) for a, b in itertools.combinations(range(160), 2) if 100 * (i := len(np.intersect1d(sets[a], sets[b]))) >= 75 * (len(sets[a]) + len(sets[b]) - i)}
    one = spark.createDataFrame([(i, len(s), s.view(np.int64).tolist(), ngram_join._bitmap(s).tolist()) for i, s in enumerate(sets)], "id long, n int, items array<long>, bits array<long>")
    lists = one.selectExpr("explode(sequence(1L, 20L)) as key", "id", "n", "1 as flags", "id div 2 as component")
    made, write = [], ngram_join.materialize

    def counted(df, name):
        out = write(df, name)
        made.append((name, out.count()))
        return out

    monkeypatch.setattr(ngram_join, "materialize", counted)
    got = {(x.a, x.b) for x in ngram_join._open_links(lists, one.select("id", "n", "items"), 75, 100, one.select("id", "n", "bits")).collect()}
    assert got <= want and grown(got) == grown(want) and len(set(grown(want)[:160:4])) > 30
    near_ = [n for name, n in made if name == "join-near"]
    assert near_[0] > 2000 and near_[-1] < 100
