"""PII, language, pieces, toxicity, decontamination and WARC."""

import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from vectide.llm import decontaminate, language_id, pieces, pii, toxicity, warc

from .helpers import docs, empty, odd_texts, words

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        s += x - 9 if x > 9 else x
    return s % 10 == 0


def brute_pii(t):
    out = []
    for n, (k, p) in enumerate(BASE.items()):
        for m in re.finditer(p, t or "", re.ASCII):
            g, d = m.group(), re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": k == "ip" and all(int(x) <= 255 for x in g.split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[k]
            if ok:
                out.append((m.start(), n, k, m.end()))
    return [(k, s, e) for s, _, k, e in sorted(out)]


def test_pii_matches_brute_force(spark):
    r = random.Random(4)
    bits = ["a.b@c.d", "@x.y", "a@b", "x@y.z_q@r.s", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "010.0.0.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-9999", "+12", "+4 4 4", "é", "日", " ", "\n", ".", "-", "0", "12", "word", "+44 20 7946 0958.", "user@mail.example.com."]
    texts = ["".join(r.choice(bits) + r.choice(["", " ", "", "."]) for _ in range(r.randint(0, 12))) for _ in range(400)] + odd_texts() + ["a" * 3000 + "@b.c", "1" * 3000, "1." * 2000 + "1", "a@" + "b." * 5000 + "c"]
    got = {x.doc_id: x for x in pii.find_pii(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert [(s["kind"], s["start"], s["end"]) for s in got[i].base] == brute_pii(t), t[:200]
    assert pii.find_pii(empty(spark)).count() == 0


def test_pii_contexts(spark):
    texts = [f"hello my contact address: user{i}@mail.example.com bye" for i in range(12)] + ["and contact address: zed-at-7-example bye", "some other words: zed-at-9-example bye"]
    got = {x.doc_id: x["all"] for x in pii.find_pii(docs(spark, texts)).collect()}
    extra = {i: [(s["kind"], texts[i][s["start"] : s["end"]]) for s in v if s["kind"].startswith("ctx_")] for i, v in got.items()}
    assert extra[12] == [("ctx_email", "zed-at-7-example")] and not extra[13] and not extra[0]


def language_docs(spark):
    alphabets = {"aa": "abcde", "bb": "defgh", "cc": "ghijk"}
    r = random.Random(6)
    rows = []
    for i in range(300):
        lang = r.choice(list(alphabets))
        rows.append((i, " ".join("".join(r.choice(alphabets[lang]) for _ in range(r.randint(2, 6))) for _ in range(30)), lang))
    return rows


def test_language(spark):
    rows = language_docs(spark)
    rows += [(1000 + i, t, None) for i, t in enumerate(odd_texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x.doc_id: x for x in language_id.identify(df).collect()}
    test = [r for r in rows if r[2] and language_id.crc_held_out(r[0])]
    assert sum(got[i].lang_pred == lang for i, _, lang in test) >= 0.95 * len(test)
    for i, t, _ in rows[300:]:
        none = not t or not any(c.isalpha() for c in t)
        assert (got[i].lang_pred == "und") == none and 0 <= got[i].lang_score <= 1
    held = {x.doc_id: x.h for x in df.select("doc_id", language_id.held_out("doc_id").alias("h")).collect()}
    assert all(held[r[0]] == language_id.crc_held_out(r[0]) for r in rows)
    blank = df.withColumn("lang", F.lit(None).cast("string"))
    assert {x.lang_pred for x in language_id.identify(blank).collect()} == {"und"}
    assert language_id.identify(df.limit(0)).count() == 0


def test_forward_backward_is_exact():
    import numpy as np

    rng = np.random.default_rng(0)
    crf = language_id.Crf(["a", "b", "c"])
    crf.a[:] = rng.normal(size=(3, 3))
    e = rng.normal(size=(4, 2, 3)).astype(np.float32)
    on = np.array([[True, True], [True, True], [True, True], [True, False]])
    post = crf.posteriors(e, on)
    for c, steps in ((0, 4), (1, 3)):
        total = np.zeros((steps, 3))
        for path in itertools.product(range(3), repeat=steps):
            w = np.exp(sum(e[i, c, y] for i, y in enumerate(path)) + sum(crf.a[x, y] for x, y in zip(path, path[1:])))
            for i, y in enumerate(path):
                total[i, y] += w
        assert np.allclose(post[:steps, c], total / total.sum(1, keepdims=True), atol=1e-4)


def all_paths(v, text):
    if not text:
        return [(0.0, [])]
    out = []
    for end in range(1, len(text) + 1):
        i = v.ids.get(text[:end])
        if i is None and end > 1:
            continue
        score = v.score[i] if i is not None else v.unknown
        ids = [i] if i is not None else v.bytes_id[list(text[:1].encode())].tolist()
        out += [(score + s, ids + p) for s, p in all_paths(v, text[end:])]
    return out


def test_nbest_is_exact():
    v = pieces.vocabulary(pieces.MODEL)
    for text in (" the cat", " a  b", "ñandú", " x▁y", "  ", "\n", " aaa"):
        want = sorted(s for s, _ in all_paths(v, text))[::-1][:6]
        got = pieces.nbest_block(v, text, 6)
        assert [s for s, _ in got] == want and len({tuple(p) for _, p in got}) == len(got)
    enc = pieces.Encoder(pieces.MODEL, 5)
    for text in ("the cat sat", "a  b", "ab\ncd", "▁x", "é 日本"):
        (ids, nbest), = enc.encode([text])
        want = sorted(s for s, _ in all_paths(v, " " + text))[::-1][:5]
        assert [s for s, _ in nbest] == want and pieces.decode(v, ids.tolist()) == text
        paths = set()
        for score, edits in nbest:
            out, at = [], 0
            for first, drop, new in edits:
                out += ids[at:first].tolist() + new
                at = first + drop
            out += ids[at:].tolist()
            assert pieces.decode(v, out) == text
            paths.add(tuple(out))
        assert len(paths) == len(nbest)


def test_pieces_round_trip(spark):
    texts = odd_texts() + ["😀 ퟿ x", "\x00\x01", "  lead", "trail  ", "a" * 30 + "b" * 40]
    got = pieces.encode(docs(spark, texts))
    back = {x.doc_id: x for x in pieces.decode_ids(got).collect()}
    for i, t in enumerate(texts):
        assert back[i].decoded == t and (back[i].decoded_ok is None) == (t is None)
    assert pieces.encode(empty(spark)).count() == 0


def test_toxicity(spark):
    r = random.Random(8)
    rows, marks = [], []
    for i in range(500):
        bad = r.random() < 0.3
        text = words(60, 5000 + i).split(" ")
        if bad:
            for _ in range(3):
                text[r.randrange(60)] = r.choice(["zzidiot", "zzmoron", "vequ" + words(1, i), "vequ" + words(1, i + 7)])
        rows.append((i, " ".join(text)))
        marks.append((i, int(bad)))
    rows += [(1000 + i, t) for i, t in enumerate(odd_texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([*marks, (1, None), (3, 0)], "doc_id long, toxic int")
    got = {x.doc_id: x.score for x in toxicity.score_toxicity(df, labels).collect()}
    test = [(i, y) for i, y in marks if language_id.crc_held_out(i)]
    assert sum((got[i] >= 0.7) == (y == 1) for i, y in test) >= 0.95 * len(test)
    assert all(0 <= s <= 1 for s in got.values()) and len(got) == len(rows) and got[1000] < 0.5
    assert {x.score < 1e-20 for x in toxicity.score_toxicity(df, labels.limit(0)).collect()} == {True}
    assert toxicity.score_toxicity(df.limit(0), labels).count() == 0


def test_masks_lose_no_leak():
    w, k = decontaminate.WINDOW, decontaminate.MISMATCHES
    for n in range(k + 1):
        for bad in itertools.combinations(range(w), n):
            assert any(all(o + c not in bad for c in m) for m in decontaminate.MASKS for o in range(w - max(m)))


def brute_leaks(texts, items):
    tok = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = {}
    for d, t in enumerate(texts):
        a = tok(t)
        for i, item in enumerate(items):
            b = tok(item)
            if len(b) < 13:
                continue
            for g in range(-len(b), len(a) + 1):
                same = [0 <= g + j < len(a) and a[g + j] == b[j] for j in range(len(b))]
                if any(sum(same[s : s + 13]) >= 11 for s in range(len(b) - 12)):
                    out.setdefault(d, set()).add(i)
    return out


def test_leaks(spark):
    r = random.Random(9)
    items = [words(r.randint(8, 40), 600 + i) for i in range(12)] + [None, ""]
    texts = []
    for i in range(60):
        b = r.choice(items[:12]).split(" ")
        lo = r.randint(0, 5)
        part = b[lo : lo + r.randint(8, 30)]
        for _ in range(r.randint(0, 4)):
            part[r.randrange(len(part))] = "sub"
        texts.append((words(r.randint(0, 20), 700 + i) + " " + " ".join(part).upper() + ", " + words(r.randint(0, 20), 800 + i)).strip())
    texts += [t for t in odd_texts() if not t or len(t) < 2000]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {x.id: set(x["items"]) for x in decontaminate.leaking_documents(docs(spark, texts), bench).collect()}
    want = brute_leaks(texts, items)
    assert got == want and want
    assert decontaminate.leaking_documents(empty(spark), bench).count() == 0
    assert decontaminate.leaking_documents(docs(spark, texts), bench.limit(0)).count() == 0


@pytest.mark.parametrize("chunk", [7, 1 << 18])
def test_warc(spark, tmp_path, chunk):
    htmls = [t for t in odd_texts() if t is None or len(t) < 3000] + [words(200, 1), words(200, 1), "é" * 60, "é" * 60, "x" * 99, "x" * 99]
    rows = [(i, [None, "http://a.b/\r\nx y", "http://c"][i % 3], h) for i, h in enumerate(htmls)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("id", F.lit(1)).withColumn("digest", F.lit("x"))
    manifest = warc.write_archives(pages, str(tmp_path / "w"))
    assert manifest.agg(F.sum("records")).first()[0] == len(rows)
    table = warc.read_archives(manifest, str(tmp_path / "w"), chunk).collect()
    data = {}
    for r in sorted(table, key=lambda r: (r.record_id, r.chunk_no)):
        data.setdefault(r.record_id, []).append(r)
        assert len(r.data) <= chunk
    for i, h in enumerate(htmls):
        body = (h or "").encode()
        first = min(j for j, g in enumerate(htmls) if (g or "").encode() == body)
        last = data[i][-1]
        again = len(body) >= 100 and first != i
        assert (last.bytes_so_far, last.digest_so_far, last.record_type, last.refers_to) == (len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", first if again else None)
        assert again or b"".join(r.data for r in data[i]) == body
    assert warc.read_archives(warc.write_archives(pages.limit(0), str(tmp_path / "e")), str(tmp_path / "e")).count() == 0
