"""Odd tables through the registered queries and stages: nulls, repeats, ties, clashes, long texts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vectide.llm import common, decontaminate, language_id, line_dedup, pieces, registry, toxicity

from .helpers import SCHEMA, docs, odd_texts, words

ODD_NAMES = ["gone_id", "gone_lines", "n_lines", "n_removed", "lang_pred", "lang_score", "decoded", "component_id", "a`b", "id", "h", "t", "_bucket", "_map"]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """All tables with odd rows: repeated ids and texts, clashing columns."""
    folder = str(tmp_path_factory.mktemp("odd"))
    texts = odd_texts() + [words(30, 5), words(30, 5), "zz " * 3 + words(20, 6)]
    rows = [(i, t, "en" if i % 2 else None, None, None) for i, t in enumerate(texts)] + [(6, texts[6], "en", "s", 1)] * 2
    table = spark.createDataFrame(rows, SCHEMA)
    table.select("*", *[F.lit(1).alias(c) for c in ODD_NAMES]).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(0, words(30, 5)), (1, None), (0, words(30, 5)), (2, "short")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, 1, i % 3 == 0) for i in range(20)] + [(1, None, None)], "doc_id long, quality int, toxic boolean").withColumn("toxic", F.col("toxic").cast("int")).write.parquet(f"{folder}/labels.parquet")
    pages = [(i, None if i % 5 == 0 else f"http://a/{i}", t) for i, t in enumerate(texts)]
    spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("x")).write.parquet(f"{folder}/pages.parquet")
    return folder, len(rows), len(texts)


@pytest.mark.parametrize("name", [k for k in registry.queries() if k != "op5_line_dedup_every"])
def test_queries_on_odd_tables(spark, sf, name):
    folder, rows, pages = sf
    got = registry.queries()[name](spark, folder).toPandas()
    assert len(got) == (pages if name.startswith("op1_") else rows)
    same = got[got[got.columns[0]] == 6].astype(str).drop_duplicates()
    assert len(same) == 1  # rows that repeat get the same answer
    if "held_out" in got:
        assert got.held_out.tolist() == [language_id.crc_held_out(int(i)) for i in got.doc_id] and got.score.between(0, 1).all()
    if "predicted" in got:
        assert (got.predicted == (got.score >= 0.7)).all()


def test_stages_on_odd_tables(spark, sf):
    got = spark.read.parquet(f"{sf[0]}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        names = got.columns
        got = stage(spark, got, sf[0])
        assert got.columns == names and got.collect()
    assert corpus_pipeline.pieces(spark, got, sf[0]).collect()


def test_clashing_columns(spark):
    table = docs(spark, odd_texts(), clash=False).select("*", *[F.lit(7).alias(c) for c in ODD_NAMES])
    got = line_dedup.line_dedup(table)
    assert [c for c in got.columns if c not in ("n_lines", "n_removed")] == [c for c in table.columns if c not in ("n_lines", "n_removed")]
    assert {r.gone_id for r in got.collect()} == {7}
    assert language_id.identify(table).count() == len(odd_texts())
    coded = pieces.decode_ids(pieces.encode(table))
    assert all(r.decoded == r.text for r in coded.collect() if r.text is not None and r.text == r.text.strip("\x00"))


def test_decontamination_without_broadcast(spark, monkeypatch):
    texts = odd_texts() + [words(10, i) + " " + words(30, 5) for i in range(5)]
    items = spark.createDataFrame([(0, words(30, 5)), (1, words(40, 4)), (2, None)], "item_id long, text string")
    read = lambda: sorted(map(str, decontaminate.leaking_documents(docs(spark, texts), items).collect()))
    want = read()
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    assert read() == want and len(want) == 7


def test_label_model_posterior():
    rng = np.random.default_rng(3)
    y = (rng.random(600) < 0.4).astype(float)
    fire = np.array([[0.05, 0.1, 0.2, 0.02, 0.9], [0.7, 0.6, 0.8, 0.5, 0.2]])
    votes = (rng.random((600, 5)) < fire[y.astype(int)]).astype(float)
    votes[:, 2] = ~votes[:, [0, 1, 3]].any(1)  # silence
    told = y.copy()
    told[200:] = np.nan
    model = toxicity.fit_label_model(votes, told)
    got = model.posterior(votes)
    for i in range(0, 600, 37):  # every voter's factor, one by one
        like = []
        for c in (0, 1):
            p = model.prior if c else 1 - model.prior
            for v in range(5):
                if votes[i, v]:
                    state = int(votes[i, model.parent[v]]) if model.parent[v] >= 0 else 0
                    p *= model.rate[c, state, v]
            like.append(p)
        assert abs(got[i] - like[1] / sum(like)) < 1e-9
    assert ((got >= 0.5) == (y == 1)).mean() > 0.85
    flipped = toxicity.fit_label_model(votes, np.where(np.arange(600) == 5, 1 - told, told)).posterior(votes)
    assert abs(flipped[5] - got[5]) < 0.1  # a text's own label is no vote


def test_chains_cover_long_texts():
    crf = language_id.train([words(300, i) for i in range(4)] + ["qrst uvwx yzqr stuv " * 80] * 4, ["a"] * 4 + ["b"] * 4)
    long = words(3000, 9) + " " + "qrst uvwx yzqr stuv " * 800
    names, score, share = language_id.classify(crf, [long, None, "", words(50, 3)])
    assert names == ["b", "und", "und", "a"] and abs(share[0].sum() - 1) < 1e-4 and 0.45 < score[0] < 0.6
