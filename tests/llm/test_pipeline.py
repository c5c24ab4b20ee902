"""Every stage of the pipeline on its own input against a brute-force version."""

import random

import corpus_pipeline
from tests.llm.helpers import docs, odd_texts, words
from tests.llm.test_dedup import brute_groups, brute_lines
from tests.llm.test_text import brute_leaks


def test_stages(spark, tmp_path):
    r = random.Random(12)
    bench = [words(30, 40 + i) for i in range(5)]
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    lines = [words(10, 90 + i) for i in range(10)]
    texts = [words(r.randint(20, 80), 100 + i) + "\n" + r.choice(lines) + "\n" + words(30, 300 + i) for i in range(40)]
    texts += [t + " changed" for t in texts[:5]] + texts[5:8] + [words(20, 500) + " " + bench[2] + " " + words(9, 501)] + [t for t in odd_texts() if not t or len(t) < 3000]
    df = docs(spark, texts, clash=False)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    now = df
    for name, stage in corpus_pipeline.STAGES:
        before = {x.doc_id: x.text for x in now.collect()}
        ids = sorted(before)
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "pieces":
            assert out.columns == df.columns
            after = {x.doc_id: x.text for x in out.collect()}
        if name == "language":
            assert all(after[i] == before[i] for i in after) and len(after) < len(before)
            assert all(i in after for i in ids if before[i] in texts[:40])
            assert not any(i in after for i in ids if not before[i] or not any(c.isalpha() for c in before[i]))
        elif name == "lines":
            want = dict(zip(ids, brute_lines([before[i] for i in ids])))
            assert after == {i: t for i, t in want.items() if t == before[i] or t.strip(" ")}
        elif name == "near_duplicates":
            got = brute_groups([before[i] for i in ids])
            assert sorted(after) == [i for k, i in enumerate(ids) if got[k][1] == k]
        elif name == "benchmark":
            leaks = brute_leaks([before[i] for i in ids], bench)
            assert sorted(after) == [i for k, i in enumerate(ids) if k not in leaks] and leaks
        else:
            rows = out.collect()
            assert sorted(x.doc_id for x in rows) == ids and all(x.decoded_ok for x in rows)
        now = out
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == now.count()
    stage = dict(corpus_pipeline.STAGES)
    assert all(f(spark, df.limit(0), str(tmp_path)).count() == 0 for f in stage.values())
