"""The registry: oracles have queries, and some queries match them."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "embeddings documents pages benchmark labels conversations".split()
SOME = ["v_l2sq_u8", "v_neg_ip_i4", "v_matmul", "v_quantize_u4", "exact_knn_u8", "exact_knn_u8_sql", "exact_knn_mips", "rerank_u4_f32", "recall_ties", "merged_edges", "ivf_assign", "ivf_probe_partial", "pq_adc", "kmeans_step", "batch_ranges", "graph_search_codes_rerank", "graph_search_quality"]


def plain(v):
    return round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", SOME)
def test_oracle(spark, name):
    got = entry.queries()[name](spark, DATA)
    cols = sorted(got.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in got.collect())
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = con.execute(f"select {', '.join(cols)} from ({entry.oracle_sql()[name]})").fetchall()
    assert got == sorted(tuple(map(plain, r)) for r in want)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_flagship(spark):
    assert entry.entry(spark).count() == 50
