"""Vector functions on hand-made fixtures, and the binary layouts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectide.functions import vector as V
from vectide.sources import formats, vecbin


def one(spark, rows, schema, col):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(col).collect()]


def test_quantize_truncates_and_clamps(spark):
    rows = [([-1.5, -1.0, -1e-9, 0.0, 0.999, 1.0, 2.0],)]
    assert one(spark, rows, "v array<float>", V.quantize("v")) == [[0, 0, 127, 127, 254, 255, 255]]
    assert one(spark, rows, "v array<float>", V.quantize("v", 1, True)) == [[-128, -128, -1, -1, 126, 127, 127]]


def test_nibbles(spark):
    rows = [([0x00, 0x0F, 0xF0, 0xFF, 0x18],)]
    assert one(spark, rows, "b array<int>", V.unpack4("b")) == [[0, 0, 240, 0, 0, 240, 240, 240, 128, 16]]
    assert one(spark, rows, "b array<int>", V.unpack4("b", True)) == [[0, 0, -16, 0, 0, -16, -16, -16, -128, 16]]
    assert one(spark, [([0x12, 0xAB, 0x34],)], "b array<int>", V.u8_to_u4("b")) == [[0xA1]]


def test_distances_and_prune_rules(spark):
    row = [([0.0, 0.0], [3.0, 4.0])]
    schema = "p array<double>, q array<double>"
    assert one(spark, row, schema, V.l2sq("p", "q")) == [25.0]
    assert one(spark, row, schema, V.neg_ip("q", "q")) == [-25.0]
    assert one(spark, row, schema, V.norm("q")) == [5.0]
    nums = [(4.0, 9.0, 1.0, 0.0)]
    schema = "pa double, pb double, ab double, z double"
    assert one(spark, nums, schema, V.cosine_at_p("z", "pb", "ab")) == [1.0]
    assert one(spark, nums, schema, V.cosine_at_p("pa", "pb", "ab")) == [1.0]
    assert one(spark, nums, schema, V.pruned_by_distance("pb", "ab", 1.1)) == [True]
    assert one(spark, nums, schema, V.pruned_by_angle("pa", "pb", "ab", 0.0)) == [False]
    assert one(spark, nums, schema, V.survives_either("pa", "pb", "ab", 10.0, 0.5)) == [True]
    with pytest.raises(ValueError):
        V.distance("p", "q", "cosine")


def test_bytes_out_of_range_raise(spark):
    with pytest.raises(Exception, match="not a byte"):
        one(spark, [([256.0],)], "v array<float>", V.to_u8("v"))


def test_layouts_round_trip(tmp_path):
    x = np.arange(12, dtype=np.float32).reshape(3, 4)
    formats.write_vectors(f"{tmp_path}/a.fbin", x)
    assert (formats.read_vectors(f"{tmp_path}/a.fbin", 1, 1) == x[1:2]).all() and formats.head(f"{tmp_path}/a.fbin") == (3, 4)
    formats.write_fvecs(f"{tmp_path}/a.fvecs", x)
    formats.fvecs_to_fbin(f"{tmp_path}/a.fvecs", f"{tmp_path}/b.fbin")
    assert (formats.read_vectors(f"{tmp_path}/b.fbin") == x).all()
    ids = np.array([[1, 2], [3, 4]])
    formats.write_truth(f"{tmp_path}/t", ids, ids * 0.5)
    got = formats.read_truth(f"{tmp_path}/t")
    assert (got[0] == ids).all() and (got[1] == ids * 0.5).all()
    formats.write_truth(f"{tmp_path}/t2", ids)
    assert formats.read_truth(f"{tmp_path}/t2")[1] is None
    formats.write_matrix(f"{tmp_path}/m", x, np.ones(3))
    m, b = formats.read_matrix(f"{tmp_path}/m")
    assert (m == x).all() and (b == 1).all()
    lists = [[1, 2], [], [0]]
    same = lambda got: [list(map(int, g)) for g in got] == lists
    formats.write_graph(f"{tmp_path}/g", lists, 4)
    assert same(formats.read_graph(f"{tmp_path}/g")[0])
    with pytest.raises(ValueError):
        formats.write_graph(f"{tmp_path}/g", lists, 1)
    formats.write_nested(f"{tmp_path}/n", iter(lists))
    assert same(formats.read_nested(f"{tmp_path}/n"))
    formats.write_csr(f"{tmp_path}/c", lists)
    assert same(formats.read_csr(f"{tmp_path}/c"))
    formats.write_csr_vectors(f"{tmp_path}/cv", lists, x)
    got = formats.read_csr_vectors(f"{tmp_path}/cv", only=[0, 2])
    assert list(got[0][0]) == [1, 2] and (got[0][1] == x[1:3]).all() and (got[2][1] == x[:1]).all()
    formats.write_hierarchy(f"{tmp_path}/h", np.array([-1, 0, -3]), 2)
    assert list(formats.read_hierarchy(f"{tmp_path}/h")[0]) == [-1, 0, -3]
    formats.write_ids(f"{tmp_path}/i", [7, 9])
    assert list(formats.read_ids(f"{tmp_path}/i")) == [7, 9]
    with pytest.raises(ValueError):
        formats.dtype_of("x.unknown")


def test_data_source(spark, tmp_path):
    vecbin.register(spark)
    df = spark.createDataFrame([(i, [float(i), 2.0]) for i in range(10)], "id long, vec array<float>").repartition(3)
    df.write.format("vecbin").mode("append").option("type", "fbin").save(f"{tmp_path}/out")
    back = spark.read.format("vecbin").option("rowsPerPartition", "2").load(f"{tmp_path}/out")
    assert sorted(map(tuple, ((r.id, tuple(r.vec)) for r in back.collect()))) == [(i, (float(i), 2.0)) for i in range(10)]
    np.save(f"{tmp_path}/x.npy", np.eye(2))
    assert vecbin.read_npy(spark, f"{tmp_path}/x.npy").select("vec").collect()[1][0] == [0.0, 1.0]
    codes = np.array([[0x18, 0xF0]], np.uint8)
    formats.write_vectors(f"{tmp_path}/c.i4bin", codes)
    assert spark.read.format("vecbin").load(f"{tmp_path}/c.i4bin").first().vec == [-128.0, 16.0, 0.0, -16.0]
    vecbin.append_report(back.select("id"), f"{tmp_path}/report")
    vecbin.append_report(back.select("id"), f"{tmp_path}/report")
    assert spark.read.option("header", True).csv(f"{tmp_path}/report").count() == 20
    assert vecbin.gather(back, [1, 3]).count() == 2
    assert F is not None


@pytest.mark.parametrize("kind,values", [("u4bin", [[0, 16, 240, 32], [48, 0, 16, 224]]), ("i4bin", [[0, 16, -128, 112], [-16, 0, 32, -32]]), ("fbin", [[0.5, 1.0, -2.0, 3.0]] * 2)])
def test_vecbin_round_trip_and_overwrite(spark, tmp_path, kind, values):
    vecbin.register(spark)
    path = str(tmp_path / kind)
    for shift in (10, 20):
        df = spark.createDataFrame([(i + shift, [float(v) for v in row]) for i, row in enumerate(values)], "id long, vec array<float>").coalesce(1)
        df.write.format("vecbin").option("type", kind).mode("overwrite").save(path)
    got = sorted((r.id, r.vec) for r in spark.read.format("vecbin").load(path).collect())
    assert got == [(i + 20, [float(v) for v in row]) for i, row in enumerate(values)]
