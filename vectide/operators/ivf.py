"""Inverted-file index: centroids, assignment, posting lists, probing, product codes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectide.functions import vector as V
from vectide.operators.exact import CELLS, QUERY_BYTES, Nearest, _blocks, _size, _united, knn_join, matrix, operand, scan, top_k


def sampled(id_col: str, fraction: float) -> Column:
    """A fixed share of ids by their MD5, the same wherever it is evaluated."""
    return F.substring(F.md5(F.col(id_col).cast("string")), 1, 4) < F.lit(f"{round(fraction * 65536):04x}")


def random_centroids(base: DataFrame, fraction: float = 0.16) -> DataFrame:
    """Base rows that serve as centroids: (id, vec)."""
    return base.where(sampled("id", fraction)).select("id", "vec")


def nearest(vectors: DataFrame, centroids: DataFrame, r: int, metric: str = "l2", exact: bool = False, block_bytes: int = QUERY_BYTES) -> DataFrame:
    """The r nearest centroids of every vector: (vec_id, rnk, centroid_id, dist).

    Centroids go to the vectors in blocks of at most block_bytes. With one block, which is
    the usual case, nothing is ranked again.
    """
    got = scan(vectors, centroids, r, metric, exact, block_bytes)
    return got.select(F.col("qid").alias("vec_id"), "rnk", F.col("id").alias("centroid_id"), "dist")


def build(base: DataFrame, centroids: DataFrame, r: int = 16, metric: str = "l2", exact: bool = False, max_size: int | None = None, whole: bool = False) -> DataFrame:
    """Posting lists as rows (centroid_id, vec_id, dist, rnk).

    A centroid's vector goes to its own list only. With max_size a list keeps its nearest
    max_size members besides the vectors for which it is the first choice, so every vector
    stays in at least one list. A centroid with r copies of smaller id among the centroids
    does not rank its own list and is in none; whole puts it in its own as the first.
    """
    got = nearest(base, centroids, r, metric, exact)
    own = centroids.select(F.col("id").alias("vec_id"), F.lit(True).alias("own"))
    rows = got.join(own, "vec_id", "left").where(F.col("own").isNull() | (F.col("vec_id") == F.col("centroid_id"))).select("centroid_id", "vec_id", "dist", "rnk")
    if whole:
        self_ = centroids.select(F.col("id").cast("long").alias("centroid_id"), F.col("id").cast("long").alias("vec_id"), V.distance("vec", "vec", metric, exact).alias("dist"), F.lit(1).alias("rnk"))
        rows = rows.where("vec_id <> centroid_id").unionByName(self_)
    if max_size is None:
        return rows
    w = Window.partitionBy("centroid_id").orderBy("dist", "vec_id")
    return rows.withColumn("place", F.row_number().over(w)).where((F.col("place") <= max_size) | (F.col("rnk") == 1)).drop("place")


def sizes(postings: DataFrame) -> DataFrame:
    """(centroid_id, size)."""
    return postings.groupBy("centroid_id").agg(F.count("*").alias("size"))


def lists(postings: DataFrame) -> DataFrame:
    """(centroid_id, vec_ids) with sorted lists."""
    return postings.groupBy("centroid_id").agg(F.array_sort(F.collect_list("vec_id")).alias("vec_ids"))


def invert(lists_: DataFrame) -> DataFrame:
    """(vec_id, centroid_ids) from (centroid_id, vec_ids)."""
    return lists_.select("centroid_id", F.explode("vec_ids").alias("vec_id")).groupBy("vec_id").agg(F.array_sort(F.collect_list("centroid_id")).alias("centroid_ids"))


def inline(postings: DataFrame, base: DataFrame) -> DataFrame:
    """Posting rows with the member's vector beside the id: (centroid_id, vec_id, vec)."""
    return postings.select("centroid_id", "vec_id").join(base.select(F.col("id").alias("vec_id"), "vec"), "vec_id").select("centroid_id", "vec_id", "vec")


def in_lists(postings: DataFrame, accepted: Column) -> DataFrame:
    """Centroids whose list holds an accepted vec_id, one row a hit."""
    return postings.where(accepted).select("centroid_id", "vec_id")


def split_lists(postings: DataFrame, most: int) -> DataFrame:
    """Lists cut into sublists of about `most` members by a hash: (centroid_id, part, vec_id)."""
    n = F.ceil(F.col("size") / most)
    return postings.join(sizes(postings), "centroid_id").select("centroid_id", F.pmod(F.xxhash64("vec_id"), n).cast("int").alias("part"), "vec_id")


def probe(queries: DataFrame, centroids: DataFrame, inlined: DataFrame, k: int, nprobe: int, metric: str = "l2", exact: bool = False) -> DataFrame:
    """Search the nprobe nearest lists of every query: (qid, rnk, id, dist).

    A vector in several probed lists counts once. All lists probed makes it exact over the
    vectors that are in a list. Queries with the lists they probe go to the lists in blocks
    of QUERY_BYTES; a task keeps k rows a query, and no vector is moved.
    """
    spark = inlined.sparkSession
    lists_ = centroids.count()
    every = nprobe >= lists_  # then the order of the lists does not matter
    queries = queries.select(F.col("id").cast("long"), "vec").persist()
    count, size = _size(queries)
    first = None if every else knn_join(centroids, queries, nprobe, metric, exact).select("qid", F.col("id").alias("centroid_id")).persist()
    kind = "long" if exact else "double"
    parts = []
    for qid, q in _blocks(queries, size + (0 if every else 16 * nprobe * count), QUERY_BYTES):
        pairs = None
        if not every:
            asked = spark.createDataFrame(pa.table({"qid": qid})) if len(qid) < count else None
            got = (first if asked is None else first.join(asked, "qid", "left_semi")).orderBy("centroid_id", "qid").toArrow()
            pairs = got.column(1).to_numpy(), np.searchsorted(qid, got.column(0).to_numpy())
        shared = spark.sparkContext.broadcast((qid, q, pairs))

        def near(batches, shared=shared):
            qid, q, pairs = shared.value
            best = Nearest(qid, operand(q, exact), k, metric, exact)
            step = max(1, min(4096, CELLS // len(qid)))
            for batch in batches:
                for a in range(0, batch.num_rows, step):
                    part = batch.slice(a, step)
                    ids, at, back = np.unique(part.column(1).to_numpy(zero_copy_only=False), return_index=True, return_inverse=True)
                    mask = None
                    if pairs is not None:
                        lists, where = np.unique(part.column(0).to_numpy(zero_copy_only=False), return_inverse=True)
                        of = np.searchsorted(lists, pairs[0])
                        of[of == len(lists)] = 0
                        asks = np.zeros((len(qid), len(lists)), bool)
                        hit = lists[of] == pairs[0]
                        asks[pairs[1][hit], of[hit]] = True
                        mask = np.zeros((len(qid), len(ids)), bool)
                        np.logical_or.at(mask.T, back, asks[:, where].T)
                    b = operand(matrix(part.column(2)), exact)[at]
                    best.add(ids, b, np.einsum("ij,ij->i", b, b), mask)
            yield best.batch().select(["qid", "id", "dist"])

        parts.append(inlined.select(F.col("centroid_id").cast("long"), F.col("vec_id").cast("long"), "vec").mapInArrow(near, f"qid long, id long, dist {kind}"))
    queries.unpersist()
    if first is not None:
        first.unpersist()
    if not parts:
        return spark.createDataFrame([], f"qid long, rnk int, id long, dist {kind}")
    return top_k(_united(parts).dropDuplicates(["qid", "id"]), k)


def codebook(base: DataFrame, chunks: int, words: int) -> DataFrame:
    """Product codebook (chunk, code, word): sub-vectors of the `words` rows of least MD5."""
    rows = base.orderBy(F.md5(F.col("id").cast("string")), "id").limit(words).select("id", "vec")
    coded = rows.withColumn("code", F.row_number().over(Window.orderBy(F.md5(F.col("id").cast("string")), "id")) - 1)
    width = (F.size("vec") / chunks).cast("int")
    return coded.select("code", "vec", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk")).select("chunk", "code", F.slice("vec", F.col("chunk") * width + 1, width).alias("word"))


def pq_encode(base: DataFrame, book: DataFrame, chunks: int) -> DataFrame:
    """Codes of every vector: (id, codes), the nearest word per chunk, the lower code on ties."""
    width = (F.size("vec") / chunks).cast("int")
    sub = base.select("id", "vec", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk")).select("id", "chunk", F.slice("vec", F.col("chunk") * width + 1, width).alias("part"))
    near = sub.join(F.broadcast(book), "chunk").groupBy("id", "chunk").agg(F.min(F.struct(V.l2sq("part", "word").alias("d"), "code")).alias("m"))
    return near.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "m.code"))), lambda s: s["code"]).alias("codes"))


def pq_search(queries: DataFrame, coded: DataFrame, book: DataFrame, chunks: int, k: int) -> DataFrame:
    """Asymmetric distances by lookup tables, the k nearest codes: (qid, rnk, id, dist)."""
    width = (F.size("vec") / chunks).cast("int")
    sub = queries.select(F.col("id").alias("qid"), "vec", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk")).select("qid", "chunk", F.slice("vec", F.col("chunk") * width + 1, width).alias("part"))
    cell = sub.join(F.broadcast(book), "chunk").select("qid", "chunk", "code", V.l2sq("part", "word").alias("d"))
    table = cell.groupBy("qid", "chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("code", "d"))), lambda s: s["d"]).alias("row"))
    table = table.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "row"))), lambda s: s["row"]).alias("lut"))
    dist = F.aggregate(F.zip_with("codes", "lut", lambda c, row: F.element_at(row, c + 1)), F.lit(0.0), lambda a, x: a + x)
    return top_k(coded.join(F.broadcast(table)).select("qid", "id", dist.alias("dist")), k)
