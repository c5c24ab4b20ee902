"""Recall, query statistics and the throughput report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Recall levels of the report, fixed values.
LEVELS = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.75, 0.8, 0.85, 0.9, 0.93, 0.95, 0.97, 0.98, 0.99, 0.995, 0.999, 0.9995, 0.9999, 0.99995, 0.99999)
#: Beam widths and visit limits of the search sweep, fixed values.
BEAMS = (10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20, 22, 24, 26, 28, 30, 32, 34, 36, 38, 40, 45, 50, 55, 60, 65, 70, 80, 90, 100, 120, 140, 160, 180, 200, 225, 250, 275, 300, 375, 500, 750, 1000)
LIMITS = (10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20, 21, 22, 23, 24, 25, 26, 28, 30, 35)


def recall(results: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """Tie-aware recall of the first k results: one row (queries, hits, recall).

    A truth counts if it is among the k nearest or ties with the k-th; hits are divided by k
    times the number of queries in the truth.
    """
    order = Window.partitionBy("qid").orderBy("dist", "id")
    bar = truth.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).groupBy("qid").agg(F.max("dist").alias("bar"))
    wide = truth.join(bar, "qid").where("dist <= bar").select("qid", "id").distinct()
    hits = results.where(F.col("rnk") <= k).select("qid", "id").join(wide, ["qid", "id"], "left_semi").agg(F.count("*").alias("hits"))
    return bar.agg(F.count("*").alias("queries")).join(hits).select("queries", "hits", F.when(F.col("queries") > 0, F.col("hits") / (F.col("queries") * k)).otherwise(F.lit(0.0)).alias("recall"))


def recall_at(results: DataFrame, truth: DataFrame, k: int, n: int) -> DataFrame:
    """Share of the first k truths that are in the first n results: (k, n, hits, recall)."""
    t = truth.where(F.col("rnk") <= k).select("qid", "id")
    got = t.join(results.where(F.col("rnk") <= n).select("qid", "id").withColumn("hit", F.lit(1)), ["qid", "id"], "left")
    return got.agg(F.count("hit").alias("hits"), F.count("*").alias("all")).select(F.lit(k).alias("k"), F.lit(n).alias("n"), "hits", F.when(F.col("all") > 0, F.col("hits") / F.col("all")).otherwise(F.lit(0.0)).alias("recall"))


def statistics(counters: DataFrame, column: str) -> DataFrame:
    """Mean (whole number), 99th percentile by position and population deviation of a counter.

    The percentile is the value at 0-based position floor(0.99 n) of the sorted column, found
    from counts per value, so no task collects the column.
    """
    per = counters.groupBy(F.col(column).alias("x")).agg(F.count("*").alias("c"))
    total = counters.agg(F.count("*").alias("n"), F.floor(F.avg(column)).cast("long").alias("avg"), F.stddev_pop(column).alias("std"))
    upto = per.withColumn("upto", F.sum("c").over(Window.orderBy("x").rowsBetween(Window.unboundedPreceding, 0)))
    tail = upto.join(total).where(F.col("upto") > F.floor(F.col("n") * 0.99)).agg(F.min("x").alias("tail"))
    return total.join(tail).select("avg", "tail", "std")


def degree_stats(graph: DataFrame) -> DataFrame:
    """(nodes, edges, avg_degree, max_degree) of a graph (id, nbrs)."""
    n = F.size("nbrs")
    return graph.agg(F.count("*").alias("nodes"), F.sum(n).cast("long").alias("edges"), F.avg(n).alias("avg_degree"), F.max(n).cast("long").alias("max_degree"))


def popularity(visits: DataFrame, nodes: DataFrame) -> DataFrame:
    """log(1 + visits) of every node from rows (id) of visits: (id, visits, pop)."""
    c = visits.groupBy("id").agg(F.count("*").alias("v"))
    return nodes.select("id").join(c, "id", "left").select("id", F.coalesce("v", F.lit(0)).cast("long").alias("visits"), F.log1p(F.coalesce("v", F.lit(0)).cast("double")).alias("pop"))


def weighted_degree(graph: DataFrame, pops: DataFrame) -> DataFrame:
    """Mean degree weighted by popularity."""
    j = graph.join(pops, "id")
    return j.agg((F.sum(F.size("nbrs") * F.col("pop")) / F.sum("pop")).alias("weighted_degree"))


def bucket_report(runs: DataFrame, levels: tuple = LEVELS) -> DataFrame:
    """Per recall bucket the run of most throughput: the bucket's level and the run's columns; the last is open."""
    spark = runs.sparkSession
    edges = [(i, float(lo), float(levels[i + 1]) if i + 1 < len(levels) else 2.0) for i, lo in enumerate(levels)]
    buckets = F.broadcast(spark.createDataFrame(edges, "bucket int, lo double, hi double"))
    j = runs.join(buckets, (runs.recall >= buckets.lo) & (runs.recall <= buckets.hi))
    best = Window.partitionBy("bucket").orderBy(F.desc("qps"), "beam")
    return j.withColumn("r", F.row_number().over(best)).where("r = 1").drop("r", "hi").withColumnRenamed("lo", "level")
