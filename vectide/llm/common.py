"""Shared helpers: shared-folder tables, size-checked joins, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A join side is broadcast only if its measured rows times its row width stay below this.
BROADCAST_BYTES = 24 * 1024 * 1024
#: Bytes of an edge in the size check, and edges a task reads of an exchange while all edges pass it.
EDGE_BYTES, PART_EDGES = 48, 65_536
#: Bytes of rows that Spark hands to a Python worker at a time after small_batches().
BATCH_BYTES = 4 * 1024 * 1024


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir.

    Where the setting is absent in local mode (tests) a temporary folder is set; on a
    cluster the setting must be there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext.getCheckpointDir()
        if current:
            return current
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="vectide-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    Cuts lineage, survives lost executors and lets later steps read single columns.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/vectide/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables of which nothing that is still to run depends."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def fits(df: DataFrame, row_bytes: int | Column, limit: int | None = None) -> bool:
    """Whether df is within the broadcast bound; row_bytes is a row's size, or a column that measures it.

    df should be a materialized table, as it is read for this.
    """
    size = df.count() * row_bytes if isinstance(row_bytes, int) else df.agg(F.sum(row_bytes)).first()[0] or 0
    return size <= (BROADCAST_BYTES if limit is None else limit)


def small_side(df: DataFrame, row_bytes: int | Column, limit: int | None = None) -> DataFrame:
    """Mark df for broadcast if its measured size fits the limit, else leave the choice to Spark."""
    return F.broadcast(df) if fits(df, row_bytes, limit) else df


def maybe_in(df: DataFrame, col: str, ids: DataFrame, yes: bool = True) -> DataFrame:
    """Rows of df whose col may be among the ids (all that are, and some others), or with yes=False the rest.

    ids is a materialized table of one column. What is broadcast is a bitmap of 16 to 32
    bits an id, 16 MB at most: with more than 8 million ids the share of others, else one
    in 16 or less, grows, and nothing else changes.
    """
    bits = min(27, max(15, (16 * ids.count()).bit_length()))
    slot = lambda c: F.shiftrightunsigned(F.xxhash64(c.cast("long")), 64 - bits) + 1
    x = slot(F.col(ids.columns[0]))
    maps = ids.groupBy(F.bitmap_bucket_number(x).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(x)).alias("_map"))
    maps = materialize(maps, "bitmap")
    x = slot(F.col(col))
    at = F.bitmap_bit_position(x)
    byte = F.conv(F.hex(F.substring(F.col("_map"), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce((byte / F.pow(F.lit(2), at % 8)).cast("int") % 2 == 1, F.lit(False))
    return df.join(F.broadcast(maps), F.bitmap_bucket_number(x) == F.col("_bucket"), "left").where(hit if yes else ~hit).drop("_bucket", "_map")


def unused(name: str, taken: list[str]) -> str:
    """A column name that begins like name and clashes with none in taken."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def small_batches(spark: SparkSession) -> None:
    """Let Spark hand rows to Python workers in batches of about BATCH_BYTES; its own bound is 64 MB, or 10,000 rows.

    The JVM and the worker each hold a batch. This is a setting of the session, read when a
    DataFrame runs, so it stays; one that the session has already is left as it is. It decides
    how many rows come at a time, not which.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, BATCH_BYTES)


def release() -> None:
    """Give freed memory of a Python worker back to the system, which it would else keep while idle."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run):
    """run for mapInArrow, followed by release()."""

    def inner(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return inner


def arrow_map(df: DataFrame, run, more: list[T.StructField]) -> DataFrame:
    """df.mapInArrow(run) for a run that appends columns; df's own may have any names, run sees them as c0, c1, ..."""
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.mapInArrow(tidy(run), T.StructType([*plain.schema.fields, *more])).toDF(*df.columns, *[f.name for f in more])


def quoted(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 200, settle: bool = True) -> DataFrame:
    """Connected components of an undirected edge list as (node, component).

    component is the smallest node id of the component. Alternates large-star and
    small-star steps; each is a grouped minimum, combined before it is shuffled, and a join
    of the edges with the minima. If the edges fit the measured bound, the minima are
    broadcast and the parts of every exchange are read by as many tasks as the edges need, whatever
    the session sets; else the minima are a written table, so the join's sides are both plain exchanges
    and Spark splits the edges of a hub over tasks. Nodes without edges are not returned. An empty
    edge list gives an empty result, without a round. Rounds grow with the logarithm of the edges. With
    settle=False it may stop after max_rounds: equal labels are then connected for certain,
    different ones may be.
    """
    e = (
        edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
        .where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    e = materialize(e, "edges")
    n = e.count()
    small = n * EDGE_BYTES <= BROADCAST_BYTES
    parts = 4 + n // PART_EDGES

    def few(df: DataFrame) -> DataFrame:
        return df.coalesce(parts) if small else df

    def minima(df: DataFrame) -> DataFrame:
        return F.broadcast(few(df)) if small else materialize(df, "minima")

    last = None
    for _ in range(max_rounds if n else 0):
        ends = few(e)
        both = ends.unionByName(ends.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = minima(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = few(large.where("u <> v").distinct())
        down = down if small else materialize(down, "edges")
        low2 = minima(down.groupBy("u").agg(F.min("v").alias("m")))
        step = down.join(low2, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low2.select("u", F.col("m").alias("v")))
        new = materialize(few(step.where("u <> v").distinct()), "edges")
        discard(e, *([] if small else [low, low2, down]))
        e = new
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == last:
            break
        last = tuple(state)
    else:
        if settle and n:
            raise RuntimeError("component labelling did not settle")
    star = few(e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node"))
    roots = few(e.select(F.col("v").alias("node")).distinct()).join(star, "node", "left_anti")
    return star.unionByName(roots.select("node", F.col("node").alias("component")))
