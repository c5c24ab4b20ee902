"""Vector files as a Spark data source.

spark.read.format("vecbin").load(path) gives (id long, vec array<float>) of .fbin, .u8bin,
.i8bin, .u4bin, .i4bin and .fvecs files; ids are row numbers. Every partition reads its
own range of rows, so a file of any size is split. Writing makes one file per task named
part-<n>.<type> in the target folder, ids alongside in part-<n>.ids; a task that fails
leaves nothing behind.

The path is a file or folder that all executors can open.
"""

from __future__ import annotations

import glob
import os

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from vectide.sources import formats


class _Rows(InputPartition):
    def __init__(self, path: str, start: int, count: int, first_id: int):
        self.path, self.start, self.count, self.first_id = path, start, count, first_id


class VecReader(DataSourceReader):
    """Splits files by ranges of rows."""

    def __init__(self, options: dict):
        path = options["path"]
        self.files = sorted(f for f in glob.glob(f"{path}/*") if not f.endswith(".ids")) if os.path.isdir(path) else [path]
        self.rows = int(options.get("rowsPerPartition", 1 << 18))

    def partitions(self) -> list[InputPartition]:
        out, first = [], 0
        for f in self.files:
            if f.endswith(".fvecs"):
                dims = int(np.fromfile(f, "<u4", 1)[0]) if os.path.getsize(f) else 0
                n = os.path.getsize(f) // (4 + 4 * dims) if dims else 0
            else:
                n = formats.head(f)[0]
            out += [_Rows(f, a, min(self.rows, n - a), first + a) for a in range(0, n, self.rows)]
            first += n
        return out or [_Rows("", 0, 0, 0)]

    def read(self, partition: _Rows):
        import pyarrow as pa

        if not partition.count:
            return
        p = partition
        if p.path.endswith(".fvecs"):
            x = formats.read_fvecs(p.path, p.start, p.count)
        else:
            x = formats.read_vectors(p.path, p.start, p.count)
            if p.path.endswith(("u4bin", "i4bin")):
                low, high = (x & 15).astype(np.int16), (x >> 4).astype(np.int16)
                if p.path.endswith("i4bin"):
                    low, high = (low ^ 8) - 8, (high ^ 8) - 8
                x = np.stack([low * 16, high * 16], 2).reshape(len(x), -1)
        named = p.path.rsplit(".", 1)[0] + ".ids"
        ids = np.fromfile(named, "<i8", p.count, offset=8 * p.start) if os.path.exists(named) else np.arange(p.first_id, p.first_id + len(x))
        step = 1 << 14
        for a in range(0, len(x), step):
            part = np.ascontiguousarray(x[a : a + step], np.float32)
            offsets = np.arange(0, part.size + 1, part.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(ids[a : a + step], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(part.ravel()))], names=["id", "vec"])


def pack_nibbles(x: np.ndarray) -> np.ndarray:
    """Bytes of two dimensions each, even ones low; values are sixteen times a nibble, as the reader gives them."""
    if x.shape[1] % 2:
        x = np.concatenate([x, np.zeros((len(x), 1), x.dtype)], 1)
    nibble = (x // 16).astype(np.int64) & 15
    return (nibble[:, 0::2] | nibble[:, 1::2] << 4).astype(np.uint8)


class _Wrote(WriterCommitMessage):
    def __init__(self, files: list[str]):
        self.files = files


class VecWriter(DataSourceWriter):
    """Writes a file per task under a temporary name, renamed when the job commits."""

    def __init__(self, options: dict, overwrite: bool = False):
        self.path, self.kind, self.overwrite = options["path"], options.get("type", "fbin"), overwrite
        formats.dtype_of(f"x.{self.kind}")

    def write(self, iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        os.makedirs(self.path, exist_ok=True)
        ids, rows = [], []
        for r in iterator:
            ids.append(r["id"])
            rows.append(np.asarray(r["vec"], np.float32))
        if not rows:
            return _Wrote([])
        x = np.stack(rows)
        if self.kind in ("u4bin", "i4bin"):
            x = pack_nibbles(x)
        t = TaskContext.get()
        name = f"{self.path}/.part-{t.partitionId():05d}-{t.taskAttemptId()}"
        formats.write_vectors(f"{name}.{self.kind}", x)
        np.array(ids, "<i8").tofile(f"{name}.ids")
        return _Wrote([f"{name}.{self.kind}", f"{name}.ids"])

    def commit(self, messages) -> None:
        if self.overwrite:
            for f in glob.glob(f"{self.path}/*"):
                os.remove(f)
        for m in messages:
            for f in m.files if m else ():
                os.rename(f, f.replace("/.part-", "/part-"))

    def abort(self, messages) -> None:
        for m in messages:
            for f in m.files if m else ():
                if os.path.exists(f):
                    os.remove(f)


class VecSource(DataSource):
    """The vecbin format."""

    @classmethod
    def name(cls) -> str:
        return "vecbin"

    def schema(self) -> str:
        return "id long, vec array<float>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return VecReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return VecWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(VecSource)


def gather(df: DataFrame, ids: list[int]) -> DataFrame:
    """Rows of some ids, a filter that Parquet can push down."""
    return df.where(df.id.isin(ids))


def append_report(df: DataFrame, path: str) -> None:
    """Append rows of a benchmark report as CSV with a header."""
    df.write.mode("append").option("header", True).csv(path)


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """Rows (file, row, vec) of .npy files and of the arrays in .npz files."""
    import io

    import pandas as pd

    files = spark.read.format("binaryFile").load(path)

    def rows(batches):
        for pdf in batches:
            out = []
            for p, data in zip(pdf["path"], pdf["content"]):
                got = np.load(io.BytesIO(data), allow_pickle=False)
                named = {p: got} if isinstance(got, np.ndarray) else {f"{p}#{k}": got[k] for k in got.files}
                for name, x in named.items():
                    out += [(name, i, np.atleast_1d(r).astype(float).ravel().tolist()) for i, r in enumerate(np.atleast_1d(x))]
            yield pd.DataFrame(out, columns=["file", "row", "vec"])

    return files.select("path", "content").mapInPandas(rows, "file string, row long, vec array<double>")
