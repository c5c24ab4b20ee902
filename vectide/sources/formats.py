"""Binary layouts of vector files, little-endian, as plain functions on bytes and files."""

from __future__ import annotations

import io
import struct

import numpy as np

#: Suffix -> (numpy type of a stored value); u4 and i4 store two nibbles a byte.
SUFFIX = {"fbin": np.float32, "bin": np.float32, "u8bin": np.uint8, "i8bin": np.int8, "u4bin": np.uint8, "i4bin": np.uint8}


def dtype_of(path: str):
    """Stored type by file suffix; raises on an unknown one."""
    ext = path.rsplit(".", 1)[-1]
    if ext not in SUFFIX:
        raise ValueError(f"unknown vector file type: {path}")
    return np.dtype(SUFFIX[ext]).newbyteorder("<")


def head(path: str) -> tuple[int, int]:
    """(rows, stored values a row)."""
    with open(path, "rb") as f:
        return struct.unpack("<II", f.read(8))


def write_vectors(path: str, x: np.ndarray) -> None:
    """Header [n, dims], then the rows."""
    with open(path, "wb") as f:
        f.write(struct.pack("<II", *x.shape))
        f.write(np.ascontiguousarray(x, dtype_of(path)).tobytes())


def read_vectors(path: str, start: int = 0, count: int | None = None) -> np.ndarray:
    """Some rows; only their bytes are read."""
    n, dims = head(path)
    kind = dtype_of(path)
    count = n - start if count is None else min(count, n - start)
    with open(path, "rb") as f:
        f.seek(8 + start * dims * kind.itemsize)
        return np.frombuffer(f.read(count * dims * kind.itemsize), kind).reshape(count, dims)


def write_fvecs(path: str, x: np.ndarray) -> None:
    """Records of [dims, values]."""
    with open(path, "wb") as f:
        for row in np.asarray(x, "<f4"):
            f.write(struct.pack("<I", len(row)) + row.tobytes())


def read_fvecs(path: str, start: int = 0, count: int | None = None) -> np.ndarray:
    """Some records; raises if their lengths differ."""
    with open(path, "rb") as f:
        dims = struct.unpack("<I", f.read(4))[0]
        size = 4 + 4 * dims
        f.seek(0, io.SEEK_END)
        n = f.tell() // size
        count = n - start if count is None else min(count, n - start)
        f.seek(start * size)
        raw = np.frombuffer(f.read(count * size), "<u4").reshape(count, dims + 1)
    if not (raw[:, 0] == dims).all():
        raise ValueError("records of different lengths")
    return raw[:, 1:].copy().view("<f4")


def fvecs_to_fbin(src: str, dst: str) -> None:
    """Rewrite fvecs records behind one header."""
    write_vectors(dst, read_fvecs(src))


def write_truth(path: str, ids: np.ndarray, dists: np.ndarray | None = None) -> None:
    """[queries, k], ids, then distances if given."""
    with open(path, "wb") as f:
        f.write(struct.pack("<II", *ids.shape) + np.asarray(ids, "<u4").tobytes())
        if dists is not None:
            f.write(np.asarray(dists, "<f4").tobytes())


def read_truth(path: str) -> tuple[np.ndarray, np.ndarray | None]:
    """(ids, distances or None)."""
    with open(path, "rb") as f:
        n, k = struct.unpack("<II", f.read(8))
        ids = np.frombuffer(f.read(4 * n * k), "<u4").reshape(n, k)
        rest = f.read(4 * n * k)
    return ids, np.frombuffer(rest, "<f4").reshape(n, k) if len(rest) == 4 * n * k and n * k else None


def write_matrix(path: str, m: np.ndarray, bias: np.ndarray | None = None) -> None:
    """[rows, columns, has bias], the matrix, then the bias if any."""
    with open(path, "wb") as f:
        f.write(struct.pack("<II?", *m.shape, bias is not None) + np.asarray(m, "<f4").tobytes())
        if bias is not None:
            f.write(np.asarray(bias, "<f4").tobytes())


def read_matrix(path: str) -> tuple[np.ndarray, np.ndarray | None]:
    """(matrix, bias or None)."""
    with open(path, "rb") as f:
        r, c, has = struct.unpack("<II?", f.read(9))
        m = np.frombuffer(f.read(4 * r * c), "<f4").reshape(r, c)
        return m, np.frombuffer(f.read(4 * r), "<f4") if has else None


def write_graph(path: str, lists: list, most: int) -> None:
    """[n, max degree], degrees, then all neighbours."""
    if any(len(x) > most for x in lists):
        raise ValueError("a list is longer than the maximum degree")
    with open(path, "wb") as f:
        f.write(struct.pack("<II", len(lists), most))
        f.write(np.array([len(x) for x in lists], "<u4").tobytes())
        for x in lists:
            f.write(np.asarray(x, "<u4").tobytes())


def read_graph(path: str) -> tuple[list[np.ndarray], int]:
    """(neighbour lists, max degree)."""
    with open(path, "rb") as f:
        n, most = struct.unpack("<II", f.read(8))
        deg = np.frombuffer(f.read(4 * n), "<u4").astype(int)
        flat = np.frombuffer(f.read(), "<u4")
    return np.split(flat, np.cumsum(deg)[:-1]) if n else [], most


def write_hierarchy(path: str, below: np.ndarray, entry: int, most: int | None = None) -> None:
    """[max, used, entry], then per node the node below or -1 - vector."""
    with open(path, "wb") as f:
        f.write(struct.pack("<QQQ", most or len(below), len(below), entry) + np.asarray(below, "<i8").tobytes())


def read_hierarchy(path: str) -> tuple[np.ndarray, int]:
    """(node below or -1 - vector, entry)."""
    with open(path, "rb") as f:
        _, used, entry = struct.unpack("<QQQ", f.read(24))
        return np.frombuffer(f.read(8 * used), "<i8"), entry


def write_ids(path: str, ids) -> None:
    """[n, 1], ids."""
    with open(path, "wb") as f:
        f.write(struct.pack("<QQ", len(ids), 1) + np.asarray(ids, "<u4").tobytes())


def read_ids(path: str) -> np.ndarray:
    """Ids."""
    with open(path, "rb") as f:
        n, _ = struct.unpack("<QQ", f.read(16))
        return np.frombuffer(f.read(4 * n), "<u4")


def write_nested(path: str, lists) -> None:
    """[lists], then per list [length], ids; lists may be an iterator of known number."""
    with open(path, "wb") as f:
        f.write(struct.pack("<Q", 0))
        n = 0
        for x in lists:
            f.write(struct.pack("<Q", len(x)) + np.asarray(x, "<u4").tobytes())
            n += 1
        f.seek(0)
        f.write(struct.pack("<Q", n))


def read_nested(path: str) -> list[np.ndarray]:
    """Lists."""
    with open(path, "rb") as f:
        out = []
        for _ in range(struct.unpack("<Q", f.read(8))[0]):
            n = struct.unpack("<Q", f.read(8))[0]
            out.append(np.frombuffer(f.read(4 * n), "<u4"))
        return out


def write_csr(path: str, lists: list) -> None:
    """[lists, ids], end offsets, ids."""
    with open(path, "wb") as f:
        size = np.array([len(x) for x in lists], "<u8")
        f.write(struct.pack("<QQ", len(lists), int(size.sum())) + np.cumsum(size).astype("<u8").tobytes())
        for x in lists:
            f.write(np.asarray(x, "<u4").tobytes())


def read_csr(path: str) -> list[np.ndarray]:
    """Lists."""
    with open(path, "rb") as f:
        n, total = struct.unpack("<QQ", f.read(16))
        ends = np.frombuffer(f.read(8 * n), "<u8").astype(int)
        return np.split(np.frombuffer(f.read(4 * total), "<u4"), ends[:-1]) if n else []


def write_csr_vectors(path: str, lists: list, vectors: np.ndarray) -> None:
    """[lists, ids, dims], end offsets, then per list ids and their members' vectors."""
    size = np.array([len(x) for x in lists], "<u8")
    with open(path, "wb") as f:
        f.write(struct.pack("<QQQ", len(lists), int(size.sum()), vectors.shape[1]) + np.cumsum(size).astype("<u8").tobytes())
        for x in lists:
            f.write(np.asarray(x, "<u4").tobytes() + np.asarray(vectors[np.asarray(x, int)], "<f4").tobytes())


def read_csr_vectors(path: str, only=None) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """List number -> (ids, vectors); with only, the other lists are skipped over."""
    with open(path, "rb") as f:
        n, _, dims = struct.unpack("<QQQ", f.read(24))
        ends = np.frombuffer(f.read(8 * n), "<u8").astype(int)
        at = f.tell()
        out = {}
        for i in range(n) if only is None else only:
            lo = int(ends[i - 1]) if i else 0
            size = int(ends[i]) - lo
            f.seek(at + lo * (4 + 4 * dims))
            out[i] = (np.frombuffer(f.read(4 * size), "<u4"), np.frombuffer(f.read(4 * size * dims), "<f4").reshape(size, dims))
        return out
