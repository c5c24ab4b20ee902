"""Column functions on vectors held as arrays.

Integer codes sum in integers and are exact; float components are widened to double and
summed in array order, so results do not depend on partitioning.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _wide(x, exact: bool) -> Column:
    return _c(x).cast("array<bigint>" if exact else "array<double>")


def _sum(arr: Column, exact: bool) -> Column:
    return F.aggregate(arr, F.lit(0).cast("bigint") if exact else F.lit(0.0), lambda a, x: a + x)


def l2sq(p, q, exact: bool = False) -> Column:
    """Squared Euclidean distance; exact for integer codes."""
    return _sum(F.zip_with(_wide(p, exact), _wide(q, exact), lambda x, y: (x - y) * (x - y)), exact)


def dot(p, q, exact: bool = False) -> Column:
    """Inner product."""
    return _sum(F.zip_with(_wide(p, exact), _wide(q, exact), lambda x, y: x * y), exact)


def neg_ip(p, q, exact: bool = False) -> Column:
    """Negative inner product, so that smaller is nearer."""
    return -dot(p, q, exact)


def distance(p, q, metric: str = "l2", exact: bool = False) -> Column:
    """The distance of a metric by name."""
    if metric not in ("l2", "mips"):
        raise ValueError(f"unknown metric {metric}")
    return (l2sq if metric == "l2" else neg_ip)(p, q, exact)


def norm(v) -> Column:
    """Euclidean norm."""
    return F.sqrt(dot(v, v))


def rms(v, eps: float = 1e-6) -> Column:
    """Root of the mean square plus eps."""
    return F.sqrt(dot(v, v) / F.size(_c(v)) + F.lit(eps))


def axpy(v, x, w) -> Column:
    """v + w * x."""
    w = _c(w) if isinstance(w, (str, Column)) else F.lit(float(w))
    return F.zip_with(_wide(v, False), _wide(x, False), lambda a, b: a + w * b)


def axpy_square(v, x, w) -> Column:
    """v + w * x squared, elementwise."""
    w = _c(w) if isinstance(w, (str, Column)) else F.lit(float(w))
    return F.zip_with(_wide(v, False), _wide(x, False), lambda a, b: a + w * b * b)


def axpy_sparse(v, index, value, w: float) -> Column:
    """v[i] += value * w for paired arrays of 0-based indexes and values; an index occurs once."""
    at = F.map_from_arrays(_c(index), _c(value))
    return F.transform(_wide(v, False), lambda a, i: a + F.coalesce(F.try_element_at(at, i), F.lit(0.0)) * F.lit(float(w)))


def scale(v, s: float) -> Column:
    """v times a number."""
    return F.transform(_wide(v, False), lambda a: a * F.lit(float(s)))


def divide(v, s: float) -> Column:
    """v over a number."""
    return F.transform(_wide(v, False), lambda a: a / F.lit(float(s)))


def part(v, offset: int, length: int) -> Column:
    """length components from a 0-based offset."""
    return F.slice(_c(v), offset + 1, length)


def zeros(dims: int) -> Column:
    """The zero vector."""
    return F.array_repeat(F.lit(0.0), dims)


def uniform(id_col, dims: int, bound: float, seed: int = 0) -> Column:
    """Components in (-bound, bound) drawn from a hash of (seed, id, position)."""
    u = lambda j: (F.xxhash64(F.lit(seed), _c(id_col), j) / F.lit(float(2**63)))
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda j: u(j) * F.lit(float(bound)))


def quantize(v, chunk: int = 1, signed: bool = False) -> Column:
    """Scalar codes of components in [-1, 1]; with chunk 2 two 4-bit codes a byte, the later one high.

    Truncates (v + 1) / 2 * 255 towards zero and clamps to 0..255 before any shift.
    """
    def code(x: Column) -> Column:
        t = ((x + F.lit(1.0).cast("float")).cast("double") * 0.5 * 255).cast("int")
        t = F.greatest(F.least(t, F.lit(255)), F.lit(0))
        return t - 128 if signed else t

    codes = F.transform(_c(v).cast("array<float>"), code)
    if chunk == 1:
        return codes
    if chunk != 2:
        raise ValueError("one or two codes a byte")
    half = F.transform(codes, lambda t: F.shiftright(t, 4).bitwiseAND(15))
    pair = F.sequence(F.lit(0), F.floor(F.size(half) / 2).cast("int") - 1)
    return F.transform(pair, lambda i: F.element_at(half, 2 * i + 1) + F.shiftleft(F.element_at(half, 2 * i + 2), 4))


def to_u8(v) -> Column:
    """Float components that are whole bytes already; raises outside 0..255."""
    bad = lambda x: F.raise_error(F.concat(F.lit("not a byte: "), x.cast("string"))).cast("int")
    return F.transform(_c(v), lambda x: F.when((x >= 0) & (x < 256), x.cast("int")).otherwise(bad(x)))


def u8_to_u4(codes) -> Column:
    """Pack 8-bit codes to their high nibbles, the odd position high; an odd trailing one is dropped."""
    c = _c(codes)
    pair = F.sequence(F.lit(0), F.floor(F.size(c) / 2).cast("int") - 1)
    return F.when(F.size(c) > 1, F.transform(pair, lambda i: F.element_at(c, 2 * i + 2).bitwiseAND(240) + F.shiftright(F.element_at(c, 2 * i + 1), 4))).otherwise(F.array().cast("array<int>"))


def unpack4(packed, signed: bool = False) -> Column:
    """Components of packed nibbles in sixteenths of a byte, the low nibble first; signed sign-extends."""
    ext = (lambda n: (n.bitwiseXOR(F.lit(8)) - 8) * 16) if signed else (lambda n: n * 16)
    return F.flatten(F.transform(_c(packed), lambda b: F.array(ext(b.bitwiseAND(15)), ext(F.shiftright(b, 4).bitwiseAND(15)))))


def project(v, matrix: list[list[float]], bias: list[float] | None = None) -> Column:
    """Matrix times vector plus bias; the matrix is small and becomes a literal."""
    rows = F.array(*[F.array(*[F.lit(float(x)) for x in r]) for r in matrix])
    add = F.array(*[F.lit(float(b)) for b in (bias or [0.0] * len(matrix))])
    x = _wide(v, False)
    return F.transform(rows, lambda r, j: F.element_at(add, j + 1) + _sum(F.zip_with(r, x, lambda a, b: a * b), False))


def cosine_at_p(pa, pb, ab) -> Column:
    """Cosine of the angle at p from squared distances p-a, p-b and a-b; 1 if a side is 0."""
    a, b, c = _c(pa), _c(pb), _c(ab)
    return F.when((a <= 0) | (b <= 0), F.lit(1.0)).otherwise((a + b - c) / (2 * F.sqrt(a) * F.sqrt(b)))


def pruned_by_distance(pb, ab, alpha: float) -> Column:
    """Whether b, seen from p, is occluded by a: alpha * d(a, b) <= d(p, b)."""
    return F.lit(alpha) * _c(ab) <= _c(pb) if alpha > 1e-5 else F.lit(False)


def pruned_by_angle(pa, pb, ab, cos_angle: float) -> Column:
    """Whether b lies within the angle around a, seen from p."""
    return cosine_at_p(pa, pb, ab) > F.lit(cos_angle) if cos_angle > 1e-5 else F.lit(False)


def survives_either(pa, pb, ab, alpha: float, cos_angle: float) -> Column:
    """Whether b stays if one enabled test that keeps it is enough."""
    tests = []
    if alpha > 1e-5:
        tests.append(F.lit(alpha) * _c(ab) > _c(pb))
    if cos_angle > 1e-5:
        tests.append(cosine_at_p(pa, pb, ab) < F.lit(cos_angle))
    return reduce(lambda x, y: x | y, tests) if tests else F.lit(True)


def relu(v) -> Column:
    """Elementwise maximum with zero."""
    return F.transform(_wide(v, False), lambda x: F.greatest(x, F.lit(0.0)))


def rms_norm(v) -> Column:
    """v over its root mean square."""
    r = rms(v)
    return F.transform(_wide(v, False), lambda x: x / r)
