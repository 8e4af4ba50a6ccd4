"""Vector expressions: columns in, columns out, no Python at run time.

Vectors are arrays of numbers, computed as doubles. Where a dimension is given and small, sums are unrolled
so that they stay in generated code; else they are higher-order functions. A null vector gives null.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = 64
QUERY_BITS = 4
EPSILON = 1.9
DEFAULT_COSINE = 0.8
UNROLL = 128
#: So that rounding errors don't decide about halves.
FINE = 2.0**-30
ZERO = 0.0


def vector(v: Column) -> Column:
    return v.cast("array<double>")


def padded_size(n: int) -> int:
    return -(-n // WORD) * WORD


def pad(v: Column) -> Column:
    """Zeros up to a multiple of WORD."""
    return F.concat(v, F.array_repeat(F.lit(ZERO), F.pmod(-F.size(v), F.lit(WORD)).cast("int")))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(ZERO), lambda s, x: s + x)


def dot(a: Column, b: Column, dim: int | None = None) -> Column:
    if dim and dim <= UNROLL:
        return reduce(add, [a[i] * b[i] for i in range(dim)])
    return total(F.zip_with(a, b, lambda x, y: x * y))


def l2(a: Column, b: Column, dim: int | None = None) -> Column:
    """Squared distance; there is no square root. Where no dimension is given, a shorter vector goes on with zeros."""
    if dim and dim <= UNROLL:
        return reduce(add, [(a[i] - b[i]) * (a[i] - b[i]) for i in range(dim)])
    diff = lambda x, y: F.coalesce(x, F.lit(ZERO)) - F.coalesce(y, F.lit(ZERO))
    return total(F.zip_with(a, b, lambda x, y: diff(x, y) * diff(x, y)))


def residual(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(v, lambda x: x * x)))


def word(v: Column, w: int, bit) -> Column:
    """64 values as one number, bit i set where bit(value)."""
    one = F.lit(1).cast("long")
    bits = F.transform(F.slice(v, w * WORD + 1, WORD), lambda x, i: F.when(bit(x), F.call_function("shiftleft", one, i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))


def sign_code(v: Column, dim: int) -> Column:
    """A bit for each value, set if it is above zero; dim is a multiple of WORD."""
    return F.array(*[word(v, w, lambda x: x > 0) for w in range(dim // WORD)])


def signs(v: Column) -> Column:
    """1 where a value is above zero, else -1."""
    return F.transform(v, lambda x: F.when(x > 0, F.lit(1.0)).otherwise(F.lit(-1.0)))


def step_size(low: Column, high: Column) -> Column:
    return (high - low) / F.lit(float((1 << QUERY_BITS) - 1))


def quantize(v: Column, low: Column, delta: Column) -> Column:
    """Nearest multiple of delta above low, halves to even; a constant vector gives zeros. What is within FINE of a half is one."""
    safe = F.when(delta == 0, F.lit(1.0)).otherwise(delta)
    return F.transform(v, lambda x: F.when(delta == 0, F.lit(0)).otherwise(F.rint(F.rint((x - low) / safe / FINE) * FINE).cast("int")))


def quantize_biased(v: Column, low: Column, delta: Column, bias: Column) -> Column:
    """With a bias in [0, 1) for each value, rounded down."""
    safe = F.when(delta == 0, F.lit(1.0)).otherwise(delta)
    return F.zip_with(v, bias, lambda x, b: F.when(delta == 0, F.lit(0)).otherwise(F.floor((x - low) / safe + b).cast("int")))


def bit_planes(q: Column, dim: int) -> Column:
    """For each bit of the quantized values, the words of that bit."""
    return F.array(*[F.array(*[word(q, w, lambda x, j=j: F.shiftright(x, j).bitwiseAND(F.lit(1)) == 1) for w in range(dim // WORD)]) for j in range(QUERY_BITS)])


def binary_dot(x: Column, y: Column, words: int) -> Column:
    return reduce(add, [F.bit_count(x[w].bitwiseAND(y[w])) for w in range(words)])


def asymmetric_dot(code: Column, planes: Column, words: int) -> Column:
    """Sum of the quantized values where the code has a bit."""
    return reduce(add, [F.bit_count(code[w].bitwiseAND(planes[j][w])) * F.lit(1 << j) for j in range(QUERY_BITS) for w in range(words)])


def factors(r: Column, dim: int) -> dict[str, Column]:
    """What a code's row keeps of its residual: squared length and the three factors of the estimate."""
    root = F.lit(float(dim) ** 0.5)
    d2 = total(F.transform(r, lambda x: x * x))
    d = F.sqrt(d2)
    aligned = total(F.transform(r, F.abs))
    cosine = F.when(d > 0, aligned / (F.when(d > 0, d).otherwise(F.lit(1.0)) * root)).otherwise(F.lit(DEFAULT_COSINE))
    w = d / cosine
    ip = F.lit(-2.0) / root * w
    return {
        "center_distance_square": d2, "factor_ip": ip, "factor_ppc": ip * total(signs(r)),
        "error_bound": F.lit(2 * EPSILON / float(dim - 1) ** 0.5) * F.sqrt(F.greatest(F.lit(ZERO), w * w - d2)),
    }


def rough(code: Column, planes: Column, words: int) -> Column:
    """A bound that the squared distance is seldom below; columns of the code's row and of the query's probe."""
    c = F.col
    return (
        c("center_distance_square") + c("g2") + c("low") * c("factor_ppc")
        + (F.lit(2.0) * asymmetric_dot(code, planes, words) - c("q_sum")) * c("factor_ip") * c("delta") - c("error_bound") * F.sqrt("g2")
    )
