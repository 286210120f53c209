"""Similarity of vectors and hashes as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the structural similarity over the range 0 to 255.
C1, C2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2


def _let(value: Column, f) -> Column:
    """f(value) with `value` worked out once, however often f names it: inside a lambda, what is named is worked out again for each element."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def _dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def ssim(a: Column, b: Column) -> Column:
    """Structural similarity of two vectors by their moments: means, population variances and covariance."""
    n = F.size(a)
    mean_a, mean_b = _sum(a) / n, _sum(b) / n
    var_a, var_b = _dot(a, a) / n - mean_a * mean_a, _dot(b, b) / n - mean_b * mean_b
    cov = _dot(a, b) / n - mean_a * mean_b
    return ((2 * mean_a * mean_b + C1) * (2 * cov + C2)) / ((mean_a * mean_a + mean_b * mean_b + C1) * (var_a + var_b + C2))


def chi_squared(a: Column, b: Column) -> Column:
    """Sum of (a - b)^2 / (a + b) over places where a + b is positive."""
    return _sum(F.zip_with(a, b, lambda x, y: F.when(x + y > 0, (x - y) * (x - y) / (x + y)).otherwise(0.0)))


def histogram(v: Column) -> Column:
    """Absolute values scaled to a sum of one; a vector of zeros stays one."""
    size = F.transform(v, F.abs)
    return _let(F.struct(size.alias("v"), _sum(size).alias("total")), lambda s: F.transform(s["v"], lambda x: F.when(s["total"] > 0, x / s["total"]).otherwise(0.0)))


def as_grey(v: Column) -> Column:
    """-1 to 1 mapped to 0 to 255."""
    return F.transform(v, lambda x: 127.5 + 127.5 * x)


def median_bits(v: Column) -> Column:
    """Bits, from the first element on, of whether each element is over the median; 64 elements make a long."""

    def median(ordered: Column) -> Column:
        half = F.floor(F.size(ordered) / 2).cast("int")
        upper = F.element_at(ordered, half + 1)
        return F.when(F.size(ordered) % 2 == 1, upper).otherwise((F.element_at(ordered, half) + upper) / 2)

    def bits(s: Column) -> Column:
        return F.aggregate(s["v"], F.lit(0).cast("long"), lambda acc, x: F.shiftleft(acc, 1).bitwiseOR(F.when(x > s["m"], 1).otherwise(0).cast("long")))

    return _let(F.struct(v.alias("v"), _let(F.sort_array(v), median).alias("m")), bits)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
