"""Point-wise operators on voxel values: Column to Column, for one projection without a join.

Scalars come first where the name ends in ``_sv`` and last where it ends in ``_vs``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.model import COORDS, VOXEL, Domain

Number = float | int | Column


def col(x: Number | bool) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


# generators over the domain's own rows
def tt() -> Column:
    return F.lit(True)


def ff() -> Column:
    return F.lit(False)


def bconstant(b: bool) -> Column:
    return F.lit(bool(b))


def constant(k: Number) -> Column:
    return col(k).cast("double")


def coordinate(axis: str) -> Column:
    """The coordinate along an axis, 0 along an axis that the image lacks."""
    return F.col(axis).cast("double")


def border(domain: Domain) -> Column:
    """Whether a voxel is the first or last along an axis of the image; axes with one voxel don't count."""
    sides = [(F.col(a) == 0) | (F.col(a) == domain.length(a) - 1) for a in domain.axes]
    return reduce(Column.__or__, sides, F.lit(False))


# masks
def not_(a: Column) -> Column:
    return ~a


def and_(a: Column, b: Column) -> Column:
    return a & b


def or_(a: Column, b: Column) -> Column:
    return a | b


def eq_sv(k: Number, v: Column) -> Column:
    return v == k


def geq_sv(k: Number, v: Column) -> Column:
    return v >= k


def leq_sv(k: Number, v: Column) -> Column:
    return v <= k


def between(a: Number, b: Number, v: Column) -> Column:
    return v.between(a, b)


# values
def absolute(v: Column) -> Column:
    return F.abs(v)


def div_sv(k: Number, v: Column) -> Column:
    """``k / v``, null where v is 0."""
    return F.try_divide(col(k).cast("double"), v)


def sub_sv(k: Number, v: Column) -> Column:
    return col(k) - v


def div_vs(v: Column, k: Number) -> Column:
    """``v`` times the reciprocal of ``k``."""
    return v * (1 / col(k))


def sub_vs(v: Column, k: Number) -> Column:
    return v - k


def add_vs(v: Column, k: Number) -> Column:
    return v + k


def mul_vs(v: Column, k: Number) -> Column:
    return v * k


def divide(a: Column, b: Number) -> Column:
    """Voxel by voxel, null where the divisor is 0; a scalar quotient raises instead."""
    return F.try_divide(a.cast("double"), col(b))


def masked(v: Column, m: Column) -> Column:
    """``v`` on the mask, else 0."""
    return F.when(m, v).otherwise(F.lit(0.0))


def div_z(a: Column, b: Column, other: Number) -> Column:
    """``a / b``, ``other`` where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b), col(other))


def if_(m: Column, a: Number, b: Number) -> Column:
    """``a`` on the mask, else ``b``."""
    return F.when(m, col(a)).otherwise(col(b))


def threshold_equal(v: Column, t: Number, true: Number = 1, false: Number = 0) -> Column:
    return F.when(v == t, col(true)).otherwise(col(false))


def binary_threshold(v: Column, low: Number, high: Number, inside: int = 1, outside: int = 0) -> Column:
    return F.when(v.between(low, high), F.lit(int(inside))).otherwise(F.lit(int(outside)))


# vector pixels
def rgb(r: Column, g: Column, b: Column) -> Column:
    return F.array(r, g, b)


def rgba(r: Column, g: Column, b: Column, a: Column) -> Column:
    return F.array(r, g, b, a)


def component(v: Column, k: int) -> Column:
    return F.get(v, F.lit(k))


def alpha(v: Column) -> Column:
    """The fourth component, 255 if there is none."""
    return F.coalesce(F.get(v, F.lit(3)), F.lit(255.0))


def intensity(v: Column) -> Column:
    """Luma of a vector pixel; the value itself of one with a single component."""
    luma = 0.2126 * F.get(v, F.lit(0)) + 0.7152 * F.get(v, F.lit(1)) + 0.0722 * F.get(v, F.lit(2))
    return F.when(F.size(v) == 1, F.get(v, F.lit(0))).otherwise(luma)


# image with image, of different tables
def aligned(a: DataFrame, b: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """Values of two sets of images on one row; only for images that don't share a table."""
    return a.select(*VOXEL, F.col("v").alias(left)).join(b.select(*VOXEL, F.col("v").alias(right)), VOXEL)


def extract(voxels: DataFrame, size: tuple[float, ...], index: tuple[float, ...], rebase: bool = True) -> DataFrame:
    """A box of ``size`` from ``index`` on, both cut to whole numbers; its coordinates begin at 0 again."""
    out = voxels
    for axis, n, first in zip(COORDS, map(int, size), map(int, index)):
        out = out.where(F.col(axis).between(first, first + max(n, 1) - 1))
        if rebase:
            out = out.withColumn(axis, F.col(axis) - first)
    return out
