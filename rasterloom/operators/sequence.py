"""Sequences: array columns, and tables with ``idx, value`` for long ones.

Array operators are Column functions. Table operators keep the order in ``idx``; where they leave
gaps, ``renumbered`` closes them by counting ranges of ``idx`` rather than in one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def whole(x: object, what: str) -> int:
    """A whole number: an int, a float without a fraction, or a string of one."""
    if isinstance(x, bool):
        raise ValueError(f"{what}: expected a whole number, got {x!r}")
    if isinstance(x, str):
        x = float(x)
    if isinstance(x, float) and not x.is_integer():
        raise ValueError(f"{what}: expected a whole number, got {x!r}")
    return int(x)  # type: ignore[call-overload]


# array columns
def array_range(start: Column, stop: Column) -> Column:
    """Whole numbers from ``start`` up to ``stop``, none if that isn't larger."""
    return F.when(stop > start, F.sequence(start, F.greatest(stop - 1, start))).otherwise(F.array().cast("array<bigint>"))


def mapped(a: Column, f: Callable[[Column], Column]) -> Column:
    return F.transform(a, f)


def filtered(a: Column, f: Callable[[Column], Column]) -> Column:
    return F.filter(a, f)


def item(a: Column, i: int) -> Column:
    """The item at ``i``, from 0; it is an error if there is none."""
    if whole(i, "index") < 0:
        raise ValueError("index: negative")
    return F.element_at(a, whole(i, "index") + 1)


def sliced(a: Column, low: int | None, high: int | None) -> Column:
    """Items from ``low`` up to ``high``; none if ``high`` isn't larger."""
    low = max(0, whole(low or 0, "slice"))
    if high is None:
        return F.slice(a, F.lit(low + 1), F.greatest(F.size(a) - low, F.lit(0)))
    return F.slice(a, low + 1, max(0, whole(high, "slice") - low))


def subsequence(a: Column, start: int, stop: int | None = None) -> Column:
    """``subsequence(a, stop)`` or ``subsequence(a, start, stop)``; bounds below 0 are 0."""
    start, stop = (0, start) if stop is None else (start, stop)
    return sliced(a, max(0, whole(start, "subsequence")), max(0, whole(stop, "subsequence")))


def argmax(a: Column) -> Column:
    """The place of the first largest item; an empty array is an error."""
    at = F.array_position(a, F.array_max(a)) - 1
    return F.when(F.size(a) > 0, at).otherwise(F.raise_error(F.lit("argmax: empty sequence")).cast("bigint"))


def zipped(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    """Item by item; arrays of unequal length are an error."""
    same = F.size(a) == F.size(b)
    return F.when(same, F.zip_with(a, b, f)).otherwise(F.when(~same, F.raise_error(F.lit("sequences of unequal length")).cast("array<double>")))


def fold(op: str, a: Column, init: Column | None = None) -> Column:
    """A left fold. Without ``init``, sums and products begin at 0 and 1, connectives at their neutral value, extrema at the first item."""
    if op == "+":
        return F.aggregate(a, init if init is not None else F.lit(0.0), lambda s, x: s + x)
    if op == "-":
        return F.aggregate(a, init if init is not None else F.lit(0.0), lambda s, x: s - x)
    if op == "*":
        return F.aggregate(a, init if init is not None else F.lit(1.0), lambda s, x: s * x)
    if op == "/":
        if init is None:
            raise ValueError("fold / needs an initial value")
        return F.aggregate(a, init, lambda s, x: s / x)
    if op == "&&":
        return F.aggregate(a, init if init is not None else F.lit(True), lambda s, x: s & x)
    if op == "||":
        return F.aggregate(a, init if init is not None else F.lit(False), lambda s, x: s | x)
    if op in ("min", "max"):
        best = F.array_min(a) if op == "min" else F.array_max(a)
        pick = F.least if op == "min" else F.greatest
        if init is not None:
            return F.coalesce(pick(best, init), init)
        return F.when(F.size(a) > 0, best).otherwise(F.raise_error(F.lit(f"fold {op}: empty sequence")).cast("double"))
    raise ValueError(f"E_UNSUPPORTED_FOLD: {op}")


def vector(a: Column, kind: str) -> Column:
    """Items cast: ``vector_uint32`` is kind bigint, cut to whole numbers below 2 ** 32; ``vector_double`` is double."""
    if kind == "uint32":
        return F.transform(a, lambda x: F.pmod(x.cast("bigint"), F.lit(1 << 32)))
    return F.transform(a, lambda x: x.cast(kind))


# tables
def table_range(spark: SparkSession, start: int, stop: int | None = None) -> DataFrame:
    """``idx, value`` of the whole numbers from ``start`` (0 if only one bound is given) up to ``stop``."""
    start, stop = (0, start) if stop is None else (start, stop)
    start, stop = whole(start, "range"), whole(stop, "range")
    return spark.range(start, max(start, stop)).select((F.col("id") - start).alias("idx"), F.col("id").alias("value"))


def renumbered(rows: DataFrame, step: int = 65_536) -> DataFrame:
    """``rows`` with ``idx`` from 0 without gaps, in the old order.

    Rows of a range of ``step`` old places are numbered together and the ranges' counts are summed,
    so a task sees a range or one count of each.
    """
    part = F.floor(F.col("idx") / step)
    counts = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before")
    numbered = rows.withColumn("_part", part).withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy("idx")) - 1)
    return numbered.join(before, "_part").withColumn("idx", F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def table_slice(rows: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
    """Rows from ``low`` up to ``high``, numbered from 0 again; the bounds are a predicate that reaches the source."""
    low = max(0, whole(low or 0, "slice"))
    out = rows.where(F.col("idx") >= low)
    out = out if high is None else out.where(F.col("idx") < max(low, whole(high, "slice")))
    return out.withColumn("idx", F.col("idx") - low)


def table_filter(rows: DataFrame, f: Callable[[Column], Column]) -> DataFrame:
    return renumbered(rows.where(f(F.col("value"))))


def table_map(rows: DataFrame, f: Callable[[Column], Column]) -> DataFrame:
    return rows.withColumn("value", f(F.col("value")))


def table_fold(rows: DataFrame, op: str, init: float | bool | None = None) -> DataFrame:
    """One row, ``value``: the fold as an aggregate that is made in parts; subtraction and division go by the sum and product."""
    v = F.col("value")
    start = F.lit(init) if init is not None else None
    if op in ("+", "-"):
        total = F.coalesce(F.sum(v), F.lit(0))
        base = start if start is not None else F.lit(0.0)
        return rows.agg((base + total if op == "+" else base - total).alias("value"))
    if op in ("*", "/"):
        if op == "/" and start is None:
            raise ValueError("fold / needs an initial value")
        total = F.coalesce(F.product(v), F.lit(1.0))
        return rows.agg(((start if start is not None else F.lit(1.0)) * total if op == "*" else start / total).alias("value"))
    if op in ("&&", "||"):
        both, none = (F.bool_and(v), True) if op == "&&" else (F.bool_or(v), False)
        held = F.coalesce(both, F.lit(none))
        return rows.agg((held if start is None else (held & start if op == "&&" else held | start)).alias("value"))
    if op in ("min", "max"):
        best = F.min(v) if op == "min" else F.max(v)
        if start is None:
            return rows.agg(F.when(best.isNotNull(), best).otherwise(F.raise_error(F.lit(f"fold {op}: empty sequence")).cast("double")).alias("value"))
        return rows.agg((F.least if op == "min" else F.greatest)(best, start).alias("value"))
    raise ValueError(f"E_UNSUPPORTED_FOLD: {op}")


def table_argmax(rows: DataFrame, by: list[str]) -> DataFrame:
    """The place of the first largest ``value`` of each group, from a partial aggregate of one struct."""
    return rows.groupBy(*by).agg(F.max(F.struct(F.col("value"), (-F.col("idx")).alias("_at"))).alias("_best")).select(*by, (-F.col("_best._at")).alias("argmax"))
