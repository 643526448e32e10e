"""Aggregates of images, ranks inside masks, thresholds from histograms, and local histogram correlation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.model import Domain


def extrema(voxels: DataFrame, value: str = "v") -> DataFrame:
    """``image_id, min, max``."""
    return voxels.groupBy("image_id").agg(F.min(value).alias("min"), F.max(value).alias("max"))


def average(voxels: DataFrame, value: Column, mask: Column, empty: float | None = None) -> DataFrame:
    """``image_id, avg`` over the mask. An empty mask gives ``empty``, or raises if that is None."""
    mean = F.avg(F.when(mask, value))
    if empty is not None:
        return voxels.groupBy("image_id").agg(F.coalesce(mean, F.lit(float(empty))).alias("avg"))
    rows = voxels.groupBy("image_id").agg(mean.alias("avg"))
    return rows.withColumn("avg", F.when(F.col("avg").isNotNull(), F.col("avg")).otherwise(F.raise_error(F.lit("avg: the mask is empty")).cast("double")))


def volume(voxels: DataFrame, mask: Column) -> DataFrame:
    """``image_id, volume``: how many voxels the mask has, as a double."""
    return voxels.groupBy("image_id").agg(F.count_if(mask).cast("double").alias("volume"))


def statistics(voxels: DataFrame, value: str = "v") -> DataFrame:
    """Minimum, maximum, mean, sample deviation and variance, sum and count."""
    v = F.col(value)
    return voxels.groupBy("image_id").agg(F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sigma"), F.var_samp(v).alias("variance"), F.sum(v).alias("sum"), F.count(v).alias("count"))


def array_stats(voxels: DataFrame, value: str = "v") -> DataFrame:
    """Mean, population deviation, extrema, exact median, number of values and of distinct ones."""
    v = F.col(value)
    return voxels.groupBy("image_id").agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.median(v).alias("median"), F.count(v).alias("total"), F.count_distinct(v).alias("n_unique"))


def count_pixels(voxels: DataFrame, value: Column, of: float | None = None) -> DataFrame:
    """Counts and percentages of one value, or of each distinct value."""
    if of is not None:
        hit = F.count_if(value == of)
        return voxels.groupBy("image_id").agg(F.lit(of).alias("value"), hit.alias("count"), F.count("*").alias("total"), (100 * hit / F.count("*")).alias("percentage"))
    each = voxels.groupBy("image_id", value.alias("value")).agg(F.count("*").alias("count"))
    total = F.sum("count").over(Window.partitionBy("image_id"))
    return each.select("image_id", "value", "count", (100 * F.col("count") / total).alias("percentage"))


def percentiles(voxels: DataFrame, value: Column, mask: Column, ties: float) -> Column:
    """The rank of a voxel among those of its image's mask: the share that is smaller plus ``ties`` of those equal; -1 outside.

    Three windows over one partitioning by image: the smaller ones are counted by rank, in order of
    value, with the voxels outside of the mask kept apart as a partition of their own.
    """
    inside = mask.cast("boolean")
    own = Window.partitionBy("image_id", inside)
    rank = F.rank().over(own.orderBy(value)) - 1
    same = F.count("*").over(Window.partitionBy("image_id", inside, value))
    return F.when(inside, (rank + F.lit(float(ties)) * same) / F.count("*").over(own)).otherwise(F.lit(-1.0))


def otsu(voxels: DataFrame, value: str, mask: Column, bins: int) -> DataFrame:
    """``image_id, threshold``: the upper edge of the bin that splits the masked values with the largest variance between classes.

    Bins are equal steps from the least to the largest masked value, which is in the last bin; the
    first split wins ties. Voxels become counts by bin before any window sees them.
    """
    rows = voxels.where(mask).select("image_id", F.col(value).alias("v"))
    ends = rows.groupBy("image_id").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    width = (F.col("high") - F.col("low")) / bins
    place = F.when(width == 0, 0).otherwise(F.least(F.lit(bins - 1), F.floor(F.try_divide(F.col("v") - F.col("low"), width)).cast("int")))
    counts = rows.join(ends, "image_id").groupBy("image_id", "low", "high", place.alias("bin")).agg(F.count("*").alias("n"))
    all_bins = counts.groupBy("image_id", "low", "high").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("held"))
    dense = all_bins.select("image_id", "low", "high", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "held")
    dense = dense.select("image_id", "low", "high", "bin", F.coalesce(F.try_element_at("held", F.col("bin")), F.lit(0)).alias("n"))
    so_far = Window.partitionBy("image_id").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("image_id")
    middle = F.col("bin") + 0.5
    dense = dense.select("image_id", "low", "high", "bin", F.sum("n").over(so_far).alias("n0"), F.sum(F.col("n") * middle).over(so_far).alias("s0"), F.sum("n").over(whole).alias("n"), F.sum(F.col("n") * middle).over(whole).alias("s"))
    rest = F.col("n") - F.col("n0")
    apart = F.try_divide(F.col("s0"), F.col("n0")) - F.try_divide(F.col("s") - F.col("s0"), rest)
    dense = dense.withColumn("between", F.coalesce(F.col("n0") * rest * apart * apart, F.lit(0.0)))
    best = dense.withColumn("place", F.row_number().over(Window.partitionBy("image_id").orderBy(F.round("between", 9).desc(), "bin"))).where("place = 1")
    return best.select("image_id", (F.col("low") + (F.col("bin") + 1) * width).alias("threshold"))


def binned(value: Column, low: Column, high: Column, bins: int) -> Column:
    """The bin of a value, null below ``low``, from ``high`` on, and if these are equal."""
    step = (high - low) / bins
    return F.when((step > 0) & (value >= low) & (value < high), F.least(F.floor(F.try_divide(value - low, step)), F.lit(bins - 1)).cast("int"))


def radii(domain: Domain, r: float) -> dict[str, int]:
    """Voxels on each side along each axis that a neighbourhood of radius ``r`` has."""
    return {a: max(1, round(r / domain.step(a))) for a in domain.axes}


def cross_correlation(voxels: DataFrame, domain: Domain, r: float, a: Column, b: Column, fb: Column, low: Column, high: Column, bins: int, out: str = "cc") -> DataFrame:
    """``voxels`` with ``out``: how the histogram of ``a`` around a voxel correlates with that of ``b`` on the mask ``fb``.

    Neighbourhoods are boxes, cut at the image's border. Histograms are arrays that are summed along
    one axis after the other, by window frames over one partitioning by image; an axis costs as much
    for a large radius as for a small one in rows, never a neighbourhood's worth. Two constant
    histograms correlate by 1, one alone by 0.
    """
    of = Window.partitionBy("image_id")
    rows = voxels.withColumns({"_bin": binned(a, low, high, bins), "_fbin": F.when(fb, binned(b, low, high, bins))})
    rows = rows.withColumns({f"_h{k}": F.when(F.col("_bin") == k, 1).otherwise(0) for k in range(bins)})
    rows = rows.withColumn("_g", F.array(*[F.count_if(F.col("_fbin") == k).over(of) for k in range(bins)]))
    for axis, n in radii(domain, r).items():
        line = Window.partitionBy("image_id", *[c for c in ("x", "y", "z") if c != axis]).orderBy(axis).rangeBetween(-n, n)
        rows = rows.withColumns({f"_h{k}": F.sum(f"_h{k}").over(line) for k in range(bins)})
    rows = rows.withColumn("_h", F.array(*[F.col(f"_h{k}") for k in range(bins)]))
    total = lambda x: F.aggregate(x, F.lit(0).cast("bigint"), lambda s, v: s + v)
    product = lambda x, y: total(F.zip_with(x, y, lambda p, q: (p * q).cast("bigint")))
    h, g = F.col("_h"), F.col("_g")
    hh, gg = bins * product(h, h) - total(h) * total(h), bins * product(g, g) - total(g) * total(g)
    value = F.when((hh == 0) & (gg == 0), 1.0).when((hh == 0) | (gg == 0), 0.0)
    value = value.otherwise(F.try_divide((bins * product(h, g) - total(h) * total(g)).cast("double"), F.sqrt(hh.cast("double")) * F.sqrt(gg.cast("double"))))
    return rows.withColumn(out, value).drop("_bin", "_fbin", "_g", "_h", *[f"_h{k}" for k in range(bins)])
