"""The library that is defined by the operators: boundaries, reachability, growth, morphology.

Names say what the symbols of the surface language mean; ``plans.library`` binds the symbols.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.model import Domain
from rasterloom.operators import spatial, stats


def difference(a: Column, b: Column) -> Column:
    return a & ~b


def xor(a: Column, b: Column) -> Column:
    return a != b


def external_boundary(voxels: DataFrame, a: Column, domain: Domain, out: str = "boundary") -> DataFrame:
    """Neighbours of ``a`` that aren't of it."""
    rows = spatial.near(voxels.withColumn("_a", a), F.col("_a"), domain, "_n")
    return rows.withColumn(out, F.col("_n") & ~F.col("_a")).drop("_a", "_n")


def may_reach(voxels: DataFrame, a: Column, b: Column, domain: Domain, out: str = "may_reach") -> DataFrame:
    """Voxels next to ``a``, or next to a component of ``b`` that is next to ``a``."""
    return spatial.of_masks(voxels, [a, b], domain, reach_grid, out)


def reach_grid(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return spatial.near_grid(spatial.through_grid(spatial.near_grid(a), b) | a)


def touch(voxels: DataFrame, a: Column, b: Column, domain: Domain, out: str = "touch") -> DataFrame:
    """The components of ``a`` that have a neighbour in ``b``."""
    return spatial.of_masks(voxels, [a, b], domain, lambda p, q: spatial.through_grid(spatial.near_grid(q), p), out)


def grow(voxels: DataFrame, a: Column, b: Column, domain: Domain, out: str = "grow") -> DataFrame:
    """``a`` and the components of ``b`` that touch it."""
    rows = touch(voxels.withColumn("_ga", a), b, F.col("_ga"), domain, "_gt")
    return rows.withColumn(out, F.col("_ga") | F.col("_gt")).drop("_ga", "_gt")


def surrounded(voxels: DataFrame, a: Column, b: Column, domain: Domain, out: str = "surrounded") -> DataFrame:
    """Voxels of ``a`` from which no path leaves ``a`` but through ``b``."""
    rows = may_reach(voxels.withColumn("_sa", a), ~(a | b), ~b, domain, "_sr")
    return rows.withColumn(out, F.col("_sa") & ~F.col("_sr")).drop("_sa", "_sr")


def pdt(voxels: DataFrame, a: Column, domain: Domain, out: str = "pdt") -> DataFrame:
    """The distance to ``a``, 0 inside."""
    return spatial.dt(voxels, a, domain, out).withColumn(out, F.greatest(F.col(out), F.lit(0.0)))


def dist_leq(voxels: DataFrame, r: float, a: Column, domain: Domain, out: str = "dist_leq") -> DataFrame:
    return pdt(voxels, a, domain, "_d").withColumn(out, F.col("_d") <= r).drop("_d")


def dist_geq(voxels: DataFrame, r: float, a: Column, domain: Domain, out: str = "dist_geq") -> DataFrame:
    return pdt(voxels, a, domain, "_d").withColumn(out, F.col("_d") >= r).drop("_d")


def dilate(voxels: DataFrame, a: Column, r: float, domain: Domain, out: str = "dilate") -> DataFrame:
    return dist_leq(voxels, r, a, domain, out)


def erode(voxels: DataFrame, a: Column, r: float, domain: Domain, out: str = "erode") -> DataFrame:
    """Voxels farther than ``r`` from what isn't ``a``."""
    rows = dist_leq(voxels, r, ~a, domain, out)
    return rows.withColumn(out, ~F.col(out))


def imopen(voxels: DataFrame, a: Column, r: float, domain: Domain, out: str = "imopen") -> DataFrame:
    """What is left of ``a`` where balls of radius ``r`` fit into it."""
    spacing = domain.spacing[::-1]
    return spatial.of_masks(voxels, [~a], domain, lambda rest: spatial.within_grid(~spatial.within_grid(rest, r, spacing), r, spacing), out)


def imclose(voxels: DataFrame, a: Column, r: float, domain: Domain, out: str = "imclose") -> DataFrame:
    """``a`` and the gaps in it that balls of radius ``r`` don't fit into."""
    spacing = domain.spacing[::-1]
    return spatial.of_masks(voxels, [a], domain, lambda grid: ~spatial.within_grid(~spatial.within_grid(grid, r, spacing), r, spacing), out)


def smoothen(voxels: DataFrame, a: Column, r: float, domain: Domain, out: str = "smoothen") -> DataFrame:
    """Voxels within ``r`` of the part of ``a`` that is at least ``r`` from what isn't ``a``."""
    spacing = domain.spacing[::-1]
    return spatial.of_masks(voxels, [~a], domain, lambda rest: spatial.within_grid(np.maximum(spatial.distance_grid(rest, spacing), 0) >= r, r, spacing), out)


def norm(value: Column, k: float = 1.0) -> Column:
    """Values as shares of ``k`` at the image's largest."""
    return F.try_divide(k * value, F.max(value).over(Window.partitionBy("image_id")))


def boolean_to_number(mask: Column, k: float) -> Column:
    return F.when(mask, F.lit(float(k))).otherwise(F.lit(0.0))


def overlay_color(mask: Column, color: Column, image: Column) -> Column:
    return F.when(mask, color).otherwise(image)


def empty_b(voxels: DataFrame, a: Column) -> DataFrame:
    """``image_id, empty``."""
    return stats.volume(voxels, a).select("image_id", (F.col("volume") == 0).alias("empty"))


def leq_b(voxels: DataFrame, a: Column, b: Column) -> DataFrame:
    """``image_id, included``: whether each voxel of ``a`` is of ``b``."""
    return voxels.groupBy("image_id").agg(F.bool_and(~a | b).alias("included"))


def eq_b(voxels: DataFrame, a: Column, b: Column) -> DataFrame:
    """``image_id, equal``: whether the masks are equal."""
    return voxels.groupBy("image_id").agg(F.bool_and(a == b).alias("equal"))


def neq_b(voxels: DataFrame, a: Column, b: Column) -> DataFrame:
    """``image_id, differ``: whether some voxel is of one mask only."""
    return voxels.groupBy("image_id").agg(F.bool_or(a != b).alias("differ"))


def collect_cc(voxels: DataFrame, phi1: Column, phi2: Column, domain: Domain) -> DataFrame:
    """``image_id, min_cc, max_cc, collected``: the components of ``phi2`` that ``phi1`` meets, and whether it is empty or inside one.

    ``collected`` is true for an empty ``phi1``, or if all of it lies in a single component.
    """
    rows = spatial.lcc(voxels.withColumn("_p", phi1), phi2, domain, "_c").where("_p")
    found = rows.groupBy("image_id").agg(F.min("_c").alias("min_cc"), F.max("_c").alias("max_cc"))
    every = voxels.select("image_id").distinct().join(found, "image_id", "left")
    return every.select("image_id", "min_cc", "max_cc", F.coalesce((F.col("min_cc") == F.col("max_cc")) & (F.col("min_cc") > 0), F.lit(True)).alias("collected"))
