"""Workloads on volumes of 32 x 60 x 60 voxels: chains, distances, ranks and correlations, for the bench.

Volumes are the values of 1800 vectors of ``embeddings`` one after the other; vectors that don't fill a
volume are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.model import Domain
from rasterloom.operators import spatial, stats

GRID = Domain((60, 60, 32))
VECTORS = 60 * 60 * 32 // 64


def volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxels of all volumes, dealt out by image before they are unrolled."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.floor(F.col("vec_id") / VECTORS).alias("image_id"), (F.col("vec_id") % VECTORS).alias("part"), "embedding")
    whole = rows.groupBy("image_id").agg(F.count("*").alias("n")).where(F.col("n") == VECTORS).select("image_id")
    rows = rows.join(whole, "image_id").repartition("image_id").select("image_id", "part", F.posexplode("embedding").alias("pos", "v"))
    at = F.col("part") * 64 + F.col("pos")
    return rows.select("image_id", (at % 60).cast("int").alias("x"), (F.floor(at / 60) % 60).cast("int").alias("y"), F.floor(at / 3600).cast("int").alias("z"), F.col("v").cast("double").alias("v"))


def add_mul_chain(spark: SparkSession, sf_dir: str, steps: int = 16) -> DataFrame:
    """A chain of sums and products, which is one projection."""
    out = F.col("v")
    for k in range(steps):
        out = out + F.col("v") * (k + 1) if k % 2 else out * (1 + k / 100) + k
    return volumes(spark, sf_dir).select("image_id", "x", "y", "z", out.alias("out"))


def distance_and_mask(spark: SparkSession, sf_dir: str, n: int = 11) -> DataFrame:
    """Distances to the masks of several thresholds, and how many of them are near."""
    rows = volumes(spark, sf_dir)
    for k in range(n):
        rows = spatial.dt(rows, F.col("v") > 0.02 * (k + 1), GRID, f"d{k}")
    return rows.select("image_id", "x", "y", "z", sum((F.when(F.col(f"d{k}") < 2, 1).otherwise(0) for k in range(n)), F.lit(0)).alias("out"))


def percentiles(spark: SparkSession, sf_dir: str, n: int = 10) -> DataFrame:
    """Ranks inside the masks of several thresholds."""
    rows = volumes(spark, sf_dir)
    for k in range(n):
        rows = rows.withColumn(f"p{k}", stats.percentiles(rows, F.col("v"), F.col("v") > 0.02 * k - 0.1, 0.5))
    return rows


def cross_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local histograms of three radii and three numbers of bins against that of the whole volume."""
    rows = volumes(spark, sf_dir)
    for r in (1, 2, 3):
        for bins in (8, 16, 24):
            rows = stats.cross_correlation(rows, GRID, float(r), F.col("v"), F.col("v"), F.lit(True), F.lit(-0.5), F.lit(0.5), bins, f"c{r}x{bins}")
    return rows


WORKLOADS: dict[str, Callable[[SparkSession, str], DataFrame]] = {f"volume_{f.__name__}": f for f in (add_mul_chain, distance_and_mask, percentiles, cross_correlation)}
