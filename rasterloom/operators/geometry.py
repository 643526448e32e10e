"""Drawing on flat images: a new table each time, nothing is changed in place."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def blank(spark: SparkSession, height: int, width: int, value: float = 0.0, image_id: int = 0) -> DataFrame:
    """A canvas with one value; rows are made where they are used, from one range of numbers."""
    height, width = int(height), int(width)
    if height <= 0 or width <= 0:
        raise ValueError("blank: height and width must be positive")
    at = F.col("id")
    return spark.range(height * width).select(F.lit(image_id).cast("bigint").alias("image_id"), (at % width).cast("int").alias("x"), F.floor(at / width).cast("int").alias("y"), F.lit(0).alias("z"), F.lit(float(value)).alias("v"))


def circle(value: Column, cx: float, cy: float, r: float, paint: float) -> Column:
    """``paint`` up to ``r`` from the centre."""
    if r <= 0:
        raise ValueError("circle: the radius must be positive")
    dx, dy = F.col("x") - float(cx), F.col("y") - float(cy)
    return F.when(dx * dx + dy * dy <= float(r) * float(r), F.lit(float(paint))).otherwise(value)


def regular_polygon(value: Column, cx: float, cy: float, r: float, sides: int, paint: float) -> Column:
    """``paint`` inside the polygon whose corners are ``r`` from the centre, by folding angles onto one side."""
    if r <= 0 or sides < 3:
        raise ValueError("regular_polygon: the radius must be positive, and there are three sides at least")
    dx, dy = F.col("x") - float(cx), F.col("y") - float(cy)
    turn = 2 * math.pi / sides
    folded = F.pmod(F.atan2(dy, dx) + math.pi, F.lit(turn)) - math.pi / sides
    edge = r * math.cos(math.pi / sides) / F.greatest(F.cos(folded), F.lit(1e-9))
    return F.when(F.sqrt(dx * dx + dy * dy) <= edge, F.lit(float(paint))).otherwise(value)
