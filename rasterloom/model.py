"""The data model: voxel tables, their domain, and sequences.

A set of images is one DataFrame with ``image_id, x, y, z`` and a value in ``v`` (boolean for masks);
flat images have z = 0. Point-wise operators are Column expressions over one such row, so a chain of
them is one projection. A sequence is a DataFrame with ``idx, value``, or an array column.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["image_id"]
COORDS = ["x", "y", "z"]
VOXEL = [*KEY, *COORDS]


@dataclass(frozen=True)
class Domain:
    """The grid that the images of a set share: voxels along each axis, and the distance between them."""

    size: tuple[int, int, int]
    spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)

    @property
    def flat(self) -> bool:
        return self.size[2] == 1

    @property
    def axes(self) -> list[str]:
        """The axes along which there is more than one voxel."""
        return [c for c, n in zip(COORDS, self.size) if n > 1]

    def step(self, axis: str) -> float:
        return self.spacing[COORDS.index(axis)]

    def length(self, axis: str) -> int:
        return self.size[COORDS.index(axis)]


def raster(table: DataFrame, key: str, values: str, domain: Domain) -> DataFrame:
    """Voxels of an array column, x fastest and z slowest; only the two columns are read."""
    at = F.col("pos")
    wide, high = domain.size[0], domain.size[1]
    rows = table.select(F.col(key).alias("image_id"), F.posexplode(values).alias("pos", "held"))
    return rows.select("image_id", (at % wide).cast("int").alias("x"), (F.floor(at / wide) % high).cast("int").alias("y"), F.floor(at / (wide * high)).cast("int").alias("z"), F.col("held").cast("double").alias("v"))


def packed(voxels: DataFrame, value: str = "v") -> DataFrame:
    """``image_id, values``: the values of each image as an array, x fastest and z slowest."""
    rows = voxels.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("z", "y", "x", F.col(value).alias("v")))).alias("rows"))
    return rows.select("image_id", F.transform("rows", lambda r: r["v"]).alias("values"))


def by_image(voxels: DataFrame) -> DataFrame:
    """Voxels dealt out by image, once: windows and aggregates of an image need no shuffle after that."""
    return voxels.repartition("image_id")


def mask(value: Column) -> Column:
    """A mask as 0 and 1, null as 0."""
    return F.coalesce(value.cast("boolean"), F.lit(False))
