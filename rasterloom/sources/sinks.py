"""Writing values and images: ``save``, result tables by content hash, and image encoders."""

from __future__ import annotations

import gzip
import json
import pickle
import struct
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from rasterloom.model import Domain
from rasterloom.sources import formats


def save(path: str, value: object) -> None:
    """Write a value by suffix: JSON, pickle, else its text; a DataFrame is written as Parquet, or as JSON lines for .json."""
    if isinstance(value, DataFrame):
        writer = value.write.mode("overwrite")
        writer.json(path) if path.endswith(".json") else writer.parquet(path)
        return
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    if target.suffix == ".json":
        target.write_text(json.dumps(value))
    elif target.suffix in (".pkl", ".pickle", ".bin"):
        target.write_bytes(pickle.dumps(value))
    else:
        target.write_text(str(value))


class Store:
    """Results as Parquet below one folder, each named by the content hash of the node that made it."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, node_id: str) -> str:
        return f"{self.root}/node_id={node_id}"

    def there(self, path: str) -> bool:
        """Whether a file is there, in any store that Spark reads."""
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return fs_path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(fs_path)

    def get(self, node_id: str) -> DataFrame | None:
        """The result, if it was written to its end."""
        return self.spark.read.parquet(self.path(node_id)) if self.there(self.path(node_id) + "/_SUCCESS") else None

    def find(self, node_id: str) -> tuple[dict, DataFrame] | None:
        """What was noted about a result, and the result, if both were written to their ends."""
        if not self.there(f"{self.path(node_id)}.about/_SUCCESS"):
            return None
        df = self.get(node_id)
        return None if df is None else (json.loads(self.spark.read.text(f"{self.path(node_id)}.about").first()[0]), df)

    def put(self, node_id: str, df: DataFrame, about: dict | None = None) -> DataFrame:
        """Write a result, then what is noted about it, and return what reads it."""
        df.write.mode("overwrite").parquet(self.path(node_id))
        self.spark.createDataFrame([(json.dumps(about or {}),)], "about string").coalesce(1).write.mode("overwrite").text(f"{self.path(node_id)}.about")
        return self.spark.read.parquet(self.path(node_id))


def to_nifti(grid: np.ndarray, spacing: tuple[float, float, float]) -> bytes:
    """A NIfTI-1 file of doubles; the axes of ``grid`` are z, y, x."""
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, 3, *grid.shape[::-1], 1, 1, 1, 1)
    struct.pack_into("<2h", head, 70, 64, 64)
    struct.pack_into("<8f", head, 76, 1.0, *spacing, 1.0, 1.0, 1.0, 1.0)
    struct.pack_into("<3f", head, 108, 352.0, 1.0, 0.0)
    head[344:348] = b"n+1\0"
    return bytes(head) + np.ascontiguousarray(grid, "<f8").tobytes()


def to_metaimage(grid: np.ndarray, spacing: tuple[float, float, float]) -> bytes:
    """A MetaImage of doubles that holds its data."""
    size = " ".join(map(str, grid.shape[::-1]))
    head = f"ObjectType = Image\nNDims = 3\nBinaryData = True\nBinaryDataByteOrderMSB = False\nCompressedData = False\nElementSpacing = {' '.join(map(str, spacing))}\nDimSize = {size}\nElementType = MET_DOUBLE\nElementDataFile = LOCAL\n"
    return head.encode() + np.ascontiguousarray(grid, "<f8").tobytes()


def to_pnm(grid: np.ndarray) -> bytes:
    """A grey PNM image of the middle slice; values are cut to 0 to 255."""
    plane = np.clip(grid[grid.shape[0] // 2], 0, 255).astype("u1")
    return b"P5 %d %d 255\n" % plane.shape[::-1] + plane.tobytes()


ENCODERS = {".nii": to_nifti, ".nii.gz": to_nifti, ".mha": to_metaimage, ".pgm": lambda grid, spacing: to_pnm(grid), ".png": formats.to_png, ".nrrd": formats.to_nrrd, ".tif": formats.to_tiff, ".tiff": formats.to_tiff, ".vtk": formats.to_vtk}


def suffix_of(path: str) -> str | None:
    """The suffix of an image format that is written, by the path's end."""
    return next((x for x in sorted(ENCODERS, key=len, reverse=True) if path.lower().endswith(x)), None)


def write_bytes(path: str, raw: bytes) -> None:
    """Write a file: to a local path, or to a store that Arrow's file systems know by the path's scheme."""
    if "://" in path:
        from pyarrow import fs

        store, place = fs.FileSystem.from_uri(path)
        store.create_dir(place.rpartition("/")[0], recursive=True)
        with store.open_output_stream(place) as out:
            out.write(raw)
        return
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_bytes(raw)


def write_images(voxels: DataFrame, folder: str, domain: Domain, suffix: str = ".nii.gz", name: str | None = None) -> DataFrame:
    """Write each image to ``folder/<image_id><suffix>`` from the task that holds it; ``image_id, path`` when it is run.

    ``folder`` must be one that all executors reach: a shared path, or a URI. With ``name`` the files
    are ``<name>-<image_id><suffix>``. Vector pixels are arrays of equal length.
    """
    size, spacing = domain.size, domain.spacing

    def one(part: pd.DataFrame) -> pd.DataFrame:
        values = np.array(part["v"].tolist(), float)
        grid = np.zeros((*size[::-1], *values.shape[1:]))
        grid[part["z"], part["y"], part["x"]] = values
        path = f"{folder}/{f'{name}-' if name else ''}{part['image_id'].iloc[0]}{suffix}"
        raw = ENCODERS[suffix](grid, spacing)
        write_bytes(path, gzip.compress(raw) if suffix.endswith(".gz") else raw)
        return pd.DataFrame({"image_id": [part["image_id"].iloc[0]], "path": [path]})

    return voxels.groupBy("image_id").applyInPandas(one, "image_id long, path string")


def write_image(voxels: DataFrame, path: str, domain: Domain) -> list[str]:
    """Write the images of a program to ``path``: one under its name, several with their ids before the suffix."""
    suffix = suffix_of(path)
    if suffix is None:
        raise ValueError(f"no encoder for {path}")
    folder, _, last = path.rpartition("/")
    ids = [r[0] for r in voxels.select("image_id").distinct().limit(2).collect()]
    if len(ids) != 1:
        return sorted(r.path for r in write_images(voxels, folder or ".", domain, suffix, last[: -len(suffix)]).collect())
    rows = voxels.select("x", "y", "z", "v").toArrow()  # one image, which is written to one file
    values = np.array(rows["v"].to_pylist(), float)
    grid = np.zeros((*domain.size[::-1], *values.shape[1:]))
    grid[rows["z"].to_numpy(), rows["y"].to_numpy(), rows["x"].to_numpy()] = values
    raw = ENCODERS[suffix](grid, domain.spacing)
    write_bytes(path, gzip.compress(raw) if suffix.endswith(".gz") else raw)
    return [path]


def pages(df: DataFrame, size: int) -> Iterator[list]:
    """Rows in lists of at most ``size``, in the table's order, one partition on the driver at a time."""
    held: list = []
    for row in df.toLocalIterator():
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held
