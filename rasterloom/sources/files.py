"""Files as sequences and images: ``load``, ``dir``, decoders of NIfTI-1, MetaImage and PNM."""

from __future__ import annotations

import gzip
import json
import re
import struct
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.model import Domain
from rasterloom.sources import formats

VOXELS = "path string, image_id long, x int, y int, z int, v double"


def load(spark: SparkSession, path: str) -> DataFrame | object:
    """JSON is parsed; the lines of .txt and .csv are ``idx, value`` as they are; other files are bytes.

    Lines are numbered by file and offset with one pass that counts the lines of each part.
    """
    suffix = Path(path).suffix.lower()
    if suffix == ".json":
        return json.loads("\n".join(r[0] for r in spark.read.option("wholetext", "true").text(path).collect()))
    if suffix in (".txt", ".csv"):
        return lines(spark, path)
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def lines(spark: SparkSession, path: str) -> DataFrame:
    """``idx, value`` of the lines of a file, in order."""
    from rasterloom.operators.sequence import renumbered

    # the id holds the number of the partition and the place in it: in order, with gaps
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("idx"), "value")
    return renumbered(rows, 1 << 33)


def directory(root: str, glob: str = "*", recursive: bool = False, full: bool = False) -> list[str]:
    """Sorted names of files and folders below ``root``; whole resolved paths if ``full``."""
    base = Path(root)
    if not base.is_dir():
        raise FileNotFoundError(root)
    found = base.rglob(glob) if recursive else base.glob(glob)
    return sorted(str(p.resolve()) if full else p.name for p in found)


def listing(spark: SparkSession, root: str, glob: str = "*", recursive: bool = False) -> DataFrame:
    """``path, length`` of files below ``root`` in any store that Spark reads; contents aren't read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(root).select("path", "length")


# decoders: bytes to an array with the axes z, y, x and the spacing of x, y, z
def nifti(raw: bytes) -> tuple[np.ndarray, tuple[float, float, float]]:
    """A NIfTI-1 image; intensities are scaled as the header says."""
    raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
    end = "<" if struct.unpack("<i", raw[:4])[0] == 348 else ">"
    dim = struct.unpack(end + "8h", raw[40:56])
    kind, step = struct.unpack(end + "h", raw[70:72])[0], struct.unpack(end + "8f", raw[76:108])
    offset, slope, shift = struct.unpack(end + "3f", raw[108:120])
    #: Data types of the format.
    kinds = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}
    if kind not in kinds:
        raise ValueError(f"NIfTI data type {kind} is not supported")
    size = [max(1, n) for n in dim[1:4]]
    data = np.frombuffer(raw, end + kinds[kind], int(np.prod(size)), int(offset)).reshape(size[::-1]).astype(float)
    return data * slope + shift if slope not in (0.0, 1.0) or shift else data, tuple(abs(s) or 1.0 for s in step[1:4])  # type: ignore[return-value]


def metaimage(raw: bytes) -> tuple[np.ndarray, tuple[float, float, float]]:
    """A MetaImage whose data follow the header, compressed or not."""
    m = re.search(rb"ElementDataFile\s*=\s*LOCAL\s*?\n", raw)
    if not m:
        raise ValueError("only MetaImage files that hold their data are supported")
    head = dict(line.split("=", 1) for line in raw[: m.end()].decode("latin-1").splitlines() if "=" in line)
    head = {k.strip(): v.strip() for k, v in head.items()}
    #: Element types of the format.
    kinds = {"MET_UCHAR": "u1", "MET_CHAR": "i1", "MET_SHORT": "i2", "MET_USHORT": "u2", "MET_INT": "i4", "MET_UINT": "u4", "MET_FLOAT": "f4", "MET_DOUBLE": "f8"}
    size = [int(n) for n in head["DimSize"].split()]
    step = [float(s) for s in head.get("ElementSpacing", head.get("ElementSize", " ".join("1" for _ in size))).split()]
    body = raw[m.end() :]
    body = zlib.decompress(body) if head.get("CompressedData", "False") == "True" else body
    end = ">" if head.get("BinaryDataByteOrderMSB", head.get("ElementByteOrderMSB", "False")) == "True" else "<"
    size, step = [*size, 1, 1][:3], [*step, 1.0, 1.0][:3]
    return np.frombuffer(body, end + kinds[head["ElementType"]], int(np.prod(size))).reshape(size[::-1]).astype(float), tuple(step)  # type: ignore[return-value]


def pnm(raw: bytes) -> tuple[np.ndarray, tuple[float, float, float]]:
    """A binary grey PNM image."""
    m = re.match(rb"P5\s+(?:#[^\n]*\n)*(\d+)\s+(\d+)\s+(\d+)\s", raw)
    if not m:
        raise ValueError("only binary grey PNM images are supported")
    wide, high, top = map(int, m.groups())
    return np.frombuffer(raw, "u1" if top < 256 else ">u2", wide * high, m.end()).reshape(1, high, wide).astype(float), (1.0, 1.0, 1.0)


DECODERS = {".nii": nifti, ".nii.gz": nifti, ".mha": metaimage, ".pgm": pnm, ".png": formats.png, ".nrrd": formats.nrrd, ".tif": formats.tiff, ".tiff": formats.tiff, ".vtk": formats.vtk, ".bmp": formats.bmp, ".dcm": formats.dicom}


def decoded(path: str, raw: bytes) -> tuple[np.ndarray, tuple[float, float, float]]:
    """The image in a file, by the suffix of its path."""
    for suffix, f in DECODERS.items():
        if path.lower().endswith(suffix):
            return f(raw)
    raise ValueError(f"no decoder for {path}")


def read_images(spark: SparkSession, path: str, size: tuple[int, int, int] | None = None, channels: int = 1) -> DataFrame:
    """``path, image_id, x, y, z, v`` of all image files that ``path`` names; ids are hashes of the paths.

    Each file is decoded by one task, which passes its voxels on slice by slice. With ``size`` an image
    of another grid is an error. Vector pixels of ``channels`` numbers are arrays.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, key, raw in zip(*(c.to_pylist() for c in batch.columns)):
                data, _ = decoded(name, raw)
                if size is not None and data.shape[2::-1] != tuple(size):
                    raise ValueError(f"{name} has the grid {data.shape[2::-1]}, not {tuple(size)}")
                if (data.shape[3] if data.ndim == 4 else 1) != channels:
                    raise ValueError(f"{name} has another number of channels than {channels}")
                y, x = (a.ravel().astype(np.int32) for a in np.indices(data.shape[1:3]))
                for z, plane in enumerate(data):
                    n = len(x)
                    v = pa.array(plane.ravel()) if channels == 1 else pa.array(plane.reshape(n, -1).tolist(), pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_pydict({"path": pa.array([name] * n), "image_id": pa.array([key] * n, pa.int64()), "x": pa.array(x), "y": pa.array(y), "z": pa.array(np.full(n, z, np.int32)), "v": v})

    files = spark.read.format("binaryFile").load(path).select("path", F.xxhash64("path").alias("id"), "content")
    return files.mapInArrow(run, VOXELS if channels == 1 else VOXELS.replace("v double", "v array<double>"))


def grid_of(spark: SparkSession, path: str) -> tuple[Domain, int]:
    """The grid of the first image that ``path`` names, and the numbers of its pixels."""
    name, raw = spark.read.format("binaryFile").load(path).select("path", "content").first()
    data, spacing = decoded(name, bytes(raw))
    return Domain(tuple(data.shape[2::-1]), spacing), data.shape[3] if data.ndim == 4 else 1  # type: ignore[arg-type]


def domain_of(spark: SparkSession, path: str) -> Domain:
    """The grid of the first image that ``path`` names."""
    return grid_of(spark, path)[0]
