"""Image filters of the ``simpleitk`` namespace beyond those that the language has itself, on the package's operators.

Masks that filters give are numbers, 1 and 0. Point-wise filters are columns, so that a chain of them is
one projection; the others are those of neighbourhoods, components and distances.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.model import VOXEL, Domain
from rasterloom.operators import derived, spatial, stats, voxel
from rasterloom.plans.engine import Frame, Image, by_image, column, divided, extended, frame_of, pointwise, primitive
from rasterloom.plans.syntax import LanguageError

#: Names of pixel types, in the order of their numbers.
PIXELS = "sitkInt8 sitkUInt8 sitkInt16 sitkUInt16 sitkInt32 sitkUInt32 sitkInt64 sitkUInt64 sitkFloat32 sitkFloat64".split()


def pixel_id(name: str) -> int:
    """The number of a pixel type."""
    if name not in PIXELS:
        raise LanguageError("E_VALUE", f"no pixel type {name}")
    return PIXELS.index(name)


def cast(v: Any, kind: float) -> Any:
    """A value as a pixel type holds it: whole numbers drop the fraction and wrap around, 32-bit floats are rounded."""
    name = PIXELS[int(kind)] if 0 <= int(kind) < len(PIXELS) else ""
    if not name:
        raise LanguageError("E_VALUE", f"no pixel type {kind}")
    x = number(v)
    if name == "sitkFloat64":
        return x
    if name == "sitkFloat32":
        return x.cast("float").cast("double")
    bits = int(name.lstrip("sitkUIn"))
    whole = F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("decimal(38,0)")
    low = 0 if "UInt" in name else 1 << (bits - 1)
    return (F.pmod(whole + F.lit(low).cast("decimal(38,0)"), F.lit(1 << bits).cast("decimal(38,0)")) - F.lit(low).cast("decimal(38,0)")).cast("double")


def number(v: Any) -> Column:
    return (v if isinstance(v, Column) else F.lit(v)).cast("double")


def whole(v: Any) -> Column:
    return number(v).cast("bigint")


def flag(on: Column, a: Any = 1, b: Any = 0) -> Column:
    return F.when(on, number(a)).otherwise(number(b))


def on(v: Any) -> Column:
    return number(v) != 0


#: Filters of one image.
ONE: dict[str, Callable[[Column], Column]] = {
    "Abs": F.abs, "Acos": F.acos, "Asin": F.asin, "Atan": F.atan, "Cos": F.cos, "Sin": F.sin, "Tan": F.tan, "Exp": F.exp, "Log": F.log, "Log10": F.log10, "Sqrt": F.sqrt,
    "ExpNegative": lambda v: F.exp(-v), "Square": lambda v: v * v, "UnaryMinus": lambda v: -v, "BoundedReciprocal": lambda v: 1 / (1 + F.abs(v)), "Not": lambda v: flag(v == 0), "BinaryNot": lambda v: flag(v == 0), "VectorMagnitude": F.abs,
}
#: Filters of two images, or of an image and a number.
TWO: dict[str, Callable[[Column, Column], Column]] = {
    "Add": lambda a, b: a + b, "Subtract": lambda a, b: a - b, "Multiply": lambda a, b: a * b, "Divide": divided, "DivideReal": divided, "DivideFloor": lambda a, b: F.floor(divided(a, b)).cast("double"),
    "Maximum": F.greatest, "Minimum": F.least, "Modulus": lambda a, b: F.try_mod(a, b), "Pow": F.pow, "Atan2": F.atan2, "SquaredDifference": lambda a, b: (a - b) * (a - b), "AbsoluteValueDifference": lambda a, b: F.abs(a - b),
    "And": lambda a, b: whole(a).bitwiseAND(whole(b)).cast("double"), "Or": lambda a, b: whole(a).bitwiseOR(whole(b)).cast("double"), "Xor": lambda a, b: whole(a).bitwiseXOR(whole(b)).cast("double"),
}
#: Comparisons, with the numbers for yes and no after the two that are compared.
COMPARE: dict[str, Callable[[Column, Column], Column]] = {
    "Equal": lambda a, b: a == b, "NotEqual": lambda a, b: a != b, "Greater": lambda a, b: a > b, "GreaterEqual": lambda a, b: a >= b, "Less": lambda a, b: a < b, "LessEqual": lambda a, b: a <= b,
}

for _name, _f in ONE.items():
    primitive(f"simpleitk:{_name}", 1, lift=True)(lambda v, f=_f: f(number(v)))
for _name, _f in TWO.items():
    primitive(f"simpleitk:{_name}", 2, lift=True)(lambda a, b, f=_f: f(number(a), number(b)))
for _name, _f in COMPARE.items():
    primitive(f"simpleitk:{_name}", 2, 4, lift=True)(lambda a, b, yes=1, no=0, f=_f: flag(f(number(a), number(b)), yes, no))

primitive("simpleitk:Cast", 2)(lambda x, kind: pointwise(lambda v: cast(v, kind), x))
primitive("simpleitk:GetPixelIDValueFromString", 1)(pixel_id)
primitive("simpleitk:Mask", 2, 4, lift=True)(lambda v, m, outside=0, value=0: F.when(number(m) != number(value), number(v)).otherwise(number(outside)))
primitive("simpleitk:MaskNegated", 2, 4, lift=True)(lambda v, m, outside=0, value=0: F.when(number(m) == number(value), number(v)).otherwise(number(outside)))
primitive("simpleitk:Clamp", 1, 4)(lambda x, kind=9, low=-1e308, high=1e308: pointwise(lambda v: cast(F.greatest(number(low), F.least(number(high), number(v))), kind), x))
primitive("simpleitk:Threshold", 1, 4, lift=True)(lambda v, low=0, high=1, outside=0: F.when(number(v).between(number(low), number(high)), number(v)).otherwise(number(outside)))
primitive("simpleitk:InvertIntensity", 1, 2, lift=True)(lambda v, most=255: number(most) - number(v))
primitive("simpleitk:ShiftScale", 1, 3, lift=True)(lambda v, shift=0, scale=1: (number(v) + number(shift)) * number(scale))
primitive("simpleitk:Sigmoid", 1, 5, lift=True)(lambda v, alpha=1, beta=0, most=255, least=0: (number(most) - number(least)) / (1 + F.exp(-(number(v) - number(beta)) / number(alpha))) + number(least))
primitive("simpleitk:Compose", 2, None, lift=True)(lambda *vs: F.array(*map(number, vs)))
primitive("simpleitk:VectorIndexSelectionCast", 1, 3)(lambda x, k=0, kind=9: pointwise(lambda v: cast(F.get(v, F.lit(int(k))), kind), x))


@primitive("simpleitk:IntensityWindowing", 1, 5, lift=True)
def intensity_windowing(v: Any, low: float = 0, high: float = 255, least: float = 0, most: float = 255) -> Column:
    """A window of values spread over another; values beyond it are cut to its ends."""
    x = F.greatest(number(low), F.least(number(high), number(v)))
    return (x - number(low)) * ((number(most) - number(least)) / (number(high) - number(low))) + number(least)


@primitive("simpleitk:Normalize", 1)
def normalize(x: Image) -> Image:
    """Values with mean 0 and variance 1 over each image."""
    return pointwise(lambda v, mean, dev: F.try_divide(number(v) - mean, dev), x, by_image(F.avg)(x), by_image(F.stddev_samp)(x))


def sizes(x: Any) -> list[int]:
    """Numbers for the axes x, y and z, from a sequence or one number for each."""
    return [*map(int, x), 0, 0][:3] if isinstance(x, (list, tuple)) else [int(x)] * 3


@primitive("simpleitk:Crop", 1, 3)
def crop(x: Image, low: Any = 0, high: Any = 0) -> Image:
    """An image without so many voxels at the lower and the upper end of each axis."""
    size, a, b = x.frame.domain.size, sizes(low), sizes(high)
    a, b = ([n if s > 1 else 0 for n, s in zip(v, size)] for v in (a, b))
    left = [s - p - q for s, p, q in zip(size, a, b)]
    if min(left) < 1:
        raise LanguageError("E_VALUE", "Crop leaves no voxel")
    return Image(Frame(voxel.extract(x.result(), left, a), Domain(tuple(left), x.frame.domain.spacing)), F.col("v"))


@primitive("simpleitk:RegionOfInterest", 3)
def region(x: Image, size: Any, index: Any) -> Image:
    box = [max(1, n) for n in sizes(size)]
    return Image(Frame(voxel.extract(x.result(), box, sizes(index)), Domain(tuple(box), x.frame.domain.spacing)), F.col("v"))


@primitive("simpleitk:ConstantPad", 1, 4)
def pad(x: Image, low: Any = 0, high: Any = 0, value: float = 0.0) -> Image:
    """An image with so many voxels of a value before and after each axis; each image brings its own border."""
    d = x.frame.domain
    a, b = ([n if s > 1 else 0 for n, s in zip(sizes(v), d.size)] for v in (low, high))
    size = tuple(s + p + q for s, p, q in zip(d.size, a, b))
    moved = x.result().select("image_id", *[(F.col(c) + n).alias(c) for c, n in zip("xyz", a)], F.col("v").cast("double").alias("v"))
    spans = [F.sequence(F.lit(0), F.lit(n - 1)) for n in size]
    rows = x.frame.df.select("image_id").distinct()
    for c, span in zip("xyz", spans):
        rows = rows.withColumn(c, F.explode(span))
    inside = F.lit(True)
    for c, n, s in zip("xyz", a, d.size):
        inside = inside & F.col(c).between(n, n + s - 1)
    border = rows.where(~inside).withColumn("v", F.lit(float(value)))
    return Image(Frame(moved.unionByName(border).repartition("image_id"), Domain(size, d.spacing)), F.col("v"))


def _masked(f: Callable[..., DataFrame], x: Any) -> Image:
    return extended(f)(pointwise(on, x))


@primitive("simpleitk:ConnectedComponent", 1, 2)
def connected(x: Any, fully: Any = False) -> Image:
    """Component numbers; neighbours share a face unless ``fully`` is true."""
    return _masked(spatial.lcc if fully else spatial.lcc_by_faces, x)


primitive("simpleitk:BinaryDilate", 1, 2)(lambda x, r=1: pointwise(flag, _masked(lambda df, m, d, out: derived.dilate(df, m, max(sizes(r)) + 0.5, Domain(d.size), out), x)))
primitive("simpleitk:BinaryErode", 1, 2)(lambda x, r=1: pointwise(flag, _masked(lambda df, m, d, out: derived.erode(df, m, max(sizes(r)) + 0.5, Domain(d.size), out), x)))
primitive("simpleitk:GradientMagnitude", 1)(extended(spatial.gradient))


@primitive("simpleitk:SignedMaurerDistanceMap", 1, 4)
def signed_distance(x: Any, inside: Any = False, squared: Any = True, spaced: Any = False) -> Image:
    """Distance to the outline of what isn't 0; squared and in voxels unless it is said otherwise, negative inside unless ``inside``."""
    out = _masked(lambda df, m, d, out: spatial.dt(df, m, d if spaced else Domain(d.size), out), x)
    sign = -1.0 if inside else 1.0
    return pointwise(lambda v: v * F.abs(v) * sign if squared else v * sign, out)


@primitive("simpleitk:OtsuThreshold", 1, 4)
def otsu_threshold(x: Any, inside: float = 1, outside: float = 0, bins: float = 128) -> Image:
    """``inside`` up to the threshold, ``outside`` above it."""
    frame = frame_of([x])
    value = column(x, frame)

    def make(df: DataFrame, name: str) -> DataFrame:
        found = stats.otsu(df.withColumn("_x", number(value)), "_x", F.lit(True), int(bins))
        return df.join(found.withColumnRenamed("threshold", name), "image_id", "left")

    return Image(frame, flag(number(value) <= frame.add(make), inside, outside))
