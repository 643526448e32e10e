"""The primitives of the surface language, by namespace, bound to the package's operators."""

from __future__ import annotations

from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.functions import strings
from rasterloom.model import VOXEL, Domain
from rasterloom.operators import cases, derived, geometry, sequence, spatial, stats, trainers, voxel
from rasterloom.plans.engine import Closure, Engine, Frame, Generator, Image, PRIMITIVES, both, by_image, column, divided, either, extended, frame_of, needing, negated, pointwise, primitive
from rasterloom.plans.syntax import LanguageError
from rasterloom.sources import files, sinks

# scalars, items and voxels
for _names, _f in {
    "vox1:+ vox1:num_add vox1:.+. vox1:.+ vox1:+. vox1:add_vs default:addition": lambda a, b: a + b,
    "vox1:- vox1:num_sub vox1:.-. vox1:.- vox1:-. vox1:sub_vs vox1:sub_sv default:subtraction": lambda a, b: a - b,
    "vox1:* vox1:num_mul vox1:.*. vox1:.* vox1:*. vox1:mul_vs default:multiplication": lambda a, b: a * b,
    "vox1:/ vox1:num_div vox1:./. vox1:./ vox1:/. vox1:div_vs vox1:div_sv default:division": divided,
    "vox1:== default:num_eq vox1:.=. vox1:.= vox1:=. vox1:eq_sv": lambda a, b: a == b,
    "vox1:!= default:num_neq": lambda a, b: a != b,
    "vox1:<= default:num_leq vox1:.<=. vox1:<=.": lambda a, b: a <= b,
    "vox1:< default:num_lt vox1:.<. vox1:<.": lambda a, b: a < b,
    "vox1:>= default:num_geq vox1:.>=. vox1:>=.": lambda a, b: a >= b,
    "vox1:> default:num_gt vox1:.>. vox1:>.": lambda a, b: a > b,
    # a threshold before an image, from the image's side
    "vox1:.<= vox1:geq_sv": lambda k, v: v >= k,
    "vox1:.>= vox1:leq_sv": lambda k, v: v <= k,
    "vox1:.< ": lambda k, v: v > k,
    "vox1:.> ": lambda k, v: v < k,
    "default:bool_and_scalar vox1:bool_and_scalar vox1:and vox1:& vox1:.&.": both,
    "default:bool_or_scalar vox1:bool_or_scalar vox1:or vox1:| vox1:.|.": either,
    "vox1:mask": lambda v, m: F.when(m.cast("boolean"), v).otherwise(F.lit(0.0)),
    "vox1:\\": lambda a, b: both(a, negated(b)),
    "vox1:xor": lambda a, b: a.cast("boolean") != b.cast("boolean"),
}.items():
    primitive(_names.strip(), 2, lift=True)(_f)

primitive("default:not_compat default:not vox1:not vox1:! vox1:!. vox1:not_compat vox1:bool_not_scalar", 1, lift=True)(negated)
primitive("vox1:abs", 1, lift=True)(lambda v: F.abs(v) if isinstance(v, Column) else abs(v))
primitive("vox1:between", 3, lift=True)(lambda a, b, v: (v >= a) & (v <= b))
primitive("vox1:divZ", 3, lift=True)(voxel.div_z)
primitive("vox1:overlayB", 3, lift=True)(lambda m, a, b: F.when(m.cast("boolean"), b).otherwise(a))
primitive("vox1:red", 1, lift=True)(lambda v: F.get(v, F.lit(0)))
primitive("vox1:green", 1, lift=True)(lambda v: F.get(v, F.lit(1)))
primitive("vox1:blue", 1, lift=True)(lambda v: F.get(v, F.lit(2)))
primitive("vox1:alpha", 1, lift=True)(voxel.alpha)
primitive("vox1:rgb", 3, lift=True)(F.array)
primitive("vox1:rgba", 4, lift=True)(F.array)
primitive("arrays:threshold_equal", 2, 4, lift=True)(lambda v, t, a=1, b=0: F.when(v == t, a).otherwise(b))
primitive("simpleitk:BinaryThreshold", 2, 5, lift=True)(lambda v, lo, hi=255, a=1, b=0: F.when((v >= lo) & (v <= hi), F.lit(int(a) if not isinstance(a, Column) else a)).otherwise(F.lit(b)))


@primitive("vox1:intensity", 1)
def intensity(x: Image) -> Image:
    """Luma of vector pixels; other images as they are."""
    kind = x.frame.df.select(x.value.alias("v")).schema["v"].dataType.typeName()
    return Image(x.frame, voxel.intensity(x.value) if kind == "array" else x.value.cast("double"))


# generators
primitive("vox1:tt", 0)(lambda: Generator(lambda d: F.lit(True)))
primitive("vox1:ff", 0)(lambda: Generator(lambda d: F.lit(False)))
primitive("vox1:bconstant", 1)(lambda b: Generator(lambda d: F.lit(bool(b))))
primitive("vox1:constant", 1)(lambda k: k if isinstance(k, Image) else Generator(lambda d: F.lit(float(k))))
primitive("vox1:border", 0)(lambda: Generator(voxel.border))
for _axis in ("x", "y", "z"):
    primitive(f"vox1:{_axis}", 0)(lambda axis=_axis: Generator(lambda d: F.col(axis).cast("double")))

# whole images
primitive("vox1:max", 1)(by_image(lambda v: F.max(v)))
primitive("vox1:min", 1)(by_image(lambda v: F.min(v)))
primitive("vox1:volume vox1:vol", 1)(by_image(lambda m: F.sum(F.when(m.cast("int") > 0, 1.0).otherwise(0.0))))
primitive("simpleitk:MinimumMaximum", 1)(lambda x: [by_image(F.min)(x), by_image(F.max)(x)])
primitive("simpleitk:Statistics", 1)(lambda x: [by_image(f)(x) for f in (F.min, F.max, F.avg, F.stddev_samp, F.var_samp, F.sum, F.count)])


@primitive("vox1:avg", 2)
def avg(v: Any, m: Any) -> Image:
    """The mean on the mask; an empty mask is an error when the value is used."""
    out = by_image(lambda x, on: F.avg(F.when(on, x)))(v, m)
    return Image(out.frame, F.when(out.value.isNotNull(), out.value).otherwise(F.raise_error(F.lit("avg: the mask is empty")).cast("double")), True)


@primitive("vox1:avg0", 2)
def avg0(v: Any, m: Any) -> Image:
    out = by_image(lambda x, on: F.avg(F.when(on, x)))(v, m)
    return Image(out.frame, F.coalesce(out.value, F.lit(0.0)), True)


primitive("vox1:emptyB", 1)(lambda m: pointwise(lambda v: v == 0, PRIMITIVES["vox1"]["volume"].run(m)))
primitive("vox1:nemptyB", 1)(lambda m: pointwise(lambda v: v > 0, PRIMITIVES["vox1"]["volume"].run(m)))
primitive("vox1:eqB", 2)(lambda a, b: by_image(lambda p, q: F.bool_and(p == q))(a, b))
primitive("vox1:neqB", 2)(lambda a, b: by_image(lambda p, q: F.bool_or(p != q))(a, b))
primitive("vox1:leqB", 2)(lambda a, b: by_image(lambda p, q: F.bool_and(~p | q))(a, b))
primitive("vox1:norm", 2)(lambda k, x: pointwise(lambda v, top: F.try_divide(k * v, top), x, PRIMITIVES["vox1"]["max"].run(x)))
primitive("vox1:booleanToNumber", 2)(lambda k, m: pointwise(lambda v: F.when(v, F.lit(float(k))).otherwise(0.0), m))
primitive("vox1:ifB vox1:ifN", 3)(lambda cond, a, b: pointwise(lambda c, p, q: F.when(c, p).otherwise(q), cond, a, b) if isinstance(cond, (Image, Generator)) else a if cond else b)
primitive("vox1:overlayColor", 5)(lambda m, x, r, g, b: pointwise(lambda on, v, p, q, s: F.when(on, F.array(p, q, s).cast("array<double>")).otherwise(v), m, x, *map(float, (r, g, b))))
primitive("simpleitk:RescaleIntensity", 1, 3)(
    lambda x, lo=0.0, hi=255.0: pointwise(lambda v, a, b: lo + (v - a) * F.try_divide(F.lit(float(hi - lo)), b - a), x, by_image(F.min)(x), by_image(F.max)(x))
)

# neighbourhoods, components, distances
primitive("vox1:near vox1:N", 1)(extended(spatial.near))
primitive("vox1:interior vox1:I", 1)(extended(spatial.interior))
primitive("vox1:lcc vox1:Lcc", 1)(extended(spatial.lcc))
primitive("vox1:through", 2)(extended(spatial.through))
primitive("vox1:~>", 2)(lambda a, b: extended(spatial.through)(b, a))
primitive("vox1:maxvol", 1)(extended(spatial.maxvol))
primitive("vox1:dt", 1)(extended(spatial.dt))
primitive("vox1:gradient", 1)(extended(spatial.gradient))
primitive("vox1:B+", 1)(extended(derived.external_boundary))
primitive("vox1:mayReach", 2)(extended(derived.may_reach))
primitive("vox1:touch vox1:T", 2)(extended(derived.touch))
primitive("vox1:grow", 2)(extended(derived.grow))
primitive("vox1:surrounded vox1:S", 2)(extended(derived.surrounded))
primitive("vox1:pdt", 1)(extended(derived.pdt))
primitive("vox1:distgeq", 2)(lambda r, m: extended(lambda df, on, d, out: derived.dist_geq(df, r, on, d, out))(m))
primitive("vox1:distleq", 2)(lambda r, m: extended(lambda df, on, d, out: derived.dist_leq(df, r, on, d, out))(m))
primitive("vox1:smoothen", 2)(extended(derived.smoothen))
primitive("vox1:erode", 2)(extended(derived.erode))
primitive("vox1:dilate", 2)(extended(derived.dilate))
primitive("vox1:imopen", 2)(extended(derived.imopen))
primitive("vox1:imclose", 2)(extended(derived.imclose))
primitive("simpleitk:CurvatureFlow", 3)(extended(lambda df, v, step, rounds, d, out: spatial.curvature_flow(df, v, d, float(step), int(rounds), out)))


@primitive("vox1:percentiles", 3)
def percentiles(x: Any, m: Any, ties: float) -> Image:
    frame = frame_of([x, m])
    value, mask = column(x, frame), column(m, frame)
    return Image(frame, frame.add(lambda df, name: df.withColumn(name, stats.percentiles(df, value, mask, ties))))


@primitive("vox1:otsu", 3)
def otsu(x: Any, m: Any, bins: float) -> Image:
    """Voxels of the mask above its threshold."""
    frame = frame_of([x, m])
    value, mask = column(x, frame), column(m, frame)

    def make(df: DataFrame, name: str) -> DataFrame:
        found = stats.otsu(df.withColumns({"_x": value, "_m": mask}), "_x", F.col("_m"), int(bins))
        return df.join(found.withColumnRenamed("threshold", name), "image_id", "left")

    return Image(frame, F.coalesce(mask & (value > frame.add(make)), F.lit(False)))


@primitive("vox1:crossCorrelation", 7)
def cross_correlation(r: float, a: Any, b: Any, fb: Any, low: Any, high: Any, bins: float) -> Image:
    frame = frame_of([a, b])
    values = [column(v, frame) for v in (a, b, fb, low, high)]
    return Image(frame, frame.add(lambda df, name: stats.cross_correlation(df, frame.domain, float(r), *values, int(bins), name)))


@primitive("vox1:~", 4)
def similar(a: Any, b: Any, r: float, bins: float) -> Image:
    """Local correlation with the whole histogram of ``b``."""
    return cross_correlation(r, a, b, Generator(lambda d: F.lit(True)), by_image(F.min)(b), by_image(F.max)(b), bins)


@primitive("vox1:maskCC", 2)
def mask_cc(phi1: Any, phi2: Any) -> Image:
    return pointwise(lambda label, on: F.when(on, label).otherwise(0), extended(spatial.lcc)(phi2), phi1)


@primitive("vox1:collect", 2)
def collect(phi1: Any, phi2: Any) -> Image:
    """Whether ``phi1`` is empty or inside one component of ``phi2``."""
    label = extended(spatial.lcc)(phi2)
    low, high = (by_image(lambda n, on, f=f: f(F.when(on, n)))(label, phi1) for f in (F.min, F.max))
    return pointwise(lambda a, b: F.coalesce((a == b) & (a > 0), F.lit(True)), low, high)


primitive("vox1:minCC", 2)(lambda a, b: by_image(lambda n, on: F.min(F.when(on, n)))(extended(spatial.lcc)(b), a))
primitive("vox1:maxCC", 2)(lambda a, b: by_image(lambda n, on: F.max(F.when(on, n)))(extended(spatial.lcc)(b), a))


@primitive("vox1:extract simpleitk:Extract", 3)
def extract(x: Image, size: list[float], index: list[float]) -> Image:
    sizes, first = [int(v) for v in size], [int(v) for v in index]
    sizes, first = [*sizes, 1, 1][:3], [*first, 0, 0][:3]
    box = voxel.extract(x.result(), sizes, first)
    return Image(Frame(box, Domain(tuple(max(1, n) for n in sizes), x.frame.domain.spacing)), F.col("v"))


# measures of two label images
def _measure(f: Any) -> Any:
    def run(a: Any, b: Any, *rest: float) -> DataFrame:
        frame = frame_of([a, b])
        p, q = column(a, frame), column(b, frame)
        return f(frame.df.select("image_id", p.alias("a"), q.alias("b")), *rest)

    return run


def _register_measures() -> None:
    from rasterloom.operators import metrics

    primitive("arrays:pixel_accuracy", 2)(_measure(metrics.pixel_accuracy))
    primitive("arrays:confusion_matrix", 2, 3)(_measure(lambda df, n=2: metrics.confusion_matrix(df, int(n))))
    primitive("arrays:dice_score", 2, 3)(_measure(lambda df, label=1: metrics.overlap(df, label).select("image_id", "dice")))
    primitive("arrays:jaccard_index", 2, 3)(_measure(lambda df, label=1: metrics.overlap(df, label).select("image_id", "jaccard")))
    primitive("arrays:compare_arrays", 2)(_measure(metrics.compare_arrays))


_register_measures()
primitive("arrays:array_stats", 1)(lambda x: stats.array_stats(x.result()))
primitive("arrays:count_pixels", 1, 2)(lambda x, of=None: stats.count_pixels(x.result(), F.col("v"), of))
primitive("arrays:vector_uint32", 1, kind="sequence")(lambda xs: [int(v) % (1 << 32) for v in xs])
primitive("arrays:vector_double", 1, kind="sequence")(lambda xs: [float(v) for v in xs])

# sequences
primitive("default:sequence", 0, None, "sequence")(lambda *xs: list(xs))


@primitive("default:range", 1, 2, "sequence")
@needing
def range_(start: Any, stop: Any = None, engine: Engine | None = None) -> Any:
    """Whole numbers; long ranges are tables."""
    start, stop = (0, start) if stop is None else (start, stop)
    low, high = sequence.whole(start, "range"), sequence.whole(stop, "range")
    if high - low > 100_000 and engine is not None:
        return sequence.table_range(engine.spark, low, high)
    return list(range(low, high))


def _over(xs: Any, f: Closure, engine: Engine) -> Any:
    if isinstance(xs, DataFrame):
        return sequence.table_map(xs, lambda v: _as_column(engine.apply(f, v)))
    return [engine.apply(f, x) for x in xs]


def _as_column(x: Any) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


@primitive("default:map default:for_loop default:dask_map", 2, kind="sequence")
@needing
def map_(xs: Any, f: Closure, engine: Engine) -> Any:
    return _over(xs, f, engine)


@primitive("default:filter", 2, kind="sequence")
@needing
def filter_(xs: Any, f: Closure, engine: Engine) -> Any:
    if isinstance(xs, DataFrame):
        return sequence.table_filter(xs, lambda v: _as_column(engine.apply(f, v)))
    return [x for x in xs if engine.apply(f, x)]


@primitive("default:index", 2)
def index(xs: Any, i: Any) -> Any:
    at = sequence.whole(i, "index")
    if at < 0:
        raise LanguageError("E_INDEX", "negative index")
    if isinstance(xs, DataFrame):
        found = xs.where(F.col("idx") == at).first()
        if found is None:
            raise LanguageError("E_INDEX", "index out of range")
        return found.value
    items = list(xs)
    if at >= len(items):
        raise LanguageError("E_INDEX", "index out of range")
    return items[at]


@primitive("default:slice", 3, kind="sequence")
def slice_(xs: Any, low: Any, high: Any) -> Any:
    if isinstance(xs, DataFrame):
        return sequence.table_slice(xs, low, high)
    first = max(0, sequence.whole(low or 0, "slice"))
    last = len(xs) if high is None else sequence.whole(high, "slice")
    return list(xs)[first : max(first, last)]


@primitive("default:subsequence", 2, 3, "sequence")
def subsequence(xs: Any, start: Any, stop: Any = None) -> Any:
    start, stop = (0, start) if stop is None else (start, stop)
    return slice_(xs, max(0, sequence.whole(start, "subsequence")), max(0, sequence.whole(stop, "subsequence")))


@primitive("default:argmax", 1)
def argmax(xs: Any) -> int:
    if isinstance(xs, DataFrame):
        found = sequence.table_argmax(xs.withColumn("_g", F.lit(0)), ["_g"]).first()
        items = [] if found is None else [found.argmax]
        if items:
            return items[0]
    elif xs:
        return max(range(len(xs)), key=lambda k: (xs[k], -k))
    raise LanguageError("E_EMPTY", "argmax of an empty sequence")


@primitive("default:fold", 1, 2)
@needing
def fold(xs: Any, init: Any = None, operator: str = "+", engine: Engine | None = None) -> Any:
    """A left fold over items, which may be sequences or images."""
    if isinstance(xs, DataFrame):
        return sequence.table_fold(xs, operator, init).first().value
    ops = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": divided, "&&": both, "||": either, "min": _least, "max": _most}
    start = {"+": 0.0, "-": 0.0, "*": 1.0, "&&": True, "||": False}
    items = list(xs)
    if init is None:
        if operator in start:
            init = start[operator]
        elif not items or operator == "/":
            raise LanguageError("E_EMPTY", f"fold {operator} needs an initial value here")
        else:
            init, items = items[0], items[1:]
    for x in items:
        init = pointwise(ops[operator], init, x)
    return init


def _least(a: Any, b: Any) -> Any:
    return F.least(_as_column(a), _as_column(b)) if isinstance(a, Column) or isinstance(b, Column) else min(a, b)


def _most(a: Any, b: Any) -> Any:
    return F.greatest(_as_column(a), _as_column(b)) if isinstance(a, Column) or isinstance(b, Column) else max(a, b)


# files, strings, drawing
@primitive("default:load", 1, kind="dataset")
@needing
def load(path: Any, engine: Engine) -> Any:
    return list(path) if isinstance(path, (list, tuple)) else files.load(engine.spark, path)


@primitive("default:dir", 1, 4, "sequence")
@needing
def dir_(root: str, glob: str = "*", recursive: Any = False, full: Any = False, engine: Engine | None = None) -> list[str]:
    """Sorted names below a folder: a local one, or one of any store that Spark reads if it has a scheme, of which files are listed."""
    if "://" not in root:
        return files.directory(root, glob, bool(recursive), bool(full))
    found = [r.path for r in files.listing(engine.spark, root, glob, bool(recursive)).select("path").collect()]  # type: ignore[union-attr]
    return sorted(found if full else (x.rpartition("/")[2] for x in found))


@primitive("simpleitk:ReadImage", 1, kind="image")
@needing
def read_image(path: Any, engine: Engine) -> Image:
    """The images that a path names, which may be a pattern of many with one grid."""
    domain, channels = files.grid_of(engine.spark, path)
    return Image(Frame(files.read_images(engine.spark, path, domain.size, channels).drop("path").repartition("image_id"), domain), F.col("v"))


@primitive("simpleitk:WriteImage", 2, 4)
def write_image(x: Image, path: str, *_: Any) -> Any:
    """Write an image in the format of the path's suffix; gives the path, or the paths if there are several images."""
    found = sinks.write_image(x.frame.df.select(*VOXEL, (x.value.cast("double") if _scalar(x) else x.value).alias("v")), path, x.frame.domain)
    return found[0] if len(found) == 1 else found


def _scalar(x: Image) -> bool:
    return x.frame.df.select(x.value.alias("v")).schema["v"].dataType.typeName() != "array"


@primitive("default:print_primitive", 2)
def print_primitive(label: Any, value: Any) -> str:
    from rasterloom.plans.engine import plain

    text = f"{label}={plain(value)}"
    print(text)
    return text


@primitive("default:overlay", 1, None)
def overlay(*given: Any) -> dict:
    """Layers with labels, opacity, colours and visibility, the first named Base.

    Layers are the arguments, or the items of the only one; nested overlays pass on their layers. What
    a single dict with ``layers`` has besides is metadata.
    """
    metadata: dict[str, Any] = {}
    if len(given) == 1 and isinstance(given[0], dict) and "layers" in given[0]:
        metadata = {**(given[0].get("metadata") or {}), **{k: v for k, v in given[0].items() if k not in ("layers", "metadata")}}
        given = tuple(given[0]["layers"])
    elif len(given) == 1 and isinstance(given[0], (list, tuple)):
        given = tuple(given[0])
    elif len(given) == 1 and isinstance(given[0], DataFrame):
        given = tuple(r.value for r in given[0].orderBy("idx").collect())
    out: list[dict] = []
    for x in given:
        if isinstance(x, dict) and "layers" in x:
            out += x["layers"]
            continue
        base = not out
        out.append({"label": "Base" if base else f"Overlay {len(out)}", "opacity": 1.0 if base else 0.5, "colormap": "gray" if base else "red", "visible": True} | (x if isinstance(x, dict) and "value" in x else {"value": x}))
    if not out:
        raise LanguageError("E_EMPTY", "overlay needs a layer")
    return {"layers": out, "metadata": metadata}


def _text(x: Any) -> str:
    return str(x)


@primitive("strings:concat", 1, None, lift=True)
def concat(*xs: Any) -> Any:
    if any(isinstance(x, Column) for x in xs):
        return F.concat(*[x.cast("string") if isinstance(x, Column) else F.lit(_text(x)) for x in xs])
    return "".join(map(_text, xs))


@primitive("strings:format_string", 1, None, lift=True)
def format_string(template: str, *xs: Any) -> Any:
    if any(isinstance(x, Column) for x in xs):
        return strings.format_string(template, *map(_as_column, xs))
    whole = [int(x) if isinstance(x, float) and x.is_integer() and "d}" in template else x for x in xs]
    return template.format(*whole)


@primitive("geom:blank", 2, 3, "image")
@needing
def blank(height: float, width: float, value: float = 0.0, engine: Engine | None = None) -> Image:
    df = geometry.blank(engine.spark, int(height), int(width), value)  # type: ignore[union-attr]
    return Image(Frame(df, Domain((int(width), int(height), 1))), F.col("v"))


primitive("geom:circle", 5, kind="image")(lambda x, cx, cy, r, v: pointwise(lambda p: geometry.circle(p, cx, cy, r, v), x))
primitive("geom:regular_polygon", 6, kind="image")(lambda x, cx, cy, r, n, v: pointwise(lambda p: geometry.regular_polygon(p, cx, cy, r, int(n), v), x))


@primitive("test:fibonacci", 1)
def fibonacci(n: float) -> Any:
    if isinstance(n, Column):  # the items of a long sequence; 38 digits at most
        zero, one = (F.lit(k).cast("decimal(38,0)") for k in (0, 1))
        return F.aggregate(F.sequence(F.lit(1), F.greatest(n.cast("int"), F.lit(0)) + 1), F.struct(zero.alias("a"), one.alias("b")), lambda s, k: F.when(k > n.cast("int"), s).otherwise(F.struct(s["b"].alias("a"), (s["a"] + s["b"]).cast("decimal(38,0)").alias("b"))))["a"]
    a, b = 0, 1
    for _ in range(sequence.whole(n, "fibonacci")):
        a, b = b, a + b
    return a


primitive("test:impure", 1)(lambda x: (print(x), x)[1])
primitive("test:demo_data", 0, None)(lambda *_: {"name": "demo", "values": [1, 2, 3], "nested": {"flag": True}})


from rasterloom.plans import filters, plugins  # noqa: E402, F401  register the filters, and the libraries that ship

# models; an embedding application can register other pairs of functions to train and to predict
TRAINERS: dict[str, Any] = {"default": (trainers.fit, trainers.label)}


def _labelled(checked: list) -> DataFrame:
    """Voxels of all cases, with a column for each volume and ``label``."""
    out = None
    for k, (_, volumes, label) in enumerate(checked):
        frame = volumes[0].frame
        values = [column(v, frame).alias(f"v{n}") for n, v in enumerate(volumes)]
        rows = frame.df.select(F.lit(k).cast("bigint").alias("image_id"), "x", "y", "z", *values, column(label, frame).cast("int").alias("label"))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise LanguageError("E_EMPTY", "train needs a case")
    return out


@primitive("nnunet:train", 2, 8)
def train(given: list, work_root: str, modalities: Any = None, config: str = "2d", nfolds: float = 5, name: str = "", device: str = "", trainer: str = "default") -> Any:
    """Train with the trainer that was registered as ``trainer`` in ``TRAINERS``, a pair of functions to train and to predict."""
    if trainer not in TRAINERS:
        raise LanguageError("E_RUNTIME", f"no trainer {trainer!r} is registered")
    found = cases.checked(given)
    rows = cases.binary_labels(_labelled(found))
    return {"model": cases.train(rows, TRAINERS[trainer][0], int(nfolds), len(found[0][1])), "trainer": trainer}


primitive("nnunet:make_predictor", 1, 3)(lambda model, device="", folds=None: model | {"folds": [int(k) for k in folds] if folds else None})


@primitive("nnunet:predict", 2, kind="image")
def predict(predictor: dict, volumes: Any) -> Image:
    images = volumes if isinstance(volumes, list) else [volumes]
    if len(images) != predictor["model"].modalities:
        raise LanguageError("E_ARITY", "predict: another number of volumes than in training")
    frame = images[0].frame
    rows = frame.df.select(*VOXEL, *[column(v, frame).alias(f"v{n}") for n, v in enumerate(images)])
    return image_of(cases.predict(rows, predictor["model"], TRAINERS[predictor["trainer"]][1], predictor.get("folds")), frame.domain, "label")


primitive("nnunet:env_check", 0, None)(lambda *_: cases.env_check())
for _name in ("enqueue", "enqueue_advanced", "workflow_controller"):
    primitive(f"test:{_name}", 1, None)(lambda *xs, name=_name: {"operation": name, "arguments": [str(x) for x in xs], "scheduled": False})


@primitive("test:timewaste", 2)
def timewaste(size: float, rounds: float) -> float:
    """Work for its own sake: products and eigenvalues of a matrix with 10 times ``size`` rows, at most 1000, again and again."""
    n = min(1000, max(1, 10 * sequence.whole(size, "timewaste")))
    wave = np.sin(np.arange(n * n, dtype=float)).reshape(n, n)
    total, held = 0.0, wave
    for _ in range(max(1, sequence.whole(rounds, "timewaste"))):
        held = held @ wave.T
        held /= np.abs(held).max()
        total += float(np.linalg.eigvalsh((held + held.T) / 2).sum())
    return total



def image_of(df: DataFrame, domain: Domain, value: str = "v") -> Image:
    """A bound image for programs, from a voxel table."""
    return Image(Frame(df.select(*VOXEL, F.col(value).alias("v")), domain), F.col("v"))

