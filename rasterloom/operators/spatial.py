"""Neighbourhoods, components, reachability and distances on voxel tables.

A mask operator takes the voxel table and the mask as a Column, and gives the table with a column
more. Box neighbourhoods are window frames along one axis after the other, over one partitioning by
image. Components and distances are made by one task for each image by default; for images beyond
one task's memory there are forms that go on by joins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.model import COORDS, VOXEL, Domain


def frame(axis: str, n: int = 1):
    """The window of a voxel's neighbours up to ``n`` steps along an axis."""
    return Window.partitionBy("image_id", *[c for c in COORDS if c != axis]).orderBy(axis).rangeBetween(-n, n)


def near(voxels: DataFrame, mask: Column, domain: Domain, out: str = "near") -> DataFrame:
    """Voxels of the mask, and those with one of it among the neighbours in the box around them."""
    rows = voxels.withColumn(out, mask.cast("boolean"))
    for axis in domain.axes:
        rows = rows.withColumn(out, F.max(out).over(frame(axis)))
    return rows


def interior(voxels: DataFrame, mask: Column, domain: Domain, out: str = "interior") -> DataFrame:
    """Voxels whose whole box is of the mask; what is outside of the image counts as mask."""
    rows = voxels.withColumn(out, mask.cast("boolean"))
    for axis in domain.axes:
        rows = rows.withColumn(out, F.min(out).over(frame(axis)))
    return rows


def linear(domain: Domain) -> Column:
    """The place of a voxel in raster order."""
    return F.col("x") + domain.size[0] * (F.col("y") + domain.size[1] * F.col("z")).cast("bigint")


# kernels of whole images: arrays with the axes image, z, y, x
def shifts(shape: tuple[int, ...], faces: bool = False) -> Iterator[tuple[tuple[slice, ...], tuple[slice, ...]]]:
    """Pairs of views that are one step apart, for half of the steps to the box's neighbours, or to those that share a face."""
    choices = [[0], *([-1, 0, 1] if n > 1 else [0] for n in shape[1:])]
    steps = np.array(np.meshgrid(*choices, indexing="ij")).reshape(len(shape), -1).T
    for step in steps[len(steps) // 2 + 1 :]:
        if faces and np.abs(step).sum() > 1:
            continue
        yield tuple(slice(max(0, -d), n - max(0, d)) for d, n in zip(step, shape)), tuple(slice(max(0, d), n - max(0, -d)) for d, n in zip(step, shape))


def label_grid(grid: np.ndarray, faces: bool = False) -> np.ndarray:
    """Component numbers of the masks, 0 outside; numbered in each image by the first voxel in raster order.

    Each voxel takes the least place among its neighbours, then the place that this one has taken,
    until nothing changes.
    """
    none = grid.size
    label = np.where(grid, np.arange(none).reshape(grid.shape), none)
    views = [*shifts(grid.shape, faces)]
    while True:
        old = label.copy()
        for a, b in views:
            both = grid[a] & grid[b]
            least = np.minimum(label[a], label[b])
            label[a] = np.where(both, least, label[a])
            label[b] = np.where(both, np.minimum(least, label[b]), label[b])
        flat = np.append(label.ravel(), none)
        while True:
            hop = np.append(flat[flat[:-1]], none)
            if (hop == flat).all():
                break
            flat = hop
        label = flat[:-1].reshape(grid.shape)
        if (label == old).all():
            break
    roots, number = np.unique(label[grid], return_inverse=True)
    image = roots // grid[0].size
    first = np.searchsorted(image, image)  # numbers begin at 1 in each image
    out = np.zeros(grid.shape, np.int64)
    out[grid] = (np.arange(len(roots)) - first + 1)[number]
    return out


def distance_grid(grid: np.ndarray, spacing: tuple[float, ...]) -> np.ndarray:
    """Distance to the mask's outline, negative inside; the outline are mask voxels with a neighbour in the box that isn't mask.

    Squared distances are least sums along one axis after the other. Without an outline all are
    infinite: outside of an empty mask, and as negative ones inside of a full one.
    """
    outline = np.zeros(grid.shape, bool)
    for a, b in shifts(grid.shape):
        outline[a] |= grid[a] & ~grid[b]
        outline[b] |= grid[b] & ~grid[a]
    square = np.where(outline, 0.0, np.inf)
    for axis, step in enumerate(spacing, 1):
        n = grid.shape[axis]
        if n == 1:
            continue
        apart = (np.subtract.outer(np.arange(n), np.arange(n)) * step) ** 2
        lines = np.moveaxis(square, axis, -1)
        best = np.full(lines.shape, np.inf)
        for k in range(n):
            np.minimum(best, lines[..., k : k + 1] + apart[k], out=best)
        square = np.moveaxis(best, -1, axis)
    out = np.sqrt(square)
    return np.where(grid, -out, out) + 0.0


def flow_grid(values: np.ndarray, step: float, rounds: int, spacing: tuple[float, ...]) -> np.ndarray:
    """Curvature flow: ``rounds`` explicit steps by mean curvature, edges repeated beyond the border."""
    v = values.astype(float)
    axes = [k for k, n in enumerate(v.shape) if k and n > 1]
    h = [0.0, *spacing]
    for _ in range(rounds):
        wide = np.pad(v, [(1, 1) if k in axes else (0, 0) for k in range(v.ndim)], mode="edge")

        def at(**move: int) -> np.ndarray:
            return wide[tuple(slice(1 + move.get(f"d{k}", 0), 1 + move.get(f"d{k}", 0) + v.shape[k]) if k in axes else slice(None) for k in range(v.ndim))]

        one = {k: (at(**{f"d{k}": 1}) - at(**{f"d{k}": -1})) / (2 * h[k]) for k in axes}
        two = {k: (at(**{f"d{k}": 1}) - 2 * v + at(**{f"d{k}": -1})) / h[k] ** 2 for k in axes}
        top = np.zeros_like(v)
        for i in axes:
            top += two[i] * sum((one[j] ** 2 for j in axes if j != i), np.zeros_like(v))
            for j in axes:
                if j > i:
                    cross = (at(**{f"d{i}": 1, f"d{j}": 1}) - at(**{f"d{i}": 1, f"d{j}": -1}) - at(**{f"d{i}": -1, f"d{j}": 1}) + at(**{f"d{i}": -1, f"d{j}": -1})) / (4 * h[i] * h[j])
                    top -= 2 * one[i] * one[j] * cross
        square = sum((g**2 for g in one.values()), np.zeros_like(v))
        v = v + step * np.where(square > 1e-9, top / np.where(square > 1e-9, square, 1), 0.0)
    return v


def near_grid(grid: np.ndarray) -> np.ndarray:
    """Masks with the neighbours in the box around each voxel."""
    out = grid
    for axis in range(1, grid.ndim):
        if grid.shape[axis] > 1:
            wide = np.pad(out, [(1, 1) if k == axis else (0, 0) for k in range(grid.ndim)])
            n = grid.shape[axis]
            out = np.logical_or.reduce([np.take(wide, np.arange(k, k + n), axis) for k in range(3)])
    return out


def through_grid(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The components of the masks ``b`` that have a voxel of ``a``."""
    label = label_grid(b)
    image = np.arange(len(label)).reshape(-1, *[1] * (label.ndim - 1)) * (label.max(initial=0) + 1)
    hit = np.zeros(len(label) * (label.max(initial=0) + 1), bool)
    hit[(label + image)[a & (label > 0)]] = True
    return hit[label + image] & (label > 0)


def largest_grid(grid: np.ndarray) -> np.ndarray:
    """The largest component of each mask; all of those that tie for it."""
    label = label_grid(grid)
    most = label.max(initial=0) + 1
    image = np.arange(len(label)).reshape(-1, *[1] * (label.ndim - 1)) * most
    size = np.bincount((label + image).ravel(), minlength=len(label) * most).reshape(len(label), most)
    size[:, 0] = 0
    top = size == np.maximum(size.max(1, keepdims=True), 1)
    return top.ravel()[label + image] & (label > 0)


def within_grid(grid: np.ndarray, r: float, spacing: tuple[float, ...]) -> np.ndarray:
    """Voxels within ``r`` of each mask."""
    return np.maximum(distance_grid(grid, spacing), 0) <= r


def per_image(voxels: DataFrame, value: Column | list[Column], domain: Domain, kernel: Callable[..., np.ndarray], out: str, kind: str) -> DataFrame:
    """``voxels`` with what ``kernel`` makes of the images' grids of one value or several; an image must fit a task.

    Images are dealt out whole and sorted by id, so a task takes those of a batch together: the
    kernel works on all of them at once, and holds one batch and one image at most.
    """
    size = domain.size
    values = {f"_in{k}": v.cast("double") for k, v in enumerate(value if isinstance(value, list) else [value])}
    rows, given = voxels.withColumns(values), list(values)
    names = [f"`{c}` {t}" for c, t in voxels.dtypes if c != out]

    def made(part: pd.DataFrame) -> pd.DataFrame:
        image = pd.factorize(part["image_id"], use_na_sentinel=False)[0]
        at = (image, part["z"].to_numpy(), part["y"].to_numpy(), part["x"].to_numpy())
        grids = []
        for name in given:
            grids.append(np.zeros((image.max() + 1, *size[::-1])))
            grids[-1][at] = part[name].to_numpy()
        return part.drop(columns=[*given, out], errors="ignore").assign(**{out: kernel(*grids)[at]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # rows of the last image so far, which may go on
        for part in batches:
            if not len(part):
                continue
            last = part["image_id"].iloc[-1]
            whole = part["image_id"].to_numpy() != last
            cut = int(np.flatnonzero(whole)[-1]) + 1 if whole.any() else 0
            if cut or held and held[-1]["image_id"].iloc[-1] != last:
                yield made(pd.concat([*held, part.iloc[:cut]], ignore_index=True))
                held = []
            held.append(part.iloc[cut:])
        if held:
            yield made(pd.concat(held, ignore_index=True))

    return rows.repartition("image_id").sortWithinPartitions("image_id").mapInPandas(run, ", ".join([*names, f"`{out}` {kind}"]))


def of_masks(voxels: DataFrame, masks: list[Column], domain: Domain, kernel: Callable[..., np.ndarray], out: str) -> DataFrame:
    """``voxels`` with the mask that ``kernel`` makes of masks, null as false: a chain of neighbourhoods, components and distances in one pass."""
    given = [F.coalesce(m.cast("int"), F.lit(0)) for m in masks]
    return per_image(voxels, given, domain, lambda *grids: kernel(*(g != 0 for g in grids)), out, "boolean")


def dt(voxels: DataFrame, mask: Column, domain: Domain, out: str = "dt") -> DataFrame:
    """The signed Euclidean distance to the mask, by the domain's spacing."""
    spacing = domain.spacing[::-1]
    return per_image(voxels, F.coalesce(mask.cast("int"), F.lit(0)), domain, lambda g: distance_grid(g != 0, spacing), out, "double")


def lcc(voxels: DataFrame, mask: Column, domain: Domain, out: str = "label") -> DataFrame:
    """Connected components with all neighbours in the box, numbered from 1 in raster order; 0 outside."""
    return per_image(voxels, F.coalesce(mask.cast("int"), F.lit(0)), domain, lambda g: label_grid(g != 0), out, "bigint")


def lcc_by_faces(voxels: DataFrame, mask: Column, domain: Domain, out: str = "label") -> DataFrame:
    """Connected components of voxels that share faces, numbered as those of ``lcc``."""
    return per_image(voxels, F.coalesce(mask.cast("int"), F.lit(0)), domain, lambda g: label_grid(g != 0, True), out, "bigint")


def dt_by_lines(voxels: DataFrame, mask: Column, domain: Domain, out: str = "dt") -> DataFrame:
    """``dt`` for images that are too large for a task: squared distances go along the lines of one axis after the other.

    A task holds lines, never an image, and all of it are DataFrame functions.
    """
    rows = voxels.drop(out).withColumn("_m", F.coalesce(mask.cast("boolean"), F.lit(False)))
    rows = near(rows, ~F.col("_m"), domain, "_n")
    rows = rows.withColumn("_d", F.when(F.col("_m") & F.col("_n"), 0.0).otherwise(float("inf"))).drop("_n")
    kept = [c for c in rows.columns if c not in ("image_id", "_d")]
    for axis in domain.axes:
        across = [c for c in COORDS if c != axis]
        line = rows.groupBy("image_id", *across).agg(F.collect_list(F.struct(*[c for c in kept if c not in across], "_d")).alias("_l"))
        apart = lambda p, q: (p[axis] - q[axis]) * domain.step(axis)  # noqa: B023, E731
        best = F.transform("_l", lambda p: F.struct(p.alias("p"), F.aggregate("_l", F.lit(float("inf")), lambda d, q: F.least(d, q["_d"] + apart(p, q) * apart(p, q))).alias("d")))  # noqa: B023
        rows = line.select("image_id", *across, F.explode(best).alias("_b")).select("image_id", *across, *[F.col(f"_b.p.{c}").alias(c) for c in kept if c not in across], F.col("_b.d").alias("_d"))
    rows = rows.withColumn(out, F.when(F.col("_m"), -F.sqrt("_d")).otherwise(F.sqrt("_d")) + 0.0)
    return rows.select(*[c for c in voxels.columns if c != out], out)


def curvature_flow_by_windows(voxels: DataFrame, value: Column, domain: Domain, step: float, rounds: int, out: str = "flow") -> DataFrame:
    """``curvature_flow`` for images that are too large for a task: neighbours come from windows along the axes.

    All windows share the partitioning by image and line that Spark gives them; a round is a step of
    the plan, so that many rounds should be cut by checkpoints of the caller.
    """

    def beside(df: DataFrame, names: dict[str, tuple[str, str, int]]) -> DataFrame:
        """Columns ``name: (of, axis, move)``; beyond the border the edge is repeated."""
        made = {}
        for name, (of, axis, move) in names.items():
            line = Window.partitionBy("image_id", *[c for c in COORDS if c != axis]).orderBy(axis)
            made[name] = F.coalesce((F.lead if move > 0 else F.lag)(of).over(line), F.col(of))
        return df.withColumns(made)

    rows, axes = voxels.drop(out).withColumn("_v", value.cast("double")), domain.axes
    for _ in range(rounds):
        rows = beside(rows, {f"_{a}{m}": ("_v", a, 1 if m == "p" else -1) for a in axes for m in "pm"})
        pairs = [(a, b) for k, a in enumerate(axes) for b in axes[k + 1 :]]
        for a, b in pairs:
            rows = beside(rows, {f"_{a}{b}{m}{n}": (f"_{a}{m}", b, 1 if n == "p" else -1) for m in "pm" for n in "pm"})
        one = {a: (F.col(f"_{a}p") - F.col(f"_{a}m")) / (2 * domain.step(a)) for a in axes}
        two = {a: (F.col(f"_{a}p") - 2 * F.col("_v") + F.col(f"_{a}m")) / domain.step(a) ** 2 for a in axes}
        none = F.lit(0.0)
        top = sum((two[a] * sum((one[b] * one[b] for b in axes if b != a), none) for a in axes), none)
        for a, b in pairs:
            cross = (F.col(f"_{a}{b}pp") - F.col(f"_{a}{b}pm") - F.col(f"_{a}{b}mp") + F.col(f"_{a}{b}mm")) / (4 * domain.step(a) * domain.step(b))
            top = top - 2 * one[a] * one[b] * cross
        square = sum((one[a] * one[a] for a in axes), none)
        rows = rows.withColumns({"_t": top, "_s": square}).withColumn("_v", F.col("_v") + step * F.when(F.col("_s") > 1e-9, F.col("_t") / F.col("_s")).otherwise(0.0))
        rows = rows.select(*[c for c in voxels.columns if c != out], "_v")
    return rows.withColumnRenamed("_v", out)


def curvature_flow(voxels: DataFrame, value: Column, domain: Domain, step: float, rounds: int, out: str = "flow") -> DataFrame:
    spacing = domain.spacing[::-1]
    return per_image(voxels, value, domain, lambda g: flow_grid(g, step, rounds, spacing), out, "double")


def lcc_by_joins(voxels: DataFrame, mask: Column, domain: Domain, out: str = "label", checkpoint: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``lcc`` for images that are too large for a task: labels spread by window frames, and by pointer jumps.

    ``checkpoint`` writes a round's table and cuts its lineage; ``DataFrame.checkpoint`` by default,
    for which the session needs a checkpoint folder that its executors share.
    """
    held = checkpoint or (lambda df: df.checkpoint())
    rows = held(voxels.select(*VOXEL, mask.cast("boolean").alias("_m"), F.when(mask, linear(domain)).alias("_l")))
    while True:
        new = rows.withColumn("_old", F.col("_l"))
        for axis in domain.axes:
            new = new.withColumn("_n", F.min("_l").over(frame(axis)))
            new = new.withColumn("_l", F.col("_n"))
        new = new.withColumn("_l", F.when(F.col("_m"), F.col("_l")))
        roots = new.where("_m").groupBy("image_id", "_old").agg(F.min("_l").alias("_r"))
        new = new.join(roots, ["image_id", "_old"], "left").withColumn("_l", F.when(F.col("_m"), F.least("_l", "_r")))
        new = held(new.select(*VOXEL, "_m", "_l", (F.col("_l") != F.col("_old")).alias("_c")))
        if new.where("_c").isEmpty():
            break
        rows = new.drop("_c")
    numbers = new.where("_m").select("image_id", "_l").distinct().withColumn(out, F.row_number().over(Window.partitionBy("image_id").orderBy("_l")).cast("bigint"))
    labels = new.join(numbers, ["image_id", "_l"], "left").select(*VOXEL, F.coalesce(out, F.lit(0)).alias(out))
    return voxels.drop(out).join(labels, VOXEL)


def through(voxels: DataFrame, a: Column, b: Column, domain: Domain, out: str = "through", label: Callable = lcc) -> DataFrame:
    """The components of ``b`` that have a voxel of ``a``."""
    if label is lcc:
        return of_masks(voxels, [a, b], domain, through_grid, out)
    rows = label(voxels.withColumn("_a", a), b, domain, out="_b")
    hit = F.max(F.col("_a") & (F.col("_b") > 0)).over(Window.partitionBy("image_id", "_b"))
    return rows.withColumn(out, F.coalesce(hit & (F.col("_b") > 0), F.lit(False))).drop("_a", "_b")


def maxvol(voxels: DataFrame, mask: Column, domain: Domain, out: str = "maxvol", label: Callable = lcc) -> DataFrame:
    """The largest component; all of those that tie for it."""
    if label is lcc:
        return of_masks(voxels, [mask], domain, largest_grid, out)
    rows = label(voxels, mask, domain, out="_b")
    size = F.when(F.col("_b") > 0, F.count("*").over(Window.partitionBy("image_id", "_b"))).otherwise(0)
    rows = rows.withColumn("_n", size)
    most = F.max("_n").over(Window.partitionBy("image_id"))
    return rows.withColumn(out, (F.col("_n") > 0) & (F.col("_n") == most)).drop("_b", "_n")


def gradient(voxels: DataFrame, value: Column, domain: Domain, out: str = "gradient") -> DataFrame:
    """The magnitude of central differences by the domain's spacing; beyond the border the last value is repeated."""
    parts = []
    for axis in domain.axes:
        line = Window.partitionBy("image_id", *[c for c in COORDS if c != axis]).orderBy(axis)
        change = F.lead("_v", 1).over(line), F.lag("_v", 1).over(line)
        slope = (F.coalesce(change[0], F.col("_v")) - F.coalesce(change[1], F.col("_v"))) / (2 * domain.step(axis))
        parts.append(slope * slope)
    return voxels.withColumn("_v", value).withColumn(out, F.sqrt(reduce(Column.__add__, parts, F.lit(0.0)))).drop("_v")
