"""Operators against plain loops, and what was stated for scalars and sequences."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.functions import strings
from rasterloom.model import Domain, by_image, raster
from rasterloom.operators import cases, derived, geometry, metrics, sequence, spatial, stats, voxel

SIZE = (6, 5, 4)
DOMAIN = Domain(SIZE, (0.7, 1.3, 2.1))


@pytest.fixture(scope="module")
def grids():
    rng = np.random.default_rng(3)
    out = {k: rng.normal(90, 25, SIZE[::-1]).round(1) for k in range(3)}
    out[3], out[4] = np.zeros(SIZE[::-1]), np.full(SIZE[::-1], 200.0)  # an empty mask, a full one
    out[5] = np.where(rng.random(SIZE[::-1]) < 0.5, 60.0, 120.0)  # ties
    return out


@pytest.fixture(scope="module")
def voxels(spark, grids):
    rows = [(k, g.ravel().tolist()) for k, g in grids.items()]
    return raster(spark.createDataFrame(rows, "id long, a array<double>").repartition(3), "id", "a", DOMAIN).cache()


def values(df, name):
    out = {}
    for r in df.select("image_id", "x", "y", "z", name).collect():
        out.setdefault(r[0], np.zeros(SIZE[::-1], object))[r.z, r.y, r.x] = r[name]
    return out


def box(grid, z, y, x, r=(1, 1, 1)):
    return grid[max(0, z - r[2]) : z + r[2] + 1, max(0, y - r[1]) : y + r[1] + 1, max(0, x - r[0]) : x + r[0] + 1]


def each(grid, f):
    return np.array([[[f(z, y, x) for x in range(SIZE[0])] for y in range(SIZE[1])] for z in range(SIZE[2])])


def mask():
    return F.col("v") > 100


def test_near_and_interior(voxels, grids):
    near, inside = values(spatial.near(voxels, mask(), DOMAIN), "near"), values(spatial.interior(voxels, mask(), DOMAIN), "interior")
    for k, g in grids.items():
        assert (near[k] == each(g, lambda z, y, x: (box(g, z, y, x) > 100).any())).all()
        assert (inside[k] == each(g, lambda z, y, x: (box(g, z, y, x) > 100).all())).all()


def plain_labels(m):
    label, n = np.zeros(m.shape, int), 0
    for at in np.ndindex(m.shape):
        if m[at] and not label[at]:
            n += 1
            stack = [at]
            while stack:
                p = stack.pop()
                if label[p] == 0 and m[p]:
                    label[p] = n
                    stack += [q for q in np.ndindex(m.shape) if max(abs(a - b) for a, b in zip(p, q)) == 1 and m[q] and not label[q]]
    return label


@pytest.mark.parametrize("level", [100, 118])
def test_components(voxels, grids, level):
    m = F.col("v") > level
    found = values(spatial.lcc(voxels, m, DOMAIN), "label")
    largest, touched = values(spatial.maxvol(voxels, m, DOMAIN), "maxvol"), values(spatial.through(voxels, F.col("v") > 130, m, DOMAIN), "through")
    for k, g in grids.items():
        want = plain_labels(g > level)
        assert (found[k] == want).all()
        sizes = np.bincount(want.ravel())[1:]
        best = [n + 1 for n, s in enumerate(sizes) if s == max(sizes)]
        assert (largest[k] == np.isin(want, best)).all()
        assert (touched[k] == np.isin(want, [n for n in np.unique(want[g > 130]) if n])).all()


def test_components_by_joins_agree(spark, voxels, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    m = F.col("v") > 112
    a = values(spatial.lcc(voxels, m, DOMAIN), "label")
    b = values(spatial.lcc_by_joins(voxels, m, DOMAIN), "label")
    assert all((a[k] == b[k]).all() for k in a)


def plain_dt(m):
    edge = [p for p in np.ndindex(m.shape) if m[p] and not box(m, *p).all()]
    out = np.full(m.shape, np.inf)
    step = DOMAIN.spacing[::-1]
    for p in np.ndindex(m.shape):
        out[p] = min((math.dist([a * s for a, s in zip(p, step)], [a * s for a, s in zip(q, step)]) for q in edge), default=math.inf)
    return np.where(m, -out, out) + 0.0


def test_distances_and_morphology(voxels, grids):
    found = values(spatial.dt(voxels, mask(), DOMAIN), "dt")
    eroded, dilated = values(derived.erode(voxels, mask(), 1.5, DOMAIN), "erode"), values(derived.dilate(voxels, mask(), 1.5, DOMAIN), "dilate")
    for k, g in grids.items():
        assert np.allclose(found[k].astype(float), plain_dt(g > 100))
        assert (eroded[k] == ~(np.maximum(plain_dt(~(g > 100)), 0) <= 1.5)).all()
        assert (dilated[k] == (np.maximum(plain_dt(g > 100), 0) <= 1.5)).all()


def test_percentiles(voxels, grids):
    found = values(by_image(voxels).withColumn("p", stats.percentiles(voxels, F.col("v"), mask(), 0.25)), "p")
    for k, g in grids.items():
        inside = g[g > 100]
        want = each(g, lambda z, y, x: ((inside < g[z, y, x]).sum() + 0.25 * (inside == g[z, y, x]).sum()) / len(inside) if g[z, y, x] > 100 else -1.0)
        assert np.allclose(found[k].astype(float), want)


def test_gradient(voxels, grids):
    found = values(spatial.gradient(voxels, F.col("v"), DOMAIN), "gradient")
    for k, g in grids.items():
        wide = np.pad(g, 1, mode="edge")
        parts = [(np.roll(wide, -1, a) - np.roll(wide, 1, a))[1:-1, 1:-1, 1:-1] / (2 * s) for a, s in enumerate(DOMAIN.spacing[::-1])]
        assert np.allclose(found[k].astype(float), np.sqrt(sum(p * p for p in parts)))


def test_cross_correlation(voxels, grids):
    low, high, bins = 40.0, 140.0, 5
    out = stats.cross_correlation(voxels, DOMAIN, 1.5, F.col("v"), F.col("v"), mask(), F.lit(low), F.lit(high), bins)
    found, r = values(out, "cc"), [stats.radii(DOMAIN, 1.5)[a] for a in "xyz"]

    def hist(a):
        a = a[(a >= low) & (a < high)]
        return np.bincount(((a - low) / ((high - low) / bins)).astype(int), minlength=bins).astype(float)

    def corr(a, b):
        a, b = a - a.mean(), b - b.mean()
        if not a.any() or not b.any():
            return 1.0 if not a.any() and not b.any() else 0.0
        return (a * b).sum() / math.sqrt((a * a).sum() * (b * b).sum())

    for k, g in grids.items():
        fb = hist(g[g > 100])
        assert np.allclose(found[k].astype(float), each(g, lambda z, y, x: corr(hist(box(g, z, y, x, r)), fb)))


def test_curvature_flow_keeps_planes_and_smooths(voxels, grids):
    flat = values(spatial.curvature_flow(voxels, F.col("x") * 2.0 + F.col("y"), DOMAIN, 0.05, 4), "flow")[0].astype(float)
    inner = (slice(None), slice(1, -1), slice(1, -1))
    want = np.broadcast_to(2.0 * np.arange(SIZE[0]) + np.arange(SIZE[1])[:, None], flat.shape)
    assert np.allclose(flat[1:-1][inner][:, :1, :1], want[1:-1][inner][:, :1, :1], atol=0.3)
    rough = values(spatial.curvature_flow(voxels, F.col("v"), DOMAIN, 0.02, 5), "flow")
    assert rough[0].astype(float).std() < grids[0].std() and (rough[3] == 0).all()


def test_aggregates_of_images(voxels, grids):
    found = {r.image_id: r for r in stats.statistics(voxels).collect()}
    for k, g in grids.items():
        assert (found[k]["min"], found[k]["max"], found[k]["count"]) == (g.min(), g.max(), g.size)
        assert found[k].sigma == pytest.approx(g.std(ddof=1))
    with pytest.raises(Exception, match="mask is empty"):
        stats.average(voxels, F.col("v"), F.col("v") > 1000).collect()
    assert {r.avg for r in stats.average(voxels, F.col("v"), F.col("v") > 1000, empty=0).collect()} == {0.0}


def test_statistics_stated(spark):
    df = raster(spark.createDataFrame([(0, [0.0, 10.0, 20.0, 30.0])], "id long, a array<double>"), "id", "a", Domain((2, 2, 1)))
    r = stats.statistics(df).first()
    assert (r["min"], r["max"], r["mean"], r["count"]) == (0, 30, 15, 4)


def test_windows_share_one_shuffle(spark, voxels):
    rows = by_image(voxels)
    plan = rows.withColumn("p", stats.percentiles(rows, F.col("v"), mask(), 0.0))
    for _ in range(2):
        plan = spatial.near(plan, F.col("p") > 0.5, DOMAIN, "n")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1


def test_scans_read_their_columns(spark):
    import os

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no tables")
    from rasterloom.queries import QUERIES

    text = QUERIES["volume"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>>" in text


def test_overlaps(spark):
    df = spark.createDataFrame([(0, 1, 1), (0, 1, 0), (0, 0, 1), (1, 0, 0)], "image_id long, a int, b int")
    got = {r.image_id: r for r in metrics.overlap(df).collect()}
    assert got[0].dice == pytest.approx(0.5) and got[0].jaccard == pytest.approx(1 / 3) and math.isnan(got[1].dice) and got[1].jaccard == 0


def test_sequences_stated(spark):
    one = spark.range(1)
    a = lambda *xs: F.array(*[F.lit(x) for x in xs])
    value = lambda c: one.select(c.alias("c")).first().c
    assert value(sequence.array_range(F.lit(5), F.lit(1))) == [] and value(sequence.array_range(F.lit(2), F.lit(5))) == [2, 3, 4]
    assert value(sequence.argmax(a(3, 9, 4, 9, 1))) == 1
    assert value(sequence.subsequence(a(0, 1, 2, 3), 2)) == [0, 1] and value(sequence.subsequence(a(0, 1, 2, 3), 3, 1)) == []
    assert value(sequence.sliced(a(0, 1, 2, 3, 4), 3, None)) == [3, 4]
    assert value(sequence.fold("&&", a(True, True, False, True))) is False
    for bad in (sequence.item(a(1, 2), 5), sequence.zipped(a(1.0), a(1.0, 2.0), lambda x, y: x), sequence.fold("max", a().cast("array<double>"))):
        with pytest.raises(Exception):
            value(bad)


def test_renumbered_and_folds(spark):
    rows = sequence.table_range(spark, 1000)
    kept = sequence.renumbered(rows.where("value % 3 = 1").repartition(5), step=64)
    assert [(r.idx, r.value) for r in kept.orderBy("idx").collect()] == [(k, 3 * k + 1) for k in range(333)]
    assert sequence.table_fold(rows, "-", 10.0).first().value == 10 - sum(range(1000))
    assert sequence.table_argmax(rows.withColumn("value", F.col("value") % 7).withColumn("g", F.lit(1)), ["g"]).first().argmax == 6


def test_strings(spark):
    row = spark.createDataFrame([(7, 2.5, True, None)], "i int, d double, b boolean, n string")
    got = row.select(strings.concat((F.col("i"), "int"), (F.col("d"), "double"), (F.lit(3.0), "double"), (F.col("b"), "boolean"), (F.col("n"), "string")).alias("c"), strings.format_string("{:03d}|{:.2f}|{:.1%}|{{x}} 100% {}", F.col("i"), F.col("d"), F.col("d"), F.col("i")).alias("f")).first()
    assert got.c == "72.53.0TrueNone" and got.f == "007|2.50|250.0%|{x} 100% 7"


def test_drawing(spark):
    df = geometry.blank(spark, 64, 64).withColumn("v", geometry.circle(F.col("v"), 32, 32, 10, 200))
    square = geometry.blank(spark, 64, 64).withColumn("v", geometry.regular_polygon(F.col("v"), 32, 32, 16, 4, 150))
    assert df.where("v = 200").count() == sum((x - 32) ** 2 + (y - 32) ** 2 <= 100 for x in range(64) for y in range(64))
    assert 450 < square.where("v = 150").count() < 580
    with pytest.raises(ValueError):
        geometry.blank(spark, 0, 5)


def test_extract_and_alignment(voxels, grids):
    out = voxel.extract(voxels, (2, 2, 1), (1, 3, 2))
    assert {(r.x, r.y): r.v for r in out.where("image_id = 0").collect()} == {(x, y): grids[0][2, y + 3, x + 1] for x in range(2) for y in range(2)}
    both = voxel.aligned(voxels, voxels.withColumn("v", F.col("v") * 2))
    assert both.where("b <> 2 * a").count() == 0 and both.count() == voxels.count()


def test_models(spark, voxels):
    assert cases.checked([["a b", ["x"], "y"], ["c", ["x"], "y"]])[0][0] == "a_b"
    for bad in ([["a b", [1], 2], ["a?b", [1], 2]], [["a", [1], 2], ["b", [1, 2], 2]], [["a", 1]]):
        with pytest.raises(ValueError):
            cases.checked(bad)
    rows = cases.binary_labels(voxels.withColumn("label", F.when(F.col("v") > 100, 3).otherwise(0)))

    def trainer(df):
        return repr(float((df[df.label == 1].v.min() + df[df.label == 0].v.max()) / 2)).encode()

    model = cases.train(rows, trainer, folds=2)
    out = cases.predict(voxels, model, lambda m, df: (df.v > float(m)).astype(int))
    assert sorted(model.folds) == [0, 1] and out.where((F.col("label") == 1) != (F.col("v") > 100)).count() < 10
