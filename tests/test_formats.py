"""Image formats, filters, the result store and namespaces from outside."""

import gzip
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom import cli
from rasterloom.model import Domain
from rasterloom.operators import spatial
from rasterloom.plans import engine as engines
from rasterloom.plans import plugins
from rasterloom.plans.engine import Engine, plain
from rasterloom.plans.primitives import image_of
from rasterloom.plans.syntax import LanguageError
from rasterloom.sources import files, formats, sinks

RNG = np.random.default_rng(4)


@pytest.mark.parametrize("suffix", [".nii", ".mha", ".nrrd", ".tif", ".vtk"])
def test_formats_of_volumes(suffix):
    grid = RNG.integers(-50, 300, (3, 4, 5)).astype(float)
    back, spacing = files.decoded(f"a{suffix}", sinks.ENCODERS[suffix](grid, (1.0, 2.0, 3.0)))
    assert (back == grid).all() and (spacing == (1.0, 2.0, 3.0) or suffix == ".tif")


@pytest.mark.parametrize("channels", [1, 2, 3, 4])
def test_png(channels):
    grid = RNG.integers(0, 256, (1, 6, 7) + ((channels,) if channels > 1 else ())).astype(float)
    assert (formats.png(formats.to_png(grid))[0] == grid).all()


@pytest.mark.parametrize("kind", range(5))
def test_png_filters_and_depths(kind):
    """Rows that are filtered here by the letter of the format."""
    pixels = RNG.integers(0, 256, (5, 4 * 3)).astype(int)
    rows = []
    for y in range(5):
        row = [kind]
        for x in range(12):
            a, b, c = (pixels[y][x - 3] if x > 2 else 0), (pixels[y - 1][x] if y else 0), (pixels[y - 1][x - 3] if y and x > 2 else 0)
            near = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
            row.append((pixels[y][x] - [0, a, b, (a + b) // 2, near][kind]) % 256)
        rows += row

    def made(head, *chunks):
        return formats.PNG_START + b"".join(struct.pack(">I", len(body)) + name + body + b"crc." for name, body in ((b"IHDR", struct.pack(">IIBBBBB", *head)), *chunks))

    raw = made((4, 5, 8, 2, 0, 0, 0), (b"IDAT", zlib.compress(bytes(map(int, rows)))))
    assert (formats.png(raw)[0].reshape(5, 12) == pixels).all()
    if kind == 0:
        two = made((5, 1, 2, 3, 0, 0, 0), (b"PLTE", bytes(range(12))), (b"IDAT", zlib.compress(bytes([0, 0b00011011, 0b01000000]))))
        assert formats.png(two)[0][0, 0].tolist() == [[0, 1, 2], [3, 4, 5], [6, 7, 8], [9, 10, 11], [3, 4, 5]]
        deep = made((1, 1, 16, 0, 0, 0, 0), (b"IDAT", zlib.compress(b"\0\x01\x02")))
        assert formats.png(deep)[0].tolist() == [[[258.0]]]
        with pytest.raises(ValueError):
            formats.png(made((1, 1, 8, 0, 0, 0, 1), (b"IDAT", b"")))


def test_other_decoders():
    rows = b"\1\2\3\0" + b"\4\5\6\0"
    head = b"BM" + struct.pack("<IHHIIiiHHIIiiII", 0, 0, 0, 54, 40, 3, 2, 1, 8, 0, 0, 0, 0, 0, 0)
    assert formats.bmp(head + rows)[0].tolist() == [[[4, 5, 6], [1, 2, 3]]]
    element = lambda g, e, kind, body: struct.pack("<HH", g, e) + kind + (struct.pack("<HI", 0, len(body)) if kind == b"OW" else struct.pack("<H", len(body))) + body
    short = lambda e, n: element(0x28, e, b"US", struct.pack("<H", n))
    raw = bytes(128) + b"DICM" + element(2, 0x10, b"UI", b"1.2.840.10008.1.2.1\0") + short(0x10, 2) + element(0x28, 0x30, b"DS", b"0.5\\0.25 ") + short(0x11, 3) + short(0x100, 16) + element(0x28, 0x1052, b"DS", b"-10 ") + element(0x7FE0, 0x10, b"OW", struct.pack("<6H", *range(6)))
    grid, spacing = formats.dicom(raw)
    assert grid.tolist() == [[[-10, -9, -8], [-7, -6, -5]]] and spacing == (0.25, 0.5, 1.0)
    text = b"# vtk DataFile Version 2.0\nx\nASCII\nDATASET STRUCTURED_POINTS\nDIMENSIONS 2 1 2\nSPACING 1 1 4\nPOINT_DATA 4\nSCALARS a int 1\nLOOKUP_TABLE default\n1 2\n3 4\n"
    assert formats.vtk(text)[0].tolist() == [[[1, 2]], [[3, 4]]] and formats.vtk(text)[1] == (1.0, 1.0, 4.0)
    assert formats.unpacked(b"\x02abc\xfez\x80") == b"abczzz"


def grid_image(spark, grid):
    rows = [(1, x, y, z, float(grid[z, y, x])) for z in range(grid.shape[0]) for y in range(grid.shape[1]) for x in range(grid.shape[2])]
    return image_of(spark.createDataFrame(rows, "image_id long, x int, y int, z int, v double"), Domain(grid.shape[::-1]))


def array_of(value, shape):
    out = np.full(shape, np.nan)
    for r in value.result().collect():
        out[r.z, r.y, r.x] = float(r.v)
    return out


def test_images_are_written_and_read_by_programs(spark, tmp_path):
    grid = RNG.integers(0, 256, (1, 5, 6)).astype(float)
    for name in ("a.png", "b.nii.gz", "c.nrrd"):
        path = f"{tmp_path}/{name}"
        engine = Engine(spark, f'import "simpleitk"\nprint "p" WriteImage(img, "{path}")', bindings={"img": grid_image(spark, grid)})
        assert engine.run()[0][1] == path
        back = Engine(spark, f'print "x" ReadImage("{path}") .+ 1').run()[0][1]
        assert (array_of(back, grid.shape) == grid + 1).all()
    formatted = formats.to_png(RNG.integers(0, 256, (1, 2, 2, 3)).astype(float))
    (tmp_path / "rgb.png").write_bytes(formatted)
    red = Engine(spark, f'print "x" red(ReadImage("{tmp_path}/rgb.png"))').run()[0][1]
    assert (array_of(red, (1, 2, 2)) == formats.png(formatted)[0][..., 0]).all()
    (tmp_path / "odd.png").write_bytes(formats.to_png(np.zeros((1, 3, 3))))
    (tmp_path / "odd2.png").write_bytes(formats.to_png(np.zeros((1, 3, 4))))
    with pytest.raises(Exception, match="has the grid"):
        plain(Engine(spark, f'print "x" ReadImage("{tmp_path}/odd*.png")').run()[0][1])
    program = tmp_path / "p.imgql"
    program.write_text(f'save "{tmp_path}/out.png" ReadImage("{tmp_path}/a.png")\n')
    assert cli.main(["--master", "local[4]", "run", str(program)]) == 0
    assert (formats.png((tmp_path / "out.png").read_bytes())[0] == grid).all()


def test_filters(spark):
    grid = np.array([[[3.7, -2.5, 0.0], [300.0, 1.0, 2.0], [-1.0, 5.0, 9.0]]])
    wants = {
        'Cast(img, GetPixelIDValueFromString("sitkUInt8"))': np.trunc(grid) % 256,
        'Cast(img, GetPixelIDValueFromString("sitkInt8"))': (np.trunc(grid) + 128) % 256 - 128,
        'Cast(img, GetPixelIDValueFromString("sitkFloat32"))': grid.astype(np.float32),
        "Add(img, Square(img))": grid + grid**2, "Maximum(img, 1)": np.maximum(grid, 1), "Greater(img, 1)": grid > 1, "LessEqual(img, 1, 7, 3)": np.where(grid <= 1, 7, 3),
        "And(Greater(img, 0), Less(img, 4))": (grid > 0) & (grid < 4), "Or(Greater(img, 4), Less(img, 0))": (grid > 4) | (grid < 0), "Not(Equal(img, 1))": grid != 1,
        "Mask(img, Greater(img, 1), 9)": np.where(grid > 1, grid, 9), "MaskNegated(img, Greater(img, 1))": np.where(grid > 1, 0, grid), "Threshold(img, 0, 5, 8)": np.where((grid >= 0) & (grid <= 5), grid, 8),
        "Clamp(img, 9, 0, 4)": np.clip(grid, 0, 4), "ShiftScale(img, 1, 2)": (grid + 1) * 2, "InvertIntensity(img)": 255 - grid, "IntensityWindowing(img, 0, 5, 0, 10)": np.clip(grid, 0, 5) * 2,
        "Normalize(img)": (grid - grid.mean()) / grid.std(ddof=1), "VectorIndexSelectionCast(Compose(img, Abs(img)), 1)": np.abs(grid), "Sqrt(Abs(img))": np.sqrt(np.abs(grid)),
        "Crop(img, [1, 0, 0], [0, 1, 0])": grid[:, :2, 1:], "RegionOfInterest(img, [2, 2, 1], [1, 1, 0])": grid[:, 1:, 1:], "ConstantPad(img, [1, 0, 0], [0, 2, 0], 6)": np.pad(grid, ((0, 0), (0, 2), (1, 0)), constant_values=6),
        "GradientMagnitude(Equal(img, 77))": np.zeros_like(grid),
    }
    for text, want in wants.items():
        got = Engine(spark, f'import "simpleitk"\nprint "x" simpleitk.{text}', bindings={"img": grid_image(spark, grid)}).run()[0][1]
        assert array_of(got, want.shape) == pytest.approx(want.astype(float), abs=1e-6), text


def test_filters_of_neighbourhoods(spark):
    grid = np.zeros((1, 6, 6))
    grid[0, [1, 2, 4], [1, 2, 4]] = 1
    run = lambda text: array_of(Engine(spark, f'print "x" simpleitk.{text}', bindings={"img": grid_image(spark, grid)}).run()[0][1], grid.shape)
    assert run("ConnectedComponent(img)").max() == 3 and run("ConnectedComponent(img, 1)").max() == 2
    y, x = np.indices((6, 6))
    near = lambda r: np.array([[min((a - p) ** 2 + (b - q) ** 2 for p, q in ((1, 1), (2, 2), (4, 4))) <= (r + 0.5) ** 2 for b in range(6)] for a in range(6)])
    assert (run("BinaryDilate(img, 1)")[0] == near(1)).all()
    assert (run("BinaryErode(BinaryDilate(img, 1), 0)")[0] == near(1)).all()
    square = run("SignedMaurerDistanceMap(img)")[0].round(6)
    assert square[0, 0] == 2 and square[1, 1] == 0 and square[5, 0] == min((5 - a) ** 2 + b**2 for a, b in ((1, 1), (2, 2), (4, 4)))
    assert (run("OtsuThreshold(img, 5, 6)") == np.where(grid > 0.5, 6, 5)).all()


def test_large_image_forms_equal_the_kernels(spark):
    shape = (4, 7, 6)
    domain = Domain(shape[::-1], (1.0, 2.0, 0.5))
    rows = [(k, x, y, z, float(RNG.normal())) for k in range(3) for z in range(shape[0]) for y in range(shape[1]) for x in range(shape[2])]
    voxels = spark.createDataFrame(rows, "image_id long, x int, y int, z int, v double")
    for mask in (F.col("v") > 0.7, F.lit(False), F.lit(True)):
        both = spatial.dt_by_lines(spatial.dt(voxels, mask, domain, "a"), mask, domain, "b").collect()
        assert len(both) == len(rows) and all(r.a == pytest.approx(r.b, abs=1e-9) for r in both)
    both = spatial.curvature_flow_by_windows(spatial.curvature_flow(voxels, F.col("v"), domain, 0.05, 2, "a"), F.col("v"), domain, 0.05, 2, "b").collect()
    assert len(both) == len(rows) and all(r.a == pytest.approx(r.b, abs=1e-9) for r in both)


def test_results_are_stored(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo\n")
    store, runs = sinks.Store(spark, f"file://{tmp_path}/store"), []
    engines.primitive("test:noted", 1)(lambda x: (runs.append(1), x)[1])
    text = f'let lines = test.noted(load("{tmp_path}/a.txt"))\nprint "x" lines'
    assert plain(Engine(spark, text, store=store).run()[0][1]) == ["one", "two"] and runs == [1]
    again = Engine(spark, text, store=store)
    assert plain(again.run()[0][1]) == ["one", "two"] and runs == [1]
    (tmp_path / "a.txt").write_text("one\ntwo\nthree\n")
    spark.catalog.clearCache()
    assert plain(Engine(spark, text, store=store).run()[0][1]) == ["one", "two", "three"] and runs == [1, 1]
    image = grid_image(spark, np.ones((1, 2, 2)))
    bound = Engine(spark, 'print "x" img .+ 1', bindings={"img": image}, store=store)
    assert bound.lasting(bound.plan.goals[0].id) is None and (array_of(bound.run()[0][1], (1, 2, 2)) == 2).all()
    blank = 'print "x" geom.blank(2, 3, 4) .* 2\nprint "y" vox1.max(geom.blank(2, 3, 4))'
    for _ in range(2):
        x, y = (v for _, v in Engine(spark, blank, store=store).run())
        assert (array_of(x, (1, 2, 3)) == 8).all() and y.whole and y.result().first().value == 4


def test_namespaces_from_outside(spark, tmp_path):
    (tmp_path / "extra.py").write_text("from rasterloom.plans.engine import primitive\nprimitive('extra:twice', 1)(lambda x: 2 * x)\n")
    (tmp_path / "shapes.imgql").write_text("let thrice(x) = 3 * x\n")
    assert plugins.load_folder(str(tmp_path)) == ["extra", "shapes"]
    assert Engine(spark, 'import "shapes"\nprint "x" thrice(extra.twice(2))').run()[0][1] == 12
    with pytest.raises(LanguageError, match="E_IMPORT"):
        plugins.register_library("bad", 'print "x" 1')
    seen = []
    engines.PLANNERS.append(lambda plan: (seen.append(len(plan.nodes)), plan)[1])
    engines.RESETS.append(lambda: seen.append("reset"))
    try:
        Engine(spark, 'print "x" 1 + 2')
        assert seen[0] == "reset" and seen[1] >= 3
    finally:
        engines.PLANNERS.pop()
        engines.RESETS.pop()


def test_long_sequences_keep_the_rules_of_short_ones(spark):
    run = lambda text: plain(Engine(spark, text).run()[0][1])
    for n in (5, 200_000):
        with pytest.raises(LanguageError, match="E_LENGTH"):
            run(f'print "x" range(0,{n}) + range(0,{n - 1})')
        with pytest.raises(LanguageError, match="E_DIVISION"):
            run(f'print "x" fold + (for i in range(0,{n}) do 1 / i)')
        with pytest.raises(LanguageError, match="E_DIVISION"):
            run(f'print "x" range(0,{n}) / 0')
        assert run(f'print "x" (for i in range(0,{n}) do fibonacci(i))[4]') == 3
    assert run('print "x" (for i in range(0,200000) do fibonacci(i))[30]') == 832040
    with pytest.raises(LanguageError, match="E_LENGTH"):
        run('print "x" range(0,200000) + [1,2]')
    with pytest.raises(LanguageError, match="E_TYPE"):
        run('print "x" for i in range(0,200000) do timewaste(i, 1)')


def test_folders_of_stores(spark, tmp_path):
    for name in ("b.txt", "a.txt", "c.csv"):
        (tmp_path / name).write_text("x")
    run = lambda text: Engine(spark, f'print "x" {text}').run()[0][1]
    assert run(f'dir("file://{tmp_path}", "*.txt")') == run(f'dir("{tmp_path}", "*.txt")') == ["a.txt", "b.txt"]
    assert [x.rpartition("/")[2] for x in run(f'dir("file://{tmp_path}", "*", false, true)')] == ["a.txt", "b.txt", "c.csv"]


def test_overlays_and_models(spark):
    show = lambda text, **held: Engine(spark, text, bindings=held).run()[0][1]
    assert [x["label"] for x in show('print "x" overlay([1, 2, 3])')["layers"]] == ["Base", "Overlay 1", "Overlay 2"]
    given = show('print "x" overlay(given)', given={"layers": [{"value": 1, "opacity": 0.25}], "metadata": {"a": 1}, "title": "t"})
    assert given["metadata"] == {"a": 1, "title": "t"} and given["layers"][0]["opacity"] == 0.25
    with pytest.raises(LanguageError, match="E_EMPTY"):
        show('print "x" overlay([])')
    assert show('print "x" timewaste(2, 3)') == show('print "x" timewaste(2, 3)')
    grids = [np.where(m := RNG.random((1, 8, 8)) < 0.4, 10.0, 0.0) + RNG.normal(size=(1, 8, 8)) for _ in range(3)]
    text = 'let c(n, x) = [n, [x], x .> 5]\nlet model = train([c("a", p), c("b", q)], "w", 0, "2d", 1)\nprint "x" predict(make_predictor(model), r)'
    got = show(text, p=grid_image(spark, grids[0]), q=grid_image(spark, grids[1]), r=grid_image(spark, grids[2]))
    assert (array_of(got, (1, 8, 8)) == (grids[2] > 5)).mean() > 0.95
    assert gzip.decompress(gzip.compress(b"x")) == b"x" and m.shape == (1, 8, 8)
