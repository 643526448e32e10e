"""Programs: text, plans, errors, values, files."""

import json

import numpy as np
import pytest

from rasterloom import cli
from rasterloom.plans import primitives
from rasterloom.plans.engine import Engine, Reducer, plain
from rasterloom.plans.graph import Node, Plan
from rasterloom.plans.syntax import LanguageError, parse_program, shown
from rasterloom.queries import GRID
from rasterloom.sources import files, sinks
from rasterloom.model import Domain, raster


def result(spark, text, **bindings):
    return [plain(v) for _, v in Engine(spark, text, bindings=bindings).run()]


@pytest.mark.parametrize(
    "text, want",
    [
        ("1+2*3", 9.0), ("2 ./. 4 .*. 3", 1.5), ("fold + 0 range(0,5)", 10), ("fold * 1 range(1,5)", 24), ("fold max range(0,8)", 7), ("fold && [true,true,false,true]", False),
        ("argmax([3,9,4,9,1])", 1), ("argmax([1.0,2.5,2.5])", 1), ("argmax(range(3,8))", 4), ("filter x in range(0,10) do num_gt(x,5)", [6, 7, 8, 9]),
        ("[0,1,2,3,4][1:4]", [1, 2, 3]), ("[0,1,2,3,4][:2]", [0, 1]), ("[0,1,2,3,4][3:]", [3, 4]), ("[0,1,2,3,4][:]", [0, 1, 2, 3, 4]), ("[[1,2],[3,4+1]][1][1]", 5.0),
        ("((range(0,6)/5)*10)+1", [1, 3, 5, 7, 9, 11]), ("[10,20,30] - [1,2,3]", [9, 18, 27]), ("[1,2,3]+10", [11, 12, 13]), ("subsequence([0,1,2,3],2)", [0, 1]), ("subsequence([0,1,2,3],1,3)", [1, 2]),
        ("subsequence([0,1,2,3],3,1)", []), ("range(5,1)", []), ("let x = 2 in let x = 3 in x * x", 9), ("map(sq, range(0,4))", [0, 1, 4, 9]), ("3 .*. 4", 12), ("4 .<=. 5", True), ("5 .>. 4", True), ("!true", False),
        ("true && false || true", True), ('strings.concat("a", 3, true)', "a3.0True"), ('strings.format_string("{:03d} {:.2%}", 7, 0.5)', "007 50.00%"), ("test.fibonacci(10)", 55), ("fold / 100 range(1,3)", 50), ("-3 + 5", 2),
        ("for i in range(0,3) do for j in range(0,2) do i + j", [[0, 1], [1, 2], [2, 3]]),
    ],
)
def test_values(spark, text, want):
    assert result(spark, f'sq(a) = a * a\nprint "x" {text}') == [want]


@pytest.mark.parametrize(
    "text, code",
    [
        ('print "x" nothing', "E_UNBOUND_IDENTIFIER"), ('print "x" num_gt(1)', "E_ARITY"), ("f(a) = a\nprint \"x\" f(1,2)", "E_ARITY"), ('print "x" fold % [1,2]', "E_UNSUPPORTED_FOLD"), ("$dir = 1", "E_RESERVED_PROGRAM_VARIABLE"),
        ("x=-1", "E_PARSE"), ('print "x" (1', "E_PARSE"), ('import "nowhere"', "E_IMPORT"), ('print "x" for i in [1] do nothing(i)', "E_UNBOUND_IDENTIFIER"),
    ],
)
def test_errors_before_running(text, code):
    with pytest.raises(LanguageError) as e:
        Reducer().program(text)
    assert e.value.code == code


@pytest.mark.parametrize("text", ["1/0", "[1,2][5]", "[1,2,3] + [1,2]", "argmax([])", "fold / [1,2]", "range(0.5)"])
def test_errors_when_running(spark, text):
    with pytest.raises(Exception):
        result(spark, f'print "x" {text}')


def test_own_operators_and_functions(spark):
    assert result(spark, "let +?(a,b) = a + b + 1\nlet B+(a) = a * 2\nprint \"a\" 3 +? 4\nprint \"b\" B+(5)") == [8, 10]


def test_text_round_trip():
    text = 'import "strings"\nlet f(a,b) = a + b * [1,2][0:1]\ng = let x = 1 in filter y in range(0,3) do y > x\nprint "p" fold max 0 g\nsave "o.json" for i in g do !(i > 1)'
    once = [shown(c) for c in parse_program(text)]
    assert [shown(c) for c in parse_program("\n".join(once))] == once


def test_plans_share_and_name_nodes():
    text = 'f(a) = a + a\nprint "x" f(f(f(1)))\nprint "y" f(f(f(1)))'
    a, b = Reducer().program(text), Reducer().program(text)
    assert list(a.nodes) == list(b.nodes) and a.goals[0].id == a.goals[1].id and sum(n.kind == "primitive" for n in a.nodes.values()) == 3
    deep = "\n".join(["a0 = 1", *(f"a{k} = a{k - 1} + a{max(0, k - 2)}" for k in range(1, 400)), 'print "x" a399'])
    assert len(Reducer().program(deep).ordered()) > 390
    assert {g["operation"] for g in a.to_json()["goals"]} == {"print"} and a.to_dot().startswith("digraph {") and "vox1.+" in a.to_text()
    json.dumps(a.to_json())


def test_cycles_are_found():
    p = Plan({"a": Node("primitive", "f", ("b",)), "b": Node("primitive", "g", ("a",))})
    with pytest.raises(ValueError):
        p.ordered()


@pytest.fixture(scope="module")
def ramp(spark):
    df = raster(spark.createDataFrame([(0, [float(k) for k in range(1, 28)])], "id long, a array<double>"), "id", "a", Domain((3, 3, 3)))
    return lambda: primitives.image_of(df, Domain((3, 3, 3)))


def test_equal_forms_of_image_operators(spark, ramp):
    forms = [("a > 13", "13 < a"), ("a + 2", "a +. 2"), ("2 / (a + 1)", "2 ./ (a +. 1)"), ("a >= 5", "5 .<= a"), ("a > 5", "a >. 5"), ("a > 5", "5 .< a"), ("!(a > 5)", "a <= 5"), ("(a > 3) & (a < 9)", "between(4,8,a)"), ("(a > 3) \\ (a > 9)", "(a > 3) & not(a > 9)"), ("a = (a)", "a .= a")]
    for one, two in forms[:-1]:
        got = result(spark, f'import "vox1"\nprint "1" {one}\nprint "2" {two}', a=ramp())
        key = lambda r: (r["z"], r["y"], r["x"])
        assert sorted(got[0], key=key) == sorted(got[1], key=key)


def test_values_of_whole_images(spark, ramp):
    got = result(spark, 'import "vox1"\nprint "v" volume(a > 20)\nprint "m" max(a) - min(a)\nprint "a" avg(a, a > 25)\nprint "b" volume(border)\nprint "t" volume((a > 20) ~> (a > 26))\nprint "i" volume(x > 0)', a=ramp())
    assert got == [{0: 7.0}, {0: 26.0}, {0: 26.5}, {0: 26.0}, {0: 7.0}, {0: 18.0}]


def test_pages_and_streams(spark, tmp_path):
    (tmp_path / "n.txt").write_text("\n".join(map(str, range(10_000))))
    engine = Engine(spark, f'lines = load("{tmp_path}/n.txt")\nprint "x" lines\nprint "s" [1,2,3,4,5]')
    lines, short = (g.id for g in engine.plan.goals)
    assert engine.page(lines, 0, 5) == (["0", "1", "2", "3", "4"], 5) and engine.page(lines, 9998, 5) == (["9998", "9999"], None)
    assert list(engine.stream(short, 2)) == [[1, 2], [3, 4], [5]]


def test_files(spark, tmp_path):
    (tmp_path / "a.json").write_text("[1, 2]")
    (tmp_path / "b.bin").write_bytes(bytes([1, 2, 3]))
    assert files.load(spark, str(tmp_path / "a.json")) == [1, 2] and files.load(spark, str(tmp_path / "b.bin")) == bytes([1, 2, 3])
    for case in ("caseA", "caseB"):
        (tmp_path / "d" / case).mkdir(parents=True)
        (tmp_path / "d" / case / "x.txt").write_text(case)
    assert files.directory(str(tmp_path / "d")) == ["caseA", "caseB"] and len(files.directory(str(tmp_path / "d"), "*.txt", True, True)) == 2
    assert files.listing(spark, str(tmp_path / "d"), "*.txt", True).count() == 2
    for name, value in (("o.json", [1, {"a": 2}]), ("o.txt", 3.5), ("o.pkl", [1])):
        sinks.save(str(tmp_path / "out" / name), value)
    assert json.loads((tmp_path / "out" / "o.json").read_text()) == [1, {"a": 2}] and (tmp_path / "out" / "o.txt").read_text() == "3.5"


@pytest.mark.parametrize("suffix", [".nii.gz", ".nii", ".mha"])
def test_images_round_trip(spark, tmp_path, suffix):
    domain = Domain((3, 4, 2), (0.5, 1.0, 2.0))
    grid = np.random.default_rng(1).normal(size=24)
    df = raster(spark.createDataFrame([(5, grid.tolist())], "id long, a array<double>"), "id", "a", domain)
    (path,) = [r.path for r in sinks.write_images(df, str(tmp_path), domain, suffix).collect()]
    back = files.read_images(spark, path)
    assert {(r.x, r.y, r.z): r.v for r in back.collect()} == {(r.x, r.y, r.z): r.v for r in df.collect()}
    assert files.domain_of(spark, path) == domain


def test_store(spark, tmp_path):
    store = sinks.Store(spark, f"file://{tmp_path}")
    assert store.get("k") is None
    assert store.put("k", spark.range(5)).count() == 5 and store.get("k").count() == 5


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    (tmp_path / "lib.imgql").write_text("sq(a) = a * a\n")
    (tmp_path / "p.imgql").write_text('import "lib.imgql"\nprint "x" sq(3)\nsave "%s/o.json" [1,2]\nprint "s" $stem\n' % tmp_path)
    assert cli.main(["run", str(tmp_path / "p.imgql"), "--save-json", str(tmp_path / "p.json"), "--save-dot", str(tmp_path / "p.dot")]) == 0
    assert capsys.readouterr().out == "x=9.0\ns=p\n" and json.loads((tmp_path / "o.json").read_text()) == [1, 2] and json.loads((tmp_path / "p.json").read_text())["goals"]
    (tmp_path / "bad.imgql").write_text('print "x" nothing')
    assert cli.main(["run", str(tmp_path / "bad.imgql")]) == 2
    assert cli.main(["list-primitives"]) == 0 and "default.range 1..2" in capsys.readouterr().out


def test_events(spark, tmp_path):
    import datetime

    from rasterloom.streaming import events

    rows = [(k, datetime.datetime(2024, 1, 1 + k // 10, k % 10), "a" if k % 2 else "b", 1.0) for k in range(30)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string, value double")
    df.write.parquet(f"{tmp_path}/in")
    want = sorted(map(str, events.tumbling(df).collect()))
    run = events.tumbling(events.read(spark, f"{tmp_path}/in", df.schema)).writeStream.format("memory").queryName("seen").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert sorted(map(str, spark.table("seen").collect())) == want
    assert GRID.flat
