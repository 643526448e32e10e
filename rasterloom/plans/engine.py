"""Reducing programs to plans, and running plans on Spark.

An image of a program is a whole set of images: a frame, the voxel table, and a column of it.
Point-wise primitives make column expressions; the others add a column to the frame, so that a chain
of them stays one table without joins. Values of an image as a whole, such as its volume, are
columns too. Nodes are made once, whatever uses them.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterloom.model import VOXEL, Domain
from rasterloom.plans.graph import Goal, Node, NodeId, Plan
from rasterloom.plans.syntax import LanguageError, Tree, parse_program, shown
from rasterloom.sources.sinks import Store

#: Fixed values of the language: names of program variables, operators of folds, other names of operators.
RESERVED = ("$cwd", "$dir", "$file", "$filename", "$stem")
FOLDS = ("+", "-", "*", "/", "&&", "||", "min", "max")
ALIASES = {"!": "not", "&&": "bool_and_scalar", "||": "bool_or_scalar"}


# run-time values
@dataclass
class Frame:
    """A voxel table that gains columns, and its grid."""

    df: DataFrame
    domain: Domain
    made: int = 0
    #: columns of other frames that were joined, with the image that each is of
    joined: dict[int, tuple[Image, Column]] = field(default_factory=dict)

    def add(self, make: Callable[[DataFrame, str], DataFrame]) -> Column:
        """Add a column with ``make(table, name)``."""
        name = f"_v{self.made}"
        self.made += 1
        self.df = make(self.df, name)
        return F.col(name)


@dataclass
class Image:
    """A column of a frame; ``whole`` if it has one value for each image."""

    frame: Frame
    value: Column
    whole: bool = False

    def result(self) -> DataFrame:
        """``image_id, value`` for values of whole images, else ``image_id, x, y, z, v``."""
        if self.whole:
            rows = self.frame.df.select("image_id", self.value.alias("value"))
            return rows.groupBy("image_id").agg(F.first("value").alias("value"))
        return self.frame.df.select(*VOXEL, self.value.alias("v"))


@dataclass
class Generator:
    """An image without a grid of its own, which it takes from what it is used with."""

    make: Callable[[Domain], Column]


@dataclass
class Function:
    params: list[str]
    body: Tree
    env: dict[str, Any]


@dataclass
class Closure:
    """A function of one value at run time: its body, and the values that it has captured."""

    param: str
    body: Tree
    env: dict[str, Any] = field(default_factory=dict)


def frame_of(args: list[Any]) -> Frame:
    for a in args:
        if isinstance(a, Image):
            return a.frame
    raise LanguageError("E_DOMAIN", "no image tells the grid of this expression")


def column(x: Any, frame: Frame) -> Column:
    """A value as a column of ``frame``; an image of another frame is joined to it, by voxel or by image."""
    if isinstance(x, Generator):
        return x.make(frame.domain)
    if not isinstance(x, Image):
        return x if isinstance(x, Column) else F.lit(x)
    if x.frame is frame:
        return x.value
    if id(x) not in frame.joined:
        other = x.result().withColumnRenamed("value" if x.whole else "v", "_o")
        frame.joined[id(x)] = x, frame.add(lambda df, name: df.join(other.withColumnRenamed("_o", name), ["image_id"] if x.whole else VOXEL, "left"))
    return frame.joined[id(x)][1]


def pointwise(f: Callable[..., Any], *args: Any) -> Any:
    """``f`` of plain values, columns, images, or items of sequences.

    A sequence and a scalar pair the scalar with each item; two sequences must have one length. An
    empty sequence counts as a scalar. Long sequences, which are tables, are held to the same rules.
    """
    if any(isinstance(a, DataFrame) for a in args):
        return rowwise(f, *args)
    if any(isinstance(a, list) and a for a in args):
        size = {len(a) for a in args if isinstance(a, list) and a}
        if len(size) > 1:
            raise LanguageError("E_LENGTH", "sequences of unequal length")
        return [pointwise(f, *(a[k] if isinstance(a, list) and a else a for a in args)) for k in range(size.pop())]
    if any(isinstance(a, Image) for a in args):
        frame = frame_of(list(args))
        whole = all(a.whole if isinstance(a, Image) else not isinstance(a, Generator) for a in args)
        return Image(frame, f(*(column(a, frame) for a in args)), whole)
    if any(isinstance(a, Generator) for a in args):
        return Generator(lambda d: f(*(a.make(d) if isinstance(a, Generator) else F.lit(a) if not isinstance(a, Column) else a for a in args)))
    return strict(f)(*args)


def strict(f: Callable[..., Any]) -> Callable[..., Any]:
    """``f`` as it is of items of sequences, where an error of a plain value is an error of the column too."""
    return getattr(f, "strict", f)


def rowwise(f: Callable[..., Any], *args: Any) -> DataFrame:
    """``f`` of items of long sequences with one another, with short ones, or with scalars."""
    some = next(a for a in args if isinstance(a, DataFrame))
    given = [table_of(some.sparkSession, a) if isinstance(a, list) and a else a for a in args]
    tables = [a for a in given if isinstance(a, DataFrame)]
    if len(tables) > 1 and len({t.count() for t in tables}) > 1:
        raise LanguageError("E_LENGTH", "sequences of unequal length")
    rows = tables[0].select("idx", F.col("value").alias("_0"))
    for k, t in enumerate(tables[1:], 1):
        rows = rows.join(t.select("idx", F.col("value").alias(f"_{k}")), "idx")
    names = iter(range(len(tables)))
    values = [F.col(f"_{next(names)}") if isinstance(a, DataFrame) else a for a in given]
    return rows.select("idx", strict(f)(*values).alias("value"))


def table_of(spark: SparkSession, items: list) -> DataFrame:
    """A short sequence as a table."""
    return spark.createDataFrame([*enumerate(items)], ["idx", "value"])


def divided(a: Any, b: Any) -> Any:
    """Division of voxels gives null for a zero divisor; that of scalars is an error."""
    if isinstance(a, Column) or isinstance(b, Column):
        return F.try_divide((a if isinstance(a, Column) else F.lit(a)).cast("double"), b if isinstance(b, Column) else F.lit(b))
    if b == 0:
        raise LanguageError("E_DIVISION", "division by zero")
    return a / b


def divided_strictly(a: Any, b: Any) -> Any:
    if not isinstance(b, Column) and b == 0:
        raise LanguageError("E_DIVISION", "division by zero")
    if not isinstance(b, Column):
        return divided(a, b)
    return F.when(b == 0, F.raise_error(F.lit("E_DIVISION: division by zero")).cast("double")).otherwise(divided(a, b))


divided.strict = divided_strictly  # type: ignore[attr-defined]


def truth(x: Any) -> Any:
    return x.cast("boolean") if isinstance(x, Column) else bool(x)


def both(a: Any, b: Any) -> Any:
    a, b = truth(a), truth(b)
    return a & b if isinstance(a, Column) or isinstance(b, Column) else a and b


def either(a: Any, b: Any) -> Any:
    a, b = truth(a), truth(b)
    return a | b if isinstance(a, Column) or isinstance(b, Column) else a or b


def negated(a: Any) -> Any:
    a = truth(a)
    return ~a if isinstance(a, Column) else not a


@dataclass
class Primitive:
    """A function of the language; ``most`` is None if it takes any number."""

    name: str
    run: Callable[..., Any]
    least: int
    most: int | None
    kind: str = "scalar"


PRIMITIVES: dict[str, dict[str, Primitive]] = {}
#: Libraries in the surface language by namespace; functions that see each plan before it runs; functions that reset state before a program.
LIBRARIES: dict[str, str] = {}
PLANNERS: list[Callable[[Plan], Plan]] = []
RESETS: list[Callable[[], None]] = []
#: Primitives that read the files of their first argument, and those whose value isn't told by their arguments.
FILES = {"default.load", "simpleitk.ReadImage"}
IMPURE = {"default.dir", "test.impure", "default.print_primitive", "simpleitk.WriteImage", "nnunet.train", "nnunet.env_check"}


def primitive(names: str, least: int, most: int | None = -1, kind: str = "scalar", lift: bool = False) -> Callable:  # type: ignore[assignment]
    """Register a function under qualified names; ``lift`` makes it one of images and sequences by their values."""

    def add(f: Callable) -> Callable:
        run = functools.partial(pointwise, f) if lift else f
        for name in names.split():
            space, _, own = name.partition(":")
            PRIMITIVES.setdefault(space, {})[own] = Primitive(f"{space}.{own}", run, least, least if most == -1 else most, kind)
        return f

    return add


def resolve(name: str, imported: list[str]) -> Primitive | None:
    """A qualified name, else the first of ``default``, the imports in their order, and the rest by name."""
    space, _, own = name.partition(".")
    if space in PRIMITIVES and own in PRIMITIVES[space]:
        return PRIMITIVES[space][own]
    for space in ["default", *imported, *sorted(PRIMITIVES)]:
        if name in PRIMITIVES.get(space, {}):
            return PRIMITIVES[space][name]
    return None


# reducing
class Reducer:
    """Makes a plan of commands: functions are inlined, equal nodes are one, names and arities are checked."""

    def __init__(self, path: str | None = None, bindings: dict[str, Any] | None = None):
        self.plan = Plan()
        self.values: dict[NodeId, Any] = {}
        self.env: dict[str, Any] = {}
        self.path = Path(path).resolve() if path else None
        place = self.path or Path.cwd() / "program"
        for name, value in zip(RESERVED, (str(Path.cwd()), str(place.parent), str(place), place.name, place.stem)):
            self.env[name] = self.constant(value)
        for name, value in (bindings or {}).items():
            node = Node("constant", "bound", attrs=(("value", name),), output_kind="image")
            self.env[name] = self.plan.add(node)
            self.values[node.id] = value

    def constant(self, value: Any) -> NodeId:
        return self.plan.add(Node("constant", "constant", attrs=(("value", value),)))

    def program(self, text: str) -> Plan:
        for command in parse_program(text):
            self.command(command)
        return self.plan

    def command(self, c: Tree) -> None:
        if c[0] == "import":
            self.load(c[1])
        elif c[0] in ("print", "save"):
            self.plan.goals.append(Goal(c[0], self.reduce(c[2], self.env), c[1]))
        else:
            _, name, formal, body = c
            if name in RESERVED:
                raise LanguageError("E_RESERVED_PROGRAM_VARIABLE", name)
            self.env = self.env | {name: Function(formal, body, self.env) if formal else self.reduce(body, self.env)}

    def load(self, name: str) -> None:
        if "." not in name and "/" not in name:
            if name not in PRIMITIVES and name not in LIBRARIES:
                raise LanguageError("E_IMPORT", f"no namespace {name}")
            if name not in self.plan.imported:
                self.plan.imported.append(name)
                for command in parse_program(LIBRARIES.get(name, "")):
                    if command[0] in ("print", "save"):
                        raise LanguageError("E_IMPORT", f"the library {name} has a goal")
                    self.command(command)
            return
        path = Path(name) if Path(name).is_absolute() or self.path is None else self.path.parent / name
        for command in parse_program(path.read_text()):
            self.command(command)

    def node(self, name: str, args: list[NodeId], attrs: tuple = ()) -> NodeId:
        p = resolve(name, self.plan.imported)
        if p is None:
            raise LanguageError("E_UNBOUND_IDENTIFIER", name)
        if len(args) < p.least or p.most is not None and len(args) > p.most:
            raise LanguageError("E_ARITY", f"{name} takes {p.least}{'' if p.most == p.least else f' to {p.most}' if p.most else ' or more'} arguments, not {len(args)}")
        return self.plan.add(Node("primitive", p.name, tuple(args), attrs=attrs, output_kind=p.kind))

    def closure(self, param: str, body: Tree, env: dict[str, Any]) -> NodeId:
        """A closure node; the ids and functions that its body names are captured, and checked now."""
        free = sorted(names(body) - {param})
        held = {n: env[n] for n in free if n in env}
        for n in free:
            if n not in env and n not in ALIASES and resolve(n, self.plan.imported) is None and n not in locals_of(body):
                raise LanguageError("E_UNBOUND_IDENTIFIER", n)
        caught = tuple((n, v) for n, v in held.items() if isinstance(v, str))
        node = Node("closure", "closure", kwargs=caught, attrs=(("parameter", param), ("body", shown(body)), ("capture_names", [n for n, _ in caught]), ("function_captures", [n for n in held if not isinstance(held[n], str)])), output_kind="closure")
        self.values[node.id] = Closure(param, body, held)
        return self.plan.add(node)

    def reduce(self, t: Tree, env: dict[str, Any]) -> NodeId:
        kind = t[0]
        if kind == "constant":
            return self.constant(t[1])
        if kind == "array":
            return self.node("sequence", [self.reduce(x, env) for x in t[1]])
        if kind == "in":
            return self.reduce(t[3], env | {t[1]: self.reduce(t[2], env)})
        if kind == "slice":
            bounds = [self.constant(None) if b is None else self.reduce(b, env) for b in t[2:]]
            return self.node("slice", [self.reduce(t[1], env), *bounds])
        if kind in ("for", "filter"):
            return self.node("for_loop" if kind == "for" else "filter", [self.reduce(t[2], env), self.closure(t[1], t[3], env)])
        if kind == "fold":
            if t[1] not in FOLDS:
                raise LanguageError("E_UNSUPPORTED_FOLD", t[1])
            return self.node("fold", [self.reduce(x, env) for x in (t[3], t[2]) if x is not None], (("operator", t[1]),))
        _, name, args = t
        if name == "map" and len(args) == 2 and args[0][0] == "call" and not args[0][2]:
            f = args[0][1]
            return self.node("map", [self.reduce(args[1], env), self.closure("_item", ("call", f, [("call", "_item", [])]), env)])
        if name not in ALIASES and name in env:
            bound = env[name]
            if isinstance(bound, Function):
                if len(bound.params) != len(args):
                    raise LanguageError("E_ARITY", f"{name} takes {len(bound.params)} arguments, not {len(args)}")
                return self.reduce(bound.body, bound.env | dict(zip(bound.params, (self.reduce(a, env) for a in args))))
            if args:
                raise LanguageError("E_ARITY", f"{name} is not a function")
            return bound
        return self.node(ALIASES.get(name, name), [self.reduce(a, env) for a in args])


def names(t: Any) -> set[str]:
    """The names that a tree calls."""
    if isinstance(t, list):
        return set().union(*map(names, t)) if t else set()
    if not isinstance(t, tuple):
        return set()
    if t[0] == "call":
        return {t[1]} | names(t[2])
    return set().union(*(names(x) for x in t[1:] if isinstance(x, (tuple, list)))) if len(t) > 1 else set()


def locals_of(t: Any) -> set[str]:
    """The names that a tree binds."""
    if isinstance(t, list):
        return set().union(*map(locals_of, t)) if t else set()
    if not isinstance(t, tuple):
        return set()
    own = {t[1]} if t[0] in ("in", "for", "filter") else set()
    return own.union(*(locals_of(x) for x in t[1:] if isinstance(x, (tuple, list))))


# running
def translated(f: Callable[[], Any]) -> Any:
    """What ``f`` gives; an error of the language that Spark met in a column is raised as such."""
    try:
        return f()
    except PySparkException as e:
        if found := re.search(r"\b(E_[A-Z]+): ([^\n]*?)(?: SQLSTATE.*)?(?:\n|$)", str(e)):
            raise LanguageError(found[1], found[2]) from e
        raise


class Engine:
    """Runs the nodes that goals need, each once."""

    def __init__(self, spark: SparkSession, text: str, path: str | None = None, bindings: dict[str, Any] | None = None, store: Store | None = None):
        for reset in RESETS:
            reset()
        self.spark, self.store = spark, store
        self.reducer = Reducer(path, bindings)
        self.plan = self.reducer.program(text)
        for planner in PLANNERS:
            self.plan = planner(self.plan)
        self.done: dict[NodeId, Any] = dict(self.reducer.values)
        self.bound = {k for k, v in self.reducer.values.items() if not isinstance(v, Closure)}

    def lasting(self, key: NodeId) -> str | None:
        """A name for a node's value that holds in other runs; None if there is none.

        Values that the caller has bound, functions that closures capture by name, side effects and
        listings of folders have none. Files count by their names, lengths and times.
        """
        seen, stack, files = {key}, [key], []
        while stack:
            k = stack.pop()
            node = self.plan.nodes[k]
            attrs = dict(node.attrs)
            if k in self.bound or node.operator in IMPURE or attrs.get("function_captures"):
                return None
            if node.operator in FILES:
                path = self.plan.nodes[node.args[0]]
                if path.kind != "constant" or not isinstance(dict(path.attrs)["value"], str):
                    return None
                files.append(dict(path.attrs)["value"])
            below = [*node.args, *(v for _, v in node.kwargs)]
            stack += [x for x in below if x not in seen]
            seen.update(below)
        if not files:
            return key
        marks = []
        for path in sorted(files):
            listed = self.spark.read.format("binaryFile").load(path).select(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)").alias("h"))
            marks.append(str(listed.agg(F.count("*"), F.sum("h")).first()))
        return f"{key}-{hashlib.sha256(' '.join(marks).encode()).hexdigest()[:16]}"

    def stored(self, key: NodeId) -> Any:
        """The value of a node that an earlier run has stored, or None."""
        name = self.lasting(key) if self.store and self.plan.nodes[key].kind == "primitive" else None
        found = self.store.find(name) if self.store and name else None
        if found is None:
            return None
        about, df = found
        if about["kind"] == "image":
            frame = Frame(df, Domain(tuple(about["size"]), tuple(about["spacing"])))
            return Image(frame, F.col("value" if about["whole"] else "v"), about["whole"])
        return df

    def keep(self, key: NodeId, value: Any) -> Any:
        """Store the value of a goal, if it is a table or an image, and return what reads it."""
        name = self.lasting(key) if self.store and isinstance(value, (Image, DataFrame)) else None
        if self.store is None or name is None or self.store.find(name):
            return value
        about = {"kind": "image", "whole": value.whole, "size": value.frame.domain.size, "spacing": value.frame.domain.spacing} if isinstance(value, Image) else {"kind": "table"}
        self.store.put(name, value.result() if isinstance(value, Image) else value, about)
        return self.stored(key)

    def value(self, key: NodeId) -> Any:
        """The value of a node; what it needs is made first, without recursion into deep plans."""
        stack = [key]
        while stack:
            k = stack[-1]
            if k in self.done:
                stack.pop()
                continue
            node = self.plan.nodes[k]
            if self.store and (found := self.stored(k)) is not None:
                self.done[k] = found
                continue
            missing = [a for a in node.args if a not in self.done]
            if missing:
                stack += missing
                continue
            self.done[k] = dict(node.attrs)["value"] if node.kind == "constant" else self.call(node.operator, [self.done[a] for a in node.args], dict(node.attrs))
            stack.pop()
        return self.done[key]

    def call(self, operator: str, args: list[Any], attrs: dict[str, Any] | None = None) -> Any:
        p = resolve(operator, self.plan.imported)
        if p is None:
            raise LanguageError("E_UNBOUND_IDENTIFIER", operator)
        if len(args) < p.least or p.most is not None and len(args) > p.most:
            raise LanguageError("E_ARITY", operator)
        more = {"engine": self} | (attrs or {}) if getattr(p.run, "needs_engine", False) else {}
        try:
            return translated(lambda: p.run(*args, **more))
        except (TypeError, ValueError, AttributeError, PySparkException) as e:
            if not any(isinstance(a, Column) for a in args):
                raise
            raise LanguageError("E_TYPE", f"{p.name} does not take items of long sequences: {e}") from e
        except LanguageError as e:
            frames = {id(v.frame): v.frame for v in self.done.values() if isinstance(v, Image)}
            if e.code != "E_DOMAIN" or len(frames) != 1:
                raise
            frame = next(iter(frames.values()))  # the only images there are tell the grid
            return p.run(*(Image(frame, a.make(frame.domain)) if isinstance(a, Generator) else a for a in args), **more)

    def apply(self, c: Closure, item: Any) -> Any:
        return self.evaluate(c.body, c.env | {c.param: ("value", item)})

    def evaluate(self, t: Tree, env: dict[str, Any]) -> Any:
        """The value of a closure's body for one item, which may be a column that stands for all."""
        kind = t[0]
        if kind == "constant":
            return t[1]
        if kind == "array":
            return [self.evaluate(x, env) for x in t[1]]
        if kind == "in":
            return self.evaluate(t[3], env | {t[1]: ("value", self.evaluate(t[2], env))})
        if kind == "slice":
            return self.call("slice", [self.evaluate(t[1], env), *(None if b is None else self.evaluate(b, env) for b in t[2:])])
        if kind in ("for", "filter"):
            return self.call("for_loop" if kind == "for" else "filter", [self.evaluate(t[2], env), Closure(t[1], t[3], env)])
        if kind == "fold":
            return self.call("fold", [self.evaluate(x, env) for x in (t[3], t[2]) if x is not None], {"operator": t[1]})
        _, name, args = t
        if name == "map" and len(args) == 2 and args[0][0] == "call" and not args[0][2]:
            return self.call("map", [self.evaluate(args[1], env), Closure("_item", ("call", args[0][1], [("call", "_item", [])]), env)])
        bound = env.get(name) if name not in ALIASES else None
        if isinstance(bound, Function):
            return self.evaluate(bound.body, bound.env | dict(zip(bound.params, (("value", self.evaluate(a, env)) for a in args))))
        if isinstance(bound, tuple):
            return bound[1]
        if isinstance(bound, str):
            return self.value(bound)
        return self.call(ALIASES.get(name, name), [self.evaluate(a, env) for a in args])

    def run(self) -> list[tuple[Goal, Any]]:
        """The value of each goal, in order."""
        return [(g, self.goal(g)) for g in self.plan.goals]

    def goal(self, g: Goal) -> Any:
        """The value of a goal, which is stored if there is a store."""
        if self.store and g.id not in self.done:
            self.done[g.id] = self.keep(g.id, self.value(g.id))
        return self.value(g.id)

    def page(self, key: NodeId, offset: int, limit: int) -> tuple[list, int | None]:
        """Items of a sequence from ``offset`` on, and where the next page begins; None after the last. A scalar is one item."""
        value = self.value(key)
        if isinstance(value, DataFrame) and value.columns == ["idx", "value"]:
            items = [r.value for r in translated(lambda: value.where(F.col("idx").between(offset, offset + limit - 1)).orderBy("idx").collect())]
        else:
            items = (value if isinstance(value, list) else [value])[offset : offset + limit]
        return items, offset + limit if len(items) == limit else None

    def stream(self, key: NodeId, size: int):
        """Items of a sequence in lists of at most ``size``."""
        offset: int | None = 0
        while offset is not None:
            items, offset = self.page(key, offset, size)
            if items:
                yield items


def plain(value: Any) -> Any:
    """A value for the driver: images as rows, long sequences as lists."""
    return translated(lambda: _plain(value))


def _plain(value: Any) -> Any:
    if isinstance(value, Image):
        return [r.asDict() for r in value.result().collect()] if not value.whole else {r.image_id: r.value for r in value.result().collect()}
    if isinstance(value, DataFrame):
        return [r.value for r in value.orderBy("idx").collect()] if value.columns == ["idx", "value"] else [r.asDict() for r in value.collect()]
    if isinstance(value, list):
        return [_plain(v) for v in value]
    return value


def by_image(f: Callable[[Column], Column]) -> Callable[..., Image]:
    """A primitive that aggregates an image's values; the aggregate is a window over the image."""

    def run(x: Any, *rest: Any) -> Image:
        frame = frame_of([x, *rest])
        args = [column(a, frame) for a in (x, *rest)]
        return Image(frame, frame.add(lambda df, name: df.withColumn(name, f(*args).over(Window.partitionBy("image_id")))), True)

    return run


def extended(f: Callable[..., DataFrame]) -> Callable[..., Image]:
    """A primitive ``f(table, columns…, domain, out=name)`` that adds a column to the frame."""

    def run(*args: Any) -> Image:
        frame = frame_of(list(args))
        values = [column(a, frame) if isinstance(a, (Image, Generator)) else a for a in args]
        return Image(frame, frame.add(lambda df, name: f(df, *values, frame.domain, out=name)))

    return run


def needing(f: Callable) -> Callable:
    f.needs_engine = True  # type: ignore[attr-defined]
    return f

