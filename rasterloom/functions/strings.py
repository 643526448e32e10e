"""Strings as the surface language makes them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELD = re.compile(r"\{\{|\}\}|\{(\d*)(?::([^{}]*))?\}")
SPEC = re.compile(r"([<>]?)(0?)(\d*)(,?)(?:\.(\d+))?([dfs%x]?)")


def shown(value: Column, kind: str) -> Column:
    """A value as text: whole doubles with one zero after the point, booleans capitalised, null as None."""
    if kind in ("double", "float"):
        # digits of the double itself, without an exponent where there are at most 16 before the point
        plain = F.when((F.abs(value) < 1e16) & (F.floor(value) == value), F.concat(F.format_string("%.0f", value.cast("double")), F.lit(".0"))).otherwise(F.lower(value.cast("string")))
        return F.coalesce(plain, F.lit("None"))
    if kind == "boolean":
        return F.coalesce(F.initcap(value.cast("string")), F.lit("None"))
    return F.coalesce(value.cast("string"), F.lit("None"))


def concat(*values: tuple[Column, str]) -> Column:
    """The texts of values with their types, joined."""
    return F.concat(*[shown(v, k) for v, k in values])


def format_string(template: str, *values: Column) -> Column:
    """A brace template, such as ``{:03d} {:.2f} {:.1%}``, as the session's own formatter; it is read when the plan is made."""
    parts: list[str] = []
    args: list[Column] = []
    at = turn = 0
    for m in FIELD.finditer(template):
        parts.append(template[at : m.start()].replace("%", "%%"))
        at = m.end()
        if m[0] in ("{{", "}}"):
            parts.append(m[0][0])
            continue
        k = int(m[1]) if m[1] else turn
        turn += not m[1]
        spec = SPEC.fullmatch(m[2] or "")
        if spec is None:
            raise ValueError(f"format_string: {m[0]} is not supported")
        if k >= len(values):
            raise ValueError(f"format_string: no value for {m[0]}")
        side, zero, width, comma, digits, kind = spec.groups()
        flags = ("-" if side == "<" else "") + ("0" if zero and width else "") + comma
        value = values[k]
        if kind == "%":
            parts.append(f"%{flags}{width}.{digits or 6}f%%")
            value = value.cast("double") * 100
        elif kind == "f":
            parts.append(f"%{flags}{width}.{digits or 6}f")
            value = value.cast("double")
        elif kind in ("d", "x"):
            parts.append(f"%{flags}{width}{kind}")
            value = value.cast("bigint")
        else:
            parts.append(f"%{flags}{width}{'.' + digits if digits else ''}s")
            value = value.cast("string")
        args.append(value)
    parts.append(template[at:].replace("%", "%%"))
    return F.format_string("".join(parts), *args) if args else F.lit("".join(parts).replace("%%", "%"))
