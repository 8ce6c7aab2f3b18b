"""A postfix program as one boolean column, without Python at run time.

Whether the stack underflows or doesn't end with one entry depends on the program only, so such programs are the constant
false. What depends on the row is a comparison with a missing operand, or a regular expression on anything but
strings: it makes the whole program false. Nothing short-circuits, so the column is the value of the last entry and the
presence of all operands of all comparisons. JSON null counts as missing.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartolith.functions.geo import haversine
from cartolith.plans.program import Compare, Condition, Literal, Near, Node, Path, Search, parse_or_search

NUMERIC = ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT")


def _all(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts)


def kind_of(v: Column) -> Column:
    """BIGINT, DECIMAL, DOUBLE, STRING, BOOLEAN, OBJECT, ARRAY or VOID of a variant."""
    return F.regexp_extract(F.schema_of_variant(v), r"^[A-Z]+", 0)


def step_into(v: Column, path: Path) -> Column:
    """The variant at a path; missing where a key meets no object or a place no array."""
    for run, negative in _runs(path.steps):
        if negative is None:
            v = F.try_variant_get(v, run, "variant")
        else:
            v = F.try_element_at(v.try_cast("array<variant>"), F.lit(negative))
    return v


def _runs(steps: tuple[str | int, ...]) -> list[tuple[str, int | None]]:
    out: list[tuple[str, int | None]] = []
    text = ""
    for s in steps:
        if isinstance(s, int) and s < 0:
            if text:
                out.append(("$" + text, None))
            out.append(("", s))
            text = ""
        elif isinstance(s, int):
            text += f"[{s}]"
        elif '"' in s:
            text += "['" + s + "']"
        else:
            text += '["' + s + '"]'
    return out + ([("$" + text, None)] if text else [])


class _Operand:
    """A stack entry and how it looks as each kind; None: never of that kind."""

    present: Column
    truth: Column
    decimal: Column | None = None
    double: Column | None = None
    string: Column | None = None
    boolean: Column | None = None
    json: Column | None = None
    constant: object = None


class Bag:
    """Plain columns in place of a property bag: paths of one step to them become typed comparisons, which reach a Parquet scan."""

    def __init__(self, df: DataFrame, columns: dict[str, str]) -> None:
        self.columns = {name: (F.col(c), df.schema[c].dataType) for name, c in columns.items()}
        self.variant = F.to_variant_object(F.struct(*(F.col(c).alias(name) for name, c in columns.items())))

    def at(self, path: Path) -> _Operand:
        first = path.steps[0]
        if first not in self.columns:
            return _Value(F.lit(None).cast("variant"))
        column, kind = self.columns[first]
        if len(path.steps) == 1 and isinstance(kind, (T.IntegralType, T.FloatType, T.DoubleType, T.StringType, T.BooleanType)):
            return _Field(column, kind)
        return _Value(step_into(self.variant, path))


class _Field(_Operand):
    """A column of a plain type."""

    def __init__(self, column: Column, kind: T.DataType) -> None:
        self.present = column.isNotNull()
        self.truth = self.present
        self.column = column
        if isinstance(kind, T.StringType):
            self.string = column
        elif isinstance(kind, T.BooleanType):
            self.boolean, self.truth = column, self.present & column
        else:
            self.double = column.cast("double")
            self.whole = isinstance(kind, T.IntegralType)
            if self.whole:
                self.decimal = column.cast("decimal(38,18)")

    def against(self, op: str, value: int | float | str) -> Column | None:
        """The comparison with a constant in the column's own type; null for null, which the whole program is false for anyway."""
        if isinstance(value, str) or self.string is not None or self.boolean is not None:
            return _apply(op, self.column, F.lit(value)) if isinstance(value, str) and self.string is not None else None
        if self.whole and float(value).is_integer() and -(1 << 63) <= value < 1 << 63:
            return _apply(op, self.column, F.lit(int(value)))
        if not self.whole and float(value) == value and value == value:
            return _apply(op, self.column, F.lit(float(value)))
        return None


class _Value(_Operand):
    def __init__(self, v: Column) -> None:
        kind = kind_of(v)
        self.present = v.isNotNull() & ~F.coalesce(F.is_variant_null(v), F.lit(True))
        self.boolean = F.when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))
        self.truth = self.present & F.coalesce(self.boolean, F.lit(True))
        exact = kind.isin("BIGINT", "DECIMAL", "INT", "SMALLINT", "TINYINT")
        self.decimal = F.when(exact, F.try_variant_get(v, "$", "decimal(38,18)"))
        self.double = F.when(kind.isin(*NUMERIC), F.try_variant_get(v, "$", "double"))
        self.string = F.when(kind == "STRING", F.try_variant_get(v, "$", "string"))
        self.json = F.when(kind.isin("OBJECT", "ARRAY"), F.to_json(v))


class _Constant(_Operand):
    def __init__(self, value: int | float | str) -> None:
        self.constant = value
        self.present = self.truth = F.lit(True)
        if isinstance(value, str):
            self.string = F.lit(value)
        else:
            self.double = F.lit(float(value))
            if isinstance(value, int):
                self.decimal = F.lit(str(value)).cast("decimal(38,18)")
            elif value == value and abs(value) < 1e18:
                self.decimal = F.lit(repr(value)).cast("decimal(38,18)")


class _Truth(_Operand):
    def __init__(self, truth: Column) -> None:
        self.present = F.lit(True)
        self.truth = self.boolean = truth


def _apply(op: str, a: Column, b: Column) -> Column:
    return {"==": a == b, ">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b}[op]


def _compare(op: str, a: _Operand, b: _Operand) -> Column:
    """Of equal kinds only; numbers of all types are one kind. Null only for a column that is null itself."""
    if op == "!=":
        return ~_compare("==", a, b)
    if isinstance(a, _Field) and isinstance(b, _Constant):
        plain = a.against(op, b.constant)
    elif isinstance(a, _Constant) and isinstance(b, _Field):
        plain = b.against({"==": "==", ">": "<", ">=": "<=", "<": ">", "<=": ">="}[op], a.constant)
    else:
        plain = None
    if plain is not None:
        return plain
    tried: list[Column] = []
    if a.decimal is not None and b.decimal is not None:
        tried.append(_apply(op, a.decimal, b.decimal))
    if a.double is not None and b.double is not None:
        tried.append(_apply(op, a.double, b.double))
    if a.string is not None and b.string is not None:
        tried.append(_apply(op, a.string, b.string))
    if op == "==":
        if a.boolean is not None and b.boolean is not None:
            tried.append(a.boolean == b.boolean)
        if a.json is not None and b.json is not None:
            tried.append(a.json == b.json)
    return F.coalesce(*tried, F.lit(False))


def java_pattern(text: str) -> str | None:
    """``/x/`` and ``/x/i`` without the slashes; None if Java can't compile it, which then matches nothing."""
    m = re.fullmatch(r"/(.*)/(i?)", text, re.S)
    pattern = ("(?iu)" if m[2] else "") + m[1] if m else text
    try:
        SparkSession.active().sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception:
        return None
    return pattern


def _matches(a: _Operand, b: _Operand) -> tuple[Column, Column]:
    """(whether it applies at all, whether it matches)."""
    if a.string is None or b.string is None:
        return F.lit(False), F.lit(False)
    applies = F.lit(True)
    for x in (a, b):
        if not isinstance(x.constant, str):
            applies = applies & x.string.isNotNull()
    if isinstance(b.constant, str):
        pattern = java_pattern(b.constant)
        return applies, F.lit(False) if pattern is None else F.coalesce(a.string.rlike(pattern), F.lit(False))
    inner = F.regexp_extract(b.string, r"(?s)^/(.*)/(i?)$", 1)
    slashed = b.string.rlike(r"(?s)^/.*/i?$")
    pattern = F.when(slashed, F.concat(F.when(b.string.endswith("/i"), F.lit("(?iu)")).otherwise(F.lit("")), inner)).otherwise(b.string)
    return applies, F.coalesce(F.regexp_like(a.string, pattern), F.lit(False))


def search_column(text: str, properties: Column | Bag) -> Column:
    """Whether a top-level string property holds the text, in any case. Empty text: no match."""
    if not text:
        return F.lit(False)
    if isinstance(properties, Bag):
        held = [F.coalesce(F.contains(F.lower(c), F.lower(F.lit(text))), F.lit(False)) for c, kind in properties.columns.values() if isinstance(kind, T.StringType)]
        return reduce(lambda a, b: a | b, held, F.lit(False))
    values = F.map_values(properties.try_cast("map<string,variant>"))
    wanted = F.lower(F.lit(text))
    return F.coalesce(F.exists(values, lambda v: (kind_of(v) == "STRING") & F.contains(F.lower(F.try_variant_get(v, "$", "string")), wanted)), F.lit(False))


def compile_program(program: Sequence[Node], properties: Column | Bag | str = "properties", centroid: Column | str | None = None) -> Column:
    """``centroid``: struct of x (longitude) and y (latitude); without it, ``near`` is false."""
    bag = F.col(properties) if isinstance(properties, str) else properties
    centre = F.col(centroid) if isinstance(centroid, str) else centroid
    false = F.lit(False)
    stack: list[_Operand] = []
    needed: list[Column] = []
    for node in program:
        if isinstance(node, Path):
            if not node.steps:
                stack.append(_Truth(F.lit(True)))
            else:
                stack.append(bag.at(node) if isinstance(bag, Bag) else _Value(step_into(bag, node)))
        elif isinstance(node, Literal):
            stack.append(_Constant(node.value))
        elif isinstance(node, Search):
            stack.append(_Truth(search_column(node.text, bag)))
        elif isinstance(node, Near):
            near = false
            if centre is not None:
                metres = haversine(centre["x"], centre["y"], F.lit(node.lon), F.lit(node.lat))
                near = F.coalesce(metres <= node.metres, false)
            stack.append(_Truth(near))
        elif isinstance(node, Condition) and node.op == "not":
            if not stack:
                return false
            stack.append(_Truth(~stack.pop().truth))
        else:
            if len(stack) < 2:
                return false
            b, a = stack.pop(), stack.pop()
            if isinstance(node, Condition):
                stack.append(_Truth(a.truth & b.truth if node.op == "and" else a.truth | b.truth))
            elif node.op == "=~":
                applies, found = _matches(a, b)
                needed.append(applies)
                stack.append(_Truth(found))
            else:
                needed += [x.present for x in (a, b) if isinstance(x, (_Value, _Field))]
                stack.append(_Truth(_compare(node.op, a, b)))
    if len(stack) != 1:
        return false
    return _all([*needed, stack[0].truth])


def predicate(text: str, properties: Column | Bag | str = "properties", centroid: Column | str | None = None, strict: bool = False) -> Column:
    return compile_program(parse_or_search(text, strict), properties, centroid)
