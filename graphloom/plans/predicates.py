"""Boolean predicates over node properties, with two-valued logic.

A property test is true or false, never unknown. Negations of single tests are rewritten to the opposite test, so that
`not eq` keeps a missing property false; other negations flip what their operand evaluates to. Positive tests stay bare
comparisons, which reach the Parquet scan; only what stands below a remaining negation is coalesced to false.
"""

from __future__ import annotations

import base64
import datetime as dt
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.errors import GraphError

MAX_NODES, MAX_DEPTH, MAX_IN, MAX_BYTES = 10_000, 256, 10_000, 1 << 20

COMPARISONS = ("eq", "ne", "lt", "le", "gt", "ge")
TESTS = (*COMPARISONS, "between", "in", "exists", "isNull", "isNotNull")
OPPOSITE = {"eq": "ne", "ne": "eq", "lt": "ge", "ge": "lt", "gt": "le", "le": "gt", "isNull": "isNotNull", "isNotNull": "isNull"}


@dataclass(frozen=True)
class Test:
    """One property test. values: the literal, both bounds, or the list."""

    op: str
    var: str
    prop: str
    values: tuple = ()
    inclusive: tuple[bool, bool] = (True, True)


@dataclass(frozen=True)
class Group:
    """and / or of any number of parts, not of one. An empty and is true, an empty or is false."""

    op: str
    parts: tuple


Predicate = Test | Group
TRUE, FALSE = Group("and", ()), Group("or", ())


def literal(raw):
    """A Python value, or a tagged one: {"t": "Int", "v": 5}. DateTime counts nanoseconds since 1970, Bytes is base64."""
    if not isinstance(raw, dict):
        return raw
    kind, v = raw.get("t"), raw.get("v")
    if kind == "Null":
        return None
    if kind == "Bytes":
        try:
            return base64.b64decode(v, validate=True)
        except (ValueError, TypeError):
            raise GraphError("BytesEncoding", "a Bytes literal isn't base64") from None
    if kind == "DateTime":
        if not -(1 << 63) <= v < 1 << 63:
            raise GraphError("DateTimeInvalid", "a DateTime literal counts nanoseconds in 64 bits")
        return dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=v // 1000)
    if kind == "Date":
        return dt.date.fromisoformat(v)
    if kind in ("Bool", "Int", "Float", "String"):
        return {"Bool": bool, "Int": int, "Float": float, "String": str}[kind](v)
    raise GraphError("TypeMismatch", f"no literal has the type {kind!r}")


def parse(spec: dict | None) -> Predicate:
    """From {"op": ..., "args": [...]} groups and {"op", "var", "prop", "value" | "values" | "low", "high"} tests."""
    if spec is None:
        return TRUE
    op = spec.get("op")
    if op in ("and", "or"):
        return Group(op, tuple(parse(p) for p in spec.get("args", ())))
    if op == "not":
        args = spec["args"] if isinstance(spec.get("args"), list) else [spec.get("arg", spec.get("args"))]
        if len(args) != 1 or args[0] is None:
            raise GraphError("InvalidPredicate", "a negation has one operand")
        return Group("not", (parse(args[0]),))
    op = {"isnull": "isNull", "isnotnull": "isNotNull"}.get(op, op)
    if op not in TESTS:
        raise GraphError("InvalidPredicate", f"no test is called '{op}'")
    if op == "between":
        values, inclusive = (literal(spec.get("low")), literal(spec.get("high"))), tuple(spec.get("inclusive", (True, True)))
        return Test(op, spec["var"], spec["prop"], values, (bool(inclusive[0]), bool(inclusive[1])))
    if op == "in":
        return Test(op, spec["var"], spec["prop"], tuple(literal(v) for v in spec.get("values", ())))
    return Test(op, spec["var"], spec["prop"], (literal(spec.get("value")),) if op in COMPARISONS else ())


def tests(p: Predicate) -> Iterator[Test]:
    if isinstance(p, Test):
        yield p
    else:
        for part in p.parts:
            yield from tests(part)


def _measure(p: Predicate) -> tuple[int, int]:
    if isinstance(p, Test):
        return 1, 1
    sizes = [_measure(x) for x in p.parts]
    return 1 + sum(n for n, _ in sizes), 1 + max((d for _, d in sizes), default=0)


def kind(v) -> str:
    if isinstance(v, bool):
        return "bool"
    if isinstance(v, int | float):
        return "number"
    if isinstance(v, str):
        return "string"
    if isinstance(v, bytes | bytearray):
        return "bytes"
    return "time" if isinstance(v, dt.date) else "null" if v is None else "other"


def check(p: Predicate) -> Predicate:
    """Limits and literal rules; nulls leave an in-list, its values lose duplicates and are sorted."""
    nodes, depth = _measure(p)
    if nodes > MAX_NODES:
        raise GraphError("PredicateTooLarge", f"a predicate of {nodes} nodes, {MAX_NODES} are allowed")
    if depth > MAX_DEPTH:
        raise GraphError("PredicateTooDeep", f"a predicate {depth} levels deep, {MAX_DEPTH} are allowed")
    return _checked(p)


def _checked(p: Predicate) -> Predicate:
    if isinstance(p, Group):
        return replace(p, parts=tuple(_checked(x) for x in p.parts))
    kinds = {kind(v) for v in p.values}
    if "other" in kinds:
        raise GraphError("TypeMismatch", f"a literal of {p.op} has a type that properties can't have")
    if any(isinstance(v, float) and not math.isfinite(v) for v in p.values):
        raise GraphError("NonFiniteFloat", "a literal is infinite or not a number")
    if sum(len(v) for v in p.values if isinstance(v, bytes | bytearray)) > MAX_BYTES:
        raise GraphError("BytesLiteralTooLarge", f"bytes literals may have {MAX_BYTES} bytes")
    if p.op in ("lt", "le", "gt", "ge", "between"):
        if "null" in kinds:
            raise GraphError("NullNotAllowed", f"null has no place in an order, {p.op} needs a value")
        if kinds & {"bool", "bytes"}:
            raise GraphError("TypeMismatch", f"{p.op} compares numbers, times and text only")
        if p.op == "between":
            if len(kinds) > 1:
                raise GraphError("TypeMismatch", "the bounds of between differ in type")
            low, high = (_instant(v) for v in p.values)
            if low > high:
                raise GraphError("InvalidBounds", "the low bound of between is above the high one")
    if p.op == "in":
        values = [v for v in p.values if v is not None]
        if not values:
            raise GraphError("InListEmpty", "a list of in has no value besides null")
        if len(values) > MAX_IN:
            raise GraphError("InListTooLarge", f"a list of in may have {MAX_IN} values")
        if len(kinds - {"null"}) > 1:
            raise GraphError("TypeMismatch", "the values of in differ in type")
        return replace(p, values=tuple(sorted(set(values), key=_instant)))
    return p


def _instant(v):
    return dt.datetime.combine(v, dt.time()) if isinstance(v, dt.date) and not isinstance(v, dt.datetime) else v


def normalize(p: Predicate, negate: bool = False) -> Predicate:
    """Flat groups without repeats, constants folded, negations only on tests and groups that can't be turned around."""
    if isinstance(p, Test):
        if not negate:
            return p
        return replace(p, op=OPPOSITE[p.op]) if p.op in OPPOSITE else Group("not", (p,))
    if p.op == "not":
        return normalize(p.parts[0], not negate)
    zero, one = (TRUE, FALSE) if p.op == "and" else (FALSE, TRUE)
    parts: list[Predicate] = []
    for x in map(normalize, p.parts):
        for y in x.parts if isinstance(x, Group) and x.op == p.op else (x,):
            if y not in parts:
                parts.append(y)
    if one in parts:
        out: Predicate = one
    else:
        parts = [x for x in parts if x != zero]
        out = parts[0] if len(parts) == 1 else Group(p.op, tuple(parts))
    if not negate:
        return out
    if out in (TRUE, FALSE):
        return FALSE if out == TRUE else TRUE
    if isinstance(out, Test):
        return normalize(out, True)
    return out.parts[0] if out.op == "not" else Group("not", (out,))


def conjuncts(p: Predicate) -> list[Predicate]:
    return list(p.parts) if isinstance(p, Group) and p.op == "and" else [p]


_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def typed(test: Test, data: T.DataType) -> tuple:
    """The test's literals as columns for a property of this type; a literal that can't be compared is an error."""
    of = (
        "number" if isinstance(data, _NUMBERS) else "string" if isinstance(data, T.StringType) else "bool" if isinstance(data, T.BooleanType) else "bytes" if isinstance(data, T.BinaryType)
        else "time" if isinstance(data, T.DateType | T.TimestampType | T.TimestampNTZType) else "other"
    )
    out = []
    for v in test.values:
        if v is not None and kind(v) != of and not (of == "time" and kind(v) == "number"):
            raise GraphError("TypeMismatch", f"{test.op}: property '{test.prop}' of type {data.simpleString()} can't be compared with a {kind(v)}")
        if of == "time" and v is not None:
            if kind(v) == "number":  # days or milliseconds since 1970, as they are stored
                v = dt.date(1970, 1, 1) + dt.timedelta(days=int(v)) if isinstance(data, T.DateType) else dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=v)
            instant = _instant(v)
            out.append(F.lit(instant.isoformat(sep=" ")).cast("date" if isinstance(data, T.DateType) and instant == dt.datetime.combine(instant.date(), dt.time()) else "timestamp_ntz" if not isinstance(data, T.TimestampType) else "timestamp"))
        else:
            out.append(F.lit(v))
    return tuple(out)


def column(p: Predicate, of: Callable[[Test], tuple[Column, Column, T.DataType]], strict: bool = False) -> Column:
    """A predicate as a Column. of(test): the property, whether it is present, its type. strict: false instead of null."""
    if isinstance(p, Group):
        if p.op == "not":
            return ~column(p.parts[0], of, True)
        out = F.lit(p.op == "and")
        for i, x in enumerate(p.parts):
            c = column(x, of, strict)
            out = c if not i else (out & c if p.op == "and" else out | c)
        return out
    value, there, data = of(p)
    lits = typed(p, data)
    if p.op == "exists":
        return there
    if p.op in ("isNull", "isNotNull"):
        return value.isNull() if p.op == "isNull" else value.isNotNull()
    if p.op in ("eq", "ne") and p.values[0] is None:
        return value.isNull() if p.op == "eq" else value.isNotNull()
    if p.op == "in":
        c = value.isin(*lits)
    elif p.op == "between":
        c = (value >= lits[0] if p.inclusive[0] else value > lits[0]) & (value <= lits[1] if p.inclusive[1] else value < lits[1])
    else:
        c = {"eq": value == lits[0], "ne": value != lits[0], "lt": value < lits[0], "le": value <= lits[0], "gt": value > lits[0], "ge": value >= lits[0]}[p.op]
    return F.coalesce(c, F.lit(False)) if strict else c
