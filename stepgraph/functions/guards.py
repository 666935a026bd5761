"""Guards: predicates over a committed view, compiled to Spark columns that are never null.

A view maps each channel to its value column and its version column; version 0 means never written, which is
not the same as a null value.  A channel or path that is missing makes a guard false.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Channel:
    value: Column
    version: Column
    kind: T.DataType | None = None
    default: bool = False


@dataclass(frozen=True)
class Path:
    channel: str
    segments: tuple[str | int, ...] = ()


@dataclass(frozen=True)
class Guard:
    op: str
    args: tuple[Any, ...]


def changed(channel: str) -> Guard:
    return Guard("changed", (channel,))


def version_at_least(channel: str, n: int) -> Guard:
    if n < 0:
        raise ValueError("a version is not negative")
    return Guard("version_at_least", (channel, n))


def path(channel: str, segments: Sequence[str | int]) -> Path:
    return Path(channel, tuple(segments))


def exists(ref: str | Path) -> Guard:
    return Guard("exists", (ref,))


def equals(ref: str | Path, value: Any) -> Guard:
    return Guard("equals", (ref, value))


def all_of(*guards: Guard) -> Guard:
    return Guard("all", guards)


def any_of(*guards: Guard) -> Guard:
    return Guard("any", guards)


def not_(guard: Guard) -> Guard:
    return Guard("not", (guard,))


def _family(kind: T.DataType | None) -> str:
    """Types whose values can be equal to one another."""
    if isinstance(kind, (T.IntegralType, T.FractionalType)):
        return "number"
    return "unknown" if kind is None or isinstance(kind, T.NullType) else type(kind).__name__


def kind_of(ref: str | Path, view: dict[str, Channel]) -> T.DataType | None:
    """The type of what a reference names, None if it is not known or nothing."""
    kind = view[ref if isinstance(ref, str) else ref.channel].kind
    for segment in () if isinstance(ref, str) else ref.segments:
        if isinstance(kind, T.StructType):
            kind = kind[segment].dataType if segment in kind.names else None
        else:
            kind = getattr(kind, "valueType", None) or getattr(kind, "elementType", None)
    return kind


def _same(left: Column, kind: T.DataType | None, right: Column, other: T.DataType | None) -> Column:
    """Whether two values are equal; values of unlike types are not, and are never cast into one another."""
    families = {_family(kind), _family(other)}
    if "unknown" not in families and len(families) == 2:
        return left.isNull() & right.isNull()
    if families & {"MapType", "StructType", "ArrayType"}:
        return F.to_json(F.struct(left.alias("v"))) == F.to_json(F.struct(right.alias("v")))
    return left.eqNullSafe(right)


def resolve(ref: str | Path, view: dict[str, Channel]) -> tuple[Column, Column]:
    """(whether the reference resolves, its value)."""
    name, segments = (ref, ()) if isinstance(ref, str) else (ref.channel, ref.segments)
    if name not in view:
        raise KeyError(f"unknown channel {name}")
    channel = view[name]
    there = F.lit(True) if channel.default else channel.version > 0
    value, kind = channel.value, channel.kind
    for segment in segments:
        if isinstance(kind, T.StructType):
            if segment not in kind.names:
                return F.lit(False), F.lit(None)
            there = there & value.isNotNull()
            value, kind = value.getField(segment), kind[segment].dataType
        elif isinstance(kind, T.MapType):
            there = there & F.coalesce(F.map_contains_key(value, F.lit(segment)), F.lit(False))
            value, kind = F.try_element_at(value, F.lit(segment)), kind.valueType
        elif isinstance(kind, T.ArrayType) and isinstance(segment, int):
            inside = (F.size(value) > segment) if segment >= 0 else (F.size(value) >= -segment)
            there = there & F.coalesce(inside, F.lit(False))
            value, kind = F.try_element_at(value, F.lit(segment + 1 if segment >= 0 else segment)), kind.elementType
        else:
            return F.lit(False), F.lit(None)
    return F.coalesce(there, F.lit(False)), value


def to_column(guard: Guard, view: dict[str, Channel], written: dict[str, Column] | None = None) -> Column:
    """written: whether each channel was written in the step just committed."""
    inner = lambda g: to_column(g, view, written)
    if guard.op == "all":
        return reduce(lambda a, b: a & b, map(inner, guard.args), F.lit(True))
    if guard.op == "any":
        return reduce(lambda a, b: a | b, map(inner, guard.args), F.lit(False))
    if guard.op == "not":
        return ~inner(guard.args[0])
    if guard.op == "changed":
        return (written or {}).get(guard.args[0], F.lit(False))
    if guard.op == "version_at_least":
        return view[guard.args[0]].version >= guard.args[1]
    if guard.op == "exists":
        return resolve(guard.args[0], view)[0]
    if guard.op == "equals":
        there, left = resolve(guard.args[0], view)
        other = guard.args[1]
        kind = kind_of(guard.args[0], view)
        if isinstance(other, Path):
            also, right = resolve(other, view)
            return there & also & _same(left, kind, right, kind_of(other, view))
        literal = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType()}.get(type(other))
        return there & _same(left, kind, F.lit(other), literal)
    raise ValueError(f"unknown guard {guard.op}")
