"""The schema language, compiled to a column of reasons why a value is not valid."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T



def compiles(pattern: str) -> bool:
    """Whether a pattern is valid for Python, which checks values on the driver, and for Java, which checks rows."""
    try:
        re.compile(pattern)
    except re.error:
        return False
    context = SparkContext._active_spark_context
    if context is None or context._jvm is None:
        return True
    try:
        context._jvm.java.util.regex.Pattern.compile(pattern)
    except (Py4JJavaError, IllegalArgumentException):
        return False
    return True


KINDS = ("string", "integer", "float", "boolean", "map", "object", "enum", "list")


@dataclass(frozen=True)
class Schema:
    kind: str
    required: bool = False
    min: float | None = None
    max: float | None = None
    min_length: int | None = None
    max_length: int | None = None
    pattern: str | None = None
    values: tuple[Any, ...] = ()
    item: Schema | None = None
    min_items: int | None = None
    max_items: int | None = None
    fields: dict[str, Schema] = field(default_factory=dict)
    open: bool = False

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"unknown schema type {self.kind}")
        if self.kind == "list" and self.item is None:
            raise ValueError("a list needs an item schema")
        if self.kind == "enum" and not self.values:
            raise ValueError("an enum needs values")

    @staticmethod
    def of(what: Any) -> Schema:
        """A schema from its short form: "string", ("integer", {"min": 0}), ("list", item), ("enum", values) or ("object", fields), the last three with options too."""
        if isinstance(what, Schema):
            return what
        if isinstance(what, str):
            return Schema(what)
        if not isinstance(what, tuple) or not 2 <= len(what) <= 3 or not isinstance(what[0], str):
            raise ValueError(f"not a schema: {what!r}")
        kind, inner, options = what[0], what[1], what[2] if len(what) == 3 else {}
        if kind == "list":
            return Schema(kind, item=Schema.of(inner), **options)
        if kind == "enum":
            return Schema(kind, values=tuple(inner), **options)
        if kind == "object":
            return Schema(kind, fields={k: Schema.of(v) for k, v in inner.items()}, **options)
        if len(what) == 3 or not isinstance(inner, dict):
            raise ValueError(f"not a schema: {what!r}")
        return Schema(kind, **inner)

    def sound(self) -> bool:
        """Whether bounds are in order and patterns compile, here and inside."""
        for low, high in ((self.min, self.max), (self.min_length, self.max_length), (self.min_items, self.max_items)):
            if low is not None and high is not None and low > high:
                return False
        if any(n is not None and n < 0 for n in (self.min_length, self.max_length, self.min_items, self.max_items)):
            return False
        if self.pattern is not None and not compiles(self.pattern):
            return False
        return all(s.sound() for s in (*self.fields.values(), *([self.item] if self.item else [])))

    def covers(self, other: Schema) -> bool:
        """Whether values of another schema fit this one by type: the same kind, a subset of an enum, items alike."""
        if self.kind != other.kind:
            return False
        if self.kind == "enum":
            return set(other.values) <= set(self.values)
        return self.kind != "list" or self.item.covers(other.item)

    def spark_type(self) -> T.DataType:
        if self.kind == "integer":
            wide = any(v is not None and abs(v) > 2**63 - 1 for v in (self.min, self.max))
            return T.DecimalType(38, 0) if wide else T.LongType()
        if self.kind == "list":
            return T.ArrayType(self.item.spark_type(), True)
        if self.kind == "object":
            return T.StructType([T.StructField(k, v.spark_type(), True) for k, v in self.fields.items()])
        if self.kind == "enum":
            kind = type(self.values[0])
            return {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType()}.get(kind, T.StringType())
        plain = {"string": T.StringType(), "float": T.DoubleType(), "boolean": T.BooleanType()}
        return plain.get(self.kind) or T.MapType(T.StringType(), T.StringType())


def _checks(schema: Schema, value: Column, at: str) -> list[tuple[Column, str]]:
    out: list[tuple[Column, str]] = []
    if schema.required:
        out.append((value.isNull(), f"{at} is required"))
    if schema.min is not None:
        out.append((value < F.lit(schema.min), f"{at} must be at least {schema.min}"))
    if schema.max is not None:
        out.append((value > F.lit(schema.max), f"{at} must be at most {schema.max}"))
    if schema.min_length is not None:
        out.append((F.char_length(value) < schema.min_length, f"{at} must have at least {schema.min_length} characters"))
    if schema.max_length is not None:
        out.append((F.char_length(value) > schema.max_length, f"{at} must have at most {schema.max_length} characters"))
    if schema.pattern is not None:
        if compiles(schema.pattern):
            out.append((~value.rlike(schema.pattern), f"{at} must match {schema.pattern}"))
        else:
            out.append((value.isNotNull(), f"{at} has an invalid pattern"))
    if schema.kind == "enum":
        out.append((~value.isin(*schema.values), f"{at} must be one of {', '.join(map(str, schema.values))}"))
    if schema.min_items is not None:
        out.append((F.size(value) < schema.min_items, f"{at} must have at least {schema.min_items} items"))
    if schema.max_items is not None:
        out.append((F.size(value) > schema.max_items, f"{at} must have at most {schema.max_items} items"))
    if schema.kind == "object":
        for name in sorted(schema.fields):
            out += _checks(schema.fields[name], value.getField(name), f"{at}.{name}")
    return out


def violations(schema: Schema, value: Column, at: str) -> Column:
    """An array of reasons, empty for a valid value; null is valid unless required."""
    found = [F.when(F.coalesce(bad, F.lit(False)), F.lit(reason)) for bad, reason in _checks(schema, value, at)]
    out = F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")
    if schema.kind == "list":
        item = lambda x, i: F.transform(
            violations(schema.item, x, ""), lambda r: F.concat(F.lit(f"{at}["), i.cast("string"), F.lit("]"), r)
        )
        out = F.concat(out, F.coalesce(F.flatten(F.transform(value, item)), F.array().cast("array<string>")))
    return out


def row_violations(schemas: dict[str, Schema]) -> Column:
    parts: Sequence[Column] = [violations(s, F.col(name), name) for name, s in sorted(schemas.items())]
    return F.concat(*parts)


def reasons(schema: Schema, value: Any, at: str) -> list[str]:
    """As violations(), for one value on the driver, whose type is not yet known."""
    if value is None:
        return [f"{at} is required"] if schema.required else []
    kinds = {"string": str, "integer": int, "float": (int, float), "boolean": bool, "list": (list, tuple), "map": dict, "object": dict}
    flag = isinstance(value, bool) and schema.kind != "boolean"
    if schema.kind == "enum":
        same = any(type(v) is type(value) and v == value for v in schema.values)
        return [] if same else [f"{at} must be one of {', '.join(map(str, schema.values))}"]
    if flag or not isinstance(value, kinds[schema.kind]):
        return [f"{at} must be of type {schema.kind}"]
    out = []
    size = len(value) if hasattr(value, "__len__") else 0
    text, items = schema.kind == "string", schema.kind == "list"
    checks = [
        (schema.min is not None and schema.kind in ("integer", "float") and value < schema.min, f"must be at least {schema.min}"),
        (schema.max is not None and schema.kind in ("integer", "float") and value > schema.max, f"must be at most {schema.max}"),
        (text and schema.min_length is not None and size < schema.min_length, f"must have at least {schema.min_length} characters"),
        (text and schema.max_length is not None and size > schema.max_length, f"must have at most {schema.max_length} characters"),
        (items and schema.min_items is not None and size < schema.min_items, f"must have at least {schema.min_items} items"),
        (items and schema.max_items is not None and size > schema.max_items, f"must have at most {schema.max_items} items"),
    ]
    out += [f"{at} {reason}" for bad, reason in checks if bad]
    if text and schema.pattern is not None and not re.search(schema.pattern, value):
        out.append(f"{at} must match {schema.pattern}")
    if items:
        out += [r for i, x in enumerate(value) for r in reasons(schema.item, x, f"{at}[{i}]")]
    if schema.kind == "object":
        unknown = [] if schema.open else sorted(set(value) - set(schema.fields))
        out += [f"{at}.{k} is not declared" for k in unknown]
        out += [r for k in sorted(schema.fields) for r in reasons(schema.fields[k], value.get(k), f"{at}.{k}")]
    return out
