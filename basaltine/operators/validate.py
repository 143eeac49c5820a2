"""Checks of columns and rows, built as expressions from a description of what is allowed."""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Domains of the numeric kinds; floats must be finite.
KINDS = {
    "u8": (0, 255), "i8": (-128, 127), "u16": (0, 65535), "i16": (-32768, 32767),
    "u32": (0, (1 << 32) - 1), "i32": (-(1 << 31), (1 << 31) - 1), "f32": (-3.4028234663852886e38, 3.4028234663852886e38), "f64": (-1.7976931348623157e308, 1.7976931348623157e308),
}


class UnsupportedSchema(ValueError):
    """The schema asks for something that would only be approximated."""


def _f32(value: float, up: bool) -> float:
    """The nearest single-precision number at or above (below) a value."""
    near = struct.unpack("<f", struct.pack("<f", value))[0]
    if (near >= value) if up else (near <= value):
        return near
    bits = struct.unpack("<i", struct.pack("<f", near))[0]
    away = 1 if (near > 0) == up or near == 0 else -1
    if near == 0 and not up:
        return -struct.unpack("<f", struct.pack("<i", 1))[0]
    return struct.unpack("<f", struct.pack("<i", bits + away))[0]


def _limits(kind: str, low: float | None, high: float | None) -> tuple[float, float]:
    a, b = KINDS[kind]
    return a if low is None else max(a, low), b if high is None else min(b, high)


def bounds(kind: str, low: float | None = None, high: float | None = None) -> tuple[float, float]:
    """The inclusive bounds in effect: integers round inward, so do single-precision numbers."""
    a, b = _limits(kind, low, high)
    if kind == "f32":
        return _f32(a, True), _f32(b, False)
    return (a, b) if kind == "f64" else (math.ceil(a), math.floor(b))


def invalid(value: Column, kind: str, low: float | None = None, high: float | None = None) -> Column:
    """Whether a number is null, not finite or out of bounds.

    Single-precision values meet the bounds in double precision, where both are exact; a column of doubles may be
    checked as that kind too, and its values are not rounded either.
    """
    a, b = _limits(kind, low, high) if kind == "f32" else bounds(kind, low, high)
    if a > b:
        return F.lit(True)
    bad = value.isNull() | (value < F.lit(a)) | (value > F.lit(b))
    return F.coalesce(bad | F.isnan(value.cast("double")), F.lit(True)) if kind in ("f32", "f64") else F.coalesce(bad, F.lit(True))


def check_column(df: DataFrame, column: str, row_id: str, kind: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """One row: valid, invalid_count and first_invalid (the smallest bad row id, -1 if none)."""
    bad = invalid(F.col(column), kind, low, high)
    return df.agg((F.count_if(bad) == 0).alias("valid"), F.count_if(bad).alias("invalid_count"), F.coalesce(F.min(F.when(bad, F.col(row_id))), F.lit(-1)).cast("bigint").alias("first_invalid"))


@dataclass(frozen=True)
class Rule:
    """What a value must be. Kinds: any never string number integer boolean null literal array object union."""

    kind: str
    low: float | None = None
    high: float | None = None
    open_low: bool = False
    open_high: bool = False
    values: tuple = ()
    items: Rule | None = None
    fields: dict[str, Rule] = field(default_factory=dict)
    optional: frozenset[str] = frozenset()
    options: tuple[Rule, ...] = ()


#: The keywords that a type understands.
WORDS = {
    "number": ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum"), "integer": ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum"),
    "string": ("minLength", "maxLength"), "array": ("minItems", "maxItems", "items"), "object": ("properties", "required", "additionalProperties"),
}


def rule_of(schema: dict) -> Rule:
    """A rule from a subset of JSON Schema; UnsupportedSchema for any other keyword."""
    known = {"type", "const", "enum", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "minLength", "maxLength", "minItems", "maxItems", "items", "properties", "required", "anyOf", "additionalProperties"}
    if isinstance(schema, bool):
        return Rule("any" if schema else "never")
    if set(schema) - known:
        raise UnsupportedSchema(f"unsupported keywords: {sorted(set(schema) - known)}")
    if "anyOf" in schema:
        return Rule("union", options=tuple(map(rule_of, schema["anyOf"])))
    if "const" in schema:
        return Rule("literal", values=(schema["const"],))
    if "enum" in schema:
        return Rule("literal", values=tuple(schema["enum"]))
    kind = schema.get("type", "any")
    if schema.get("additionalProperties", True) is not True:
        # a parsed row has lost its unknown fields
        raise UnsupportedSchema("additionalProperties can only be true")
    if isinstance(kind, list):
        return Rule("union", options=tuple(rule_of({w: v for w, v in schema.items() if w in ("type", *WORDS.get(k, ()))} | {"type": k}) for k in kind))
    stray = set(schema) - {"type", "additionalProperties"} - set(WORDS.get(kind, ()))
    if stray:
        raise UnsupportedSchema(f"{sorted(stray)} say nothing of {kind}")
    if kind in ("number", "integer"):
        return Rule(kind, schema.get("exclusiveMinimum", schema.get("minimum")), schema.get("exclusiveMaximum", schema.get("maximum")), "exclusiveMinimum" in schema, "exclusiveMaximum" in schema)
    if kind == "string":
        return Rule(kind, schema.get("minLength"), schema.get("maxLength"))
    if kind == "array":
        return Rule(kind, schema.get("minItems"), schema.get("maxItems"), items=rule_of(schema["items"]) if "items" in schema else None)
    if kind == "object":
        fields = {n: rule_of(s) for n, s in schema.get("properties", {}).items()}
        return Rule(kind, fields=fields, optional=frozenset(fields) - frozenset(schema.get("required", ())))
    if kind in ("any", "boolean", "null"):
        return Rule(kind)
    raise UnsupportedSchema(f"unsupported type {kind}")


def satisfies(value: Column, rule: Rule) -> Column:
    """Whether a typed value (nested in structs and arrays) satisfies a rule; lengths of text are code points."""

    def within(x: Column) -> Column:
        ok = F.lit(True)
        if rule.low is not None:
            ok = ok & ((x > rule.low) if rule.open_low else (x >= rule.low))
        if rule.high is not None:
            ok = ok & ((x < rule.high) if rule.open_high else (x <= rule.high))
        return ok

    there = value.isNotNull()
    if rule.kind == "any":
        return F.lit(True)
    if rule.kind == "never":
        return F.lit(False)
    if rule.kind == "null":
        return value.isNull()
    if rule.kind == "boolean":
        return there
    if rule.kind == "literal":
        ok = F.lit(False)
        for v in rule.values:
            ok = ok | (value.isNull() if v is None else F.coalesce(value == F.lit(v), F.lit(False)))
        return ok
    if rule.kind in ("number", "integer"):
        d = value.cast("double")
        finite = ~F.isnan(d) & (F.abs(d) < float("inf"))
        whole = (F.floor(d) == d) if rule.kind == "integer" else F.lit(True)
        return F.coalesce(there & finite & whole & within(value), F.lit(False))
    if rule.kind == "string":
        return F.coalesce(there & within(F.char_length(value)), F.lit(False))
    if rule.kind == "array":
        inner = F.forall(value, lambda x: satisfies(x, rule.items)) if rule.items is not None else F.lit(True)
        return F.coalesce(there & within(F.size(value)) & inner, F.lit(False))
    if rule.kind == "object":
        ok = there
        for name, r in rule.fields.items():
            part = value[name]
            ok = ok & (part.isNull() | satisfies(part, r) if name in rule.optional else satisfies(part, r))
        return F.coalesce(ok, F.lit(False))
    if rule.kind == "union":
        ok = F.lit(False)
        for r in rule.options:
            ok = ok | satisfies(value, r)
        return ok
    raise UnsupportedSchema(rule.kind)


def first_issue(row: dict[str, Rule]) -> Column:
    """The name of the first column that fails its rule, null if none does."""
    return F.coalesce(*[F.when(~satisfies(F.col(n), r), F.lit(n)) for n, r in row.items()], F.lit(None).cast("string"))


def nullable(rule: Rule) -> Rule:
    """A rule that null satisfies too."""
    return Rule("union", options=(Rule("null"), rule))


def issues(value: Column, rule: Rule, path: str = "") -> Column:
    """array<struct<code, path, expected>>: what of a value breaks a rule, down to its fields and elements.

    Codes are ``type`` (null or another kind), ``range``, ``length``, ``literal`` and ``union``; a path is like
    ``a.b[2]``. Fields come in the order of the rule.
    """
    here = F.lit(path) if isinstance(path, str) else path

    def issue(code: str, expected: str) -> Column:
        return F.array(F.struct(F.lit(code).alias("code"), here.alias("path"), F.lit(expected).alias("expected")))

    none = F.filter(issue("", ""), lambda x: F.lit(False))
    if rule.kind == "object":
        found = none
        for name, r in rule.fields.items():
            at = F.concat(here, F.when(here == "", F.lit("")).otherwise(F.lit(".")), F.lit(name))
            inner = issues(value[name], r, at)
            found = F.concat(found, F.when(value[name].isNull(), none).otherwise(inner) if name in rule.optional else inner)
        return F.when(value.isNull(), issue("type", "object")).otherwise(found)
    if rule.kind == "array":
        length = F.when(satisfies(value, Rule("array", rule.low, rule.high)), none).otherwise(issue("length", f"{rule.low} to {rule.high}"))
        inner = none
        if rule.items is not None:
            inner = F.flatten(F.transform(value, lambda x, i: issues(x, rule.items, F.concat(here, F.lit("["), i.cast("string"), F.lit("]")))))
        return F.when(value.isNull(), issue("type", "array")).otherwise(F.concat(length, inner))
    code, expected = {"number": ("range", f"{rule.low} to {rule.high}"), "integer": ("range", f"whole, {rule.low} to {rule.high}"), "string": ("length", f"{rule.low} to {rule.high}"), "literal": ("literal", ", ".join(map(str, rule.values))), "union": ("union", "one of several")}.get(rule.kind, ("type", rule.kind))
    broken = issue(code, expected)
    if rule.kind in ("number", "integer", "string", "boolean"):
        broken = F.when(value.isNull(), issue("type", rule.kind)).otherwise(broken)
    return F.when(satisfies(value, rule), none).otherwise(broken)


def check_json(df: DataFrame, column: str, ddl: str, rule: Rule) -> DataFrame:
    """``df`` with ``valid``: whether JSON text parses into a type and satisfies a rule."""
    parsed = F.from_json(F.col(column), ddl, {"mode": "PERMISSIVE"})
    return df.withColumn("valid", F.coalesce(parsed.isNotNull() & satisfies(parsed, rule), F.lit(False)))
