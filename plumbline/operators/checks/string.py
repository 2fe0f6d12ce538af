"""Checks on text."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions import patterns as P
from plumbline.plans.registry import check


def matches(t, column, ok, mostly=None):
    t.rows(column, ~ok, F.col(column).isNotNull(), mostly)


def any_pattern(c, patterns):
    out = F.lit(False)
    for p in patterns:
        out = out | c.rlike(p)
    return out


@check("string")
def Regex(t, column, pattern, mostly=None):
    """Values match a regular expression (found anywhere)."""
    matches(t, column, F.col(column).rlike(pattern), mostly)


@check("string")
def RegexList(t, column, patterns):
    """Values match at least one regular expression."""
    matches(t, column, any_pattern(F.col(column), patterns))


@check("string", "high")
def NotMatchRegex(t, column, pattern):
    """Values do not match a regular expression."""
    matches(t, column, ~F.col(column).rlike(pattern))


@check("string")
def Length(t, column, min_length=None, max_length=None):
    """Text length is within bounds."""
    n, ok = F.length(column), F.lit(True)
    if min_length is not None:
        ok = ok & (n >= min_length)
    if max_length is not None:
        ok = ok & (n <= max_length)
    matches(t, column, ok)


@check("string")
def Email(t, column):
    """Values are e-mail addresses."""
    matches(t, column, F.col(column).rlike(P.EMAIL))


@check("string")
def Url(t, column):
    """Values are URLs."""
    matches(t, column, F.col(column).rlike(P.URL))


@check("string")
def Phone(t, column, country_code=None):
    """Values are phone numbers (of a country when given)."""
    matches(t, column, F.col(column).rlike(P.PHONE[country_code or "any"]))


@check("string")
def Uuid(t, column):
    """Values are UUIDs of version 1 to 5."""
    matches(t, column, F.col(column).rlike(P.UUID))


@check("string")
def IpAddress(t, column, version=None):
    """Values are IPv4 or IPv6 addresses."""
    kinds = {"4": [P.IPV4], "6": [P.IPV6], "ipv4": [P.IPV4], "ipv6": [P.IPV6]}
    matches(t, column, any_pattern(F.col(column), kinds.get(str(version).lower(), [P.IPV4, P.IPV6])))


@check("string")
def Format(t, column, format_type):
    """Values have a named format."""
    matches(t, column, F.col(column).rlike(P.FORMATS[format_type]))


@check("string")
def JsonParseable(t, column):
    """Values are valid JSON."""
    matches(t, column, F.try_parse_json(F.col(column)).isNotNull())


JSON_TYPES = {"string": "string", "integer": "bigint", "number": "double", "boolean": "boolean"}


def json_valid(v: Column, schema: dict, type_of: Column) -> Column:
    """Column that tells whether a VARIANT satisfies a JSON Schema.

    Understands type, enum, minimum, maximum, exclusive bounds, minLength,
    maxLength, pattern, properties, required, items, minItems and maxItems.
    """
    kind = type_of
    ok = F.lit(True)
    wanted = schema.get("type")
    if wanted:
        tests = {
            "object": kind.startswith("OBJECT"), "array": kind.startswith("ARRAY"), "string": kind == "STRING",
            "integer": kind == "BIGINT", "boolean": kind == "BOOLEAN", "null": kind == "VOID",
            "number": kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL"),
        }
        any_of = F.lit(False)
        for w in [wanted] if isinstance(wanted, str) else wanted:
            any_of = any_of | tests[w]
        ok = ok & any_of
    number = F.try_variant_get(v, "$", "double")
    text = F.try_variant_get(v, "$", "string")
    numeric = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    for key, test in (("minimum", lambda x: number >= x), ("maximum", lambda x: number <= x),
                      ("exclusiveMinimum", lambda x: number > x), ("exclusiveMaximum", lambda x: number < x)):
        if key in schema:
            ok = ok & (~numeric | test(schema[key]))
    for key, test in (("minLength", lambda x: F.length(text) >= x), ("maxLength", lambda x: F.length(text) <= x),
                      ("pattern", lambda x: text.rlike(x))):
        if key in schema:
            ok = ok & ((kind != "STRING") | test(schema[key]))
    if "enum" in schema:
        ok = ok & text.isin([e if isinstance(e, str) else json.dumps(e) for e in schema["enum"]])
    for name in schema.get("required", ()):
        ok = ok & (~kind.startswith("OBJECT") | F.try_variant_get(v, f"$.{name}", "variant").isNotNull())
    for name, sub in schema.get("properties", {}).items():
        child = F.try_variant_get(v, f"$.{name}", "variant")
        ok = ok & (child.isNull() | json_valid(child, sub, F.schema_of_variant(child)))
    items = F.try_variant_get(v, "$", "array<variant>")
    if "items" in schema:
        ok = ok & (~kind.startswith("ARRAY") | F.forall(items, lambda x: json_valid(x, schema["items"], F.schema_of_variant(x))))
    if "minItems" in schema:
        ok = ok & (~kind.startswith("ARRAY") | (F.size(items) >= schema["minItems"]))
    if "maxItems" in schema:
        ok = ok & (~kind.startswith("ARRAY") | (F.size(items) <= schema["maxItems"]))
    return F.coalesce(ok, F.lit(False))


@check("string")
def JsonSchema(t, column, schema):
    """Values are JSON documents that satisfy a schema."""
    spec = json.loads(schema) if isinstance(schema, str) else dict(schema)
    v = F.try_parse_json(F.col(column))
    matches(t, column, v.isNotNull() & json_valid(v, spec, F.schema_of_variant(v)))


@check("string", "low")
def Alphanumeric(t, column):
    """Values hold letters and digits only."""
    matches(t, column, F.col(column).rlike(P.ALPHANUMERIC))


@check("string", "low")
def ConsistentCasing(t, column, casing):
    """Values follow one casing style."""
    c = F.col(column)
    simple = {"lower": F.lower, "upper": F.upper, "title": F.initcap}
    matches(t, column, c == simple[casing](c) if casing in simple else c.rlike(P.CASING[casing]))


@check("string")
def LikePattern(t, column, pattern):
    """Values match an SQL LIKE pattern."""
    matches(t, column, F.col(column).like(pattern))


@check("string", "high")
def NotLikePattern(t, column, pattern):
    """Values do not match an SQL LIKE pattern."""
    matches(t, column, ~F.col(column).like(pattern))


def java_format(fmt: str) -> str:
    """strftime directives to Java letters; other formats pass unchanged."""
    if "%" not in fmt:
        return fmt
    return re.sub(r"%[A-Za-z%]", lambda m: P.STRFTIME.get(m.group(), m.group()), fmt)


def parsed(c: Column, formats=P.DATE_FORMATS) -> Column:
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(java_format(f))) for f in formats])


@check("string")
def DateutilParseable(t, column):
    """Values can be read as a date in one of the usual formats."""
    matches(t, column, parsed(F.col(column).cast("string")).isNotNull())
