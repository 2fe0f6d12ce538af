"""Checks of the table's shape and of column relations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.numeric import compare
from plumbline.plans.registry import check

# Accepted type names (lower case) and the Spark type each stands for.
TYPE_NAMES = {
    "int8": T.ByteType, "int16": T.ShortType, "int32": T.IntegerType, "int64": T.LongType,
    "uint8": T.ShortType, "uint16": T.IntegerType, "uint32": T.LongType, "uint64": T.DecimalType,
    "float32": T.FloatType, "float64": T.DoubleType, "boolean": T.BooleanType, "bool": T.BooleanType,
    "string": T.StringType, "utf8": T.StringType, "date": T.DateType, "duration": T.DayTimeIntervalType,
    "categorical": T.StringType, "decimal": T.DecimalType, "list": T.ArrayType, "struct": T.StructType,
    "byte": T.ByteType, "short": T.ShortType, "int": T.IntegerType, "integer": T.IntegerType,
    "long": T.LongType, "bigint": T.LongType, "float": T.FloatType, "double": T.DoubleType,
    "array": T.ArrayType, "map": T.MapType, "binary": T.BinaryType,
}


def type_matches(actual: T.DataType, wanted: str) -> bool:
    name = wanted.strip().lower()
    if name in ("datetime", "timestamp", "timestamp_ntz"):
        return isinstance(actual, (T.TimestampType, T.TimestampNTZType))
    if name in TYPE_NAMES:
        return isinstance(actual, TYPE_NAMES[name])
    return actual.simpleString() == name


def schema_differences(actual: T.StructType, wanted: dict[str, str], strict: bool) -> int:
    """Missing columns + wrong types (+ extra columns when strict)."""
    have = {f.name: f.dataType for f in actual.fields}
    bad = sum(1 for c, t in wanted.items() if c not in have or not type_matches(have[c], t))
    return bad + (sum(1 for c in have if c not in wanted) if strict else 0)


def as_schema(schema) -> dict[str, str]:
    if isinstance(schema, T.StructType):
        return {f.name: f.dataType.simpleString() for f in schema.fields}
    return {k: (v["type"] if isinstance(v, dict) else v) for k, v in dict(schema).items()}


@check("schema", "critical")
def ColumnExists(t, columns):
    """Named columns are present."""
    cols = t.columns_or(columns)
    for c in cols:
        t.facts(c, int(c not in t.df.columns), 1)


@check("schema", "high")
def ColumnNotExists(t, columns):
    """Named columns are absent."""
    for c in t.columns_or(columns):
        t.facts(c, int(c in t.df.columns), 1)


def count_in_range(n, expected, lo, hi) -> bool:
    return ((expected is None or n == expected) and (lo is None or n >= lo) and (hi is None or n <= hi))


@check("schema")
def ColumnCount(t, expected=None, min_count=None, max_count=None):
    """Number of columns is as expected or within bounds."""
    n = len(t.df.columns)
    t.facts(None, int(not count_in_range(n, expected, min_count, max_count)), 1, n)


@check("schema")
def RowCount(t, expected=None, min_count=None, max_count=None):
    """Number of rows is as expected or within bounds."""
    n = t.stat(F.count(F.lit(1)))
    lo = min_count if expected is None else expected
    hi = max_count if expected is None else expected
    t.value(None, n, lo, hi)


@check("schema", "high")
def ColumnType(t, column, expected_type):
    """A column has the expected type."""
    t.facts(column, int(not type_matches(t.df.schema[column].dataType, expected_type)), 1)


@check("schema", "low")
def ColumnOrder(t, expected_order, strict=False):
    """Columns appear in the given order (strict: exactly these)."""
    have, want = t.df.columns, list(expected_order)
    if strict:
        ok = have == want
    else:
        ok = [c for c in have if c in want] == [c for c in want if c in have]
    t.facts(None, int(not ok), 1)


@check("schema", "critical")
def TableSchema(t, schema, strict=False):
    """The table has the given columns and types (strict: no others)."""
    want = as_schema(schema)
    t.facts(None, schema_differences(t.df.schema, want, strict), len(want))


@check("schema")
def ColumnPair(t, column_a, column_b, relationship):
    """Two columns stand in the given relation."""
    a, b = F.col(column_a), F.col(column_b)
    t.rows(f"{column_a},{column_b}", ~compare(relationship, a, b), a.isNotNull() & b.isNotNull())


@check("schema", "critical")
def MultiColumnUnique(t, columns):
    """The column combination is unique."""
    g = t.groups(columns)
    n = F.col("n")
    t.verdict(",".join(columns), t.stat(F.coalesce(F.sum(F.when(n > 1, n)), F.lit(0)), g),
              t.stat(F.coalesce(F.sum(n), F.lit(0)), g), frame=g)


@check("schema", "critical")
def ReferentialIntegrity(t, column, reference_source_id, reference_column):
    """Every non-null value exists in the reference column."""
    t.missing_parent(column, [column], t.ref(reference_source_id), [reference_column])


def total_of(columns):
    return reduce(lambda a, b: a + b, [F.col(c) for c in columns])


def all_present(columns):
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])


@check("schema")
def MultiColumnSum(t, columns, expected_sum, tolerance=0.0001):
    """The columns of a row add up to a constant."""
    t.rows(",".join(columns), F.abs(total_of(columns) - F.lit(expected_sum)) > tolerance, all_present(columns))


@check("schema")
def MultiColumnCalculation(t, expression, tolerance=0.0001):
    """A boolean expression holds, or a numeric one is zero, in every row."""
    e = F.expr(expression)
    boolean = isinstance(t.df.select(e.alias("e")).schema["e"].dataType, T.BooleanType)
    t.rows(None, ~e if boolean else F.abs(e) > tolerance, e.isNotNull())


def pair_member(a, b, pairs):
    return F.struct(a.alias("a"), b.alias("b")).isin(
        [F.struct(F.lit(x).alias("a"), F.lit(y).alias("b")) for x, y in pairs])


@check("schema")
def ColumnPairInSet(t, column_a, column_b, valid_pairs):
    """The value pair is one of the listed pairs."""
    a, b = F.col(column_a), F.col(column_b)
    t.rows(f"{column_a},{column_b}", ~pair_member(a, b, valid_pairs), a.isNotNull() & b.isNotNull())


@check("schema", "high")
def ColumnPairNotInSet(t, column_a, column_b, forbidden_pairs):
    """The value pair is none of the listed pairs."""
    a, b = F.col(column_a), F.col(column_b)
    t.rows(f"{column_a},{column_b}", pair_member(a, b, forbidden_pairs), a.isNotNull() & b.isNotNull())
