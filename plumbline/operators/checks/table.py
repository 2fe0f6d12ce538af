"""Checks of the table as a whole."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.checks.datetime import age_days, moment
from plumbline.operators.checks.schema import as_schema, count_in_range, schema_differences, type_matches
from plumbline.plans.registry import check

TRUNC = {"hourly": "hour", "daily": "day", "weekly": "week", "monthly": "month"}


def row_count(t):
    return t.stat(F.count(F.lit(1)))


@check("table", "critical")
def TableNotEmpty(t):
    """The table has at least one row."""
    t.value(None, row_count(t), lo=1)


@check("table")
def TableRowCountRange(t, min_rows=None, max_rows=None):
    """Row count is within bounds."""
    t.value(None, row_count(t), min_rows, max_rows)


@check("table")
def TableRowCountExact(t, expected_rows, tolerance=0):
    """Row count equals a number within a tolerance."""
    t.value(None, row_count(t), expected_rows - tolerance, expected_rows + tolerance)


@check("table")
def TableColumnCount(t, expected_count=None, min_count=None, max_count=None):
    """Number of columns is as expected."""
    n = len(t.df.columns)
    t.facts(None, int(not count_in_range(n, expected_count, min_count, max_count)), 1, n)


@check("table", "critical")
def TableRequiredColumns(t, required_columns):
    """All required columns are present."""
    t.facts(None, sum(c not in t.df.columns for c in required_columns), len(required_columns))


@check("table", "high")
def TableForbiddenColumns(t, forbidden_columns):
    """No forbidden column is present."""
    t.facts(None, sum(c in t.df.columns for c in forbidden_columns), len(forbidden_columns))


@check("table", "high")
def TableFreshness(t, datetime_column, max_age_hours):
    """The newest entry is at most so many hours old."""
    age = age_days(t, t.stat(F.max(moment(datetime_column)))) * 24.0
    t.value(datetime_column, age, ok=F.coalesce(age <= float(max_age_hours), F.lit(False)))


@check("table")
def TableDataRecency(t, datetime_column, max_age_days):
    """The newest entry is at most so many days old."""
    age = age_days(t, t.stat(F.max(moment(datetime_column))))
    t.value(datetime_column, age, ok=F.coalesce(age <= float(max_age_days), F.lit(False)))


def period_number(ts, frequency):
    """Consecutive whole number of the period a moment falls in."""
    days = F.floor(F.unix_micros(ts) / F.lit(86400e6))
    return {
        "hourly": F.floor(F.unix_micros(ts) / F.lit(3600e6)),
        "daily": days,
        "weekly": F.floor((days + 3) / 7),  # weeks start on Monday
        "monthly": F.year(ts) * 12 + F.month(ts),
    }[frequency].cast("long")


@check("table")
def TableUpdateFrequency(t, datetime_column, expected_frequency, tolerance_periods=1):
    """No gap between updates is longer than 1 + tolerance periods."""
    frame = t.frame(f"periods:{datetime_column}:{expected_frequency}", lambda: t.df.select(
        period_number(moment(datetime_column), expected_frequency).alias("p")).dropna().distinct())
    pairs = t.pairs(["p"], {"p": F.col("p")}, source=frame)
    bad = t.stat(("sum", lambda cur, prev: cur("p") - prev("p") > 1 + tolerance_periods), pairs, f"gaps_{tolerance_periods}")
    t.verdict(datetime_column, bad, F.greatest(F.col("rows") - 1, F.lit(0)), frame=pairs)


@check("table", "high")
def TableSchemaMatch(t, expected_schema, strict=False):
    """Schema equals a definition (strict: no other columns)."""
    want = as_schema(expected_schema)
    t.facts(None, schema_differences(t.df.schema, want, strict), len(want))


@check("table", "high")
def TableColumnTypes(t, expected_types):
    """Listed columns have the expected types."""
    have = {f.name: f.dataType for f in t.df.schema.fields}
    for c, wanted in dict(expected_types).items():
        t.facts(c, int(c not in have or not type_matches(have[c], wanted)), 1)


def row_bytes(df):
    """Bytes of a row: fixed widths, and the length of text and JSON forms."""
    width = {T.ByteType: 1, T.BooleanType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4, T.DateType: 4}
    total = F.lit(0).cast("long")
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            part = F.coalesce(F.octet_length(F.col(f.name)), F.lit(0))
        elif isinstance(f.dataType, T.ArrayType):
            part = F.greatest(F.size(F.col(f.name)), F.lit(0)) * width.get(type(f.dataType.elementType), 8)
        elif isinstance(f.dataType, (T.StructType, T.MapType)):
            part = F.coalesce(F.octet_length(F.to_json(F.col(f.name))), F.lit(0))
        else:
            part = F.lit(width.get(type(f.dataType), 8))
        total = total + part
    return total


@check("table", "low")
def TableMemorySize(t, min_size_mb=None, max_size_mb=None):
    """Estimated size of the values in MiB is within bounds."""
    mb = t.stat(F.coalesce(F.sum(row_bytes(t.df)), F.lit(0))) / F.lit(1048576.0)
    t.value(None, mb, min_size_mb, max_size_mb)


@check("table")
def TableDimensions(t, min_rows=None, max_rows=None, min_cols=None, max_cols=None):
    """Rows and columns are within bounds."""
    n, cols = row_count(t), len(t.df.columns)
    ok = F.lit(count_in_range(cols, None, min_cols, max_cols))
    if min_rows is not None:
        ok = ok & (n >= min_rows)
    if max_rows is not None:
        ok = ok & (n <= max_rows)
    t.value(None, n, ok=ok)


@check("table", "low")
def TableRowToColumnRatio(t, min_ratio=None, max_ratio=None):
    """Rows per column are within bounds."""
    t.value(None, row_count(t) / F.lit(float(max(len(t.df.columns), 1))), min_ratio, max_ratio)


@check("table")
def TablePartitionCoverage(t, partition_column, expected_partitions=None, min_rows_per_partition=1):
    """Every expected (or present) partition value has enough rows."""
    g = t.groups([partition_column], F.col(partition_column).isNotNull())
    enough = F.col("n") >= min_rows_per_partition
    if expected_partitions:
        wanted = list(dict.fromkeys(expected_partitions))
        good = t.stat(F.count_if(enough & F.col("k0").isin(wanted)), g)
        return t.verdict(partition_column, F.lit(len(wanted)) - good, F.lit(len(wanted)), frame=g)
    t.verdict(partition_column, t.stat(F.count_if(~enough), g), t.stat(F.count(F.lit(1)), g), frame=g)


@check("table")
def TableNullRatio(t, max_null_ratio=0.1, columns=None):
    """Share of null cells is at most the maximum."""
    cols = t.columns_or(columns)
    nulls = F.lit(0.0)
    for c in cols:
        nulls = nulls + t.stat(F.count_if(F.col(c).isNull()))
    n = row_count(t)
    share = F.when(n > 0, nulls / (n * len(cols))).otherwise(F.lit(0.0))
    t.value(",".join(columns) if columns else None, share, hi=float(max_null_ratio))


@check("table")
def TableDuplicateRatio(t, max_duplicate_ratio=0.01, columns=None):
    """Share of surplus copies among the rows is at most the maximum."""
    g = t.groups(t.columns_or(columns))
    share = t.stat(F.sum(F.col("n") - 1) / F.sum("n"), g)
    t.value(",".join(columns) if columns else None, share, hi=float(max_duplicate_ratio), frame=g)
