"""Checks for absent values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.plans.registry import check


def present(columns):
    """How many of the columns are non-null in the row."""
    return reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in columns])


@check("completeness", "high")
def Null(t, columns=None, mostly=None):
    """Null values per column."""
    for c in t.columns_or(columns):
        t.rows(c, F.col(c).isNull(), mostly=mostly)


@check("completeness", "critical")
def NotNull(t, column):
    """The column has no null value."""
    t.rows(column, F.col(column).isNull())


@check("completeness")
def CompletenessRatio(t, column, min_ratio=0.95):
    """Share of non-null values is at least the minimum."""
    share = t.stat(F.avg(F.col(column).isNotNull().cast("int")))
    t.value(column, share, lo=min_ratio)


@check("completeness")
def EmptyString(t, columns=None):
    """Empty strings per string column."""
    for c in t.columns_or(columns, T.StringType):
        t.rows(c, F.col(c) == "", F.col(c).isNotNull())


@check("completeness", "low")
def WhitespaceOnly(t, columns=None):
    """Non-empty strings made of white space only."""
    for c in t.columns_or(columns, T.StringType):
        t.rows(c, F.col(c).rlike(r"^\s+$"), F.col(c).isNotNull())


@check("completeness", "high")
def ConditionalNull(t, column, condition):
    """Null values among rows that meet a condition."""
    t.rows(column, F.col(column).isNull(), F.expr(condition))


@check("completeness", "low")
def DefaultValue(t, column, default_values):
    """Values that equal a placeholder."""
    t.rows(column, F.col(column).isin(list(default_values)), F.col(column).isNotNull())


@check("completeness", "critical")
def RequiredFields(t, columns, treat_empty_as_null=True):
    """All listed fields are filled."""
    def absent(c):
        gone = F.col(c).isNull()
        if treat_empty_as_null and isinstance(t.df.schema[c].dataType, T.StringType):
            gone = gone | (F.trim(F.col(c)) == "")
        return gone
    t.rows(",".join(columns), reduce(lambda a, b: a | b, [absent(c) for c in columns]))


@check("completeness", "high")
def ConditionalRequired(t, column, when_column, when_value):
    """A field is filled when another one has a given value."""
    t.rows(column, F.col(column).isNull(), F.col(when_column) == F.lit(when_value))


@check("completeness")
def MutualCompleteness(t, columns):
    """The columns are all null or all non-null."""
    t.rows(",".join(columns), ~present(columns).isin(0, len(columns)))


@check("completeness")
def AtLeastOneNotNull(t, columns):
    """At least one of the columns is non-null."""
    t.rows(",".join(columns), present(columns) == 0)


@check("completeness")
def ExactlyOneNotNull(t, columns):
    """Exactly one of the columns is non-null."""
    t.rows(",".join(columns), present(columns) != 1)
