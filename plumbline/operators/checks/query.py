"""Checks written by the user as Spark SQL expressions or queries."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import functions as F

from plumbline.functions.numeric import compare
from plumbline.operators.checks.uniqueness import repeated
from plumbline.plans.registry import check

AGGREGATES = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "std": F.stddev_samp, "count": F.count}


def holds(t, expression, column=None, where=None):
    e = F.expr(expression)
    applies = e.isNotNull() if where is None else where & e.isNotNull()
    t.rows(column, ~e, applies)


@check("query")
def Expression(t, expression, description=None):
    """A boolean expression holds in every row where it is defined."""
    holds(t, expression, description)


@check("query")
def CustomExpression(t, expression_str):
    """A boolean expression holds in every row where it is defined."""
    holds(t, expression_str)


@check("query")
def QueryRowCount(t, filter_expression, expected_count=None, max_count=None):
    """Number of rows that meet a filter."""
    n = t.stat(F.count_if(F.expr(filter_expression)))
    t.value(None, n, expected_count, max_count if expected_count is None else expected_count)


@check("query", "high")
def QueryReturnsNoRows(t, filter_expression, violation_message=None):
    """No row meets the filter."""
    t.rows(violation_message, F.expr(filter_expression))


@check("query")
def QueryReturnsRows(t, filter_expression, min_rows=1):
    """At least so many rows meet the filter."""
    t.value(None, t.stat(F.count_if(F.expr(filter_expression))), lo=min_rows)


@check("query")
def QueryAggregate(t, column, aggregate, filter_expression=None, expected_value=None, min_value=None, max_value=None,
                   tolerance=0.0001):
    """An aggregate over filtered rows is as expected."""
    c = F.col(column) if filter_expression is None else F.when(F.expr(filter_expression), F.col(column))
    v = t.stat(AGGREGATES[aggregate](c))
    if expected_value is not None:
        return t.value(column, v, ok=F.abs(v - F.lit(expected_value)) <= tolerance)
    t.value(column, v, min_value, max_value)


@check("query")
def QueryGroupAggregate(t, column, group_by, aggregate, min_value=None, max_value=None):
    """An aggregate per group is within a range."""
    by = [group_by] if isinstance(group_by, str) else list(group_by)
    g = t.frame(f"agg:{by}:{aggregate}:{column}", lambda: t.df.groupBy(*by).agg(
        AGGREGATES[aggregate](F.col(column)).alias("v")))
    v, bad = F.col("v"), F.lit(False)
    if min_value is not None:
        bad = bad | (v < min_value)
    if max_value is not None:
        bad = bad | (v > max_value)
    t.verdict(column, t.stat(F.count_if(bad), g), t.stat(F.count(F.lit(1)), g), frame=g)


@check("query")
def QueryAggregateCompare(t, column, filter_a, filter_b, aggregate, operator, tolerance=0.0001):
    """Aggregates over two filters compare as stated."""
    f, c = AGGREGATES[aggregate], F.col(column)
    a, b = t.stat(f(F.when(F.expr(filter_a), c))), t.stat(f(F.when(F.expr(filter_b), c)))
    if operator in ("eq", "=="):
        ok = F.abs(a - b) <= tolerance
    else:
        ok = compare(operator, a, b)
    t.value(column, a - b, ok=ok)


@check("query")
def QueryColumnValues(t, column, filter_expression=None, expected_values=None, forbidden_values=None):
    """Filtered rows hold expected, and no forbidden, values."""
    c, bad = F.col(column), F.lit(False)
    if expected_values:
        bad = bad | ~c.isin(list(expected_values))
    if forbidden_values:
        bad = bad | c.isin(list(forbidden_values))
    keep = c.isNotNull() if filter_expression is None else F.expr(filter_expression) & c.isNotNull()
    t.rows(column, bad, keep)


@check("query", "high")
def QueryColumnUnique(t, column, filter_expression=None):
    """Values are unique among filtered rows."""
    repeated(t, [column], ignore_null=True, where=None if filter_expression is None else F.expr(filter_expression))


@check("query", "high")
def QueryColumnNotNull(t, column, filter_expression=None):
    """No null among filtered rows."""
    t.rows(column, F.col(column).isNull(), None if filter_expression is None else F.expr(filter_expression))


@check("query")
def ConditionalExpression(t, condition, expression):
    """Where the condition holds, so does the expression."""
    holds(t, expression, where=F.expr(condition))


@check("query")
def MultiCondition(t, conditions, mode="all"):
    """All, any or none of the conditions hold in every row."""
    tests = [F.coalesce(F.expr(c), F.lit(False)) for c in conditions]
    some, every = reduce(lambda a, b: a | b, tests), reduce(lambda a, b: a & b, tests)
    t.rows(None, {"all": ~every, "any": ~some, "none": some}[mode])


@check("query")
def RowLevel(t, expression, min_pass_ratio=1.0):
    """Share of rows in which the expression holds."""
    share = t.stat(F.avg(F.coalesce(F.expr(expression), F.lit(False)).cast("int")))
    t.value(None, share, lo=float(min_pass_ratio))


@check("query")
def SQLQuery(t, query, expect_empty=True):
    """A query over the table (named ``data`` or ``df``) returns no rows, or some."""
    def build():
        # Bound as an argument, so that no session-wide view is left behind.
        return t.df.sparkSession.sql(bind_table(query), data=t.df)
    g = t.frame(f"sql:{query}", build)
    n = t.stat(F.count(F.lit(1)), g)
    ok = (n == 0) if expect_empty else (n > 0)
    t.verdict(None, n if expect_empty else F.when(n > 0, 0).otherwise(1), F.greatest(n, F.lit(1)), ok, n, frame=g)


def bind_table(query):
    """Turn the table names ``data`` and ``df`` into a query argument."""
    escaped = query.replace("{", "{{").replace("}", "}}")
    return re.sub(r"(?i)\b(from|join)\s+(data|df)\b", r"\1 {data}", escaped)


@check("query", "high")
def BusinessRule(t, rule_name, rule_expression, error_message=None, category=None):
    """A named rule holds in every row where it is defined."""
    holds(t, rule_expression, rule_name)
