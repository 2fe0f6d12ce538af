"""Checks that relate several columns of a row, or two columns overall."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from plumbline.functions.numeric import compare
from plumbline.operators.checks.completeness import present
from plumbline.operators.checks.distribution import in_bounds
from plumbline.operators.checks.schema import all_present, total_of
from plumbline.plans.registry import check


def label(*columns):
    return ",".join(columns)


def off_target(value, expected=None, lo=None, hi=None, tolerance=0.0):
    """Value misses the expected number (within tolerance) or the range."""
    bad = F.lit(False)
    if expected is not None:
        bad = bad | (F.abs(value - F.lit(expected)) > tolerance)
    return bad | ~in_bounds(value, lo, hi)


@check("multi_column")
def ColumnComparison(t, column_a, column_b, operator, mostly=None):
    """Two columns compare as stated."""
    a, b = F.col(column_a), F.col(column_b)
    t.rows(label(column_a, column_b), ~compare(operator, a, b), a.isNotNull() & b.isNotNull(), mostly)


@check("multi_column")
def ColumnArithmetic(t, column_a, column_b, result_column, operation, tolerance=0.0001):
    """a (operation) b equals the result column; division by zero fails."""
    a, b, r = F.col(column_a), F.col(column_b), F.col(result_column)
    value = {"add": lambda: a + b, "subtract": lambda: a - b, "multiply": lambda: a * b,
             "divide": lambda: F.try_divide(a, b), "modulo": lambda: F.try_mod(a, b)}[operation]()
    t.rows(label(column_a, column_b, result_column),
           F.coalesce(F.abs(value - r) > tolerance, F.lit(True)), a.isNotNull() & b.isNotNull() & r.isNotNull())


@check("multi_column")
def ColumnSum(t, columns, target_column, tolerance=0.0001):
    """The columns add up to the target column."""
    t.rows(label(*columns, target_column), F.abs(total_of(columns) - F.col(target_column)) > tolerance,
           all_present([*columns, target_column]))


@check("multi_column")
def ColumnRatio(t, numerator_column, denominator_column, expected_ratio=None, min_ratio=None, max_ratio=None,
                tolerance=0.01):
    """Quotient of two columns is as expected; zero divisors are skipped."""
    ratio = F.try_divide(F.col(numerator_column), F.col(denominator_column))
    t.rows(label(numerator_column, denominator_column),
           off_target(ratio, expected_ratio, min_ratio, max_ratio, tolerance), ratio.isNotNull())


@check("multi_column")
def ColumnCorrelation(t, column_a, column_b, min_correlation=None, max_correlation=None):
    """Pearson correlation is within a range."""
    t.value(label(column_a, column_b), t.stat(F.corr(column_a, column_b)), min_correlation, max_correlation)


@check("multi_column", "high")
def ColumnDependency(t, determinant_column, dependent_column, allow_null=True):
    """Each determinant value has one dependent value.

    Pairs are counted first, so a hot determinant shuffles only its distinct
    dependents.
    """
    def build():
        src = t.df.select(F.col(determinant_column).alias("a"), F.col(dependent_column).alias("b"))
        src = src.dropna() if allow_null else src.filter(F.col("a").isNotNull())
        return src.distinct().groupBy("a").agg(F.count(F.lit(1)).alias("n"))

    g = t.frame(f"fd:{determinant_column}>{dependent_column}:{allow_null}", build)
    t.verdict(label(determinant_column, dependent_column), t.stat(F.count_if(F.col("n") > 1), g),
              t.stat(F.count(F.lit(1)), g), frame=g)


@check("multi_column", "high")
def Conditional(t, when_column, when_value, then_column, then_operator, then_value=None):
    """When one column has a value, another one meets an expectation."""
    c = F.col(then_column)
    if then_operator in ("not_null", "null"):
        bad = c.isNull() if then_operator == "not_null" else c.isNotNull()
    elif then_operator == "in_set":
        bad = ~c.isin(list(then_value) if isinstance(then_value, (list, tuple)) else [then_value])
    else:
        bad = ~compare(then_operator, c, F.lit(then_value))
    t.rows(label(when_column, then_column), bad, F.col(when_column) == F.lit(when_value))


@check("multi_column")
def ColumnChainComparison(t, columns, operator, strict=True):
    """Neighbouring columns compare as stated (not strict: equal allowed)."""
    op = operator if strict else {"lt": "lte", "gt": "gte", "<": "<=", ">": ">=", "less": "less_equal",
                                  "greater": "greater_equal"}.get(operator, operator)
    held = reduce(lambda x, y: x & y, [compare(op, F.col(a), F.col(b)) for a, b in zip(columns, columns[1:])])
    t.rows(label(*columns), ~held, all_present(columns))


@check("multi_column")
def ColumnConsistency(t, columns, group_by):
    """Within a group the columns hold one value combination."""
    by = [group_by] if isinstance(group_by, str) else list(group_by)
    g = t.frame(f"consistent:{by}:{columns}", lambda: t.df.select(*by, *columns).distinct()
                .groupBy(*by).agg(F.count(F.lit(1)).alias("n")))
    t.verdict(label(*columns), t.stat(F.count_if(F.col("n") > 1), g), t.stat(F.count(F.lit(1)), g), frame=g)


@check("multi_column", "high")
def MutualExclusivity(t, columns, allow_all_null=True):
    """At most one of the columns is non-null."""
    n = present(columns)
    t.rows(label(*columns), n > 1 if allow_all_null else n != 1)


@check("multi_column")
def ColumnCoexistence(t, columns):
    """The columns are all null or all non-null."""
    t.rows(label(*columns), ~present(columns).isin(0, len(columns)))


@check("multi_column")
def ColumnImplication(t, antecedent_column, antecedent_condition, consequent_column, consequent_condition):
    """Where the first condition holds, so does the second.

    A condition is a predicate over its column: ``> 5``, ``IS NULL``,
    or a whole expression that names the column.
    """
    def whole(column, condition):
        text = condition.strip()
        starts = text[:1] in "<>=!" or text.split(" ")[0].lower() in ("is", "in", "not", "like", "between", "rlike")
        return F.expr(f"`{column}` {text}" if starts else text)
    t.rows(label(antecedent_column, consequent_column), ~whole(consequent_column, consequent_condition),
           whole(antecedent_column, antecedent_condition))


@check("multi_column")
def ColumnMax(t, max_column, source_columns):
    """A column holds the largest of the source columns."""
    t.rows(label(max_column, *source_columns), F.col(max_column) != F.greatest(*source_columns),
           all_present([max_column, *source_columns]))


@check("multi_column")
def ColumnMin(t, min_column, source_columns):
    """A column holds the smallest of the source columns."""
    t.rows(label(min_column, *source_columns), F.col(min_column) != F.least(*source_columns),
           all_present([min_column, *source_columns]))


def row_mean(columns):
    return total_of(columns) / F.lit(float(len(columns)))


@check("multi_column")
def ColumnMean(t, columns, min_value=None, max_value=None):
    """Mean over the columns of a row is within a range."""
    t.rows(label(*columns), off_target(row_mean(columns), None, min_value, max_value), all_present(columns))


@check("multi_column")
def ColumnVariance(t, columns, min_variance=None, max_variance=None):
    """Sample variance over the columns of a row is within a range."""
    mean = row_mean(columns)
    spread = reduce(lambda a, b: a + b, [F.pow(F.col(c) - mean, 2) for c in columns]) / F.lit(float(len(columns) - 1))
    t.rows(label(*columns), off_target(spread, None, min_variance, max_variance), all_present(columns))


@check("multi_column")
def ColumnCovariance(t, column_a, column_b, min_covariance=None, max_covariance=None):
    """Sample covariance is within a range."""
    t.value(label(column_a, column_b), t.stat(F.covar_samp(column_a, column_b)), min_covariance, max_covariance)


@check("multi_column")
def ColumnProduct(t, columns, target_column, tolerance=0.0001):
    """The columns multiply to the target column."""
    product = reduce(lambda a, b: a * b, [F.col(c) for c in columns])
    t.rows(label(*columns, target_column), F.abs(product - F.col(target_column)) > tolerance,
           all_present([*columns, target_column]))


@check("multi_column")
def ColumnDifference(t, column_a, column_b, expected_difference=None, min_difference=None, max_difference=None,
                     tolerance=0.0001):
    """Difference of two columns is as expected."""
    d = F.col(column_a) - F.col(column_b)
    t.rows(label(column_a, column_b), off_target(d, expected_difference, min_difference, max_difference, tolerance),
           d.isNotNull())


@check("multi_column")
def ColumnPercentage(t, numerator_column, denominator_column, expected_percentage=None, min_percentage=None,
                     max_percentage=None, tolerance=0.1):
    """Percentage of two columns is as expected; zero divisors are skipped."""
    pct = F.try_divide(F.col(numerator_column), F.col(denominator_column)) * 100.0
    t.rows(label(numerator_column, denominator_column),
           off_target(pct, expected_percentage, min_percentage, max_percentage, tolerance), pct.isNotNull())
