"""Checks on distinct values. All read value counts, so a hot value is one
row per task in the shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from plumbline.plans.registry import check

N = F.col


def add(t, frame, cond, value):
    """Sum of ``value`` over groups meeting ``cond`` (0 when none)."""
    return t.stat(F.coalesce(F.sum(F.when(cond, value)), F.lit(0)), frame)


def key_filled(columns):
    return reduce(lambda a, b: a & b, [F.col(f"k{i}").isNotNull() for i in range(len(columns))])


def rows_of(t, columns, frame, cond, where=None):
    """The rows whose group meets ``cond``; groups are few beside the rows, so they are joined to them."""
    def rows():
        bad = frame.build().filter(cond).select(*[F.col(f"k{i}").alias(f"__k{i}") for i in range(len(columns))])
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(columns)])
        return (t.df if where is None else t.df.filter(where)).join(bad, same, "left_semi")
    return rows


def repeated(t, columns, label=None, ignore_null=False, where=None, mostly=None):
    g = t.groups(columns, where)
    n = F.col("n")
    keep = key_filled(columns) if ignore_null else F.lit(True)
    bad, total = add(t, g, keep & (n > 1), n), add(t, g, keep, n)
    ok = (bad == 0) if mostly is None else (total - bad) >= F.lit(float(mostly)) * total
    t.verdict(label or ",".join(columns), bad, total, ok, frame=g, rows=rows_of(t, columns, g, keep & (n > 1), where))


def key_errors(t, columns, allow_null=False):
    """Rows in repeated groups plus (unless allowed) rows with a null part."""
    g = t.groups(columns)
    n, whole = F.col("n"), key_filled(columns)
    bad = whole & (n > 1) if allow_null else ~whole | (n > 1)
    t.verdict(",".join(columns), add(t, g, bad, n), add(t, g, F.lit(True), n), frame=g, rows=rows_of(t, columns, g, bad))


def distinct_of(t, column):
    g = t.groups([column])
    return g, t.stat(F.count("k0"), g)


@check("uniqueness", "high")
def Unique(t, column, mostly=None):
    """Values occur once (nulls ignored)."""
    repeated(t, [column], ignore_null=True, mostly=mostly)


@check("uniqueness")
def UniqueRatio(t, column, min_ratio=None, max_ratio=None):
    """Distinct share of the non-null values is within bounds."""
    g, distinct = distinct_of(t, column)
    rows = add(t, g, F.col("k0").isNotNull(), F.col("n"))
    t.value(column, F.when(rows > 0, distinct / rows), min_ratio, max_ratio, frame=g)


@check("uniqueness")
def DistinctCount(t, column, min_count=None, max_count=None):
    """Number of distinct non-null values is within bounds."""
    g, distinct = distinct_of(t, column)
    t.value(column, distinct, min_count, max_count, frame=g)


@check("uniqueness", "high")
def Duplicate(t, columns=None):
    """Rows whose (whole) key occurs more than once; nulls compare equal."""
    repeated(t, t.columns_or(columns))


@check("uniqueness", "high")
def DuplicateWithinGroup(t, column, group_by):
    """Values repeated inside a group."""
    by = [group_by] if isinstance(group_by, str) else list(group_by)
    repeated(t, [*by, column], column)


@check("uniqueness", "critical")
def PrimaryKey(t, column):
    """Unique and non-null."""
    key_errors(t, [column])


@check("uniqueness", "critical")
def CompoundKey(t, columns):
    """Column combination is unique with no null part."""
    key_errors(t, list(columns))


def member(values):
    return F.col("k0").isin(list(values))


@check("uniqueness")
def DistinctValuesInSet(t, column, value_set):
    """Every distinct value belongs to the set."""
    g, distinct = distinct_of(t, column)
    t.verdict(column, t.stat(F.count_if(~member(value_set)), g), distinct, frame=g)


@check("uniqueness")
def DistinctValuesEqualSet(t, column, value_set):
    """Distinct values are exactly the set."""
    g, distinct = distinct_of(t, column)
    known = t.stat(F.count_if(member(value_set)), g)
    extra = distinct - known
    missing = F.lit(len(set(value_set))) - known
    t.verdict(column, extra + missing, distinct + missing, frame=g)


@check("uniqueness")
def DistinctValuesContainSet(t, column, required_values):
    """Distinct values contain the set."""
    g, _ = distinct_of(t, column)
    size = len(set(required_values))
    t.verdict(column, F.lit(size) - t.stat(F.count_if(member(required_values)), g), F.lit(size), frame=g)


@check("uniqueness")
def DistinctCountBetween(t, column, min_count, max_count):
    """Number of distinct non-null values is within bounds."""
    DistinctCount(t, column, min_count, max_count)


def clash(columns):
    """A value occurs twice among the non-null columns of the row."""
    values = F.array(*[F.col(c).cast("string") for c in columns])
    filled = F.array_compact(values)
    return F.size(F.array_distinct(filled)) < F.size(filled)


@check("uniqueness")
def UniqueWithinRecord(t, columns):
    """The listed columns of a row hold different values."""
    t.rows(",".join(columns), clash(columns))


@check("uniqueness", "low")
def AllColumnsUniqueWithinRecord(t, columns=None):
    """All columns of a row hold different values."""
    cols = t.columns_or(columns)
    t.rows(",".join(cols), clash(cols))


@check("uniqueness", "high")
def NaturalKey(t, columns, allow_null=False):
    """Business key is unique and (unless allowed) complete."""
    key_errors(t, list(columns), allow_null)


@check("uniqueness", "critical")
def SurrogateKey(t, column, check_sequential=False, start_value=1):
    """Unique, non-null and optionally gap-free from a start value."""
    g = t.groups([column])
    k, n = F.col("k0"), F.col("n")
    bad = add(t, g, k.isNull() | (n > 1), n)
    ok = bad == 0
    if check_sequential:
        lo, hi = t.stat(F.min(k), g), t.stat(F.max(k), g)
        ok = ok & (lo == start_value) & (hi - lo + 1 == t.stat(F.count(k), g))
    t.verdict(column, bad, add(t, g, F.lit(True), n), F.coalesce(ok, F.lit(True)), frame=g)
