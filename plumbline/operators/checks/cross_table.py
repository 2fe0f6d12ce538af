"""Checks of a table against another table."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.numeric import compare
from plumbline.operators.drift import two_sided
from plumbline.plans.primitives import exact_quantiles, paired_counts
from plumbline.plans.registry import check


@check("cross_table", "critical")
def ForeignKey(t, column, reference_source_id, reference_column, allow_null=True):
    """Every value exists in the reference column."""
    t.missing_parent(column, [column], t.ref(reference_source_id), [reference_column], not allow_null)


@check("cross_table", "critical")
def CompositeForeignKey(t, columns, reference_source_id, reference_columns, allow_null=True):
    """Every key combination exists in the reference table."""
    t.missing_parent(",".join(columns), columns, t.ref(reference_source_id), reference_columns, not allow_null)


@check("cross_table", "high")
def Orphan(t, column, reference_source_id, reference_column, ignore_null=True):
    """Records with no parent record."""
    t.missing_parent(column, [column], t.ref(reference_source_id), [reference_column], not ignore_null)


def two_row_counts(t, reference_source_id):
    """One row (a, b): rows of this table and of the reference."""
    ref = t.ref(reference_source_id)
    return t.frame(f"rows2:{reference_source_id}", lambda: t.df.select(F.lit(0).alias("side")).unionByName(
        ref.select(F.lit(1).alias("side"))).groupBy("side").agg(F.count(F.lit(1)).alias("n")))


def judged_pair(op, a, b, tolerance):
    if op in ("eq", "=="):
        return F.abs(a - b) <= tolerance
    return compare(op, a, b)


@check("cross_table")
def CrossTableRowCount(t, reference_source_id, operator="eq", tolerance=0):
    """Row counts compare as stated."""
    g = two_row_counts(t, reference_source_id)
    a, b = (t.stat(F.coalesce(F.sum(F.when(F.col("side") == s, F.col("n"))), F.lit(0)), g) for s in (0, 1))
    t.value(None, a - b, ok=judged_pair(operator, a, b, tolerance), frame=g)


AGGREGATES = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "count": F.count, "std": F.stddev_samp}


@check("cross_table")
def CrossTableAggregate(t, column, reference_source_id, aggregate, reference_column=None, operator="eq", tolerance=0.01):
    """An aggregate of corresponding columns compares as stated."""
    ref, other = t.ref(reference_source_id), reference_column or column
    if aggregate == "median":
        a = exact_quantiles(t.df, [(F.col(column), 0.5)])[0]
        b = exact_quantiles(ref, [(F.col(other), 0.5)])[0]
        a, b = F.lit(a).cast("double"), F.lit(b).cast("double")
        return t.value(column, a - b, ok=judged_pair(operator, a, b, tolerance))
    f = AGGREGATES[aggregate]
    g = t.frame(f"sides:{column}:{reference_source_id}:{reference_column}", lambda: two_sided(ref, t.df, F.col(other), F.col(column)))
    # Side 0 is the reference, side 1 this table.
    b, a = (t.stat(f(F.when(F.col("side") == s, F.col("x"))), g) for s in (0, 1))
    t.value(column, a - b, ok=judged_pair(operator, a, b, tolerance), frame=g)


@check("cross_table")
def CrossTableDistinct(t, column, reference_source_id, reference_column=None, operator="eq"):
    """Distinct value sets are equal, nested, overlapping or disjoint."""
    ref, other = t.ref(reference_source_id), reference_column or column
    g = t.frame(f"sets:{column}:{reference_source_id}:{other}",
                lambda: paired_counts(t.df, ref, F.col(column), F.col(other)))
    only_a, only_b = t.stat(F.count_if(F.col("nb") == 0), g), t.stat(F.count_if(F.col("na") == 0), g)
    n = t.stat(F.count(F.lit(1)), g)
    shared = n - only_a - only_b
    bad = {"eq": only_a + only_b, "subset": only_a, "superset": only_b, "disjoint": shared,
           "intersect": F.when(shared > 0, 0).otherwise(1)}[operator]
    t.verdict(column, bad, n, frame=g, observed=shared)


@check("cross_table", "high")
def CrossTableSchema(t, reference_source_id, check_columns=True, check_types=True, check_order=False, strict=False):
    """Two tables have compatible schemas (strict: no extra columns here)."""
    ref = t.ref(reference_source_id)
    mine = {f.name: f.dataType for f in t.df.schema.fields}
    theirs = {f.name: f.dataType for f in ref.schema.fields}
    bad = 0
    if check_columns:
        bad += sum(c not in mine for c in theirs) + (sum(c not in theirs for c in mine) if strict else 0)
    if check_types:
        bad += sum(c in mine and mine[c] != k for c, k in theirs.items())
    if check_order:
        bad += int([c for c in mine if c in theirs] != [c for c in theirs if c in mine])
    t.facts(None, bad, len(theirs))


@check("cross_table", "high")
def JoinIntegrity(t, column, reference_source_id, reference_column, expected_cardinality):
    """Matched keys repeat on no side that should be 'one'."""
    ref = t.ref(reference_source_id)
    g = t.frame(f"join:{column}:{reference_source_id}:{reference_column}",
                lambda: paired_counts(t.df, ref, F.col(column), F.col(reference_column)).filter("na > 0 and nb > 0"))
    left, right = expected_cardinality.split("_to_")
    bad = F.lit(False)
    if left == "one":
        bad = bad | (F.col("na") > 1)
    if right == "one":
        bad = bad | (F.col("nb") > 1)
    t.verdict(column, t.stat(F.count_if(bad), g), t.stat(F.count(F.lit(1)), g), frame=g)
