"""Range checks on one statistic of a column."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.plans.planner import Quantile
from plumbline.plans.registry import check


def in_range(stat, doc):
    def run(t, column, min_value=None, max_value=None):
        t.value(column, t.stat(stat(F.col(column))), min_value, max_value)
    run.__doc__ = doc
    return run


for _name, _stat in {
    "MeanBetween": F.avg, "StdBetween": F.stddev_samp, "VarianceBetween": F.var_samp,
    "SumBetween": F.sum, "MinBetween": F.min, "MaxBetween": F.max,
}.items():
    check("aggregate", name=_name)(in_range(_stat, f"Column {_name[:-7].lower()} is within a range."))


@check("aggregate")
def MedianBetween(t, column, min_value=None, max_value=None):
    """Column median is within a range."""
    (median,) = yield [Quantile(F.col(column), 0.5)]
    t.value(column, F.lit(median).cast("double"), min_value, max_value)


@check("aggregate")
def CountBetween(t, min_count=None, max_count=None):
    """Row count is within a range."""
    t.value(None, t.stat(F.count(F.lit(1))), min_count, max_count)
