"""Referential checks, including hierarchies in one table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from plumbline.operators.hierarchy import climb, on_cycle
from plumbline.plans.registry import check


@check("referential", "high")
def ForeignKey(t, column, reference_source, reference_column):
    """Every non-null value exists in the reference column."""
    t.missing_parent(column, [column], t.ref(reference_source), [reference_column])


@check("referential", "high")
def CompositeForeignKey(t, columns, reference_source, reference_columns):
    """Every complete key combination exists in the reference table."""
    t.missing_parent(",".join(columns), columns, t.ref(reference_source), reference_columns)


@check("referential", "high")
def SelfReferentialFK(t, column, reference_column, allow_null=True):
    """Every value exists in another column of the same table."""
    t.missing_parent(column, [column], t.df, [reference_column], not allow_null)


@check("referential", "high")
def OrphanRecord(t, column, reference_source, reference_column):
    """Records that point to no parent record."""
    t.missing_parent(column, [column], t.ref(reference_source), [reference_column])


@check("referential", "high")
def DanglingReference(t, column, reference_source, reference_column, deleted_when=None):
    """References to absent parents, or to ones marked as deleted."""
    parent = t.ref(reference_source)
    if deleted_when:
        parent = parent.filter(~F.coalesce(F.expr(deleted_when), F.lit(False)))
    t.missing_parent(column, [column], parent, [reference_column])


@check("referential", "critical")
def CircularReference(t, id_column, parent_column, max_depth=100):
    """Nodes whose parent chain returns to themselves."""
    g = t.frame(f"cycle:{id_column}:{parent_column}:{max_depth}",
                lambda: on_cycle(t.df, F.col(id_column), F.col(parent_column), max_depth))
    (n,) = yield [F.count(F.lit(1))]
    t.verdict(f"{id_column},{parent_column}", t.stat(F.count(F.lit(1)), g), F.lit(n), frame=g)


@check("referential")
def HierarchyDepth(t, id_column, parent_column, max_depth):
    """No node is more than ``max_depth`` steps below its root."""
    g = t.frame(f"depth:{id_column}:{parent_column}:{max_depth}",
                lambda: climb(t.df, F.col(id_column), F.col(parent_column), int(max_depth)))
    deep = (F.col("depth") > int(max_depth)) | ~F.col("root_reached")
    t.verdict(f"{id_column},{parent_column}", t.stat(F.count_if(deep), g), t.stat(F.count(F.lit(1)), g),
              frame=g)


@check("referential", "high")
def CascadeIntegrity(t, column, reference_source, reference_column, action="cascade"):
    """State of children after parents were deleted.

    cascade, restrict, no_action: no child may point to an absent parent.
    set_null: children of absent parents must be null, which is the same
    test on the non-null values.
    """
    if action not in ("cascade", "set_null", "restrict", "no_action"):
        raise ValueError(f"unknown action {action!r}")
    t.missing_parent(column, [column], t.ref(reference_source), [reference_column], action == "cascade")


@check("referential", "high")
def MultiTableOrphan(t, column, reference_sources, reference_columns):
    """Values that have no parent in any of several tables."""
    parents = [t.ref(s).select(F.col(c).alias("p")) for s, c in zip(reference_sources, reference_columns)]
    t.missing_parent(column, [column], reduce(lambda a, b: a.unionByName(b), parents), ["p"])
