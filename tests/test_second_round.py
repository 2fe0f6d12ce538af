"""Faults that the given tables do not show."""

import math

import pytest
from pyspark.sql import functions as F

from plumbline.operators import anomaly as A
from plumbline.operators import hierarchy, schema_evolution
from plumbline.operators.drift import harmonic, harmonic_squares
from plumbline.operators.neighbours import cut_into_cells
from plumbline.plans import primitives as P
from plumbline.plans.planner import run
from plumbline.plans.registry import CheckConfig as C


def test_forest_on_few_distinct_values(spark):
    df = spark.range(200_000).select("id", F.when(F.col("id") == 77, 1000.0).otherwise(F.col("id") % 5).alias("v"))
    scored = A.forest_scores(A.Prepared(df, "id", ["v"]), 50, 128)
    top = scored.orderBy(F.desc("score")).first()
    assert top.id == 77 and scored.filter(F.col("score") >= top.score).count() == 1
    for v in ("v", "w"):  # few different rows, and many with a third of equal ones
        wide = df.withColumn("w", F.when(F.col("id") % 3 == 0, 1.0).otherwise(F.rand(1)))
        rows = A.forest_rows(A.Prepared(wide, "id", [v]), 50, 128, 42).groupBy("tree").count().collect()
        assert len(rows) == 50 and all(100 < r["count"] < 240 for r in rows)


def test_forest_without_rows(spark):
    with pytest.raises(ValueError, match="no row"):
        A.forest_scores(A.Prepared(spark.range(0).select("id", F.col("id").alias("v")), "id", ["v"]))


def test_nan_is_a_missing_number(spark):
    df = spark.range(1_000).select("id", F.when(F.col("id") == 5, float("nan")).when(F.col("id") == 6, float("inf")).when(F.col("id") == 7, 900.0).otherwise(F.col("id") % 10).cast("double").alias("v"))
    p = A.Prepared(df, "id", ["v"])
    for found in (A.statistical(p), A.statistical(p, "iqr"), A.statistical(p, "mad", 50.0)):
        assert {r.id for r in found.filter("is_anomaly").collect()} == {7}
    assert 7 in {r.id for r in A.mahalanobis(p, 97.5, False).filter("is_anomaly").collect()}
    rows = {r.check: r for r in run(df, [C("ZScoreAnomaly", {"column": "v"}), C("ZScoreOutlier", {"column": "v"}), C("MADAnomaly", {"column": "v", "threshold": 50.0})]).collect()}
    assert {k: r.unexpected_count for k, r in rows.items()} == {"ZScoreAnomaly": 1, "ZScoreOutlier": 1, "MADAnomaly": 1}


@pytest.mark.parametrize("limit", [3, 50, 100_000])
def test_quantiles_are_the_same_on_both_sides_of_the_buffer(spark, limit):
    values = [float(i * i % 97) for i in range(900)] + [1e300, -1e300, 0.0] * 40
    df = spark.createDataFrame([(v,) for v in [*values, float("nan"), float("inf"), None]], "v double")
    qs = (0.0, 0.01, 0.25, 0.5, 0.77, 0.999, 1.0)
    got = P.exact_quantiles(df, [(F.col("v"), q) for q in qs], limit)
    ordered = sorted(values)
    want = [ordered[int(q * (len(values) - 1))] + (ordered[min(int(q * (len(values) - 1)) + 1, len(values) - 1)] - ordered[int(q * (len(values) - 1))]) * math.modf(q * (len(values) - 1))[0] for q in qs]
    assert got == pytest.approx(want)
    assert P.exact_quantiles(df.filter("v is null"), [(F.col("v"), 0.5)], limit) == [None]


def test_a_failing_check_is_one_error_row(spark):
    df = spark.createDataFrame([(1, "a"), (0, "b")], "w int, s string")
    rows = {r.check: r for r in run(df, [C("Null", {"columns": ["s"]}), C("CustomExpression", {"expression_str": "1 / w >= 0"}), C("Between", {"column": "w", "min_value": 0, "max_value": 5})]).collect()}
    assert {k: r.status for k, r in rows.items()} == {"Null": "pass", "CustomExpression": "error", "Between": "pass"}
    assert "DIVIDE_BY_ZERO" in rows["CustomExpression"].message


def test_all_parents_count(spark):
    edges = [(1, 2), (1, 3), (3, 1), (2, None), (4, 1), (5, 5), (6, 2), (6, 7), (7, 6)]
    for rows in (edges, edges[::-1]):
        df = spark.createDataFrame(rows, "id long, up long")
        assert {r.id for r in hierarchy.on_cycle(df, F.col("id"), F.col("up")).collect()} == {1, 3, 5, 6, 7}
    tree = spark.createDataFrame([(1, None), (2, 1), (3, 2), (3, 1), (4, 3)], "id long, up long")
    assert {r.id: (r.depth, r.root_reached) for r in hierarchy.climb(tree, F.col("id"), F.col("up"), 2).collect()} == {1: (0, True), 2: (1, True), 3: (2, True), 4: (3, False)}


def test_versions_with_gaps(spark):
    kind = "version int, column string, dtype string, nullable boolean, uniq boolean"
    versions = spark.createDataFrame([(1, "a", "int", False, False), (3, "a", "string", False, False)], kind)
    changes = schema_evolution.version_changes(versions).collect()
    assert [(r.version, r.change_type) for r in changes] == [(3, "type_changed")]


def test_harmonic_numbers_at_any_size():
    for n in (1, 2, 7, 50, 4_000, 5_000):
        assert harmonic(n) == pytest.approx(sum(1 / k for k in range(1, n + 1)), abs=1e-10)
        assert harmonic_squares(n) == pytest.approx(sum(1 / k ** 2 for k in range(1, n + 1)), abs=1e-10)


def test_no_cell_of_single_points(spark):
    points = spark.range(20_000).select("id", F.array(F.rand(3), F.rand(4)).alias("x"), F.lit(1).cast("long").alias("w"))
    sizes = [r["count"] for r in cut_into_cells(points, 2, 1_000).groupBy("cell").count().collect()]
    assert min(sizes) > 20 and max(sizes) <= 1_000
    line = spark.range(6_000).select("id", F.array(F.when(F.col("id") < 5_000, 0.5).otherwise(F.rand(5)), F.rand(6) / 10).alias("x"), F.lit(1).cast("long").alias("w"))
    assert max(r["count"] for r in cut_into_cells(line, 2, 500).groupBy("cell").count().collect()) <= 500


def test_zones_and_countries(spark):
    df = spark.createDataFrame([(48.2, 16.4, "Europe/Vienna"), (48.2, 100.0, "Europe/Vienna")], "lat double, lon double, tz string")
    both = {"lat_column": "lat", "lon_column": "lon"}
    rows = {r.check: r for r in run(df, [C("GeoTimezone", {**both, "timezone_column": "tz"}), C("GeoCountry", {**both, "country_code": "AT", "box": [46.3, 49.1, 9.5, 17.2]})]).collect()}
    assert rows["GeoTimezone"].unexpected_count == 1 and rows["GeoCountry"].unexpected_count == 1
    assert run(df, [C("GeoCountry", {**both, "country_code": "AT"})]).first().status == "error"
