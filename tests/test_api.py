"""The verbs end to end on a small table."""

import pytest
from pyspark.sql import functions as F

from plumbline import api


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([(i, f"user{i}@mail.org", 20.0 + i % 30, "a" if i % 3 else "b") for i in range(90)], "id long, email string, age double, kind string")


def test_check_formats_and_summary(df):
    configs = [api.CheckConfig("NotNull", {"column": "id"}), api.CheckConfig("Between", {"column": "age", "min_value": 0, "max_value": 30})]
    assert api.check(df, configs, result_format="boolean_only").columns == ["check", "column", "status"]
    result = api.check(df, configs, schema={"id": "Int64", "email": "Int32"})
    row = api.summary(result).first()
    assert (row.passed, row.checks, row.failed, row.critical) == (False, 3, 2, 1)


def test_learned_rules_hold_on_their_own_table(df):
    assert api.summary(api.check(df, auto_schema=True)).first().passed


def test_profile_learn_compare_scan_mask(df):
    p = {r["column"]: r for r in api.profile(df).collect()}
    assert p["email"].inferred_type == "email" and p["id"].is_unique and p["age"].median == 34.5 and p["kind"].top_values[0].value == "a"
    assert p["age"].histogram[0]["count"] == 9 and p["kind"].distinct_count == 2
    assert {r["column"]: r.allowed_values for r in api.learn(df).collect()}["kind"] == ["a", "b"]
    moved = df.withColumn("age", F.col("age") + 15)
    assert {r["column"]: r.drifted for r in api.compare(df, moved, ["age", "kind"]).collect()} == {"age": True, "kind": False}
    for m in ("ks", "cvm", "anderson", "psi", "js", "kl", "hellinger", "bhattacharyya", "tv", "wasserstein", "energy", "mmd"):
        same, far = api.compare(df, df, ["age"], m).first(), api.compare(df, moved, ["age"], m).first()
        assert not same.drifted and far.drifted, m
    assert [r.pii_type for r in api.scan(df).collect()] == ["email"]
    assert api.scan(df, regulations=["gdpr", "lgpd"]).count() == 2
    assert api.mask(df).first().email.strip("*") == "" and api.mask(df).first().kind in ("a", "b")
    fake = api.mask(df.withColumn("email", F.col("kind")), ["email"], "fake")
    assert fake.select("email").distinct().count() == 2


def test_custom_checks_can_be_registered(df):
    @api.register_check("custom", "low")
    def EvenIds(t, column):
        """Identifiers are even."""
        t.rows(column, F.col(column) % 2 != 0)
    assert api.check(df, [api.CheckConfig("EvenIds", {"column": "id"})]).first().unexpected_count == 45
    from plumbline.plans.registry import CATALOG
    CATALOG.pop("custom.EvenIds")


def test_rejected_rows_come_with_the_result(spark):
    import json
    df = spark.createDataFrame([(i, i % 10, "x" if i % 4 else None) for i in range(200)], "id long, v long, s string").repartition(7)
    checks = [api.CheckConfig("Between", {"column": "v", "min_value": 0, "max_value": 6}), api.CheckConfig("Null", {"columns": ["s"]}), api.CheckConfig("Unique", {"column": "v"}),
              api.CheckConfig("RowCount", {"expected": 3}), api.CheckConfig("Positive", {"column": "nope"}), api.CheckConfig("Between", {"column": "id", "min_value": 0, "max_value": 10 ** 6})]
    rows = {(r.check, r.column): r for r in api.check(df, checks, include_unexpected_rows=True, max_unexpected_rows=25).collect()}
    assert len(rows) == 6
    told = [json.loads(x) for x in rows[("Between", "v")].unexpected_rows]
    every = sorted(json.dumps({"id": i, "v": i % 10, **({"s": "x"} if i % 4 else {})}, separators=(",", ":")) for i in range(200) if i % 10 > 6)
    assert len(told) == 25 and all(x["v"] > 6 for x in told) and rows[("Between", "v")].unexpected_rows == every[:25]
    assert len(rows[("Null", "s")].unexpected_rows) == 25 and len(rows[("Unique", "v")].unexpected_rows) == 25
    assert rows[("Between", "id")].unexpected_rows == [] and next(r for (c, _), r in rows.items() if c == "RowCount").unexpected_rows is None
    assert next(r for (c, _), r in rows.items() if c == "Positive").unexpected_rows is None
    assert "unexpected_rows" not in api.check(df, checks).columns
