"""Evidence of cross-column rules: key shares, few values, dependencies."""

from plumbline.operators import rules


def test_composite_keys_need_their_share_of_different_values(spark):
    df = spark.range(3000).selectExpr("id as whole_id", "id * 6 div 10 as half_id", "id div 3 as third_code", "id div 100 as rare_key", "id % 2 as two", "id % 7 as seven", "id % 3 = 0 as flag", "array(id) as list_id")
    pairs = {(a, b): p for a, b, _, p in rules.composite_keys(df)}
    assert ("half_id", "seven") in pairs and pairs[("half_id", "seven")] == "id_categorical_combination"
    assert ("half_id", "two") not in pairs and not any("whole_id" in p for p in pairs)


def test_dependencies_are_decided_exactly(spark):
    df = spark.range(4000).selectExpr("id % 400 as city", "id % 400 % 20 as state", "if(id = 17, 3, id % 400 % 20) as nearly", "id as unique_id", "id % 3 as other")
    got = {(r.determinant, r.dependent): r for r in rules.dependencies(df).collect()}
    assert got[("city", "state")].holds and not got[("city", "nearly")].holds and ("unique_id", "city") not in got and ("city", "other") not in got
    assert (got[("city", "state")].distinct_determinant, got[("city", "nearly")].distinct_pair) == (400, 401)
    assert rules.dependencies(df.limit(0)).collect() == [] and rules.composite_keys(df.limit(0)) == []
