"""The catalog is complete, and every check has a query."""

import inspect

import pytest

from plumbline import catalog
from plumbline.plans.registry import CATALOG, CheckConfig, by_category, find, search

SIZES = {"schema": 14, "completeness": 12, "uniqueness": 15, "distribution": 15, "string": 17, "datetime": 10, "aggregate": 8, "anomaly": 16,
         "drift": 13, "cross_table": 8, "multi_column": 20, "query": 16, "table": 17, "geospatial": 13, "privacy": 14, "business_rule": 8,
         "profiling": 8, "localization": 10, "ml_feature": 8, "timeseries": 11, "referential": 9}


def test_sizes():
    assert {c: len(by_category(c)) for c in SIZES} == SIZES and len(CATALOG) == sum(SIZES.values()) == 262


def test_every_check_has_a_query():
    names = set(catalog.queries())
    for spec in CATALOG.values():
        assert f"check_{spec.name}" in names or f"check_{spec.category}_{spec.name}" in names, spec.key
    for shared in ("ForeignKey", "CompositeForeignKey", "MostCommonValue"):
        assert sum(s.name == shared for s in CATALOG.values()) == 2


def test_oracles_belong_to_queries():
    assert set(catalog.oracles()) <= set(catalog.queries())
    assert len(catalog.oracles()) > 0.9 * len(catalog.queries())


def test_lookup():
    assert find("between").category == "distribution"
    assert find("referential.foreignkey").category == "referential"
    assert {s.name for s in search("luhn")} >= {"Luhn", "CreditCard", "CreditCardDetection"}
    with pytest.raises(KeyError):
        find("Nothing")


def test_configs_are_checked():
    assert CheckConfig("Between", {"column": "a", "min_value": 1, "max_value": 2, "mostly": None}).normalised() == {"column": "a", "min_value": 1, "max_value": 2}
    assert CheckConfig("Null", {"columns": ["a"]}).normalised() == {"columns": ("a",)}
    with pytest.raises(ValueError):
        CheckConfig("Between", {"column": "a"}).normalised()
    with pytest.raises(ValueError):
        CheckConfig("NotNull", {"column": "a", "speed": 3}).normalised()
    for spec in CATALOG.values():
        assert spec.description and set(spec.required).isdisjoint(spec.defaults) and callable(spec.fn)
        assert list(inspect.signature(spec.fn).parameters)[0] == "t"
