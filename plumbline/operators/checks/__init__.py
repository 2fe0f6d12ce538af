"""The check catalog by category; importing this package registers all."""

from plumbline.operators.checks import (  # noqa: F401
    aggregate,
    anomaly,
    business_rule,
    completeness,
    cross_table,
    datetime,
    distribution,
    drift,
    geospatial,
    localization,
    ml_feature,
    multi_column,
    privacy,
    profiling,
    query,
    referential,
    schema,
    string,
    table,
    timeseries,
    uniqueness,
)
