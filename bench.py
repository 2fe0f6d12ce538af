"""Headline queries, timed. Prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import time

from plumbline import catalog
from plumbline.catalog.base import table
from plumbline.plans.planner import run
from plumbline.plans.registry import CheckConfig as C
from plumbline.session import build_session

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

ROW_CHECKS = [C("Between", {"column": c, "min_value": 0, "max_value": 10 ** 6}) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")] + [
    C("Null", {"columns": ["l_quantity", "l_extendedprice", "l_shipdate", "l_returnflag"]}),
    C("InSet", {"column": "l_returnflag", "value_set": ["A", "N", "R"]}), C("Positive", {"column": "l_extendedprice"}),
    C("MeanBetween", {"column": "l_discount", "max_value": 1}), C("StdBetween", {"column": "l_tax", "max_value": 1}),
    C("ColumnComparison", {"column_a": "l_extendedprice", "column_b": "l_quantity", "operator": "gte"}),
    C("DateBetween", {"column": "l_shipdate", "min_date": "1990-01-01", "max_date": "2010-01-01"}),
    C("Expression", {"expression": "l_extendedprice * (1 - l_discount) >= 0"}), C("TableNotEmpty"), C("RowLevel", {"expression": "l_quantity > 0"}),
]


def fused(spark, sf):
    return run(table(spark, sf, "lineitem"), ROW_CHECKS)


def unfused(spark, sf):
    out = None
    for check in ROW_CHECKS:
        part = run(table(spark, sf, "lineitem"), [check])
        out = part if out is None else out.unionByName(part)
    return out


QUERIES = {"run_fused_20_checks": fused, "run_unfused_20_checks": unfused, "run_flagship": catalog.flagship}
HEADLINE = """check_CompoundKey check_ForeignKey check_Outlier check_MADAnomaly check_Increasing check_Distribution_normal check_GeoSpeed
check_Seasonality check_PIIDetection check_JoinIntegrity check_AnonymizationCheck check_FeatureCorrelationMatrix check_HierarchyDepth
profile_numeric profile_cardinality profile_top_values profile_histogram profile_full rules_cross_column drift_ks drift_psi drift_wasserstein drift_mmd
stats_mann_whitney pii_scan_documents mask_hash sample_random sample_block sample_stratified sketch_count_min sketch_bloom anomaly_zscore
anomaly_isolation_forest anomaly_kmeans lineage_impact runs_trend_daily incident_correlations retention_size dedup_adaptive
throttle_token_bucket stream_rolling_zscore stream_ema anomaly_lof anomaly_dbscan sample_reservoir_weighted rules_dependencies""".split()


def main() -> None:
    spark = build_session("bench", f"local[{CPUS}]", **{
        "spark.sql.shuffle.partitions": CPUS, "spark.ui.enabled": "false", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("OFF")
    catalog.queries()["check_Null"](spark, SF).collect()  # start-up is not measured
    times = {}
    for name in [*QUERIES, *HEADLINE]:
        fn = QUERIES.get(name) or catalog.queries()[name]
        start = time.perf_counter()
        fn(spark, SF).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_wall_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(SF.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
