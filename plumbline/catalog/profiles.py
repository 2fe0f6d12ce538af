"""Queries of profiles, learning, rules, comparison, drift and statistics."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import functions as F

from plumbline.catalog.base import duck, register, shown, source, table
from plumbline.catalog.checks_rows import NULLS, SUMS, sql_erfc, sql_normal
from plumbline.catalog.checks_values import A, E1, E2, JS, PSI, R, bin_shares, cdfs, ks_p, value_shares
from plumbline.functions import patterns as P
from plumbline.operators import drift, profile, rules, stats
from plumbline.plans.planner import run
from plumbline.plans.registry import CheckConfig

NUM = ["l_quantity", "l_extendedprice", "l_discount"]


def cross_oracle(rows: str) -> str:
    """The rules whose names fit, and how many rows contradict them."""
    rules_of = (("ColumnComparison", '{"column_a": "ship_date", "column_b": "order_date", "operator": "gte"}', "comparison", 0.8, "ship_date < order_date"),
                ("ColumnSum", '{"columns": ["subtotal", "tax"], "target_column": "total", "tolerance": 0.01}', "sum", 0.75, "abs(subtotal + tax - total) > 0.01"),
                ("ColumnProduct", '{"columns": ["quantity", "unit_price"], "target_column": "total", "tolerance": 0.01}', "product", 0.75, "abs(quantity * unit_price - total) > 0.01"),
                ("ColumnRatio", '{"denominator_column": "subtotal", "max_ratio": 1.0, "min_ratio": 0.0, "numerator_column": "tax"}', "ratio", 0.7, "tax / subtotal not between 0 and 1"),
                ("ColumnPercentage", '{"denominator_column": "subtotal", "max_percentage": 100.0, "min_percentage": 0.0, "numerator_column": "tax"}', "percentage", 0.7, "tax / subtotal * 100 not between 0 and 100"))
    related = (('{"column_a": "quantity", "column_b": "total", "max_correlation": 1.0, "min_correlation": 0.5}', "corr(quantity, total) between 0.5 and 1"),
               ('{"column_a": "quantity", "column_b": "unit_price", "max_correlation": 1.0, "min_correlation": 0.1}', "corr(quantity, unit_price) between 0.1 and 1"))
    parts = [f"select '{c}' as \"check\", '{e}' as expected, '{p}' as pattern, {w}::double as confidence, count(*) filter (where {bad}) = 0 as holds, count(*) filter (where {bad}) as unexpected_count, count(*) as total_count from r"
             for c, e, p, w, bad in rules_of]
    parts += [f"select 'ColumnCorrelation', '{e}', 'correlation', 0.65::double, {ok}, (not ({ok}))::int::bigint, 1::bigint from r" for e, ok in related]
    return f"with r as ({rows}) " + " union all ".join(parts)


def composite_oracle(rows: str) -> str:
    """Pairs of the two key-like columns, and of each with the two columns of few values; rows that are not alone with their pair."""
    pairs = (("batch_id", "ref_no", "id_column_combination", 0.75), *((a, b, "id_categorical_combination", 0.65) for a in ("batch_id", "ref_no") for b in ("o_orderstatus", "o_orderpriority")))
    parts = [f"select 'MultiColumnUnique' as \"check\", '{{\"columns\": [\"{a}\", \"{b}\"]}}' as expected, '{p}' as pattern, {w}::double as confidence, max(k) = 1 as holds, "
             f"coalesce(sum(k) filter (where k > 1), 0)::bigint as unexpected_count, sum(k)::bigint as total_count from (select count(*) as k from r group by {a}, {b}) g" for a, b, p, w in pairs]
    return f"with r as ({rows}) " + " union all ".join(parts)


def per_column(cols: list[str], template: str, frm: str) -> str:
    """The template once per column ({c}), unioned."""
    return " union all ".join(f"select '{c}' as \"column\", {template.replace('{c}', c)} from {frm}" for c in cols)


def profiles() -> None:
    fields = ["column", "row_count", "null_count", "null_ratio", "min_value", "max_value", "mean", "std"]
    register("profile_numeric", lambda s, d: profile.scalars(table(s, d, "lineitem"), NUM).select(*fields, "skewness", "kurtosis"),
             per_column(NUM, "count(*) as row_count, count(*) - count({c}) as null_count, round((count(*) - count({c})) * 1.0 / count(*), 6) as null_ratio, "
                        "min({c}) as min_value, max({c}) as max_value, round(avg({c}), 6) as mean, round(stddev_samp({c}), 6) as std, "
                        "round((select avg(power({c} - m, 3)) / power(avg(power({c} - m, 2)), 1.5) from lineitem, (select avg({c}) m from lineitem)), 6) as skewness, "
                        "round(kurtosis_pop({c}), 6) as kurtosis", "lineitem"))
    texts = ["seg", "nm"]
    register("profile_text", lambda s, d: profile.scalars(source(s, d, NULLS), texts).select(
        "column", "null_count", "empty_string_count", "min_length", "max_length", "avg_length"),
        per_column(texts, "count(*) - count({c}) as null_count, count(*) filter (where {c} = '') as empty_string_count, min(length({c})) as min_length, "
                   "max(length({c})) as max_length, round(avg(length({c})), 6) as avg_length", f"({duck(NULLS)}) t"))
    register("profile_dates", lambda s, d: profile.scalars(table(s, d, "orders"), ["o_orderdate"]).select(
        "column", F.col("min_date").cast("timestamp").alias("first_seen"), F.col("max_date").cast("timestamp").alias("last_seen")).join(
            profile.date_gaps(table(s, d, "orders"), ["o_orderdate"]), "column"),
        "select 'o_orderdate' as \"column\", min(o_orderdate) as first_seen, max(o_orderdate) as last_seen, "
        "cast(date_diff('day', min(o_orderdate), max(o_orderdate)) + 1 - count(distinct o_orderdate::date) as bigint) as date_gaps from orders")
    shares = " union all ".join(f"select 'url' as \"column\", '{k}' as pattern, round(count(*) filter (where regexp_matches(url, '{v}')) * 1.0 / count(url), 6) as match_ratio from pages"
                                for k, v in profile.PATTERNS.items())
    register("profile_patterns", lambda s, d: profile.scalars(table(s, d, "pages"), ["url"]).select(
        "column", F.explode("patterns").alias("p")).select("column", "p.pattern", "p.match_ratio"),
        f"select * from ({shares}) x where match_ratio >= 0.8")
    cols = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]
    register("profile_cardinality", lambda s, d: profile.cardinality(table(s, d, "orders"), cols),
             per_column(cols, "count(distinct {c}) as distinct_count, round(count(distinct {c}) * 1.0 / count({c}), 6) as unique_ratio, "
                        "count(distinct {c}) = count({c}) as is_unique, count(distinct {c}) <= 1 as is_constant", "orders"))
    register("profile_cardinality_approx", lambda s, d: profile.cardinality(table(s, d, "orders"), cols, approximate=True))
    for name, least, order in (("top", False, "n desc"), ("bottom", True, "n")):
        register(f"profile_{name}_values", lambda s, d, least=least: profile.ranked_values(table(s, d, "part"), ["p_brand", "p_type", "p_size"], 5, least),
                 " union all ".join(f"select * from (select '{c}' as \"column\", cast(row_number() over (order by {order}, value) as int) as rank, value, n as count from "
                                    f"(select cast({c} as varchar) as value, count(*) n from part where {c} is not null group by 1) g) r where rank <= 5"
                                    for c in ("p_brand", "p_type", "p_size")))
    register("profile_quartiles", lambda s, d: profile.quartiles(table(s, d, "lineitem"), NUM),
             per_column(NUM, "quantile_cont({c}, 0.25) as q1, median({c}) as median, quantile_cont({c}, 0.75) as q3", "lineitem"))
    register("profile_histogram", lambda s, d: profile.histogram(table(s, d, "orders"), ["o_totalprice"]),
             "select 'o_totalprice' as \"column\", cast(b as int) as bucket, round(lo + b * w, 6) as low, round(lo + (b + 1) * w, 6) as high, "
             "count(x) as count, round(count(x) * 100.0 / max(n), 6) as percentage from (select unnest(range(10)) b) bs cross join "
             "(select min(o_totalprice) lo, (max(o_totalprice) - min(o_totalprice)) / 10 w, count(o_totalprice) n from orders) e "
             "left join (select o_totalprice x from orders) o on least(floor((x - lo) / w), 9) = b group by b, lo, w")
    register("profile_table", lambda s, d: profile.table_profile(source(s, d, "select l_partkey, l_suppkey from {lineitem}")),
             "select sum(n)::bigint as row_count, 2 as column_count, (sum(n) * 16)::bigint as estimated_bytes, sum(n - 1)::bigint as duplicate_rows, "
             "round(sum(n - 1) * 1.0 / sum(n), 6) as duplicate_ratio from (select count(*) n from lineitem group by l_partkey, l_suppkey) g")
    register("profile_correlations", lambda s, d: profile.correlations(source(s, d, SUMS), ["l_extendedprice", "cut", "net", "l_quantity"], 0.5),
             f"with data as ({duck(SUMS)}) select * from (" + " union all ".join(
                 f"select '{a}' as column_a, '{b}' as column_b, round(corr({a}, {b}), 6) as correlation from data"
                 for a, b in (("l_extendedprice", "cut"), ("l_extendedprice", "net"), ("l_extendedprice", "l_quantity"), ("cut", "net"), ("cut", "l_quantity"), ("net", "l_quantity")))
             + ") c where abs(correlation) >= 0.5")
    register("profile_learn", lambda s, d: profile.learn(source(s, d, NULLS)).select(
        "column", "nullable", "unique", "min_value", "max_value", "distinct_count", F.array_join("allowed_values", ",").alias("allowed")),
        "with data as (" + duck(NULLS) + ") " + " union all ".join(
            f"select '{c}' as \"column\", count(*) > count({c}) as nullable, count(distinct {c}) = count({c}) as \"unique\", {rng}, count(distinct {c}) as distinct_count, "
            f"case when count(distinct {c}) <= 20 then array_to_string(list_sort(list(distinct cast({c} as varchar))), ',') end as allowed from data"
            for c, rng in (("c_custkey", "min(c_custkey)::double as min_value, max(c_custkey)::double as max_value"), ("bal", "min(bal) as min_value, max(bal) as max_value"),
                           ("nat", "min(nat)::double as min_value, max(nat)::double as max_value"), ("seg", "null::double as min_value, null::double as max_value"),
                           ("nm", "null::double as min_value, null::double as max_value"))))
    register("profile_full", lambda s, d: profile.profile(table(s, d, "lineitem")))
    change = ("with m as ({0}) select \"column\", metric, round(b, 6) as baseline, round(c, 6) as current, round(c - b, 6) as change, round((c - b) / nullif(b, 0) * 100, 6) as change_pct, "
              "coalesce(abs(j) >= 1.0, false) as is_significant, case when abs(coalesce(j, 0)) < 1.0 then 'stable' when j > 0 then 'up' else 'down' end as trend from "
              "(select *, case when metric in ('null_pct', 'unique_pct') then c - b else (c - b) / nullif(b, 0) * 100 end as j from m) x")
    forms = {"null_pct": "round((count(*) - count({c})) * 1.0 / count(*), 6) * 100", "unique_pct": "round(count(distinct {c}) * 1.0 / count({c}), 6) * 100",
             "distinct_count": "count(distinct {c}) * 1.0", "mean": "round(avg({c}), 6)", "std": "round(stddev_samp({c}), 6)", "min": "min({c}) * 1.0", "max": "max({c}) * 1.0"}
    parts = " union all ".join(f"select '{c}' as \"column\", '{k}' as metric, (select {f.replace('{c}', c)} from a) as b, (select {f.replace('{c}', c)} from r) as c"
                               for c in NUM for k, f in forms.items())
    register("profile_compare", lambda s, d: profile.compare_profiles(source(s, d, A), source(s, d, R), NUM, 0.01),
             f"with a as ({duck(A)}), r as ({duck(R)}) select * from (" + change.format(parts) + ") z")
    register("profile_data_change", lambda s, d: profile.data_change(profile.table_metrics(source(s, d, E1)), profile.table_metrics(source(s, d, E2)), 0.02),
             f"with a as ({duck(E1)}), b as ({duck(E2)}), m as (" + " union all ".join(
                 f"select '{n}' as metric, (select {e} from a) as baseline, (select {e} from b) as current" for n, e in (
                     ("row_count", "count(*) * 1.0"), ("null_percentage", "max(0.0)"),
                     ("distinct_count", "(count(distinct event_id) + count(distinct ts) + count(distinct user_id) + count(distinct event_type) + count(distinct value) + count(distinct props)) / 6.0")))
             + ") select metric, baseline::double as baseline, current::double as current, round(g, 6) as change, g >= 0.02 as triggered from "
               "(select *, case when baseline = 0 then (case when current <> 0 then 1.0 else 0.0 end) else abs(current - baseline) / abs(baseline) end as g from m) x")
    # Every day of the events stands for one stored profile.
    days = "select date_trunc('day', ts) as ts, event_type as col, count(*) as row_count, avg(cast(case when value > 60 then 100 else 0 end as double)) as null_pct, count(distinct user_id) * 100 / count(*) as unique_pct from {events} group by date_trunc('day', ts), event_type"
    stored = lambda s, d: source(s, d, days).select(F.date_format("ts", "yyyy-MM-dd").alias("profile_id"), "ts", F.col("col").alias("column"), "row_count", "null_pct", "unique_pct")
    register("profile_trend", lambda s, d: profile.trend_of_profiles(stored(s, d)).drop("ts"),
             f"select strftime(ts, '%Y-%m-%d') as profile_id, max(row_count) as row_count, count(*) as column_count, round(avg(null_pct), 2) as avg_null_pct, "
             f"round(avg(unique_pct), 2) as avg_unique_pct from ({duck(days)}) x group by 1")
    register("profile_column_trends", lambda s, d: profile.column_trends(stored(s, d)),
             f"select col as \"column\", round(f, 6) as first, round(l, 6) as last, round(mn, 6) as min_value, round(mx, 6) as max_value, round(av, 6) as avg_value, "
             f"round(case when f <> 0 then (l - f) / f * 100 else 0 end, 2) as change_pct, case when abs(l - f) < 1 then 'stable' when l > f then 'up' else 'down' end as trend from "
             f"(select col, arg_min(null_pct, ts) f, arg_max(null_pct, ts) l, min(null_pct) mn, max(null_pct) mx, avg(null_pct) av from ({duck(days)}) x group by col having count(*) >= 2) y")


    daily = f"(select strftime(ts, '%Y-%m-%d') d, max(row_count) c, row_number() over (order by strftime(ts, '%Y-%m-%d')) - 1 as i from ({duck(days)}) x group by 1) y"
    fit = "regr_slope(c, i)"
    r = "corr(c, i)"
    register("profile_row_count_trend", lambda s, d: profile.row_count_trend(stored(s, d)),
             f"select n as profiles, round((l - f) * 100.0 / f, 6) as change_pct, case when abs((l - f) * 100.0 / f) < 5 then 'stable' when l > f then 'up' else 'down' end as trend, round(slope, 6) as slope, "
             f"abs(t) > 2.048407 as is_significant from (select count(*) n, arg_min(c, i) f, arg_max(c, i) l, {fit} as slope, {r} * sqrt((count(*) - 2) / (1 - {r} * {r})) as t from {daily}) z")
    pct = "select l_orderkey, case when l_discount = 0 then '' when l_discount > 0.09 then 'n/a' else concat(cast(cast(l_discount * 1000 as int) as string), '.5%') end as txt from {lineitem}"
    register("parse_percent", lambda s, d: source(s, d, pct).select("txt", profile.parse_percent(F.col("txt")).alias("pct")).groupBy("txt", "pct").agg(F.count(F.lit(1)).alias("n")),
             f"select txt, coalesce(try_cast(replace(txt, '%', '') as double), 0) as pct, count(*) as n from ({duck(pct)}) x group by 1, 2")


def rule_queries() -> None:
    register("rules_suggest", lambda s, d: rules.suggest(rules.profile_rows(source(s, d, NULLS))),
             # Written out for this source from measured shares.
             "select * replace (confidence::double as confidence) from (with data as (" + duck(NULLS) + "), p as (" + " union all ".join(
                 f"select '{c}' as \"column\", {int(num)} as num, 1 - count({c}) * 1.0 / count(*) as nr, round(count(distinct {c}) * 1.0 / count({c}), 6) as ur, count(distinct {c}) as d, "
                 f"{'min(%s)::double' % c if num else 'null::double'} as lo, {'max(%s)::double' % c if num else 'null::double'} as hi from data"
                 for c, num in (("c_custkey", 1), ("bal", 1), ("nat", 1), ("seg", 0), ("nm", 0))) + ") " + " union all ".join((
                     "select \"column\", 'NotNull' as \"check\", 'completeness' as category, 0.95 as confidence, 'high' as severity, '{}' as params from p where nr = 0",
                     "select \"column\", 'Unique', 'uniqueness', 0.95, 'high', '{}' from p where ur >= 0.999",
                     "select \"column\", 'Unique', 'uniqueness', 0.8, 'medium', '{\"mostly\":' || round(ur, 2) || '}' from p where ur >= 0.95 and ur < 0.999",
                     "select \"column\", 'DistinctCount', 'distribution', 0.75, 'low', '{\"max_count\":' || (d + 5) || '}' from p where ur < 0.1 and d between 1 and 49",
                     "select \"column\", 'Range', 'statistics', 0.7, 'medium', '{\"min_value\":' || round(lo - (hi - lo) * 0.1, 2)::double || ',\"max_value\":' || round(hi + (hi - lo) * 0.1, 2)::double || '}' from p where num = 1 and hi > lo",
                     "select \"column\", 'NonNegative', 'statistics', 0.75, 'low', '{}' from p where num = 1 and lo >= 0 and regexp_matches(\"column\", '(id|count|quantity|amount|price|age)$')",
                     "select \"column\", 'ZScoreOutlier', 'statistics', 0.6, 'low', '{\"threshold\": 3.0}' from p where num = 1 and hi > lo")) + ") z")
    register("rules_suite", lambda s, d: rules.generate_suite(table(s, d, "orders"), "strict"))
    wide = ("select o.o_orderdate as order_date, l.l_shipdate as ship_date, l.l_quantity as quantity, l.l_extendedprice / l.l_quantity as unit_price, l.l_extendedprice as total, "
            "l.l_extendedprice * l.l_tax as tax, l.l_extendedprice as subtotal from {lineitem} l join {orders} o on l.l_orderkey = o.o_orderkey")
    register("rules_cross_column", lambda s, d: rules.suggest_cross(source(s, d, wide)), cross_oracle(wide.format(lineitem="lineitem", orders="orders")))
    keyed = "select cast(floor(o_orderkey * 0.8) as bigint) as batch_id, cast(floor(o_orderkey / 3) * 2 + o_orderkey % 2 as bigint) as ref_no, o_orderstatus, o_orderpriority, o_custkey from {orders}"
    register("rules_composite_keys", lambda s, d: rules.suggest_cross(source(s, d, keyed)), composite_oracle(keyed.format(orders="orders")))
    bucketed = "select o_custkey, o_custkey % 10 as bucket, o_orderstatus, o_orderpriority from {orders}"
    register("rules_dependencies", lambda s, d: rules.dependencies(source(s, d, bucketed)),
             "select 'o_custkey' as determinant, 'bucket' as dependent, count(distinct o_custkey) as distinct_determinant, count(distinct row(o_custkey, o_custkey % 10)) as distinct_pair, true as holds from orders")
    register("rules_apply_suite", apply_suite)
    rate = "avg(case when regexp_matches(text, '" + P.PII["email"] + "') then 1.0 else 0.0 end)"
    register("rules_confidence", lambda s, d: table(s, d, "documents").groupBy("lang").agg(
        F.avg(F.col("text").rlike(P.PII["email"]).cast("int")).alias("rate"), F.count(F.lit(1)).alias("n"), (F.count_distinct("source") / F.count(F.lit(1))).alias("u")).select(
        "lang", F.round(rules.pattern_confidence(F.col("rate"), F.col("n")), 6).alias("pattern"), F.round(rules.uniqueness_confidence(F.col("u"), F.col("n")), 6).alias("uniqueness")),
        f"select lang, round(least(1.0, 0.5 + {rate} * 0.4 + least(1.0, count(*) / 100.0) * 0.1), 6) as pattern, "
        "round(least(1.0, (case when u >= 0.99 then 0.85 when u >= 0.95 then 0.75 when u >= 0.8 then 0.65 else 0.5 end) + least(0.1, count(*) / 100000.0)), 6) as uniqueness from "
        "(select *, (count(distinct source) over (partition by lang)) * 1.0 / count(*) over (partition by lang) as u from documents) d group by lang, u")
    register("rules_sample_violations", lambda s, d: rules.sample_violations(
        table(s, d, "customer"), CheckConfig("Positive", {"column": "c_acctbal"}), 5).agg(F.count(F.lit(1)).alias("n"), F.max(F.col("c_acctbal") > 0).alias("any_good")),
        "select least(count(*), 5) as n, false as any_good from customer where c_acctbal <= 0")


def apply_suite(spark, sf):
    """Generate a suite for orders and run it."""
    orders = table(spark, sf, "orders")
    return shown(run(orders, rules.suite_configs(rules.generate_suite(orders, "default"))))


def drift_queries() -> None:
    def cmp(name: str, a: str, b: str, col: str, stat: str, frm: str, p: str = "null", numeric: str = "double") -> None:
        limit = drift.THRESHOLDS[name]
        hit = f"p < {limit}" if name in drift.P_VALUE_METHODS else f"s > {limit}"
        p_out = "round(p, 6)" if p != "null" else "null"
        register(f"drift_{name}", lambda s, d: drift.compare(source(s, d, a), source(s, d, b), [col], name),
                 f"with r as ({duck(a)}), data as ({duck(b)}) select '{col}' as \"column\", '{numeric}' as dtype, '{name}' as method, round(s, 6) as statistic, cast({p_out} as double) as p_value, "
                 f"{limit}::double as threshold, {hit} as drifted from (select s, {p} as p from (select {stat} as s from {frm}) q) z")
    c = "l_extendedprice"
    n1, n2 = f"(select count({c}) from r)", f"(select count({c}) from data)"
    cmp("ks", A, R, c, "max(abs(fa - fb))", cdfs(c), f"(select {ks_p('s', 'n1', 'n2')} from (select {n1} n1, {n2} n2) n)")
    cmp("psi", A, R, c, PSI, bin_shares(c))
    cmp("js", A, R, c, JS, bin_shares(c))
    cmp("kl", A, R, c, "sum(p * ln(p / q))", bin_shares(c))
    cmp("hellinger", A, R, c, "sqrt(sum(power(sqrt(p) - sqrt(q), 2)) / 2)", bin_shares(c))
    cmp("bhattacharyya", A, R, c, "-ln(least(sum(sqrt(p * q)), 1.0))", bin_shares(c))
    cmp("tv", A, R, c, "sum(abs(p - q)) / 2", bin_shares(c))
    e0, e1 = "((na + nb) * t1 / (t1 + t2))", "((na + nb) * t2 / (t1 + t2))"
    z = "((cbrt(s / 4.0) - (1 - 2.0 / 36.0)) / sqrt(2.0 / 36.0))"
    cmp("chi2", E1, E2, "event_type", f"sum(power(na - {e0}, 2) / {e0} + power(nb - {e1}, 2) / {e1})",
        f"(select *, sum(na) over () * 1.0 t1, sum(nb) over () * 1.0 t2 from {value_shares('event_type')}) y", f"1 - {sql_normal(z)}", "string")
    v = "value"
    cmp("wasserstein", E1, E2, v, "sum(abs(fa - fb) * coalesce(nx - x, 0)) / (select stddev_samp(value) from r)", cdfs(v))
    cmp("energy", E1, E2, v, "2 * sum((fa - fb) * (fa - fb) * coalesce(nx - x, 0))", cdfs(v))
    register("drift_cvm", lambda s, d: drift.compare(source(s, d, E1), source(s, d, E2), [v], "cvm").select("column", "statistic"),
             f"with r as ({duck(E1)}), data as ({duck(E2)}) select 'value' as \"column\", round(sum((na + nb) * power(fa - fb, 2)) * max(ta) * max(tb) / power(max(ta) + max(tb), 2), 6) as statistic from {cdfs(v)}")
    mid = "(fa * ta + fb * tb - (na + nb) / 2)"
    tot = "(ta + tb)"
    w = f"({mid} * ({tot} - {mid}) - (na + nb) * {tot} / 4)"
    part = f"power((fa * ta - na / 2) * {tot} - {mid} * ta, 2) / ta + power((fb * tb - nb / 2) * {tot} - {mid} * tb, 2) / tb"
    register("drift_anderson", lambda s, d: drift.compare(source(s, d, E1), source(s, d, E2), [v], "anderson").select("column", "statistic"),
             f"with r as ({duck(E1)}), data as ({duck(E2)}) select 'value' as \"column\", round(sum(case when {w} > 0 then (na + nb) * ({part}) / {w} end) * (max({tot}) - 1) / power(max({tot}), 2), 6) as statistic from {cdfs(v)}")
    freq = [NormalDist().inv_cdf((i + 0.5) / drift.MMD_FEATURES) for i in range(drift.MMD_FEATURES)]
    band = f"(select (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / {math.sqrt(2)!r} as h from (select value from r union all select value from data) u)"
    diffs = " + ".join(f"power(avg({f}(value * {w!r} / h)) filter (where s = 0) - avg({f}(value * {w!r} / h)) filter (where s = 1), 2)" for w in freq for f in ("cos", "sin"))
    cmp("mmd", E1, E2, v, f"({diffs}) / {drift.MMD_FEATURES}", f"(select value, 0 s from r union all select value, 1 from data) u, {band} b")
    register("drift_auto", lambda s, d: drift.compare(source(s, d, E1), source(s, d, E2), ["value", "event_type"]).select("column", "method", "statistic", "drifted"),
             f"with r as ({duck(E1)}), data as ({duck(E2)}) select 'value' as \"column\", 'psi' as method, round(s, 6) as statistic, s > 0.1 as drifted from (select {PSI} s from {bin_shares('value')}) q union all "
             f"select 'event_type', 'chi2', round(s, 6), 1 - {sql_normal(z)} < 0.05 from (select sum(power(na - {e0}, 2) / {e0} + power(nb - {e1}, 2) / {e1}) s from "
             f"(select *, sum(na) over () * 1.0 t1, sum(nb) over () * 1.0 t2 from {value_shares('event_type')}) y) q")
    register("drift_summary", lambda s, d: drift.summary(drift.compare(source(s, d, A), source(s, d, R), NUM, "tv", 0.004)),
             f"with r as ({duck(A)}), data as ({duck(R)}) select count(*) as total_columns, count(*) filter (where x > 0.004) as drifted_columns, "
             "round(count(*) filter (where x > 0.004) * 100.0 / count(*), 6) as drift_percentage, count(*) filter (where x > 0.004) > 0 as has_drift from ("
             + " union all ".join(f"select sum(abs(p - q)) / 2 x from {bin_shares(c)}" for c in NUM) + ") f")


def label(e: str, a: float, b: float, c: float) -> str:
    return f"case when abs({e}) < {a} then 'negligible' when abs({e}) < {b} then 'small' when abs({e}) < {c} then 'medium' else 'large' end"


SIG = ("case when p >= 0.10 then 'not_significant' when p >= 0.05 then 'marginally_significant' when p >= 0.01 then 'significant' "
       "when p >= 0.001 then 'highly_significant' else 'very_highly_significant' end")


def stat_row(test: str, eff: str, inner: str) -> str:
    return (f"select '{test}' as test, round(s, 6) as statistic, round(p, 6) as p_value, round(e, 6) as effect_size, {eff} as effect, {SIG} as significance, "
            f"p < 0.05 as is_significant, n1::bigint as n1, n2::bigint as n2 from ({inner}) w")


def statistics() -> None:
    heads = f"with a as ({duck(E1)}), b as ({duck(E2)}) "
    m = "(select count(value) n1, avg(value) m1, var_samp(value) v1 from a) x, (select count(value) n2, avg(value) m2, var_samp(value) v2 from b) y"
    d = "abs(m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2))"
    t = "(m1 - m2) / sqrt(v1 / n1 + v2 / n2)"
    welch = stat_row("welch_t", label("e", 0.2, 0.5, 0.8), f"select *, {sql_erfc('(abs(s) / sqrt(2.0))')} as p from (select n1, n2, {t} as s, {d} as e from {m}) u")
    register("stats_welch_t", lambda s, f: stats.welch_t(source(s, f, E1), source(s, f, E2), F.col("value"), F.col("value")), heads + welch)
    register("stats_cohens_d", lambda s, f: stats.cohens_d(source(s, f, E1), source(s, f, E2), F.col("value"), F.col("value")),
             heads + f"select round(e, 6) as cohens_d, {label('e', 0.2, 0.5, 0.8)} as effect from (select {d} as e from {m}) q")
    rank = "(select g, rank() over (order by value) + (count(*) over (partition by value) - 1) / 2.0 as r from (select 1 g, value from a union all select 2, value from b) u) k"
    ties = "(select sum(power(c, 3) - c) ts from (select count(*) c from (select value from a union all select value from b) u group by value) g) t"
    u = ("select n1, n2, least(u1, n1 * n2 - u1) as s, sqrt(n1 * n2 / 12.0 * (n1 + n2 + 1 - ts / ((n1 + n2) * (n1 + n2 - 1.0)))) as sd from "
         f"(select sum(r) filter (where g = 1) - count(*) filter (where g = 1) * (count(*) filter (where g = 1) + 1) / 2.0 as u1, count(*) filter (where g = 1) * 1.0 as n1, count(*) filter (where g = 2) * 1.0 as n2 from {rank}) h, {ties}")
    zz = "(abs((s - n1 * n2 / 2) / sd) / sqrt(2.0))"
    mw = stat_row("mann_whitney_u", label("e", 0.1, 0.3, 0.5), f"select *, {sql_erfc(zz)} as p, 1 - 2 * s / (n1 * n2) as e from ({u}) i")
    register("stats_mann_whitney", lambda s, f: stats.mann_whitney(source(s, f, E1), source(s, f, E2), F.col("value"), F.col("value")), heads + mw)
    register("stats_comprehensive", lambda s, f: stats.comprehensive(source(s, f, E1), source(s, f, E2), F.col("value"), F.col("value")),
             heads + f"select *, test = 'welch_t' as recommended from ({welch} union all {mw}) x")
    chi = ("select n1, n2, k, (n1 + n2) * (s1 / n1 + s2 / n2 - 1) as s from (select sum(x) * 1.0 n1, sum(y) * 1.0 n2, sum(x * x / (x + y)) s1, sum(y * y / (x + y)) s2, count(*) k from "
           "(select event_type, sum(i) * 1.0 x, sum(j) * 1.0 y from (select event_type, 1 i, 0 j from a union all select event_type, 0, 1 from b) u group by 1) g) h")
    wh = "((cbrt(s / (k - 1)) - (1 - 2.0 / (9 * (k - 1)))) / sqrt(2.0 / (9 * (k - 1))))"
    register("stats_chi_square", lambda s, f: stats.chi_square(source(s, f, E1), source(s, f, E2), F.col("event_type"), F.col("event_type")),
             heads + stat_row("chi_square", label("e", 0.1, 0.3, 0.5), f"select *, 1 - {sql_normal(wh)} as p, sqrt(s / (n1 + n2)) as e from ({chi}) i"))
    r, x = "corr(o_totalprice, x)", "epoch(o_orderdate) / 86400.0"
    tr = f"select n as n1, 0 as n2, e, r * sqrt((n - 2) / (1 - r * r)) as s from (select count(*) n, {r} as r, regr_slope(o_totalprice, x) as e from (select o_totalprice, {x} as x from orders) o) q"
    register("stats_trend", lambda s, f: stats.trend(table(s, f, "orders"), F.unix_micros(F.col("o_orderdate").cast("timestamp")) / F.lit(86400e6), F.col("o_totalprice")),
             stat_row("trend", "case when e > 0 then 'increasing' when e < 0 then 'decreasing' else 'flat' end", f"select *, {sql_erfc('(abs(s) / sqrt(2.0))')} as p from ({tr}) i"))


for part in (profiles, rule_queries, drift_queries, statistics):
    part()
