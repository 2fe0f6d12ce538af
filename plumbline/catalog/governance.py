"""Queries of the privacy, sampling, sketch, anomaly, schema, lineage,
rollup, routing and retention operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.catalog.base import duck, register, source, table
from plumbline.catalog.checks_values import PEOPLE, core_sql, found, lof_sql
from plumbline.functions import patterns as P
from plumbline.operators import anomaly, lineage, privacy, retention, routing, runs, sampling, schema_evolution, sketches
from plumbline.session import checkpointed


def privacy_queries() -> None:
    tables = (("documents", ("text",)), ("conversations", ("text",)))
    for name, cols in tables:
        parts = " union all ".join(
            f"select '{c}' as \"column\", '{k}' as pii_type, count(*) filter (where {found(c, k)}) as count, count({c}) as total, "
            f"round(count(*) filter (where {found(c, k)}) * 1.0 / count({c}), 6) as confidence from {name}" for c in cols for k in P.PII)
        register(f"pii_scan_{name}", lambda s, d, name=name, cols=cols: privacy.scan(table(s, d, name), cols).drop("samples"),
                 f"select * from ({parts}) f where count > 0")
        rules = " union all ".join(f"select '{r}' as regulation, '{k}' as kind" for r, ks in P.REGULATIONS.items() for k in ks)
        severity = ("case when pii_type in ('ssn', 'credit_card', 'passport') then 'critical' when pii_type in ('email', 'phone', 'address', 'date_of_birth', 'driver_license') "
                    "then 'high' else 'medium' end")
        register(f"pii_violations_{name}", lambda s, d, name=name, cols=cols: privacy.violations(privacy.scan(table(s, d, name), cols)),
                 f"select regulation, \"column\", pii_type, count, {severity} as severity from ({parts}) f join ({rules}) r on f.pii_type = r.kind where count > 0")
    register("mask_hash", lambda s, d: privacy.mask(table(s, d, "customer"), ["c_name"], "hash").select("c_custkey", "c_name"),
             "select c_custkey, sha256(c_name) as c_name from customer")
    register("mask_redact", lambda s, d: privacy.mask(table(s, d, "conversations"), ["text"], "redact"),
             "select conv_id, turn, role, repeat('*', length(text)) as text from conversations")
    register("mask_fake", lambda s, d: privacy.mask(table(s, d, "part").withColumn("real", F.col("p_name")), ["p_name"], "fake").agg(
        F.count_distinct("real").alias("names"), F.count_distinct("p_name").alias("pseudonyms"), F.count_if(F.col("real") == F.col("p_name")).alias("kept")),
        "select count(distinct p_name) as names, count(distinct p_name) as pseudonyms, 0::bigint as kept from part")
    register("mask_detected", lambda s, d: privacy.mask(table(s, d, "documents").select("doc_id", "text", "lang")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("text").rlike("[^*]")).alias("readable"), F.count_if(F.col("lang").rlike("[^*]")).alias("lang_kept")),
        "select count(*) as n, 0::bigint as readable, count(*) as lang_kept from documents")
    register("k_anonymity", lambda s, d: privacy.k_anonymity(source(s, d, PEOPLE), ["c_nationkey", "c_mktsegment"], "dest"),
             f"select c_nationkey, c_mktsegment, count(*) as k, count(distinct dest) as l from ({duck(PEOPLE)}) p group by 1, 2")


def sizes(df: DataFrame, whole: DataFrame, key: str) -> DataFrame:
    """Rows of a sample, distinct keys, and keys that are not in the table."""
    return df.select(F.col(key).alias("k")).join(whole.select(F.col(key).alias("k"), F.lit(1).alias("known")), "k", "left").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("k").alias("keys"), F.count_if(F.col("known").isNull()).alias("foreign"))


def sampling_queries() -> None:
    def sized(name: str, tbl: str, key: str, take, expected: str) -> None:
        register(f"sample_{name}", lambda s, d: sizes(take(table(s, d, tbl)), table(s, d, tbl), key),
                 f"select n as rows, n as keys, 0::bigint as foreign from (select ({expected})::bigint as n from (select count(*) as total from {tbl}) t) x")
    sized("random", "orders", "o_orderkey", lambda df: sampling.random_sample(df, 1000, ["o_orderkey"]), "least(1000, total)")
    sized("block", "events", "event_id", lambda df: sampling.block(df, 500, ["event_id"], 1000), "least(500, ceil(total / 1000.0) * greatest(500 // ceil(total / 1000.0)::bigint, 1))")
    sized("multi_stage", "orders", "o_orderkey", lambda df: sampling.multi_stage(df, 300, ["o_orderkey"]), "least(300, total)")
    sized("column_aware", "customer", "c_custkey", lambda df: sampling.column_aware(df, 100, ["c_custkey"]), "least(140, total)")
    sized("systematic", "events", "event_id", lambda df: sampling.systematic(df, 7, ["event_id"], 2), "(total - 3) // 7 + 1")
    sized("adaptive", "orders", "o_orderkey", lambda df: sampling.adaptive(df, 1000, ["o_orderkey"]), "total")
    register("sample_systematic_rows", lambda s, d: sampling.systematic(table(s, d, "events"), 11, ["event_id"]).select("event_id", "value"),
             "select event_id, value from (select event_id, value, row_number() over (order by event_id) - 1 as i from events) r where i % 11 = 0")
    register("sample_head", lambda s, d: sampling.head(table(s, d, "orders"), 50, ["o_orderkey"]).select("o_orderkey", "o_totalprice"),
             "select o_orderkey, o_totalprice from orders order by o_orderkey limit 50")
    register("sample_tail", lambda s, d: sampling.tail(table(s, d, "orders"), 50, ["o_orderkey"]).select("o_orderkey", "o_totalprice"),
             "select o_orderkey, o_totalprice from orders order by o_orderkey desc limit 50")
    register("sample_stratified", lambda s, d: sampling.stratified(table(s, d, "orders"), 1500, "o_orderpriority", ["o_orderkey"]).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("o_orderpriority").alias("strata")),
        "select least(1500, sum(floor(n * 1.1 * 1500 / t)))::bigint as rows, count(*) as strata from (select count(*) n, sum(count(*)) over () t from orders group by o_orderpriority) g")
    # Draws that both sides can compute: a multiplicative hash of the key.
    spread = "((o_orderkey * 2654435761 + 12345) % 4294967296 + 0.5) / 4294967296.0"
    register("sample_reservoir", lambda s, d: sampling.reservoir(table(s, d, "orders"), 400, ["o_orderkey"], draw=F.expr(spread).cast("double")).select("o_orderkey", "o_totalprice"),
             f"select o_orderkey, o_totalprice from orders order by {spread} desc, o_orderkey limit 400")
    register("sample_reservoir_weighted", lambda s, d: sampling.reservoir(table(s, d, "orders"), 400, ["o_orderkey"], "o_totalprice", draw=F.expr(spread).cast("double")).select("o_orderkey", "o_totalprice"),
             f"select o_orderkey, o_totalprice from orders where o_totalprice > 0 order by -ln({spread}) / o_totalprice, o_orderkey limit 400")
    register("sample_hash", lambda s, d: sampling.hash_sample(table(s, d, "lineitem"), ["l_orderkey"], 1, 10).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
             .join(table(s, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("m")), "l_orderkey").agg(F.count_if(F.col("n") != F.col("m")).alias("split_keys")),
             "select 0::bigint as split_keys from (select count(*) from lineitem) t")
    register("sample_progressive", lambda s, d: progressive(s, d))
    register("sample_size_plan", lambda s, d: sampling.size_plan(table(s, d, "lineitem"), "sketch"),
             "select n as population, case when n < 1000000 then 'small' when n < 10000000 then 'medium' else 'large' end as scale, r as recommended, "
             "greatest(r // 2, 100) as min_size, least(r * 10, n) as max_size, case when n < 1000000 then 'none' when n < 10000000 then 'column_aware' else 'block' end as strategy from "
             "(select n, greatest(greatest(ceil(384.16 / (1 + 383.16 / n)), 100), 10000)::bigint as r from (select count(*) n from lineitem) a) b")


def progressive(spark: SparkSession, sf: str) -> DataFrame:
    p = sampling.progressive(table(spark, sf, "lineitem"), 5000, ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"])
    return p.sample.agg(F.count(F.lit(1)).alias("rows")).withColumn("stages", F.lit(p.stages)).withColumn("converged", F.lit(p.converged))


def sketch_queries() -> None:
    register("sketch_hll", lambda s, d: sketches.hll_distinct(table(s, d, "lineitem"), "l_partkey").select(
        F.lit("l_partkey").alias("column"), (F.abs(F.col("estimate") / table(s, d, "lineitem").agg(F.count_distinct("l_partkey")).scalar() - 1) < F.col("standard_error") * 4).alias("within")),
        "select 'l_partkey' as \"column\", count(*) > 0 as within from lineitem")
    register("sketch_count_min", lambda s, d: sketches.count_min_lookup(
        sketches.count_min(table(s, d, "events"), "event_type"), table(s, d, "events").select("event_type").distinct(), "event_type"),
        "select event_type as value, count(*) as estimate from events group by 1")
    register("sketch_count_min_bound", lambda s, d: bound(s, d),
             "select 0::bigint as too_small, true as within from (select count(*) from orders) t")
    register("sketch_bloom", lambda s, d: sketches.bloom_contains(
        sketches.bloom(table(s, d, "orders"), "o_custkey", 200_000), table(s, d, "orders").select("o_custkey").distinct(), "o_custkey", 200_000)
        .groupBy("maybe").agg(F.count(F.lit(1)).alias("n")), "select true as maybe, count(distinct o_custkey) as n from orders")
    register("sketch_bloom_error", lambda s, d: sketches.bloom_contains(
        sketches.bloom(table(s, d, "orders"), "o_orderkey", 200_000), table(s, d, "orders").select((F.col("o_orderkey") + 10_000_000).alias("k")), "k", 200_000)
        .agg((F.avg(F.col("maybe").cast("int")) < 0.02).alias("below_two_percent")), "select true as below_two_percent from (select count(*) from orders) t")
    register("sketch_heavy_hitters", lambda s, d: sketches.heavy_hitters(table(s, d, "events"), "user_id", 10, 0.005),
             "select user_id as value, count(*) as count, round(count(*) * 1.0 / (select count(*) from events), 6) as share from events group by 1 "
             "having count(*) * 1.0 / (select count(*) from events) >= 0.005 order by 2 desc, 1 limit 10")
    register("sketch_top_k", lambda s, d: sketches.approx_heavy_hitters(table(s, d, "orders"), "o_orderpriority", 5),
             "select o_orderpriority as value, count(*) as count from orders group by 1 order by 2 desc limit 5")


def bound(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    exact = orders.groupBy(F.col("o_custkey").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    found = sketches.count_min_lookup(sketches.count_min(orders, "o_custkey"), exact.withColumnRenamed("value", "o_custkey"), "o_custkey")
    # The guarantee: at most e/width of all rows too much, but for a share e^-depth of the values.
    slack = orders.count() * 2.7183 / 2000
    return found.join(exact, "value").agg(F.count_if(F.col("estimate") < F.col("n")).alias("too_small"),
                                          (F.avg((F.col("estimate") - F.col("n") > slack).cast("int")) <= 0.0068).alias("within"))


Z = "(select *, avg(o_totalprice) over () m1, stddev_samp(o_totalprice) over () s1, avg(o_custkey) over () m2, stddev_samp(o_custkey) over () s2 from orders)"
ZS = "greatest(abs(o_totalprice - m1) / s1, abs(o_custkey - m2) / s2)"


def anomaly_queries() -> None:
    cols = ["o_totalprice", "o_custkey"]
    orders = lambda s, d: table(s, d, "orders")
    scored = f"(select o_orderkey as id, {ZS} as score, {ZS} > 1.7 as is_anomaly, * from {Z} z)"
    detect = lambda s, d, **k: anomaly.detect(orders(s, d), "o_orderkey", "statistical", cols, **k)
    register("anomaly_zscore", lambda s, d: anomaly.report(detect(s, d, threshold=1.7)),
             f"select count(*) as total_rows, count(*) filter (where is_anomaly) as anomaly_count, round(count(*) filter (where is_anomaly) * 1.0 / count(*), 6) as anomaly_rate from {scored} x")
    register("anomaly_top", lambda s, d: anomaly.top_anomalies(detect(s, d, threshold=1.5), 100).select("id", F.round("score", 6).alias("score")),
             f"select id, round(score, 6) as score from {scored} x where score > 1.5 order by x.score desc, id limit 100")
    register("anomaly_column_summary", lambda s, d: anomaly.column_summaries(orders(s, d), "o_orderkey", detect(s, d, threshold=1.7), cols),
             " union all ".join(f"select '{c}' as \"column\", count(*) filter (where is_anomaly) as anomaly_count, round(count(*) filter (where is_anomaly) * 1.0 / count(*), 6) as anomaly_rate, "
                                f"round(coalesce(avg(score) filter (where is_anomaly), 0), 6) as mean_anomaly_score, min({c})::double as min_value, max({c})::double as max_value from {scored} x" for c in cols))
    q = "(select quantile_cont(value, 0.25) a, quantile_cont(value, 0.75) b, median(value) m from events) q"
    ev = lambda s, d, **k: anomaly.detect(table(s, d, "events"), "event_id", "statistical", ["value"], **k)
    iqr = f"(select event_id as id, greatest(0, (a - 1.5 * (b - a) - value) / (b - a), (value - b - 1.5 * (b - a)) / (b - a)) as score, value < a - 1.5 * (b - a) or value > b + 1.5 * (b - a) as is_anomaly from events, {q}) x"
    register("anomaly_iqr", lambda s, d: ev(s, d, method="iqr", threshold=1.5).filter("is_anomaly").select("id", F.round("score", 6).alias("score")),
             f"select id, round(score, 6) as score from {iqr} where is_anomaly")
    mad = f"(select event_id as id, abs(value - m) * (0.6745 / d) as score from events, {q}, (select median(abs(value - m)) d from events, (select median(value) m from events) z) r) x"
    register("anomaly_mad", lambda s, d: ev(s, d, method="mad", threshold=3.5).filter("is_anomaly").select("id", F.round("score", 6).alias("score")),
             f"select id, round(score, 6) as score from {mad} where score > 3.5")
    z = "(select event_id as id, abs(value - m) / s as score from events, (select avg(value) m, stddev_samp(value) s from events) q) x"
    hits = (f"(select 'zscore' as algorithm, id from {z} where score > 2.0 union all select 'iqr', id from {iqr} where is_anomaly union all select 'mad', id from {mad} where score > 3.5)")
    many = lambda s, d: anomaly.run_many(table(s, d, "events"), "event_id", {
        "zscore": {"algorithm": "statistical", "method": "zscore", "threshold": 2.0}, "iqr": {"algorithm": "statistical", "method": "iqr", "threshold": 1.5},
        "mad": {"algorithm": "statistical", "method": "mad", "threshold": 3.5}}, ["value"])
    per = f"(select id, count(distinct algorithm) n from {hits} h group by id)"
    register("anomaly_agreement", lambda s, d: anomaly.agreement(many(s, d), 3).drop("detected_by"),
             f"select id, n as detection_count, case when n = 3 then 'all' when n >= 2 then 'majority' else 'one' end as agreement_level, round(n / 3.0, 6)::double as confidence from {per} p")
    register("anomaly_agreement_summary", lambda s, d: anomaly.agreement_summary(many(s, d), 3),
             f"select count(*) as total_unique_anomalies, count(*) filter (where n = 3) as all_agree, count(*) filter (where n >= 2) as majority_agree, count(*) filter (where n >= 2) as some_agree, count(*) filter (where n = 1) as one_only from {per} p")
    register("anomaly_overlap", lambda s, d: anomaly.overlap_matrix(many(s, d)),
             f"select a.algorithm as algorithm_i, b.algorithm as algorithm_j, count(*) as overlap from {hits} a join {hits} b on a.id = b.id group by 1, 2")
    register("anomaly_batch", lambda s, d: anomaly.batch({"orders": (orders(s, d), "o_orderkey"), "parts": (table(s, d, "part"), "p_partkey"),
                                                          "broken": (table(s, d, "region").select("r_name", F.col("r_name").alias("id")), "id")}, "statistical", threshold=1.7).select(
        "source", "total_rows", F.col("error").isNotNull().alias("failed")),
        "select 'orders' as source, count(*) as total_rows, false as failed from orders union all select 'parts', count(*), false from part union all select 'broken', null, true")
    rep = "select count(*) as total_rows, count(*) filter (where {0}) as anomaly_count, round(count(*) filter (where {0}) * 1.0 / count(*), 6)::double as anomaly_rate from {1}"
    heads = lambda parts: "with " + ", ".join(f"{k} as ({duck(v)})" for k, v in parts.items()) + " "
    cust = "select c_acctbal as a, cast(c_nationkey as double) as b from {customer}"
    # Two standardised columns: the second component is their difference (or sum).
    pair = ("(select power(z1 - r * z2, 2) / 4 as s from (select (o_totalprice - avg(o_totalprice) over ()) / stddev_pop(o_totalprice) over () z1, (o_custkey - avg(o_custkey) over ()) / stddev_pop(o_custkey) over () z2, "
            "(select sign(corr(o_totalprice, o_custkey)) from orders) r from orders) x) y")
    known = {
        "lof": heads(lof_sql(cust, 20)) + rep.format("s > (select quantile_cont(s, 0.98) from lof)", "lof"),
        "dbscan": heads(core_sql(cust, 0.2, 10)) + rep.format("noise", "(select not p.core and not exists (select 1 from core c where power(c.a - p.a, 2) + power(c.b - p.b, 2) <= 0.04 and c.core) as noise from core p) n"),
        "autoencoder": rep.format(f"s > (select quantile_cont(s, 0.95) from {pair})", pair),
    }
    for name, params in (("isolation_forest", {"contamination": 0.02, "n_estimators": 50}), ("lof", {"contamination": 0.02}), ("one_class_svm", {"nu": 0.05}),
                         ("dbscan", {"eps": 0.2, "min_samples": 10}), ("autoencoder", {"encoding_dim": 1}), ("ensemble", {}), ("mahalanobis", {}), ("kmeans", {"n_clusters": 4})):
        src = "customer" if name in ("lof", "dbscan") else "orders"
        key, names = ("c_custkey", ["c_acctbal", "c_nationkey"]) if src == "customer" else ("o_orderkey", cols)
        register(f"anomaly_{name}", lambda s, d, name=name, params=params, src=src, key=key, names=names: anomaly.report(
            anomaly.detect(table(s, d, src), key, name, names, **params)), known.get(name))
    register("anomaly_explain", lambda s, d: anomaly.explain(orders(s, d), "o_orderkey", [r["id"] for r in anomaly.top_anomalies(
        detect(s, d, threshold=1.5), 5).collect()], cols, trees=30, donors=10))


V1 = "select c_custkey, c_name, c_nationkey, c_acctbal from {customer}"
V2 = "select c_custkey, c_name, cast(c_nationkey as bigint) as c_nationkey, cast(c_acctbal as string) as c_acctbal, case when c_acctbal < 0 then null else c_mktsegment end as c_mktsegment from {customer}"
V3 = "select cast(c_custkey % 10 as bigint) as c_custkey, cast(c_nationkey as bigint) as c_nationkey, cast(c_acctbal as double) as c_acctbal, case when c_acctbal < 0 then null else c_mktsegment end as c_mktsegment from {customer}"
SHAPES = {1: {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double"},
          2: {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "bigint", "c_acctbal": "string", "c_mktsegment": "string"},
          3: {"c_custkey": "bigint", "c_nationkey": "bigint", "c_acctbal": "double", "c_mktsegment": "string"}}


def versions(spark: SparkSession, sf: str) -> DataFrame:
    """Learned snapshots of three shapes of the customer table: a dozen rows,
    kept so that a comparison of versions learns them once."""
    out = None
    for i, text in enumerate((V1, V2, V3), 1):
        snap = schema_evolution.learned_snapshot(source(spark, sf, text)).withColumn("version", F.lit(i))
        out = snap if out is None else out.unionByName(snap)
    return checkpointed(out)


SNAPSHOT_SQL = " union all ".join(
    f"select {v} as version, '{c}' as \"column\", '{t}' as dtype, count(*) > count({c}) as nullable, count(distinct {c}) = count({c}) as uniq from ({duck(text)}) v"
    for v, text in ((1, V1), (2, V2), (3, V3)) for c, t in SHAPES[v].items())
CHANGES = ("select coalesce(o.version + 1, n.version)::int as version, coalesce(o.\"column\", n.\"column\") as \"column\", o.dtype t0, n.dtype t1, o.nullable n0, n.nullable n1, o.uniq u0, n.uniq u1, "
           f"o.dtype is not null had, n.dtype is not null has from (select * from ({SNAPSHOT_SQL}) s where version < 3) o full join (select * from ({SNAPSHOT_SQL}) s where version > 1) n "
           "on o.version + 1 = n.version and o.\"column\" = n.\"column\"")
DIFF = ("select version, \"column\", 'column_added' as change_type, null::varchar as old_value, t1 as new_value, case when n1 then 'non_breaking' else 'warning' end as severity from c where not had "
        "union all select version, \"column\", 'column_removed', t0, null, 'breaking' from c where not has "
        "union all select version, \"column\", 'type_changed', t0, t1, case when (t0, t1) in (('int', 'bigint'), ('double', 'string')) then 'non_breaking' else 'breaking' end from c where had and has and t0 <> t1 "
        "union all select version, \"column\", 'nullable_changed', n0::varchar, n1::varchar, case when n0 then 'breaking' else 'non_breaking' end from c where had and has and n0 <> n1 "
        "union all select version, \"column\", 'constraint_changed', 'unique=' || u0::varchar, 'unique=' || u1::varchar, case when u1 then 'warning' else 'non_breaking' end from c where had and has and u0 <> u1")


def schema_queries() -> None:
    register("schema_learned", versions, SNAPSHOT_SQL)
    register("schema_hash", lambda s, d: schema_evolution.schema_hash(versions(s, d)),
             f"select version, sha256(array_to_string(list_sort(list(\"column\" || ':' || dtype || ':' || nullable::varchar)), '|')) as schema_hash from ({SNAPSHOT_SQL}) s group by version")
    again = lambda s, d: versions(s, d).withColumn("version", F.col("version") + 10).filter("version <> 12").unionByName(
        versions(s, d).filter("version = 2").withColumn("version", F.lit(22)).withColumn("nullable", F.lit(True)))
    register("schema_new_versions", lambda s, d: schema_evolution.new_versions(versions(s, d), again(s, d)).select("version"),
             f"select 22 as version from (select count(*) from ({SNAPSHOT_SQL}) s) t")
    register("schema_changes", lambda s, d: schema_evolution.version_changes(versions(s, d)), f"with c as ({CHANGES}) {DIFF}")
    register("schema_breaking", lambda s, d: schema_evolution.breaking_since(versions(s, d), 2), f"with c as ({CHANGES}) select * from ({DIFF}) d where version > 2 and severity = 'breaking'")
    register("schema_summary", lambda s, d: schema_evolution.summary(versions(s, d)),
             f"with c as ({CHANGES}) select 3 as current_version, 3::bigint as total_versions, count(*) as total_changes, count(*) filter (where severity = 'breaking') as breaking_changes from ({DIFF}) d")
    words = "select p_partkey, p_name as a, concat(p_type, ' ', p_name) as b from {part}"
    grams = "list_transform(range(1, greatest(length({0}) - 1, 1) + 1), lambda i: substr(lower({0}), i, 2))"
    toks = "list_filter(regexp_split_to_array(lower({0}), '[_\\-\\s]+'), lambda t: t <> '')"
    over = "len(list_intersect({0}, {1})) * 1.0 / greatest(len(list_distinct(list_concat({0}, {1}))), 1)"
    lev, gram, tok = ("1 - levenshtein(a, b) * 1.0 / greatest(length(a), length(b), 1)", over.format(grams.format("a"), grams.format("b")), over.format(toks.format("a"), toks.format("b")))
    sim = lambda how: F.round(schema_evolution.similarity(F.col("a"), F.col("b"), how), 6).alias(how)
    register("name_similarity", lambda s, d: source(s, d, words).select("p_partkey", *[sim(h) for h in ("levenshtein", "ngram", "token", "composite", "jaro_winkler")]),
             f"select p_partkey, round({lev}, 6)::double as levenshtein, round({gram}, 6)::double as ngram, round({tok}, 6)::double as token, "
             f"round(({lev}) * 0.4 + ({gram}) * 0.3 + ({tok}) * 0.3, 6)::double as composite, round(jaro_winkler_similarity(lower(a), lower(b)), 6) as jaro_winkler from ({duck(words)}) w")
    register("schema_renames", lambda s, d: schema_evolution.renames(
        schema_evolution.learned_snapshot(table(s, d, "customer")), schema_evolution.learned_snapshot(table(s, d, "supplier")), 0.6))


TREE = "select cast(floor(c_custkey / 2) as bigint) as src, c_custkey as dst, case when c_custkey % 2 = 0 then 'transforms_to' else 'derives_from' end as edge_type from {customer} "
NODES = "select c_custkey as id, c_name as name, case when c_custkey = 0 then 'source' when c_nationkey < 12 then 'transform' else 'sink' end as node_type, c_nationkey as source_id from {customer}"
RATES = "select c_nationkey as source_id, o_orderdate as ts, cast(o_orderkey % 20 as double) / 100 as anomaly_rate, o_orderkey from {orders} join {customer} on o_custkey = c_custkey"
START = "select c_custkey as id from {customer} where c_mktsegment = 'BUILDING' and c_acctbal > 9000"


def lineage_queries() -> None:
    edges, nodes, start = (lambda s, d, t=t: source(s, d, t) for t in (TREE, NODES, START))
    down = (f"recursive e as ({duck(TREE)}), w(root, id, depth) as (select id, id, 0 from ({duck(START)}) s union select w.root, e.dst, w.depth + 1 from w join e on w.id = e.src where w.depth < {{0}})")
    up = (f"recursive e as ({duck(TREE)}), w(root, id, depth) as (select id, id, 0 from ({duck(START)}) s union select w.root, e.src, w.depth + 1 from w join e on w.id = e.dst where w.depth < {{0}})")
    register("lineage_downstream", lambda s, d: lineage.downstream(start(s, d), edges(s, d), 6), f"with {down.format(6)} select root, id, min(depth)::int as depth from w where depth > 0 and id <> root group by root, id")
    register("lineage_upstream", lambda s, d: lineage.upstream(start(s, d), edges(s, d), 10), f"with {up.format(10)} select root, id, min(depth)::int as depth from w where depth > 0 and id <> root group by root, id")
    both = f"select s.id as root, coalesce(u.n, 0) as upstream_count, coalesce(x.n, 0) as downstream_count, coalesce(u.n, 0) + coalesce(x.n, 0) as total_affected from ({duck(START)}) s "
    register("lineage_impact", lambda s, d: lineage.impact(start(s, d), edges(s, d), "both", 4),
             both + f"left join (with {up.format(4)} select root, count(distinct id) n from w where depth > 0 and id <> root group by root) u on u.root = s.id "
             f"left join (with {down.format(4)} select root, count(distinct id) n from w where depth > 0 and id <> root group by root) x on x.root = s.id")
    rates = lambda s, d: source(s, d, RATES).withColumn("ts", F.struct("ts", "o_orderkey"))
    latest = f"(select source_id, arg_max(anomaly_rate, row(ts, o_orderkey)) rate from ({duck(RATES)}) r group by source_id)"
    status = "case when rate is null then 'unknown' when rate >= 0.15 then 'high' when rate >= 0.05 then 'medium' when rate > 0 then 'low' else 'clean' end"
    register("lineage_status", lambda s, d: lineage.with_status(nodes(s, d), rates(s, d)).select("id", "anomaly_rate", "status"),
             f"select id, rate as anomaly_rate, {status} as status from ({duck(NODES)}) n left join {latest} l on n.source_id = l.source_id")
    stat = f"st as (select id, {status} as status from ({duck(NODES)}) n left join {latest} l on n.source_id = l.source_id)"
    sev = ("case when s.status in ('medium', 'high') then case r.status when 'high' then 'critical' when 'medium' then 'high' else 'medium' end "
           "when r.status in ('high', 'medium', 'low') then r.status when r.status = 'clean' then 'none' else 'unknown' end")
    imp = f"i as (select root, w.id, depth::int as depth, r.status as root_status, s.status, {sev} as impact_severity from w join st r on w.root = r.id join st s on w.id = s.id where depth > 0 and w.id <> w.root)"
    register("lineage_anomaly_impact", lambda s, d: lineage.anomaly_impact(start(s, d), nodes(s, d), edges(s, d), rates(s, d), 5), f"with {down.format(5)}, {stat}, {imp} select * from i")
    n = "count(*) filter (where impact_severity = '{0}')"
    register("lineage_overall_severity", lambda s, d: lineage.overall_severity(lineage.anomaly_impact(start(s, d), nodes(s, d), edges(s, d), rates(s, d), 5)),
             f"with {down.format(5)}, {stat}, {imp} select root, count(*) as impacted, case when {n.format('critical')} > 0 then 'critical' when {n.format('high')} >= 3 or ({n.format('high')} > 0 and bool_or(root_status = 'high')) then 'critical' "
             f"when {n.format('high')} > 0 then 'high' when {n.format('medium')} >= 3 then 'high' when {n.format('medium')} > 0 then 'medium' when {n.format('low')} > 0 then 'low' else 'none' end as overall from i group by root")
    jobs = "select o_orderkey as op, o_custkey as id from {orders}"
    outs = "select l_orderkey as op, l_suppkey as id from {lineitem}"
    known = "select c_custkey as src, cast(c_nationkey as bigint) as dst, 'derives_from' as edge_type from {customer}"
    register("lineage_track", lambda s, d: lineage.track(source(s, d, jobs), source(s, d, outs), source(s, d, known), "derives_from"),
             f"select distinct a.id as src, b.id as dst, 'derives_from' as edge_type from ({duck(jobs)}) a join ({duck(outs)}) b on a.op = b.op where (a.id, b.id) not in (select (src, dst) from ({duck(known)}) k)")
    register("lineage_node_events", lambda s, d: lineage.node_events(nodes(s, d), edges(s, d), "warehouse", "2024-01-01T00:00:00Z").select(
        F.get_json_object("event", "$.job.name").alias("name"), F.get_json_object("event", "$.inputs[0].name").alias("input"), F.get_json_object("event", "$.outputs[0].namespace").alias("ns")),
        f"select n.name, p.name as input, 'warehouse' as ns from ({duck(NODES)}) n left join ({duck(TREE)}) e on e.dst = n.id left join ({duck(NODES)}) p on p.id = e.src")
    events = lambda s, d: lineage.graph_events(nodes(s, d), "warehouse", "daily", "2024-01-01T00:00:00Z")
    register("lineage_graph_events", lambda s, d: events(s, d).agg(
        F.sum(F.json_array_length(F.get_json_object("event", "$.inputs"))).alias("inputs"),
        F.sum(F.json_array_length(F.get_json_object("event", "$.outputs"))).alias("outputs"),
        F.count_if(F.get_json_object("event", "$.eventType") == "START").alias("started")),
        f"select 2 * count(*) filter (where node_type = 'source') as inputs, count(*) filter (where node_type <> 'source') as outputs, 1::bigint as started from ({duck(NODES)}) n")
    around = lambda s, d: lineage.around(start(s, d), nodes(s, d), edges(s, d), 1)
    near = (f"near as (select id from ({duck(START)}) s union select dst from ({duck(TREE)}) e where src in (select id from ({duck(START)}) s) union select src from ({duck(TREE)}) e where dst in (select id from ({duck(START)}) s))")
    register("lineage_around", lambda s, d: around(s, d)[0].select("id").withColumn("part", F.lit("node")).unionByName(around(s, d)[1].select(F.col("dst").alias("id")).withColumn("part", F.lit("edge"))),
             f"with {near} select id, 'node' as part from near union all select dst, 'edge' from ({duck(TREE)}) e where src in (select id from near) and dst in (select id from near)")


RUNS = ("select event_id as run_id, user_id as source_id, ts as created_at, event_type <> 'error' as passed, case when event_type = 'error' then 'failed' when event_type = 'purchase' then 'error' else 'success' end as status, "
        "event_type, value, cast(floor(value * 1000) as bigint) as size_bytes from {events}")
SOURCES = "select c_custkey as source_id, c_acctbal > 0 as is_active, case when c_custkey % 4 = 0 then null else c_nationkey end as owner_id, case when c_custkey % 8 < 4 then null else c_mktsegment end as team_id, cast(null as string) as domain_id from {customer}"
INCIDENTS = ("select event_id as incident_id, ts as created_at, case when value > 80 then 'critical' when value > 50 then 'high' when value > 20 then 'medium' else 'low' end as severity, "
             "case when event_id % 4 = 0 then 'resolved' when event_id % 4 = 1 then 'acknowledged' else 'open' end as status, case when event_id % 4 = 0 then 'resolved' else 'triggered' end as state, "
             "concat('user ', cast(user_id as string)) as source_name, case when event_type = 'view' then null else event_type end as queue_id, event_type as queue_name, "
             "case when event_id % 3 = 0 then null else user_id % 10 end as assignee_id, props as message, event_type as title, "
             "case when event_id % 4 = 0 then ts + interval 2 hours else null end as resolved_at from {events}")
NOW = "2024-01-30 12:00:00"
SINCE = "timestamp '{0}'"


def run_queries() -> None:
    rs, inc = (lambda s, d: source(s, d, RUNS)), (lambda s, d: source(s, d, INCIDENTS))
    r, i = f"({duck(RUNS)}) r", f"({duck(INCIDENTS)}) i"
    rate = "round(count(*) filter (where passed) * 100.0 / count(*), 2)::double"
    register("runs_history_summary", lambda s, d: runs.history_summary(rs(s, d), NOW, 7),
             f"select source_id, count(*) as total_runs, count(*) filter (where passed) as passed_runs, count(*) filter (where not passed) as failed_runs, {rate} as success_rate from {r} where created_at >= timestamp '2024-01-23 12:00:00' group by source_id")
    for g, unit in (("hourly", "hour"), ("daily", "day"), ("weekly", "week")):
        register(f"runs_trend_{g}", lambda s, d, g=g: runs.history_trend(rs(s, d), NOW, 30, g),
                 f"select source_id, strftime(date_trunc('{unit}', created_at), '%Y-%m-%d %H:%M') as period, count(*) as run_count, count(*) filter (where passed) as passed_count, count(*) filter (where not passed) as failed_count, {rate} as success_rate "
                 f"from {r} where created_at >= timestamp '2023-12-31 12:00:00' group by 1, 2")
    issues = "select event_type as issue_type, case when value > 90 then null else concat('u', cast(user_id as string)) end as col, cast(floor(value) as bigint) as n from {events}"
    register("runs_failure_frequency", lambda s, d: runs.failure_frequency(source(s, d, issues).select(F.col("col").alias("column"), "issue_type", F.col("n").alias("count"))),
             f"select coalesce(col, 'unknown') || '.' || issue_type as issue, sum(n)::bigint as count from ({duck(issues)}) x group by 1 order by 2 desc, 1 limit 10")
    register("runs_recent", lambda s, d: runs.recent_runs(rs(s, d)).select("run_id", "status"), f"select run_id, status from {r} order by created_at desc, run_id desc limit 10")
    register("runs_page", lambda s, d: runs.page(rs(s, d), [F.desc("created_at"), F.desc("run_id")], 40, 20).select("run_id"), f"select run_id from {r} order by created_at desc, run_id desc limit 20 offset 40")
    register("fleet_health", lambda s, d: runs.source_health(source(s, d, SOURCES), rs(s, d)),
             f"select count(*) as total, count(*) filter (where is_active) as active, count(*) filter (where st = 'success') as healthy, count(*) filter (where st in ('failed', 'error')) as unhealthy, "
             f"count(*) filter (where owner_id is null and team_id is null and domain_id is null) as unowned from ({duck(SOURCES)}) s left join (select source_id, arg_max(status, row(created_at, run_id)) st from {r} group by 1) l on s.source_id = l.source_id")
    queues = "select distinct event_type as queue_id from {events} union all select r_name from {region}"
    register("fleet_backlog", lambda s, d: runs.backlog(source(s, d, queues), inc(s, d)),
             f"select q.queue_id, count(i.incident_id) as count from ({duck(queues)}) q left join (select * from {i} where state <> 'resolved') i on i.queue_id = q.queue_id group by 1")
    register("fleet_workload", lambda s, d: runs.workload(inc(s, d)), f"select coalesce(assignee_id::varchar, 'unassigned') as assignee, count(*) as count from {i} where state <> 'resolved' group by 1")
    register("fleet_sources_by_owner", lambda s, d: runs.sources_by(source(s, d, SOURCES), "owner_id"), f"select owner_id as id, count(*) as count from ({duck(SOURCES)}) s where owner_id is not null group by 1")
    arts = "select event_id as artifact_id, user_id as source_id, ts as created_at, event_type as artifact_type, case when value > 70 then 'failed' else 'ready' end as status, cast(floor(value * 100) as bigint) as file_size, event_id % 5 as downloads, case when event_id % 3 = 0 then null else ts + interval 5 days end as expires_at from {events}"
    register("fleet_artifact_freshness", lambda s, d: runs.artifact_freshness(source(s, d, arts), source(s, d, SOURCES), NOW),
             f"select owner_id, count(*) filter (where created_at >= timestamp '2024-01-29 12:00:00') as fresh_24h, count(*) filter (where created_at < timestamp '2024-01-23 12:00:00') as stale from ({duck(arts)}) a left join ({duck(SOURCES)}) s on a.source_id = s.source_id group by 1")
    register("artifact_statistics", lambda s, d: runs.artifact_statistics(source(s, d, arts)),
             f"select artifact_type, status, count(*) as artifacts, sum(file_size)::bigint as total_bytes, sum(downloads)::bigint as downloads from ({duck(arts)}) a group by 1, 2")
    register("artifact_expired", lambda s, d: runs.expired_artifacts(source(s, d, arts), NOW).select("artifact_id"), f"select artifact_id from ({duck(arts)}) a where expires_at < timestamp '{NOW}'")
    register("incident_search", lambda s, d: runs.find_incidents(inc(s, d), queue="error", status="open", text="USER 1").select("incident_id", "severity"),
             f"select incident_id, severity from {i} where queue_id = 'error' and status = 'open' and (lower(title) like '%user 1%' or lower(message) like '%user 1%' or lower(source_name) like '%user 1%' or lower(queue_name) like '%user 1%')")
    day = "created_at >= timestamp '2024-01-29 12:00:00'"
    register("incident_counts", lambda s, d: runs.incident_counts(inc(s, d), NOW), " union all ".join(
        f"select '{n}' as dimension, {c} as value, count(*) as count from {i} where {day} group by {c}" for n, c in (("severity", "severity"), ("source", "source_name"), ("status", "status"))))
    register("incident_trend", lambda s, d: runs.incident_trend(inc(s, d), NOW),
             f"select h as hour, count(incident_id) as count from (select unnest(generate_series(timestamp '2024-01-29 12:00:00', timestamp '{NOW}', interval 1 hour)) h) t left join {i} on date_trunc('hour', created_at) = h group by 1")
    register("incident_top_sources", lambda s, d: runs.top_sources(inc(s, d), NOW), f"select source_name, count(*) as count from {i} where {day} group by 1 order by 2 desc, 1 limit 5")
    near = "b.created_at between a.created_at - interval 1 hour and a.created_at + interval 1 hour and a.incident_id <> b.incident_id"
    pick = "select incident_id, related_id, '{0}' as correlation_type, {1}::double as score from (select a.incident_id, b.incident_id as related_id, row_number() over (partition by a.incident_id order by b.created_at desc, b.incident_id desc) r from i a join i b on {2} and " + near + ") x where r <= 10"
    register("incident_correlations", lambda s, d: runs.correlations(inc(s, d)),
             f"with i as ({duck(INCIDENTS)}) " + pick.format("same_queue", 0.9, "a.queue_id = b.queue_id") + " union all " + pick.format("same_source", 0.7, "a.source_name = b.source_name and (a.queue_id is null or b.queue_id is null or a.queue_id <> b.queue_id)"))
    log = "select event_id, ts as created_at, user_id % 6 as channel_id, case when event_type = 'error' then 'failed' else 'sent' end as status from {events}"
    register("notification_stats", lambda s, d: runs.notification_stats(source(s, d, log), NOW, 48),
             f"select channel_id, status, count(*) as count from ({duck(log)}) l where created_at >= timestamp '2024-01-28 12:00:00' group by 1, 2")
    register("notification_success", lambda s, d: runs.notification_success(source(s, d, log), NOW, 48),
             f"select count(*) as total, round(count(*) filter (where status = 'sent') * 100.0 / count(*), 2)::double as success_rate from ({duck(log)}) l where created_at >= timestamp '2024-01-28 12:00:00'")
    register("escalation_stats", lambda s, d: runs.escalation_stats(inc(s, d)),
             f"select count(*) as total, count(*) filter (where state <> 'resolved') as active, round(avg(epoch_us(resolved_at) - epoch_us(created_at)) filter (where state = 'resolved') / 1e6, 3) as avg_resolution_seconds from {i}")
    register("escalation_by_state", lambda s, d: runs.escalations_by_state(inc(s, d)), f"select state, count(*) as count from {i} group by 1")
    register("dedup_config_stats", lambda s, d: runs.config_stats(source(s, d, "select c_mktsegment as strategy, c_nationkey as policy, c_acctbal > 0 as is_active from {customer}"), ["strategy", "policy"]),
             "select c_mktsegment as strategy, c_nationkey as policy, count(*) as configs, count(*) filter (where c_acctbal > 0) as active from customer group by 1, 2")
    audits = "select event_id, ts, event_type, case when event_type = 'error' then 'failure' else 'success' end as status, user_id as item_id, value as duration_ms from {events}"
    register("audit_events", lambda s, d: runs.find_audits(source(s, d, audits), status="failure", start="2024-01-05", offset=10, limit=25).select("event_id", "item_id"),
             f"select event_id, item_id from ({duck(audits)}) a where status = 'failure' and ts >= timestamp '2024-01-05' order by ts desc, event_id desc limit 25 offset 10")
    register("audit_stats", lambda s, d: runs.audit_stats(source(s, d, audits), NOW),
             f"select count(*) as total_events, count(*) filter (where ts::date = date '2024-01-30') as events_today, count(*) filter (where ts >= timestamp '2024-01-23 12:00:00') as events_this_week, "
             f"round(count(*) filter (where status = 'failure') * 1.0 / count(*), 6)::double as error_rate, round(avg(duration_ms) filter (where duration_ms <> 0), 6) as avg_duration_ms from ({duck(audits)}) a")
    register("audit_counts", lambda s, d: runs.audit_counts(source(s, d, audits)),
             f"select 'type' as kind, event_type as value, count(*) as count from ({duck(audits)}) a group by 2 union all select 'status', status, count(*) from ({duck(audits)}) a group by 2")
    moves = "select o_orderkey, o_orderpriority as policy, case when o_orderstatus = 'F' then 'completed' when o_orderstatus = 'P' then 'failed' else 'pending' end as status, cast(floor(o_totalprice) as bigint) as size_bytes from {orders}"
    register("tier_stats", lambda s, d: runs.tier_stats(source(s, d, moves)),
             f"select count(*) as migrations, count(*) filter (where status = 'completed') as completed, count(*) filter (where status = 'failed') as failed, coalesce(sum(size_bytes) filter (where status = 'completed'), 0)::bigint as bytes_moved from ({duck(moves)}) m")
    register("tier_policies", lambda s, d: runs.policies_per_tier(source(s, d, "select n_nationkey as tier from {nation}"), source(s, d, "select c_nationkey as from_tier from {customer}")),
             "select n_nationkey as tier, count(c_custkey) as policies from nation left join customer on c_nationkey = n_nationkey group by 1")


EVENTS = ("select event_id, ts, event_type, case when value > 80 then 'critical' when value > 50 then 'high' when value > 20 then 'medium' when value > 5 then 'low' else 'strange' end as severity, "
          "cast(floor(value) as int) as issue_count, value / 100 as pass_rate, concat('Sales.', event_type, '_', cast(user_id as string)) as asset, user_id, value, props, "
          "case when event_type = 'error' then 'Failed' else 'ok' end as status, case when event_type = 'error' then concat('Timeout in job ', cast(user_id as string)) else null end as error from {events}")


def routing_queries() -> None:
    def events(s: SparkSession, d: str) -> DataFrame:
        return source(s, d, EVENTS).withColumns({"tags": F.array(F.col("event_type"), F.concat(F.lit("u"), (F.col("user_id") % 5).cast("string"))),
                                                 "metadata": F.create_map(F.lit("value"), F.col("value").cast("string"), F.lit("type"), F.col("event_type"))})
    rules = {
        "severity": (lambda: routing.severity_at_least("high"), "severity in ('high', 'critical')"),
        "issues": (lambda: routing.issues_at_least(60), "issue_count >= 60"),
        "pass_rate": (lambda: routing.pass_rate_at_most(0.1), "pass_rate <= 0.1"),
        "office": (lambda: routing.in_hours(), "isodow(ts) <= 5 and hour(ts) >= 9 and hour(ts) < 17"),
        "night": (lambda: routing.in_hours(22, 6, (5, 6)), "isodow(ts) >= 6 and (hour(ts) >= 22 or hour(ts) < 6)"),
        "tag_any": (lambda: routing.has_tags(["error", "u3"]), "event_type = 'error' or user_id % 5 = 3"),
        "tag_all": (lambda: routing.has_tags(["error", "u3"], True), "event_type = 'error' and user_id % 5 = 3"),
        "asset": (lambda: routing.asset_like("sales.*_1?"), "regexp_matches(lower(asset), '^sales\\..*_1.$')"),
        "metadata": (lambda: routing.metadata_matches("value", "gt", 95), "value > 95"),
        "status": (lambda: routing.status_in(["FAILED"]), "status = 'Failed'"),
        "error": (lambda: routing.error_matches("timeout.*1$"), "error is not null and regexp_matches(lower(error), 'timeout.*1$')"),
        "always": (routing.always, "true"), "never": (routing.never, "false"),
        "expression": (lambda: routing.expression("issue_count > 50 AND event_type IN ('view', 'click')"), "issue_count > 50 and event_type in ('view', 'click')"),
        "all_of": (lambda: routing.all_of(routing.severity_at_least("medium"), routing.status_in(["failed"])), "severity in ('medium', 'high', 'critical') and status = 'Failed'"),
        "any_of": (lambda: routing.any_of(routing.issues_at_least(98), routing.pass_rate_at_most(0.01)), "issue_count >= 98 or pass_rate <= 0.01"),
        "not": (lambda: routing.negate(routing.severity_at_least("low")), "severity not in ('low', 'medium', 'high', 'critical')"),
    }
    register("routing_rules", lambda s, d: routing.route(events(s, d), {k: f() for k, (f, _) in rules.items()}).groupBy("route").agg(F.count(F.lit(1)).alias("events"), F.sum("event").alias("id_sum")),
             f"with e as ({duck(EVENTS)}) select * from (" + " union all ".join(f"select '{k}' as route, count(*) as events, sum(event_id)::bigint as id_sum from e where {q}" for k, (_, q) in rules.items()) + ") x where events > 0")
    ev = ("select event_id, case when event_type = 'error' then 'validation_failed' when event_type = 'view' then 'schema_changed' when event_type = 'click' then 'drift_detected' else 'test' end as event_type, "
          "cast(user_id as string) as source_id, value > 90 as has_critical, value > 60 as has_high, value > 50 as has_breaking from {events}")
    rl = ("select c_custkey as rule_id, case when c_custkey % 6 = 0 then 'validation_failed' when c_custkey % 6 = 1 then 'critical_issues' when c_custkey % 6 = 2 then 'high_issues' when c_custkey % 6 = 3 then 'breaking_schema_change' "
          "when c_custkey % 6 = 4 then 'drift_detected' else 'schema_changed' end as condition, cast(c_custkey % 150 as string) as only_source, c_acctbal > 8000 as is_active from {customer}")
    register("routing_match_rules", lambda s, d: routing.match_rules(source(s, d, ev), source(s, d, rl).withColumn("source_ids", F.array("only_source"))),
             f"select event_id, rule_id from ({duck(ev)}) e join ({duck(rl)}) r on r.only_source = e.source_id and r.is_active and ((e.event_type = 'validation_failed' and (condition = 'validation_failed' or (condition = 'critical_issues' and has_critical) "
             "or (condition = 'high_issues' and (has_critical or has_high)))) or (e.event_type = 'schema_changed' and (condition = 'schema_changed' or (condition = 'breaking_schema_change' and has_breaking))) or (e.event_type = 'drift_detected' and condition = 'drift_detected'))")
    for policy, parts in (("basic", "'act:' || event_type || '|cp:' || user_id"), ("severity", "'act:' || event_type || '|cp:' || user_id || '|sev:' || severity"),
                          ("issue_based", "'act:' || event_type || '|cp:' || user_id || '|ish:' || left(sha256(props), 16)"),
                          ("strict", "'act:' || event_type || '|cp:' || user_id || '|sev:' || severity || '|ts:' || floor(epoch(ts) / 300)::bigint"), ("none", None)):
        body = "event_id::varchar" if parts is None else parts
        register(f"fingerprint_{policy}", lambda s, d, policy=policy: source(s, d, EVENTS).select("event_id", routing.policy_fingerprint(
            policy, F.col("user_id"), F.col("event_type"), F.col("severity"), F.col("props"), F.col("ts").cast("timestamp"), event=F.col("event_id")).alias("fingerprint")),
            f"select event_id, left(sha256({body}), 32) as fingerprint from ({duck(EVENTS)}) e")


def retention_queries() -> None:
    r = f"({duck(RUNS)}) r"
    rs = lambda s, d: source(s, d, RUNS)
    register("retention_age", lambda s, d: retention.older_than(rs(s, d), NOW, 20).select("run_id"), f"select run_id from {r} where created_at < timestamp '2024-01-10 12:00:00'")
    register("retention_status", lambda s, d: retention.older_by_status(rs(s, d), NOW, 10, 20).select("run_id"),
             f"select run_id from {r} where created_at < case when status = 'failed' then timestamp '2024-01-10 12:00:00' else timestamp '2024-01-20 12:00:00' end")
    register("retention_per_source", lambda s, d: retention.surplus_per_source(rs(s, d), 5).select("run_id"),
             f"select run_id from (select run_id, row_number() over (partition by source_id order by created_at desc, run_id desc) n from {r}) x where n > 5")
    register("retention_size", lambda s, d: retention.oldest_over_limit(rs(s, d), 40_000_000).select("run_id"),
             f"select run_id from (select run_id, size_bytes, sum(size_bytes) over (order by created_at, run_id) c, sum(size_bytes) over () t from {r}) x where t > 40000000 and c - size_bytes < t - 32000000")
    items = ("select o_orderkey as item_id, case when o_orderstatus = 'O' then 'hot' when o_orderstatus = 'F' then 'warm' else 'cold' end as tier, o_orderdate as created_at, "
             "case when o_orderkey % 3 = 0 then null else o_orderdate + interval 100 days end as last_accessed, o_custkey % 50 as access_count, cast(floor(o_totalprice) as bigint) as size_bytes from {orders}")
    now = "2001-09-01 10:00:00"
    register("tier_migration_plan", lambda s, d: retention.migration_plan(source(s, d, items), [
        ("old", "hot", "warm", retention.age_policy(now, 1500)),
        ("idle_or_big", "hot", "cold", retention.composite([retention.access_policy(now, 600), retention.size_policy(min_size_kb=300)], False)),
        ("busy", "cold", "hot", retention.access_policy(now, min_access_count=40)),
        ("saturday", "warm", "cold", retention.scheduled_policy(now, [5], 10, 1000)),
        ("custom", "warm", "hot", retention.composite([retention.custom_policy("access_count > 45"), retention.size_policy(1000)]))]),
        f"select item_id, split_part(m, ':', 1) as policy, tier as from_tier, split_part(m, ':', 2) as to_tier, size_bytes from (select *, case when tier = 'hot' and created_at <= timestamp '{now}' - interval 1500 days then 'old:warm' "
        f"when tier = 'hot' and (coalesce(last_accessed <= timestamp '{now}' - interval 600 days, false) or size_bytes >= 307200) then 'idle_or_big:cold' when tier = 'cold' and access_count >= 40 then 'busy:hot' "
        f"when tier = 'warm' and created_at <= timestamp '{now}' - interval 1000 days then 'saturday:cold' when tier = 'warm' and access_count > 45 and size_bytes >= 1000 then 'custom:hot' end as m from ({duck(items)}) i) x where m is not null")


for part in (privacy_queries, sampling_queries, sketch_queries, anomaly_queries, schema_queries, lineage_queries, run_queries, routing_queries, retention_queries):
    part()
