"""Column and table profiles, schema learning, profile comparison.

Scalars come from aggregates over a few columns each, values from one typed
count per column; no column is collected into a single task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import patterns as P
from plumbline.operators.checks.table import period_number, row_bytes
from plumbline.operators.stats import trend_stats
from plumbline.plans.primitives import exact_quantiles, row_numbers, spread, value_counts
from plumbline.session import checkpointed

TOP = 10
BUCKETS = 10
COLUMNS_PER_AGG = 3
MIN_PATTERN_SHARE = 0.8
PATTERNS = {"email": P.EMAIL, "url": P.URL, "uuid": P.UUID, "ipv4": P.IPV4, "phone": P.PHONE["any"],
            "credit_card": P.CARD, "ssn": P.SSN, "date": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$",
            "integer": r"^[+\-]?[0-9]+$", "decimal": r"^[+\-]?[0-9]+\.[0-9]+$", "json": r"^\s*[{\[].*[}\]]\s*$"}


def split_kinds(df: DataFrame, columns: Sequence[str] | None) -> tuple[list[str], list[str], list[str], list[str]]:
    """(all scalar columns, numeric, text, time)."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    cols = [c for c in (columns or kinds) if isinstance(kinds[c], T.AtomicType)]
    return (cols, [c for c in cols if isinstance(kinds[c], T.NumericType)],
            [c for c in cols if isinstance(kinds[c], T.StringType)],
            [c for c in cols if isinstance(kinds[c], (T.DateType, T.TimestampType, T.TimestampNTZType))])


def scalars(df: DataFrame, columns: Sequence[str] | None = None, include_patterns: bool = True) -> DataFrame:
    """One row per column: counts, moments, lengths, dates, patterns.

    Columns are aggregated a few at a time, each part reading its own columns:
    one aggregate over all of them would not compile to fast code.
    """
    cols = split_kinds(df, columns)[0]
    parts = [_scalars(df, cols[i:i + COLUMNS_PER_AGG], include_patterns) for i in range(0, len(cols), COLUMNS_PER_AGG)]
    return reduce(lambda a, b: a.unionByName(b), parts)


def _scalars(df: DataFrame, columns: Sequence[str], include_patterns: bool) -> DataFrame:
    cols, numbers, texts, times = split_kinds(df, columns)
    if texts and include_patterns:
        df = spread(df.select(*cols))
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    aggs: list[Column] = [F.count(F.lit(1)).alias("rows")]
    out = []
    none = {t: F.lit(None).cast(t) for t in ("long", "double", "string")}

    def ref(c: str, name: str, expr: Column) -> Column:
        aggs.append(expr.alias(f"{name}|{c}"))
        return F.col(f"`{name}|{c}`")

    for c in cols:
        v = F.col(c)
        text, number, time = c in texts, c in numbers, c in times
        filled = ref(c, "n", F.count(v))
        found = F.array().cast("array<struct<pattern:string,match_ratio:double>>")
        if text and include_patterns:
            hits = [F.struct(F.lit(k).alias("pattern"), F.round(ref(c, f"p_{k}", F.count_if(v.rlike(p))) / filled, 6)
                             .alias("match_ratio")) for k, p in PATTERNS.items()]
            found = F.filter(F.array(*hits), lambda h: h["match_ratio"] >= MIN_PATTERN_SHARE)
        fields = {
            "column": F.lit(c), "dtype": F.lit(kinds[c]), "row_count": F.col("rows"),
            "null_count": F.col("rows") - filled,
            "null_ratio": F.round(F.when(F.col("rows") > 0, (F.col("rows") - filled) / F.col("rows")).otherwise(0.0), 6),
            "empty_string_count": ref(c, "empty", F.count_if(v == "")) if text else F.lit(0).cast("long"),
            "min_value": ref(c, "min", F.min(v)).cast("double") if number else none["double"],
            "max_value": ref(c, "max", F.max(v)).cast("double") if number else none["double"],
            "mean": F.round(ref(c, "avg", F.avg(v)), 6) if number else none["double"],
            "std": F.round(ref(c, "sd", F.stddev_samp(v)), 6) if number else none["double"],
            "skewness": F.round(ref(c, "skew", F.skewness(v)), 6) if number else none["double"],
            "kurtosis": F.round(ref(c, "kurt", F.kurtosis(v)), 6) if number else none["double"],
            "min_length": ref(c, "minl", F.min(F.length(v))).cast("long") if text else none["long"],
            "max_length": ref(c, "maxl", F.max(F.length(v))).cast("long") if text else none["long"],
            "avg_length": F.round(ref(c, "avgl", F.avg(F.length(v))), 6) if text else none["double"],
            "min_date": ref(c, "mind", F.min(v)).cast("string") if time else none["string"],
            "max_date": ref(c, "maxd", F.max(v)).cast("string") if time else none["string"],
            "patterns": found,
        }
        out.append(F.struct(*[e.alias(k) for k, e in fields.items()]))
    return df.agg(*aggs).select(F.explode(F.array(*out)).alias("r")).select("r.*")


def quartiles(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, q1, median, q3) of the numeric columns."""
    numbers = split_kinds(df, columns)[1]
    qs = exact_quantiles(df, [(F.col(c), q) for c in numbers for q in (0.25, 0.5, 0.75)])
    rows = [(c, *qs[3 * i:3 * i + 3]) for i, c in enumerate(numbers)]
    return df.sparkSession.createDataFrame(rows, "column string, q1 double, median double, q3 double")


def value_table(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, value, n): counts of every value, as text; nulls left out.

    Each column is read and counted by itself in its own type, and only the
    distinct values are turned into text.
    """
    parts = [value_counts(df, {"v": F.col(c)}).filter(F.col("v").isNotNull())
             .select(F.lit(c).alias("column"), F.col("v").cast("string").alias("value"), "n") for c in split_kinds(df, columns)[0]]
    return reduce(lambda a, b: a.unionByName(b), parts)


def pattern_shares(counts: DataFrame) -> DataFrame:
    """(column, patterns) from value counts: a repeated value is matched once."""
    n = F.sum("n")
    hits = F.array(*[F.struct(F.lit(k).alias("pattern"), F.round(F.coalesce(F.sum(F.when(F.col("value").rlike(p), F.col("n"))), F.lit(0)) / n, 6)
                              .alias("match_ratio")) for k, p in PATTERNS.items()])
    return counts.groupBy("column").agg(F.filter(hits, lambda h: h["match_ratio"] >= MIN_PATTERN_SHARE).alias("patterns"))


def cardinality(df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = False,
                counts: DataFrame | None = None) -> DataFrame:
    """(column, distinct_count, unique_ratio, is_unique, is_constant)."""
    cols = split_kinds(df, columns)[0]
    if approximate:
        aggs = [a for c in cols for a in (F.approx_count_distinct(c, 0.02).alias(f"d|{c}"), F.count(c).alias(f"n|{c}"))]
        flat = df.agg(*aggs).select(F.explode(F.array(*[F.struct(
            F.lit(c).alias("column"), F.col(f"`d|{c}`").alias("distinct_count"), F.col(f"`n|{c}`").alias("filled")) for c in cols]))
            .alias("r")).select("r.*")
    else:
        counted = (value_table(df, cols) if counts is None else counts).groupBy("column").agg(F.count(F.lit(1)).alias("distinct_count"), F.sum("n").alias("filled"))
        every = df.sparkSession.createDataFrame([(c,) for c in cols], "column string")
        flat = every.join(counted, "column", "left").na.fill(0)
    d, n = F.col("distinct_count"), F.col("filled")
    return flat.select("column", "distinct_count", F.when(n > 0, F.round(d / n, 6)).otherwise(F.lit(0.0)).alias("unique_ratio"),
                       ((n > 0) & (d == n)).alias("is_unique"), (d <= 1).alias("is_constant"))


def ranked_values(df: DataFrame, columns: Sequence[str] | None = None, n: int = TOP, least: bool = False,
                  counts: DataFrame | None = None) -> DataFrame:
    """(column, rank, value, count): most (or least) frequent values, ties by
    value. The rank limit is applied before the shuffle, so a wide column
    does not land in one task."""
    order = [F.col("n") if least else F.desc("n"), F.col("value")]
    w = Window.partitionBy("column").orderBy(*order)
    source = value_table(df, columns) if counts is None else counts
    return (source.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
            .select("column", "rank", "value", F.col("n").alias("count")))


def histogram(df: DataFrame, columns: Sequence[str] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """(column, bucket, low, high, count, percentage) of equal-width buckets
    of the numeric columns, by conditional counts."""
    numbers = split_kinds(df, columns)[1]
    ends = df.agg(*[a for c in numbers for a in (F.min(c).cast("double"), F.max(c).cast("double"), F.count(c))]).first()
    parts = []
    for i, c in enumerate(numbers):
        lo, hi, n = ends[3 * i:3 * i + 3]
        if not n:
            continue
        width = (hi - lo) / buckets or 1.0
        at = F.least(F.floor((F.col(c).cast("double") - lo) / width), F.lit(buckets - 1))
        count = buckets if hi > lo else 1
        row = df.agg(*[F.count_if(at == b).alias(f"b{b}") for b in range(count)])
        parts.append(row.select(F.explode(F.array(*[F.struct(
            F.lit(c).alias("column"), F.lit(b).alias("bucket"), F.round(F.lit(lo + b * width), 6).alias("low"),
            F.round(F.lit(lo + (b + 1) * width), 6).alias("high"), F.col(f"b{b}").alias("count"),
            F.round(F.col(f"b{b}") * 100.0 / n, 6).alias("percentage")) for b in range(count)])).alias("r")).select("r.*"))
    if not parts:
        return df.sparkSession.createDataFrame([], "column string, bucket int, low double, high double, count long, percentage double")
    return reduce(lambda a, b: a.unionByName(b), parts)


def date_gaps(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, date_gaps): calendar days missing between first and last."""
    times = split_kinds(df, columns)[3]
    parts = [df.select(period_number(F.col(c).cast("timestamp"), "daily").alias("d")).dropna().distinct()
             .agg(F.coalesce(F.max("d") - F.min("d") + 1 - F.count(F.lit(1)), F.lit(0)).alias("date_gaps"))
             .select(F.lit(c).alias("column"), "date_gaps") for c in times]
    if not parts:
        return df.sparkSession.createDataFrame([], "column string, date_gaps long")
    return reduce(lambda a, b: a.unionByName(b), parts)


def profile(df: DataFrame, columns: Sequence[str] | None = None, top_n: int = TOP, include_patterns: bool = True,
            include_distributions: bool = True, approximate: bool = False) -> DataFrame:
    """The full column profile: one row per column, nested lists inside.

    The value counts, which four of its parts need, are written once.
    """
    counts = None if approximate else checkpointed(value_table(df, columns))
    texts = split_kinds(df, columns)[2]
    out = scalars(df, columns, include_patterns and approximate)
    if include_patterns and not approximate and texts:
        shares = pattern_shares(counts.filter(F.col("column").isin(texts)))
        out = out.drop("patterns").join(shares, "column", "left")
    parts = [cardinality(df, columns, approximate, counts), quartiles(df, columns), date_gaps(df, columns)]
    for name, least in (("top_values", False), ("bottom_values", True)):
        parts.append(ranked_values(df, columns, top_n, least, counts).groupBy("column").agg(F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "value", "count"))),
            lambda s: F.struct(s["value"].alias("value"), s["count"].alias("count"))).alias(name)))
    if include_distributions and split_kinds(df, columns)[1]:
        parts.append(histogram(df, columns).groupBy("column").agg(
            F.array_sort(F.collect_list(F.struct("bucket", "low", "high", "count", "percentage"))).alias("histogram")))
    for part in parts:
        out = out.join(part, "column", "left")
    return out.withColumn("inferred_type", F.coalesce(F.get("patterns", F.lit(0))["pattern"], F.col("dtype")))


def table_profile(df: DataFrame) -> DataFrame:
    """One row: rows, columns, estimated bytes, duplicate rows and ratio."""
    plain = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    groups = df.withColumn("__bytes", row_bytes(df)).groupBy(*plain).agg(
        F.count(F.lit(1)).alias("__n"), F.sum("__bytes").alias("__b"))
    n = F.coalesce(F.sum("__n"), F.lit(0))
    return groups.agg(
        n.alias("row_count"), F.lit(len(df.columns)).alias("column_count"),
        F.coalesce(F.sum("__b"), F.lit(0)).alias("estimated_bytes"), F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("duplicate_rows"),
        F.round(F.coalesce(F.sum(F.col("__n") - 1) / F.sum("__n"), F.lit(0.0)), 6).alias("duplicate_ratio"))


def correlations(df: DataFrame, columns: Sequence[str] | None = None, threshold: float = 0.7) -> DataFrame:
    """(column_a, column_b, correlation) of numeric pairs at or above the
    threshold in size; all pairs in one aggregate."""
    pairs = list(combinations(split_kinds(df, columns)[1], 2))
    rows = df.agg(*[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    out = F.array(*[F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.round(f"r{i}", 6).alias("correlation"))
                    for i, (a, b) in enumerate(pairs)])
    return rows.select(F.explode(out).alias("r")).select("r.*").filter(F.abs("correlation") >= threshold)


def learn(df: DataFrame, columns: Sequence[str] | None = None, max_allowed: int = 20) -> DataFrame:
    """Schema learned from data: type, nullable, unique, range, and the
    allowed values of columns with at most ``max_allowed`` distinct ones."""
    base = scalars(df, columns, False).select("column", "dtype", "null_count", "min_value", "max_value")
    counts = checkpointed(value_table(df, columns))
    w = Window.partitionBy("column").orderBy("value")
    # One value more than allowed tells that a column has too many.
    few = (counts.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= max_allowed + 1).groupBy("column")
           .agg(F.count(F.lit(1)).alias("seen"), F.array_sort(F.collect_list("value")).alias("vals")))
    return (base.join(cardinality(df, columns, counts=counts), "column").join(few, "column", "left")
            .select("column", "dtype", (F.col("null_count") > 0).alias("nullable"), F.col("is_unique").alias("unique"),
                    "min_value", "max_value", "distinct_count",
                    F.when(F.col("seen") <= max_allowed, F.col("vals")).alias("allowed_values")))


METRICS = ("null_pct", "unique_pct", "distinct_count", "mean", "std", "min", "max")


def metric_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, metric, value) of the comparable profile metrics."""
    p = scalars(df, columns, False).join(cardinality(df, columns), "column")
    values = {"null_pct": F.col("null_ratio") * 100, "unique_pct": F.col("unique_ratio") * 100,
              "distinct_count": F.col("distinct_count").cast("double"), "mean": F.col("mean"), "std": F.col("std"),
              "min": F.col("min_value"), "max": F.col("max_value")}
    return p.select("column", F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("value"))
                                                  for k, v in values.items()])).alias("m")).select("column", "m.metric", "m.value")


def compare_metrics(baseline: DataFrame, current: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Change of each (column, metric). Percent metrics are judged by points,
    the others by relative change; both against ``threshold`` * 100."""
    b, c = F.col("baseline"), F.col("current")
    change = c - b
    relative = F.when(b != 0, change / b * 100)
    judged = F.when(F.col("metric").isin("null_pct", "unique_pct"), change).otherwise(relative)
    limit = threshold * 100
    return (baseline.withColumnRenamed("value", "baseline").join(current.withColumnRenamed("value", "current"), ["column", "metric"])
            .filter(b.isNotNull() & c.isNotNull())
            .select("column", "metric", F.round(b, 6).alias("baseline"), F.round(c, 6).alias("current"),
                    F.round(change, 6).alias("change"), F.round(relative, 6).alias("change_pct"),
                    F.coalesce(F.abs(judged) >= limit, F.lit(False)).alias("is_significant"),
                    F.when(F.abs(F.coalesce(judged, F.lit(0.0))) < limit, "stable").when(judged > 0, "up").otherwise("down").alias("trend")))


def compare_profiles(base: DataFrame, cur: DataFrame, columns: Sequence[str] | None = None, threshold: float = 0.1) -> DataFrame:
    return compare_metrics(metric_rows(base, columns), metric_rows(cur, columns), threshold)


def data_change(baseline: DataFrame, current: DataFrame, threshold: float = 0.05) -> DataFrame:
    """(metric, baseline, current, change, triggered) for metric rows
    (metric, value); a change from zero counts as 1."""
    b, c = F.col("baseline"), F.col("current")
    change = F.when(b == 0, F.when(c != 0, 1.0).otherwise(0.0)).otherwise(F.abs(c - b) / F.abs(b))
    return (baseline.withColumnRenamed("value", "baseline").join(current.withColumnRenamed("value", "current"), "metric")
            .select("metric", "baseline", "current", F.round(change, 6).alias("change"), (change >= threshold).alias("triggered")))


def table_metrics(df: DataFrame) -> DataFrame:
    """(metric, value): row_count, mean null percentage and distinct count."""
    per = metric_rows(df)
    means = per.filter(F.col("metric").isin("null_pct", "distinct_count")).groupBy("metric").agg(F.avg("value").alias("value"))
    rows = df.agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("row_count").alias("metric"), "value")
    return rows.unionByName(means.select(F.when(F.col("metric") == "null_pct", "null_percentage").otherwise(F.col("metric")).alias("metric"), "value"))


def trend_of_profiles(profiles: DataFrame) -> DataFrame:
    """Per profile (profile_id, ts): mean null and unique percentage. Input
    rows: profile_id, ts, column, row_count, null_pct, unique_pct."""
    return profiles.groupBy("profile_id", "ts").agg(
        F.max("row_count").alias("row_count"), F.count(F.lit(1)).alias("column_count"),
        F.round(F.avg("null_pct"), 2).alias("avg_null_pct"), F.round(F.avg("unique_pct"), 2).alias("avg_unique_pct"))


def column_trends(profiles: DataFrame) -> DataFrame:
    """Per column: first, last, least, greatest and mean null percentage, and
    its direction (a point or more)."""
    key = F.struct("ts", "profile_id")
    out = profiles.groupBy("column").agg(
        F.min_by("null_pct", key).alias("first"), F.max_by("null_pct", key).alias("last"), F.min("null_pct").alias("min_value"),
        F.max("null_pct").alias("max_value"), F.avg("null_pct").alias("avg_value"), F.count(F.lit(1)).alias("n")).filter("n >= 2")
    change = F.col("last") - F.col("first")
    return out.select("column", F.round("first", 6).alias("first"), F.round("last", 6).alias("last"),
                      F.round("min_value", 6).alias("min_value"), F.round("max_value", 6).alias("max_value"),
                      F.round("avg_value", 6).alias("avg_value"),
                      F.round(F.when(F.col("first") != 0, change / F.col("first") * 100).otherwise(0.0), 2).alias("change_pct"),
                      F.when(F.abs(change) < 1.0, "stable").when(change > 0, "up").otherwise("down").alias("trend"))


def row_count_trend(profiles: DataFrame, alpha: float = 0.05) -> DataFrame:
    """One row: direction of the row count from the first to the last profile
    (5 percent or more), slope per profile and its significance."""
    per = trend_of_profiles(profiles).select("profile_id", "ts", "row_count")
    order = F.struct("ts", "profile_id")
    ends = per.agg(F.count(F.lit(1)).alias("profiles"), F.min_by("row_count", order).alias("first"), F.max_by("row_count", order).alias("last"))
    fit = trend_stats(row_numbers(per, ["ts", "profile_id"], "i"), F.col("i"), F.col("row_count")).select("slope", "p")
    change = (F.col("last") - F.col("first")) / F.col("first") * 100
    return ends.select(
        "profiles", F.round(F.when(F.col("first") > 0, change), 6).alias("change_pct"),
        F.when((F.col("first") <= 0) | (F.abs(change) < 5.0), "stable").when(change > 0, "up").otherwise("down").alias("trend"),
        F.round(fit.select("slope").scalar(), 6).alias("slope"), F.coalesce(fit.select("p").scalar() < alpha, F.lit(False)).alias("is_significant"))


def parse_percent(text: Column) -> Column:
    """Number of a text like ``25.5%``; 0 when empty or unreadable."""
    return F.coalesce(F.replace(text, F.lit("%"), F.lit("")).try_cast("double"), F.lit(0.0))
