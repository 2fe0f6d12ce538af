"""Rules suggested from profiles and column names, and suites of them.

Single-column rules are a projection of the profile. Cross-column rules start
from name patterns and are then verified on the data in one check run.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators import profile as prof
from plumbline.plans.planner import run, unexpected_rows
from plumbline.plans.registry import CheckConfig, find

# Thresholds per strictness.
STRICTNESS = {
    "loose": {"min_confidence": 0.3, "null_threshold": 10.0, "unique_threshold": 90.0, "range_buffer": 0.2,
              "distinct_buffer": 10, "z": 4.0, "rare_null_mostly": 0.98},
    "medium": {"min_confidence": 0.5, "null_threshold": 5.0, "unique_threshold": 95.0, "range_buffer": 0.1,
               "distinct_buffer": 5, "z": 3.0, "rare_null_mostly": 0.98},
    "strict": {"min_confidence": 0.7, "null_threshold": 1.0, "unique_threshold": 99.0, "range_buffer": 0.0,
               "distinct_buffer": 5, "z": 2.5, "rare_null_mostly": 0.99},
}
# Strictness and categories of each preset.
PRESETS = {
    "default": ("medium", ("schema", "completeness", "uniqueness", "statistics")),
    "strict": ("strict", ("schema", "completeness", "uniqueness", "statistics", "pattern")),
    "loose": ("loose", ("schema", "completeness")),
    "minimal": ("medium", ("schema", "completeness")),
    "comprehensive": ("medium", ("schema", "completeness", "uniqueness", "statistics", "pattern", "distribution")),
    "ci_cd": ("strict", ("schema", "completeness", "uniqueness")),
    "schema_only": ("medium", ("schema",)),
    "format_only": ("medium", ("pattern",)),
    "cross_column": ("medium", ("relationship", "multi_column", "uniqueness")),
    "data_integrity": ("strict", ("schema", "completeness", "uniqueness", "relationship", "multi_column")),
}
# Name hints of formats.
NAME_HINTS = {"Email": (("email", "e_mail", "mail"), 0.85, "medium"), "Phone": (("phone", "tel", "mobile", "cell"), 0.75, "low"),
              "Url": (("url", "link", "website", "href"), 0.8, "low")}
POSITIVE_HINTS = ("id", "count", "quantity", "amount", "price", "age")


def pattern_confidence(match_rate: Column, sample_size: Column, min_sample: int = 100, base: float = 0.5) -> Column:
    """Base + 0.4 of the match rate + 0.1 of the sample's share of full size."""
    full = F.least(F.lit(1.0), sample_size / float(min_sample))
    return F.when(sample_size == 0, F.lit(base)).otherwise(F.least(F.lit(1.0), match_rate * 0.4 + full * 0.1 + base))


def uniqueness_confidence(ratio: Column, rows: Column) -> Column:
    base = F.when(ratio >= 0.99, 0.85).when(ratio >= 0.95, 0.75).when(ratio >= 0.8, 0.65).otherwise(0.5)
    return F.when(rows == 0, F.lit(0.5)).otherwise(F.least(F.lit(1.0), base + F.least(F.lit(0.1), rows / 100000.0)))


def correlation_confidence(strength: str, columns: int = 2) -> float:
    return max(0.5, {"strong": 0.85, "medium": 0.7, "weak": 0.55}.get(strength, 0.6) - max(0, (columns - 2) * 0.05))


def rule(check: str, category: str, confidence: float, severity: str, params: Column | None = None) -> Column:
    """Rule struct; ``params`` is the JSON text of the extra parameters."""
    return F.struct(F.lit(check).alias("check"), F.lit(category).alias("category"), F.lit(float(confidence)).alias("confidence"),
                    F.lit(severity).alias("severity"), (params if params is not None else F.lit("{}")).alias("params"))


def suggest(profile_rows: DataFrame, strictness: str = "medium") -> DataFrame:
    """(column, check, category, confidence, severity, params) from profile
    rows: column, dtype, null_ratio, unique_ratio, distinct_count, min_value,
    max_value, mean, std."""
    s = STRICTNESS[strictness]
    null_pct, unique_pct = F.col("null_ratio") * 100, F.col("unique_ratio") * 100
    name = F.lower("column")
    number = F.col("dtype").isin("tinyint", "smallint", "int", "bigint", "float", "double") | F.col("dtype").startswith("decimal")
    lo, hi = F.col("min_value"), F.col("max_value")
    slack = (hi - lo) * s["range_buffer"]
    mostly = F.to_json(F.struct(F.round(F.lit(0.99) - F.col("null_ratio"), 2).alias("mostly")))
    optional = [
        F.when(null_pct == 0, rule("NotNull", "completeness", 0.95, "high")),
        F.when((null_pct > 0) & (null_pct < 1), rule("Null", "completeness", 0.85, "medium", F.lit(json.dumps({"mostly": s["rare_null_mostly"]})))),
        F.when((null_pct >= 1) & (null_pct < s["null_threshold"]), rule("Null", "completeness", 0.7, "low", mostly)),
        F.when(unique_pct >= 99.9, rule("Unique", "uniqueness", 0.95, "high")),
        F.when((unique_pct >= s["unique_threshold"]) & (unique_pct < 99.9), rule(
            "Unique", "uniqueness", 0.8, "medium", F.to_json(F.struct(F.round("unique_ratio", 2).alias("mostly"))))),
        F.when((unique_pct < 10) & (unique_pct < s["unique_threshold"]) & F.col("distinct_count").between(1, 49), rule(
            "DistinctCount", "distribution", 0.75, "low", F.to_json(F.struct((F.col("distinct_count") + s["distinct_buffer"]).alias("max_count"))))),
        F.when(number & (hi > lo), rule("Range", "statistics", 0.7, "medium", F.to_json(F.struct(
            F.round(lo - slack, 2).alias("min_value"), F.round(hi + slack, 2).alias("max_value"))))),
        F.when(F.col("dtype").startswith("timestamp") | (F.col("dtype") == "date"), rule("DatetimeParseable", "schema", 0.9, "medium")),
        F.when(number & (lo >= 0) & name.rlike(f"({'|'.join(POSITIVE_HINTS)})$"), rule("NonNegative", "statistics", 0.75, "low")),
        F.when(number & (F.col("std") > 0), rule("ZScoreOutlier", "statistics", 0.6, "low", F.lit(json.dumps({"threshold": s["z"]})))),
    ]
    text = F.col("dtype") == "string"
    for check, (hints, confidence, severity) in NAME_HINTS.items():
        optional.append(F.when(text & name.rlike("|".join(hints)), rule(check, "pattern", confidence, severity)))
    return (profile_rows.select("column", F.explode(F.array_compact(F.array(*optional))).alias("r")).select("column", "r.*")
            .filter(F.col("confidence") >= s["min_confidence"]))


def profile_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return prof.scalars(df, columns, False).join(prof.cardinality(df, columns), "column")


# Hint lists of cross-column rules.
# (check, hints that must match different columns, parameters, confidence)
ORDERED = (("start", "end"), ("created", "updated"), ("birth_date", "death_date"), ("hire_date", "termination_date"),
           ("order_date", "ship_date"), ("min_", "max_"), ("low", "high"), ("floor", "ceiling"), ("cost", "price"))
CHAINS = (("created", "updated", "deleted"), ("start_date", "mid_date", "end_date"), ("ordered", "shipped", "delivered"),
          ("submitted", "approved", "completed"), ("min", "avg", "max"), ("low", "mid", "high"), ("bronze", "silver", "gold"),
          ("small", "medium", "large"), ("floor_price", "price", "ceiling_price"), ("cost", "price", "msrp"))
SUMS = ((("subtotal", "tax", "shipping"), "total"), (("subtotal", "tax"), "total"), (("principal", "interest"), "total_amount"),
        (("base_salary", "bonus"), "total_compensation"))
PRODUCTS = ((("quantity", "unit_price"), "total"), (("quantity", "price"), "amount"), (("hours", "rate"), "cost"),
            (("length", "width"), "area"), (("principal", "rate"), "interest"))
DIFFERENCES = (("gross", "deductions", "net"), ("revenue", "cost", "profit"), ("end_value", "start_value", "change"),
               ("current", "previous", "delta"))
RATIOS = (("profit", "revenue"), ("tax", "subtotal"), ("discount", "price"), ("part", "total"), ("completed", "total"))
PERCENTAGES = (("discount", "subtotal"), ("tax", "subtotal"), ("commission", "sales"), ("profit", "revenue"))
CORRELATED = ((("price", "cost"), 0.7, 1.0), (("quantity", "total"), 0.5, 1.0), (("quantity", "price"), 0.1, 1.0),
              (("height", "weight"), 0.3, 1.0), (("income", "expenditure"), 0.4, 1.0), (("age", "experience"), 0.5, 1.0),
              (("views", "clicks"), 0.6, 1.0), (("revenue", "profit"), 0.6, 1.0), (("discount", "price"), -1.0, -0.3),
              (("errors", "quality"), -1.0, -0.5))
TOGETHER = (("latitude", "longitude"), ("lat", "lon"), ("first_name", "last_name"), ("street", "city", "zip"),
            ("card_number", "card_expiry"))
EXCLUSIVE = (("phone_home", "phone_work", "phone_mobile"), ("payment_card", "payment_bank", "payment_crypto"))
DEPENDENT = (("country", "currency"), ("zip", "city"), ("product_id", "product_name"))
IMPLIED = (("status", "active", "email"), ("status", "active", "phone"), ("is_premium", "true", "subscription_tier"))
KEY_HINTS = ("id", "key", "code", "num", "ref")
# Percent of different values of a part of a composite key, and how many values a category has.
KEY_SHARE, FEW_VALUES = (50, 99.9), (2, 100)


def matched(hints: Sequence[str], columns: Sequence[str]) -> list[str]:
    """The first unused column for each hint; empty when one is missing."""
    found: list[str] = []
    for h in hints:
        hit = next((c for c in columns if h in c.lower() and c not in found), None)
        if hit is None:
            return []
        found.append(hit)
    return found


def distinct_sketches(df: DataFrame, groups: Sequence[Sequence[str]]) -> tuple[int, list[int]]:
    """Number of rows, and about how many different values each group of columns has: one scan, one sketch a group."""
    sketch = [F.approx_count_distinct(F.struct(*[F.col(f"`{c}`") for c in g]) if len(g) > 1 else F.col(f"`{g[0]}`"), 0.02).alias(f"d{i}") for i, g in enumerate(groups)]
    row = df.agg(F.count(F.lit(1)).alias("n"), *sketch).first()
    return row["n"], [row[f"d{i}"] for i in range(len(groups))]


def composite_keys(df: DataFrame) -> list[tuple[str, str, float, str]]:
    """(column, column, confidence, pattern) of pairs that may be a key: columns named like keys that are mostly but not
    wholly unique, with each other, and the first of them with columns of a few values."""
    plain = [f.name for f in df.schema.fields if isinstance(f.dataType, T.AtomicType)]
    if not any(h in c.lower() for c in plain for h in KEY_HINTS):
        return []
    n, distinct = distinct_sketches(df, [[c] for c in plain])
    ids, few = [], []
    for c, d in zip(plain, distinct, strict=True):
        hinted = any(h in c.lower() for h in KEY_HINTS)
        if hinted and any(abs(d / max(n, 1) - share / 100) < 0.1 for share in KEY_SHARE):
            d = df.select(c).distinct().filter(F.col(c).isNotNull()).count()  # too near a bound for a sketch
        if KEY_SHARE[0] <= 100 * d / max(n, 1) < KEY_SHARE[1] and hinted:
            ids.append(c)
        elif FEW_VALUES[0] < d < FEW_VALUES[1]:
            few.append(c)
    pairs = [(a, b, 0.75, "id_column_combination") for i, a in enumerate(ids) for b in ids[i + 1:i + 3]]
    pairs += [(a, b, 0.65, "id_categorical_combination") for a in ids[:2] for b in few[:3]]
    return pairs


def dependencies(df: DataFrame, columns: Sequence[str] | None = None, most: float = 0.5, tolerance: float = 0.1) -> DataFrame:
    """(determinant, dependent, distinct_determinant, distinct_pair, holds): pairs where a value of the first column seems to fix
    that of the second, found by sketches of single columns and pairs (two scans in all), then decided by exact counts of the
    candidates alone. Determinants that are nearly unique (over ``most`` of the rows) fix everything and are left out."""
    names = list(columns or [f.name for f in df.schema.fields if isinstance(f.dataType, T.AtomicType)])
    n, distinct = distinct_sketches(df, [[c] for c in names])
    size = dict(zip(names, distinct, strict=True))
    tried = [(a, b) for a in names for b in names if a != b and 1 < size[b] <= size[a] * (1 + tolerance) and size[a] <= most * n]
    schema = "determinant string, dependent string, distinct_determinant long, distinct_pair long, holds boolean"
    if not tried:
        return df.sparkSession.createDataFrame([], schema)
    both = distinct_sketches(df, [list(p) for p in tried])[1]
    hopeful = [p for p, d in zip(tried, both, strict=True) if d <= size[p[0]] * (1 + tolerance)]
    if not hopeful:
        return df.sparkSession.createDataFrame([], schema)
    exact = None
    for a, b in hopeful:
        counts = df.select(F.col(f"`{a}`").alias("a"), F.col(f"`{b}`").alias("b")).groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high"), F.count_distinct("b").alias("k"))
        row = counts.agg(F.lit(a).alias("determinant"), F.lit(b).alias("dependent"), F.count(F.lit(1)).alias("distinct_determinant"),
                         F.sum(F.greatest("k", F.lit(1))).cast("long").alias("distinct_pair"), F.coalesce(F.bool_and(F.col("k") <= 1), F.lit(True)).alias("holds"))
        exact = row if exact is None else exact.unionByName(row)
    return exact


def cross_candidates(df: DataFrame) -> list[tuple[CheckConfig, float, str]]:
    """Cross-column rules whose names fit: (config, confidence, pattern)."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    cols = list(kinds)
    numbers = [c for c in cols if isinstance(kinds[c], T.NumericType)]
    out: list[tuple[CheckConfig, float, str]] = []

    def add(check: str, params: dict, confidence: float, pattern: str) -> None:
        out.append((CheckConfig(check, params), confidence, pattern))

    for a, b in filter(None, (matched(p, cols) for p in ORDERED)):
        if kinds[a] == kinds[b]:
            add("ColumnComparison", {"column_a": b, "column_b": a, "operator": "gte"}, 0.8, "comparison")
    for chain in filter(None, (matched(p, cols) for p in CHAINS)):
        if len({str(kinds[c]) for c in chain}) == 1:
            add("ColumnChainComparison", {"columns": chain, "operator": "lte"}, 0.75, "chain")
    for parts, total in SUMS:
        hit = matched([*parts, total], numbers)
        if hit:
            add("ColumnSum", {"columns": hit[:-1], "target_column": hit[-1], "tolerance": 0.01}, 0.75, "sum")
    for parts, total in PRODUCTS:
        hit = matched([*parts, total], numbers)
        if hit:
            add("ColumnProduct", {"columns": hit[:-1], "target_column": hit[-1], "tolerance": 0.01}, 0.75, "product")
    for hit in filter(None, (matched(p, numbers) for p in DIFFERENCES)):
        add("MultiColumnCalculation", {"expression": f"`{hit[0]}` - `{hit[1]}` - `{hit[2]}`", "tolerance": 0.01}, 0.75, "difference")
    for hit in filter(None, (matched(p, numbers) for p in RATIOS)):
        add("ColumnRatio", {"numerator_column": hit[0], "denominator_column": hit[1], "min_ratio": 0.0, "max_ratio": 1.0}, 0.7, "ratio")
    for hit in filter(None, (matched(p, numbers) for p in PERCENTAGES)):
        add("ColumnPercentage", {"numerator_column": hit[0], "denominator_column": hit[1], "min_percentage": 0.0, "max_percentage": 100.0}, 0.7, "percentage")
    for hints, lo, hi in CORRELATED:
        hit = matched(hints, numbers)
        if hit:
            add("ColumnCorrelation", {"column_a": hit[0], "column_b": hit[1], "min_correlation": lo, "max_correlation": hi}, 0.65, "correlation")
    stems: dict[str, list[str]] = {}
    for c in numbers:
        stems.setdefault(re.sub(r"[_\-]?(v?\d+|old|new|prev|next)$", "", c.lower()), []).append(c)
    for group in stems.values():
        for a, b in zip(group, group[1:]):
            add("ColumnCorrelation", {"column_a": a, "column_b": b, "min_correlation": 0.5, "max_correlation": 1.0}, 0.7, "versioned")
    for hit in filter(None, (matched(p, cols) for p in TOGETHER)):
        add("ColumnCoexistence", {"columns": hit}, 0.7, "coexistence")
    for hit in filter(None, (matched(p, cols) for p in EXCLUSIVE)):
        add("MutualExclusivity", {"columns": hit}, 0.6, "exclusivity")
    for hit in filter(None, (matched(p, cols) for p in DEPENDENT)):
        add("ColumnDependency", {"determinant_column": hit[0], "dependent_column": hit[1]}, 0.7, "dependency")
    for when, value, then in IMPLIED:
        hit = matched([when, then], cols)
        if hit:
            add("Conditional", {"when_column": hit[0], "when_value": value, "then_column": hit[1], "then_operator": "not_null"}, 0.7, "implication")
    for a, b, confidence, pattern in composite_keys(df):
        add("MultiColumnUnique", {"columns": [a, b]}, confidence, pattern)
    seen: set[tuple[str, str]] = set()
    kept = []
    for config, confidence, pattern in out:
        mark = (config.name, json.dumps(config.params, sort_keys=True))
        if mark not in seen:
            seen.add(mark)
            kept.append((config, confidence, pattern))
    return kept


def suggest_cross(df: DataFrame, verify: bool = True) -> DataFrame:
    """Cross-column rules with their outcome on the data; a rule the data
    contradicts is reported with ``holds`` false."""
    candidates = cross_candidates(df)
    schema = "check string, expected string, pattern string, confidence double"
    if not candidates:
        return df.sparkSession.createDataFrame([], schema + ", holds boolean, unexpected_count long, total_count long")
    rows = [(c.name, json.dumps(c.params, default=str, sort_keys=True), pattern, conf) for c, conf, pattern in candidates]
    out = df.sparkSession.createDataFrame(rows, schema)
    if not verify:
        return out
    result = run(df, [c for c, _, _ in candidates]).select(
        "check", "expected", (F.col("status") == "pass").alias("holds"), "unexpected_count", "total_count")
    return out.join(result, ["check", "expected"])


def select_rules(rules: DataFrame, preset: str | None = None, include: Sequence[str] | None = None,
                 exclude: Sequence[str] | None = None, min_confidence: float | None = None) -> DataFrame:
    """Filter by preset, categories and confidence; one rule per check and
    column (the most confident), best first."""
    cond = F.lit(True)
    if preset:
        cond = cond & F.col("category").isin(list(PRESETS[preset][1]))
    if include:
        cond = cond & F.col("category").isin(list(include))
    if exclude:
        cond = cond & ~F.col("category").isin(list(exclude))
    if min_confidence is not None:
        cond = cond & (F.col("confidence") >= min_confidence)
    best = rules.filter(cond).groupBy("column", "check").agg(F.max_by(
        F.struct("category", "confidence", "severity", "params"), F.struct("confidence", "params")).alias("r"))
    return best.select("column", "check", "r.*").orderBy(F.desc("confidence"), "column", "check")


def generate_suite(df: DataFrame, preset: str = "default", columns: Sequence[str] | None = None,
                   exclude: Sequence[str] | None = None) -> DataFrame:
    """Rules for a table under a preset."""
    return select_rules(suggest(profile_rows(df, columns), PRESETS[preset][0]), preset, exclude=exclude)


def suite_configs(rules: DataFrame) -> list[CheckConfig]:
    """Check requests of a suite (a handful of rows per column)."""
    out = []
    for r in rules.collect():
        params = json.loads(r["params"])
        target = "columns" if r["check"] == "Null" else "column"
        out.append(CheckConfig(r["check"], {target: [r["column"]] if target == "columns" else r["column"], **params}, True, r["severity"]))
    return out


def sample_violations(df: DataFrame, config: CheckConfig, limit: int = 5) -> DataFrame:
    return unexpected_rows(df, config, limit=limit)


def export_rules(rules: DataFrame, fmt: str) -> str:
    """Suite as JSON, YAML, TOML or Python text."""
    items = [{"check": c.name, "severity": c.severity or find(c.name).severity, "params": c.params} for c in suite_configs(rules)]
    quote = lambda v: json.dumps(v, default=str)
    if fmt == "json":
        return json.dumps({"rules": items}, indent=2, default=str)
    if fmt == "yaml":
        lines = ["rules:"]
        for i in items:
            lines += [f"  - check: {i['check']}", f"    severity: {i['severity']}", "    params:"]
            lines += [f"      {k}: {quote(v)}" for k, v in i["params"].items()]
        return "\n".join(lines) + "\n"
    if fmt == "toml":
        lines = []
        for i in items:
            lines += ["[[rules]]", f"check = {quote(i['check'])}", f"severity = {quote(i['severity'])}", "[rules.params]"]
            lines += [f"{k} = {quote(v)}" for k, v in i["params"].items()] + [""]
        return "\n".join(lines)
    if fmt == "python":
        lines = ["from plumbline.plans.registry import CheckConfig", "", "RULES = ["]
        lines += [f"    CheckConfig({i['check']!r}, {i['params']!r}, severity={i['severity']!r})," for i in items]
        return "\n".join([*lines, "]", ""])
    raise ValueError(f"unknown format {fmt!r}")
