"""Schema snapshots, differences, renames and version history as rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Other names of a type, and the order of widening.
ALIASES = {"int": "int64", "integer": "int64", "bigint": "int64", "smallint": "int16", "tinyint": "int8", "float": "float64",
           "double": "float64", "real": "float32", "str": "string", "text": "string", "varchar": "string", "char": "string",
           "bool": "boolean", "timestamp": "datetime", "timestamptz": "datetime", "timestamp_ntz": "datetime"}
WIDENINGS = {"int8": ("int16", "int32", "int64", "float32", "float64", "string"),
             "int16": ("int32", "int64", "float32", "float64", "string"),
             "int32": ("int64", "float64", "string"), "int64": ("string",), "float32": ("float64", "string"),
             "float64": ("string",), "boolean": ("string",), "date": ("string",), "datetime": ("string",)}


def snapshot(df: DataFrame, unique: DataFrame | None = None) -> DataFrame:
    """(column, dtype, nullable, uniq) of a table; ``unique`` (column, uniq)
    adds measured uniqueness."""
    rows = [(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema.fields]
    out = df.sparkSession.createDataFrame(rows, "column string, dtype string, nullable boolean")
    if unique is None:
        return out.withColumn("uniq", F.lit(False))
    return out.join(unique, "column", "left").withColumn("uniq", F.coalesce("uniq", F.lit(False)))


def learned_snapshot(df: DataFrame) -> DataFrame:
    """Snapshot whose nullable and unique flags are measured on the rows."""
    from plumbline.operators.profile import learn
    return learn(df).select("column", "dtype", "nullable", F.col("unique").alias("uniq"))


def schema_hash(versions: DataFrame) -> DataFrame:
    """(version, schema_hash): SHA-256 over type and nullability by name."""
    entry = F.concat_ws(":", "column", "dtype", F.col("nullable").cast("string"))
    return versions.groupBy("version").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(entry)), "|"), 256).alias("schema_hash"))


def new_versions(known: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming versions whose hash differs from every known one."""
    return schema_hash(incoming).join(schema_hash(known).select("schema_hash"), "schema_hash", "left_anti").select("version", "schema_hash")


def normal(dtype: Column) -> Column:
    table = F.create_map(*[x for k, v in ALIASES.items() for x in (F.lit(k), F.lit(v))])
    plain = F.lower(F.trim(dtype))
    return F.coalesce(F.try_element_at(table, plain), plain, F.lit("unknown"))


def widens(old: Column, new: Column) -> Column:
    """The change keeps every value (equal after normalising, or wider)."""
    a, b = normal(old), normal(new)
    ok = a == b
    for k, wider in WIDENINGS.items():
        ok = ok | ((a == k) & b.isin(list(wider)))
    return ok


def diff(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(column, change_type, old_value, new_value, severity) between two
    snapshots; ``keys`` are further columns both sides are matched on."""
    on = [*keys, "column"]
    both = (old.select(*on, F.col("dtype").alias("t0"), F.col("nullable").alias("n0"), F.col("uniq").alias("u0"), F.lit(True).alias("had"))
            .join(new.select(*on, F.col("dtype").alias("t1"), F.col("nullable").alias("n1"), F.col("uniq").alias("u1"), F.lit(True).alias("has")),
                  on, "full_outer"))
    kept = F.col("had") & F.col("has")

    def change(kind: str, a: Column, b: Column, severity: Column) -> Column:
        return F.struct(F.lit(kind).alias("change_type"), a.cast("string").alias("old_value"), b.cast("string").alias("new_value"),
                        severity.alias("severity"))

    none = F.lit(None).cast("string")
    changes = F.array_compact(F.array(
        F.when(F.col("had").isNull(), change("column_added", none, F.col("t1"), F.when(F.col("n1"), "non_breaking").otherwise("warning"))),
        F.when(F.col("has").isNull(), change("column_removed", F.col("t0"), none, F.lit("breaking"))),
        F.when(kept & (F.col("t0") != F.col("t1")), change("type_changed", F.col("t0"), F.col("t1"),
               F.when(widens(F.col("t0"), F.col("t1")), "non_breaking").otherwise("breaking"))),
        F.when(kept & (F.col("n0") != F.col("n1")), change("nullable_changed", F.col("n0"), F.col("n1"),
               F.when(F.col("n0"), "breaking").otherwise("non_breaking"))),
        F.when(kept & (F.col("u0") != F.col("u1")), change(
            "constraint_changed", F.concat(F.lit("unique="), F.col("u0").cast("string")), F.concat(F.lit("unique="), F.col("u1").cast("string")),
            F.when(F.col("u1"), "warning").otherwise("non_breaking")))))
    return both.select(*on, F.explode(changes).alias("c")).select(*on, "c.*")


def version_changes(versions: DataFrame) -> DataFrame:
    """Changes from each version to the next one there is; numbers may have gaps."""
    order = versions.select("version").distinct()  # one row per version
    steps = order.withColumn("next", F.lead("version").over(Window.orderBy("version"))).filter("next is not null")
    earlier = versions.join(steps, "version").withColumn("version", F.col("next")).drop("next")
    later = versions.join(steps.select(F.col("next").alias("version")), "version", "left_semi")
    return diff(earlier, later, ("version",))


def breaking_since(versions: DataFrame, version: int) -> DataFrame:
    return version_changes(versions).filter((F.col("version") > version) & (F.col("severity") == "breaking"))


def summary(versions: DataFrame) -> DataFrame:
    """One row: current version, versions, changes, breaking changes."""
    changes = version_changes(versions).agg(F.count(F.lit(1)).alias("total_changes"), F.count_if(F.col("severity") == "breaking").alias("breaking_changes"))
    return changes.select(
        versions.agg(F.max("version")).scalar().alias("current_version"),
        versions.agg(F.count_distinct("version")).scalar().alias("total_versions"), "total_changes", "breaking_changes")


def next_semantic_version(major: int, minor: int, patch: int, severities: list[str]) -> tuple[int, int, int]:
    """Breaking changes raise the major, all other changes the minor number; without a change the patch number rises."""
    if "breaking" in severities:
        return major + 1, 0, 0
    return (major, minor + 1, 0) if "warning" in severities or "non_breaking" in severities else (major, minor, patch + 1)


# -- renames ----------------------------------------------------------------
def levenshtein_similarity(a: Column, b: Column) -> Column:
    return F.lit(1.0) - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def grams(c: Column, n: int = 2) -> Column:
    text = F.lower(c)
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def ngram_similarity(a: Column, b: Column) -> Column:
    return overlap(grams(a), grams(b))


def tokens(c: Column) -> Column:
    """Words of snake_case and camelCase names."""
    return F.filter(F.split(F.lower(F.regexp_replace(c, r"([a-z0-9])([A-Z])", r"$1_$2")), r"[_\-\s]+"), lambda t: t != "")


def token_similarity(a: Column, b: Column) -> Column:
    return overlap(tokens(a), tokens(b))


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    used, hits = [False] * len(b), []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == ch:
                used[j] = True
                hits.append(ch)
                break
    if not hits:
        return 0.0
    other = [ch for ch, u in zip(b, used) if u]
    m, t = len(hits), sum(x != y for x, y in zip(hits, other)) // 2
    jaro = (m / len(a) + m / len(b) + (m - t) / m) / 3
    if jaro <= 0.7:
        return jaro
    prefix = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4])) if x != y), min(4, len(a), len(b)))
    return jaro + prefix * 0.1 * (1 - jaro)


@F.pandas_udf(T.DoubleType())
def jaro_winkler_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([jaro_winkler(x.lower(), y.lower()) for x, y in zip(a, b)])


def similarity(a: Column, b: Column, algorithm: str = "composite") -> Column:
    one = {"levenshtein": levenshtein_similarity, "ngram": ngram_similarity, "token": token_similarity, "jaro_winkler": jaro_winkler_similarity}
    if algorithm != "composite":
        return one[algorithm](a, b)
    return levenshtein_similarity(a, b) * 0.4 + ngram_similarity(a, b) * 0.3 + token_similarity(a, b) * 0.3


def renames(removed: DataFrame, added: DataFrame, threshold: float = 0.8, require_type_match: bool = True,
            allow_compatible_types: bool = True, algorithm: str = "composite") -> DataFrame:
    """(old_name, new_name, similarity, confirmed): best new name per removed
    column. Pairs are formed inside equal or compatible types only; the lists
    hold column names, not rows."""
    left = removed.select(F.col("column").alias("old_name"), F.col("dtype").alias("old_type"), normal(F.col("dtype")).alias("cls"))
    right = added.select(F.col("column").alias("new_name"), F.col("dtype").alias("new_type"), normal(F.col("dtype")).alias("cls"))
    if not require_type_match:
        pairs = left.withColumn("cls", F.lit("any")).join(right.withColumn("cls", F.lit("any")), "cls")
    elif allow_compatible_types:
        wider = left.select("old_name", "old_type", F.explode(F.array_union(F.array("cls"), reachable(F.col("cls")))).alias("cls"))
        pairs = wider.join(right, "cls")
    else:
        pairs = left.join(right, "cls")
    w = Window.partitionBy("old_name").orderBy(F.desc("similarity"), "new_name")
    return (pairs.withColumn("similarity", similarity(F.col("old_name"), F.col("new_name"), algorithm))
            .withColumn("r", F.row_number().over(w)).filter(F.col("r") == 1)
            .select("old_name", "new_name", F.round("similarity", 6).alias("similarity"), (F.col("similarity") >= threshold).alias("confirmed")))


def reachable(cls: Column) -> Column:
    out = F.array().cast("array<string>")
    for k, wider in WIDENINGS.items():
        out = F.when(cls == k, F.array(*[F.lit(w) for w in wider])).otherwise(out)
    return out
