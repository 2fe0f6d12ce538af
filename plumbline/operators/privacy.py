"""Personal-data scan, regulation violations and masking."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import patterns as P
from plumbline.plans.primitives import spread


def text_columns(df: DataFrame, columns: Sequence[str] | None = None) -> list[str]:
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return [c for c in (columns or kinds) if isinstance(kinds[c], T.StringType)]


def redacted(found: Column) -> Column:
    """First two characters of a finding, the rest starred."""
    return F.concat(F.left(found, F.lit(2)), F.repeat(F.lit("*"), F.greatest(F.length(found) - 2, F.lit(0))))


def scan(df: DataFrame, columns: Sequence[str] | None = None, types: Sequence[str] | None = None,
         min_confidence: float = 0.0) -> DataFrame:
    """One row per (column, type) found: rows hit, filled rows, confidence
    (share of the filled rows) and up to two redacted samples.

    Whole texts of all rows are read; a pattern counts rows, it does not
    multiply them.
    """
    cols, kinds = text_columns(df, columns), list(types or P.PII)
    parts = []
    for c in cols:
        # The first match is looked for once per pattern; all else is derived from it.
        found = spread(df.select(c)).select(F.col(c).isNotNull().alias("filled"), *[
            F.regexp_extract(c, P.PII[k], 0).alias(k) for k in kinds])
        aggs = [F.count_if("filled").alias("n")]
        for k in kinds:
            sample = F.when(F.col(k) != "", redacted(F.col(k)))
            # Least and greatest sample: two examples in constant space.
            aggs += [F.count_if(F.col(k) != "").alias(f"h_{k}"), F.min(sample).alias(f"a_{k}"), F.max(sample).alias(f"z_{k}")]
        out = [F.struct(F.lit(c).alias("column"), F.lit(k).alias("pii_type"), F.col(f"h_{k}").alias("count"), F.col("n").alias("total"),
                        F.when(F.col("n") > 0, F.round(F.col(f"h_{k}") / F.col("n"), 6)).otherwise(F.lit(0.0)).alias("confidence"),
                        F.array_distinct(F.array_compact(F.array(f"a_{k}", f"z_{k}"))).alias("samples")) for k in kinds]
        parts.append(found.agg(*aggs).select(F.explode(F.array(*out)).alias("f")).select("f.*"))
    schema = "column string, pii_type string, count long, total long, confidence double, samples array<string>"
    if not cols:
        return df.sparkSession.createDataFrame([], schema)
    return reduce(lambda a, b: a.unionByName(b), parts).filter((F.col("count") > 0) & (F.col("confidence") >= min_confidence))


def violations(findings: DataFrame, regulations: Sequence[str] = ("gdpr", "ccpa", "lgpd")) -> DataFrame:
    """Findings that count as personal data under each regulation."""
    rules = [(r, k) for r in regulations for k in P.REGULATIONS[r]]
    severity = F.when(F.col("pii_type").isin("ssn", "credit_card", "passport"), "critical").when(
        F.col("pii_type").isin("email", "phone", "address", "date_of_birth", "driver_license"), "high").otherwise("medium")
    table = F.array(*[F.struct(F.lit(r).alias("regulation"), F.lit(k).alias("kind")) for r, k in rules])
    return (findings.select("*", F.explode(F.filter(table, lambda x: x["kind"] == F.col("pii_type"))).alias("r"))
            .select(F.col("r.regulation").alias("regulation"), "column", "pii_type", "count", severity.alias("severity")))


# Dictionary for pseudonyms.
FIRST = ("Alex", "Blake", "Casey", "Drew", "Ellis", "Finley", "Gray", "Harper", "Indigo", "Jules", "Kai", "Lane",
         "Morgan", "Nico", "Oakley", "Parker", "Quinn", "Reese", "Sage", "Taylor")
LAST = ("Adler", "Brook", "Clay", "Dale", "East", "Field", "Glen", "Hill", "Isle", "Jarvis", "Knoll", "Lake",
        "Marsh", "North", "Orchard", "Pine", "Quarry", "Ridge", "Stone", "Vale")


def pseudonym(c: Column, seed: int = 42) -> Column:
    """Name picked by a hash of the value: equal values stay equal, so joins
    on a masked column still work."""
    h = F.xxhash64(c, F.lit(seed))
    first, last = (F.array(*[F.lit(x) for x in words]) for words in (FIRST, LAST))
    number = F.lpad(F.pmod(F.shiftright(h, 16), F.lit(1_000_000)).cast("string"), 6, "0")
    return F.concat_ws(" ", F.get(first, F.pmod(h, F.lit(len(FIRST))).cast("int")),
                       F.concat(F.get(last, F.pmod(F.shiftright(h, 8), F.lit(len(LAST))).cast("int")), number))


def masked(c: Column, strategy: str, seed: int = 42) -> Column:
    text = c.cast("string")
    if strategy == "redact":
        return F.regexp_replace(text, r"(?s).", "*")
    if strategy == "hash":
        return F.sha2(text, 256)
    if strategy == "fake":
        return F.when(c.isNotNull(), pseudonym(text, seed))
    raise ValueError(f"unknown masking strategy {strategy!r}")


def mask(df: DataFrame, columns: Sequence[str] | None = None, strategy: str = "redact", seed: int = 42) -> DataFrame:
    """Mask the named columns, or every column the scan finds data in."""
    if columns is None:
        # At most columns x types rows come back.
        columns = sorted({r["column"] for r in scan(df).select("column").distinct().collect()})
    return df.withColumns({c: masked(F.col(c), strategy, seed) for c in columns}) if columns else df


def k_anonymity(df: DataFrame, quasi: Sequence[str], sensitive: str | None = None) -> DataFrame:
    """Group sizes of the quasi-identifiers with distinct sensitive values.

    Counted per (group, sensitive value) first, so a hot group is split over
    its values before it meets in one row.
    """
    keys = [F.col(c) for c in quasi]
    if sensitive is None:
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("k"))
    inner = df.groupBy(*keys, F.col(sensitive).alias("__s")).agg(F.count(F.lit(1)).alias("n"))
    return inner.groupBy(*quasi).agg(F.sum("n").alias("k"), F.count("__s").alias("l"))
