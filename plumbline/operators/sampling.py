"""Repeatable samples and their sizes.

Rows are chosen by a hash of a key and a seed, so the same call gives the
same rows on any cluster. Whatever is sorted has been thinned to about the
sample's size first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.plans.primitives import row_numbers

SPACE = 2 ** 53
# Row limits of the scale classes, targets of the quality presets, z-scores, throughput and memory factors.
SCALES = (("small", 1_000_000), ("medium", 10_000_000), ("large", 100_000_000), ("xlarge", 1_000_000_000))
STRATEGY_OF = {"small": "none", "medium": "column_aware", "large": "block", "xlarge": "multi_stage", "xxlarge": "multi_stage"}
QUALITY_ROWS = {"sketch": 10_000, "quick": 50_000, "standard": 100_000, "high": 500_000, "exact": None}
Z = {0.80: 1.28, 0.85: 1.44, 0.90: 1.645, 0.95: 1.96, 0.99: 2.576}
TYPE_WEIGHT = {"numeric": 1.0, "string": 2.0, "categorical": 0.5, "complex": 3.0}


def unit(keys: Sequence[str], seed: int) -> Column:
    """Uniform number in [0, 1) from the key columns and a seed."""
    return F.pmod(F.xxhash64(*[F.col(k) for k in keys], F.lit(seed)), F.lit(SPACE)).cast("double") / float(SPACE)


def enough(n: float, total: int) -> float:
    """Share that keeps at least n of total rows but for a 1e-9 chance."""
    return 1.0 if total <= 0 else min(1.0, (n + 6.0 * math.sqrt(n) + 30.0) / total)


def random_sample(df: DataFrame, n: int, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """n rows (all, if there are fewer), the ones with the smallest hashes."""
    share = enough(n, df.count())
    picked = df.withColumn("__u", unit(keys, seed))
    if share < 1.0:
        picked = picked.filter(F.col("__u") < share)
    return picked.orderBy("__u", *keys).limit(n).drop("__u")


def head(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    return df.orderBy(*order).limit(n)


def tail(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)


def hash_sample(df: DataFrame, keys: Sequence[str], numerator: int, denominator: int, seed: int = 42) -> DataFrame:
    """Rows whose key hash falls in the first classes; a key is in or out as
    a whole, in every table sampled alike."""
    h = F.pmod(F.xxhash64(*[F.col(k) for k in keys], F.lit(seed)), F.lit(denominator))
    return df.filter(h < numerator)


def reservoir(df: DataFrame, n: int, keys: Sequence[str], weight: str | None = None, seed: int = 42, draw: Column | None = None, fan_in: int = 16) -> DataFrame:
    """n rows drawn without replacement, with chances in proportion to ``weight`` (alike without one).

    Every row has a priority -ln(u) / weight, u being a hash of its keys (or ``draw``, a number between 0 and 1). Each task keeps the n
    rows of least priority as they stream by; reservoirs are merged some at a time, level by level, so the table is neither sorted nor
    shuffled and no task holds more than a batch beside its n rows. Rows without a positive weight are never drawn; ties go by
    the keys.
    """
    u = unit(keys, seed) if draw is None else draw
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    priority = F.when((w > 0) & ~F.isnan(w), -F.log(F.greatest(u, F.lit(1e-300))) / w)
    rows = df.withColumn("__priority", priority).filter(F.col("__priority").isNotNull())
    order = [("__priority", "ascending"), *[(k, "ascending") for k in keys]]

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bound = None, None
        for batch in batches:
            if bound is not None:
                batch = batch.filter(pc.less_equal(batch.column("__priority"), bound))
            if batch.num_rows:
                held = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
                if held.num_rows > 2 * n:
                    held = held.take(pc.sort_indices(held, sort_keys=order)[:n]).combine_chunks()
                    bound = held.column("__priority")[n - 1]
        if held is not None:
            yield from held.take(pc.sort_indices(held, sort_keys=order)[:n]).combine_chunks().to_batches()

    if n <= 0:
        return df.limit(0)
    parts = rows.rdd.getNumPartitions()
    rows = rows.mapInArrow(keep, rows.schema)
    while parts > 1:
        parts = -(-parts // fan_in)
        rows = rows.repartition(parts).mapInArrow(keep, rows.schema)
    return rows.drop("__priority")


def systematic(df: DataFrame, step: int, order: Sequence[str], start: int = 0) -> DataFrame:
    """Every ``step``-th row of the order."""
    return row_numbers(df, order, "__i").filter(F.pmod(F.col("__i"), F.lit(step)) == start).drop("__i")


def stratified(df: DataFrame, n: int, stratum: str | None, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """About n rows, each stratum with floor(1.1 n/N of its size), trimmed to
    n; without the column a random sample."""
    total = df.count()
    if total <= n:
        return df
    if stratum is None or stratum not in df.columns:
        return random_sample(df, n, keys, seed)
    share = min(1.0, 1.1 * n / total)
    sizes = df.groupBy(F.col(stratum).alias("__g")).agg(F.count(F.lit(1)).alias("__size"))
    quota = F.floor(F.col("__size") * share)
    # Thin each stratum to a little more than its quota before ranking it.
    keep = F.least(F.lit(1.0), (quota + F.sqrt(quota) * 6.0 + 30.0) / F.col("__size"))
    w = Window.partitionBy("__g").orderBy("__u", *keys)
    picked = (df.withColumn("__u", unit(keys, seed)).join(sizes, F.col(stratum).eqNullSafe(F.col("__g")))
              .filter(F.col("__u") < keep).withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= quota))
    return picked.orderBy("__u", *keys).limit(n).drop("__u", "__g", "__size", "__r")


def block(df: DataFrame, target: int, order: Sequence[str], block_size: int = 0, per_block: int | None = None,
          seed: int = 42) -> DataFrame:
    """Equal draws from consecutive blocks of the order, trimmed to target."""
    total = df.count()
    size = block_size or max(total // 100, 10_000)
    blocks = max(math.ceil(total / size), 1)
    each = per_block or max(target // blocks, 1)
    indexed = row_numbers(df, order, "__i").withColumn("__b", F.floor(F.col("__i") / size)).withColumn("__u", unit(["__i"], seed))
    # Blocks are large; only a little more than ``each`` rows of one are ranked. The last may be short.
    last = enough(each, total - (blocks - 1) * size)
    thinned = indexed.filter(F.col("__u") < F.when(F.col("__b") == blocks - 1, last).otherwise(enough(each, size)))
    w = Window.partitionBy("__b").orderBy("__u", "__i")
    picked = thinned.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= each)
    return picked.orderBy("__u", "__i").limit(target).drop("__i", "__b", "__u", "__r")


def multi_stage(df: DataFrame, target: int, keys: Sequence[str], stages: int = 3, seed: int = 42) -> DataFrame:
    """Equal reductions stage by stage, each with its own seed, then a trim."""
    total = df.count()
    if total <= target:
        return df
    ratio = (total / target) ** (1.0 / stages)
    left, out = float(total), df
    for s in range(stages):
        if left <= target:
            break
        goal = max(left / ratio, target)
        out = out.filter(unit(keys, seed + s) < enough(goal, int(left)))
        left = goal + 6.0 * math.sqrt(goal) + 30.0
    return out.orderBy(unit(keys, seed + stages), *keys).limit(target)


def type_class(kind: T.DataType) -> str:
    if isinstance(kind, T.NumericType):
        return "numeric"
    if isinstance(kind, T.StringType):
        return "string"
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        return "complex"
    return "numeric" if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)) else "categorical"


def column_aware_size(df: DataFrame, target: int) -> int:
    weights = [TYPE_WEIGHT[type_class(f.dataType)] for f in df.schema.fields]
    return int(target * sum(weights) / max(len(weights), 1))


def column_aware(df: DataFrame, target: int, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """Random sample whose size grows with the complexity of the columns."""
    return random_sample(df, column_aware_size(df, target), keys, seed)


@dataclass
class Progress:
    sample: DataFrame
    stages: int
    converged: bool
    means: list[dict[str, float]]


def progressive(df: DataFrame, target: int, keys: Sequence[str], start_ratio: float = 0.01, growth: float = 2.0,
                tolerance: float = 0.01, max_stages: int = 5, seed: int = 42) -> Progress:
    """Grow nested samples until the means of all numeric columns settle. Each stage is one aggregate; the samples are nested by hash."""
    total = df.count()
    numbers = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    size, means, done = max(int(total * start_ratio), 1000), [], False
    for _ in range(max_stages):
        part = df.filter(unit(keys, seed) < min(1.0, size / max(total, 1)))
        row = part.agg(*[F.avg(c).alias(c) for c in numbers]).first() if numbers else {}
        means.append({c: float(row[c]) for c in numbers if row[c] is not None})
        if len(means) > 1:
            moves = [abs(v - means[-2][c]) / abs(means[-2][c]) for c, v in means[-1].items() if means[-2].get(c)]
            if max(moves, default=0.0) < tolerance:
                done = True
                break
        if size >= target:
            break
        size = min(int(size * growth), target)
    return Progress(random_sample(df, min(target, total), keys, seed), len(means), done, means)


def scale_of(rows: int) -> str:
    return next((name for name, limit in SCALES if rows < limit), "xxlarge")


def adaptive(df: DataFrame, target: int, keys: Sequence[str], order: Sequence[str] | None = None, seed: int = 42) -> DataFrame:
    """Strategy by table size: none, column-aware, block or multi-stage."""
    how = STRATEGY_OF[scale_of(df.count())]
    if how == "none":
        return df
    if how == "column_aware":
        return column_aware(df, target, keys, seed)
    return block(df, target, order or keys, seed=seed) if how == "block" else multi_stage(df, target, keys, seed=seed)


def needs_sampling(size_bytes: int, limit_mb: int = 100) -> bool:
    """The gate that switches sampling on."""
    return size_bytes > limit_mb * 1024 * 1024


def cochran(population: Column, confidence: float = 0.95, margin: float = 0.05, p: float = 0.5) -> Column:
    """Sample size with finite-population correction, at least 100."""
    n0 = Z.get(confidence, 1.96) ** 2 * p * (1 - p) / margin ** 2
    return F.greatest(F.ceil(F.lit(n0) / (F.lit(n0 - 1) / population + 1.0)), F.lit(100)).cast("long")


def size_plan(df: DataFrame, quality: str = "standard", confidence: float = 0.95, margin: float = 0.05) -> DataFrame:
    """One row: population, scale, recommended, least and greatest size."""
    n = F.col("population")
    scale = F.lit("xxlarge")
    for name, limit in reversed(SCALES):
        scale = F.when(n < limit, name).otherwise(scale)
    floor = QUALITY_ROWS[quality]
    size = cochran(n, confidence, margin)
    if floor is not None:
        size = F.greatest(size, F.lit(floor))
    strategy = F.create_map(*[x for k, v in STRATEGY_OF.items() for x in (F.lit(k), F.lit(v))])
    return (df.agg(F.count(F.lit(1)).alias("population")).withColumn("scale", scale).withColumn("recommended", size)
            .select("population", "scale", "recommended", F.greatest(F.floor(F.col("recommended") / 2), F.lit(100)).alias("min_size"),
                    F.least(F.col("recommended") * 10, n).alias("max_size"), F.get(F.array(strategy[F.col("scale")]), F.lit(0)).alias("strategy")))
