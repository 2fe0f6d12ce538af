"""Scale-safe building blocks shared by checks, drift and sampling.

None of them uses an unpartitioned window over table rows, and none sends
more than one row per partition (or per requested statistic) to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.numeric import finite
from plumbline.session import checkpointed

# Above this many rows an exact quantile is found by narrowing a bracket
# instead of by one `percentile` buffer.
PERCENTILE_BUFFER_ROWS = 100_000
SKETCH_ACCURACY = 2_000
QUANTILE_BINS = 4_096
# Generated code of a wider aggregate is too long for the JIT compiler and
# runs an order of magnitude slower. Splitting costs no extra reading: each
# part scans its own columns only.
AGGREGATE_WEIGHT = 56
BUFFERS = {"kurtosis": 5, "skewness": 4, "corr": 6, "covar": 4, "stddev": 3, "var_": 3, "regr": 4, "avg": 2, "percentile": 4}


def weight(agg: Column | str) -> int:
    """Buffer fields of an aggregate, roughly."""
    text = str(agg)
    return next((n for name, n in BUFFERS.items() if name in text), 1)


def split_aggregates(aggs: dict[str, Column]) -> list[dict[str, Column]]:
    """Groups of aggregates that compile well, in order."""
    parts: list[dict[str, Column]] = [{}]
    load = 0
    for name, agg in aggs.items():
        w = weight(agg)
        if load and load + w > AGGREGATE_WEIGHT:
            parts.append({})
            load = 0
        parts[-1][name] = agg
        load += w
    return parts


def agg_row(df: DataFrame, aggs: dict[str, Column]) -> dict[str, Any]:
    """Aggregates of a table as driver scalars."""
    out: dict[str, Any] = {}
    for part in split_aggregates(aggs):
        out.update(df.agg(*[c.alias(n) for n, c in part.items()]).first().asDict() if part else {})
    return out


def spread(df: DataFrame) -> DataFrame:
    """Share a table of few files out to all cores before work that costs
    much CPU per row; a table of many splits is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with columns that are computed once per row: filters stay above a generator, so what uses the columns reads their values
    where it would otherwise repeat long expressions."""
    row = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return df.select("*", row.alias("__once")).select(*df.columns, *[F.col("__once").getField(n).alias(n) for n in columns])


def value_counts(df: DataFrame, keys: dict[str, Column], n: str = "n") -> DataFrame:
    """Distinct key tuples with their row count (map-side combined, so a hot
    key reaches the shuffle as one row per task)."""
    return df.groupBy(*[c.alias(k) for k, c in keys.items()]).agg(F.count(F.lit(1)).alias(n))


def paired_counts(left: DataFrame, right: DataFrame, a: Column, b: Column) -> DataFrame:
    """(v, na, nb): how often each value occurs on either side, nulls dropped."""
    both = (left.select(a.alias("v"), F.lit(1).alias("ia"), F.lit(0).alias("ib"))
            .unionByName(right.select(b.alias("v"), F.lit(0).alias("ia"), F.lit(1).alias("ib"))))
    return (both.filter(F.col("v").isNotNull()).groupBy("v")
            .agg(F.sum("ia").alias("na"), F.sum("ib").alias("nb")))


def range_sorted(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """Rows spread over ordered partitions; ``__pid`` grows with the order."""
    return df.repartitionByRange(*order).withColumn("__pid", F.spark_partition_id())


def running_totals(df: DataFrame, order: str, sums: Sequence[str],
                   tie: Sequence[str] = ()) -> DataFrame:
    """Add ``cum_<c>`` (inclusive) for every column in ``sums`` in global
    ``order``, and ``next_<order>``, the following order value.

    The range-partitioned rows are checkpointed, so that the offsets per
    partition and the rows themselves see the same partition borders even
    when an executor is lost. The offset table has one row per partition.
    """
    parts = checkpointed(range_sorted(df, [order, *tie]))
    local = Window.partitionBy("__pid").orderBy(order, *tie)
    offsets_in_order = Window.orderBy("__pid")
    totals = parts.groupBy("__pid").agg(
        *[F.sum(c).alias(f"t_{c}") for c in sums], F.min(order).alias("first"))
    offsets = totals.select(
        "__pid",
        *[F.coalesce(F.sum(f"t_{c}").over(offsets_in_order.rowsBetween(Window.unboundedPreceding, -1)),
                     F.lit(0)).alias(f"o_{c}") for c in sums],
        F.lead("first").over(offsets_in_order).alias("o_next"))
    return (parts
            .withColumns({f"cum_{c}": F.sum(c).over(local.rowsBetween(Window.unboundedPreceding, 0))
                          for c in sums})
            .withColumn(f"next_{order}", F.lead(order).over(local))
            .join(F.broadcast(offsets), "__pid")
            .withColumns({**{f"cum_{c}": F.col(f"cum_{c}") + F.col(f"o_{c}") for c in sums},
                          f"next_{order}": F.coalesce(F.col(f"next_{order}"), F.col("o_next"))})
            .drop("__pid", "o_next", *[f"o_{c}" for c in sums]))


def row_numbers(df: DataFrame, order: Sequence[str], name: str = "row_index") -> DataFrame:
    """0-based global row number in ``order`` without a single-task sort."""
    parts = checkpointed(range_sorted(df, list(order)))
    offsets = parts.groupBy("__pid").agg(F.count(F.lit(1)).alias("t"))
    offsets = offsets.select("__pid", F.coalesce(
        F.sum("t").over(Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("o"))
    local = Window.partitionBy("__pid").orderBy(*order)
    return (parts.withColumn(name, F.row_number().over(local).cast("long") - 1)
            .join(F.broadcast(offsets), "__pid")
            .withColumn(name, F.col(name) + F.col("o")).drop("__pid", "o"))


def ordered_scan(df: DataFrame, order: Sequence[str], sums: Sequence[str] = (), maxes: Sequence[str] = (),
                 prev: Sequence[str] = ()) -> DataFrame:
    """Running sums ``cum_<c>`` and maxima ``top_<c>`` (both inclusive) and
    the previous row's ``prev_<c>``, along a global order.

    The order should be unique. Works on range partitions, so a key that
    holds a third of the rows is spread like any other stretch of the order.
    """
    parts = checkpointed(range_sorted(df, list(order)))
    local = Window.partitionBy("__pid").orderBy(*order)
    upto, ahead = local.rowsBetween(Window.unboundedPreceding, 0), Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    ends = parts.groupBy("__pid").agg(
        F.count(F.lit(1)).alias("t_rows"), *[F.sum(c).alias(f"t_{c}") for c in sums], *[F.max(c).alias(f"m_{c}") for c in maxes],
        F.max_by(F.struct(*[F.col(c).alias(c) for c in prev]) if prev else F.lit(0), F.struct(*order)).alias("last"))
    carry = ends.select(
        "__pid", *[F.sum(f"t_{c}").over(ahead).alias(f"o_{c}") for c in sums], *[F.max(f"m_{c}").over(ahead).alias(f"x_{c}") for c in maxes],
        F.lag("last").over(Window.orderBy("__pid")).alias("o_last"))
    out = parts.withColumns({**{f"cum_{c}": F.sum(c).over(upto) for c in sums}, **{f"top_{c}": F.max(c).over(upto) for c in maxes},
                             "__r": F.row_number().over(local), **{f"prev_{c}": F.lag(c).over(local) for c in prev}})
    out = out.join(F.broadcast(carry), "__pid")
    return out.withColumns({
        **{f"cum_{c}": F.col(f"cum_{c}") + F.coalesce(f"o_{c}", F.lit(0)) for c in sums},
        **{f"top_{c}": F.when(F.col(f"top_{c}").isNull() | (F.col(f"x_{c}") > F.col(f"top_{c}")), F.col(f"x_{c}")).otherwise(F.col(f"top_{c}")) for c in maxes},
        **{f"prev_{c}": F.when(F.col("__r") == 1, F.col("o_last").getField(c)).otherwise(F.col(f"prev_{c}")) for c in prev},
    }).drop("__pid", "__r", "o_last", *[f"o_{c}" for c in sums], *[f"x_{c}" for c in maxes])


def rank_in_group(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str = "rank") -> DataFrame:
    """1-based row number inside each group without gathering the group: the
    global row number less that of the group's first row."""
    numbered = row_numbers(df, [*group, *order], "__i")
    starts = ordered_scan(numbered.withColumn("__g", F.struct(*group)), ["__i"], prev=["__g"])
    first = F.col("prev___g").isNull() | ~F.col("__g").eqNullSafe(F.col("prev___g"))
    marked = starts.withColumn("__s", F.when(first, F.col("__i"))).drop("prev___g")
    return (ordered_scan(marked, ["__i"], maxes=["__s"])
            .withColumn(name, F.col("__i") - F.col("top___s") + 1).drop("__i", "__g", "__s", "top___s"))


def latest_in_window(points: DataFrame, probes: DataFrame, n: int) -> DataFrame:
    """For every probe the newest ``n`` points of its group inside a time range.

    ``points``: g, ts, id; ``probes``: pid, g, lo, hi; result: pid, id, ts, nth.
    Points and probes are merged along one order, which tells each probe the
    number of the last point not after ``hi``; the n points before it are then
    fetched by number. No two rows are compared that are not in the answer's
    neighbourhood, however many share a group.
    """
    merged = (points.select("g", F.col("ts").alias("at"), F.lit(0).alias("kind"), F.col("id").cast("string").alias("who"), "id", "ts",
                            F.lit(None).alias("pid"), F.lit(None).cast("timestamp").alias("lo"), F.lit(1).alias("one"))
              .unionByName(probes.select("g", F.col("hi").alias("at"), F.lit(1).alias("kind"), F.col("pid").cast("string").alias("who"),
                                         F.lit(None).alias("id"), F.lit(None).cast("timestamp").alias("ts"), "pid", "lo", F.lit(0).alias("one"))))
    scanned = checkpointed(ordered_scan(merged, ["g", "at", "kind", "who"], sums=["one"]))
    numbered = scanned.filter("kind = 0").select(F.col("cum_one").alias("no"), F.col("g").alias("pg"), "id", "ts")
    asked = scanned.filter("kind = 1").select("pid", "g", "lo", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("nth"), "cum_one")
    asked = asked.withColumn("no", F.col("cum_one") - F.col("nth"))
    return (asked.join(numbered, "no").filter(F.col("pg").eqNullSafe(F.col("g")) & (F.col("ts") >= F.col("lo")))
            .select("pid", "id", "ts", (F.col("nth") + 1).alias("nth")))


def chunked(df: DataFrame, order: Sequence[str], rows: int = 100_000) -> DataFrame:
    """Add ``idx`` (global row number) and ``chunk``: consecutive stretches
    of equal size, the unit of work for ordered computations."""
    return row_numbers(df, order, "idx").withColumn("chunk", F.floor(F.col("idx") / rows).cast("long"))


Pair = Callable[[Callable[[str], Column], Callable[[str], Column]], Column]


def adjacent_stats(df: DataFrame, order: Sequence[str], carry: dict[str, Column],
                   stats: dict[str, tuple[str, Pair]]) -> DataFrame:
    """One row of statistics over (previous row, current row) in ``order``.

    ``stats`` maps a name to (``sum`` or ``max``, f(cur, prev)). Rows are
    range-partitioned by the whole order tuple, so one entity holding a third
    of the table is still spread over tasks. Pairs across partition borders
    are evaluated on one (first, last) row per partition.
    """
    kept = df.select(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)],
                     F.struct(*[c.alias(k) for k, c in carry.items()]).alias("cur"))
    keys = [f"o{i}" for i in range(len(order))]
    local = Window.partitionBy("__pid").orderBy(*keys)
    lagged = (range_sorted(kept, keys)
              .withColumn("prev", F.lag("cur").over(local))
              .withColumn("key", F.struct(*keys)))

    def field(of: Column) -> Callable[[str], Column]:
        return lambda name: of.getField(name)

    def fold(kind: str, value: Column) -> Column:
        return F.sum(value.cast("double")) if kind == "sum" else F.max(value.cast("double"))

    inner = {k: fold(kind, F.when(F.col("prev").isNotNull(), f(field(F.col("cur")), field(F.col("prev")))))
             for k, (kind, f) in stats.items()}
    per_part = lagged.groupBy("__pid").agg(
        *[c.alias(k) for k, c in inner.items()],
        F.count(F.lit(1)).alias("rows"),
        F.min_by("cur", "key").alias("first"), F.max_by("cur", "key").alias("last"))
    edges = per_part.withColumn("before", F.lag("last").over(Window.orderBy("__pid")))
    border = {k: F.when(F.col("before").isNotNull(), f(field(F.col("first")), field(F.col("before")))).cast("double")
              for k, (kind, f) in stats.items()}
    out = [F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")]
    for k, (kind, _) in stats.items():
        if kind == "sum":
            out.append(F.coalesce(F.sum(F.coalesce(F.col(k), F.lit(0.0)) + F.coalesce(border[k], F.lit(0.0))),
                                  F.lit(0.0)).alias(k))
        else:
            out.append(F.max(F.greatest(F.col(k), border[k])).alias(k))
    return edges.agg(*out)


def exact_quantiles(df: DataFrame, wanted: Sequence[tuple[Column, float]],
                    buffer_rows: int | None = None) -> list[float | None]:
    """Exact interpolated quantiles of columns, as driver scalars; nulls, NaN and infinities do not count."""
    return [None if p is None else between(*p) for p in order_pairs(df, wanted, buffer_rows)]


def between(a: float, b: float, share: float) -> float:
    return a if a == b else a + (b - a) * share


def order_pairs(df: DataFrame, wanted: Sequence[tuple[Column, float]], buffer_rows: int | None = None) -> list[tuple[float, float, float] | None]:
    """For each quantile the values on either side of it and how far it lies between them.

    A bracket around the two order statistics of each quantile begins as the whole range and is narrowed until what
    lies inside fits the buffer of one `percentile`. A round counts the rows of a bracket in bins of equal width, each with its
    least and greatest value: either the two statistics are the ends of two bins, or one bin is the next bracket. Quantiles that share
    a bracket share its count. After a round that dropped few rows, most being close together in a wide range, a mergeable
    sketch proposes the next bracket once. All sizes take this way; small inputs need no round.
    """
    limit = buffer_rows or PERCENTILE_BUFFER_ROWS
    wanted = [(finite(c), float(q)) for c, q in wanted]
    columns: dict[str, tuple[Column, list[int]]] = {}
    for i, (c, _) in enumerate(wanted):
        columns.setdefault(str(c), (c, []))[1].append(i)
    out: list[tuple[float, float, float] | None] = [None] * len(wanted)
    row = agg_row(df, {k: a for j, (c, _) in enumerate(columns.values())
                       for k, a in ((f"n{j}", F.count(c)), (f"lo{j}", F.min(c)), (f"hi{j}", F.max(c)))})
    state = []
    for j, (c, ids) in enumerate(columns.values()):
        n = row[f"n{j}"]
        for i in ids if n else []:
            pos = wanted[i][1] * (n - 1)
            state.append({"i": i, "j": j, "c": c, "k0": int(pos), "k1": min(int(pos) + 1, n - 1), "frac": pos - int(pos),
                          "lo": row[f"lo{j}"], "hi": row[f"hi{j}"], "below": 0, "inside": n, "ends": None, "sketch": False})

    def inside(s: dict) -> Column:
        return s["c"].between(s["lo"], s["hi"])

    while open_ := [s for s in state if s["ends"] is None and s["inside"] > limit and s["lo"] < (s["lo"] / 2 + s["hi"] / 2) < s["hi"]]:
        _by_sketch(df, [s for s in open_ if s["sketch"]], inside)
        _by_bins(df, [s for s in open_ if not s["sketch"]], inside)
    final = {f"v{s['i']}": F.percentile(F.when(inside(s), s["c"]), [(k - s["below"]) / max(s["inside"] - 1, 1) for k in (s["k0"], s["k1"])])
             for s in state if s["ends"] is None and s["lo"] < s["hi"]}
    values = agg_row(df, final)
    for s in state:
        ends = s["ends"] or ((s["lo"], s["hi"]) if s["lo"] == s["hi"] else values[f"v{s['i']}"])
        out[s["i"]] = (*ends, s["frac"])
    return out


def _by_bins(df: DataFrame, states: list[dict], inside: Callable[[dict], Column]) -> None:
    """Narrow brackets by counts in bins, all in one job."""
    groups: dict[tuple, list[dict]] = {}
    for s in states:
        groups.setdefault((s["j"], s["lo"], s["hi"]), []).append(s)
    parts = []
    for g, same in enumerate(groups.values()):
        s = same[0]
        # Halves, as the width of the whole range may be no number; where the bins would have no width, two are left.
        width = (s["hi"] / 2 - s["lo"] / 2) / QUANTILE_BINS
        place = F.floor((s["c"] / 2 - s["lo"] / 2) / width) if width > 0 else (s["c"] > s["lo"]).cast("long")
        parts.append(df.filter(inside(s)).select(place.alias("bin"), s["c"].alias("v")).groupBy("bin")
                     .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).withColumn("g", F.lit(g)))
    if not parts:
        return
    bins: dict[int, list] = {}
    for r in sorted(reduce(DataFrame.unionByName, parts).collect(), key=lambda r: (r.g, r.bin)):
        bins.setdefault(r.g, []).append(r)
    for g, same in enumerate(groups.values()):
        for s in same:
            at, before = s["below"], s["inside"]
            for k, r in enumerate(bins[g]):
                if at + r.n > s["k0"]:
                    break
                at += r.n
            if s["k1"] >= at + r.n:
                s["ends"] = (r.hi, bins[g][k + 1].lo)
            else:
                s["lo"], s["hi"], s["below"], s["inside"], s["sketch"] = r.lo, r.hi, at, r.n, r.n > 0.5 * before


def _by_sketch(df: DataFrame, states: list[dict], inside: Callable[[dict], Column]) -> None:
    """Narrow brackets by two values that a sketch proposes, counting what lies below and up to them."""
    slack = 2.0 / SKETCH_ACCURACY
    guesses = agg_row(df, {f"s{j}": F.percentile_approx(F.when(inside(s), s["c"]), [
        max((s["k0"] - s["below"]) / s["inside"] - slack, 0.0), min((s["k1"] - s["below"] + 1) / s["inside"] + slack, 1.0)],
        SKETCH_ACCURACY) for j, s in enumerate(states)})
    counts = agg_row(df, {f"{kind}{j}_{t}": F.count_if(s["c"] < F.lit(x) if kind == "b" else s["c"] <= F.lit(x))
                          for j, s in enumerate(states) for t, x in enumerate(sorted(guesses[f"s{j}"])) for kind in ("b", "u")})
    for j, s in enumerate(states):
        upto = s["below"] + s["inside"]
        for t, x in enumerate(sorted(guesses[f"s{j}"])):
            below, to = counts[f"b{j}_{t}"], counts[f"u{j}_{t}"]
            if below <= s["k0"] and x >= s["lo"]:
                s["lo"], s["below"] = x, below
            if to > s["k1"] and x <= s["hi"]:
                s["hi"], upto = x, to
        s["inside"], s["sketch"] = upto - s["below"], False


def reach(start: DataFrame, edges: DataFrame, max_depth: int) -> DataFrame:
    """Breadth-first reach: ``start`` (id), ``edges`` (src, dst) to rows
    (root, id, depth) with the least depth. A round is one join and one anti
    join; its result is checkpointed, so plans do not grow with the depth."""
    edges = checkpointed(edges.select("src", "dst").distinct())
    found = frontier = checkpointed(start.select(F.col("id").alias("root"), "id", F.lit(0).alias("depth")).distinct())
    for depth in range(1, max_depth + 1):
        step = (frontier.select("root", F.col("id").alias("src")).join(edges, "src")
                .select("root", F.col("dst").alias("id")).distinct()
                .join(found.select("root", "id"), ["root", "id"], "left_anti")
                .withColumn("depth", F.lit(depth)))
        frontier = checkpointed(step)
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    return found
