"""Runs checks: all checks that look at the same frame share one aggregate.

A check function receives a ``Scope`` and records verdicts. Its statistics
are plain aggregate Columns; equal ones are computed once, and every row
check of a table ends up in the same single scan. A check that needs table
statistics before it can state its row predicate is a generator: it yields
requests (aggregate Columns or ``Quantile``) and receives scalars. Requests
of all checks are answered together, round by round.
"""

from __future__ import annotations

import hashlib
import inspect
import json
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.plans.primitives import AGGREGATE_WEIGHT, adjacent_stats, agg_row, exact_quantiles, value_counts, weight
from plumbline.plans.registry import SEVERITIES, CheckConfig, CheckSpec, find

RESULT_SCHEMA = T.StructType([
    T.StructField("check", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("column", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("unexpected_count", T.LongType()),
    T.StructField("total_count", T.LongType()),
    T.StructField("unexpected_pct", T.DoubleType()),
    T.StructField("observed", T.DoubleType()),
    T.StructField("expected", T.StringType()),
    T.StructField("message", T.StringType()),
])


@dataclass(frozen=True)
class Quantile:
    """Request for an exact quantile of a column."""

    column: Column
    q: float


@dataclass
class Frame:
    """Something statistics can be computed on; equal keys are shared."""

    key: str
    build: Callable[[], DataFrame]

    def aggregate(self, stats: dict[str, Any]) -> DataFrame:
        return self.build().agg(F.count(F.lit(1)).alias("frame_rows"),
                                *[c.alias(a) for a, c in stats.items()])


@dataclass
class PairFrame(Frame):
    """Adjacent rows in a given order; statistics are (kind, f(cur, prev))."""

    order: tuple[str, ...] = ()
    carry: dict[str, Column] = field(default_factory=dict)

    def aggregate(self, stats: dict[str, Any]) -> DataFrame:
        return adjacent_stats(self.build(), self.order, self.carry, stats)


@dataclass
class Verdict:
    frame: Frame
    stats: dict[str, Any]
    column: str | None
    unexpected: Column
    total: Column
    ok: Column
    observed: Column
    violation: Column | None = None
    rows: Callable[[], DataFrame] | None = None


class Scope:
    """What a check sees: the table, its references, and verdict helpers."""

    def __init__(self, df: DataFrame, refs: dict[str, DataFrame], as_of: Column,
                 base: Frame, shared: dict[str, Frame]):
        self.df, self.refs, self.as_of = df, refs, as_of
        self.base, self._shared = base, shared
        self.verdicts: list[Verdict] = []
        self._stats: dict[str, dict[str, Any]] = {}

    # -- inputs ---------------------------------------------------------
    def ref(self, name: str) -> DataFrame:
        if name not in self.refs:
            raise KeyError(f"reference source {name!r} was not given")
        return self.refs[name]

    def columns_or(self, columns: Sequence[str] | None, *kinds: type) -> list[str]:
        """The named columns, else all columns of the given types."""
        if columns:
            return [columns] if isinstance(columns, str) else list(columns)
        return [f.name for f in self.df.schema.fields if not kinds or isinstance(f.dataType, kinds)]

    # -- frames ---------------------------------------------------------
    def frame(self, key: str, build: Callable[[], DataFrame]) -> Frame:
        return self._shared.setdefault(key, Frame(key, build))

    def groups(self, keys: Sequence[str], where: Column | None = None) -> Frame:
        """Distinct key tuples (k0..) with their count n."""
        def build() -> DataFrame:
            src = self.df if where is None else self.df.filter(where)
            return value_counts(src, {f"k{i}": F.col(k) for i, k in enumerate(keys)})
        return self.frame(f"groups:{'|'.join(keys)}:{where}", build)

    def pairs(self, order: Sequence[str], carry: dict[str, Column], where: Column | None = None,
              source: Frame | None = None) -> PairFrame:
        """Neighbouring rows of the table (or another frame) in an order."""
        source = source or self.base
        key = f"pairs:{source.key}:{'|'.join(order)}:{sorted((k, str(c)) for k, c in carry.items())}:{where}"
        def build() -> DataFrame:
            src = source.build()
            return src if where is None else src.filter(where)
        return self._shared.setdefault(key, PairFrame(key, build, tuple(order), carry))

    # -- statistics -----------------------------------------------------
    def stat(self, agg: Any, frame: Frame | None = None, name: str | None = None) -> Column:
        """Reference to an aggregate of a frame (the table by default)."""
        frame = frame or self.base
        alias = name or "s" + hashlib.md5(str(agg).encode()).hexdigest()[:14]
        self._stats.setdefault(frame.key, {})[alias] = agg
        return F.col(alias)

    # -- verdicts -------------------------------------------------------
    def verdict(self, column: str | None, unexpected: Column, total: Column, ok: Column | None = None,
                observed: Column | None = None, frame: Frame | None = None,
                violation: Column | None = None, rows: Callable[[], DataFrame] | None = None) -> None:
        frame = frame or self.base
        self.verdicts.append(Verdict(
            frame, self._stats.get(frame.key, {}), column, unexpected, total,
            (unexpected == 0) if ok is None else ok,
            F.lit(None) if observed is None else observed, violation, rows))
        self._stats[frame.key] = {}

    def rows(self, column: str | None, violation: Column, applicable: Column | None = None,
             mostly: float | None = None) -> None:
        """Row predicate: violating rows against the rows it applies to."""
        hit = violation if applicable is None else applicable & violation
        bad = self.stat(F.count_if(hit))
        total = self.stat(F.count(F.lit(1)) if applicable is None else F.count_if(applicable))
        ok = (bad == 0) if mostly is None else (total - bad) >= F.lit(float(mostly)) * total
        self.verdict(column, bad, total, ok, violation=hit)

    def value(self, column: str | None, observed: Column, lo: Any = None, hi: Any = None,
              ok: Column | None = None, frame: Frame | None = None) -> None:
        """Assertion on one number; an undefined number passes a range."""
        if ok is None:
            ok = F.lit(True)
            if lo is not None:
                ok = ok & (observed >= F.lit(lo))
            if hi is not None:
                ok = ok & (observed <= F.lit(hi))
        ok = F.coalesce(ok, F.lit(True))
        self.verdict(column, F.when(ok, 0).otherwise(1), F.lit(1), ok, observed, frame)

    def facts(self, column: str | None, bad: int, total: int, observed: float | None = None) -> None:
        """Verdict known from the schema alone."""
        self.verdict(column, F.lit(bad), F.lit(total), None,
                     F.lit(None if observed is None else float(observed)))

    def missing_parent(self, column: str, keys: Sequence[str], parent: DataFrame, parent_keys: Sequence[str],
                       null_is_error: bool = False) -> None:
        """Rows whose key has no parent.

        Child keys are counted before the join: a key held by a third of the
        rows reaches the shuffle as one row per task.
        """
        names = [f"k{i}" for i in range(len(keys))]

        def build() -> DataFrame:
            kids = value_counts(self.df, {n: F.col(k) for n, k in zip(names, keys)})
            known = parent.select(*[F.col(p).alias(n) for n, p in zip(names, parent_keys)]).distinct()
            return kids.join(known.withColumn("hit", F.lit(1)), names, "left")

        frame = Frame(f"fk:{'|'.join(keys)}:{'|'.join(parent_keys)}:{id(parent)}", build)
        frame = self._shared.setdefault(frame.key, frame)
        has_null = F.col("k0").isNull()
        for n in names[1:]:
            has_null = has_null | F.col(n).isNull()
        lost = F.col("hit").isNull() & (F.lit(True) if null_is_error else ~has_null)
        counted = F.lit(True) if null_is_error else ~has_null
        bad = self.stat(F.coalesce(F.sum(F.when(lost, F.col("n"))), F.lit(0)), frame)
        total = self.stat(F.coalesce(F.sum(F.when(counted, F.col("n"))), F.lit(0)), frame)

        def lost_rows() -> DataFrame:
            src = self.df
            if not null_is_error:
                src = src.dropna(subset=list(keys))
            known = parent.select(*[F.col(p).alias(f"__{n}") for n, p in zip(names, parent_keys)]).distinct()
            on = [src[k] == known[f"__{n}"] for k, n in zip(keys, names)]
            return src.join(known, on, "left_anti")

        self.verdict(column, bad, total, frame=frame, rows=lost_rows)


@dataclass
class Planned:
    config: CheckConfig
    spec: CheckSpec | None
    scope: Scope | None
    error: str | None = None


def _answer(df: DataFrame, asks: list[Any]) -> list[Any]:
    """Compute all requested scalars: one aggregate, plus quantile passes."""
    plain = {i: a for i, a in enumerate(asks) if not isinstance(a, Quantile)}
    quantiles = {i: a for i, a in enumerate(asks) if isinstance(a, Quantile)}
    out: list[Any] = [None] * len(asks)
    if plain:
        row = agg_row(df, {f"a{i}": a for i, a in plain.items()})
        for i in plain:
            out[i] = row[f"a{i}"]
    if quantiles:
        for i, v in zip(quantiles, exact_quantiles(df, [(q.column, q.q) for q in quantiles.values()])):
            out[i] = v
    return out


def plan(df: DataFrame, configs: Sequence[CheckConfig], refs: dict[str, DataFrame] | None = None,
         as_of: datetime | str | None = None) -> list[Planned]:
    now = F.current_timestamp() if as_of is None else F.lit(str(as_of)).cast("timestamp")
    base, shared = Frame("rows", lambda: df), {}
    planned: list[Planned] = []
    waiting: list[tuple[Planned, Any, list[Any]]] = []

    def advance(item: Planned, gen: Any, answers: list[Any] | None) -> None:
        try:
            waiting.append((item, gen, list(gen.send(answers))))
        except StopIteration:
            pass
        except (PySparkException, ValueError, KeyError, TypeError, ArithmeticError) as exc:
            item.error = _short(exc)

    for config in configs:
        if not config.enabled:
            continue
        item = Planned(config, None, None)
        planned.append(item)
        try:
            item.spec = find(config.name)
            params = config.normalised()
            item.scope = Scope(df, refs or {}, now, base, shared)
            out = item.spec.fn(item.scope, **params)
            if inspect.isgenerator(out):
                advance(item, out, None)
        except (PySparkException, ValueError, KeyError, TypeError) as exc:
            item.error = _short(exc)
    while waiting:
        round_, waiting[:] = list(waiting), []
        try:
            answers = _answer(df, [a for _, _, asks in round_ for a in asks])
        except PySparkException:
            answers = None
        at = 0
        for item, gen, asks in round_:
            if answers is None:
                try:
                    mine = _answer(df, asks)
                except PySparkException as exc:
                    item.error = _short(exc)
                    continue
            else:
                mine, at = answers[at:at + len(asks)], at + len(asks)
            advance(item, gen, mine)
    return planned


def _short(exc: BaseException) -> str:
    return f"{type(exc).__name__}: {str(exc).splitlines()[0] if str(exc) else ''}"[:300]


def quoted(text: str | None) -> str:
    """Spark SQL literal."""
    if text is None:
        return "cast(null as string)"
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _frame_result(frame: Frame, part: list[tuple[Planned, Verdict]]) -> DataFrame:
    """Aggregate a frame once; one result row per verdict."""
    stats: dict[str, Any] = {}
    for _, v in part:
        stats.update(v.stats)
    values, structs = [], []
    for i, (item, v) in enumerate(part):
        values += [v.unexpected.cast("long").alias(f"b{i}"), v.total.cast("long").alias(f"t{i}"), v.ok.alias(f"k{i}"),
                   v.observed.cast("double").alias(f"o{i}")]
        spec = item.spec
        fields = {
            "check": quoted(spec.name), "category": quoted(spec.category), "column": quoted(v.column),
            "severity": quoted(item.config.severity or spec.severity), "status": f"if(coalesce(k{i}, false), 'pass', 'fail')",
            "unexpected_count": f"b{i}", "total_count": f"greatest(t{i}, 0L)",
            "unexpected_pct": f"if(t{i} > 0, round(cast(b{i} as double) * 100 / t{i}, 6), 0.0D)", "observed": f"round(o{i}, 6)",
            "expected": quoted(json.dumps(item.config.params, default=str, sort_keys=True)),
            "message": f"if(coalesce(k{i}, false), cast(null as string), concat({quoted(spec.name)}, ': ', b{i}, ' of ', t{i}, ' unexpected'))"}
        structs.append("named_struct(" + ", ".join(f"'{k}', {e}" for k, e in fields.items()) + ")")
    return frame.aggregate(stats).select(*values).selectExpr(f"explode(array({', '.join(structs)})) as r").select("r.*")


def _compilable(verdicts: list[tuple[Planned, Verdict]]) -> list[list[tuple[Planned, Verdict]]]:
    """Verdicts of a frame in groups whose aggregates compile well; those of
    the same column stay together, so a split reads few columns twice."""
    out: list[list[tuple[Planned, Verdict]]] = [[]]
    held: set[str] = set()
    load = 0
    for item, v in sorted(verdicts, key=lambda x: x[1].column or ""):
        fresh = {a: weight(c) for a, c in v.stats.items() if a not in held}
        if load and load + sum(fresh.values()) > AGGREGATE_WEIGHT:
            out.append([])
            held, load, fresh = set(), 0, {a: weight(c) for a, c in v.stats.items()}
        out[-1].append((item, v))
        held |= set(v.stats)
        load += sum(fresh.values())
    return out


def results(df: DataFrame, planned: Sequence[Planned]) -> DataFrame:
    """Turn planned checks into one result frame; failures become rows."""
    by_frame: dict[str, tuple[Frame, list[tuple[Planned, Verdict]]]] = {}
    for item in planned:
        if item.error is not None:
            continue
        for v in item.scope.verdicts:
            by_frame.setdefault(v.frame.key, (v.frame, []))[1].append((item, v))
    parts: list[DataFrame] = []
    for frame, verdicts in by_frame.values():
        for chunk in _compilable(verdicts):
            try:
                parts.append(_frame_result(frame, chunk))
                continue
            except PySparkException:
                pass
            healthy = []
            for item, v in chunk:
                if item.error is None:
                    try:
                        _frame_result(frame, [(item, v)])
                        healthy.append((item, v))
                    except PySparkException as exc:
                        item.error = _short(exc)
            healthy = [(i, v) for i, v in healthy if i.error is None]
            if healthy:
                parts.append(_frame_result(frame, healthy))
    failed = [i for i in planned if i.error is not None]
    if failed:
        rows = [(i.spec.name if i.spec else i.config.name, i.spec.category if i.spec else None, None,
                 i.config.severity or (i.spec.severity if i.spec else "medium"), "error", None, None, None, None,
                 json.dumps(i.config.params, default=str, sort_keys=True), i.error) for i in failed]
        parts.append(df.sparkSession.createDataFrame(rows, RESULT_SCHEMA))
    if not parts:
        return df.sparkSession.createDataFrame([], RESULT_SCHEMA)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: Categories whose checks take strings as they are.
TEXT_CATEGORIES = {"completeness", "uniqueness", "string", "schema", "table", "referential", "cross_table"}
#: Parts of the names of parameters that hold an expression of the caller.
EXPRESSIONS = ("expression", "filter", "condition", "query", "when", "where", "formula", "assertion")


PLAIN = re.compile(r"(?:[\s()<>=!,+*-]|\d+(?:\.\d+)?|[A-Za-z_]\w*|`[^`]+`)+")
CALL = re.compile(r"(\w+)\s*\(")
WORDS = {"and", "or", "not", "is", "null", "between", "in", "true", "false"}


def cannot_fail(df: DataFrame, text: str) -> bool:
    """Whether an expression only compares and combines numbers, with arithmetic on floating ones alone: no division, call, cast or text."""
    if not PLAIN.fullmatch(text) or {c.lower() for c in CALL.findall(text)} - WORDS:
        return False
    names = {w.strip("`") for w in re.findall(r"`[^`]+`|[A-Za-z_]\w*", text)}
    kinds = {f.name: f.dataType for f in df.schema}
    wanted = (T.DoubleType, T.FloatType) if re.search(r"[+*-]", text) else T.NumericType
    return all(isinstance(kinds.get(w), wanted) for w in names if w.lower() not in WORDS)


def may_fail(df: DataFrame, item: Planned) -> bool:
    """Whether the data can make a planned check fail: it evaluates an expression of the caller, comes from outside the
    library, or reads text columns as anything but text (a number in a parameter, a numeric statistic)."""
    if item.spec is None or not item.spec.fn.__module__.startswith("plumbline."):
        return item.error is None
    if item.error is not None:
        return False
    params = item.config.params
    if any(not (isinstance(v, str) and cannot_fail(df, v)) for name, v in params.items() if v and any(part in name for part in EXPRESSIONS)):
        return True
    given = [x for v in params.values() for x in (v if isinstance(v, (list, tuple, set)) else [v])]
    sure = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
    texts = [f.name for f in df.schema if f.name in given and not isinstance(f.dataType, sure)]
    other = [x for x in given if not (isinstance(x, str) and x in df.columns)]
    return bool(texts) and item.spec.category not in TEXT_CATEGORIES and (
        item.spec.category != "distribution" or any(not isinstance(x, str) for x in other))


def settled(df: DataFrame, planned: Sequence[Planned]) -> list[Any]:
    """The result rows of checks that the data can make fail. They run together; if that fails, by halves, so that one failing check
    costs a few scans and not one for each of the others."""
    try:
        return results(df, planned).collect()
    except PySparkException as exc:
        if len(planned) > 1:
            half = len(planned) // 2
            return settled(df, planned[:half]) + settled(df, planned[half:])
        planned[0].error = _short(exc)
        return results(df, planned).collect()


def with_rows(df: DataFrame, out: DataFrame, planned: Sequence[Planned], most: int) -> DataFrame:
    """``out`` with the rejected rows of each check. All checks of single rows share one scan, in which each task keeps the ``most``
    least rows of a check; checks of keys bring their rows themselves."""
    told = [(i, v) for i in planned if i.error is None for v in i.scope.verdicts]
    single = [(n, v) for n, (_, v) in enumerate(told) if v.rows is None and v.violation is not None]
    parts = []
    if single:
        hits = F.array_compact(F.array(*[F.when(F.coalesce(v.violation, F.lit(False)), F.lit(n)) for n, v in single]))
        parts.append(df.select(hits.alias("hits"), F.to_json(F.struct("*")).alias("row")).filter(F.size("hits") > 0).select(F.explode("hits").alias("n"), "row"))
    parts += [v.rows().select(F.lit(n).alias("n"), F.to_json(F.struct("*")).alias("row")) for n, (_, v) in enumerate(told) if v.rows is not None]
    if not parts:
        return out.withColumn("unexpected_rows", F.lit(None).cast("array<string>"))

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[str]] = {}
        for batch in batches:
            for n, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = held.setdefault(n, [])
                rows.append(row)
                if len(rows) > 2 * most + 100:
                    rows[:] = sorted(rows)[:most]
        for n, rows in held.items():
            rows = sorted(rows)[:most]
            yield pa.RecordBatch.from_arrays([pa.array([n] * len(rows), pa.int32()), pa.array(rows, pa.string())], ["n", "row"])

    rows = reduce(DataFrame.unionByName, parts).mapInArrow(least, "n int, row string")
    first = Window.partitionBy("n").orderBy("row")
    rows = rows.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= most)
    lists = rows.groupBy("n").agg(F.array_sort(F.collect_list("row")).alias("found"))
    names = [(n, i.spec.name, v.column, json.dumps(i.config.params, default=str, sort_keys=True)) for n, (i, v) in enumerate(told) if v.rows is not None or v.violation is not None]
    index = df.sparkSession.createDataFrame(names, "n int, c string, k string, e string").join(lists, "n", "left").select(
        "c", "k", "e", F.coalesce("found", F.array().cast("array<string>")).alias("unexpected_rows")).dropDuplicates(["c", "k", "e"])
    same = (F.col("check") == F.col("c")) & F.col("column").eqNullSafe(F.col("k")) & (F.col("expected") == F.col("e")) & (F.col("status") != "error")
    return out.join(index, same, "left").drop("c", "k", "e")


def run(df: DataFrame, configs: Sequence[CheckConfig], refs: dict[str, DataFrame] | None = None,
        as_of: datetime | str | None = None, min_severity: str | None = None,
        catch_exceptions: bool = True, include_unexpected_rows: bool = False, max_unexpected_rows: int = 1000) -> DataFrame:
    """Check a table. One row per check (and column); see RESULT_SCHEMA.

    ``include_unexpected_rows`` adds ``unexpected_rows``: the rows that a check rejects as JSON, the ``max_unexpected_rows`` that
    come first as text. It is null for checks that judge the whole table.

    The result is lazy. With ``catch_exceptions``, checks that the data can make fail (a division by zero in a user's
    expression, say) run at once in a scan of their own, and one that does fail becomes an ``error`` row beside the results of
    the others. Without it errors are raised.
    """
    planned = plan(df, configs, refs, as_of)
    if catch_exceptions:
        risky = [i for i in planned if may_fail(df, i)]
        sure = [i for i in planned if not any(i is r for r in risky)]
        out = results(df, sure) if sure or not risky else None
        if risky:
            known = df.sparkSession.createDataFrame(settled(df, risky), RESULT_SCHEMA)
            out = known if out is None else out.unionByName(known)
    else:
        out = results(df, planned)
        for item in planned:
            if item.error:
                raise ValueError(item.error)
    if include_unexpected_rows:
        out = with_rows(df, out, planned, max_unexpected_rows)
    if min_severity:
        out = out.filter(F.col("severity").isin(*SEVERITIES[SEVERITIES.index(min_severity):]))
    return out


def unexpected_rows(df: DataFrame, config: CheckConfig, refs: dict[str, DataFrame] | None = None,
                    as_of: datetime | str | None = None, limit: int | None = 1000) -> DataFrame:
    """The rows a row-level or key check rejects (``limit`` None = all)."""
    item = plan(df, [config], refs, as_of)[0]
    if item.error:
        raise ValueError(item.error)
    parts = []
    for v in item.scope.verdicts:
        if v.rows is not None:
            parts.append(v.rows())
        elif v.violation is not None:
            parts.append(df.filter(v.violation))
    if not parts:
        raise ValueError(f"{config.name} judges the whole table, not single rows")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out if limit is None else out.limit(limit)
