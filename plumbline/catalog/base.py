"""Registered queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable
from string import Formatter
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import plumbline.operators.checks  # noqa: F401  (registers the catalog)
from plumbline.plans.planner import run
from plumbline.plans.registry import CheckConfig

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, fn: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"query {name} registered twice")
    QUERIES[name] = fn
    if sql is not None:
        ORACLES[name] = sql


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def source(spark: SparkSession, sf: str, text: str) -> DataFrame:
    """A table name, or SQL text with {table} placeholders."""
    names = sorted({f for _, f, _, _ in Formatter().parse(text) if f})
    if not names:
        return table(spark, sf, text)
    return spark.sql(text, **{n: table(spark, sf, n) for n in names})


def duck(text: str) -> str:
    """The same source for the SQL engine, whose views bear the table names."""
    names = {f for _, f, _, _ in Formatter().parse(text) if f}
    return text.format(**{n: n for n in names}) if names else f"select * from {text}"


OUT = ["check_name", "column_name", "status", "unexpected_count", "total_count", "observed"]


def shown(result: DataFrame) -> DataFrame:
    """Check results as the queries report them."""
    return result.select(F.col("check").alias("check_name"), F.col("column").alias("column_name"), "status",
                         "unexpected_count", "total_count", "observed")


def label(text: str | None) -> str:
    return "cast(null as varchar)" if text is None else "'" + text.replace("'", "''") + "'"


def rp(column: str | None, violation: str, applies: str | None = None, mostly: float | None = None,
       every: bool = False) -> dict[str, Any]:
    """Row predicate: ``every`` counts all rows, else rows where it applies."""
    applies = "true" if every else applies or f"{column} is not null"
    ok = "bad = 0" if mostly is None else f"(total - bad) >= {mostly} * total"
    return {"label": column, "bad": f"count(*) filter (where ({applies}) and ({violation}))",
            "total": f"count(*) filter (where {applies})", "ok": ok, "v": "null", "frm": "data"}


def ag(column: str | None, value: str, ok: str, frm: str = "data") -> dict[str, Any]:
    """Assertion on one number; an unknown verdict passes."""
    return {"label": column, "bad": None, "total": "1", "ok": f"coalesce({ok}, true)", "v": value, "frm": frm}


def vd(column: str | None, bad: str, total: str, ok: str = "bad = 0", v: str = "null", frm: str = "data") -> dict[str, Any]:
    return {"label": column, "bad": bad, "total": total, "ok": ok, "v": v, "frm": frm}


def check_sql(name: str, src: str, rows: tuple[dict[str, Any], ...], ctes: dict[str, str], recursive: str = "") -> str:
    parts = []
    for r in rows:
        if r["bad"] is None:
            inner = f"select cast({r['v']} as double) as v from {r['frm']}"
            inner = f"select 1 as total, v, {r['ok']} as ok, case when {r['ok']} then 0 else 1 end as bad from ({inner}) i"
        else:
            inner = f"select {r['bad']} as bad, {r['total']} as total, cast({r['v']} as double) as v from {r['frm']}"
            inner = f"select *, {r['ok']} as ok from ({inner}) i"
        parts.append(f"select '{name}' as check_name, {label(r['label'])} as column_name, "
                     f"case when ok then 'pass' else 'fail' end as status, cast(bad as bigint) as unexpected_count, "
                     f"cast(total as bigint) as total_count, round(v, 6) as observed from ({inner}) o")
    heads = ", ".join(f"{k} as ({v})" for k, v in {"data": duck(src), **{k: duck(v) for k, v in ctes.items()}}.items())
    if recursive:
        heads = f"recursive {heads}, {recursive}"
    return f"with {heads} " + " union all ".join(parts)


def chk(name: str, src: str, params: dict[str, Any], *rows: dict[str, Any], refs: dict[str, str] | None = None,
        as_of: str | None = None, key: str | None = None, ctes: dict[str, str] | None = None,
        duck_src: str | None = None, recursive: str = "") -> None:
    """Register a check over a source, with rows of its SQL counterpart."""
    short = name.split(".")[-1]

    def fn(spark: SparkSession, sf: str) -> DataFrame:
        given = {k: source(spark, sf, v) for k, v in (refs or {}).items()}
        return shown(run(source(spark, sf, src), [CheckConfig(name, params)], given, as_of, catch_exceptions=False))

    heads = {**(refs or {}), **(ctes or {})}
    sql = check_sql(short, duck_src or src, rows, heads, recursive) if rows else None
    register(key or f"check_{name.replace('.', '_')}", fn, sql)
