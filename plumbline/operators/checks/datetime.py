"""Checks on dates and times. ``as_of`` of the run stands for 'now'."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.patterns import OFFSET
from plumbline.operators.checks.string import java_format, parsed
from plumbline.plans.registry import check

PART_SIZE = {"day": 31, "weekday": 7, "month": 12, "hour": 24, "quarter": 4}


def moment(column):
    return F.col(column).cast("timestamp")


@check("datetime")
def DateFormat(t, column, format):
    """Values can be read with the given format."""
    c = F.col(column)
    t.rows(column, F.try_to_timestamp(c.cast("string"), F.lit(java_format(format))).isNull(), c.isNotNull())


@check("datetime")
def DateBetween(t, column, min_date=None, max_date=None):
    """Dates lie in a closed range."""
    c, ok = moment(column), F.lit(True)
    if min_date is not None:
        ok = ok & (c >= F.lit(str(min_date)).cast("timestamp"))
    if max_date is not None:
        ok = ok & (c <= F.lit(str(max_date)).cast("timestamp"))
    t.rows(column, ~ok, c.isNotNull())


@check("datetime")
def FutureDate(t, column):
    """Dates lie after the moment of the run."""
    t.rows(column, moment(column) <= t.as_of, F.col(column).isNotNull())


@check("datetime")
def PastDate(t, column):
    """Dates lie before the moment of the run."""
    t.rows(column, moment(column) >= t.as_of, F.col(column).isNotNull())


@check("datetime", "high")
def DateOrder(t, start_column, end_column):
    """Start is not after end."""
    a, b = moment(start_column), moment(end_column)
    t.rows(f"{start_column},{end_column}", a > b, a.isNotNull() & b.isNotNull())


@check("datetime", "low")
def Timezone(t, column, expected_timezone=None):
    """Values carry a zone: an offset suffix in text, or a zoned type."""
    c = F.col(column)
    kind = t.df.schema[column].dataType
    if isinstance(kind, T.TimestampType):
        zone = t.df.sparkSession.conf.get("spark.sql.session.timeZone")
        ok = F.lit(expected_timezone is None or expected_timezone == zone)
    elif isinstance(kind, T.StringType):
        ok = c.rlike(OFFSET)
        if expected_timezone is not None:
            ends = ["Z", "+00:00", "+0000"] if expected_timezone.upper() in ("UTC", "Z") else [expected_timezone]
            fits = F.lit(False)
            for e in ends:
                fits = fits | c.endswith(e)
            ok = ok & fits
    else:
        ok = F.lit(False)
    t.rows(column, ~ok, c.isNotNull())


def age_days(t, newest):
    return (F.unix_micros(t.as_of) - F.unix_micros(newest)) / F.lit(86400e6)


@check("datetime", "high")
def RecentData(t, column, max_age_days):
    """The newest entry is at most so many days old."""
    age = age_days(t, t.stat(F.max(moment(column))))
    t.value(column, age, ok=F.coalesce(age <= float(max_age_days), F.lit(False)))


@check("datetime")
def DatePartCoverage(t, column, date_part, min_coverage):
    """Share of the possible values of a date part that occur."""
    c = moment(column)
    part = {"day": F.dayofmonth, "weekday": F.weekday, "month": F.month, "hour": F.hour, "quarter": F.quarter}[date_part](c)
    # At most 31 values, so the set is a tiny exact distinct count.
    seen = t.stat(F.size(F.collect_set(part)))
    t.value(column, seen / F.lit(float(PART_SIZE[date_part])), lo=float(min_coverage))


@check("datetime", "high")
def GroupedRecentData(t, datetime_column, group_column, max_age_days):
    """The newest entry of every group is at most so many days old."""
    frame = t.frame(f"newest:{group_column}:{datetime_column}", lambda: t.df.groupBy(
        F.col(group_column).alias("g")).agg(F.max(moment(datetime_column)).alias("newest")))
    stale = F.coalesce(age_days(t, F.col("newest")) > float(max_age_days), F.lit(True))
    t.verdict(datetime_column, t.stat(F.count_if(stale), frame), t.stat(F.count(F.lit(1)), frame), frame=frame)


@check("datetime")
def DatetimeParseable(t, column):
    """Values can be read as a date in one of the usual formats."""
    c = F.col(column)
    t.rows(column, parsed(c.cast("string")).isNull(), c.isNotNull())
