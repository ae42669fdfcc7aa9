"""Small column builders shared by the operators (all JVM-side expressions)."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN_PROJECT = "Unknown Project"


def ts_lit(as_of: str | _dt.datetime | _dt.date | Column | None) -> Column:
    """A timestamp_ntz literal for ``as_of``; None means the current local time."""
    if as_of is None:
        return F.localtimestamp()
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, _dt.datetime):
        as_of = as_of.strftime("%Y-%m-%d %H:%M:%S.%f")
    elif isinstance(as_of, _dt.date):
        as_of = as_of.strftime("%Y-%m-%d 00:00:00")
    return F.expr(f"timestamp_ntz'{as_of}'")


def days_before(as_of, days: int) -> Column:
    """``as_of - days`` (a day-time interval, as ``NOW() - INTERVAL 'n days'``)."""
    return ts_lit(as_of) - F.make_dt_interval(F.lit(int(days)))


def micros_between(start: str | Column, end: str | Column) -> Column:
    """Exact microseconds from start to end (EXTRACT(EPOCH FROM end - start) * 1e6)."""
    s = start if isinstance(start, Column) else F.col(start)
    e = end if isinstance(end, Column) else F.col(end)
    return F.timestamp_diff("MICROSECOND", s, e)


def avg_micros_as(micros: Column, unit_seconds: float) -> Column:
    """Mean of ``micros`` expressed in a unit of ``unit_seconds``; NULL without values.

    The microseconds are summed exactly as integers and divided once as
    doubles, so the result does not depend on the order partial sums are
    merged in (and fractional seconds are kept, as EXTRACT(EPOCH) does).
    """
    n = F.count(micros)
    return F.when(n > 0, F.sum(micros).cast("double") / (n * F.lit(float(unit_seconds) * 1e6)))


def round_decimal2(x: Column) -> Column:
    """Round to 2 places half away from zero, through an exact decimal."""
    return F.round(x.cast("decimal(18,8)"), 2).cast("decimal(10,2)")


def percent(num: Column, den: Column, zero_when_empty: bool = True) -> Column:
    """round(num / den * 100, 2) as DECIMAL(10,2); 0 (or NULL) when den = 0."""
    val = round_decimal2(num * F.lit(100.0).cast("decimal(4,1)") / den)
    other = F.lit(0).cast("decimal(10,2)") if zero_when_empty else F.lit(None).cast("decimal(10,2)")
    return F.when(den > 0, val).otherwise(other)


def js_math_round_percent(num: Column, den: Column) -> Column:
    """Math.round(num / den * 100) in double arithmetic, 0 when den = 0."""
    return F.when(den > 0, F.floor(num / den * F.lit(100.0) + F.lit(0.5))).otherwise(F.lit(0)).cast("long")


def count_if(cond: Column) -> Column:
    return F.count_if(cond)
