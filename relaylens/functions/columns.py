"""Column expressions shared by the jobs.  All are built-in Spark
functions, so they stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
MONEY_TOTAL = "decimal(38,2)"
METRIC = "decimal(38,6)"


def epoch_ntz() -> Column:
    """1970-01-01 00:00:00 as a ``timestamp_ntz`` literal."""
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch_micros(ts: Column | str) -> Column:
    """Microseconds since 1970-01-01 of a ``timestamp_ntz``.

    Built from the calendar fields of the value (day number, hour, minute,
    seconds with fraction), so no time zone takes part: ``timestamp_diff``
    and ``unix_micros`` would cast to a session-zone timestamp first and
    shift by an hour across daylight-saving changes in a non-UTC session.
    """
    t = _col(ts)
    return (
        F.unix_date(F.to_date(t)).cast("long") * F.lit(86_400_000_000)
        + F.hour(t).cast("long") * F.lit(3_600_000_000)
        + F.minute(t).cast("long") * F.lit(60_000_000)
        + (F.date_part(F.lit("SECOND"), t) * F.lit(1_000_000)).cast("long")
    )


def floor_div(a: Column, b: int) -> Column:
    """Exact floor division of a long column by a positive constant.

    ``a - pmod(a, b)`` is a multiple of ``b``; dividing a multiple is exact in
    double arithmetic for magnitudes below 2**53 (micro-seconds up to the
    year 2255), and it floors correctly for negative ``a``.
    """
    return ((a - F.pmod(a, F.lit(b))) / F.lit(b)).cast("long")


def money(c: Column | str) -> Column:
    """A per-row amount as exact cents."""
    return _col(c).cast(MONEY)


def sum_money(c: Column) -> Column:
    """Decimal sum widened to decimal(38,2), the type both engines agree on."""
    return F.sum(c).cast(MONEY_TOTAL)


def rate(num: Column, den: Column, digits: int = 6) -> Column:
    """``num / den`` as a double rounded to ``digits``; null when ``den`` is 0.

    Spark 4 runs with ANSI mode on, so a plain division by zero would raise.
    """
    return F.round(num.cast("double") / F.nullif(den, F.lit(0)).cast("double"), digits)


def micros_to_ts(us: Column) -> Column:
    """Inverse of ``epoch_micros``: a ``timestamp_ntz``, no time zone."""
    return F.timestamp_add("MICROSECOND", us, epoch_ntz())


def metric_value(c: Column) -> Column:
    """A value in the long metric table (counts, rates and money share it)."""
    return c.cast(METRIC)
