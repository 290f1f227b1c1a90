"""Column expressions for lenient parsing, time keys and missing values.

Spark keeps NULL and NaN apart and lets NaN into aggregates, so every double
that is parsed or derived goes through ``finite`` before it is aggregated.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MINUTE_MS = 60_000
DAY_MS = 86_400_000

# The texts read as booleans.
TRUE_TEXTS = ("true", "1", "t", "yes")
FALSE_TEXTS = ("false", "0", "f", "no")


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: str | Column) -> Column:
    """NaN and both infinities become NULL."""
    c = _col(c)
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def div(c: str | Column, n: int) -> Column:
    """Integer division that rounds toward minus infinity."""
    c = _col(c)
    return F.call_function("div", c - F.pmod(c, F.lit(n)), F.lit(n))


def ratio(a: Column, b: Column) -> Column:
    """``a / b``, NULL where that is undefined or not finite."""
    return finite(F.try_divide(a, b))


def to_double(c: str | Column) -> Column:
    """Text or number to double, NULL where it is not a number.

    Java also reads ``1.5d`` and ``1.5f``; those are no numbers here.
    """
    text = F.trim(_col(c).cast("string"))
    return F.when(~text.rlike("[0-9.][dDfF]$"), text.try_cast("double"))


def as_double(df: DataFrame, name: str) -> Column:
    """A column of any type as double: numbers and booleans are cast, only texts are parsed."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return F.col(f"`{name}`").cast("double")
    return to_double(F.col(f"`{name}`"))


def to_long(c: str | Column) -> Column:
    """Text or number to bigint, NULL where it is not a whole number."""
    c = _col(c)
    as_double = to_double(c)
    whole = F.when(as_double == F.rint(as_double), as_double.try_cast("bigint"))
    return F.coalesce(F.trim(c.cast("string")).try_cast("bigint"), whole)


def to_bool(c: str | Column) -> Column:
    """Texts of the two lists above, else any number by its whole part, else NULL."""
    text = F.lower(F.trim(_col(c).cast("string")))
    number = to_double(text).try_cast("bigint")
    return (
        F.when(text.isin(*TRUE_TEXTS), True)
        .when(text.isin(*FALSE_TEXTS), False)
        .otherwise(number != 0)
    )


def epoch_ms(c: str | Column) -> Column:
    """Epoch in s, ms, us or ns (told apart by magnitude) to epoch milliseconds."""
    return epoch_ms_of(to_long(c), finite(to_double(c)))


def epoch_ms_of(whole: str | Column, number: str | Column) -> Column:
    """The same of a value that is already parsed, as bigint and as double."""
    x, d = _col(whole), _col(number)

    def beyond(v: Column, limit: float) -> Column:
        return (v >= F.lit(limit)) | (v <= F.lit(-limit))

    exact = (
        F.when(beyond(x, 1e17), div(x, 1_000_000))
        .when(beyond(x, 1e14), div(x, 1_000))
        .when(~beyond(x, 1e11), x * 1_000)
        .otherwise(x)
    )
    broken = (
        F.when(beyond(d, 1e17), F.floor(d / 1e6))
        .when(beyond(d, 1e14), F.floor(d / 1e3))
        .when(~beyond(d, 1e11), F.rint(d * 1e3))
        .otherwise(F.rint(d))
    )
    return F.coalesce(exact, broken.try_cast("bigint"))


def open_time_ms(df: DataFrame, name: str = "open_time") -> Column:
    """A time column of any accepted type as epoch milliseconds."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.TimestampType):
        return F.unix_millis(F.col(name))
    if isinstance(kind, T.TimestampNTZType):
        return F.expr(
            f"timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', `{name}`)"
        )
    if isinstance(kind, T.DateType):
        return F.datediff(F.col(name), F.lit("1970-01-01").cast("date")).cast("bigint") * DAY_MS
    if isinstance(kind, T.IntegralType):
        return F.col(name).cast("bigint")
    return F.coalesce(to_long(name), F.rint(finite(to_double(name))).try_cast("bigint"))


def utc_timestamp(ms: str | Column) -> Column:
    return F.timestamp_millis(_col(ms))


def minute_floor(ms: str | Column, step_ms: int = MINUTE_MS) -> Column:
    ms = _col(ms)
    return ms - F.pmod(ms, F.lit(step_ms))


def date_text(ms: str | Column) -> Column:
    """UTC calendar day of an epoch, as ``yyyy-MM-dd``; no session zone involved."""
    days = div(ms, DAY_MS).cast("int")
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), days), "yyyy-MM-dd")


def day_bounds_ms(start: str | date, end: str | date) -> tuple[int, int]:
    """First and last millisecond of an inclusive range of UTC days."""

    def midnight(day: str | date) -> datetime:
        day = date.fromisoformat(day) if isinstance(day, str) else day
        return datetime(day.year, day.month, day.day, tzinfo=timezone.utc)

    first = int(midnight(start).timestamp() * 1000)
    last = int((midnight(end) + timedelta(days=1)).timestamp() * 1000) - 1
    return first, last
