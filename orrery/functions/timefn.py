"""Time formats of telemetry archives, as columns; times are epoch seconds (UTC) unless named otherwise."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: J2000 in epoch seconds, and the lengths that a day-of-year time may have.
J2000 = 946728000.0
LENGTHS = (4, 8, 10, 11, 13, 14, 16, 17, 19, 21)
PATTERN = r"^\d{4}(/\d{3}(/\d{2}(:\d{2}(:\d{2}(\.\d{1,3})?)?)?)?)?$"


def _stamp(t: Column) -> Column:
    return F.timestamp_micros(F.round(t * 1e6).cast("long"))


def matches(s: Column) -> Column:
    """Whether a text is YYYY[/DDD[/HH[:MM[:SS[.mmm]]]]]."""
    return s.rlike(PATTERN)


def parse_long(s: Column) -> Column:
    """Epoch seconds; null where the text has another form."""
    year = F.substring(s, 1, 4).cast("int")
    number = lambda at, n: F.coalesce(F.nullif(F.substring(s, at, n), F.lit("")).cast("int"), F.lit(0))
    day = F.coalesce(F.nullif(F.substring(s, 6, 3), F.lit("")).cast("int"), F.lit(1))
    part = F.rpad(F.substring(s, 19, 3), 3, "0").cast("int")
    millis = F.when(F.length(s) > 18, part).otherwise(0)
    base = F.unix_date(F.make_date(year, F.lit(1), F.lit(1))).cast("double") * 86400
    value = base + (day - 1) * 86400 + number(10, 2) * 3600 + number(13, 2) * 60 + number(16, 2) + millis / 1000
    return F.when(matches(s), value)


def parse_iso(s: Column) -> Column:
    """ISO 8601, a trailing Z or none meaning UTC."""
    return F.unix_micros(F.to_timestamp(F.regexp_replace(s, "Z$", ""))) / 1e6


def format_long(t: Column) -> Column:
    """YYYY/DDD/HH:MM:SS.mmm, milliseconds cut off."""
    return F.date_format(_stamp(t), "yyyy/DDD/HH:mm:ss.SSS")


def format_short(t: Column) -> Column:
    """YYYYDDDHHMMSS."""
    return F.date_format(_stamp(t), "yyyyDDDHHmmss")


def format_iso(t: Column) -> Column:
    """ISO 8601 with milliseconds and Z."""
    return F.date_format(_stamp(t), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def parse_short(s: Column) -> Column:
    """YYYYDDDHHMMSS as seconds since J2000."""
    number = lambda at, n: F.substring(s, at, n).cast("int")
    base = F.unix_date(F.make_date(number(1, 4), F.lit(1), F.lit(1))).cast("double") * 86400
    return base + (number(5, 3) - 1) * 86400 + number(8, 2) * 3600 + number(10, 2) * 60 + number(12, 2) - J2000


def day_start(t: Column) -> Column:
    """D09."""
    return F.floor(t / 86400) * 86400.0


def day_end(t: Column) -> Column:
    """A midnight is its own end."""
    return F.ceil(t / 86400) * 86400.0


def day_of_year(t: Column) -> Column:
    return F.dayofyear(_stamp(t))


def year(t: Column) -> Column:
    return F.year(_stamp(t))


def year_day(t: Column, dash: str = "/") -> Column:
    """YYYY/DDD, or YYYYDDD without the sign."""
    return F.date_format(_stamp(t), f"yyyy'{dash}'DDD" if dash else "yyyyDDD")


def year_day_at(s: Column) -> Column:
    """D11 of a timestamp: YYYY/DDD; years after 9999 have more digits and no sign."""
    y = F.year(s)
    return F.concat(F.when(y.between(0, 9999), F.lpad(y.cast("string"), 4, "0")).otherwise(y.cast("string")), F.lit("/"), F.lpad(F.dayofyear(s).cast("string"), 3, "0"))


def hour_floor_ms(ms: Column) -> Column:
    """Milliseconds in and out."""
    return (F.floor(ms / 3600000) * 3600000).cast("long")


def weekday(t: Column) -> Column:
    """0 for Monday."""
    return F.weekday(_stamp(t))


def yesterday_doy(t: Column) -> Column:
    """D13."""
    return F.dayofyear(F.date_sub(F.to_date(_stamp(t)), 1))


def vax_year(t: Column) -> Column:
    """Twenty years earlier, the 29th of February falling back to the 28th."""
    s = _stamp(t)
    moved = F.add_months(F.to_date(s), -240)
    return F.unix_date(moved).cast("double") * 86400 + (t - F.floor(t / 86400) * 86400)


def full_length(s: Column) -> Column:
    """D15."""
    return F.length(s).isin(4, 8, 10, 13, 16, 21)


def offset_from(now: float, s: Column) -> Column:
    """Now less the parsed time."""
    return F.lit(now) - parse_long(s)
