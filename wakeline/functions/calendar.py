"""Calendar and time expressions; the session time zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def day_of_year(ts: Column) -> Column:
    """Fractional day of the year from 0."""
    return F.dayofyear(ts) - 1 + (F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts).cast("double")) / 86400


def days_between(a: Column, b: Column) -> Column:
    """b - a in days."""
    return (F.unix_micros(b) - F.unix_micros(a)) / F.lit(float(DAY_US))


def day_difference(day: Column, before: Column) -> Column:
    """Days from one day of the year to a later one, round the year's end."""
    return F.pmod(day - before, F.lit(365.0))


def season(month_index: Column) -> Column:
    """Northern season of a month index from 0."""
    return F.when(month_index.isin(11, 0, 1), "winter").when(month_index <= 4, "spring").when(month_index <= 7, "summer").otherwise("autumn")


def month_index(day: Column) -> Column:
    """Month of a fractional day, 31 days each."""
    return F.floor(day / 31).cast("int")


def year_turn(day: Column) -> tuple[Column, Column]:
    """(cos t, sin t) with a year of 366 days."""
    turn = 2 * F.pi() * day / 366
    return F.cos(turn), F.sin(turn)


def step_to_days(step: Column, hours: float = 6.0) -> Column:
    """Days at the end of a step counted from 0."""
    return (step + 1) / F.lit(24 / hours)


def valid_time(base: Column, step_range: Column) -> Column:
    """Base time plus a step 'n' or the later end of 'a-b', in hours."""
    parts = F.split(step_range, "-")
    return base + F.make_dt_interval(F.lit(0), F.element_at(parts, -1).cast("int"))


def hour_angle(ts: Column, lon_degrees: Column) -> Column:
    """Solar hour angle in radians by the low-precision equation of time."""
    b = 2 * F.pi() * (F.dayofyear(ts) - 81) / 364
    equation = 9.87 * F.sin(2 * b) - 7.53 * F.cos(b) - 1.5 * F.sin(b)
    minutes = F.hour(ts) * 60 + F.minute(ts) + F.second(ts) / 60 + 4 * lon_degrees + equation
    return F.radians(minutes / 4 - 180)


def circular_mean(angle: Column, period: float = 6.283185307179586) -> Column:
    """Aggregate: mean of angles on a circle."""
    k = 6.283185307179586 / period
    return F.atan2(F.avg(F.sin(angle * k)), F.avg(F.cos(angle * k))) / k


def days_to_seconds(days: Column) -> Column:
    return days * 86400


def hours_to_seconds(hours: Column) -> Column:
    return hours * 3600
