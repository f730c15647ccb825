"""Date and time functions, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def part(field: str, ts: Column) -> Column:
    """extract/date_part, with Sunday as day 0 and the fields Spark lacks."""
    year = F.year(ts)
    found = {
        "dow": F.dayofweek(ts) - 1, "isodow": (F.dayofweek(ts) + 5) % 7 + 1, "doy": F.dayofyear(ts),
        "epoch": F.unix_micros(ts.cast("timestamp")) / 1e6, "decade": F.floor(year / 10),
        "century": F.ceil(year / 100), "millennium": F.ceil(year / 1000), "week": F.weekofyear(ts),
    }
    return found[field].cast("double") if field in found else F.date_part(F.lit(field), ts).cast("double")


def trunc(unit: str, ts: Column) -> Column:
    """date_trunc, with decade, century and millennium."""
    years = {"decade": 10, "century": 100, "millennium": 1000}
    if unit not in years:
        return F.date_trunc(unit, ts)
    n = years[unit]
    first = F.floor(F.year(ts) / n) * n if unit == "decade" else F.floor((F.year(ts) - 1) / n) * n + 1
    return F.make_date(first.cast("int"), F.lit(1), F.lit(1)).cast("timestamp")


def overlaps(a: Column, b: Column, c: Column, d: Column) -> Column:
    """(a, b) OVERLAPS (c, d): half-open periods whose ends may be swapped; a
    period of no length is a point."""
    s1, e1, s2, e2 = F.least(a, b), F.greatest(a, b), F.least(c, d), F.greatest(c, d)
    return F.when(s1 == s2, F.lit(True)).when(s1 < s2, s2 < e1).otherwise(s1 < e2)


def days_between(a: Column, b: Column) -> Column:
    """date - date as a whole number of days."""
    return F.datediff(a, b)


def add_months_stepwise(start: Column, steps: Column, months: int) -> Column:
    """``steps`` single steps of some months; each clamps to its month's end."""
    return F.when(steps <= 0, start).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(steps, F.lit(1)).cast("int")), start, lambda t, _: F.add_months(t, months)))


#: Template patterns and their pattern letters in Spark.
TEMPLATES = (
    ("YYYY", "yyyy"), ("MONTH", "MMMM"), ("Month", "MMMM"), ("Mon", "MMM"), ("MM", "MM"), ("DDD", "DDD"), ("DD", "dd"),
    ("HH24", "HH"), ("HH12", "hh"), ("HH", "hh"), ("MI", "mm"), ("SS", "ss"), ("MS", "SSS"), ("US", "SSSSSS"), ("Day", "EEEE"), ("Dy", "EEE"), ("AM", "a"), ("PM", "a"), ("Q", "Q"),
)


def template(text: str) -> str:
    out, i = "", 0
    while i < len(text):
        for name, spark in TEMPLATES:
            if text.startswith(name, i):
                out, i = out + spark, i + len(name)
                break
        else:
            out, i = out + (f"'{text[i]}'" if text[i].isalpha() else text[i]), i + 1
    return out


def to_char(ts: Column, text: str) -> Column:
    return F.date_format(ts, template(text))


def to_date(value: Column, text: str) -> Column:
    return F.to_date(value, template(text))


def justify_hours(days: Column, micros: Column) -> tuple[Column, Column]:
    """Whole days of 24 hours move to the days: (days, microseconds)."""
    day = F.lit(86_400_000_000)
    moved = F.when(micros >= 0, F.floor(micros / day)).otherwise(F.ceil(micros / day))
    return days + moved, micros - moved * day


def justify_days(months: Column, days: Column) -> tuple[Column, Column]:
    """Whole months of 30 days move to the months: (months, days)."""
    moved = F.when(days >= 0, F.floor(days / 30)).otherwise(F.ceil(days / 30))
    return months + moved, days - moved * 30


def justify_interval(months: Column, days: Column, micros: Column) -> tuple[Column, Column, Column]:
    """Hours move to the days, days to the months, and all take one sign."""
    days, micros = justify_hours(days, micros)
    months, days = justify_days(months, days)
    back = (months > 0) & ((days < 0) | ((days == 0) & (micros < 0)))
    on = (months < 0) & ((days > 0) | ((days == 0) & (micros > 0)))
    turn = F.when(back, -1).when(on, 1).otherwise(0)
    months, days = months + turn, days - turn * 30
    back, on = (days > 0) & (micros < 0), (days < 0) & (micros > 0)
    turn = F.when(back, -1).when(on, 1).otherwise(0)
    return months, days + turn, micros - turn * F.lit(86_400_000_000)


def at_time_zone(local: Column, zone: str) -> Column:
    """The instant of a local time in a zone (a timestamp of the session)."""
    return F.to_utc_timestamp(local.cast("timestamp"), zone)


def in_time_zone(instant: Column, zone: str) -> Column:
    """The local time of an instant in a zone."""
    return F.from_utc_timestamp(instant, zone)


def to_timestamp(value: Column, text: str) -> Column:
    return F.to_timestamp(value, template(text))


def from_epoch(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def difference(a: Column, b: Column) -> tuple[Column, Column]:
    """timestamp - timestamp: whole days and the rest in microseconds."""
    micros = F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))
    return justify_hours(F.lit(0).cast("long"), micros)


def times(days: Column, micros: Column, factor: Column) -> tuple[Column, Column]:
    """interval * number: a part of a day goes to the time."""
    exact = days * factor
    whole = F.when(exact >= 0, F.floor(exact)).otherwise(F.ceil(exact))
    return whole, F.round(micros * factor + (exact - whole) * F.lit(86_400_000_000)).cast("long")


def add_interval(ts: Column, days: Column, micros: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(ts.cast("timestamp")) + days.cast("long") * F.lit(86_400_000_000) + micros)


def date_plus_time(day: Column, hours: Column, minutes: Column) -> Column:
    return add_interval(day.cast("timestamp"), F.lit(0), (hours * 60 + minutes).cast("long") * F.lit(60_000_000).cast("long"))
