"""Calendar expressions and filters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rastertime.functions.bands import dbl


def year(t: Column) -> Column:
    return F.year(t)


def year_fraction(t: Column) -> Column:
    """Day of year from 0 over the true length of the year."""
    days = F.dayofyear(F.make_date(F.year(t), F.lit(12), F.lit(31))).cast("double")
    return (F.dayofyear(t) - 1).cast("double") / days


def decimal_year(t: Column) -> Column:
    return F.year(t).cast("double") + year_fraction(t)


def year_day_code(t: Column, full: bool = True) -> Column:
    """year * 1000 + day of year, which sorts as a number; two-digit years unless ``full``."""
    return (F.year(t) if full else F.year(t) % 100) * 1000 + F.dayofyear(t)


def in_years(t: Column, first: int, last: int) -> Column:
    return F.year(t).between(first, last)


def in_dates(t: Column, start: str, end: str) -> Column:
    """Half-open."""
    return (t >= F.lit(start).cast("timestamp_ntz")) & (t < F.lit(end).cast("timestamp_ntz"))


def in_days(doy: Column, first: int, last: int) -> Column:
    """Days of the year, both ends included; first > last wraps over New Year."""
    return doy.between(first, last) if first <= last else (doy >= first) | (doy <= last)


def wrap_dates(first: int, last: int) -> tuple[int, int]:
    """Days to add to the end of a season that wraps, and 1 if the later year holds more of it."""
    if first <= last:
        return 0, 0
    return 365, int(last > 365 - first)


def window_year(t: Column, first: int, last: int) -> Column:
    """The year in which the season that holds ``t`` begins; NULL outside the season.

    A wrapped season runs from day ``first`` of a year to ``last`` - 1 + 365 days after that year's 1 January, so after a
    leap year it ends on day ``last`` - 1 of the next.
    """
    doy, y = F.dayofyear(t), F.year(t)
    if first <= last:
        return F.when(doy.between(first, last), y)
    leap = F.dayofyear(F.make_date(y - 1, F.lit(12), F.lit(31))) - 365
    return F.when(doy >= first, y).when(doy <= F.lit(last) - leap, y - 1)


def season_year(t: Column, first: int, last: int) -> Column:
    """The year that a season's composite is dated to: for a wrapped season, the one with more of its days.

    Days outside the season have a year too, those between two wrapped seasons that of the earlier; ``window_year`` tells
    which days are in it.
    """
    wraps, later = wrap_dates(first, last)
    return F.year(t) + F.when(F.dayofyear(t) >= first, later).otherwise(later - 1) if wraps else F.year(t)


def offset_date(t: Column, n: int, unit: str) -> Column:
    months = {"month": n, "year": 12 * n}
    return F.add_months(t, months[unit]) if unit in months else t + F.expr(f"INTERVAL {n} {unit}")


def stamp(y: Column, month: int = 6, day: int = 1) -> Column:
    """The date of an annual product."""
    return F.make_date(y, F.lit(month), F.lit(day))


def peak_day_to_date(fraction: Column) -> Column:
    """Month and day of a fraction of a 365-day year."""
    d = F.date_add(F.lit("2001-01-01").cast("date"), F.least(F.floor(fraction * dbl(365)).cast("int"), F.lit(364)))
    return F.struct(F.month(d).alias("month"), F.day(d).alias("day"))


def sun_angles(elevation: Column, azimuth: Column) -> dict[str, Column]:
    """Zenith and azimuth in radians from angles in degrees."""
    return {"zenith": F.radians(dbl(90) - elevation), "azimuth": F.radians(azimuth)}
