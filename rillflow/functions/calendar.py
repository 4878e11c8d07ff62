"""Calendar expressions: aggregation labels, day counts, date codes, Australian time zones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]


def aggindex(ts: Column, step: str) -> Column:
    """Integer label of a time: AS (year), AS-MON (water year that ends in MON), MS, D or h."""
    if step == "AS":
        return F.year(ts)
    if step.startswith("AS-") and step[3:] in MONTHS:
        return F.year(F.add_months(ts, 11 - MONTHS.index(step[3:]))) - 1
    month = F.year(ts) * 100 + F.month(ts)
    if step == "MS":
        return month
    if step == "D":
        return month * 100 + F.day(ts)
    if step == "h":
        return (month * 100 + F.day(ts)) * 100 + F.hour(ts)
    raise ValueError(f"unknown time step {step!r}: expected AS, AS-MON, MS, D or h")


def is_leap_year(year: Column) -> Column:
    return ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)


def days_in_month(year: Column, month: Column) -> Column:
    """-1 for an invalid month."""
    return F.when(month.between(1, 12), F.day(F.last_day(F.make_date(year, F.least(F.greatest(month, F.lit(1)), F.lit(12)), F.lit(1))))).otherwise(-1)


def day_of_year(day: Column) -> Column:
    """1..365 in every year: 29 February shares the place of 1 March, 60."""
    return F.dayofyear(day) - F.when(is_leap_year(F.year(day)) & (F.month(day) > 2), 1).otherwise(0)


def add_month(day: Column) -> Column:
    return F.add_months(day, 1)


def add_day(day: Column) -> Column:
    return F.date_add(day, 1)


def date_of_code(code: Column) -> Column:
    """Date of a number like 20010131; NULL if there is no such day."""
    text = F.lpad(F.floor(code).cast("bigint").cast("string"), 8, "0")
    return F.try_to_timestamp(text, F.lit("yyyyMMdd")).cast("date")


def compare_dates(a: Column, b: Column) -> Column:
    """1 if `a` is before `b`, -1 if after, 0 if equal."""
    return F.signum(F.datediff(b, a)).cast("int")


def binomial(n: Column, k: Column) -> Column:
    """n over k; -1 where k or n - k exceeds 30."""
    out = F.aggregate(F.sequence(F.lit(1), F.greatest(k.cast("int"), F.lit(1))), F.lit(1.0), lambda a, i: F.when(i > k, a).otherwise(a * (n - k + i) / i))
    return F.when((k > 30) | (n - k > 30), -1).otherwise(F.round(out)).cast("bigint")


def oz_timezone(lon: Column, lat: Column) -> Column:
    """Name of the time zone of a place in Australia."""
    west = F.when(lon < 129, "Australia/Perth")
    middle = west.when(lon < 141, F.when(lat < -26, "Australia/Adelaide").when(lon > 138, "Australia/Brisbane").otherwise("Australia/Darwin"))
    return middle.otherwise(F.when(lat < -29, "Australia/Sydney").otherwise("Australia/Brisbane"))
