"""Dates in free text, with how precise and how sure they are."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
_MONTH = "(" + "|".join(MONTHS) + ")"
ISO = r"\b(\d{4}-\d{2}-\d{2})\b"
MONTH_DAY_YEAR = rf"(?i)\b{_MONTH}\s+(\d{{1,2}}),?\s+(\d{{4}})\b"
MONTH_YEAR = rf"(?i)\b{_MONTH}\s+(\d{{4}})\b"
YEAR = r"\b(20\d{2})\b"
ONLY_A_DATE = rf"(?i)^\s*(\d{{4}}-\d{{2}}-\d{{2}}|{_MONTH}\s+\d{{1,2}},?\s+\d{{4}}|{_MONTH}\s+\d{{4}})\s*$"


def _result(day: Column, precision: str, confidence: str) -> Column:
    return F.struct(day.alias("date"), F.lit(precision).alias("precision"), F.lit(confidence).alias("confidence"))


def parse_date(text: Column) -> Column:
    """A struct of date, precision (day, month, year) and confidence (exact, inferred).

    The first of these that the text holds counts: an ISO date, month, day and year, month and year, a year from 2000 to
    2099. A date that no calendar has is null, of the form's precision.
    """
    get = lambda pattern, k: F.regexp_extract(text, pattern, k)
    mdy = F.concat_ws(" ", F.initcap(F.lower(get(MONTH_DAY_YEAR, 1))), get(MONTH_DAY_YEAR, 2), get(MONTH_DAY_YEAR, 3))
    my = F.concat_ws(" ", F.initcap(F.lower(get(MONTH_YEAR, 1))), F.lit("1"), get(MONTH_YEAR, 2))
    return (
        F.when(get(ISO, 1) != "", _result(F.try_to_date(get(ISO, 1), "yyyy-MM-dd"), "day", "exact"))
        .when(get(MONTH_DAY_YEAR, 1) != "", _result(F.try_to_date(mdy, "MMMM d yyyy"), "day", "exact"))
        .when(get(MONTH_YEAR, 1) != "", _result(F.try_to_date(my, "MMMM d yyyy"), "month", "exact"))
        .when(get(YEAR, 1) != "", _result(F.try_to_date(F.concat(get(YEAR, 1), F.lit("-01-01")), "yyyy-MM-dd"), "year", "inferred"))
        .otherwise(_result(F.lit(None).cast("date"), "day", "inferred"))
    )


def parse_date_cell(cell: Column) -> Column:
    """parse_date() of a cell that holds a date and nothing else; no date otherwise."""
    return F.when(cell.rlike(ONLY_A_DATE), parse_date(cell)).otherwise(_result(F.lit(None).cast("date"), "day", "inferred"))


def feed_date(published: Column, updated: Column) -> Column:
    """The date of a feed entry: published, else updated, in RFC 822 or ISO form."""
    one = lambda t: F.coalesce(
        F.try_to_timestamp(F.regexp_replace(F.regexp_replace(t, r"^\w{3},\s*", ""), r"\s(GMT|UTC|UT|Z)$", " +0000"), F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(t)
    )
    found = F.coalesce(one(published), one(updated)).cast("date")
    return F.when(found.isNotNull(), _result(found, "day", "exact")).otherwise(_result(found, "day", "inferred"))


def iso_week(day: Column) -> Column:
    return F.concat(F.extract(F.lit("YEAROFWEEK"), day).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))
