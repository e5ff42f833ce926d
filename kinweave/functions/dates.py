"""Imprecise dates: parsing, formatting and comparison as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import once

#: Beginnings of month names in English, German, French and Russian.
MONTHS = (
    (1, "jan|янв"), (2, "feb|fév|фев"), (3, "mar|mär|мар"), (4, "apr|avr|апр"), (5, "may|mai|май|мая"), (6, "jun|juin|июн"),
    (7, "jul|juil|июл"), (8, "aug|aoû|авг"), (9, "sep|сен"), (10, "oct|okt|окт"), (11, "nov|ноя"), (12, "dec|dez|déc|дек"),
)
MODIFIER = r"(?iu)^(ABT|ABOUT|BEF|BEFORE|AFT|AFTER|EST|CAL|BET)\.? +"


def parse(text: Column) -> Column:
    """struct(year, month, day, precision, modifier): precision 0 year, 1 month, 2 day; null without a year."""
    mark = F.upper(F.substring(F.regexp_extract(text, MODIFIER, 1), 1, 3))
    body = F.lower(F.regexp_replace(F.regexp_replace(text, MODIFIER, ""), "(?iu) AND .*$", ""))
    number = lambda b, n: F.nullif(F.regexp_extract(b, rf"(?<![0-9])([0-9]{{{n}}})(?![0-9])", 1), F.lit("")).cast("int")

    def month_of(b: Column) -> Column:
        found = F.lit(None).cast("int")
        for n, names in MONTHS:
            found = F.when(b.rlike(rf"(?<![\p{{L}}])({names})"), n).otherwise(found)
        return found

    def dated(p: Column) -> Column:
        last = F.dayofmonth(F.last_day(F.make_date(p["year"], F.coalesce(p["month"], F.lit(1)), F.lit(1))))
        whole = p["month"].isNotNull() & p["day"].between(1, 31) & (p["day"] <= last)
        precision = F.when(whole, 2).when(p["month"].isNotNull(), 1).otherwise(0)
        found = F.struct(p["year"].alias("year"), p["month"].alias("month"), F.when(whole, p["day"]).alias("day"), precision.alias("precision"), F.nullif(mark, F.lit("")).alias("modifier"))
        return F.when(p["year"].isNotNull(), found)

    parts = lambda b: F.struct(number(b, "4").alias("year"), month_of(b).alias("month"), number(b, "1,2").alias("day"))
    return once(once(body, parts), dated)


def form(date: Column) -> Column:
    """YYYY, YYYY-MM or YYYY-MM-DD by precision."""
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    year = F.lpad(date["year"].cast("string"), 4, "0")
    return F.when(date["precision"] == 0, year).when(date["precision"] == 1, F.concat_ws("-", year, two(date["month"]))).otherwise(F.concat_ws("-", year, two(date["month"]), two(date["day"])))


def similarity(year_a: Column, year_b: Column, precision_a: Column, precision_b: Column, equal_month: Column | None = None, equal_day: Column | None = None, soft: int = 5, most: int = 10) -> Column:
    """1 to 0: equal years by the smaller precision (years alone 0.90, other months 0.85, equal months 0.95, equal days 1), then by steps of the difference."""
    equal_month, equal_day = (F.lit(True) if x is None else x for x in (equal_month, equal_day))
    gap, least = F.abs(year_a - year_b), F.least(precision_a, precision_b)
    same = F.when(least == 0, 0.90).when(~equal_month, 0.85).when((least == 2) & equal_day, 1.0).otherwise(0.95)
    return F.when(gap == 0, same).when(gap == 1, 0.80).when(gap <= 2, 0.60).when(gap <= min(soft, most), 0.40).when(gap <= most, 0.20).otherwise(0.0)


#: Month names of the service's dates.
SERVICE_MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
LONG_MONTHS = ("JANUARY", "FEBRUARY", "MARCH", "APRIL", "MAY", "JUNE", "JULY", "AUGUST", "SEPTEMBER", "OCTOBER", "NOVEMBER", "DECEMBER")


def update_form(text: Column) -> Column:
    """struct(day, month, year) of an update's date: the first number of four digits, the first month of the year whose name occurs, the first number of one or two; null without a year."""
    body = F.regexp_replace(text, r"(?i)^(ABT|AFT|BEF|EST|CAL|BET)\s+", "")
    number = lambda b, n: F.nullif(F.regexp_extract(b, rf"(?<![\p{{L}}\p{{N}}_])([0-9]{{{n}}})(?![\p{{L}}\p{{N}}_])", 1), F.lit("")).cast("int")

    def month_of(b: Column) -> Column:
        month = F.lit(None).cast("int")
        for i, name in reversed(list(enumerate(SERVICE_MONTHS, 1))):
            month = F.when(F.contains(b, F.lit(name)), i).otherwise(month)
        return month

    parts = lambda b: F.struct(number(b, "1,2").alias("day"), month_of(b).alias("month"), number(b, "4").alias("year"))
    return once(once(F.upper(body), parts), lambda p: F.when(p["year"].isNotNull(), F.struct(F.when(p["day"].between(1, 31), p["day"]).alias("day"), p["month"].alias("month"), p["year"].alias("year"))))


def creation_form(text: Column) -> Column:
    """struct(day, month, year) of a new person's date, from its parts between blanks, hyphens and slashes, the last of a kind; null if there is none."""
    body = F.regexp_replace(text, r"(?i)^(ABT|AFT|BEF|EST|CAL)\s+", "")
    parts = F.filter(F.split(F.trim(F.upper(body)), r"[ \-/]"), lambda p: p != "")
    last = lambda kind, value: F.try_element_at(F.transform(F.filter(parts, kind), value), F.lit(-1))
    number = lambda p: p.try_cast("int")
    year = last(lambda p: p.rlike(r"^\+?[0-9]+$") & (F.length(p) == 4), number)
    day = last(lambda p: p.rlike(r"^\+?[0-9]+$") & (F.length(p) <= 2) & number(p).between(1, 31), number)
    place = lambda p: F.greatest(F.array_position(F.array(*map(F.lit, SERVICE_MONTHS)), p), F.array_position(F.array(*map(F.lit, LONG_MONTHS)), p))
    month = last(lambda p: place(p) > 0, lambda p: place(p).cast("int"))
    return F.when(F.coalesce(year, month, day).isNotNull(), F.struct(day.alias("day"), month.alias("month"), year.alias("year")))
