"""Numbers and dates from text; null where there is none.  Casts are guarded."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip_edges

NUMBER = r"^[+-]?([0-9]+([.][0-9]+)?|[.][0-9]+)$"
FIRST = r"[+-]?[0-9]+([.][0-9]+)?"


def safe_number(c: Column) -> Column:
    c = F.trim(c)
    return F.when(c.rlike(NUMBER), c.try_cast("double"))


def parse_debris(c: Column) -> Column:
    """struct(value, debris): a strict number, else a numeric prefix and junk."""
    t = F.regexp_replace(strip_edges(F.regexp_replace(c, r"[\[\](){}]", "")), ",", ".")
    prefix = F.regexp_extract(t, r"^([+-]?[0-9]+([.][0-9]+)?)[^A-Za-z0-9_%:]+$", 1)
    value = F.coalesce(safe_number(t), safe_number(prefix))
    return F.struct(value.alias("value"), (value.isNotNull() & ~t.rlike(NUMBER)).alias("debris"))


def first_number(c: Column) -> Column:
    """The first number; null for dates and for a number before a colon."""
    bad = c.rlike(r"[0-9]{1,4}[/-][0-9]{1,2}[/-][0-9]{1,4}") | c.rlike(r"[0-9] *:")
    return F.when(~bad, safe_number(F.regexp_extract(F.replace(c, F.lit(","), F.lit(".")), f"({FIRST})", 1)))


def prefix_number(c: Column) -> Column:
    return safe_number(F.regexp_extract(F.trim(c), r"^([+-]?[0-9]+([.][0-9]+)?)", 1))


def typed_value(c: Column, kind: Column) -> Column:
    """Text fields have no number; a final per cent sign is dropped."""
    return F.when(kind != "text", first_number(F.regexp_replace(c, "%$", "")))


def percent_gauge(c: Column) -> Column:
    """A gauge of per cent above 100 lost its point: a tenth or a hundredth, if within 0..100."""
    v = F.when(c > 1000, c / 100).when(c > 100, c / 10).otherwise(c)
    return F.when(v.between(0, 100), v)


def report_date(c: Column) -> Column:
    """ISO first, then month/day/year (two digits: 2000 on)."""
    iso = F.regexp_extract(c, r"([0-9]{4}-[0-9]{2}-[0-9]{2})", 1)
    m, d, y = (F.regexp_extract(c, r"([0-9]{1,2})/([0-9]{1,2})/([0-9]{4}|[0-9]{2})", i) for i in (1, 2, 3))
    year = F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).otherwise(y)
    us = F.when(y != "", F.concat_ws("-", year, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")))
    return F.coalesce(F.when(iso != "", iso).try_cast("date"), us.try_cast("date"))


def month_key(c: Column) -> Column:
    return F.year(c) * 100 + F.month(c)
