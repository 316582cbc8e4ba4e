"""Dates of partial precision as strings: YYYY-MM, YYYY or present."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words and shapes of dates.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
OPEN = ("present", "current", "now", "ongoing", "till date", "to date")
YEAR = r"(?:19|20)\d{2}"
NAMED = rf"(?:{'|'.join(MONTHS)})[a-z]*\.?,?\s+"
NUMERIC = r"(?:0?[1-9]|1[0-2])[/.]"
ISO = rf"{YEAR}-(?:0[1-9]|1[0-2])(?:-[0-3]\d)?"
TOKEN = rf"(?:{ISO}|(?:{NAMED}|{NUMERIC})?{YEAR}|{'|'.join(OPEN)})"
RANGE = rf"(?<![\w/.])({TOKEN})(?:\s*(?:-|–|—|\bto\b|\buntil\b)\s*({TOKEN}))?(?![\w/])"
VALID = r"^(\d{4}(-(0[1-9]|1[0-2]))?|present)$"
#: `present` sorts after every month.
LAST = 1_000_000


def iso(token: Column) -> Column:
    """A date as it is written -> YYYY-MM, YYYY or present."""
    t = F.trim(token)
    year, name, number = F.regexp_extract(t, rf"({YEAR})$", 1), F.lower(F.regexp_extract(t, rf"(?i)^({NAMED}){YEAR}$", 1)), F.regexp_extract(t, rf"^({NUMERIC}){YEAR}$", 1)
    month = F.lpad((F.array_position(F.lit(list(MONTHS)), F.substring(name, 1, 3))).cast("string"), 2, "0")
    return (
        F.when(t.rlike(rf"^{ISO}$"), F.substring(t, 1, 7))
        .when(name != "", F.concat_ws("-", year, month))
        .when(number != "", F.concat_ws("-", year, F.lpad(F.regexp_replace(number, "[/.]", ""), 2, "0")))
        .when(t.rlike(rf"^{YEAR}$"), t)
        .otherwise("present")
    )


def ranges(text: Column) -> Column:
    """All dates and ranges of a text as array<struct<start, end>>; a lone date is a start, a lone open word is none."""
    firsts, seconds = (F.regexp_extract_all(text, F.lit("(?iU)" + RANGE), F.lit(k)) for k in (1, 2))
    pairs = F.arrays_zip(firsts.alias("a"), seconds.alias("b"))
    dated = F.filter(pairs, lambda p: (p["b"] != "") | ~F.lower(p["a"]).isin(*OPEN))
    return F.transform(dated, lambda p: F.struct(iso(p["a"]).alias("start"), F.when(p["b"] != "", iso(p["b"])).alias("end")))


def whole_range(text: Column) -> Column:
    """The one date or range that a text is, or null."""
    return F.when(text.rlike(rf"\A(?iU){RANGE}\z") & (F.size(ranges(text)) == 1), F.get(ranges(text), F.lit(0)))


def month_index(value: Column) -> Column:
    """A number by which dates sort: months since year 0, a bare year being its January, present after all."""
    year, month = F.substring(value, 1, 4).cast("int"), F.substring(value, 6, 2)
    return F.when(value == "present", LAST).otherwise(year * 12 + F.when(month == "", 1).otherwise(month.cast("int")) - 1)


#: strftime codes -> Spark's patterns.
_CODES = {"%b": "MMM", "%B": "MMMM", "%Y": "yyyy", "%y": "yy", "%m": "MM"}


def spark_pattern(strftime: str) -> str:
    for code, pattern in _CODES.items():
        strftime = strftime.replace(code, pattern)
    if "%" in strftime:
        raise ValueError(f"date format {strftime!r}: there are {', '.join(_CODES)}")
    return strftime


def shown(value: Column, strftime: str = "%b %Y") -> Column:
    """A date as it is rendered."""
    month = F.date_format(F.to_date(F.when(value.contains("-"), value), "yyyy-MM"), spark_pattern(strftime))
    return F.when(value == "present", "Present").when(value.contains("-"), month).otherwise(value)


def shown_range(start: Column, end: Column, strftime: str = "%b %Y") -> Column:
    """Start and end with a dash, whichever there are."""
    return F.concat_ws(" – ", shown(start, strftime), shown(end, strftime))
