"""Date parsing without exceptions: shape tests by pattern, value tests by ``try_cast``."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from .text import strip

# --- Fixed values: month names. Day-first wins when a date is ambiguous. ---
MONTHS = [
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november",
    "december",
]
# --- end of fixed values ---


_YEAR = r"(\d{4})"
# digits alone are a year or a day only in a plausible range; dates with separators may have any year
_LIKELY = r"(167[89]|16[89]\d|1[7-9]\d\d|2[01]\d\d|22[0-5]\d|226[01])"
_YEAR_FIRST = rf"^{_YEAR}([-/])(\d{{1,2}})\2(\d{{1,2}})$"
_YEAR_LAST = rf"^(\d{{1,2}})([-/])(\d{{1,2}})\2{_YEAR}$"
_COMPACT = rf"^{_LIKELY}(\d\d)(\d\d)$"
_DAY_NAME = rf"^(\d{{1,2}})\s+([A-Za-z]{{3,9}})\s+{_YEAR}$"
_NAME_DAY = rf"^([A-Za-z]{{3,9}})\s+(\d{{1,2}})\s+{_YEAR}$"
_FREE = rf"^({_LIKELY}|{_YEAR}-\d{{1,2}}(-\d{{1,2}}([ T].*)?)?)$"
# one test that turns most other text away before the single shapes are tried
_ANY_SHAPE = r"^(\d{4}([-/]\d.*)?|\d{8}|\d{1,2}[-/]\d{1,2}[-/]\d{4}|\d{1,2}\s+[A-Za-z]{3,9}\s+\d{4}|[A-Za-z]{3,9}\s+\d{1,2}\s+\d{4})$"
_MONTH_NUMBERS = ",".join(
    f"{name}:{number}" for number, month in enumerate(MONTHS, 1) for name in dict.fromkeys([month, month[:3]]))


def parse_date(c: Column, dtype: T.DataType | None = None) -> Column:
    """Calendar date of a value, or null. Each shape rewrites the text to ISO form; a safe cast decides if it is a date."""
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return c.cast("date")
    s = strip(c.cast("string"))

    def iso(pattern: str, form: str) -> Column:
        return F.regexp_replace(s, pattern, form).try_cast("date")

    def named(pattern: str, month: int, form: str) -> Column:
        number = F.element_at(F.str_to_map(F.lit(_MONTH_NUMBERS), F.lit(","), F.lit(":")), F.lower(F.regexp_extract(s, pattern, month)))
        return F.replace(F.regexp_replace(s, pattern, form), F.lit("M"), number).try_cast("date")

    return (
        F.when(~s.rlike(_ANY_SHAPE), F.lit(None).cast("date"))
        .when(s.rlike(_YEAR_FIRST), iso(_YEAR_FIRST, "$1-$3-$4"))
        .when(s.rlike(_YEAR_LAST), F.coalesce(iso(_YEAR_LAST, "$4-$3-$1"), iso(_YEAR_LAST, "$4-$1-$3")))
        .when(s.rlike(_COMPACT), iso(_COMPACT, "$1-$2-$3"))
        .when(s.rlike(_DAY_NAME), named(_DAY_NAME, 2, "$3-M-$1"))
        .when(s.rlike(_NAME_DAY), named(_NAME_DAY, 1, "$3-M-$2"))
        .when(s.rlike(_FREE), s.try_cast("timestamp").cast("date"))
    )


def parse_timestamp(c: Column, dtype: T.DataType | None = None) -> Column:
    """Moment without zone: a full timestamp when the text is one, else the parsed date at midnight."""
    if isinstance(dtype, T.TimestampNTZType):
        return c
    if isinstance(dtype, (T.DateType, T.TimestampType)):
        return c.cast("timestamp_ntz")
    s = strip(c.cast("string"))
    with_time = F.regexp_replace(F.regexp_replace(s, r"Z$", ""), r"^(\d{4}-\d{1,2}-\d{1,2})T", "$1 ")
    precise = F.when(s.rlike(r"^\d{4}-\d{1,2}-\d{1,2}[ T]\d"), with_time.try_cast("timestamp_ntz"))
    return F.coalesce(precise, parse_date(s).cast("timestamp_ntz"))


def year_of(c: Column, dtype: T.DataType | None = None) -> Column:
    return F.year(parse_date(c, dtype))


def month_of(c: Column, dtype: T.DataType | None = None) -> Column:
    return F.month(parse_date(c, dtype))


def month_start(c: Column, dtype: T.DataType | None = None) -> Column:
    return F.trunc(parse_date(c, dtype), "month")
