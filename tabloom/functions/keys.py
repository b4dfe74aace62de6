"""Join-key normalisation: six ways to turn a raw value into a comparable text key."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from .dates import parse_date
from .text import fold_ascii, squeeze, to_number, value_text

EXACT, CASEFOLD, NUMERIC, DATE, ID_STRIP, SLUG = "exact", "casefold", "numeric", "date", "id_strip", "slug"
STRATEGIES = (EXACT, CASEFOLD, NUMERIC, DATE, ID_STRIP, SLUG)


def _blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _from_text(text: Column, strategy: str) -> Column:
    if strategy == EXACT:
        return text
    if strategy == CASEFOLD:
        return _blank_to_null(F.lower(squeeze(fold_ascii(text))))
    if strategy == NUMERIC:
        plain = F.replace(text, F.lit(","), F.lit(""))
        number = to_number(plain)
        whole = (number == F.rint(number)) & (F.abs(number) < 1e37)
        # up to 15 digits a double holds the same integer, so plain integers need no floating point
        return (
            F.when(plain.rlike(r"^[+-]?\d{1,15}$"), plain.try_cast("bigint").cast("string"))
            .when(whole, number.try_cast("decimal(38,0)").cast("string")).otherwise(number.cast("string"))
        )
    if strategy == DATE:
        return F.date_format(parse_date(text), "yyyy-MM-dd")
    if strategy == ID_STRIP:
        digits = F.regexp_replace(text, r"[^0-9]+", "")
        return F.when(digits != "", F.regexp_replace(digits, r"^0+(?=.)", ""))
    if strategy == SLUG:
        return _blank_to_null(F.regexp_replace(F.lower(fold_ascii(text)), r"[^a-z0-9]", ""))
    raise ValueError(f"unknown key strategy: {strategy}")


def id_text(c: Column, dtype: T.DataType) -> Column:
    """Value text in which integral doubles read as integers, so ``42.0`` keeps the digits of 42."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        integral = (c == F.rint(c)) & (F.abs(c) < 9e15)
        return F.when(integral, c.cast("bigint").cast("string")).otherwise(value_text(c, dtype))
    return value_text(c, dtype)


def join_key(c: Column, dtype: T.DataType, strategy: str) -> Column:
    """Key of a typed column. Types that already carry the meaning skip the text round trip."""
    if strategy == DATE and isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd")
    if strategy == ID_STRIP:
        return _from_text(id_text(c, dtype), strategy)
    return _from_text(value_text(c, dtype), strategy)


def key_of_text(text: Column, digits_text: Column, folded: Column, strategy: Column) -> Column:
    """Key chosen per row by a strategy column; used where many columns are stacked into one.

    ``folded`` is ``fold_ascii(text)``, computed once by the caller for the two strategies that need it.
    """
    return (
        F.when(strategy == EXACT, text)
        .when(strategy == CASEFOLD, _blank_to_null(F.lower(squeeze(folded))))
        .when(strategy == SLUG, _blank_to_null(F.regexp_replace(F.lower(folded), r"[^a-z0-9]", "")))
        .when(strategy == NUMERIC, _from_text(text, NUMERIC))
        .when(strategy == DATE, _from_text(text, DATE))
        .when(strategy == ID_STRIP, _from_text(digits_text, ID_STRIP))
    )


def typed_key(c: Column, dtype: T.DataType, text: Column, strategy: str) -> Column:
    """Key of a whole number or a double, the same as that of its ``text``, which is only read where the number itself does
    not tell."""
    read = _from_text(text, strategy)
    if isinstance(dtype, T.IntegralType):
        c = c.cast("bigint")
        if strategy in (EXACT, CASEFOLD):
            return text
        if strategy == NUMERIC:
            return F.when((c > -(10**15)) & (c < 10**15), text).otherwise(read)
        if strategy == DATE:
            return F.when(may_be_date(c), read)
        return F.when(c >= 0, text).otherwise(read)
    if strategy == CASEFOLD:
        return F.lower(text)
    if strategy == NUMERIC:
        size = F.abs(c)
        # tenths of thousandths have lost digits in their text
        whole = F.when((c == F.rint(c)) & (size < 1e37), c.try_cast("decimal(38,0)").cast("string")).otherwise(c.cast("string"))
        return F.when((size >= 1e-4) & (size < 1e-3), read).when(~F.isnan(c) & (size != float("inf")), whole)
    if strategy == DATE:
        return F.lit(None).cast("string")
    if strategy == ID_STRIP:
        digits = F.translate(id_text(c, dtype), "-.E+", "")
        return F.when(F.abs(c) != float("inf"), F.when(digits.startswith("0"), F.regexp_replace(digits, r"^0+(?=.)", "")).otherwise(digits))
    return read


def may_be_date(c: Column) -> Column:
    """Whole numbers of four or eight digits, the only ones that can read as a date."""
    return c.between(1000, 9999) | c.between(10_000_000, 99_999_999)
