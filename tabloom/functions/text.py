"""Scalar expressions on text: folding, coercion, list literals, placeholders, patterns."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, functions as F, types as T

# --- Fixed values: they decide results and must stay exactly as they are. ---
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
]
PLACEHOLDERS = ["", "--", "-", "na", "n/a", "nan", "none", "null", "false", "yes", "no", "maybe", "[]", "{}"]
TRUE_WORDS = ["yes", "true", "1", "1.0"]
FALSE_WORDS = ["no", "false", "0", "0.0"]
EMPTY_WORDS = ["nan", "null", "none", ""]
NUMERIC_LOOK = r"^\s*-?[\d,]+(\.\d+)?\s*$"
ID_PREFIX_LOOK = r"^[A-Za-z_#\-/]+\d+[A-Za-z0-9_\-/]*$"
HINT_PATTERNS = {
    "datetime": r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}(:\d{2})?Z?)?$|^\d{2}[/\-]\d{2}[/\-]\d{4}$|^[A-Za-z]{3}\s+\d{1,2}\s+\d{4}$",
    "email": r"^[^@\s]+@[^@\s]+\.[^@\s]+$",
    "url": r"^https?://",
    "uuid": r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
}
LABEL_SEPARATORS = r"\s*[,;|/]\s*"
# --- end of fixed values ---

_FLOAT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_BLANKS = r"[\s\x1c-\x1f]+"
_ITEM = r"""('(?:[^'\\]|\\.)*+'|"(?:[^"\\]|\\.)*+"|[+-]?\d[\d.eE+-]*+|True|False|None)"""
_LIST = r"^[\[\(]\s*+(?:" + _ITEM + r"\s*+(?:,\s*+" + _ITEM + r"\s*+)*+,?+\s*+)?[\]\)]$"


@lru_cache(maxsize=1)
def _fold_tables() -> tuple[str, str, dict[str, str]]:
    """Compatibility decomposition of every code point, reduced to ASCII.

    Decomposition works per character and every combining mark is outside ASCII, so a per-character table is exact.
    Returns one-to-one source characters, their targets, and the characters that expand to several.
    """
    sources, targets, longer = [], [], {}
    for code in range(0x80, sys.maxunicode + 1):
        char = chr(code)
        plain = unicodedata.normalize("NFKD", char).encode("ascii", "ignore").decode()
        if len(plain) == 1:
            sources.append(char)
            targets.append(plain)
        elif plain:
            longer[char] = plain
    return "".join(sources), "".join(targets), longer


def fold_ascii(c: Column) -> Column:
    """Accents and compatibility forms to ASCII; whatever has no ASCII form is dropped.

    ASCII text (the common case) takes the first branch; the table branches only run on rows that need them.
    """
    sources, targets, longer = _fold_tables()
    simple = F.regexp_replace(F.translate(c, sources, targets), r"[^\x00-\x7f]", "")
    # substitute the expanding characters one by one only in rows that hold one
    mapping = F.str_to_map(F.lit("\x02".join(f"{k}\x01{v}" for k, v in longer.items())), F.lit("\x02"), F.lit("\x01"))
    expanded = F.array_join(
        F.transform(F.regexp_extract_all(c, F.lit(r"(?s)."), 0), lambda ch: F.coalesce(F.element_at(mapping, ch), ch)), ""
    )
    full = F.regexp_replace(F.translate(expanded, sources, targets), r"[^\x00-\x7f]", "")
    expanding = "[" + "".join(longer) + "]"
    return (
        F.when(~c.rlike(r"[^\x00-\x7f]"), c)
        .when(~c.rlike(expanding), simple)
        .otherwise(full)
    )


def squeeze(c: Column) -> Column:
    """Runs of white space become one blank; ends are trimmed."""
    return F.trim(F.regexp_replace(c, _BLANKS, " "))


def strip(c: Column) -> Column:
    """Trim every kind of ASCII white space, not only blanks."""
    return F.trim(c, F.lit(" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f"))


def value_text(c: Column, dtype: T.DataType) -> Column:
    """Text of a value as people write it: doubles without exponent notation, nested values as JSON."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        text = c.cast("string")
        size = F.abs(c)
        plain = F.regexp_replace(F.regexp_replace(text.cast("decimal(38,18)").cast("string"), r"0+$", ""), r"\.$", ".0")
        out_of_range = ((size >= 1e7) & (size < 1e16)) | ((size < 1e-3) & (size >= 1e-4))
        return F.when(~F.isnan(c), F.when(out_of_range, plain).otherwise(text))
    if isinstance(dtype, (T.StructType, T.MapType, T.ArrayType, T.VariantType)):
        return F.to_json(c)
    if isinstance(dtype, T.BinaryType):
        return F.decode(c, "UTF-8")
    return c.cast("string")


def stable_token(c: Column, dtype: T.DataType) -> Column:
    """A comparable text for nested values; map entries are sorted by key first."""
    if isinstance(dtype, T.MapType):
        return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(c))))
    return value_text(c, dtype)


def na_to_null(c: Column) -> Column:
    return F.when(~F.trim(c).isin(NA_TOKENS), c)


def to_number(c: Column, dtype: T.DataType | None = None) -> Column:
    """Numeric value, or null when the text is no number. Infinities and NaN count as missing."""
    if isinstance(dtype, T.NumericType):
        d = c.cast("double")
        return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)
    if isinstance(dtype, T.BooleanType):
        return c.cast("double")
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.lit(None).cast("double")
    s = strip(c.cast("string"))
    return F.when(s.rlike(_FLOAT), s.try_cast("double"))


def to_boolean(c: Column) -> Column:
    word = F.lower(c.cast("string"))
    return F.when(word.isin(TRUE_WORDS), F.lit(True)).when(word.isin(FALSE_WORDS), F.lit(False))


def looks_numeric(c: Column) -> Column:
    return c.rlike(NUMERIC_LOOK)


def looks_id_prefix(c: Column) -> Column:
    return c.rlike(ID_PREFIX_LOOK)


def word_count(c: Column) -> Column:
    text = squeeze(c)
    return F.when(text == "", F.lit(0)).otherwise(F.size(F.split(text, " ")))


def hint_match(c: Column, hint: str) -> Column:
    return strip(c).rlike(HINT_PATTERNS[hint])


def drop_zero_tail(c: Column) -> Column:
    """Identifier text: trimmed, without a trailing ``.0``. Text without ``.0`` in it, the common case, meets no pattern."""
    s = strip(c.cast("string"))
    return F.when(s.contains(".0"), F.regexp_replace(s, r"\.0+$", "")).otherwise(s)


def is_list_literal(c: Column) -> Column:
    return strip(c).rlike(_LIST)


def list_literal_items(c: Column) -> Column:
    """Items of text such as ``['a', "b"]`` or ``[101, 102]``; null when the text is no flat list literal."""
    def unquote(item: Column) -> Column:
        inner = F.substring(item, F.lit(2), F.length(item) - 2)
        return F.when(item.rlike("^['\"]"), F.regexp_replace(inner, r"\\(.)", "$1")).otherwise(item)

    found = F.regexp_extract_all(strip(c), F.lit(_ITEM), 1)
    return F.when(is_list_literal(c), F.transform(found, unquote))


def first_item(c: Column) -> Column:
    """First item of a list literal; other text (also an empty list literal) stays as it is, trimmed."""
    items = list_literal_items(c)
    return F.when(F.size(items) > 0, F.element_at(items, 1)).otherwise(strip(c))


def tokens(c: Column) -> Column:
    """Items of a list literal, or the trimmed text as the only item. Items spelled ``None`` are missing."""
    items = F.filter(list_literal_items(c), lambda x: x != "None")
    return F.when(c.isNull(), F.array().cast("array<string>")).otherwise(F.coalesce(items, F.array(strip(c))))


def cell_text(c: Column) -> Column:
    """The trimmed text of a cell, or null where it is a placeholder word and so holds no token."""
    s = strip(c)
    return F.when(~F.lower(s).isin(PLACEHOLDERS), s)


def opens_list(s: Column) -> Column:
    return F.substring(s, 1, 1).isin("[", "(")


def cell_tokens(s: Column) -> Column:
    """Clean tokens of a ``cell_text``. Only text that may be a list literal meets functions over arrays, which Spark does not
    compile."""
    listed = F.filter(F.transform(tokens(s), strip), lambda x: ~F.lower(x).isin(PLACEHOLDERS))
    return F.when(opens_list(s), listed).otherwise(F.array(s))


def maybe_tokens(c: Column) -> Column:
    """Tokens without placeholder words, or null. Text that cannot be a list literal, the common case, is one token."""
    s = cell_text(c)
    return F.when(s.isNotNull(), cell_tokens(s))


def clean_tokens(c: Column) -> Column:
    return F.coalesce(maybe_tokens(c), F.array().cast("array<string>"))


def first_clean(c: Column) -> Column:
    s = cell_text(c)
    return F.when(opens_list(s), F.get(cell_tokens(s), F.lit(0))).otherwise(s)


def parse_list(c: Column) -> Column:
    """Items of a list literal; plain text is one item; malformed bracket text and blanks give no item."""
    text = strip(c)
    bracketed = text.startswith("[") & text.endswith("]")
    none = F.array().cast("array<string>")
    return (
        F.when(c.isNull() | (text == ""), none)
        .when(bracketed, F.coalesce(list_literal_items(c), none))
        .otherwise(F.array(text))
    )


def split_labels(c: Column) -> Column:
    """Labels of a multi-valued cell: list literal first, then split on ``, ; | /``."""
    parts = F.transform(tokens(c), lambda x: F.split(strip(x), LABEL_SEPARATORS))
    return F.filter(F.flatten(parts), lambda x: x != "")


def round_even(c: Column, digits: int) -> Column:
    """Round half to even on the scaled double, the convention of array libraries."""
    scale = float(10**digits)
    return F.rint(c * scale) / scale
