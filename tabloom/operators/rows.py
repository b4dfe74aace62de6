"""Filters, unions, sampling, ordering and projections over whole rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.dates import month_of, year_of
from ..functions.names import columns_matching, pick_column
from ..functions.text import first_clean, first_item, to_number
from .shape import col, field_types, numeric_columns


def apply_filters(df: DataFrame, spec: Mapping[str, Any]) -> DataFrame:
    """Filters of a spec, all of which must hold; unknown columns are ignored.

    A list is membership, ``{min, max}`` an inclusive numeric range, ``{contains}`` a case-insensitive pattern,
    anything else equality. Tests on typed columns stay plain comparisons, so they reach the Parquet scan.
    """
    types = field_types(df)
    for name, wanted in spec.items():
        if name not in types:
            continue
        c = col(name)
        if isinstance(wanted, (list, tuple, set)):
            df = df.where(reduce(Column.__or__, [equals(c, types[name], w) for w in wanted], F.lit(False)))
        elif isinstance(wanted, Mapping):
            typed = isinstance(types[name], T.NumericType)
            number = c if typed else to_number(c, types[name])
            if wanted.get("min") is not None:
                df = df.where(number >= wanted["min"])
                if isinstance(types[name], (T.DoubleType, T.FloatType)):
                    df = df.where(~F.isnan(c))  # NaN sorts above every number
            if wanted.get("max") is not None:
                df = df.where(number <= wanted["max"])
            if wanted.get("contains") is not None:
                df = df.where(c.cast("string").rlike(f"(?i){wanted['contains']}"))
        else:
            df = df.where(equals(c, types[name], wanted))
    return df


def equals(c: Column, dtype: T.DataType, wanted: Any) -> Column:
    """Equality that never fails: values of another kind than the column's are compared as text."""
    kinds = {bool: T.BooleanType, int: T.NumericType, float: T.NumericType, str: T.StringType}
    if wanted is None or type(wanted) not in kinds or isinstance(dtype, kinds[type(wanted)]):
        return c == F.lit(wanted)
    if isinstance(wanted, str) and isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return c == F.lit(wanted).try_cast(dtype)
    return c.cast("string") == F.lit(str(wanted).lower() if isinstance(wanted, bool) else str(wanted))


def not_null(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(fields))


def with_aliases(df: DataFrame, aliases: Mapping[str, Sequence[str]], primary: bool = False) -> DataFrame:
    """Copy the first existing candidate of each canonical name; with ``primary`` also its first list item."""
    for name, candidates in aliases.items():
        source = pick_column(df.columns, [name, *candidates])
        if source is None:
            continue
        value = col(source)
        extra = {f"{name}_primary": first_item(value.cast("string"))} if primary else {}
        df = df.withColumns({**extra, name: value})
    return df


def coalesce_headers(df: DataFrame, headers: Sequence[str]) -> Column:
    """First clean value over all columns that match the headers, in header then column order."""
    matched = [c for h in headers for c in columns_matching(df.columns, h)]
    values = [first_clean(col(c).cast("string")) for c in dict.fromkeys(matched)]
    return F.coalesce(*values) if values else F.lit(None).cast("string")


def with_date_parts(df: DataFrame, field: str, year: str = "year", month: str = "month") -> DataFrame:
    dtype = field_types(df)[field]
    return df.withColumns({year: year_of(col(field), dtype), month: month_of(col(field), dtype)})


def with_null_flags(df: DataFrame, fields: Sequence[str], suffix: str = "_was_missing") -> DataFrame:
    return df.withColumns({f"{f}{suffix}": col(f).isNull().cast("int") for f in fields})


# Fixed values: (domain, words in the column name, rule, warning).
DOMAIN_RULES = [
    ("healthcare", ["age"], "above_120", "age above 120"),
    ("healthcare", ["pressure", "weight", "height"], "negative", "impossible negative value"),
    ("finance", ["price", "volume", "amount"], "negative", "negative price or amount"),
    ("education", ["grade", "score"], "outside_0_100", "score outside 0 to 100"),
]


def domain_anomalies(df: DataFrame, domain: str, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, rule, warning, rows)`` for every domain rule that some row breaks; one pass for all columns."""
    tests = {"above_120": lambda x: x > 120, "negative": lambda x: x < 0, "outside_0_100": lambda x: (x > 100) | (x < 0)}
    checks = [
        (c, rule, text) for c in (columns or numeric_columns(df)) for d, words, rule, text in DOMAIN_RULES
        if d == domain and any(w in c.lower() for w in words)
    ]
    schema = "column string, rule string, warning string, rows bigint"
    if not checks:
        return df.sparkSession.createDataFrame([], schema)
    one = df.agg(*[F.count_if(tests[rule](col(c))).alias(f"r{i}") for i, (c, rule, _) in enumerate(checks)])
    listed = F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(rule).alias("rule"), F.lit(text).alias("warning"), F.col(f"r{i}").alias("rows"))
        for i, (c, rule, text) in enumerate(checks)
    ])
    return one.select(F.inline(listed)).where(F.col("rows") > 0)


def union_ragged(*frames: DataFrame) -> DataFrame:
    """Rows of all frames by column name; a column missing in one is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def tagged_with_any(df: DataFrame, tags: str, wanted: Sequence[str]) -> DataFrame:
    return df.where(F.arrays_overlap(col(tags), F.array(*[F.lit(w) for w in wanted])))


def sort_nulls_last(df: DataFrame, *fields: str) -> DataFrame:
    return df.orderBy(*[col(f).asc_nulls_last() for f in fields])


def text_sample(df: DataFrame, field: str, n: int = 10, seed: int = 42, key: Sequence[str] = ()) -> DataFrame:
    """``n`` non-null values of rows in a seeded pseudo-random order that does not depend on partitioning.

    The order is a hash of the seed and the row's ``key`` columns (all columns unless given; name a unique key to read
    less). Each task keeps its ``n`` smallest; no full sort is made.
    """
    types = field_types(df)
    parts = list(key) or [c for c in df.columns if not isinstance(types[c], (T.MapType, T.VariantType))]
    texts = df.where(col(field).isNotNull()).select(
        col(field).cast("string").alias("sample"), F.xxhash64(F.lit(seed), *[col(p) for p in parts]).alias("_at"))
    return texts.orderBy("_at", "sample").limit(n).select("sample")


def fraction_sample(df: DataFrame, fraction: float | None = None, max_rows: int | None = None, seed: int = 42) -> DataFrame:
    """Bernoulli sample by fraction, or by the fraction that gives about ``max_rows``."""
    if fraction is None:
        total = df.count()
        fraction = 1.0 if not total else min(1.0, (max_rows or 50_000) / total)
    return df if fraction >= 1.0 else df.sample(fraction=fraction, seed=seed)
