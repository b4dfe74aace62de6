"""Whole-table profile: one row per column, a one-row dataset summary, and the long tables behind the usual charts."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.text import stable_token
from .aggregates import high_correlations
from .quantiles import brackets, column_quantiles, sketched_ends
from .shape import MOMENT, col, digest_table, field_types, melt_numbers, numeric_columns, small_table, value_table
from .windows import top_per_group


def _kind(dtype: T.DataType) -> str:
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, T.NumericType):
        return "number"
    if isinstance(dtype, MOMENT):
        return "moment"
    return "text"


def column_catalog(df: DataFrame, roles: Mapping[str, str] | None = None) -> DataFrame:
    """``(column, position, dtype, kind, role)``; one row per column, so it is bounded by the schema."""
    rows = [
        (f.name, i, f.dataType.simpleString(), _kind(f.dataType),
         (roles or {}).get(f.name) or f.metadata.get("role", "feature_col"))
        for i, f in enumerate(df.schema.fields)
    ]
    return small_table(df.sparkSession, rows, "column string, position int, dtype string, kind string, role string")


QUARTILES = (0.25, 0.5, 0.75)
FIGURES = ("n", "min", "max", "mean", "std", "sd_pop", "g1", "g2")
NUMBERS = ("min", "max", "mean", "median", "std", "skewness", "kurtosis", "q1", "q3")
MAX_CLASSES = 20
# the sketch holds one register per value at most, so up to MAX_CLASSES values are never estimated beyond twice as many
SKETCH_CLASSES = 2 * MAX_CLASSES


def statistics_bundle(df: DataFrame, columns: Sequence[str]) -> dict[str, dict[str, float | int | None]]:
    """Per numeric column with a finite value: count, ends, moments and exact quartiles; a few numbers a column, kept by the driver.

    One scan adds up moments and a quantile sketch per column in every task; a second one picks the values that the sketch's
    brackets leave open. No other value is moved. Infinities and NaN count as missing.
    """
    numbers = melt_numbers(df, columns)
    x = F.col("value")
    one = numbers.groupBy("column").agg(
        F.count(x).alias("n"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("std"), F.stddev_pop(x).alias("sd_pop"), F.skewness(x).alias("g1"), F.kurtosis(x).alias("g2"),
        sketched_ends("value", QUARTILES).alias("ends")).where("n > 0")
    bundle, rows = {}, []
    for r in one.collect():
        bundle[r["column"]] = {c: r[c] for c in FIGURES} | {"g1": r["g1"] or 0.0, "flat": not r["sd_pop"]}
        rows.append((r["column"], r["n"], r["min"], r["max"], *r["ends"]))
    if not rows:
        return bundle
    places = [f"e{i}" for i in range(2 * len(QUARTILES))]
    sketched = small_table(df.sparkSession, rows, "k string, n bigint, least double, most double, " + ", ".join(f"{e} double" for e in places))
    ranges = brackets(sketched.select("k", "n", "least", "most", F.array(*places).alias("ends")), QUARTILES)
    for r in column_quantiles(df, columns, QUARTILES, ranges=ranges).collect():
        bundle[r["column"]][f"q{QUARTILES.index(r['prob']) + 1}"] = r["quantile"]
    return bundle


def number_figures(df: DataFrame, columns: Sequence[str], factor: float = 3.0, z_limit: float = 3.5) -> DataFrame:
    """Counts, moments (sample and population), quartiles, values outside the fences at ``factor`` interquartile ranges, and
    values beyond ``z_limit`` population deviations. Columns without a finite number have no row."""
    bundle = statistics_bundle(df, columns)
    rows = []
    for c in (c for c in columns if c in bundle):
        f = bundle[c]
        n, g1, g2, q1, q3 = f["n"], f["g1"], f["g2"], f["q1"], f["q3"]
        skewness = (0.0 if f["flat"] else g1 * math.sqrt(n * (n - 1)) / (n - 2)) if n >= 3 else None
        kurtosis = (0.0 if f["flat"] else (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)) if n >= 4 else None
        rows.append((c, n, f["min"], f["max"], f["mean"], f["q2"], f["std"], f["sd_pop"], 0.0 if f["flat"] else g1, 0.0 if f["flat"] else g2,
                     skewness, kurtosis, q1, q3, q1 - factor * (q3 - q1), q3 + factor * (q3 - q1)))
    doubles = ("min", "max", "mean", "median", "std", "sd_pop", "g1", "g2", "skewness", "kurtosis", "q1", "q3", "low", "high")
    known = small_table(df.sparkSession, rows, "column string, n bigint, " + ", ".join(f"{c} double" for c in doubles))
    # one row per column of the schema
    limits = F.broadcast(known.select("column", "mean", "sd_pop", "low", "high"))
    x, far = F.col("value"), F.abs((F.col("value") - F.col("mean")) / F.col("sd_pop")) > z_limit
    outside = melt_numbers(df, [r[0] for r in rows] or columns).join(limits, "column").groupBy("column").agg(
        F.count_if((x < F.col("low")) | (x > F.col("high"))).alias("outlier_count"), F.count_if((F.col("sd_pop") > 0) & far).alias("z_count"))
    return known.drop("low", "high").join(F.broadcast(outside), "column")


def fence_outliers(df: DataFrame, columns: Sequence[str], factor: float = 3.0) -> DataFrame:
    """``(column, n, q1, median, q3, outlier_count)`` with strict fences at ``factor`` interquartile ranges."""
    return number_figures(df, columns, factor).select("column", "n", "q1", "median", "q3", "outlier_count")


def presence(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per column: rows, present values and distinct values, counted on digests of 16 bytes."""
    chosen = list(columns if columns is not None else df.columns)
    held = F.col("a").isNotNull()
    counted = digest_table(df, chosen).groupBy("c").agg(
        F.sum("n").alias("rows"), F.sum(F.when(held, F.col("n")).otherwise(0)).alias("present"), F.count_if(held).alias("n_distinct"))
    names = small_table(df.sparkSession, list(enumerate(chosen)), "c int, column string")
    return names.join(counted, "c").drop("c")


def column_profile(df: DataFrame, roles: Mapping[str, str] | None = None) -> DataFrame:
    """Per column: nulls, distinct values, moments, quartiles, outliers and a distribution label."""
    full = column_catalog(df, roles).join(presence(df), "column", "left")
    if numbers := numeric_columns(df):
        full = full.join(number_figures(df, numbers), "column", "left")
    else:
        full = full.withColumns({c: F.lit(None).cast("double") for c in ("n", *NUMBERS, "outlier_count")})
    total = F.coalesce("rows", F.lit(0))
    missing = total - F.coalesce("present", F.lit(0))
    unique = F.coalesce("n_distinct", F.lit(0))
    number = F.col("kind") == "number"
    enough = number & (F.col("n") > 10)
    share = F.when(enough, F.col("outlier_count") / F.col("n")).otherwise(F.lit(0.0))
    label = (
        F.when(F.col("kind") == "boolean", "categorical")
        .when((F.col("kind") == "text") & (F.col("role") == "text_col"), "text")
        .when(F.col("kind") == "text", "categorical")
        .when(~number | (F.coalesce("n", F.lit(0)) == 0), "unknown")
        .when(F.col("skewness") > 1, "right_skewed")
        .when(F.col("skewness") < -1, "left_skewed")
        .when(unique < 10, "categorical")
        .otherwise("normal")
    )
    return full.select(
        "column", "position", "dtype", "kind", "role", missing.alias("null_count"),
        F.coalesce(F.try_divide(missing, total), F.lit(0.0)).alias("null_pct"), unique.alias("unique_count"),
        F.coalesce(F.try_divide(unique, total), F.lit(0.0)).alias("unique_pct"), label.alias("distribution_type"),
        F.when(enough, F.col("outlier_count")).otherwise(F.lit(0)).cast("bigint").alias("outlier_count"), share.alias("outlier_pct"),
        *[F.when(number, F.col(c)).alias(c) for c in ("n", *NUMBERS)],
    )


def quality_score(profile: DataFrame) -> DataFrame:
    """One row: 100 minus 50 per fully missing column and up to 10 per column for its outlier share, never below 0."""
    penalty = F.sum(50 * F.col("null_pct") + F.least(F.lit(10.0), 100 * F.col("outlier_pct")))
    return profile.agg(F.round(F.greatest(F.lit(0.0), 100 - penalty), 1).alias("quality_score"))


def potential_targets(profile: DataFrame) -> DataFrame:
    return profile.where(F.col("unique_count").between(2, MAX_CLASSES) & (F.col("role") != "id_col")).select("column", "unique_count")


def _few_valued(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """The columns that can have at most MAX_CLASSES distinct values; a sketch turns the others away before a value is moved."""
    if not columns:
        return []
    sizes = df.agg(*[F.approx_count_distinct(stable_token(col(c), field_types(df)[c])).alias(f"d{i}") for i, c in enumerate(columns)]).first()
    return [c for i, c in enumerate(columns) if sizes[i] <= SKETCH_CLASSES]


def target_columns(df: DataFrame, roles: Mapping[str, str] | None = None) -> DataFrame:
    """As potential_targets of the profile, from a table itself: only columns with few values are counted exactly."""
    catalog = column_catalog(df, roles)
    few = _few_valued(df, df.columns)
    if not few:
        return small_table(df.sparkSession, [], "column string, unique_count bigint")
    return potential_targets(catalog.join(presence(df, few).select("column", F.col("n_distinct").alias("unique_count")), "column"))


def dataset_summary(df: DataFrame, roles: Mapping[str, str] | None = None, profile: DataFrame | None = None) -> DataFrame:
    """One row for the whole table, derived from the column profile."""
    p = profile if profile is not None else column_profile(df, roles)
    penalty = F.sum(50 * F.col("null_pct") + F.least(F.lit(10.0), 100 * F.col("outlier_pct")))
    listed = lambda test: F.array_join(F.array_sort(F.collect_list(F.when(test, F.col("column")))), ", ")
    return p.agg(
        F.count(F.lit(1)).alias("cols"),
        F.round(F.greatest(F.lit(0.0), 100 - penalty), 1).alias("quality_score"),
        F.coalesce(F.bool_or(F.col("role") == "datetime_col"), F.lit(False)).alias("time_series_detected"),
        listed(F.col("role") == "datetime_col").alias("datetime_columns"),
        listed(F.col("role") == "text_col").alias("text_columns"),
        listed(F.col("unique_count").between(2, 20) & (F.col("role") != "id_col")).alias("potential_target_columns"),
    ).withColumn("rows", df.agg(F.count(F.lit(1))).scalar())


def top_column_values(df: DataFrame, k: int = 5, columns: Sequence[str] | None = None) -> DataFrame:
    """Top ``k`` values of every column. Missing values are listed for boolean columns only."""
    chosen = list(columns or df.columns)
    booleans = [c for c in chosen if isinstance(field_types(df)[c], T.BooleanType)]
    counts = value_table(df, chosen).where(F.col("value").isNotNull() | F.col("column").isin(booleans))
    return top_per_group(counts, "column", [F.col("n").desc(), F.col("value").asc_nulls_last()], k)


def class_balance(df: DataFrame) -> DataFrame:
    """Value counts of text and boolean columns with 2 to 20 distinct values."""
    types = field_types(df)
    chosen = [c for c in df.columns if _kind(types[c]) in ("text", "boolean")]
    if not chosen:
        return value_table(df, chosen).select("column", "value", F.col("n").alias("count"))
    chosen = _few_valued(df, chosen) or chosen[:1]
    booleans = [c for c in chosen if isinstance(types[c], T.BooleanType)]
    counts = value_table(df, chosen)
    few = counts.groupBy("column").agg(F.count("value").alias("u")).where(F.col("u").between(2, MAX_CLASSES)).select("column")
    # one row per column of the schema
    kept = counts.join(F.broadcast(few), "column", "left_semi")
    return kept.where(F.col("value").isNotNull() | F.col("column").isin(booleans)).select(
        "column", "value", F.col("n").alias("count"))


def categorical_bars(df: DataFrame, roles: Mapping[str, str] | None = None, max_unique: int = 30, k: int = 10) -> DataFrame:
    """Top values of columns labelled categorical with at most ``max_unique`` distinct values."""
    p = column_profile(df, roles)
    wanted = p.where((F.col("distribution_type") == "categorical") & (F.col("unique_count") <= max_unique)).select("column")
    counts = value_table(df).where(F.col("value").isNotNull())
    # one row per column of the schema
    return top_per_group(counts.join(F.broadcast(wanted), "column", "left_semi"), "column",
                         [F.col("n").desc(), F.col("value")], k)


def profile_tables(df: DataFrame, roles: Mapping[str, str] | None = None) -> dict[str, DataFrame]:
    """The three flat tables of a profile."""
    p = column_profile(df, roles)
    return {
        "dataset_summary": dataset_summary(df, roles, p),
        "column_profile": p,
        "high_correlations": high_correlations(df),
    }
