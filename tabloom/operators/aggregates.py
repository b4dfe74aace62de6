"""Counting, grouped metrics, correlation, histograms and ordered concatenation."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.dates import parse_date, parse_timestamp, year_of
from ..functions.text import maybe_tokens, round_even, split_labels, to_number
from .quantiles import grouped_median
from .shape import NESTED, col, digest_table, field_types, melt_numbers, melt_text, numeric_columns, small_table, without_nan
from ..functions.text import stable_token

# Run states counted as "processing" in the run overview.
PROCESSING_STATES = ["preprocessing", "eda_running", "agents_running", "queued"]

SUMS = ["n", "x", "y", "xx", "yy", "xy"]
BLOCK_ROWS = 4096


def ranked(counts: DataFrame, value: str, n: int | None, count: str = "count") -> DataFrame:
    """Largest counts first; ties by value, nulls last. With ``n`` this is a per-task top-n, not a full sort."""
    ordered = counts.orderBy(F.col(count).desc(), F.col(value).asc_nulls_last())
    return ordered if n is None else ordered.limit(n)


def group_count(df: DataFrame, *keys: str, name: str = "count") -> DataFrame:
    """Rows per key; a null key is a group of its own."""
    return df.groupBy(*[col(k) for k in keys]).agg(F.count(F.lit(1)).alias(name))


def _share(counts: DataFrame, count: str, total: DataFrame) -> Column:
    return round_even(F.col(count) / F.greatest(total.scalar(), F.lit(1)) * 100.0, 1)


def value_counts(df: DataFrame, field: str, n: int | None = 15) -> DataFrame:
    """Top values with their percentage of the *non-null* rows; the null bucket is listed like any value."""
    counts = group_count(without_nan(df, [field]), field)
    total = counts.agg(F.coalesce(F.sum(F.when(col(field).isNotNull(), F.col("count"))), F.lit(0)))
    return ranked(counts, field, n).withColumn("percentage", _share(counts, "count", total))


def top_values(df: DataFrame, field: str, n: int = 5) -> DataFrame:
    """Top non-null values as text with their percentage."""
    counts = df.where(col(field).isNotNull()).groupBy(col(field).cast("string").alias("value")).agg(
        F.count(F.lit(1)).alias("count"))
    total = counts.agg(F.coalesce(F.sum("count"), F.lit(0)))
    return ranked(counts, "value", n).withColumn("percentage", _share(counts, "count", total))


def grouped_metric(
    df: DataFrame, x: str, y: str | None = None, agg: str = "count", n: int | None = 20,
) -> DataFrame:
    """Per ``x``: row count, or sum / median / mean of ``y`` read as a number. Largest first, nulls last."""
    if not y or y == "count":
        return ranked(group_count(df, x), x, n)
    rows = df.select(col(x), to_number(col(y), field_types(df)[y]).alias("_y"))
    if agg == "median":
        data = grouped_median(rows, x, "_y").withColumnRenamed("median", y)
    else:
        data = rows.groupBy(col(x)).agg((F.sum("_y") if agg == "sum" else F.avg("_y")).alias(y))
    ordered = data.orderBy(col(y).desc_nulls_last(), col(x).asc_nulls_last())
    return ordered if n is None else ordered.limit(n)


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """``(column, n_distinct)``. One stacked shuffle of distinct values as digests of 16 bytes instead of one expansion per column."""
    chosen = list(columns or df.columns)
    if approx:
        types = field_types(df)
        one = df.agg(*[F.approx_count_distinct(stable_token(col(c), types[c])).alias(c) for c in chosen])
        return one.unpivot([], [col(c) for c in chosen], "column", "n_distinct")
    counted = digest_table(df, chosen).groupBy("c").agg(F.count("a").alias("n_distinct"))
    return small_table(df.sparkSession, list(enumerate(chosen)), "c int, column string").join(counted, "c").drop("c")


def null_counts(df: DataFrame) -> DataFrame:
    """``(column, null_count, null_pct)`` from one pass without a shuffle of values."""
    types = field_types(df)

    def missing(c: str) -> Column:
        test = col(c).isNull()
        return test | F.isnan(col(c)) if isinstance(types[c], (T.DoubleType, T.FloatType)) else test

    one = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count_if(missing(c)).alias(c) for c in df.columns])
    long = one.unpivot([F.col("_rows")], [col(c) for c in df.columns], "column", "null_count")
    return long.select(
        "column", "null_count", F.coalesce(F.try_divide(F.col("null_count"), F.col("_rows")), F.lit(0.0)).alias("null_pct"))


def modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, mode)``: most frequent non-null value as text, the smallest on ties."""
    counts = melt_text(df, columns).groupBy("column", "value").agg(F.count("value").alias("n"))
    return counts.groupBy("column").agg(F.min_by("value", F.when(F.col("n") > 0, F.struct(-F.col("n"), "value"))).alias("mode"))


def sample_skewness(x: Column | str) -> Column:
    """Adjusted Fisher-Pearson skewness (G1); null below three values."""
    n = F.count(x).cast("double")
    return F.when(n >= 3, F.coalesce(F.skewness(x), F.lit(0.0)) * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(x: Column | str) -> Column:
    """Bias-corrected excess kurtosis (G2); null below four values."""
    n = F.count(x).cast("double")
    g2 = F.kurtosis(x)
    return F.when(n >= 4, F.when(F.var_pop(x) == 0, 0.0).otherwise(
        (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)))


def numeric_moments(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per numeric column: count, min, max, mean, std, skewness, kurtosis. No value is shuffled."""
    long = melt_numbers(df, columns or numeric_columns(df))
    return long.groupBy("column").agg(
        F.count("value").alias("n"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        sample_skewness("value").alias("skewness"), sample_kurtosis("value").alias("kurtosis"),
    )


def pearson(x: Column, y: Column) -> Column:
    """Aggregate: Pearson r over rows where both are present; null when either does not vary."""
    both_x, both_y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(both_x) * F.stddev_pop(both_y))


def correlation_pair(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson correlation over rows where both fields are numbers, with the number of such rows."""
    types = field_types(df)
    pair = df.select(to_number(col(x), types[x]).alias("x"), to_number(col(y), types[y]).alias("y"))
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    out = pair.agg(F.count_if(both).alias("sample_size"), pearson(F.col("x"), F.col("y")).alias("r"))
    value = F.when(F.col("sample_size") >= 2, F.col("r"))
    return out.select(F.lit(x).alias("x_field"), F.lit(y).alias("y_field"), value.alias("value"), "sample_size")


def comoments(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``(i, j, n, x, y, xx, yy, xy)`` for every two columns i <= j by place: number of rows where both are present, and over
    these the centred sums of both, of their squares and of their product.

    One scan. Every task multiplies blocks of rows as matrices (present, value, square) and hands over one row per cell; Spark
    adds the cells up, so the work of a row is columns squared without an expression, or a plan, of that size. Values are
    centred at each column's mean, found before in one aggregate, so that sums of squares keep their digits. NaN and infinities
    count as missing.
    """
    numbers = [col(c).cast("double") for c in names]
    ready = df.select(*[F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x).alias(f"c{k}") for k, x in enumerate(numbers)])
    means = ready.agg(*[F.avg(c).alias(c) for c in ready.columns]).first()
    centre = np.array([m if m is not None else 0.0 for m in means])
    upper = np.triu_indices(len(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((6, len(centre), len(centre)))
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(start, BLOCK_ROWS)
                v = np.column_stack([c.to_numpy(zero_copy_only=False) for c in part.columns]) - centre
                present = ~np.isnan(v)
                v, m = np.where(present, v, 0.0), present.astype(float)
                q = v * v
                total += np.stack([m.T @ m, v.T @ m, m.T @ v, q.T @ m, m.T @ q, v.T @ v])
        cells = total[:, upper[0], upper[1]]
        if len(centre):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*(u.astype(np.int32) for u in upper), *cells)], ["i", "j", *SUMS])

    cells = ready.mapInArrow(run, "i int, j int, " + ", ".join(f"{c} double" for c in SUMS))
    return cells.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in SUMS])


def _correlations(df: DataFrame, names: Sequence[str], own: bool) -> DataFrame:
    """``(col1, col2, r)`` for every pair col1 before col2, with ``own`` also for each varying column and itself; null where
    either does not vary over the rows that have both."""
    schema = "col1 string, col2 string, r double"
    if not names:
        return small_table(df.sparkSession, [], schema)
    n = F.col("n")
    spread = lambda one, two: F.col(two) - F.try_divide(F.col(one) * F.col(one), n)
    # what rounding leaves of a sum that should be zero
    varies = lambda one, two: spread(one, two) > F.col(two) * 1e-13
    r = F.when(varies("x", "xx") & varies("y", "yy"), F.try_divide(F.col("xy") - F.try_divide(F.col("x") * F.col("y"), n), F.sqrt(spread("x", "xx") * spread("y", "yy"))))
    r = F.when(F.col("i") == F.col("j"), F.when(r.isNotNull(), 1.0)).otherwise(r)
    label = small_table(df.sparkSession, list(enumerate(names)), "k int, name string")
    pairs = comoments(df, names).where("i <= j" if own else "i < j").select("i", "j", r.alias("r"))
    for k, c in (("i", "col1"), ("j", "col2")):  # one row per column of the schema
        pairs = pairs.join(F.broadcast(label.select(F.col("k").alias(k), F.col("name").alias(c))), k)
    return pairs.select("col1", "col2", "r")


def correlation_pairs(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(col1, col2, r)`` for every pair col1 before col2, pairwise-complete."""
    return _correlations(df, list(columns or numeric_columns(df)), own=False)


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Full symmetric matrix in long form, diagonal included."""
    cells = F.array(F.struct("col1", "col2", "r"), F.when(F.col("col1") != F.col("col2"), F.struct(F.col("col2").alias("col1"), F.col("col1").alias("col2"), "r")))
    return _correlations(df, list(columns or numeric_columns(df)), own=True).select(F.inline(F.array_compact(cells)))


def high_correlations(df: DataFrame, columns: Sequence[str] | None = None, above: float = 0.85) -> DataFrame:
    return correlation_pairs(df, columns).where(F.abs("r") > above).withColumnRenamed("r", "correlation")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: rows, exact duplicates (rows minus distinct rows) and their share. Copies collapse before the shuffle."""
    types = field_types(df)
    keys = [stable_token(col(c), types[c]).alias(c) if isinstance(types[c], NESTED) else col(c) for c in df.columns]
    copies = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_copies"))
    return copies.agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("duplicates"),
    ).withColumn("duplicate_pct", F.coalesce(F.try_divide("duplicates", "rows"), F.lit(0.0)))


def date_range(df: DataFrame, field: str) -> DataFrame:
    moment = parse_timestamp(col(field), field_types(df)[field])
    return df.agg(F.min(moment).alias("earliest"), F.max(moment).alias("latest"))


def coverage(df: DataFrame, fields: Sequence[str], digits: int = 1) -> DataFrame:
    """``(field, coverage_pct)``: share of non-null rows."""
    one = without_nan(df).agg(*[
        F.coalesce(F.try_divide(F.count(col(f)), F.count(F.lit(1))), F.lit(0.0)).alias(f) for f in fields])
    return one.unpivot([], [col(f) for f in fields], "field", "share").select(
        "field", F.round(F.col("share") * 100, digits).alias("coverage_pct"))


def yearly_counts(df: DataFrame, year_field: str | None = None, date_field: str | None = None) -> DataFrame:
    """Rows per year, from a year column read as a number, else from a date column."""
    if year_field:
        year = to_number(col(year_field), field_types(df)[year_field]).cast("int")
    else:
        year = year_of(col(date_field), field_types(df)[date_field])
    rows = df.select(year.alias("year")).where(F.col("year").isNotNull())
    return group_count(rows, "year").orderBy("year")


def label_counts(df: DataFrame, field: str, n: int = 12, digits: int = 1, label: str = "label") -> DataFrame:
    """Top labels of a multi-valued field; percentages are of the listed top labels only."""
    labels = df.where(col(field).isNotNull()).select(F.explode(split_labels(col(field).cast("string"))).alias(label))
    top = ranked(group_count(labels, label), label, n)
    total = top.agg(F.coalesce(F.sum("count"), F.lit(0)))
    return top.withColumn("pct", round_even(F.col("count") / F.greatest(total.scalar(), F.lit(1)) * 100.0, digits))


def histogram(df: DataFrame, columns: Sequence[str], bins: int = 30) -> DataFrame:
    """``(column, bin, lower, upper, count)`` over equal-width bins between each column's own ends."""
    long = melt_numbers(df, columns).where(F.col("value").isNotNull())
    # one row per column, so the broadcast is bounded by the schema
    ends = F.broadcast(long.groupBy("column").agg(F.min("value").alias("lo"), F.max("value").alias("hi")))
    flat = F.col("lo") == F.col("hi")
    lo, hi = F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")), F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi"))
    spot = F.least(F.floor((F.col("value") - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("int")
    placed = long.join(ends, "column").groupBy("column", "lo", "hi", spot.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    step = (hi - lo) / bins
    return placed.select("column", "bin", (lo + step * F.col("bin")).alias("lower"),
                         (lo + step * (F.col("bin") + 1)).alias("upper"), "count")


def null_patterns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows per combination of missing columns; pattern text has 1 for missing, in column order."""
    df = without_nan(df)
    flags = [col(c).isNull().cast("int").cast("string") for c in (columns or df.columns)]
    return df.groupBy(F.concat(*flags).alias("pattern")).agg(F.count(F.lit(1)).alias("rows"))


def crosstab(df: DataFrame, row: str, column: str) -> DataFrame:
    """Long contingency table of non-null pairs."""
    return group_count(df.where(col(row).isNotNull() & col(column).isNotNull()), row, column)


def label_pairs(df: DataFrame, row: str, column: str, per_side: int | None = None) -> DataFrame:
    """Pairs of the labels of two multi-valued fields, row by row; with ``per_side`` of the first labels of each only."""
    def labels(name: str) -> Column:
        found = split_labels(col(name).cast("string"))
        return found if per_side is None else F.slice(found, 1, per_side)

    ready = df.where(col(row).isNotNull() & col(column).isNotNull()).select(labels(row).alias("a"), labels(column).alias("b"))
    return ready.select(F.explode("a").alias(row), "b").select(col(row), F.explode("b").alias(column))


def strongest_cell(cells: DataFrame, row: str, column: str, count: str = "count") -> DataFrame:
    """The cell with the largest count; ties by row then column."""
    return cells.orderBy(F.col(count).desc(), col(row), col(column)).limit(1)


def peak(counts: DataFrame, x: str, count: str = "count") -> DataFrame:
    """The period with the largest count, the earliest on ties."""
    return counts.orderBy(F.col(count).desc(), col(x)).limit(1)


@dataclass
class Side:
    """One table that gives fields to a joined result.

    ``values`` maps result names to columns whose distinct clean tokens are listed, ``firsts`` to columns of which the first
    token is kept, ``counts`` to text columns whose distinct values are counted, ``latest`` to date expressions of which the
    greatest is kept. ``order`` says which rows come first. ``distinct`` says that no two rows of a key are equal in all columns
    named here: the first shuffle would bring nothing together.
    """
    df: DataFrame
    values: Mapping[str, str] = field(default_factory=dict)
    order: Sequence[Column | str] = ()
    firsts: Mapping[str, str] = field(default_factory=dict)
    counts: Mapping[str, str] = field(default_factory=dict)
    latest: Mapping[str, Column] = field(default_factory=dict)
    distinct: bool = False


def _cells_of(side: Side, number: int, keys: Sequence[str]) -> tuple[DataFrame, dict[str, str], str]:
    """Key, side number, place of the row, dates, and the text of each of its columns; the names of these by source column; and
    the name of the place."""
    names = {c: f"_t{k}" for k, c in enumerate(dict.fromkeys([*side.values.values(), *side.firsts.values(), *side.counts.values()]))}
    at = [F.col(o) if isinstance(o, str) else o for o in side.order]
    kind = side.df.select(at[0]).schema[0].dataType if len(at) == 1 else None
    # a whole number stays a hash aggregate's buffer; any other order goes through a sort
    whole = not at or isinstance(kind, T.IntegralType)
    rank = "_first" if whole else f"_rank{number}"
    place = F.coalesce(at[0].cast("bigint"), F.lit(-1)) if at and whole else F.struct(*at) if at else F.lit(0).cast("bigint")
    rows = side.df.select(*[col(k) for k in keys], F.lit(number).alias("_side"), place.alias(rank), *[d.alias(n) for n, d in side.latest.items()],
                          *[col(c).cast("string").alias(n) for c, n in names.items()])
    return rows, names, rank


def join_unique_sides(sides: Sequence[Side], keys: Sequence[str]) -> DataFrame:
    """Distinct clean tokens per key, joined with ``", "`` in order of first appearance, for fields of several tables at once.

    The rows of all sides are stacked and shuffled twice in all, not twice a side. Rows of a key that are equal in all their
    texts become one by a combining aggregate first, so a key with a third of all rows brings each different row of its fields
    to one place once; then each key gathers what is left, one list a field. Both shuffles move plain rows of texts: lists in
    aggregation buffers and arrays of tokens would take several times their bytes on disk, so tokens are made where rows are
    gathered, and only for fields that the caller reads. A single whole-number order column per side keeps the first aggregate a
    hash aggregate. A key that a side lacks has nulls in that side's fields.
    """
    parts = [_cells_of(side, s, keys) for s, side in enumerate(sides)]
    stacked = lambda chosen: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), chosen)
    dates = [n for side in sides for n in side.latest]
    key_cols = [col(k) for k in keys]
    once = [p[0] for p, side in zip(parts, sides) if side.distinct]
    if repeated := [p[0] for p, side in zip(parts, sides) if not side.distinct]:
        rows = stacked(repeated)
        cells = [c for c in rows.columns if c.startswith("_t") and c[2:].isdigit()]
        figures = [c for c in rows.columns if c not in (*keys, "_side", *cells)]
        once.append(rows.groupBy(*key_cols, "_side", *cells).agg(*[(F.max if c in dates else F.min)(col(c)).alias(c) for c in figures]))

    tokens, lists, out = [], [], [*key_cols]
    for s, (side, (_, names, rank)) in enumerate(zip(sides, parts)):
        mine = F.col("_side") == s
        for c in dict.fromkeys([*side.values.values(), *side.firsts.values()]):
            tokens.append(F.when(mine, maybe_tokens(col(names[c]))).alias(f"_x{s}{names[c]}"))
        for c in dict.fromkeys(side.values.values()):
            x = f"_x{s}{names[c]}"
            lists += [F.collect_list(F.when(F.size(x) > 0, F.struct(F.col(rank).alias("at"), F.col(x).alias("x")))).alias(f"_all{x}"), F.max(F.size(x)).alias(f"_most{x}")]
        for c in dict.fromkeys(side.firsts.values()):
            first = F.get(f"_x{s}{names[c]}", F.lit(0))
            lists.append(F.min(F.when(first.isNotNull(), F.struct(F.col(rank).alias("at"), first.alias("x"))))["x"].alias(f"_first{s}{names[c]}"))
        for c in dict.fromkeys(side.counts.values()):
            lists.append(F.size(F.collect_set(F.when(mine, col(names[c])))).cast("bigint").alias(f"_n{s}{names[c]}"))
        out += [F.nullif(F.array_join(_in_order(f"_all_x{s}{names[c]}", f"_most_x{s}{names[c]}"), ", "), F.lit("")).alias(n) for n, c in side.values.items()]
        out += [F.col(f"_first{s}{names[c]}").alias(n) for n, c in side.firsts.items()]
        out += [F.nullif(F.col(f"_n{s}{names[c]}"), F.lit(0)).alias(n) for n, c in side.counts.items()]
        out += [col(n) for n in side.latest]
    # dealt out by key before the aggregate, or it would make lists of what a task happens to hold and shuffle these
    met = stacked(once).repartition(*key_cols)
    ranks = list(dict.fromkeys(p[2] for p in parts))
    counted = list(dict.fromkeys(p[1][c] for p, side in zip(parts, sides) for c in side.counts.values()))
    met = met.select(*key_cols, "_side", *ranks, *counted, *[col(d) for d in dates], *tokens)
    return met.groupBy(*key_cols).agg(*lists, *[F.max(col(d)).alias(d) for d in dates]).select(*out)


def _in_order(rows: str, most: str) -> Column:
    """Distinct tokens of a list of (at, x), x a row's tokens: by place of the row, place in the row's list, token."""
    single = F.flatten(F.sort_array(rows)["x"])
    several = F.sort_array(F.flatten(F.transform(rows, lambda r: F.transform(r["x"], lambda t, i: F.struct(r["at"].alias("at"), i.alias("i"), t.alias("t"))))))["t"]
    return F.array_distinct(F.when(F.col(most) > 1, several).otherwise(single))


def join_unique_many(
    df: DataFrame, keys: Sequence[str], values: Mapping[str, str], order: Sequence[Column | str] = (),
    firsts: Mapping[str, str] | None = None,
) -> DataFrame:
    """Distinct clean tokens per key, joined with ``", "`` in order of first appearance, for several fields at once.

    ``values`` maps result names to source columns; ``firsts`` names results that keep the first token only. See
    ``join_unique_sides``.
    """
    return join_unique_sides([Side(df, values, order, dict(firsts or {}))], keys)


def join_unique(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[Column | str] = (), name: str | None = None) -> DataFrame:
    return join_unique_many(df, keys, {name or value: value}, order)


def first_by_priority(value: Column, *priority: Column) -> Column:
    """Aggregate: first non-null value by priority; equal priorities by value."""
    return F.min_by(value, F.when(value.isNotNull(), F.struct(*priority, value)))


def latest_date(c: Column, dtype: T.DataType | None = None) -> Column:
    """Aggregate: ISO text of the latest date that parses."""
    return F.date_format(F.max(parse_date(c, dtype)), "yyyy-MM-dd")


def run_overview(runs: DataFrame) -> DataFrame:
    """Totals over a run log with ``status`` and ``file_size_bytes``."""
    return runs.agg(
        F.count(F.lit(1)).alias("total_datasets"),
        F.coalesce(F.sum("file_size_bytes"), F.lit(0)).alias("storage_used_bytes"),
        F.round(F.coalesce(F.sum("file_size_bytes"), F.lit(0)) / (1024.0 * 1024.0), 2).alias("storage_used_mb"),
        F.count_if(F.col("status").isin(PROCESSING_STATES)).alias("processing_count"),
        F.count_if(F.col("status") == "complete").alias("complete_count"),
    )
