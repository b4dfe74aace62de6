"""Ordered computations: rolling means and running sums over aggregated series, forward fill over whole tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from ..session import cut_lineage
from .shape import col, field_types

SAMPLED = 64  # keys looked at per slice to find where slices begin


def rolling_mean(series: DataFrame, order: str, value: str, rows: int, name: str) -> DataFrame:
    """Mean of the last ``rows`` rows by order (fewer at the start). For aggregated series of bounded length."""
    w = Window.orderBy(col(order)).rowsBetween(-(rows - 1), Window.currentRow)
    return series.withColumn(name, F.avg(col(value)).over(w))


def running_sum(series: DataFrame, order: str, value: str, name: str) -> DataFrame:
    w = Window.orderBy(col(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return series.withColumn(name, F.sum(col(value)).over(w))


def first_last_change(series: DataFrame, x: str, value: str, when_zero: float | None = 0.0) -> DataFrame:
    """First and last value by ``x``, percent change and direction of an aggregated series."""
    ends = series.agg(
        F.count(F.lit(1)).alias("points"),
        F.min_by(col(x), col(x)).alias("first_x"), F.min_by(col(value), col(x)).alias("first_value"),
        F.max_by(col(x), col(x)).alias("last_x"), F.max_by(col(value), col(x)).alias("last_value"),
    )
    rise = F.when(F.col("first_value") > 0, (F.col("last_value") - F.col("first_value")) / F.col("first_value") * 100.0)
    change = rise if when_zero is None else F.coalesce(rise, F.lit(when_zero))
    return ends.withColumn("change_pct", change).withColumn(
        "direction", F.when(F.col("change_pct") > 0, "increased").otherwise("decreased"))


def keep_first(df: DataFrame, keys: Sequence[str], order_by: Sequence[str] = ()) -> DataFrame:
    """The first row of each combination of keys, in the order of ``order_by``, then of all other values."""
    others = [c for c in df.columns if c not in keys]
    if not others:
        return df.select(*[col(k) for k in keys]).distinct().select(*[col(c) for c in df.columns])
    types = field_types(df)
    order = [*order_by, *[c for c in others if c not in order_by and not isinstance(types[c], (T.MapType, T.VariantType))]]
    first = F.min_by(F.struct(*[col(c) for c in others]), F.struct(*[col(c) for c in order]))
    return df.groupBy(*[col(k) for k in keys]).agg(first.alias("_first")).select(
        *[col(c) if c in keys else F.col("_first").getField(c).alias(c) for c in df.columns])


def top_per_group(counts: DataFrame, group: str, order: Sequence[Column], k: int) -> DataFrame:
    """First ``k`` rows per group. The rank filter lets each task keep ``k`` rows per group before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(col(group)).orderBy(*order))
    return counts.withColumn("rank", rank).where(F.col("rank") <= k)


def _sort_key(df: DataFrame, order_by: Sequence[str], partition_by: Sequence[str]) -> Column:
    """Group, order and a hash of the row as one comparable value: any types, nulls first, ties broken by the row's values."""
    hashable = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return F.struct(*[col(p).alias(f"g{i}") for i, p in enumerate(partition_by)], *[col(o).alias(f"o{i}") for i, o in enumerate(order_by)],
                    F.xxhash64(*[col(c) for c in hashable]).alias("tie"))


def slice_bounds(df: DataFrame, key: Column, pieces: int) -> DataFrame | None:
    """One row ``cuts``: lower bounds of the slices after the first, from about SAMPLED distinct keys a slice; None without rows.

    The sample, chosen by hash, only balances the slices; results do not depend on it.
    """
    rows = df.count()
    if not rows:
        return None
    every = max(1, rows // (pieces * SAMPLED))
    sample = df.select(key.alias("k")).where(F.pmod(F.xxhash64("k"), F.lit(every)) == 0).distinct()
    # a window over the bounded sample alone
    tiles = sample.select("k", F.ntile(pieces).over(Window.orderBy("k")).alias("tile")).groupBy("tile").agg(F.min("k").alias("k"))
    ordered = F.sort_array(F.collect_list("k"))
    return cut_lineage(tiles.agg(F.slice(ordered, 2, pieces).alias("cuts")))


def _slice_of(key: Column, cuts: Column, pieces: int) -> Column:
    """How many cuts are not above the key, by bisection."""
    def step(at: Column, _: Column) -> Column:
        mid = ((at["lo"] + at["hi"]) / 2).cast("int")
        below = (at["lo"] < at["hi"]) & (F.get(cuts, mid) <= key)
        return F.struct(F.when(below, mid + 1).otherwise(at["lo"]).alias("lo"), F.when(below | (at["lo"] >= at["hi"]), at["hi"]).otherwise(mid).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.size(cuts).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(pieces.bit_length() + 1)), start, step, lambda at: at["lo"])


def forward_fill(
    df: DataFrame, columns: Sequence[str], order_by: Sequence[str], partition_by: Sequence[str] = (), slices: int | None = None
) -> DataFrame:
    """Replace nulls by the last earlier non-null value of the group. Leading nulls stay.

    ``order_by`` is required: a DataFrame has no row order. A prefix scan over slices of about equal size: the whole of group,
    order and row hash decides a row's slice, so that neither a group nor an order key that holds a third of all rows is one
    task's load. Each slice is filled on its own; of each slice the last values of the group that goes on in the next slice, one
    row, are scanned over the slices and fill what is still open there. Keys may have any type that can be ordered; rows that
    tie in them are ordered by a hash of their values, and rows equal in all columns lie together.
    """
    if not order_by:
        raise ValueError("forward_fill needs order_by: rows of a DataFrame have no order of their own")
    pieces = max(2, slices or 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    key = _sort_key(df, order_by, partition_by)
    bounds = slice_bounds(df, key, pieces)
    if bounds is None:
        return df
    groups = [f"g{i}" for i in range(len(partition_by))]
    placed = df.select("*", key.alias("_k"), bounds.scalar().alias("_cuts"))
    placed = placed.withColumn("_slice", _slice_of(F.col("_k"), F.col("_cuts"), pieces)).withColumn("_next", F.get("_cuts", F.col("_slice"))).drop("_cuts")

    def same(a: str, b: str) -> Column:
        return reduce(and_, [F.col(f"{a}.{g}").eqNullSafe(F.col(f"{b}.{g}")) for g in groups], F.col(a).isNotNull() & F.col(b).isNotNull())

    # one row per slice: the last values of the group that its end is in
    tail = placed.where(same("_k", "_next")).groupBy("_slice").agg(
        F.first("_next").alias("_next"), *[F.max_by(col(c), F.when(col(c).isNotNull(), F.col("_k"))).alias(f"_c{i}") for i, c in enumerate(columns)])
    before = Window.partitionBy(*[F.col(f"_next.{g}") for g in groups], F.lit(0)).orderBy("_slice")
    carried = tail.select((F.col("_slice") + 1).alias("_slice"), F.col("_next").alias("_from"),
                          *[F.last(f"_c{i}", ignorenulls=True).over(before).alias(f"_c{i}") for i in range(len(columns))])
    within = Window.partitionBy("_slice", *[F.col(f"_k.{g}") for g in groups]).orderBy("_k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = placed.drop("_next").withColumns({c: F.last(col(c), ignorenulls=True).over(within) for c in columns})
    # at most one row per slice, a number chosen here and not by the data
    joined = local.join(F.broadcast(carried), "_slice", "left")
    fill = {c: F.coalesce(col(c), F.when(same("_k", "_from"), F.col(f"_c{i}"))) for i, c in enumerate(columns)}
    return joined.withColumns(fill).select(*[col(c) for c in df.columns])
