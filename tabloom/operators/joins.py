"""Joins on normalised keys, with match accounting from key counts instead of from the joined rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.keys import join_key
from .shape import col, field_types

HOW = ("inner", "left", "right", "outer")
LEFT_KEY, RIGHT_KEY = "_tl_left_key", "_tl_right_key"
# a key whose rows multiply to more than HOT_ROWS is joined in cells of BLOCK by BLOCK rows, so that many tasks share it
HOT_ROWS, BLOCK = 1_000_000, 500
HOT_KEY, LEFT_BLOCK, RIGHT_BLOCK, CELL = "_tl_hot_key", "_tl_left_block", "_tl_right_block", "_tl_cell"


def with_key(df: DataFrame, column: str, strategy: str, name: str) -> DataFrame:
    return df.withColumn(name, join_key(col(column), field_types(df)[column], strategy))


def shared_columns(left: DataFrame, right: DataFrame) -> list[str]:
    return sorted(set(left.columns) & set(right.columns))


def reported_conflicts(left: DataFrame, right: DataFrame, left_col: str, right_col: str) -> list[str]:
    """Shared columns other than the two key columns. Key columns that share a name are renamed but not reported."""
    return [c for c in shared_columns(left, right) if c not in (left_col, right_col)]


def _suffixed(df: DataFrame, names: Sequence[str], suffix: str) -> DataFrame:
    return df.select(*[col(c).alias(c + suffix if c in names else c) for c in df.columns])


def _equal(nulls_match: bool) -> Column:
    a, b = F.col(LEFT_KEY), F.col(RIGHT_KEY)
    return a.eqNullSafe(b) if nulls_match else a == b


def _split_outer(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    """Full outer join as left join plus unmatched right rows.

    The engine can split a hot key in left and anti joins, but not in a full outer join.
    """
    kept = left.join(right, on, "left")
    keys = left.select(LEFT_KEY).distinct()
    lonely = right.join(keys, on, "left_anti")
    return kept.unionByName(lonely, allowMissingColumns=True)


def _hot_keys(left: DataFrame, right: DataFrame, nulls_match: bool) -> DataFrame:
    """Keys that give more than HOT_ROWS rows, and their blocks per side. Each has more than 2 * sqrt(HOT_ROWS) rows, so they are few."""
    stacked = left.select(F.col(LEFT_KEY).alias(HOT_KEY), F.lit(1).alias("l"), F.lit(0).alias("r")).unionAll(
        right.select(F.col(RIGHT_KEY), F.lit(0), F.lit(1)))
    counts = stacked.groupBy(HOT_KEY).agg(F.sum("l").alias("nl"), F.sum("r").alias("nr"))
    hot = counts.where(F.col("nl").cast("double") * F.col("nr") > HOT_ROWS)
    hot = hot if nulls_match else hot.where(F.col(HOT_KEY).isNotNull())
    return hot.select(HOT_KEY, F.ceil(F.col("nl") / BLOCK).cast("int").alias("nl"), F.ceil(F.col("nr") / BLOCK).cast("int").alias("nr"))


def _dealt(df: DataFrame, key: str, hot: DataFrame, own: tuple[str, str], other: tuple[str, str]) -> DataFrame:
    """Rows of hot keys: each in one block of its own side, once for every block of the other side."""
    rows = df.join(F.broadcast(hot), F.col(key).eqNullSafe(F.col(HOT_KEY)))
    # numbered in an order of their values, so that a task that runs again deals them alike; equal rows still differ
    plain = [col(f.name) for f in df.schema.fields if f.dataType.simpleString().find("map<") < 0 and not isinstance(f.dataType, T.VariantType)]
    # never null, as the exploded block is: cells of two types would be cast, and shuffled once more
    block = F.coalesce(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col(own[0])).cast("int"), F.lit(0))
    rows = rows.sortWithinPartitions(F.xxhash64(*plain)).withColumn(own[1], block)
    dealt = rows.withColumn(other[1], F.explode(F.sequence(F.lit(0), F.col(other[0]) - 1)))
    # a stated number of partitions: adaptive execution would merge them by their bytes, which tell nothing of the rows they give
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.select(*[col(c) for c in df.columns], F.struct(HOT_KEY, LEFT_BLOCK, RIGHT_BLOCK).alias(CELL)).repartition(tasks, CELL)


def _joined(left: DataFrame, right: DataFrame, how: str, nulls_match: bool) -> DataFrame:
    """Join of two keyed tables. One key's rows multiply, and no engine shares out one small pair of partitions whose result is
    large: hot keys have rows on both sides, so whatever ``how`` is they are an inner join of their own, in cells."""
    on = _equal(nulls_match)
    hot = _hot_keys(left, right, nulls_match)
    keys = F.broadcast(hot.select(HOT_KEY))
    l, r = (df.join(keys, F.col(k).eqNullSafe(F.col(HOT_KEY)), "left_anti") for df, k in ((left, LEFT_KEY), (right, RIGHT_KEY)))
    rest = _split_outer(l, r, on) if how == "outer" else l.join(r, on, how)
    blocks = ("nl", LEFT_BLOCK), ("nr", RIGHT_BLOCK)
    a, b = _dealt(left, LEFT_KEY, hot, *blocks), _dealt(right, RIGHT_KEY, hot, *blocks[::-1])
    # a broadcast of one side would leave all cells to the tasks that read the other; null keys are equal inside a struct
    met = a.alias("a").join(b.alias("b").hint("merge"), F.col(f"a.{CELL}") == F.col(f"b.{CELL}"))
    return rest.unionAll(met.select(*[col(c) for c in (*left.columns, *right.columns)]))


def join_on_key(
    left: DataFrame, right: DataFrame, left_col: str, right_col: str, strategy: str = "exact", how: str = "inner",
    suffixes: tuple[str, str] = ("_left", "_right"), nulls_match: bool = True,
) -> DataFrame:
    """Equi-join on the normalised keys of two columns.

    Null keys match null keys by default; pass ``nulls_match=False`` for SQL equality, and look at ``match_stats`` first:
    many nulls on both sides multiply.
    """
    if how not in HOW:
        raise ValueError(f"how must be one of {HOW}")
    both = shared_columns(left, right)
    l = with_key(left, left_col, strategy, LEFT_KEY)
    r = with_key(right, right_col, strategy, RIGHT_KEY)
    l, r = _suffixed(l, both, suffixes[0]), _suffixed(r, both, suffixes[1])
    return _joined(l, r, how, nulls_match).drop(LEFT_KEY, RIGHT_KEY)


def _key_counts(left: DataFrame, right: DataFrame, left_col: str, right_col: str, strategy: str) -> DataFrame:
    """``(key, nl, nr)``: rows per key on both sides, from one combining aggregate over the two key columns stacked."""
    def keys(df: DataFrame, column: str, on_left: int) -> DataFrame:
        key = join_key(col(column), field_types(df)[column], strategy)
        return df.select(key.alias("key"), F.lit(on_left).alias("l"), F.lit(1 - on_left).alias("r"))

    stacked = keys(left, left_col, 1).unionAll(keys(right, right_col, 0))
    return stacked.groupBy("key").agg(F.sum("l").alias("nl"), F.sum("r").alias("nr"))


def match_stats(
    left: DataFrame, right: DataFrame, left_col: str, right_col: str, strategy: str = "exact", how: str = "inner",
    nulls_match: bool = True,
) -> DataFrame:
    """One row describing the join without running it: sizes, matches, one-sided rows, repeated keys, null keys.

    Both sides are reduced to key counts in a single shuffle, so a key with a third of the rows is one row here.
    """
    wide = "decimal(38,0)"
    present = F.col("key").isNotNull()
    hit = (F.col("nl") > 0) & (F.col("nr") > 0) & (F.lit(nulls_match) | present)
    none = F.lit(0).cast(wide)
    keep_left, keep_right = how in ("left", "outer"), how in ("right", "outer")
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
    sums = _key_counts(left, right, left_col, right_col, strategy).agg(
        total("nl", "left_rows"), total("nr", "right_rows"),
        F.coalesce(F.sum(F.when(hit, F.col("nl").cast(wide) * F.col("nr").cast(wide))).cast(wide), none).alias("matched_rows"),
        total(F.when(~hit, F.col("nl")), "left_unmatched"), total(F.when(~hit, F.col("nr")), "right_unmatched"),
        total(F.when(present & (F.col("nl") > 0), F.col("nl") - 1), "left_duplicate_keys"),
        total(F.when(present & (F.col("nr") > 0), F.col("nr") - 1), "right_duplicate_keys"),
        total(F.when(~present, F.col("nl")), "left_null_keys"), total(F.when(~present, F.col("nr")), "right_null_keys"),
    )
    left_only = F.col("left_unmatched") if keep_left else F.lit(0).cast("bigint")
    right_only = F.col("right_unmatched") if keep_right else F.lit(0).cast("bigint")
    return sums.select(
        "left_rows", "right_rows", "matched_rows", left_only.alias("left_only_rows"), right_only.alias("right_only_rows"),
        (F.col("matched_rows") + left_only + right_only).cast(wide).alias("merged_rows"),
        (F.col("left_duplicate_keys") + F.col("right_duplicate_keys")).alias("duplicate_keys"),
        "left_duplicate_keys", "right_duplicate_keys", "left_null_keys", "right_null_keys",
    )


def join_warnings(
    left: DataFrame, right: DataFrame, left_col: str, right_col: str, strategy: str = "exact", how: str = "inner",
    suffixes: tuple[str, str] = ("_left", "_right"), nulls_match: bool = True,
) -> DataFrame:
    """Warnings about repeated keys, an empty inner join, renamed columns and multiplying nulls, one per row."""
    stats = match_stats(left, right, left_col, right_col, strategy, how, nulls_match)
    conflicts = reported_conflicts(left, right, left_col, right_col)
    texts = F.array(
        F.when(F.col("left_duplicate_keys") > 0, F.format_string(f"left '{left_col}' repeats %d keys; rows may multiply", "left_duplicate_keys")),
        F.when(F.col("right_duplicate_keys") > 0, F.format_string(f"right '{right_col}' repeats %d keys; rows may multiply", "right_duplicate_keys")),
        F.when((F.col("matched_rows") == 0) & F.lit(how == "inner"), F.lit("inner join matched no rows; try a left join or another key strategy")),
        F.when(F.lit(bool(conflicts)), F.lit(f"shared columns renamed with {suffixes[0]}/{suffixes[1]}: {', '.join(conflicts)}")),
        F.when(F.lit(nulls_match) & (F.col("left_null_keys") > 0) & (F.col("right_null_keys") > 0),
               F.format_string("%d left and %d right null keys match each other", "left_null_keys", "right_null_keys")),
    )
    return stats.select(F.posexplode(texts).alias("position", "warning")).where(F.col("warning").isNotNull())


def exact_join_size(left: DataFrame, right: DataFrame, left_col: str, right_col: str, strategy: str = "exact") -> DataFrame:
    """Rows an inner join would give (null keys do not match), from key counts."""
    wide = "decimal(38,0)"
    both = _key_counts(left, right, left_col, right_col, strategy).where("key IS NOT NULL AND nl > 0 AND nr > 0")
    return both.agg(
        F.coalesce(F.sum(F.col("nl").cast(wide) * F.col("nr").cast(wide)).cast(wide), F.lit(0).cast(wide)).alias("est_rows"),
        F.count(F.lit(1)).alias("common_keys"))


def heuristic_join_size(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Rule-of-thumb size from the two row counts alone."""
    l, r = left.agg(F.count(F.lit(1))).scalar(), right.agg(F.count(F.lit(1))).scalar()
    rows = {"inner": l * 1.5, "left": l * 1.5, "right": r * 1.5}.get(how, (l + r).cast("double"))
    cols = len(left.columns) + len(right.columns) - 1
    one = left.sparkSession.range(1).select(rows.alias("rows"))
    return one.select(
        F.floor("rows").cast("bigint").alias("estimated_rows"),
        (F.col("rows") * cols * 8 / (1024.0 * 1024.0)).alias("estimated_memory_mb"),
        (F.col("rows") > 10_000_000).alias("very_large"),
    )


def merge_on_columns(left: DataFrame, right: DataFrame, left_col: str, right_col: str, how: str = "inner") -> DataFrame:
    """Plain join on raw values; shared columns get ``_left`` / ``_right``."""
    if left_col == right_col:
        others = [c for c in shared_columns(left, right) if c != left_col]
        l, r = _suffixed(left, others, "_left"), _suffixed(right, others, "_right")
        l = l.withColumn(LEFT_KEY, col(left_col))
        r = r.withColumn(RIGHT_KEY, col(right_col)).drop(left_col)
        joined = _joined(l, r, how, True)
        key = F.coalesce(F.col(LEFT_KEY), F.col(RIGHT_KEY)) if how in ("right", "outer") else F.col(LEFT_KEY)
        return joined.withColumn(left_col, key).drop(LEFT_KEY, RIGHT_KEY)
    both = shared_columns(left, right)
    l = _suffixed(left.withColumn(LEFT_KEY, col(left_col)), both, "_left")
    r = _suffixed(right.withColumn(RIGHT_KEY, col(right_col)), both, "_right")
    return _joined(l, r, how, True).drop(LEFT_KEY, RIGHT_KEY)


def merge_checks(left: DataFrame, right: DataFrame, merged: DataFrame) -> DataFrame:
    """Rows, missing cells and a fan-out flag (more than five times the input rows) of a merged table."""
    rows_in = left.agg(F.count(F.lit(1))).scalar() + right.agg(F.count(F.lit(1))).scalar()
    cells = [col(c).isNull().cast("bigint") for c in merged.columns]
    total = cells[0]
    for c in cells[1:]:
        total = total + c
    out = merged.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(total), F.lit(0)).alias("null_cells"))
    return out.withColumn("fan_out", F.col("rows") > rows_in * 5)


def preview(df: DataFrame, n: int = 20, order_by: Sequence[str] = ()) -> DataFrame:
    """First rows as text, missing cells as empty text."""
    if not 1 <= n <= 200:
        raise ValueError("preview shows 1 to 200 rows")
    ordered = df.orderBy(*[col(o) for o in order_by]) if order_by else df
    return ordered.limit(n).select(*[F.coalesce(col(c).cast("string"), F.lit("")).alias(c) for c in df.columns])


def matching_rows(left: DataFrame, right: DataFrame, left_col: str, right_col: str, strategy: str, matched: bool = True) -> DataFrame:
    """Left rows whose key does (or does not) occur on the right."""
    l = with_key(left, left_col, strategy, LEFT_KEY)
    keys = right.select(join_key(col(right_col), field_types(right)[right_col], strategy).alias(RIGHT_KEY)).distinct()
    return l.join(keys, _equal(False), "left_semi" if matched else "left_anti")


def match_samples(left: DataFrame, right: DataFrame, left_col: str, right_col: str, strategy: str, n: int = 5) -> DataFrame:
    """``n`` example values with a match and ``n`` without, smallest first so that the choice is stable."""
    def some(matched: bool) -> DataFrame:
        rows = matching_rows(left, right, left_col, right_col, strategy, matched)
        return rows.select(F.lit(matched).alias("matched"), col(left_col).cast("string").alias("left_raw"),
                           F.col(LEFT_KEY).alias("key")).orderBy("left_raw").limit(n)

    return some(True).unionAll(some(False))


def enrich(base: DataFrame, key: str, *sides: DataFrame | None) -> DataFrame:
    """Chain of left joins on one key column; an absent side is skipped. A null key matches a null key."""
    for i, side in enumerate(sides):
        if side is not None:
            other = side.withColumnRenamed(key, f"_side{i}")
            base = base.join(other, col(key).eqNullSafe(F.col(f"_side{i}")), "left").drop(f"_side{i}")
    return base


def list_key_lookup(df: DataFrame, id_col: str, list_items: Column, lookup: DataFrame, lookup_key: str) -> DataFrame:
    """One row per (id, distinct list item) with the lookup columns; items keep the position of their first occurrence."""
    items = df.select(col(id_col), F.posexplode(list_items).alias("_pos", "_key"))
    # lists are short in bytes and long in items: what adaptive execution merged by bytes would be one task's aggregate here
    items = items.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), col(id_col), F.col("_key"))
    distinct = items.groupBy(id_col, "_key").agg(F.min("_pos").alias("_pos"))
    return distinct.join(lookup.withColumnRenamed(lookup_key, "_lookup"), F.col("_key") == F.col("_lookup"), "left")


def top_categories_only(df: DataFrame, fields: Sequence[str], n: int) -> DataFrame:
    """Rows whose value is among the top ``n`` of every given field, tops taken on the whole table."""
    kept = df
    for i, f in enumerate(fields):
        counts = df.where(col(f).isNotNull()).groupBy(col(f).alias(f"_top{i}")).agg(F.count(F.lit(1)).alias("_n"))
        top = counts.orderBy(F.col("_n").desc(), F.col(f"_top{i}")).limit(n).select(f"_top{i}")
        # exactly n rows at most
        kept = kept.join(F.broadcast(top), col(f) == F.col(f"_top{i}"), "left_semi")
    return kept


def key_set_overlap(left: DataFrame, right: DataFrame, left_col: str, right_col: str) -> DataFrame:
    """Distinct values per side, their intersection, Jaccard and overlap relative to the smaller set."""
    l = left.select(col(left_col).cast("string").alias("k")).where("k is not null").distinct().select("k", F.lit(1).alias("l"), F.lit(0).alias("r"))
    r = right.select(col(right_col).cast("string").alias("k")).where("k is not null").distinct().select("k", F.lit(0).alias("l"), F.lit(1).alias("r"))
    both = l.unionAll(r).groupBy("k").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    s = both.agg(F.coalesce(F.sum("l"), F.lit(0)).alias("left_distinct"), F.coalesce(F.sum("r"), F.lit(0)).alias("right_distinct"),
                 F.count_if((F.col("l") == 1) & (F.col("r") == 1)).alias("common"))
    union = F.col("left_distinct") + F.col("right_distinct") - F.col("common")
    return s.withColumn("jaccard", F.coalesce(F.try_divide(F.col("common"), union), F.lit(0.0))).withColumn(
        "overlap", F.coalesce(F.try_divide(F.col("common"), F.least("left_distinct", "right_distinct")), F.lit(0.0)))
