"""Exact linear-interpolated quantiles that hold at any size: selection in rounds.

Built-in ``percentile`` keeps every distinct value of a group in one task. Here a mergeable sketch first brackets each wanted
rank; equal values inside a bracket collapse to one weighted value. While a bracket holds more than FEW values, a round cuts it
into CELLS of equal width, adds up each cell (weight, least and greatest value: partial sums in every task) and keeps the cell
that the rank falls into, between the least and greatest values that are really there. A cell whose ends are equal is the answer;
a rank between two cells lies between the greatest value of one and the least of the other. Only what is left, at most FEW
values a rank, is ordered. No window sees more than CELLS or FEW rows of one key and rank.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage
from .shape import melt_numbers

SKETCH_ACCURACY = 10_000
SPREAD = 2.0
CELLS = 2048
FEW = 10_000
FEW_KEYS = 1_000
TARGET = ["k", "p"]


def sketched_ends(value: str, probs: Sequence[float], accuracy: int = SKETCH_ACCURACY, spread: float = SPREAD) -> Column:
    """Aggregate: the sketch places a rank within ``n / accuracy``; a bracket's two ends are ``spread`` times as far on both sides."""
    margin = spread / accuracy
    return F.percentile_approx(value, [e for p in probs for e in (max(0.0, p - margin), min(1.0, p + margin))], accuracy)


def brackets(sketched: DataFrame, probs: Sequence[float], accuracy: int = SKETCH_ACCURACY, spread: float = SPREAD) -> DataFrame:
    """``(k, n, ranges of p, lo, hi)`` from ``(k, n, least, most, ends)``; every bracket is at least one rank wider than its rank."""
    # with fewer rows than the sketch keeps apart, one rank is wider than the margin: then the ends are the bracket
    few = F.lit(spread > 0) & (F.col("n") <= accuracy)
    ranges = F.array(*[
        F.struct(
            F.lit(float(p)).alias("p"),
            F.when(few, F.col("least")).otherwise(F.get("ends", F.lit(2 * i))).alias("lo"),
            F.when(few, F.col("most")).otherwise(F.get("ends", F.lit(2 * i + 1))).alias("hi"),
        )
        for i, p in enumerate(probs)
    ])
    return sketched.select("k", "n", ranges.alias("ranges"))


def _joined(rows: DataFrame, other: DataFrame, keys: Sequence[str], small: bool) -> DataFrame:
    """Rows with the columns of the other side's row of equal keys, null keys included."""
    renamed = other.withColumnsRenamed({k: f"_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return rows.join(F.broadcast(renamed) if small else renamed, on).drop(*[f"_{k}" for k in keys])


def _held(usable: DataFrame, brackets: DataFrame, small: bool) -> DataFrame:
    """``(k, p, n, v, w)``: weighted values inside each bracket; what lies below it is one row whose value is null."""
    tagged = (
        _joined(usable, brackets, ["k"], small)
        .select("k", "n", "v", F.explode("ranges").alias("r"))
        .where(F.col("v") <= F.col("r.hi"))
        .select("k", "n", F.col("r.p").alias("p"), F.when(F.col("v") >= F.col("r.lo"), F.col("v")).alias("v"))
    )
    return tagged.groupBy("k", "p", "n", "v").agg(F.count(F.lit(1)).alias("w"))


def _upto(order: Column) -> object:
    return Window.partitionBy(*TARGET).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _ranks() -> tuple[Column, Column]:
    rank = F.col("p") * (F.col("n") - 1)
    return F.floor(rank), F.ceil(rank)


def _cell(v: Column, lo: Column, hi: Column, cells: int) -> Column:
    """The cell of a value between two ends; halves keep the range of the largest doubles finite."""
    share = F.try_divide(v / 2 - lo / 2, hi / 2 - lo / 2)
    return F.least(F.floor(share * cells), F.lit(cells - 1))


def _round(live: DataFrame, targets: DataFrame, cells: int, small: bool) -> DataFrame:
    """``targets`` (k, p, n, lo, hi, base) after a round; ``a`` and ``b`` are the values at both ranks where that is settled."""
    placed = _joined(live.select(*TARGET, "v", "w"), targets, TARGET, small).withColumn("cell", _cell(F.col("v"), F.col("lo"), F.col("hi"), cells))
    cut = placed.groupBy(*TARGET, "n", "base", "cell").agg(F.sum("w").alias("w"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    below, above = _ranks()
    cut = cut.withColumn("upto", F.col("base") + F.sum("w").over(_upto(F.col("cell"))))
    holds = lambda r: F.min(F.when(F.col("upto") > r, F.struct("cell", "lo", "hi", (F.col("upto") - F.col("w")).alias("base"))))
    found = cut.groupBy(*TARGET, "n").agg(holds(below).alias("x"), holds(above).alias("y"))
    apart = F.col("x.cell") < F.col("y.cell")
    one = F.col("x.lo") == F.col("x.hi")
    return found.select(*TARGET, "n", "x.lo", "x.hi", "x.base", F.when(apart | one, F.col("x.hi")).alias("a"), F.when(apart | one, F.col("y.lo")).alias("b"))


def bracketed_quantiles(
    rows: DataFrame, key: str, value: str, probs: Sequence[float], accuracy: int = SKETCH_ACCURACY, spread: float = SPREAD,
    cells: int = CELLS, few: int = FEW, small: bool | None = None, ranges: DataFrame | None = None,
) -> DataFrame:
    """``(key, prob, quantile)`` for every key, exact. ``small`` says that the keys are few, as columns are: figures per key are
    then told to all tasks instead of moving and sorting all rows by key. Unless it is given, it holds up to FEW_KEYS keys. A bracket that misses its rank is replaced by the key's whole range."""
    usable = rows.where(F.col(value).isNotNull()).select(F.col(key).alias("k"), F.col(value).cast("double").alias("v"))
    if ranges is None:
        ranges = brackets(usable.groupBy("k").agg(
            F.count("v").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"),
            sketched_ends("v", probs, accuracy, spread).alias("ends")), probs, accuracy, spread)
    if small is None:
        ranges = cut_lineage(ranges)
        small = ranges.limit(FEW_KEYS + 1).count() <= FEW_KEYS
    held = cut_lineage(_held(usable, ranges, small))
    below, above = _ranks()
    inside = F.col("v").isNotNull()
    sizes = held.groupBy(*TARGET, "n").agg(
        F.coalesce(F.sum(F.when(~inside, F.col("w"))), F.lit(0)).alias("base"), F.sum("w").alias("last"), F.count("v").alias("values"),
        F.min("v").alias("lo"), F.max("v").alias("hi"))
    sound = (F.col("base") <= below) & (F.col("last") > above) & F.col("lo").isNotNull()
    facts = sizes.agg(F.coalesce(F.max("values"), F.lit(0)).alias("most"), F.count_if(~sound).alias("missed")).first()
    if facts["missed"]:
        whole = usable.groupBy("k").agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        ranges = F.array(*[F.struct(F.lit(float(p)).alias("p"), F.col("lo"), F.col("hi")) for p in probs])
        held = cut_lineage(_held(usable, whole.select("k", "n", ranges.alias("ranges")), small))
        sizes = held.groupBy(*TARGET, "n").agg(F.lit(0).cast("bigint").alias("base"), F.count("v").alias("values"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        facts = sizes.agg(F.coalesce(F.max("values"), F.lit(0)).alias("most")).first()
    most, live = facts["most"], held.where(inside)
    targets, settled = sizes.drop("values", "last"), []
    while most > few:
        targets = cut_lineage(_round(live, targets, cells, small))
        settled.append(targets.where("a is not null").select(*TARGET, "n", "a", "b"))
        targets = targets.where("a is null").drop("a", "b")
        live = cut_lineage(_joined(live.select(*TARGET, "v", "w"), targets.select(*TARGET, "lo", "hi"), TARGET, small).where("v >= lo and v <= hi").select(*TARGET, "v", "w"))
        most = live.groupBy(*TARGET).agg(F.count("v").alias("c")).agg(F.coalesce(F.max("c"), F.lit(0))).first()[0]
    left = _joined(live.select(*TARGET, "v", "w"), targets.select(*TARGET, "n", "base"), TARGET, small)
    left = left.withColumn("upto", F.col("base") + F.sum("w").over(_upto(F.col("v"))))
    at = lambda r: F.min(F.when(F.col("upto") > r, F.col("v")))
    found = left.groupBy(*TARGET, "n").agg(at(below).alias("a"), at(above).alias("b"))
    for done in settled:
        found = found.unionByName(done)
    return found.select(
        F.col("k").alias(key), F.col("p").alias("prob"),
        (F.col("a") + (F.col("b") - F.col("a")) * (F.col("p") * (F.col("n") - 1) - below)).alias("quantile"),
    )


def column_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], **limits) -> DataFrame:
    """``(column, prob, quantile)`` of numeric columns; figures of one row per column are broadcast."""
    return bracketed_quantiles(melt_numbers(df, columns), "column", "value", probs, small=True, **limits)


def grouped_median(df: DataFrame, key: str, value: str, **limits) -> DataFrame:
    """``(key, median)`` of a numeric column; a group without numbers keeps a null median."""
    medians = bracketed_quantiles(df, key, value, [0.5], **limits).select(F.col(key).alias("_k"), F.col("quantile").alias("median"))
    keys = df.select(key).distinct()
    return keys.join(medians, F.col(key).eqNullSafe(F.col("_k")), "left").drop("_k")
