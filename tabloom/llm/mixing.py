"""Mixing sources to target weights by Pareto order sampling.

A source's target is its share of the mix, held to ``most`` times its own size. Inside a source a document is wanted
``rate * preference`` times (``most`` at most); the whole part of that is certain, the fraction is the probability p of one
more copy. Documents are ranked by the odds of a uniform number over the odds of p, and the first ones whose words fill what
the certain copies leave open get their extra copy.

Defined cases: a null text has size 0 and is taken by probability like others, adding no word; null is a source of its own,
last in order; rows equal in id and text share one rank and so one decision; an empty table gives an empty result; other
columns are not read. The uniform number is a hash of seed, id and text, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import split_join
from .rows import cut_lineage, text_key

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
CUTS = 4096  # equal parts into which a range of ranks is cut, at each of two levels


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """key, source_size, target from rows (key, source, size). The windows run over one row per source.

    Sources reach their ceiling in the order of ceiling over weight, so the excess stops moving at the first source, in that
    order, that stays below its ceiling when the rest of the words is shared by weight.
    """
    whole = Window.partitionBy()
    by = sizes.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    by = by.withColumn("number", number).withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("number") - 1) % len(weights) + 1).cast("int")))
    by = by.withColumn("ceiling", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("ceiling") / F.col("weight"), "number")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    open_words = F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("ceiling").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    by = by.withColumn("place", F.row_number().over(order)).withColumn("level", open_words / open_weight)
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("ceiling"), F.struct("place", "level"))).over(whole).getField("level")
    return by.withColumn("level", level).select(
        "key", "source_size", F.least(F.col("ceiling"), F.coalesce(F.col("level") * F.col("weight"), F.col("ceiling"))).alias("target"))


def copies_wanted(thin: DataFrame, plan: DataFrame, most: int) -> DataFrame:
    """key, preference, source_size, target, certain, p: the copies wanted of each preference class are
    least(most, rate * preference), where the rate makes sum(size * copies) the target. Classes with the highest preference
    reach ``most`` first, so the rate is found like the level of the targets."""
    classes = thin.groupBy("key", "preference").agg(F.sum("size").alias("words")).join(plan, "key")
    whole = Window.partitionBy("key")
    above = whole.orderBy(F.desc("preference")).rowsBetween(Window.unboundedPreceding, -1)
    weighted = F.col("words") * F.col("preference")
    rate = (F.col("target") - most * F.coalesce(F.sum("words").over(above), F.lit(0))) / F.nullif(
        F.sum(weighted).over(whole) - F.coalesce(F.sum(weighted).over(above), F.lit(0.0)), F.lit(0.0))
    classes = classes.withColumn("rate", rate)
    classes = classes.withColumn("rate", F.max(F.when(F.col("rate") * F.col("preference") <= most, F.struct("preference", "rate"))).over(whole).getField("rate"))
    wanted = F.greatest(F.lit(0.0), F.least(F.lit(float(most)), F.coalesce(F.col("rate") * F.col("preference"), F.lit(float(most)))))
    return classes.select("key", "preference", "source_size", "target", wanted.alias("wanted")).withColumn(
        "certain", F.floor("wanted").cast("int")).withColumn("p", F.col("wanted") - F.col("certain")).drop("wanted")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, weights=WEIGHTS,
        share: float = SHARE, most: int = MOST) -> DataFrame:
    """id, hash, size, source, source_size, target, copies for every row; id and ``hash`` (of the text) lead back to it.

    Longer documents are preferred mildly: the preference is the number of binary digits of the size, hence one of few values.
    """
    text = F.col(text_col)
    thin = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text).alias("hash"), F.col(source_col).alias("source"), text_key(source_col).alias("key"), word_count(text).alias("size"),
        # 53 bits of a hash, strictly inside (0, 1)
        ((F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col), text), 11) + 0.5) * 2.0 ** -53).alias("u"))
    thin = cut_lineage(thin.withColumn("preference", F.floor(F.log2(F.col("size") + 1.0)) + 1.0))
    plan = copies_wanted(thin, source_targets(thin, weights, share, most), most)
    # the rank is the odds ratio brought to (0, 1), which keeps its order
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    ranked = split_join(thin, plan, ["key", "preference"]).withColumn("rank", F.when(F.col("p") > 0, odds / (1 + odds)))
    open_words = ranked.groupBy("key").agg((F.first("target") - F.sum(F.col("certain") * F.col("size"))).alias("open"))
    limits = rank_limits(ranked.where("rank is not null").select("key", "size", "rank"), open_words)
    out = split_join(ranked, limits, "key", "left")
    extra = F.coalesce(F.when(F.col("limit").isNull(), F.col("rank") < F.col("floor")).otherwise(F.col("rank") <= F.col("limit")).cast("int"), F.lit(0))
    return out.select(F.col("id").alias(id_col), "hash", "size", F.col("source").alias(source_col), "source_size", "target", (F.col("certain") + extra).alias("copies"))


def rank_limits(ranked: DataFrame, open_words: DataFrame) -> DataFrame:
    """key, limit, floor: the rank up to which (or, where limit is null, below which) words come closest to those still open.

    Exact at any size: sums per part of the rank's range find the part where the words are full, sums per part of that part
    find the next, and the ranks inside it, one in CUTS squared, are summed one by one. A window sees CUTS rows or those few.
    """
    ranked = ranked.withColumn("a", F.floor(F.col("rank") * CUTS).cast("double")).withColumn("b", F.floor(F.col("rank") * CUTS * CUTS).cast("double"))
    left = open_words.withColumn("floor", F.lit(0.0))
    for part, scale in (("a", CUTS), ("b", CUTS * CUTS)):
        sums = running_sums(ranked, left, part)
        here = F.struct(part, (F.col("open") - (F.col("sum") - F.col("words"))).alias("open"))
        # where the sum passes what is open, or the last part
        at = sums.groupBy("key").agg(F.coalesce(F.min(F.when(F.col("sum") > F.col("open"), here)), F.max(here)).alias("at"))
        left = cut_lineage(at.select("key", F.col(f"at.{part}").alias(part), "at.open", (F.col(f"at.{part}") / scale).alias("floor")))
        ranked = split_join(ranked, left.select("key", part), ["key", part], "left_semi")
        left = left.drop(part)
    sums = running_sums(ranked, left, "rank")
    near = (F.col("open") > 0) & (F.col("sum") - F.col("open") <= F.greatest(F.lit(0.0), F.col("open") - (F.col("sum") - F.col("words"))))
    return left.join(sums.groupBy("key").agg(F.max(F.when(near, F.col("rank"))).alias("limit")), "key", "left").select("key", "limit", "floor")


def running_sums(rows: DataFrame, left: DataFrame, part: str) -> DataFrame:
    sums = rows.groupBy("key", part).agg(F.sum("size").alias("words")).join(left, "key")
    return sums.withColumn("sum", F.sum("words").over(Window.partitionBy("key").orderBy(part).rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def take(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **settings) -> DataFrame:
    """The mix itself: every document with all its columns, as often as it is taken."""
    copies = mix(docs, id_col, text_col, source_col, **settings).where("copies > 0").select(
        text_key(id_col).alias("owner"), text_key(source_col).alias("of"), "hash", "copies").dropDuplicates(["owner", "of", "hash"])
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text_key(id_col).alias("owner"), text_key(source_col).alias("of"), F.xxhash64(text_col).alias("hash"))
    taken = split_join(packed, copies, ["owner", "of", "hash"])
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
