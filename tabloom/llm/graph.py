"""Connected components of a graph whose links are rows."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import cut_lineage, map_batches

FOREST = 400_000  # nodes whose links a task holds at once


def split_join(left: DataFrame, right: DataFrame, keys: str | list[str], how: str = "inner") -> DataFrame:
    """Join on columns of equal names. Both sides are dealt out anew by a hash of the keys as well, so that adaptive execution
    can split a hot key even where one side was just grouped by it."""
    keys = [keys] if isinstance(keys, str) else keys
    dealt = F.xxhash64(*keys)
    return left.withColumn("_dealt", dealt).join(right.withColumn("_dealt", dealt), ["_dealt", *keys], how).drop("_dealt")


def merged(of: DataFrame, links: DataFrame) -> DataFrame:
    """Components ``of`` (node, root) after more links (a, b): only their roots are worked on again."""
    ends = cut_lineage(with_roots(links, of).where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct())
    if ends.isEmpty():
        return of
    up = cut_lineage(components(ends))
    old = split_join(of.select("node", F.col("root").alias("at")), up.select(F.col("node").alias("at"), "root"), "at", "left")
    new = split_join(up, of.select("node"), "node", "left_anti")
    return cut_lineage(old.select("node", F.coalesce("root", "at").alias("root")).unionByName(new.select("node", "root")))


def with_roots(pairs: DataFrame, of: DataFrame) -> DataFrame:
    """Pairs (a, b) with the roots of both in ra, rb; a node without links is its own root."""
    for end, root in (("a", "ra"), ("b", "rb")):
        pairs = split_join(pairs, of.select(F.col("node").alias(end), F.col("root").alias(root)), end, "left").withColumn(root, F.coalesce(root, end))
    return pairs


def local_stars(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(node, least node it is connected with by the links at hand) for links (a, b). What is at hand is a task's links, or as
    many as touch FOREST nodes; a node may leave once for each such lot."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := above[x]) != x:
            above[x] = x = above[up]
        return x

    for a, b in rows:
        above.setdefault(a, a)
        above.setdefault(b, b)
        a, b = top(a), top(b)
        if a != b:
            above[max(a, b)] = min(a, b)
        if len(above) >= FOREST:
            yield from ((x, top(x)) for x in list(above))
            above.clear()
    yield from ((x, top(x)) for x in list(above))


def told_apart(rows: Iterator[tuple]) -> Iterator[tuple]:
    """From (node, root) in order: the node's least root (up), and a link from each other root to it (not up)."""
    at = low = last = None
    for node, root in rows:
        if node != at:
            at, low, last = node, root, root
            yield node, root, True
        elif root != last:
            last = root
            yield root, low, False


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b): the least node it is connected with, itself for the least one.

    A level contracts the links of every task where they are; nodes that several tasks saw link the roots they got there, and
    only those few links make the next level. A node is a row per task however many links it has, so that a hot node is no load
    of its own. In the end the pointers of each level are followed from the top down, by joins that can be split. A level is one
    shuffle and is written to the shared folder; a lost executor costs one level.
    """
    levels = []
    links = links.where("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long"))
    while True:
        stars = map_batches(links, "node long, root long", local_stars)
        found = cut_lineage(map_batches(stars.repartition("node").sortWithinPartitions("node", "root"), "node long, root long, up boolean", told_apart))
        levels.append(found.where("up").select("node", "root"))
        links = found.where("not up").select(F.col("node").alias("a"), F.col("root").alias("b"))
        if links.isEmpty():
            break
    out = levels.pop()
    for level in reversed(levels):
        out = split_join(level.withColumnRenamed("root", "at"), out.withColumnRenamed("node", "at"), "at", "left").select("node", F.coalesce("root", "at").alias("root"))
    return out
