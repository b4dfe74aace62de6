"""URL filter by hashed host-suffix and path-prefix expressions.

Every url is expanded into expressions *host suffix + path prefix ending in a slash*; the expressions meet the rules in one
equi-join on four bytes of their digests; the full digest and the rest of the rule's path confirm a candidate; of the rules
that fit, the longest decides.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no rule and gets the default verdict; an
empty table gives an empty result; repeated rows give repeated results; a null id is kept; other columns are not read. Of two
fitting rules of one length the one with the longer host decides, then block before allow. Rules that are null in any column
are not rules. A rule's path may end anywhere, and may be empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_VERDICT = "allow"
SHORT = 8  # hex digits of the digest that candidates share


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules given as (verdict, host, path)."""
    rows = F.array(*[F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in rules])
    return spark.range(1).select(F.inline(rows))


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path."""
    url = F.coalesce(url, F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def folder(path: Column) -> Column:
    """A path up to and with its last slash."""
    return F.regexp_extract(path, r"(?s)^(.*/)?", 0)


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """id, host, path, rule, verdict for every row of ``pages``; ``rules`` as made by rule_table, of any size.

    The two numbers taken to the driver are the greatest depths among the rules: expressions deeper than every rule cannot
    match and are not made.
    """
    rules = rules.dropna().distinct().select(
        F.col("verdict").alias("r_verdict"), F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("r_host"),
        F.col("path").alias("r_path"))
    rules = rules.withColumn("r_full", F.sha2(F.concat_ws("\n", "r_host", folder(F.col("r_path"))), 256)).withColumn("short", F.substring("r_full", 1, SHORT))
    deep = rules.agg(F.max(F.size(F.split("r_host", r"\."))).alias("labels"), F.max(F.size(F.split(folder(F.col("r_path")), "/"))).alias("parts")).first()
    labels, parts = deep["labels"] or 1, deep["parts"] or 1

    host, path = split_url(F.col(url_col))
    urls = pages.select(F.col(id_col), F.monotonically_increasing_id().alias("row"), host.alias("host"), path.alias("path"))
    names, steps = F.split("host", r"\."), F.split("path", "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(names), F.lit(labels))), lambda n: F.concat_ws(".", F.slice(names, F.size(names) - n + 1, n)))
    # an empty prefix for rules without a path, then one for each slash
    prefixes = F.transform(F.sequence(F.lit(1), F.least(F.size(steps), F.lit(parts))), lambda n: F.when(n == 1, F.lit("")).otherwise(F.concat(F.concat_ws("/", F.slice(steps, 1, n - 1)), F.lit("/"))))
    made = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.sha2(F.concat_ws("\n", s, p), 256))))
    # the url travels with its first expression only; the others carry what a rule's rest of path is compared with
    said = urls.select("*", F.posexplode(made).alias("pos", "full")).select(
        F.when(F.col("pos") == 0, F.col(id_col)).alias(id_col), "row", F.when(F.col("pos") == 0, F.col("host")).alias("host"), "path", "pos", "full",
        F.substring("full", 1, SHORT).alias("short"))
    fits = (F.col("full") == F.col("r_full")) & F.startswith("path", "r_path")
    rule = F.concat("r_host", "r_path")
    found = said.join(rules, "short", "left").where((F.col("pos") == 0) | fits).select(
        id_col, "row", "host", F.when(F.col("pos") == 0, F.col("path")).alias("path"), "pos",
        F.when(fits, F.struct(F.length(rule).alias("n"), F.length("r_host").alias("h"), (F.col("r_verdict") == "block").alias("b"), rule.alias("rule"), F.col("r_verdict").alias("verdict"))).alias("best"))
    return found.groupBy("row").agg(
        F.max(id_col).alias(id_col), F.max("host").alias("host"), F.max("path").alias("path"), F.max("best").alias("best")).select(
        id_col, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
