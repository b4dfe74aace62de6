"""Filters, projections, windows, ordering, sampling and unions."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from ..operators import aggregates as A, rows as R, windows as W
from ..operators.joins import key_set_overlap
from ..plans import analyses as P
from ..sources.sinks import history_page
from .registry import query


@query("p07_apply_filters", """
SELECT p_partkey, p_name, p_size FROM part
WHERE p_type IN ('SMALL', 'ECONOMY', 'LARGE') AND p_size BETWEEN 5 AND 30 AND regexp_matches(p_name, '(?i)RING|bolt') AND p_retailprice >= 950""")
def p07(t):
    spec = {"p_type": ["SMALL", "ECONOMY", "LARGE"], "p_size": {"min": 5, "max": 30}, "p_name": {"contains": "RING|bolt"},
            "p_retailprice": {"min": 950}, "no_such_column": 1}
    return R.apply_filters(t("part"), spec).select("p_partkey", "p_name", "p_size")


@query("p07b_filter_equality", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'")
def p07b(t):
    return R.apply_filters(t("orders"), {"o_orderstatus": "P"}).select("o_orderkey")


_NULLED = "CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END"


@query("p08_not_null", f"SELECT event_id, v FROM (SELECT event_id, {_NULLED} AS v FROM events) WHERE v IS NOT NULL")
def p08(t):
    return R.not_null(t("events").select("event_id", F.expr(_NULLED).alias("v")), ["v"])


@query("p09_alias_projection", """
SELECT o_orderkey, o_orderstatus AS sector_of_deployment, '[''' || o_orderpriority || ''', ''b'']' AS deployer, o_orderpriority AS deployer_primary FROM orders""")
def p09(t):
    df = t("orders").select("o_orderkey", F.col("o_orderstatus").alias("Sector of Deployment"),
                            F.expr("'[''' || o_orderpriority || ''', ''b'']'").alias("Alleged deployer"))
    df = R.with_aliases(df, {"sector_of_deployment": ["Sector of Deployment"]})
    df = R.with_aliases(df, {"deployer": ["Alleged Deployer"]}, primary=True)
    return df.select("o_orderkey", "sector_of_deployment", "deployer", "deployer_primary")


@query("p10_coalesce_headers", """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS value FROM orders""")
def p10(t):
    df = t("orders").select("o_orderkey", F.expr("CASE WHEN o_orderkey % 3 = 0 THEN 'n/a' ELSE o_orderstatus END").alias("Harm Type"),
                            F.expr("CASE WHEN o_orderkey % 2 = 0 THEN '[''none'', ''' || o_orderpriority || ''']' END").alias("harm.type"))
    return df.select("o_orderkey", R.coalesce_headers(df, ["Harm Type", "Harm.Type"]).alias("value"))


@query("p11_date_parts", """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN CAST(year(o_orderdate) AS BIGINT) END AS year,
  CASE WHEN o_orderkey % 5 > 0 THEN CAST(month(o_orderdate) AS BIGINT) END AS month FROM orders""")
def p11(t):
    text = F.expr("CASE WHEN o_orderkey % 5 > 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') ELSE 'soon' END")
    df = R.with_date_parts(t("orders").select("o_orderkey", text.alias("d")), "d")
    return df.select("o_orderkey", F.col("year").cast("bigint").alias("year"), F.col("month").cast("bigint").alias("month"))


@query("p12_null_flags", f"SELECT event_id, CASE WHEN event_id % 17 = 0 THEN 1 ELSE 0 END AS v_was_missing FROM events")
def p12(t):
    return R.with_null_flags(t("events").select("event_id", F.expr(_NULLED).alias("v")), ["v"]).select("event_id", "v_was_missing")


@query("p13_domain_anomalies", """
SELECT 'amount' AS "column", 'negative' AS rule, count(*) AS rows FROM customer WHERE c_acctbal - 500 < 0
UNION ALL SELECT 'price', 'negative', count(*) FROM customer WHERE c_nationkey - 20 < 0
UNION ALL SELECT 'volume', 'negative', count(*) FROM customer WHERE c_acctbal < 0 HAVING count(*) > 0""")
def p13(t):
    df = t("customer").select("c_custkey", (F.col("c_acctbal") - 500).alias("amount"), (F.col("c_nationkey") - 20).alias("price"), F.col("c_acctbal").alias("volume"))
    return R.domain_anomalies(df, "finance").select("column", "rule", "rows")


_YEARLY = "SELECT year(o_orderdate) AS year, count(*) AS incidents FROM orders GROUP BY 1"


@query("w01_rolling_mean", f"""
SELECT CAST(year AS BIGINT) AS year, incidents, round(avg(incidents) OVER (ORDER BY year ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS rolling_3y FROM ({_YEARLY})""")
def w01(t):
    y = A.yearly_counts(t("orders"), None, "o_orderdate").withColumnRenamed("count", "incidents")
    return W.rolling_mean(y, "year", "incidents", 3, "r").select(F.col("year").cast("bigint").alias("year"), "incidents", F.round("r", 6).alias("rolling_3y"))


@query("w02_running_sum", f"SELECT CAST(year AS BIGINT) AS year, CAST(sum(incidents) OVER (ORDER BY year) AS BIGINT) AS cumulative FROM ({_YEARLY})")
def w02(t):
    y = A.yearly_counts(t("orders"), None, "o_orderdate")
    return W.running_sum(y, "year", "count", "cumulative").select(F.col("year").cast("bigint").alias("year"), "cumulative")


@query("w03_monthly_rolling", """
SELECT strftime(m, '%Y-%m-%d') AS month_start, incidents, round(avg(incidents) OVER (ORDER BY m ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), 6) AS rolling_6m
FROM (SELECT date_trunc('month', o_orderdate) AS m, count(*) AS incidents FROM orders GROUP BY 1)""")
def w03(t):
    return P.monthly_rhythm(t("orders"), "o_orderdate").select(
        F.col("month_start").cast("string").alias("month_start"), "incidents", F.round("rolling_6m", 6).alias("rolling_6m"))


@query("w04_forward_fill", """
SELECT event_id, last_value(v IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v
FROM (SELECT event_id, ts, CASE WHEN event_id % 3 > 0 THEN NULL ELSE value END AS v FROM events)""")
def w04(t):
    df = t("events").select("event_id", "ts", F.expr("CASE WHEN event_id % 3 > 0 THEN NULL ELSE value END").alias("v"))
    return W.forward_fill(df, ["v"], ["ts", "event_id"]).select("event_id", "v")


@query("w04b_forward_fill_hot_key", """
SELECT event_id, last_value(v IGNORE NULLS) OVER (ORDER BY day, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v
FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 0 ELSE event_id END AS day, CASE WHEN event_id % 5 > 0 THEN NULL ELSE value END AS v FROM events)""")
def w04b(t):
    """Half of all rows share one order key."""
    df = t("events").select("event_id", F.expr("CASE WHEN event_id % 2 = 0 THEN 0 ELSE event_id END").alias("day"),
                            F.expr("CASE WHEN event_id % 5 > 0 THEN NULL ELSE value END").alias("v"))
    return W.forward_fill(df, ["v"], ["day", "event_id"]).select("event_id", "v")


@query("w04c_forward_fill_partitioned", """
SELECT event_id, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v
FROM (SELECT event_id, user_id, ts, CASE WHEN event_id % 3 > 0 THEN NULL ELSE value END AS v FROM events)""")
def w04c(t):
    df = t("events").select("event_id", "user_id", "ts", F.expr("CASE WHEN event_id % 3 > 0 THEN NULL ELSE value END").alias("v"))
    return W.forward_fill(df, ["v"], ["ts", "event_id"], ["user_id"]).select("event_id", "v")


@query("w04d_forward_fill_hot_group", """
SELECT event_id, last_value(v IGNORE NULLS) OVER (PARTITION BY owner ORDER BY kind, ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v,
  last_value(word IGNORE NULLS) OVER (PARTITION BY owner ORDER BY kind, ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS word
FROM (SELECT event_id, CASE WHEN event_id % 3 > 0 THEN 'one' WHEN event_id % 7 > 0 THEN NULL ELSE 'u' || user_id END AS owner, CASE WHEN event_id % 2 = 0 THEN 'a' ELSE event_type END AS kind, ts,
  CASE WHEN event_id % 5 > 0 THEN NULL ELSE value END AS v, CASE WHEN event_id % 11 > 0 THEN NULL ELSE event_type || event_id END AS word FROM events)""")
def w04d(t):
    """Two thirds of all rows are one group, a third shares its first order key, which is text, as is the null group's."""
    df = t("events").select("event_id", F.expr("CASE WHEN event_id % 3 > 0 THEN 'one' WHEN event_id % 7 > 0 THEN NULL ELSE 'u' || user_id END").alias("owner"),
                            F.expr("CASE WHEN event_id % 2 = 0 THEN 'a' ELSE event_type END").alias("kind"), "ts", F.expr("CASE WHEN event_id % 5 > 0 THEN NULL ELSE value END").alias("v"),
                            F.expr("CASE WHEN event_id % 11 > 0 THEN NULL ELSE event_type || event_id END").alias("word"))
    return W.forward_fill(df, ["v", "word"], ["kind", "ts", "event_id"], ["owner"]).select("event_id", "v", "word")


@query("w05_keep_first", "SELECT DISTINCT l_orderkey, l_returnflag FROM lineitem")
def w05(t):
    return W.keep_first(t("lineitem").select("l_orderkey", "l_returnflag"), ["l_orderkey", "l_returnflag"])


@query("w05b_keep_first_ordered", "SELECT l_partkey, l_orderkey, l_linenumber, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey, l_linenumber) = 1")
def w05b(t):
    rows = t("lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity", (-F.unix_micros(F.col("l_shipdate").cast("timestamp"))).alias("_age"))
    return W.keep_first(rows, ["l_partkey"], ["_age", "l_orderkey", "l_linenumber"]).drop("_age")


@query("w06_top_per_group", """
SELECT c_nationkey, c_custkey, rank FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer)
WHERE rank <= 3""")
def w06(t):
    top = W.top_per_group(t("customer"), "c_nationkey", [F.col("c_acctbal").desc(), F.col("c_custkey")], 3)
    return top.select("c_nationkey", "c_custkey", F.col("rank").cast("bigint").alias("rank"))


@query("w07_first_last_change", f"""
SELECT CAST(min(year) AS BIGINT) AS first_x, min_by(incidents, year) AS first_value, CAST(max(year) AS BIGINT) AS last_x, max_by(incidents, year) AS last_value,
  round((max_by(incidents, year) - min_by(incidents, year)) * 100.0 / min_by(incidents, year), 6) AS change_pct,
  CASE WHEN max_by(incidents, year) > min_by(incidents, year) THEN 'increased' ELSE 'decreased' END AS direction FROM ({_YEARLY})""")
def w07(t):
    c = W.first_last_change(A.yearly_counts(t("orders"), None, "o_orderdate"), "year", "count")
    return c.select(F.col("first_x").cast("bigint").alias("first_x"), "first_value", F.col("last_x").cast("bigint").alias("last_x"), "last_value",
                    F.round("change_pct", 6).alias("change_pct"), "direction")


_MAYBE = "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END"


@query("o01_sort_nulls_last", f"SELECT v, n, row_number() OVER (ORDER BY v ASC NULLS LAST) AS place FROM (SELECT {_MAYBE} AS v, count(*) AS n FROM orders GROUP BY 1)")
def o01(t):
    from pyspark.sql.window import Window

    counts = A.group_count(t("orders").select(F.expr(_MAYBE).alias("v")), "v", name="n")
    # a handful of aggregated rows; the sort itself is the operator, the place makes it visible to the check
    return R.sort_nulls_last(counts, "v").withColumn("place", F.row_number().over(Window.orderBy(F.col("v").asc_nulls_last())).cast("bigint"))


@query("o02_top_k", "SELECT o_custkey, count(*) AS count FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def o02(t):
    return A.ranked(A.group_count(t("orders"), "o_custkey"), "o_custkey", 10)


@query("o03_head", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 20")
def o03(t):
    return t("orders").select("o_orderkey", "o_totalprice").orderBy("o_orderkey").limit(20)


@query("o04_seeded_sample")
def o04(t):
    return R.text_sample(t("documents"), "text", 10, key=["doc_id"])


@query("o04b_seeded_sample_properties", "SELECT least(10, count(*)) AS rows, least(10, count(*)) AS from_table, true AS repeatable FROM documents WHERE text IS NOT NULL")
def o04b(t):
    """Size, membership and repetition of the sample."""
    docs = t("documents")
    first, again = R.text_sample(docs, "text", 10, key=["doc_id"]), R.text_sample(docs.repartition(7, "doc_id"), "text", 10, key=["doc_id"])
    member = first.join(docs.select(F.col("text").alias("sample")).distinct(), "sample", "left_semi").agg(F.count(F.lit(1)))
    return first.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows", member.scalar().alias("from_table"), (first.exceptAll(again).agg(F.count(F.lit(1))).scalar() == 0).alias("repeatable"))


@query("o05_fraction_sample")
def o05(t):
    return R.fraction_sample(t("lineitem"), 0.1).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query("o05b_fraction_sample_properties", "SELECT l_returnflag, true AS near_share, true AS from_table FROM lineitem GROUP BY 1")
def o05b(t):
    """Six standard deviations about the wanted share in each group; no row that is not in the table."""
    lines = t("lineitem")
    taken = R.fraction_sample(lines, 0.1).withColumn("_taken", F.lit(1)).select("l_orderkey", "l_linenumber", "l_returnflag", "_taken")
    counts = lines.select("l_returnflag", F.lit(0).alias("_taken")).unionAll(taken.select("l_returnflag", "_taken")).groupBy("l_returnflag").agg(
        F.sum("_taken").alias("n"), F.count_if(F.col("_taken") == 0).alias("all"))
    strange = taken.join(lines, ["l_orderkey", "l_linenumber"], "left_anti").agg(F.count(F.lit(1)))
    spread = F.abs(F.col("n") - 0.1 * F.col("all")) <= 6 * F.sqrt(0.09 * F.col("all")) + 1
    return counts.select("l_returnflag", spread.alias("near_share"), (strange.scalar() == 0).alias("from_table"))


@query("o06_history_page", "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40")
def o06(t):
    return history_page(t("orders"), 20, 40, "o_orderdate", "o_orderkey").select("o_orderkey")


@query("u01_union_ragged", """
SELECT c_custkey AS id, c_name AS name, NULL AS size FROM customer UNION ALL SELECT p_partkey, p_name, p_size FROM part
UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier""")
def u01(t):
    return R.union_ragged(
        t("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")),
        t("part").select(F.col("p_size").alias("size"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name")),
        t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")))


@query("u02_key_set_overlap", """
WITH l AS (SELECT DISTINCT o_custkey AS k FROM orders), r AS (SELECT DISTINCT l_partkey AS k FROM lineitem), c AS (SELECT count(*) AS n FROM l JOIN r USING (k)),
s AS (SELECT (SELECT count(*) FROM l) AS a, (SELECT count(*) FROM r) AS b, (SELECT n FROM c) AS n)
SELECT a AS left_distinct, b AS right_distinct, n AS common, round(n / (a + b - n), 9) AS jaccard, round(n / least(a, b), 9) AS overlap FROM s""")
def u02(t):
    o = key_set_overlap(t("orders"), t("lineitem"), "o_custkey", "l_partkey")
    return o.withColumns({"jaccard": F.round("jaccard", 9), "overlap": F.round("overlap", 9)})


@query("u03_tag_overlap", "SELECT p_partkey FROM part WHERE p_type IN ('SMALL', 'LARGE') OR p_brand IN ('SMALL', 'LARGE') OR p_name IN ('SMALL', 'LARGE')")
def u03(t):
    df = t("part").withColumn("tags", F.array("p_type", "p_brand", "p_name"))
    return R.tagged_with_any(df, "tags", ["SMALL", "LARGE"]).select("p_partkey")
