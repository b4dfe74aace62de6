"""Joins on normalised keys, their accounting, and size estimates."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from ..functions import keys as K, text as X
from ..operators import joins as J
from .registry import query
from .sqltext import key

# Keys with holes on both sides: every 50th customer and every 400th order has no key.
_LEFT = "SELECT c_custkey, CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE c_name END AS ref, c_nationkey AS shared FROM customer"
_RIGHT = "SELECT o_orderkey, CASE WHEN o_orderkey % 400 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN -o_custkey - 100000000 ELSE o_custkey END AS cust, o_orderpriority AS shared FROM orders"
_LK, _RK = key("ref", "id_strip"), key("CAST(cust AS VARCHAR)", "id_strip")
_KEYED = f"WITH l AS (SELECT *, {_LK} AS lk FROM ({_LEFT})), r AS (SELECT *, {_RK} AS rk FROM ({_RIGHT}))"


def left(t):
    return t("customer").select("c_custkey", F.expr("CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE c_name END").alias("ref"), F.col("c_nationkey").alias("shared"))


def right(t):
    cust = F.expr("CASE WHEN o_orderkey % 400 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN -o_custkey - 100000000 ELSE o_custkey END")
    return t("orders").select("o_orderkey", cust.alias("cust"), F.col("o_orderpriority").alias("shared"))


def _join(how: str, nulls_match: bool):
    word = {"inner": "JOIN", "left": "LEFT JOIN", "right": "RIGHT JOIN", "outer": "FULL JOIN"}[how]
    on = "lk IS NOT DISTINCT FROM rk" if nulls_match else "lk = rk"
    suffix = "" if nulls_match else "_sql_nulls"

    @query(f"j01_join_{how}{suffix}", f"{_KEYED} SELECT c_custkey, ref, l.shared AS shared_left, o_orderkey, cust, r.shared AS shared_right FROM l {word} r ON {on}")
    def joined(t):
        return J.join_on_key(left(t), right(t), "ref", "cust", K.ID_STRIP, how, nulls_match=nulls_match)

    side = lambda name, keep: f"count(*) FILTER ({name})" if keep else "CAST(0 AS BIGINT)"
    lone_l, lone_r = "o_orderkey IS NULL", "c_custkey IS NULL"

    @query(f"j02_match_stats_{how}{suffix}", f"""{_KEYED}, m AS (SELECT c_custkey, o_orderkey FROM l {word} r ON {on})
SELECT (SELECT count(*) FROM l) AS left_rows, (SELECT count(*) FROM r) AS right_rows, count(*) AS merged_rows,
  count(*) FILTER (c_custkey IS NOT NULL AND o_orderkey IS NOT NULL) AS matched_rows, {side(lone_l, how in ('left', 'outer'))} AS left_only_rows,
  {side(lone_r, how in ('right', 'outer'))} AS right_only_rows,
  (SELECT count(lk) - count(DISTINCT lk) FROM l) + (SELECT count(rk) - count(DISTINCT rk) FROM r) AS duplicate_keys FROM m""")
    def stats(t):
        s = J.match_stats(left(t), right(t), "ref", "cust", K.ID_STRIP, how, nulls_match)
        return s.select("left_rows", "right_rows", *[F.col(c).cast("bigint").alias(c) for c in (
            "merged_rows", "matched_rows", "left_only_rows", "right_only_rows", "duplicate_keys")])


for _how in J.HOW:
    for _nulls in (True, False):
        _join(_how, _nulls)


@query("j03_collision_suffixes", "SELECT n_nationkey AS id_a, n_name AS name_a, r_regionkey AS id_b, r_name AS name_b, 'name' AS reported FROM nation JOIN region ON n_regionkey = r_regionkey")
def j03(t):
    l = t("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), "n_regionkey")
    r = t("region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    joined = J.join_on_key(l, r, "n_regionkey", "id", suffixes=("_a", "_b"))
    return joined.select("id_a", "name_a", "id_b", "name_b", F.lit(", ".join(J.reported_conflicts(l, r, "n_regionkey", "id"))).alias("reported"))


@query("j04_fan_out_warnings", f"""{_KEYED}
SELECT 1 AS position, 'right ''cust'' repeats ' || (SELECT count(rk) - count(DISTINCT rk) FROM r) || ' keys; rows may multiply' AS warning
UNION ALL SELECT 3, 'shared columns renamed with _left/_right: shared'
UNION ALL SELECT 4, (SELECT count(*) FROM l WHERE lk IS NULL) || ' left and ' || (SELECT count(*) FROM r WHERE rk IS NULL) || ' right null keys match each other'""")
def j04(t):
    return J.join_warnings(left(t), right(t), "ref", "cust", K.ID_STRIP, "inner")


@query("j05_preview", f"""{_KEYED} SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, coalesce(CAST(o_orderkey AS VARCHAR), '') AS o_orderkey
FROM l LEFT JOIN r ON lk = rk ORDER BY l.c_custkey, r.o_orderkey NULLS FIRST LIMIT 20""")
def j05(t):
    joined = J.join_on_key(left(t), right(t), "ref", "cust", K.ID_STRIP, "left", nulls_match=False).select("c_custkey", "o_orderkey")
    return J.preview(joined, 20, ["c_custkey", "o_orderkey"])


@query("j06_plain_merge", "SELECT s_suppkey, s_name, s_nationkey, n_name, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def j06(t):
    return J.merge_on_columns(t("supplier"), t("nation"), "s_nationkey", "n_nationkey").select("s_suppkey", "s_name", "s_nationkey", "n_name", "n_regionkey")


@query("j06b_merge_checks", """
WITH m AS (SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = CASE WHEN o_orderstatus = 'P' THEN o_custkey ELSE -o_custkey END)
SELECT count(*) AS rows, CAST(2 * count(*) FILTER (o_orderkey IS NULL) AS BIGINT) AS null_cells,
  count(*) > 5 * ((SELECT count(*) FROM customer) + (SELECT count(*) FROM orders)) AS fan_out FROM m""")
def j06b(t):
    # keys of most orders are rewritten, so that there are rows without a match on both sides
    key = F.when(F.col("o_orderstatus") == "P", F.col("o_custkey")).otherwise(-F.col("o_custkey"))
    l, r = t("customer").select("c_custkey", "c_name"), t("orders").select("o_orderkey", key.alias("o_custkey"))
    return J.merge_checks(l, r, J.merge_on_columns(l, r, "c_custkey", "o_custkey", "left"))


@query("j06c_same_name_outer", """
SELECT coalesce(a, b) AS nationkey, count(*) AS rows FROM (SELECT c_nationkey AS a FROM customer) FULL JOIN (SELECT s_nationkey + 10 AS b FROM supplier) ON a = b GROUP BY 1""")
def j06c(t):
    """Rows per key, from key counts merged: the rows of a nation need not be multiplied to be counted."""
    l = t("customer").groupBy(F.col("c_nationkey").alias("nationkey")).agg(F.count(F.lit(1)).alias("customers"))
    r = t("supplier").groupBy((F.col("s_nationkey") + 10).alias("nationkey")).agg(F.count(F.lit(1)).alias("suppliers"))
    one = F.lit(1).cast("bigint")
    merged = J.merge_on_columns(l, r, "nationkey", "nationkey", "outer")
    return merged.select("nationkey", (F.coalesce("customers", one) * F.coalesce("suppliers", one)).alias("rows"))


@query("j07_heuristic_size", """
WITH n AS (SELECT (SELECT count(*) FROM customer) AS l, (SELECT count(*) FROM orders) AS r)
SELECT 'left' AS how, CAST(floor(l * 1.5) AS BIGINT) AS estimated_rows, round(l * 1.5 * 10 * 8 / 1048576.0, 9) AS estimated_memory_mb FROM n
UNION ALL SELECT 'right', CAST(floor(r * 1.5) AS BIGINT), round(r * 1.5 * 10 * 8 / 1048576.0, 9) FROM n
UNION ALL SELECT 'outer', l + r, round((l + r) * 10 * 8 / 1048576.0, 9) FROM n""")
def j07(t):
    parts = [J.heuristic_join_size(t("customer"), t("orders"), how).select(F.lit(how).alias("how"), "estimated_rows", F.round("estimated_memory_mb", 9).alias("estimated_memory_mb"))
             for how in ("left", "right", "outer")]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@query("j08_exact_size", "SELECT CAST(count(*) AS BIGINT) AS est_rows, count(DISTINCT o_custkey) AS common_keys FROM orders JOIN lineitem ON o_custkey = l_partkey")
def j08(t):
    return J.exact_join_size(t("orders"), t("lineitem"), "o_custkey", "l_partkey").select(F.col("est_rows").cast("bigint").alias("est_rows"), "common_keys")


@query("j09_enrichment_chain", """
SELECT n_nationkey, customers, suppliers FROM nation LEFT JOIN (SELECT CASE WHEN c_acctbal < 0 THEN c_nationkey ELSE -1 - c_nationkey END AS k, count(*) AS customers FROM customer GROUP BY 1) ON k = n_nationkey
LEFT JOIN (SELECT s_nationkey, count(*) AS suppliers FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey""")
def j09(t):
    base = t("nation").select("n_nationkey")
    key = F.when(F.col("c_acctbal") < 0, F.col("c_nationkey")).otherwise(-1 - F.col("c_nationkey"))
    c = t("customer").groupBy(key.alias("n_nationkey")).agg(F.count(F.lit(1)).alias("customers"))
    s = t("supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("suppliers"))
    return J.enrich(base, "n_nationkey", c, None, s)


@query("j10_list_key_lookup", """
WITH k AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)
SELECT l_orderkey AS order_id, count(*) AS listed, count(p_partkey) AS found, max(p_name) AS last_name FROM k LEFT JOIN part ON l_partkey = CASE WHEN p_size > 10 THEN p_partkey ELSE -p_partkey END GROUP BY 1""")
def j10(t):
    # list cells such as "['12', '7', '12']", as multi-valued references are published
    cells = t("lineitem").groupBy(F.col("l_orderkey").alias("order_id")).agg(
        F.concat(F.lit("['"), F.array_join(F.collect_list(F.col("l_partkey").cast("string")), "', '"), F.lit("']")).alias("refs"))
    key = F.when(F.col("p_size") > 10, F.col("p_partkey")).otherwise(-F.col("p_partkey"))
    lookup = t("part").select(key.cast("string").alias("part_key"), "p_name")
    rows = J.list_key_lookup(cells, "order_id", X.parse_list(F.col("refs")), lookup, "part_key")
    return rows.groupBy("order_id").agg(F.count(F.lit(1)).alias("listed"), F.count("_lookup").alias("found"), F.max("p_name").alias("last_name"))


@query("j11_top_categories_only", """
WITH a AS (SELECT c_nationkey FROM customer GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5), b AS (SELECT c_mktsegment FROM customer GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 2)
SELECT c_custkey FROM customer WHERE c_nationkey IN (FROM a) AND c_mktsegment IN (FROM b)""")
def j11(t):
    kept = J.top_categories_only(t("customer"), ["c_nationkey"], 5)
    segments = t("customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "c_mktsegment").limit(2)
    return kept.join(F.broadcast(segments), "c_mktsegment", "left_semi").select("c_custkey")


@query("j12_matching_rows", f"{_KEYED} SELECT c_custkey, ref, lk IN (SELECT rk FROM r WHERE rk IS NOT NULL) AND lk IS NOT NULL AS matched FROM l")
def j12(t):
    both = [J.matching_rows(left(t), right(t), "ref", "cust", K.ID_STRIP, m).select("c_custkey", "ref", F.lit(m).alias("matched")) for m in (True, False)]
    return both[0].unionAll(both[1])


@query("j12b_match_samples", f"""{_KEYED}, s AS (SELECT ref, lk, coalesce(lk IN (SELECT rk FROM r WHERE rk IS NOT NULL), false) AS matched FROM l)
SELECT matched, ref AS left_raw, lk AS key FROM (SELECT *, row_number() OVER (PARTITION BY matched ORDER BY ref NULLS FIRST) AS n FROM s) WHERE n <= 5""")
def j12b(t):
    return J.match_samples(left(t), right(t), "ref", "cust", K.ID_STRIP)
