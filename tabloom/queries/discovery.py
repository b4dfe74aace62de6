"""Join-key discovery, checked against a direct SQL computation of every pair and strategy."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys as K
from ..operators import discovery as D
from .registry import query
from .sqltext import date, key, union

_COLUMNS = {
    "customer": {"c_custkey": "i", "c_name": "s", "c_nationkey": "i", "c_acctbal": "d", "c_mktsegment": "s"},
    "orders": {"o_orderkey": "i", "o_custkey": "i", "o_orderstatus": "s", "o_totalprice": "d", "o_orderdate": "t", "o_orderpriority": "s"},
    "part": {"p_partkey": "i", "p_name": "s", "p_brand": "s", "p_type": "s", "p_size": "i", "p_retailprice": "d"},
    "supplier": {"s_suppkey": "i", "s_name": "s", "s_nationkey": "i", "s_acctbal": "d"},
    "nation": {"n_nationkey": "i", "n_name": "s", "n_regionkey": "i"},
    "region": {"r_regionkey": "i", "r_name": "s"},
}


def _text(column: str, kind: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S')" if kind == "t" else f"CAST({column} AS VARCHAR)"


def _digits(column: str, kind: str) -> str:
    return f"CASE WHEN {column} = trunc({column}) THEN CAST(CAST({column} AS BIGINT) AS VARCHAR) ELSE CAST({column} AS VARCHAR) END" if kind == "d" else _text(column, kind)


def _cells(table: str) -> str:
    return union([f"SELECT {i} AS pos, '{c}' AS col, {_text(c, k)} AS v, {_digits(c, k)} AS d FROM {table}" for i, (c, k) in enumerate(_COLUMNS[table].items())])


def _side(table: str, s: str) -> str:
    index = union([f"SELECT pos, col, '{name}' AS strategy, {key('d' if name == 'id_strip' else 'v', name)} AS k, n FROM {s}_values" for name in K.STRATEGIES])
    return rf"""{s}_cells AS ({_cells(table)}),
{s}_values AS (SELECT pos, col, v, d, count(*) AS n FROM {s}_cells GROUP BY ALL),
{s}_traits AS (SELECT pos, col, CAST(sum(n) AS BIGINT) AS n_total, CAST(sum(n) FILTER (v IS NOT NULL) AS BIGINT) AS n_notnull, count(DISTINCT v) AS n_distinct,
  sum(CASE WHEN regexp_matches(v, '^\s*-?[\d,]+(\.\d+)?\s*$') THEN n ELSE 0 END) / sum(n) >= 0.80 AS looks_numeric,
  sum(CASE WHEN regexp_matches(v, '^[A-Za-z_#\-/]+\d+[A-Za-z0-9_\-/]*$') THEN n ELSE 0 END) / sum(n) >= 0.60 AS looks_id_prefix,
  sum(CASE WHEN {date('v')} IS NOT NULL THEN n ELSE 0 END) / sum(n) >= 0.75 AS looks_date FROM {s}_values GROUP BY 1, 2),
{s}_words AS (SELECT col, quantile_cont(len(string_split(trim(regexp_replace(v, '\s+', ' ', 'g')), ' ')), 0.5) >= 4 AS looks_free_text FROM {s}_cells GROUP BY 1),
{s}_index AS (SELECT pos, col, strategy, k, CAST(sum(n) AS BIGINT) AS n FROM ({index}) WHERE k IS NOT NULL GROUP BY ALL),
{s}_totals AS (SELECT col, strategy, CAST(sum(n) AS BIGINT) AS valid, count(*) AS keys FROM {s}_index GROUP BY ALL)"""


def _scored(left: str, right: str) -> str:
    def ladder(e: str, steps, op: str) -> str:
        return "CASE " + " ".join(f"WHEN {e} {op} {edge} THEN {points}" for edge, points in steps) + " ELSE 0.0 END"

    lt, rt = "l.n_distinct / l.n_notnull", "r.n_distinct / r.n_notnull"
    tokens = "list_filter(string_split_regex(lower({0}), '[^a-z0-9]'), lambda x: x <> '')"
    a, b = tokens.format("l.col"), tokens.format("r.col")
    return f"""WITH {_side(left, 'l')}, {_side(right, 'r')},
pairs AS (SELECT l.col AS lc, r.col AS rc, l.pos AS lp, r.pos AS rp,
    unnest(list_filter([CASE WHEN l.looks_date AND r.looks_date THEN 'date' END, CASE WHEN l.looks_numeric AND r.looks_numeric THEN 'numeric' END,
      CASE WHEN l.looks_id_prefix OR r.looks_id_prefix THEN 'id_strip' END, CASE WHEN NOT l.looks_numeric AND NOT r.looks_numeric THEN 'slug' END, 'casefold', 'exact'], lambda x: x IS NOT NULL)) AS strategy,
    generate_subscripts(list_filter([CASE WHEN l.looks_date AND r.looks_date THEN 'date' END, CASE WHEN l.looks_numeric AND r.looks_numeric THEN 'numeric' END,
      CASE WHEN l.looks_id_prefix OR r.looks_id_prefix THEN 'id_strip' END, CASE WHEN NOT l.looks_numeric AND NOT r.looks_numeric THEN 'slug' END, 'casefold', 'exact'], lambda x: x IS NOT NULL), 1) AS place
  FROM l_traits l JOIN l_words lw ON lw.col = l.col CROSS JOIN r_traits r JOIN r_words rw ON rw.col = r.col WHERE NOT lw.looks_free_text AND NOT rw.looks_free_text),
met AS (SELECT strategy, l.col AS lc, r.col AS rc, CAST(sum(l.n) AS BIGINT) AS matched_left, CAST(sum(r.n) AS BIGINT) AS matched_right, count(*) AS common_keys,
  CAST(sum(l.n * r.n) AS BIGINT) AS est_rows FROM l_index l JOIN r_index r USING (strategy, k) GROUP BY 1, 2, 3),
figures AS (SELECT p.*, coalesce(matched_left, 0) AS matched_left, coalesce(matched_right, 0) AS matched_right, coalesce(common_keys, 0) AS common_keys, coalesce(est_rows, 0) AS est_rows,
  coalesce(lt.valid, 0) AS l_valid, coalesce(rt.valid, 0) AS r_valid, coalesce(matched_left / lt.valid, 0.0) AS lf, coalesce(matched_right / rt.valid, 0.0) AS rf
  FROM pairs p LEFT JOIN met USING (strategy, lc, rc) LEFT JOIN l_totals lt ON lt.col = lc AND lt.strategy = p.strategy LEFT JOIN r_totals rt ON rt.col = rc AND rt.strategy = p.strategy),
best AS (SELECT f.*, row_number() OVER (PARTITION BY lc, rc ORDER BY sqrt(lf * rf) DESC, place) AS r FROM figures f
  JOIN l_traits l ON l.col = lc JOIN r_traits r ON r.col = rc WHERE l_valid / l.n_total >= 0.3 AND r_valid / r.n_total >= 0.3),
points AS (SELECT best.*, l.n_total AS left_total, r.n_total AS right_total, sqrt(lf * rf) * 55.0 AS overlap_pts, {ladder(f'least({lt}, {rt})', D.UNIQUENESS_POINTS, '>=')} AS uniqueness_pts,
  {ladder('greatest(1 - l.n_notnull / l.n_total, 1 - r.n_notnull / r.n_total)', D.NULL_RATE_POINTS, '<=')} AS null_rate_pts,
  {ladder('least(l.n_distinct, r.n_distinct) / greatest(l.n_distinct, r.n_distinct)', D.CARDINALITY_POINTS, '>=')} AS cardinality_pts,
  CASE WHEN (l.looks_numeric AND r.looks_numeric) OR (l.looks_date AND r.looks_date) THEN 5.0 WHEN NOT (l.looks_numeric OR r.looks_numeric OR l.looks_date OR r.looks_date) THEN 3.0 ELSE 1.0 END AS pattern_pts,
  2.0 * len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) AS name_pts,
  CASE WHEN {lt} >= 0.95 AND {rt} >= 0.95 AND lf >= 0.85 THEN 'inner' WHEN lf >= rf THEN 'left' ELSE 'right' END AS join_type
  FROM best JOIN l_traits l ON l.col = lc JOIN r_traits r ON r.col = rc WHERE best.r = 1 AND (lf > 0 OR rf > 0)),
ranked AS (SELECT *, least(100.0, overlap_pts + uniqueness_pts + null_rate_pts + cardinality_pts + pattern_pts + name_pts) AS confidence FROM points)
"""


_CO = _scored("customer", "orders")


@query("d01_join_profile", f"""{_CO} SELECT col AS "column", n_total, n_notnull, n_distinct, round(n_distinct / n_notnull, 9) AS uniqueness, looks_numeric, looks_date, looks_id_prefix, looks_free_text
FROM r_traits JOIN r_words USING (col)""", spread=True)
def d01(t):
    p = D.join_profile(t("orders"))
    return p.select("column", "n_total", "n_notnull", "n_distinct", F.round("uniqueness", 9).alias("uniqueness"), "looks_numeric", "looks_date", "looks_id_prefix", "looks_free_text")


@query("d02_candidate_strategies", f"{_CO} SELECT lc AS left_col, rc AS right_col, CAST(place - 1 AS BIGINT) AS position, strategy FROM pairs", spread=True)
def d02(t):
    return D.candidate_strategies(t("customer"), t("orders")).withColumn("position", F.col("position").cast("bigint"))


@query("d03_value_overlap", f"""{_CO} SELECT lc AS left_col, rc AS right_col, strategy, matched_left, matched_right, common_keys, est_rows, round(lf, 9) AS left_overlap, round(rf, 9) AS right_overlap FROM figures""", spread=True)
def d03(t):
    s = D.scored_strategies(t("customer"), t("orders"))
    return s.select("left_col", "right_col", "strategy", "matched_left", "matched_right", "common_keys", F.col("est_rows").cast("bigint").alias("est_rows"),
                    F.round("left_overlap", 9).alias("left_overlap"), F.round("right_overlap", 9).alias("right_overlap"))


@query("d03b_one_pair_overlap", f"""
WITH l AS (SELECT {key('c_name', 'id_strip')} AS k, count(*) AS n FROM customer GROUP BY 1), r AS (SELECT CAST(o_custkey AS VARCHAR) AS k, count(*) AS n FROM orders GROUP BY 1)
SELECT CAST(sum(l.n) AS BIGINT) AS matched_left, CAST(sum(r.n) AS BIGINT) AS matched_right, count(*) AS common_keys FROM l JOIN r USING (k)""")
def d03b(t):
    return D.value_overlap(t("customer"), t("orders"), "c_name", "o_custkey", K.ID_STRIP).select("matched_left", "matched_right", "common_keys")


@query("d04_best_strategy", f"{_CO} SELECT lc AS left_col, rc AS right_col, strategy, round(sqrt(lf * rf), 9) AS score FROM best WHERE r = 1", spread=True)
def d04(t):
    b = D.best_strategies(D.scored_strategies(t("customer"), t("orders")))
    return b.select("left_col", "right_col", "strategy", F.round("score", 9).alias("score"))


_POINTS = "overlap_pts uniqueness_pts null_rate_pts cardinality_pts pattern_pts name_pts".split()


@query("d05_pair_signals", f"{_CO} SELECT lc AS left_col, rc AS right_col, {', '.join(f'round({p}, 6) AS {p}' for p in _POINTS)} FROM ranked", spread=True)
def d05(t):
    s = D.score_pairs(D.best_strategies(D.scored_strategies(t("customer"), t("orders"))))
    return s.select("left_col", "right_col", *[F.round(p, 6).alias(p) for p in _POINTS])


@query("d06_detect_joins", f"""{_CO} SELECT lc AS left_col, rc AS right_col, strategy, join_type, round(confidence, 6) AS confidence, matched_left AS match_count,
  round(100.0 * matched_left / left_total, 6) AS left_match_pct, round(100.0 * common_keys / right_total, 6) AS right_match_pct, est_rows AS est_output_rows
FROM ranked WHERE confidence >= 5 ORDER BY ranked.confidence DESC, lc, rc LIMIT 8""", spread=True)
def d06(t):
    c = D.detect_joins(t("customer"), t("orders"))
    return c.select("left_col", "right_col", "strategy", "join_type", F.round("confidence", 6).alias("confidence"), "match_count",
                    F.round("left_match_pct", 6).alias("left_match_pct"), F.round("right_match_pct", 6).alias("right_match_pct"),
                    F.col("est_output_rows").cast("bigint").alias("est_output_rows"))


@query("d06b_detect_joins_part_supplier", f"""{_scored('part', 'supplier')} SELECT lc AS left_col, rc AS right_col, strategy, join_type, round(confidence, 6) AS confidence
FROM ranked WHERE confidence >= 5 ORDER BY ranked.confidence DESC, lc, rc LIMIT 20""", spread=True)
def d06b(t):
    c = D.detect_joins(t("part"), t("supplier"), top_n=20)
    return c.select("left_col", "right_col", "strategy", "join_type", F.round("confidence", 6).alias("confidence"))


@query("d07_join_type", f"{_CO} SELECT lc AS left_col, rc AS right_col, join_type FROM ranked", spread=True)
def d07(t):
    return D.score_pairs(D.best_strategies(D.scored_strategies(t("customer"), t("orders")))).select("left_col", "right_col", "join_type")


@query("d08_enriched_candidate", f"""{_CO} SELECT left_total, right_total, matched_left AS match_count, round(100.0 * common_keys / right_total, 6) AS right_match_pct, est_rows AS est_output_rows
FROM ranked WHERE lc = 'c_name' AND rc = 'o_custkey'""", spread=True)
def d08(t):
    c = D.detect_joins(t("customer"), t("orders"), top_n=100).where("left_col = 'c_name' AND right_col = 'o_custkey'")
    return c.select("left_total", "right_total", "match_count", F.round("right_match_pct", 6).alias("right_match_pct"), F.col("est_output_rows").cast("bigint").alias("est_output_rows"))


def _suggest(a, b, x, y):
    common = f"(SELECT count(*) FROM (SELECT DISTINCT {a} AS k FROM {x}) JOIN (SELECT DISTINCT {b} AS k FROM {y}) USING (k))"
    return f"""SELECT {common} AS common, (SELECT count(DISTINCT {a}) FROM {x}) AS ld, (SELECT count(DISTINCT {b}) FROM {y}) AS rd, (SELECT count(*) FROM {x}) AS ln, (SELECT count(*) FROM {y}) AS rn"""


@query("d09_suggest_merge_keys", f"""
WITH f AS (SELECT 'custkey' AS left_col, 'custkey' AS right_col, 0.9 AS base, * FROM ({_suggest('o_custkey', 'c_custkey', 'orders', 'customer')})
  UNION ALL SELECT 'order_status', 'orderstatus', 0.7, * FROM ({_suggest('o_orderstatus', 'c_mktsegment', 'orders', 'customer')})
  UNION ALL SELECT 'nation_key', 'nationkey', 0.6, * FROM ({_suggest('o_orderkey', 'c_nationkey', 'orders', 'customer')})), g AS (SELECT *, common / least(ld, rd) AS o FROM f)
SELECT left_col, right_col, round(least(1.0, base + CASE WHEN o > 0.5 THEN 0.3 ELSE 0.1 END), 2) AS confidence_score, round(o, 2) AS overlap_pct,
  CASE WHEN ld / ln > 0.9 AND rd / rn > 0.9 THEN 'inner' WHEN ld / ln > 0.9 THEN 'right' WHEN rd / rn > 0.9 THEN 'left' ELSE 'inner' END AS join_type FROM g WHERE o >= 0.2 LIMIT 3""")
def d09(t):
    l = t("orders").select(F.col("o_custkey").alias("custkey"), F.col("o_orderstatus").alias("order_status"), F.col("o_orderkey").alias("nation_key"))
    r = t("customer").select(F.col("c_custkey").alias("custkey"), F.col("c_mktsegment").alias("orderstatus"), F.col("c_nationkey").alias("nationkey"))
    return D.suggest_merge_keys(l, r)


_KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "orders": "o_orderkey"}


def _edges() -> str:
    values = union([f"SELECT DISTINCT '{t}' AS tab, '{c}' AS col, nullif(regexp_replace(trim({_text(c, k)}), '\\.0+$', ''), '') AS k FROM {t}" for t in _KEYS for c, k in _COLUMNS[t].items()])
    marks = ", ".join(f"('{t}', '{c}')" for t, c in _KEYS.items())
    return f"""WITH v AS (SELECT * FROM ({values}) WHERE k IS NOT NULL), n AS (SELECT tab, col, count(*) AS total FROM v GROUP BY ALL), p AS (SELECT * FROM v WHERE (tab, col) IN ({marks})),
m AS (SELECT v.tab AS source_table, v.col AS source_column, p.tab AS target_table, p.col AS target_column, count(*) AS matched_values FROM v JOIN p ON v.k = p.k AND v.tab <> p.tab GROUP BY ALL)
SELECT m.*, round(100.0 * matched_values / total, 2) AS overlap_pct FROM m JOIN n ON tab = source_table AND col = source_column WHERE round(100.0 * matched_values / total, 2) >= 5"""


@query("d10_infer_relationships", _edges(), spread=True)
def d10(t):
    return D.infer_relationships({name: t(name) for name in _KEYS}, list(_KEYS.values()))
