import math

import pytest
from pyspark.sql import functions as F

from tabloom.functions import keys as K
from tabloom.operators import discovery as D, joins as J

LEFT = [("EMP-001", "Alice", "2021-01-10", 85000), ("EMP-002", "Bob", "2020-06-15", 92000), ("EMP-003", "Carol", "2022-03-01", 78000),
        ("EMP-004", "Dave", "2019-11-20", 110000), ("EMP-005", "Eve", "2023-07-04", 67000)]
RIGHT = [(1, "Alice Smith", "Jan 10 2021", 85000), (2, "Bob Jones", "Jun 15 2020", 92000), (3, "Carol White", "Mar 01 2022", 78000),
         (5, "Eve Brown", "Jul 04 2023", 67000), (6, "Frank Black", "Feb 28 2024", 55000)]


@pytest.fixture(scope="module")
def people(spark):
    return (spark.createDataFrame(LEFT, "col_a string, col_b string, col_c string, col_d bigint"),
            spark.createDataFrame(RIGHT, "ref bigint, full_name string, joined string, gross_pay bigint"))


def test_unrelated_names_and_formats_are_matched(people):
    found = {(r.left_col, r.right_col): r for r in D.detect_joins(*people).collect()}
    for pair, strategy in {("col_a", "ref"): K.ID_STRIP, ("col_c", "joined"): K.DATE, ("col_d", "gross_pay"): K.NUMERIC}.items():
        row = found[pair]
        assert row.strategy == strategy and row.match_count == 4 and math.isclose(row.overlap_pts, 44.0)
        assert row.left_match_pct == 80.0 and row.join_type == "left" and row.uniqueness_pts == 20.0 and row.null_rate_pts == 10.0
    assert [s.type for s in found["col_a", "ref"].signals] == ["value_overlap", "uniqueness", "null_rate", "cardinality_sym", "dtype_compat"]


def test_overlap_equals_brute_force(spark):
    l = [f"k{i % 7}" if i % 5 else None for i in range(60)]
    r = [f"K{i % 11}" for i in range(33)]
    ldf, rdf = spark.createDataFrame([(v,) for v in l], "a string"), spark.createDataFrame([(v,) for v in r], "b string")
    row = D.value_overlap(ldf, rdf, "a", "b", K.CASEFOLD).first()
    lk, rk = [v.lower() for v in l if v], [v.lower() for v in r]
    assert row.matched_left == sum(v in set(rk) for v in lk) and row.matched_right == sum(v in set(lk) for v in rk)
    assert row.common_keys == len(set(lk) & set(rk)) and row.est_rows == sum(lk.count(k) * rk.count(k) for k in set(lk) & set(rk))
    assert (row.l_valid, row.r_valid) == (len(lk), len(rk))


def test_empty_and_free_text_columns_are_left_out(spark):
    l = spark.createDataFrame([(str(i), None, "these are four words") for i in range(5)], "id string, gone string, prose string")
    pairs = D.scored_strategies(l, l).select("left_col", "right_col").distinct().collect()
    assert [tuple(p) for p in pairs] == [("id", "id")]


def test_null_keys(spark):
    l, r = spark.createDataFrame([(1,), (None,), (None,)], "k bigint"), spark.createDataFrame([(1,), (None,)], "k bigint")
    assert J.join_on_key(l, r, "k", "k", how="outer").count() == 3
    assert J.join_on_key(l, r, "k", "k", how="outer", nulls_match=False).count() == 4
    s = J.match_stats(l, r, "k", "k", how="outer").first()
    assert (s.matched_rows, s.left_only_rows, s.right_only_rows) == (3, 0, 0)
    s = J.match_stats(l, r, "k", "k", how="outer", nulls_match=False).first()
    assert (s.matched_rows, s.left_only_rows, s.right_only_rows) == (1, 2, 1)
    assert any("null keys" in w.warning for w in J.join_warnings(l, r, "k", "k").collect())


@pytest.mark.parametrize("how", J.HOW)
def test_hot_key_with_a_third_of_the_rows(spark, how):
    l = spark.range(3000).select(F.expr("CASE WHEN id % 3 = 0 THEN 'HOT-1' ELSE 'L-' || (id + 10) END").alias("a"))
    r = spark.range(300).select(F.expr("CASE WHEN id % 3 = 0 THEN '1' ELSE CAST(id AS STRING) || '9' END").alias("b"))
    stats = J.match_stats(l, r, "a", "b", K.ID_STRIP, how).first()
    assert J.join_on_key(l, r, "a", "b", K.ID_STRIP, how).count() == stats.merged_rows and stats.matched_rows >= 1000 * 100


def test_collisions_and_conflict_report(spark):
    l, r = spark.createDataFrame([(1, "x", 2)], "id int, name string, v int"), spark.createDataFrame([(1, "y", 3)], "id int, name string, w int")
    j = J.join_on_key(l, r, "id", "id")
    assert j.columns == ["id_left", "name_left", "v", "id_right", "name_right", "w"]
    assert J.reported_conflicts(l, r, "id", "id") == ["name"]


def test_preview_limits(spark):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    assert J.preview(df).collect() == [("1", "")]
    with pytest.raises(ValueError):
        J.preview(df, 500)


def test_no_cartesian_product_in_discovery(people):
    import contextlib
    import io

    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        D.detect_joins(*people).explain("formatted")
    assert "CartesianProduct" not in out.getvalue() and "NestedLoop" not in out.getvalue()


def test_relationships(spark):
    tables = {
        "incidents": spark.createDataFrame([(11, "a"), (12, "b")], "incident_id bigint, t string"),
        "entities": spark.createDataFrame([("11.0",), ("11",), ("99",)], "incident_id string"),
    }
    edges = D.infer_relationships(tables).collect()
    assert [(e.source_table, e.target_table, e.matched_values, e.overlap_pct) for e in edges] == [("entities", "incidents", 1, 50.0)]


@pytest.mark.parametrize("how", J.HOW)
def test_hot_keys_are_joined_in_cells(spark, monkeypatch, how):
    monkeypatch.setattr(J, "HOT_ROWS", 100)
    monkeypatch.setattr(J, "BLOCK", 8)
    key = lambda i, hot: None if i % 3 == 0 else "hot" if i % 3 == 1 else f"{hot}{i % 4}"
    l, r = [(key(i, "k"), i % 40, {"m": i % 2}) for i in range(90)], [(key(i, "k" if i % 2 else "only"), i) for i in range(70)]
    left, right = spark.createDataFrame(l, "a string, x int, m map<string,int>").repartition(3), spark.createDataFrame(r, "b string, y int")
    for nulls_match in (True, False):
        same = lambda a, b: a == b and (nulls_match or a is not None)
        want = [(a[0], a[1], b[0], b[1]) for a in l for b in r if same(a[0], b[0])]
        if how in ("left", "outer"):
            want += [(a[0], a[1], None, None) for a in l if not any(same(a[0], b[0]) for b in r)]
        if how in ("right", "outer"):
            want += [(None, None, b[0], b[1]) for b in r if not any(same(a[0], b[0]) for a in l)]
        got = J.join_on_key(left, right, "a", "b", K.EXACT, how, nulls_match=nulls_match)
        assert got.columns == ["a", "x", "m", "b", "y"]
        assert sorted(map(repr, (tuple(row) for row in got.select("a", "x", "b", "y").collect()))) == sorted(map(repr, want))
    met = J.join_on_key(left, right, "a", "b", K.EXACT, how).where("a = 'hot'")
    # 30 by 23 rows are four by three cells: no task has them all
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [n["count"] for n in met.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 30 * 23 and max(sizes) < 30 * 23


def test_listed_keys_are_counted_in_many_tasks(spark):
    rows = spark.range(400).select((F.col("id") % 40).alias("k"), (F.col("id") % 7).cast("string").alias("v"))
    cells = rows.groupBy("k").agg(F.collect_list("v").alias("refs"))  # small enough to be merged into one partition
    lookup = spark.createDataFrame([("1", "one"), ("6", "six")], "ref string, name string")
    found = J.list_key_lookup(cells, "k", F.col("refs"), lookup, "ref")
    assert found.count() == 40 * 7 and found.where("name = 'one'").count() == 40
    assert found.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_number_keys_are_those_of_their_text(spark):
    ints = [0, 7, -5, 1999, 20240131, -1234, 999_999_999_999_999, 1_000_000_000_000_000, 9_007_199_254_740_993, -(2**63), None]
    reals = [0.0, -0.0, 42.0, 4516.95, -0.5, 1e-5, 0.00012345678901234567, 12345678.9, 1e16, 1e37, 3e300, -2.5e-7, float("inf"), -float("inf"), float("nan"), None]
    for values, kind in ((ints, "bigint"), (reals, "double")):
        df = spark.createDataFrame([(v,) for v in values], f"x {kind}")
        dtype = df.schema["x"].dataType
        for s in K.STRATEGIES:
            text = K.value_text(F.col("x"), dtype)
            rows = df.select("x", K.typed_key(F.col("x"), dtype, text, s).alias("a"), K.join_key(F.col("x"), dtype, s).alias("b")).collect()
            assert [r.a for r in rows] == [r.b for r in rows], (kind, s)


def test_strategies_with_one_key_share_a_row(spark):
    df = spark.range(100).select("id", F.format_string("N-%d", "id").alias("name"))
    index = D.key_index(df, {"id": [K.EXACT, K.CASEFOLD, K.NUMERIC, K.ID_STRIP], "name": [K.EXACT, K.ID_STRIP]})
    assert index.where("c = 0").count() == 100 and index.where("c = 1").count() == 200
    row = index.where("c = 0 and key = '42'").first()
    assert (row.exact, row.casefold, row.numeric, row.id_strip, row.slug) == (1, 1, 1, 1, None)
