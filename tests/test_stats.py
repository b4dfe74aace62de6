import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabloom.operators import aggregates as A, cleaning as C, profile as P, quantiles as Q, rows as R, windows as W


def frame(spark, values, kind="double"):
    return spark.createDataFrame([(float(v) if v is not None else None,) for v in values], f"x {kind}")


def test_adjusted_skewness_and_kurtosis(spark):
    m = A.numeric_moments(frame(spark, [1, 2, 3, 10, 4])).first()
    p = P.column_profile(frame(spark, [1, 2, 3, 10, 4])).first()
    for row in (m, p):
        assert round(row.skewness, 5) == 1.69706 and round(row.kurtosis, 3) == 3.152
    assert (p.median, p.q1, p.q3) == (3.0, 2.0, 4.0)


def test_constant_column(spark):
    p = P.column_profile(frame(spark, [5] * 12)).first()
    assert (p.skewness, p.kurtosis, p.std, p.outlier_count) == (0.0, 0.0, 0.0, 0)
    assert A.correlation_pairs(spark.range(5).selectExpr("id AS a", "1.0 AS b")).first().r is None


def test_normality_scores(spark):
    def scores(values):
        df = frame(spark, values).agg(F.count("x").cast("double").alias("n"), F.skewness("x").alias("s"), F.kurtosis("x").alias("k"))
        return df.select(C.skew_z(F.col("n"), F.col("s")).alias("a"), C.kurtosis_z(F.col("n"), F.col("k") + 3).alias("b")).first()

    assert round(scores([2, 8, 0, 4, 1, 9, 9, 0]).a, 6) == 0.446264
    assert round(scores(range(1, 9)).a, 6) == 1.010805
    assert round(scores(range(20)).b, 6) == -1.705810


def test_normal_data_is_judged_by_z_score(spark):
    rng = random.Random(1)
    values = [rng.gauss(0, 1) for _ in range(2000)] + [9.0]
    p = [r for r in C.outlier_figures(frame(spark, [rng.gauss(0, 1) for _ in range(2000)]), ["x"]).collect()]
    assert p[0].method == "Z-Score"
    assert C.outlier_figures(frame(spark, values), ["x"]).first().outlier_count >= 1


@pytest.mark.parametrize("case", ["ties", "smooth", "tiny"])
def test_selection_quantiles_equal_numpy(spark, case):
    rng = np.random.default_rng(3)
    values = {"ties": np.where(rng.random(5000) < 0.4, 7.0, rng.integers(0, 50, 5000)), "smooth": rng.normal(size=5000), "tiny": np.array([3.0, 1.0])}[case]
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "v": values}))
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r.prob: r.quantile for r in Q.bracketed_quantiles(df, "k", "v", probs, accuracy=200, spread=2.0).collect()}
    assert all(math.isclose(got[p], np.quantile(values, p), abs_tol=1e-12) for p in probs)


@pytest.mark.parametrize("case", ["ties", "smooth", "powers", "wide"])
def test_selection_in_rounds(spark, case):
    rng = np.random.default_rng(4)
    n = 4000
    values = {"ties": np.where(rng.random(n) < 0.4, 7.0, rng.integers(0, 900, n)), "smooth": rng.normal(size=n), "powers": 2.0 ** rng.integers(-1000, 1000, n),
              "wide": np.concatenate([rng.normal(size=n - 2), [-1.7e308, 1.7e308]])}[case]
    keys = np.where(rng.random(n) < 0.6, "hot", rng.choice(["a", "b"], n)).astype(object)
    keys[rng.random(n) < 0.1] = None
    df = spark.createDataFrame(list(zip(keys.tolist(), values.tolist())), "k string, v double")
    probs = [0.0, 0.25, 0.5, 0.77, 1.0]
    got = {(r.k, r.prob): r.quantile for r in Q.bracketed_quantiles(df, "k", "v", probs, accuracy=100, cells=5, few=20).collect()}
    for k in ("hot", "a", "b", None):
        own = values[[x == k for x in keys]]
        assert all(math.isclose(got[k, p], np.quantile(own, p), rel_tol=1e-12, abs_tol=1e-12) for p in probs), k
    whole = {r.prob: r.quantile for r in Q.column_quantiles(df, ["v"], probs, accuracy=100, cells=7, few=1).collect()}
    assert all(math.isclose(whole[p], np.quantile(values, p), rel_tol=1e-12, abs_tol=1e-12) for p in probs)


def test_bracket_that_misses_its_rank_is_widened(spark):
    values = [float(v % 977) for v in range(20000)]
    df = spark.createDataFrame([("a", v) for v in values], "k string, v double").repartition(7)
    got = Q.bracketed_quantiles(df, "k", "v", [0.3141], accuracy=3, spread=-0.9, few=50).first()
    assert math.isclose(got.quantile, np.quantile(values, 0.3141))
    assert Q.bracketed_quantiles(df.limit(0), "k", "v", [0.5]).count() == 0


def test_grouped_median_keeps_empty_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 4.0), ("b", None), (None, 2.0)], "k string, v double")
    assert {(r.k, r.median) for r in Q.grouped_median(df, "k", "v").collect()} == {("a", 2.5), ("b", None), (None, 2.0)}


def test_forward_fill_equals_pandas(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([0, 0, i]), rng.choice([None, None, float(i)])) for i in range(400)]
    pdf = pd.DataFrame(rows, columns=["i", "d", "v"]).sort_values(["d", "i"])
    want = dict(zip(pdf.i, pdf.v.ffill()))
    df = spark.createDataFrame(rows, "i int, d int, v double").repartition(5)
    got = {r.i: r.v for r in W.forward_fill(df, ["v"], ["d", "i"], slices=6).collect()}
    assert all((got[i] is None and math.isnan(w)) or got[i] == w for i, w in want.items()) and len(got) == 400
    with pytest.raises(ValueError):
        W.forward_fill(df, ["v"], [])


def test_forward_fill_splits_hot_groups_and_orders(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice(["hot", "hot", "hot", None, f"g{i % 9}"]), rng.choice(["x", "x", None, f"w{i:04d}"]), i % 3 == 0, rng.choice([None, None, float(i)]), rng.choice([None, f"t{i}"])) for i in range(1500)]
    df = spark.createDataFrame(rows, "i int, g string, o string, b boolean, v double, t string").repartition(5)
    got = {r.i: (r.v, r.t) for r in W.forward_fill(df, ["v", "t"], ["o", "b", "i"], ["g"], slices=16).collect()}
    last, want = {}, {}
    for i, g, _, _, v, t in sorted(rows, key=lambda r: (r[1] is not None, r[1] or "", r[2] is not None, r[2] or "", r[3], r[0])):
        before = last.get(g, (None, None))
        last[g] = want[i] = (before[0] if v is None else v, before[1] if t is None else t)
    assert got == want
    key = W._sort_key(df, ["o", "b", "i"], ["g"])
    placed = df.select("g", "o", key.alias("k"), W.slice_bounds(df, key, 16).scalar().alias("cuts"))
    placed = placed.select("g", "o", W._slice_of(F.col("k"), F.col("cuts"), 16).alias("s"))
    sizes = [r["count"] for r in placed.groupBy("s").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 4 * 1500 / 16
    assert placed.where("g = 'hot' and o = 'x'").select("s").distinct().count() > 3
    assert W.forward_fill(df.limit(0), ["v"], ["i"]).count() == 0


def test_correlations_of_many_columns_in_one_scan(spark):
    rng = np.random.default_rng(7)
    n, m = 300, 500
    base = rng.normal(size=(n, 5))
    data = base[:, rng.integers(0, 5, m)] + rng.normal(size=(n, m)) * rng.random(m) + rng.integers(-1000, 1000, m)
    data[rng.random((n, m)) < 0.1] = np.nan
    pdf = pd.DataFrame(data, columns=[f"x.{k}" for k in range(m)])
    df = spark.createDataFrame(pdf).repartition(4)
    pairs = A.correlation_pairs(df)
    want = pdf.corr().to_numpy()
    got = {(int(r.col1[2:]), int(r.col2[2:])): r.r for r in pairs.collect()}
    assert len(got) == m * (m - 1) // 2 and all(math.isclose(v, want[k], abs_tol=1e-9) for k, v in got.items())


def test_histogram_bins(spark):
    assert [(r.bin, r["count"]) for r in A.histogram(frame(spark, [5, 5]), ["x"]).collect()] == [(15, 2)]
    bins = {r.bin: r["count"] for r in A.histogram(frame(spark, range(31)), ["x"]).collect()}
    assert bins[29] == 2 and sum(bins.values()) == 31


def test_small_profile(spark):
    rows = [(10.5, "A", True), (20.1, "B", False), (15.0, "A", True), (10.5, "C", True), (30.2, "A", False)]
    df = spark.createDataFrame(rows, "amount double, category string, is_active boolean")
    s = P.dataset_summary(df).first()
    assert (s.rows, s.cols) == (5, 3) and s.quality_score > 0
    balance = {(r.column, r.value): r["count"] for r in P.class_balance(df).collect()}
    assert balance == {("category", "A"): 3, ("category", "B"): 1, ("category", "C"): 1, ("is_active", "true"): 3, ("is_active", "false"): 2}


def test_large_identifiers_stay_distinct(spark):
    df = spark.range(10).select((F.col("id") + 2**60).alias("big"))
    assert P.column_profile(df).first().unique_count == 10


def test_join_unique_order_and_placeholders(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, "['a', 'no']"), (1, 3, "a"), (2, 1, "none"), (None, 1, "z")], "k int, o int, v string")
    got = {r.k: r.v for r in A.join_unique(df, ["k"], "v", ["o"]).collect()}
    assert got == {1: "a, b", 2: None, None: "z"}
    text_order = {r.k: r.v for r in A.join_unique(df.withColumn("o", F.col("o").cast("string")), ["k"], "v", ["o"]).collect()}
    assert text_order == got


def test_text_sample_is_stable(spark):
    df = spark.range(1000).select("id", F.concat(F.lit("t"), F.col("id") % 100).alias("t"))
    a = [r.sample for r in R.text_sample(df.repartition(3), "t", 10).collect()]
    assert a == [r.sample for r in R.text_sample(df.repartition(7), "t", 10).collect()] and len(set(a)) > 5
    assert len(R.text_sample(df, "t", 5000).collect()) == 1000


def test_bundle_ignores_missing_and_infinite_values(spark):
    rows = [(1.0, None, 1), (2.0, None, 1), (float("inf"), None, 1), (float("nan"), None, 2), (None, None, 3), (4.0, None, 4)]
    df = spark.createDataFrame(rows, "a double, b double, c int")
    got = {r.column: r for r in P.number_figures(df, ["a", "b", "c"]).collect()}
    assert set(got) == {"a", "c"} and (got["a"].n, got["a"].min, got["a"].max, got["a"].median) == (3, 1.0, 4.0, 2.0)
    profile = {r.column: r for r in P.column_profile(df).collect()}
    assert [(profile[c].null_count, profile[c].unique_count, profile[c].n) for c in "abc"] == [(2, 4, 3), (6, 0, None), (0, 4, 6)]
    assert P.number_figures(df.limit(0), ["a"]).count() == 0 and P.column_profile(df.limit(0)).count() == 3


def test_targets_without_a_profile_equal_those_of_it(spark):
    df = spark.range(500).selectExpr("id", "id % 20 AS twenty", "CAST(id % 21 AS STRING) AS more", "IF(id % 3 = 0, NULL, id % 2 = 0) AS flag", "'x' AS one")
    want = {(r.column, r.unique_count) for r in P.potential_targets(P.column_profile(df)).collect()}
    assert {(r.column, r.unique_count) for r in P.target_columns(df).collect()} == want == {("twenty", 20), ("flag", 2)}
    assert P.target_columns(df.select("id")).count() == 0


def test_long_text_travels_as_digests(spark):
    df = spark.range(50).selectExpr("repeat(CAST(id % 7 AS STRING), 1000) AS text", "CAST(id AS DOUBLE) AS x")
    assert {r.column: r.n_distinct for r in A.distinct_counts(df).collect()} == {"text": 7, "x": 50}
    shuffled = A.digest_table(df, ["text", "x"])
    assert [t for _, t in shuffled.dtypes] == ["int", "bigint", "bigint", "bigint"]


def test_several_sides_meet_in_one_aggregate(spark):
    a = spark.createDataFrame([("k", "x", 2), ("k", "y", 1), ("k", "x", 0), ("n", "n/a", 0), (None, "z", None)], "id string, v string, o int")
    b = spark.createDataFrame([("k", "p", "r1", "2024-01-02"), ("k", "p", "r2", "2024-03-01"), ("m", None, None, "2023-01-01")], "id string, w string, r string, d string")
    out = A.join_unique_sides([
        A.Side(a, {"vs": "v"}, ["o"], firsts={"v1": "v"}),
        A.Side(b, {"ws": "w"}, [F.col("r"), F.col("w")], counts={"n": "r"}, latest={"last": F.col("d").cast("date")})], ["id"])
    got = {r.id: (r.vs, r.v1, r.ws, r.n, str(r["last"])) for r in out.collect()}
    assert got == {"k": ("x, y", "x", "p", 2, "2024-03-01"), "n": (None, None, None, None, "None"), "m": (None, None, None, None, "2023-01-01"),
                   None: ("z", "z", None, None, "None")}
    # sides without rows, and a side whose only fields are counts
    assert A.join_unique_sides([A.Side(a.limit(0), {"vs": "v"}), A.Side(b, counts={"n": "r"})], ["id"]).where("id = 'k'").first().n == 2


def test_assembly_shuffles_sides_together(spark):
    side = spark.createDataFrame([("k", "x")], "id string, v string")
    plan = A.join_unique_sides([A.Side(side, {f"v{i}": "v"}) for i in range(4)], ["id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2


def test_sides_travel_as_rows_not_cell_by_cell(spark):
    rows = [("1", 2, "b", "['x', 'y']"), ("1", 1, "a", "n/a"), ("1", 1, "c", "['z', 'x']"), ("2", 1, "--", None), (None, 3, "a", "q")]
    df = spark.createDataFrame(rows, "k string, at long, a string, b string")
    out = A.join_unique_sides([A.Side(df, {"all_a": "a", "all_b": "b"}, ["at"], firsts={"b": "b"}, counts={"n": "a"})], ["k"])
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r.k: tuple(r)[1:] for r in out.collect()}
    assert got == {"1": ("a, c, b", "z, x, y", "z", 3), "2": (None, None, None, 1), None: ("a", "q", "q", 1)}
    # a caller that reads the keys only makes no tokens
    assert "lower" not in out.select("k")._jdf.queryExecution().optimizedPlan().toString()


def test_sides_are_shuffled_as_plain_rows(spark):
    side = spark.createDataFrame([("k", "['x', 'y']", "r1"), ("k", "x", "r2")], "id string, v string, r string")
    out = A.join_unique_sides([A.Side(side, {"vs": "v"}, firsts={"v1": "v"}), A.Side(side, {"ws": "v"}, counts={"n": "r"}, distinct=True)], ["id"])
    assert [tuple(r) for r in out.collect()] == [("k", "x, y", "x", "x, y", 2)]

    def shuffled(node):
        own = {f.dataType().simpleString() for f in (node.schema().apply(i) for i in range(node.schema().size()))} if node.nodeName() == "Exchange" else set()
        return own.union(*(shuffled(node.children().apply(i)) for i in range(node.children().size())))

    # neither tokens as arrays nor lists as aggregation buffers
    assert shuffled(out._jdf.queryExecution().executedPlan().initialPlan()) == {"string", "int", "bigint"}


def test_few_keys_are_told_to_all_tasks(spark, monkeypatch):
    seen = []
    held = Q._held
    monkeypatch.setattr(Q, "_held", lambda usable, ranges, small: seen.append(small) or held(usable, ranges, small))
    df = spark.range(300).selectExpr("id % 3 k", "double(id) v")
    got = {r.k: r.quantile for r in Q.bracketed_quantiles(df, "k", "v", [0.5]).collect()}
    assert got == {0: 148.5, 1: 149.5, 2: 150.5} and seen == [True]
