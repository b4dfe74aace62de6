import datetime

import pytest
from pyspark.sql import functions as F

from tabloom.operators import aggregates as A
from tabloom.operators import cleaning as C


def dirty(spark):
    ages = [25.0, None, 30.0, 150.0, None, 22.0] + [25.0] * 94
    day = datetime.datetime(2020, 1, 1)
    rows = [(i, ages[i], "Alice" if i % 2 == 0 else "Bob", day + datetime.timedelta(days=i)) for i in range(100)]
    return spark.createDataFrame(rows, "id bigint, age double, name string, date_joined timestamp_ntz")


def test_dirty_frame(spark):
    result = C.clean(dirty(spark), C.Context(domain="healthcare"))
    assert result.context.roles == {"id": "id_col", "age": "feature_col", "name": "feature_col", "date_joined": "feature_col"}
    assert result.df.where("age IS NULL").count() == 0 and "age_was_missing" not in result.df.columns
    assert result.df.where("id = 1").first().age == 25.0
    assert any("age above 120" in w for w in result.warnings)
    assert result.df.schema["id"].metadata["role"] == "id_col"
    assert set(result.log_frame().columns) >= {"step_name", "action", "severity"}


@pytest.mark.parametrize("missing,flagged,filled", [(4, False, True), (5, True, True), (30, True, True), (31, False, False)])
def test_missing_share_thresholds(spark, missing, flagged, filled):
    df = spark.range(100).select("id", F.when(F.col("id") >= missing, F.col("id").cast("double")).alias("v"))
    result = C.fill_missing(df, C.Context())
    assert ("v_was_missing" in result.df.columns) == flagged
    assert (result.df.where("v IS NULL").count() == 0) == filled and bool(result.warnings) != filled


def test_mode_takes_smallest_on_ties(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",), ("c",), (None,)], "v string")
    assert C.fill_missing(df, C.Context()).df.where("v IS NULL").count() == 0
    assert {r.v for r in C.fill_missing(df, C.Context()).df.groupBy("v").count().where("count = 3").collect()} == {"a"}


def test_forward_fill_needs_order(spark):
    df = dirty(spark).withColumn("date_joined", F.when(F.col("id") != 3, F.col("date_joined")))
    with pytest.raises(ValueError):
        C.fill_missing(df, C.Context())
    filled = C.fill_missing(df, C.Context(order_by=("id",))).df
    assert filled.where("id = 3").first().date_joined == filled.where("id = 2").first().date_joined


def test_type_fixer(spark):
    df = spark.range(100).select(
        F.when(F.col("id") < 96, F.col("id").cast("string")).otherwise("bad").alias("mostly"), F.col("id").cast("string").alias("always"),
        F.when(F.col("id") % 2 == 0, " Yes ").otherwise("no").alias("answer"), F.format_string("2021-01-%02d", F.col("id") % 28 + 1).alias("day"))
    fixed = C.fix_types(df, C.Context(roles={"day": "datetime_col"}))
    assert dict(fixed.df.dtypes) == {"mostly": "double", "always": "string", "answer": "boolean", "day": "timestamp_ntz"}
    relaxed = C.fix_types(df, C.Context(strict_parity=False))
    assert dict(relaxed.df.dtypes)["always"] == "double"


def test_roles(spark):
    df = spark.range(100).select(
        F.lit(1).alias("same"), F.col("id").alias("n"), F.concat(F.lit("u"), F.col("id").cast("string")).alias("user_key"), F.concat(F.lit("u"), F.col("id").cast("string")).alias("other"),
        F.repeat(F.concat(F.lit("x"), (F.col("id") % 9).cast("string")), 40).alias("prose"), F.format_string("2021-01-%02d", F.col("id") % 9 + 1).alias("day"))
    roles = C.infer_roles(df, C.Context()).context.roles
    assert roles == {"same": "constant_col", "n": "id_col", "user_key": "id_col", "other": "feature_col", "prose": "text_col", "day": "datetime_col"}


def test_nested_cells(spark):
    rows = spark.sql("""SELECT * FROM VALUES (parse_json('{"a":1}'), 101L), (parse_json('{"a":2}'), 102L), (NULL, 103L), (parse_json('{"b":[1,2]}'), 104L) AS t(payload, row_id)""")
    assert C.infer_roles(rows, C.Context()).context.roles["row_id"] == "id_col"


def test_domain_profile_roles(spark):
    df = spark.createDataFrame([("1", "x", "2020")], "incident_id string, title string, year string")
    roles = C.infer_roles(df, C.Context(domain="ai_incidents")).context.roles
    assert roles == {"incident_id": "id_col", "title": "text_col", "year": "feature_col"}


def test_duplicates_are_flagged_not_removed(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "k int, v string")
    result = C.flag_duplicates(df, C.Context())
    assert result.df.count() == 3 and "1 rows" in result.warnings[0]


def test_failing_step_aborts(spark):
    def broken(df, ctx):
        raise ValueError("no")

    with pytest.raises(RuntimeError, match="broken"):
        C.clean(spark.range(1).toDF("a"), steps=(broken,))


def test_checkpointed_run_gives_the_same_rows(spark):
    df = dirty(spark).withColumn("name", F.when(F.col("id") % 20 != 0, F.col("name")))
    plain, cut = (C.clean(df, C.Context(checkpoint=c)).df for c in (False, True))
    assert plain.exceptAll(cut).count() == 0 and cut.count() == 100


def test_nan_is_the_missing_value(spark):
    nan = float("nan")
    df = spark.createDataFrame([(float(i), "a") for i in range(90)] + [(nan, "a")] * 10, "x double, c string")
    result = C.fill_missing(df, C.Context())
    assert result.df.where("x is null or isnan(x)").count() == 0 and result.df.agg({"x_was_missing": "sum"}).first()[0] == 10
    both = spark.createDataFrame([(1.0,), (nan,), (None,)], "x double")
    assert A.coverage(both, ["x"]).first().coverage_pct == 33.3
    assert {(r.x, r["count"]) for r in A.value_counts(both, "x").collect()} == {(1.0, 1), (None, 2)}
    assert {(r.pattern, r.rows) for r in A.null_patterns(both).collect()} == {("0", 1), ("1", 2)}
