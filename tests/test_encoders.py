import pytest
from pyspark.sql import functions as F

from tabloom.operators import encoders as E

ROWS = [(k, "abc"[k % 3] if k % 7 else None, f"v{k % 4}" if k % 5 else None, float(k) if k != 3 else float("nan"), None) for k in range(40)]
SCHEMA = "id long, kind string, name string, y double, day date"


def plain_means(rows, fold=None):
    """name -> smoothed mean of y without a fold."""
    used = [(n, y) for i, _, n, y, _ in rows if y == y and (fold is None or i % 4 != fold)]
    prior = sum(y for _, y in used) / len(used)
    names = {n for _, _, n, _, _ in rows if n}
    return {n: (sum(y for m, y in used if m == n) + 10 * prior) / (sum(m == n for m, _ in used) + 10) for n in names}


@pytest.mark.parametrize("stored", [False, True])
def test_fitted_codes_equal_a_plain_version(spark, tmp_path, stored):
    df, fold = spark.createDataFrame(ROWS, SCHEMA), F.pmod("id", F.lit(4))
    fitted = E.fit_encoders(df, {"kind": "one_hot", "name": "target", "day": "date_parts"}, "y", fold, 4)
    if stored:
        fitted.save(str(tmp_path / "fitted"))
        fitted = E.FittedEncoders.load(spark, str(tmp_path / "fitted"))
    used = [(y, i) for i, _, _, y, _ in ROWS if y == y]
    out = {r.id: r for r in fitted.transform(df, fold).collect()}
    assert len(out) == len(ROWS)
    for i, kind, name, _, _ in ROWS:
        assert [out[i][f"kind_is_{k}"] for k in range(3)] == [int(kind == c) for c in "abc"]
        want = plain_means(ROWS, i % 4).get(name)
        assert out[i].name_target is None if want is None else abs(out[i].name_target - want) < 1e-9
        assert out[i].day_year is None and out[i].day_is_weekend is None
    new = spark.createDataFrame([(1, "z", "v1", None, None), (2, None, "unseen", None, None)], SCHEMA)
    scored = {r.id: r for r in fitted.transform(new).collect()}
    assert abs(scored[1].name_target - plain_means(ROWS)["v1"]) < 1e-9
    assert abs(scored[2].name_target - sum(y for y, _ in used) / len(used)) < 1e-9
    assert [scored[i][f"kind_is_{k}"] for i in (1, 2) for k in range(3)] == [0] * 6


def test_ordinal_and_shares(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    fitted = E.fit_encoders(df, {"kind": "ordinal", "name": "frequency"})
    new = spark.createDataFrame([(1, "b", "v1", 0.0, None), (2, "z", "unseen", 0.0, None), (3, None, None, 0.0, None)], SCHEMA)
    got = {r.id: (r.kind_code, r.name_share) for r in fitted.transform(new).collect()}
    assert got == {1: (1, sum(r[2] == "v1" for r in ROWS) / 40), 2: (-1, 0.0), 3: (None, None)}


def test_empty_table_clashes_and_bounds(spark):
    none = spark.createDataFrame([], SCHEMA)
    fitted = E.fit_encoders(none, {"kind": "one_hot", "name": "target"}, "y", F.lit(0), 2)
    assert fitted.transform(none).columns == [*none.columns, "name_target"]
    assert fitted.transform(spark.createDataFrame(ROWS, SCHEMA)).where("name_target is not null").count() == 0
    with pytest.raises(ValueError, match="there already"):
        E.fit_encoders(none, {"kind": "ordinal"}).transform(none.withColumn("kind_code", F.lit(1)))
    with pytest.raises(ValueError, match="more than 1000"):
        E.fit_encoders(spark.range(1001), {"id": "ordinal"})
    with pytest.raises(ValueError, match="target"):
        E.fit_encoders(none, {"kind": "target"})
