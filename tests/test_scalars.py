import re
import unicodedata

import pytest
from pyspark.sql import functions as F, types as T

from tabloom.functions import dates as D, keys as K, names as N, text as X

STR = T.StringType()


def apply(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", expr(F.col("v")).alias("x")).orderBy("i").collect()]


@pytest.mark.parametrize("strategy,values,keys", [
    (K.ID_STRIP, ["EMP-007", "user_42", "#100", "000", "abc", None], ["7", "42", "100", "0", None, None]),
    (K.SLUG, ["New York", "new-york", "Café", "--"], ["newyork", "newyork", "cafe", None]),
    (K.NUMERIC, ["42", "42.0", "1,000", " 7 ", "1.50", "x", "nan", "inf", "1e3", "-0", "1d"], ["42", "42", "1000", "7", "1.5", None, None, None, "1000", "0", None]),
    (K.DATE, ["2021-1-5", "03/04/2021", "12/25/2021", "20210110", "Jan 10 2021", "10 January 2021", "2021-01-10T05:06:07Z", "2021-02-30", "2021", "word", "1234", "9999-12-31", "1600-01-01", "16000101"],
     ["2021-01-05", "2021-04-03", "2021-12-25", "2021-01-10", "2021-01-10", "2021-01-10", "2021-01-10", None, "2021-01-01", None, None, "9999-12-31", "1600-01-01", None]),
    (K.CASEFOLD, ["  New   YORK ", "Ünï", "", "ﬁne Ⅷ"], ["new york", "uni", None, "fine viii"]),
    (K.EXACT, ["A ", "1.0", None], ["A ", "1.0", None]),
])
def test_key_strategies(spark, strategy, values, keys):
    assert apply(spark, values, lambda c: K.join_key(c, STR, strategy)) == keys


def test_fold_ascii_equals_decomposition_for_all_kinds_of_characters(spark):
    chars = [chr(c) for c in [*range(0xA0, 0x250), *range(0x1E00, 0x1F00), *range(0x2150, 0x2190), *range(0x2460, 0x2500), *range(0xFB00, 0xFB07),
                              *range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D440), *range(0x1F100, 0x1F110)]]
    values = [f"a{c}b" for c in chars] + ["é", "漢字", "plain"]
    want = [unicodedata.normalize("NFKD", v).encode("ascii", "ignore").decode() for v in values]
    assert apply(spark, values, X.fold_ascii) == want


def test_numbers_of_different_types_share_keys(spark):
    one = [apply(spark, [v], lambda c: K.join_key(c, t, K.NUMERIC), k)[0] for v, t, k in (
        (42, T.LongType(), "bigint"), (42.0, T.DoubleType(), "double"), ("42", STR, "string"))]
    assert one == ["42"] * 3
    assert apply(spark, [42.0, 12345678.0, 1.5], lambda c: K.join_key(c, T.DoubleType(), K.ID_STRIP), "double") == ["42", "12345678", "15"]


def test_value_text_of_doubles_has_no_exponent(spark):
    got = apply(spark, [12345678.9, 0.00012, 100.0, float("nan")], lambda c: X.value_text(c, T.DoubleType()), "double")
    assert got == ["12345678.9", "0.00012", "100.0", None]


def test_list_literals(spark):
    values = ["['a', \"b\"]", "[101, 102]", "['it\\'s']", "[]", "['open", "plain", None]
    assert apply(spark, values, X.list_literal_items) == [["a", "b"], ["101", "102"], ["it's"], [], None, None, None]
    assert apply(spark, values, X.first_item) == ["a", "101", "it's", "[]", "['open", "plain", None]
    assert apply(spark, values, X.parse_list) == [["a", "b"], ["101", "102"], ["it's"], [], ["['open"], ["plain"], []]
    assert apply(spark, ["['first', 'second']", "plain_value", None], X.first_item) == ["first", "plain_value", None]


def test_every_placeholder_is_removed(spark):
    assert apply(spark, [p.upper() for p in X.PLACEHOLDERS] + [" real ", "['no', 'yes it is']"], X.first_clean) == [None] * 14 + ["real", "yes it is"]


def test_split_labels(spark):
    assert apply(spark, ["a, b;c | d/e", "['x,y', 'z']", " "], X.split_labels) == [["a", "b", "c", "d", "e"], ["x", "y", "z"], []]


def test_number_and_boolean_coercion(spark):
    assert apply(spark, ["1.5", " 2 ", "1e2", "x", "", "0x10", "5f"], X.to_number) == [1.5, 2.0, 100.0, None, None, None, None]
    assert apply(spark, ["Yes", "0.0", "1", "maybe"], X.to_boolean) == [True, False, True, None]


def test_round_even(spark):
    assert apply(spark, [0.25, 0.35, 12.5], lambda c: X.round_even(c, 1), "double") == [0.2, 0.4, 12.5]


def test_timestamps_keep_time(spark):
    got = apply(spark, ["2021-01-10T05:06:07Z", "2021-01-10 05:06:07.25", "Jan 10 2021", "soon"], lambda c: D.parse_timestamp(c).cast("string"))
    assert got == ["2021-01-10 05:06:07", "2021-01-10 05:06:07.25", "2021-01-10 00:00:00", None]


def test_names():
    assert N.clean_column_names(["Order ID", "order-id", "2nd", "***", "order_id_1"]) == ["order_id", "order_id_1", "col_2nd", "unnamed", "order_id_1_1"]
    assert N.table_names(["a/b.csv", "a_b.json", "A-B.csv"]) == ["a_b", "a_b_2", "a_b_3"]
    assert N.json_column_name("a.b[*]") == "a__b___"
    assert N.columns_matching(["Harm Type", "harm_type.1", "x"], "HarmType") == ["Harm Type", "harm_type.1"]
    assert N.fuzzy_column(["event_date", "incident_year"], ["year", "incident_year"]) == "incident_year"
    assert N.fuzzy_column(["vendor_name"], ["vendor"]) == "vendor_name"
    assert N.fuzzy_column(["abc"], ["deployed_by"]) is None
    assert N.find_table(["x/Incidents.CSV", "y"], "incidents.csv") == "x/Incidents.CSV"
    assert N.find_tables_by_prefix(["d/reports_a.csv", "d/reports.txt", "d/r.csv"], "reports") == ["d/reports_a.csv"]
    assert re.fullmatch(r"[a-z_]+", N.incident_column_name(" Harm.Type ")) and N.incident_column_name("Harm.Type") == "harm_type"
