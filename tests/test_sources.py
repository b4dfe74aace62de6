import json

import pytest
from pyspark.sql import functions as F

from tabloom.operators import joins as J
from tabloom.sources import catalog as G, jsonshape as Z, lines as Z_lines, readers as R, sinks as S

LAYOUTS = [
    ("array_of_objects", '[{"a":1,"b":{"c":2}},{"a":2,"d":[1,2]}]', 2), ("array_of_arrays", '[["x","y"],[1,2],[3,4]]', 2),
    ("array_of_arrays", "[[1,2],[3,4]]", 2), ("array_of_scalars", '[1,2,"z"]', 3), ("mixed_array", '[{"a":1},2,[3]]', 3),
    ("wrapped_array", '{"data":[{"a":1}],"n":3}', 1), ("wrapped_multi", '{"p":[{"a":1}],"q":[{"a":1},{"a":2}]}', 2),
    ("object_of_objects", '{"k1":{"a":1},"k2":{"a":2,"_key":"own"}}', 2), ("single_object", '{"a":1,"b":[1]}', 1),
    ("ndjson", '{"a":1}\n{"a":2}\n', 2), ("empty", "[]", 0), ("unknown", "{oops", 0),
]


def test_json_layouts(spark):
    docs = spark.createDataFrame([(i, text) for i, (_, text, _) in enumerate(LAYOUTS)], "doc int, text string")
    got = {r.doc: (r.layout, r.root_records) for r in Z.document_layouts(docs).collect()}
    assert got == {i: (layout, n) for i, (layout, _, n) in enumerate(LAYOUTS)}
    records = {}
    for r in Z.extract_records(docs).select("doc", "pos", F.to_json("record").alias("j")).orderBy("doc", "pos").collect():
        records.setdefault(r.doc, []).append(json.loads(r.j))
    assert records[1] == [{"x": 1, "y": 2}, {"x": 3, "y": 4}] and records[2] == [{"col_0": 1, "col_1": 2}, {"col_0": 3, "col_1": 4}]
    assert records[3] == [{"value": 1}, {"value": 2}, {"value": "z"}] and records[6] == [{"a": 1}, {"a": 2}]
    assert records[7] == [{"a": 1, "_key": "k1"}, {"a": 2, "_key": "own"}]


def test_json_files(spark, tmp_path):
    (tmp_path / "one.json").write_text('{"rows": [{"a": 1, "b": {"c": "x"}}, {"a": 2}]}')
    df = Z.load_json_structural(spark, str(tmp_path))
    assert {(r.a, r.b__c) for r in df.collect()} == {(1, "x"), (2, None)}
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "l.json").write_text('{"a": 1}\n{"a": 2}\n')
    assert Z.read_ndjson(spark, str(tmp_path / "lines")).count() == 2


def brute_paths(records):
    found = {}

    def walk(v, path, depth):
        if depth == 8 and isinstance(v, (dict, list)) and v:
            found.setdefault(path, []).append(json.dumps(v))
        elif isinstance(v, dict) and v:
            for k, x in v.items():
                walk(x, f"{path}.{k}" if path else k, depth + 1)
        elif isinstance(v, list) and v and all(isinstance(x, dict) for x in v):
            for x in v:
                walk(x, path + "[*]", depth + 1)
        else:
            found.setdefault(path, []).append(None if v == [] else v)

    for r in records:
        walk(r, "", 0)
    found.pop("", None)
    return found


def test_field_profile_equals_brute_force(spark):
    deep = {"v": 1}
    for i in range(10):
        deep = {f"n{i}": deep}
    records = [{"a": 1, "b": [{"c": None}, {"c": "x", "d": {}}], "e": [], "f": [1, "q"], "g": 1.5}, {"a": "s", "b": [], "h": True}, deep]
    want = brute_paths(records)
    df = spark.createDataFrame([(json.dumps(r),) for r in records], "t string").select(F.parse_json("t").alias("record"))
    got = {r.path: r for r in Z.field_profile(df).collect()}
    assert set(got) == set(want)
    for path, values in want.items():
        assert (got[path]["count"], got[path].null_count) == (len(values), sum(v is None for v in values)), path
    assert got["b[*].d"].n_dict == 1 and got["a"].n_unique == 2
    assert Z.structural_warnings(df).first().deep_nesting


def test_hints(spark):
    rows = [{"mail": f"u{i}@x.org", "u": "http://x", "d": "2020-01-01", "g": "123e4567-e89b-12d3-a456-426614174000"} for i in range(3)]
    df = spark.createDataFrame([(json.dumps(r),) for r in rows], "t string").select(F.parse_json("t").alias("record"))
    assert {r.path: r.hints for r in Z.field_profile(df).collect()} == {"mail": "email", "u": "url", "d": "datetime", "g": "uuid"}


def test_csv_types_and_missing_words(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('id,score,ok,name\n1,1.5,true,"a, ""b"""\n2,NA,FALSE,n/a\n3,2,true,c\n')
    df, report = R.load(spark, str(path))
    assert dict(df.dtypes) == {"id": "smallint", "score": "double", "ok": "boolean", "name": "string"}
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, 1.5, True, 'a, "b"'), (2, None, False, None), (3, 2.0, True, "c")]
    assert (report.row_count, report.col_count) == (3, 4)


def test_latin1_fallback_warns(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_bytes("name\nCafé\n".encode("latin-1"))
    df, warnings = R.read_delimited(spark, str(path))
    assert df.first().name == "Café" and "latin-1" in warnings[0]


def test_broken_json_lines_are_counted_and_the_others_kept(spark, tmp_path):
    (tmp_path / "b.json").write_text("".join(f'{{"a": {i}}}\n' for i in range(100)) + '{"a": \n')
    df, report = R.load(spark, str(tmp_path / "b.json"))
    assert df.count() == report.row_count == 100 and df.columns == ["a"] and report.warnings == ["1 lines are no JSON records"]
    docs = spark.createDataFrame([("x", "\n".join(f'{{"a": {i}}}' for i in range(50)) + "\noops")], "doc string, text string")
    assert Z.extract_records(docs).count() == 50 and Z.document_layouts(docs).first().layout == "ndjson"
    assert Z.document_problems(docs).first().bad_lines == 1
    (tmp_path / "p.json").write_text(json.dumps({"a": 1, "b": {"c": 2}}, indent=1))
    assert R.read_json(spark, str(tmp_path / "p.json")).first().a == 1


def test_awkward_json_keys(spark):
    texts = ['{"AVOID":1,"x":{"VOIDED":2},"n":null}', '{"AVOID":3,"Name":"p","name":"q","d.e":5,"d":{"e":6}}']
    docs = spark.createDataFrame([(t, t) for t in texts], "doc string, text string")
    flat = Z.flatten_records(Z.extract_records(docs))
    rows = {r.AVOID: r.asDict() for r in flat.collect()}
    assert rows[1]["x__VOIDED"] == 2 and len({c.lower() for c in flat.columns}) == len(flat.columns)
    assert {"p", "q", 5, 6} <= set(rows[3].values())


def test_csv_with_quoted_breaks_and_ragged_rows(spark, tmp_path):
    (tmp_path / "q.csv").write_text("id,t\n" + "".join(f'{i},"line\nbreak"\n' for i in range(10)))
    df, report = R.load(spark, str(tmp_path / "q.csv"))
    assert report.row_count == 10 and dict(df.dtypes)["id"] == "smallint" and "quoted line breaks" in report.warnings[0]
    (tmp_path / "r.csv").write_text("a,b\n1,2\n1,2,3\n4\n")
    df, report = R.load(spark, str(tmp_path / "r.csv"))
    assert sorted(map(tuple, df.collect()), key=str) == [(1, 2), (1, 2), (4, None)] and report.warnings == ["2 rows have more or fewer fields than the header"]
    (tmp_path / "u.csv").write_text("name\ncafé \ufffd\n")
    df, report = R.load(spark, str(tmp_path / "u.csv"))
    assert df.first().name == "café \ufffd" and report.warnings == []


def test_empty_and_unknown_files(spark, tmp_path):
    (tmp_path / "e.csv").write_text("a,b\n")
    with pytest.raises(R.LoadError):
        R.load(spark, str(tmp_path / "e.csv"))
    with pytest.raises(R.LoadError):
        R.load(spark, str(tmp_path / "e.csv"), "xls")


def test_json_lines_then_document(spark, tmp_path):
    (tmp_path / "l.json").write_text('{"incident_id":"1","title":"x"}\n{"incident_id":"2","title":"y"}\n')
    (tmp_path / "d.json").write_text('[\n {"a": 1},\n {"a": 2}\n]')
    assert R.read_json(spark, str(tmp_path / "l.json")).count() == 2
    assert [r.a for r in R.read_json(spark, str(tmp_path / "d.json")).orderBy("a").collect()] == [1, 2]


def test_scan_tables(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "Incidents.csv").write_text("id\n1\n2\n")
    (tmp_path / "sub" / "r.json").write_text('{"a": 1}\n')
    (tmp_path / "bad.json").write_text("{oops")
    (tmp_path / "note.txt").write_text("x")
    tables, catalog = G.scan_tables(spark, str(tmp_path))
    assert set(tables) == {"incidents", "sub_r"}
    rows = catalog.collect()
    assert [(r.table, r.rows) for r in rows if r.status == "loaded"] == [("incidents", 2), ("sub_r", 1)]
    assert [r.table for r in rows if r.status.startswith("error")] == ["bad"]
    capped = G.scan_tables(spark, str(tmp_path), max_file_mb=0.0)[1]
    assert all(r.status.startswith("skipped_size_gt_") for r in capped.collect())


def test_storable(spark, tmp_path):
    df = spark.sql("SELECT named_struct('a', 1) AS payload, X'ff41' AS blob, parse_json('[1]') AS v, TIMESTAMP_NTZ'2020-01-01 00:00:00' AS ts")
    out = S.to_storable(df)
    assert dict(out.dtypes) == {"payload": "string", "blob": "string", "v": "string", "ts": "timestamp_ntz"}
    assert out.first().payload == '{"a":1}' and out.first().blob.endswith("A")
    S.write_parquet(df, str(tmp_path / "p"))


def test_logs_and_history(spark, tmp_path):
    with pytest.raises(ValueError):
        S.log_frame(spark, [{"step_name": "s", "action": "a", "severity": "loud"}])
    l, r = spark.createDataFrame([(1,), (2,)], "a int"), spark.createDataFrame([(1,), (1,)], "b int")
    args = ("a", "b", "exact", "left")
    path = str(tmp_path / "h")
    for _ in range(2):
        S.append_merge(S.merge_record(J.match_stats(l, r, *args), *args, J.join_warnings(l, r, *args)), path)
    page = S.history_page(spark.read.parquet(path), limit=1).collect()
    assert len(page) == 1 and (page[0].merged_rows, page[0].matched_rows, page[0].left_only_rows, len(page[0].warnings)) == (3, 2, 1, 1)


GOOD = ['{"a": 1, "t": "x}]"}', '{"a": 2, "t": "[{"}', '{"a": 3, "t": "q\\"{"}']
BAD = ['{"a": ', "oops", '{"a": {"b": [']


@pytest.mark.parametrize("lines", [GOOD + BAD, BAD + GOOD, [x for pair in zip(BAD, GOOD) for x in pair], BAD[:1] + GOOD + ["}"], ["{", *GOOD, "}"]])
def test_malformed_lines_never_hide_records(spark, tmp_path, lines):
    path = tmp_path / "x.json"
    path.write_text("\n".join(lines) + "\n\n")
    for schema in (None, "a bigint, t string"):
        loaded = R.read_records(spark, str(path), schema and R.T.StructType.fromDDL(schema))
        assert sorted(r.a for r in loaded.df.collect()) == [1, 2, 3] and loaded.df.count() == 3
        assert loaded.bad_rows == len(lines) - 3 and loaded.warnings == [f"{len(lines) - 3} lines are no JSON records"]
        assert sorted(r.line for r in loaded.bad.collect()) == sorted(set(lines) - set(GOOD)) and loaded.bad.count() == len(lines) - 3
    assert R.load(spark, str(path))[1].bad_rows == len(lines) - 3


def test_documents_are_proven_by_brackets(spark, tmp_path):
    texts = {"pretty": json.dumps([{"a": 1, "b": {"c": "]}"}}, {"a": 2}], indent=2), "rows": '[\n{"a": 1},\n{"a": 2}\n]\n', "blank": '\n\n[\n\n{"a": 1}\n]\n\n',
             "lines": '{"a": 1}\n{"a": 2}', "several": '{\n"a": 1\n}\n{\n"a": 2\n}', "glued": '{\n"a": 1\n}{\n"a": 2\n}', "open": '[\n{"a": 1},\n', "one line": '[{"a": 1}]'}
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_text(text)
    documents, lines = Z_lines.documents_among(spark, str(tmp_path))
    stem = lambda paths: {p.rsplit("/", 1)[-1].removesuffix(".json") for p in paths}
    assert stem(documents) == {"pretty", "rows", "blank"} and stem(lines) == set(texts) - stem(documents)
    # blocks of a few bytes: depths are carried across them
    (tmp_path / "big").mkdir()
    (tmp_path / "big" / "b.json").write_text(json.dumps([{"a": k, "b": [k]} for k in range(300)], indent=1))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        assert len(Z_lines.documents_among(spark, str(tmp_path / "big"))[0]) == 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert R.read_json(spark, str(tmp_path / "big")).count() == 300
    mixed = R.read_records(spark, [str(tmp_path / f"{n}.json") for n in ("pretty", "lines", "several")])
    assert sorted(r.a for r in mixed.df.collect()) == [1, 1, 2, 2] and mixed.bad_rows == 6
    with pytest.raises(R.LoadError):
        R.read_records(spark, _written(tmp_path, "none.json", "{oops\n5\n"))


def _written(folder, name, text):
    (folder / name).write_text(text)
    return str(folder / name)


def test_values_that_do_not_fit_a_schema(spark, tmp_path):
    path = _written(tmp_path, "v.json", '{"a": 1}\n{"a": "x", "b": 2}\n{"b": 3}\n{"a"')
    loaded = R.read_records(spark, path, R.T.StructType.fromDDL("a bigint, b bigint"))
    assert sorted(map(tuple, loaded.df.collect()), key=str) == [(1, None), (None, 2), (None, 3)]
    assert loaded.warnings == ["1 lines are no JSON records", "1 records have values that do not fit the schema"]
    path = _written(tmp_path, "v.csv", 'k,n,d,ok\n1,2.5,2020-01-31,true\nx,NA,2020-13-01,no\n"3",4,,\n4,5\n6,7,2020-02-01,false,9\n')
    loaded = R.read_delimited_checked(spark, path, schema=R.T.StructType.fromDDL("id int, n double, d date, ok boolean"))
    got = {r.n: (r.id, str(r.d), r.ok) for r in loaded.df.collect()}
    assert got == {2.5: (1, "2020-01-31", True), None: (None, "None", False), 4.0: (3, "None", None), 5.0: (4, "None", None), 7.0: (6, "2020-02-01", False)}
    assert loaded.warnings == ["2 rows have more or fewer fields than the header", "1 rows have values that do not fit the schema"]
    assert sorted(r.line for r in loaded.bad.collect()) == ["4,5", "6,7,2020-02-01,false,9"] and loaded.bad_rows == 2


def test_quoted_break_with_schema(spark, tmp_path):
    path = _written(tmp_path, "q.csv", 'id,t\n1,"line\nbreak"\n2,b\n')
    loaded = R.read_delimited_checked(spark, path, schema=R.T.StructType.fromDDL("id int, t string"))
    assert sorted(map(tuple, loaded.df.collect())) == [(1, "line\nbreak"), (2, "b")] and loaded.bad_rows == 0


def test_encodings_and_breaks_are_found_per_file(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("id,name\n1,Café\n".encode("latin-1"))
    (tmp_path / "b one.csv").write_text("id,name\n2,Café €\n", encoding="utf-8")
    (tmp_path / "c.csv").write_text('id,name\n3,"x\ny"\n')
    loaded = R.read_delimited_checked(spark, str(tmp_path))
    assert sorted(map(tuple, loaded.df.collect())) == [(1, "Café"), (2, "Café €"), (3, "x\ny")]
    assert loaded.warnings == ["not valid UTF-8; 1 files decoded as latin-1 instead", "quoted line breaks found; 1 files are read whole"]


def test_warnings_are_logged(spark, tmp_path, caplog):
    R.read_csv(spark, _written(tmp_path, "r.csv", "a,b\n1,2,3\n"))
    R.read_json(spark, _written(tmp_path, "r.json", '{"a": 1}\n{'))
    assert [m.split(": ")[-1] for m in caplog.messages] == ["1 rows have more or fewer fields than the header", "1 lines are no JSON records"]


def test_document_warnings(spark):
    docs = spark.createDataFrame([(i, text) for i, (_, text, _) in enumerate(LAYOUTS)] + [(99, None)], "doc int, text string")
    told = {r.doc: r.warning for r in Z.document_warnings(docs).collect()}
    assert told[6] == "several arrays, only the largest is used: p, q" and told[10] == "empty document" and told[11] == told[99] == "unknown layout: no JSON document and no JSON lines"
    assert set(told) == {6, 10, 11, 99}


def test_numbers_of_documents_are_not_read_one_by_one_as_text(spark, tmp_path):
    for n in (1, 2):
        (tmp_path / f"part={n}").mkdir()
    (tmp_path / "part=1" / "a.json").write_text('[\n{"k": 1,\n "c": 7, "d": 1.50},\n{"k": 2, "c": null, "d": 2}\n]')
    (tmp_path / "part=2" / "b.json").write_text('{"k": 3, "c": "c3", "d": "x"}\n')
    loaded = R.read_records(spark, str(tmp_path))
    assert sorted(map(tuple, loaded.df.select("k", "c", "d", "part").collect())) == [(1, "7", "1.50", 1), (2, None, "2", 1), (3, "c3", "x", 2)]
    assert loaded.bad_rows == 0 and loaded.warnings == [] and dict(loaded.df.dtypes)["c"] == "string"
    # a document's whole numbers stay numbers in the scan; text is asked for only where the file holds other values
    assert "c:bigint" in loaded.df._jdf.queryExecution().toString()
