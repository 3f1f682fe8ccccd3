import json

import pytest
from bodies import ERROR, datastore, features, pages, row_array

from callharmony.sources import (
    DATASTORE,
    FEATURES,
    ROW_ARRAY,
    land_pages,
    observed_fields,
    page_sizes,
    parse_body,
    parse_rows,
    raw_rows,
    read_datastore_pages,
    read_feature_pages,
    read_page_files,
    read_page_table,
    read_row_array,
    read_row_lines,
    register_raw,
    unwrap,
)

WRAP = {"features": (FEATURES, features), "datastore": (DATASTORE, datastore), "row_array": (ROW_ARRAY, row_array)}


@pytest.fixture(params=WRAP)
def shape(request):
    return WRAP[request.param]


def test_rows_of_every_page(spark, shape):
    envelope, wrap = shape
    df = pages(spark, wrap({"id": 1, "t": "a"}, {"id": 2, "t": "b"}), wrap({"id": 3, "t": None}), wrap())
    rows = parse_rows(df, envelope, ["id", "t"])
    assert sorted((r.page_seq, r.id, r.t) for r in rows.collect()) == [(0, "1", "a"), (0, "2", "b"), (1, "3", None)]


@pytest.mark.parametrize("body", [ERROR, "not json", "", None, "{}", "[]", "null", '{"features": null}'])
def test_a_body_without_rows_gives_none(spark, shape, body):
    envelope, wrap = shape
    df = pages(spark, body, wrap({"id": 1}))
    assert [r.id for r in parse_rows(df, envelope, ["id"]).collect()] == ["1"]
    assert raw_rows(df, envelope).count() == 1


def test_types_that_differ_between_pages(spark, shape):
    envelope, wrap = shape
    df = pages(spark, wrap({"id": 17, "x": None}), wrap({"id": "17-b", "x": 1.5}), wrap({"x": {"y": [1]}}))
    got = {r.page_seq: (r.id, r.x) for r in parse_rows(df, envelope, ["id", "x"]).collect()}
    assert got == {0: ("17", None), 1: ("17-b", "1.5"), 2: (None, '{"y":[1]}')}


def test_names_in_other_letter_case(spark, shape):
    """A page spells a name in one way; which way may differ between pages."""
    envelope, wrap = shape
    df = pages(
        spark,
        wrap({"CALL_ID": 1, "callDateTime": 5}, {"callDateTime": 6}),
        wrap({"call_id": 2, "calldatetime": 7}, {"call_id": 3}),
        wrap({"Call_Id": 4, "note": '"call_id": "x"'}, {"cAlLdAtEtImE": {"a": 8}}),
        wrap({"note": "call_id"}, {"call_id": None, "other": "CALL_ID"}),
    )
    rows = parse_rows(df, envelope, ["call_id", "calldatetime"], {"calldatetime": ["callDateTime"]})
    assert sorted((tuple(r)[2:] for r in rows.collect()), key=str) == [
        (0, "1", "5"), (0, None, "6"), (1, "2", "7"), (1, "3", None), (2, "4", None), (2, None, '{"a":8}'),
        (3, None, None), (3, None, None)]


def test_absent_column_is_null(spark, shape):
    envelope, wrap = shape
    rows = parse_rows(pages(spark, wrap({"id": 1})), envelope, ["id", "never_sent"]).collect()
    assert [(r.id, r.never_sent) for r in rows] == [("1", None)]


def test_raw_rows_keep_every_field(spark, shape):
    envelope, wrap = shape
    row = {"id": 1, "name": "é \" , ]", "nested": {"a": [1, None]}, "ok": True, "none": None}
    (raw,) = raw_rows(pages(spark, wrap(row)), envelope).collect()
    assert json.loads(raw.value) == row


def test_page_sizes_tell_an_error_from_an_empty_page(spark, shape):
    envelope, wrap = shape
    df = pages(spark, wrap({"id": 1}, {"id": 2}), ERROR, wrap())
    got = [(r.page_seq, r.n, r.has_rows) for r in page_sizes(df, envelope).orderBy("page_seq").collect()]
    assert got == [(0, 2, True), (1, 0, False), (2, 0, True)]


def test_truncated_flag_is_read_by_value(spark):
    df = pages(spark, datastore({"a": 1}, truncated=True), datastore({"a": 2}, truncated=False), datastore({"a": 3}))
    got = [r.truncated for r in page_sizes(df, DATASTORE).orderBy("page_seq").collect()]
    assert got == [True, False, None]


def test_observed_fields(spark):
    df = pages(spark, features({"a": 1, "B": 2}, {"a": None}), features())
    assert sorted(tuple(r) for r in observed_fields(df, FEATURES).collect()) == [("B", 1), ("a", 2)]


def test_typed_parse_and_unwrap(spark):
    df = parse_body(pages(spark, features({"k": 5, "z": 1})), FEATURES.schema("struct<k: bigint>"))
    assert [tuple(r) for r in unwrap(df, "features", "attributes", keep=["page_seq"]).collect()] == [(0, 5)]
    one = parse_body(spark.createDataFrame([('{"k": 5}',), ("x",)], "props string"), "k BIGINT", body="props")
    assert [r[0] for r in one.select("parsed.k").collect()] == [5, None]
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        parse_body(spark.createDataFrame([("x",)], "props string"), "k BIGINT", "FAILFAST", "props").collect()


def land(folder, bodies, run="r9"):
    target = folder / f"run_id={run}"
    target.mkdir(parents=True)
    for seq, body in enumerate(bodies):
        (target / f"page-{seq}.json").write_text(body)
    return str(folder)


def test_page_files_know_run_and_page(spark, tmp_path):
    path = land(tmp_path / "pages", ["[]\n", "{\n}", ERROR] + ["[]"] * 9)
    df = read_page_files(spark, path, "some-city")
    got = sorted((r.dataset, r.run_id, r.page_seq, r.body) for r in df.collect())
    assert [g[2] for g in got] == list(range(12))
    assert got[1] == ("some-city", "r9", 1, "{\n}")


def test_readers_of_each_shape(spark, tmp_path):
    feature = land(tmp_path / "f", [features({"a": 1, "b": "x"}), features(), ERROR])
    store = land(tmp_path / "d", [datastore({"a": 2, "b": "y"}, truncated=True), datastore({"a": 3, "b": None})])
    array = land(tmp_path / "r", [row_array({"a": 4, "b": "z"})])
    schema = "a BIGINT, b STRING, c STRING"
    assert [tuple(r) for r in read_feature_pages(spark, feature, schema).collect()] == [(0, 1, "x", None)]
    got = sorted(tuple(r) for r in read_datastore_pages(spark, store, schema).collect())
    assert got == [(0, 2, "y", None), (1, 3, None, None)]
    assert [tuple(r) for r in read_row_array(spark, array, schema).collect()] == [(0, 4, "z", None)]


def test_row_lines(spark, tmp_path):
    file = tmp_path / "rows.json"
    rows = [{"a": 1, "b": "x, [y]"}, {"a": 2, "b": "],"}, {"a": 3, "b": None}]
    for text in (
        "[" + "\n,".join(json.dumps(r) for r in rows) + "\n]\n",
        "[\n" + ",\n".join(json.dumps(r) for r in rows) + "]",
    ):
        file.write_text(text)
        got = read_row_lines(spark, str(file), "a BIGINT, b STRING")
        assert sorted((r.a, r.b) for r in got.collect()) == [(1, "x, [y]"), (2, "],"), (3, None)]
    file.write_text('[{"a": 1,\n"b": "x"}]')
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        read_row_lines(spark, str(file), "a BIGINT, b STRING").collect()


def test_page_table_roundtrip(spark, tmp_path):
    path = str(tmp_path / "table")
    land_pages(pages(spark, "x", "y", dataset="c1"), path)
    land_pages(pages(spark, "z", dataset="c2", run_id="r2"), path)
    assert sorted(tuple(r) for r in read_page_table(spark, path).collect()) == [
        ("c1", "r1", 0, "x"), ("c1", "r1", 1, "y"), ("c2", "r2", 0, "z")]
    plan = read_page_table(spark, path).where("dataset = 'c2'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dataset" in plan


def test_register_raw(spark, tmp_path):
    folder = tmp_path / "it's raw"
    folder.mkdir()
    (folder / "part-0.json").write_text('{"a": 1, "extra": true}\n{"a": 2}\n')
    register_raw(spark, "raw_calls", str(folder), "a BIGINT, b STRING")
    assert sorted(tuple(r) for r in spark.table("raw_calls").collect()) == [(1, None), (2, None)]
    register_raw(spark, "raw_calls", str(folder), "a STRING")
    assert spark.table("raw_calls").columns == ["a"]
    spark.sql("DROP TABLE raw_calls")
    assert (folder / "part-0.json").exists()


@pytest.mark.parametrize("envelope, wrap", [(ROW_ARRAY, row_array), (FEATURES, features)])
def test_spellings_that_alternate_on_a_page(spark, envelope, wrap):
    rows = [{"nopd_item": "1", "x": None}, {"NOPD_ITEM": "2"}, {"Nopd_Item": "3", "other": "nopd_item"}, {"nopd_item": None}]
    df = parse_rows(pages(spark, wrap(*rows)), envelope, ["nopd_item", "x"], keep=["page_seq"])
    assert [r.nopd_item for r in df.collect()] == ["1", "2", "3", None]
