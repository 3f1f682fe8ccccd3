from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from callharmony.operators import (
    apply_range,
    conform,
    fill_missing,
    label,
    load_crosswalk,
    map_call_type,
    map_fields,
)
from callharmony.operators.crosswalk import crosswalk_of
from callharmony.schema import CALL_SCHEMA
from callharmony.sinks import preview


def test_label_is_constant(spark):
    assert [r.dataset for r in label(spark.range(2), "Phoenix, AZ").collect()] == ["Phoenix, AZ"] * 2


def test_fill_missing_adds_typed_nulls_only_where_absent(spark):
    df = spark.createDataFrame([("c1", "d1")], "Call_ID string, dataset string")
    filled = fill_missing(df, CALL_SCHEMA)
    assert {f.name.lower() for f in filled.schema} == set(CALL_SCHEMA.names)
    row = filled.first()
    assert row["Call_ID"] == "c1" and row["drug"] is None
    assert filled.schema["call_time"].dataType.simpleString() == "timestamp"
    assert "void" not in {f.dataType.simpleString() for f in filled.schema}


def test_map_fields_renames_casts_and_drops(spark):
    df = spark.createDataFrame([(7, "2", "x"), (8, "no", None)], "ID bigint, Flag string, rest string")
    mapped = map_fields(
        df,
        [
            ("id", "bigint", "call_id", "string"),
            ("FLAG", "bigint", "drug", "boolean"),
            ("missing", "string", "priority", "string"),
        ],
    )
    assert mapped.columns == ["call_id", "drug", "priority"]
    assert [tuple(r) for r in mapped.collect()] == [("7", True, None), ("8", None, None)]


def test_conform_has_14_columns_in_order(spark):
    df = spark.createDataFrame([(True, "A", 5)], "drug boolean, dataset string, other int")
    shaped = conform(df, CALL_SCHEMA)
    assert shaped.columns == CALL_SCHEMA.names and len(shaped.columns) == 14
    assert [f.dataType for f in shaped.schema] == [f.dataType for f in CALL_SCHEMA]


TIMES = [datetime(2020, 12, 30, 23, 59, 59), datetime(2020, 12, 31), datetime(2021, 12, 31, 11, 59, 59),
         datetime(2021, 12, 31, 12), datetime(2022, 1, 1), datetime(2022, 1, 1, 0, 0, 1), None]


@pytest.mark.parametrize(
    "low, high, half_open, kept",
    [
        (date(2020, 12, 31), date(2022, 1, 1), False, [1, 2, 3, 4]),
        ("2021-01-01T00:00:00", "2021-12-31T11:59:59", False, [2]),
        (date(2021, 1, 1), date(2021, 12, 31), False, []),
        (date(2020, 12, 31), date(2022, 1, 1), True, [1, 2, 3]),
        (None, None, False, [0, 1, 2, 3, 4, 5, 6]),
    ],
)
def test_apply_range_bounds(spark, low, high, half_open, kept):
    df = spark.createDataFrame(list(enumerate(TIMES)), "i int, t timestamp")
    assert sorted(r.i for r in apply_range(df, "t", low, high, half_open).collect()) == kept


def test_crosswalk_is_exact_and_keeps_the_row_count(spark):
    crosswalk = load_crosswalk(spark)
    calls = spark.createDataFrame(
        [(0, "Phoenix, AZ", "FIGHT"), (1, "Phoenix, AZ", "fight"), (2, "Phoenix, AZ", None),
         (3, "Phoenix, AZ", "Affray"), (4, "Phoenix, AZ", "TRESPASSING"), (5, "Baltimore, MD", "FIGHT"),
         (6, "New Orleans, LA", "SIMPLE ROBBERY, PROPERTY SNATCHING"), (7, "Gainesville, FL", "Noise Complaint"),
         (8, "New Orleans, LA", "NOISE COMPLAINT"), (9, "Gainesville, FL", "Theft Grand - Value 300 to 4")],
        "i int, dataset string, call_type string",
    )
    got = {r.i: r.common_call_type for r in map_call_type(calls, crosswalk, "call_type").collect()}
    assert got == {0: "FIGHT", 1: None, 2: None, 3: None, 4: "TRESPASS", 5: None, 6: "ROBBERY", 7: "NOISE",
                   8: "NEGLECT", 9: "999"}


def test_packaged_dictionaries(spark):
    rows = load_crosswalk(spark).collect()
    per_dataset = {}
    for row in rows:
        per_dataset.setdefault(row.dataset, set()).add(row.common_call_type)
    sizes = {d: sum(r.dataset == d for r in rows) for d in per_dataset}
    assert sizes == {"Phoenix, AZ": 5, "Gainesville, FL": 117, "New Orleans, LA": 63, "Worcester, MA": 34,
                     "Burlington, VT": 56}
    assert {d: len(codes) for d, codes in per_dataset.items()} == {
        "Phoenix, AZ": 5, "Gainesville, FL": 56, "New Orleans, LA": 43, "Worcester, MA": 31, "Burlington, VT": 43}
    assert len(set().union(*per_dataset.values())) == 90
    assert all(r.common_call_type == r.common_call_type.strip() for r in rows)


def test_dictionary_with_a_repeated_key_is_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="2 rows for 1"):
        crosswalk_of(spark, [("A", "x", "1"), ("A", "x", "2")])
    file = tmp_path / "codes.csv"
    file.write_text('dataset,call_type,common_call_type\n"A, B","x, y", ONE\n"A, B",z,TWO\n')
    got = load_crosswalk(spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == [("A, B", "x, y", "ONE"), ("A, B", "z", "TWO")]
    file.write_text("dataset,call_type,common_call_type\nA,x,1\nA,x,2\n")
    with pytest.raises(ValueError):
        load_crosswalk(spark, str(tmp_path))


def test_preview_shows_schema_and_rows(spark, capsys):
    preview(spark.range(7).select(F.col("id").cast("string").alias("call_id")))
    shown = capsys.readouterr().out
    assert "call_id: string" in shown and shown.count("-RECORD") == 5
