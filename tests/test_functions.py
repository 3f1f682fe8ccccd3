from datetime import datetime

import pytest
from pyspark.sql import functions as F

from callharmony.functions import (
    cast_to,
    epoch_ms_to_ts,
    join_date_time,
    local_to_utc,
    text_to_ts,
    whole_number,
)


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def utc(spark, column):
    return one(spark, F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@pytest.mark.parametrize(
    "text, zone, want",
    [
        ("2021-07-01 10:00:00", "America/Phoenix", "2021-07-01 17:00:00.000000"),
        ("2021-01-01 10:00:00", "America/Phoenix", "2021-01-01 17:00:00.000000"),
        ("2021-07-01T10:00:00.250", "America/New_York", "2021-07-01 14:00:00.250000"),
        ("2021-01-01 10:00:00", "America/Chicago", "2021-01-01 16:00:00.000000"),
        # the hour skipped in spring, and the hour repeated in autumn
        ("2021-03-14 02:30:00", "America/New_York", "2021-03-14 07:30:00.000000"),
        ("2021-11-07 01:30:00", "America/New_York", "2021-11-07 05:30:00.000000"),
    ],
)
def test_local_to_utc(spark, text, zone, want):
    assert utc(spark, local_to_utc(F.lit(text), zone)) == want


@pytest.mark.parametrize("text", ["not a time", "2021-13-01 00:00:00", "", None])
def test_unreadable_time_is_null_also_under_ansi(spark, text):
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"
    assert one(spark, local_to_utc(F.lit(text), "America/Chicago")) is None
    assert one(spark, text_to_ts(F.lit(text))) is None


def test_text_time_is_not_shifted(spark):
    assert utc(spark, text_to_ts(F.lit("2021-07-01 10:00:00"))) == "2021-07-01 10:00:00.000000"


def test_join_date_time_is_null_if_either_is(spark):
    joined = join_date_time(F.lit("2021-07-01"), F.lit("10:00:00"))
    assert utc(spark, local_to_utc(joined, "America/New_York")) == "2021-07-01 14:00:00.000000"
    assert one(spark, join_date_time(F.lit(None).cast("string"), F.lit("10:00"))) is None
    assert one(spark, join_date_time(F.lit("2021-07-01"), F.lit(None).cast("string"))) is None


def test_epoch_keeps_milliseconds(spark):
    assert utc(spark, epoch_ms_to_ts(F.lit(1609459200123))) == "2021-01-01 00:00:00.123000"
    assert utc(spark, epoch_ms_to_ts(F.lit(-1))) == "1969-12-31 23:59:59.999000"


@pytest.mark.parametrize("flag, want", [(0, False), (1, True), (2, True), (None, None)])
def test_long_to_boolean(spark, flag, want):
    assert one(spark, cast_to(F.lit(flag).cast("bigint"), "boolean")) is want


def test_cast_gives_null_on_bad_text(spark):
    assert one(spark, cast_to(F.lit("abc"), "bigint")) is None
    assert one(spark, cast_to(F.lit(17), "string")) == "17"
    assert one(spark, cast_to(F.lit("2021-01-01 01:02:03"), "timestamp")) == datetime(2021, 1, 1, 1, 2, 3)


@pytest.mark.parametrize(
    "text, want", [("1", 1), ("0", 0), ("1.0", 1), ("1.609459200123E12", 1609459200123), ("x", None), (None, None)]
)
def test_whole_number(spark, text, want):
    assert one(spark, whole_number(F.lit(text).cast("string"))) == want
