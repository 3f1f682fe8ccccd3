from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from callharmony.operators import delete_matching, empty_like, fold_pages, upsert

ROW = "dataset string, call_id string, page_seq int, v int"


def bag(df):
    return Counter(tuple(r) for r in df.collect())


def upsert_rows(target, batch):
    """What a keyed delete and insert do, in plain Python."""
    keys = {(d, c) for d, c, *_ in batch if d is not None and c is not None}
    return [row for row in target if tuple(row[:2]) not in keys] + list(batch)


def test_upsert_replaces_by_key_and_keeps_duplicates_and_null_keys(spark):
    target = [("A", "1", 0, 1), ("A", "2", 0, 2), ("B", "1", 0, 3), ("A", None, 0, 4), (None, "1", 0, 5)]
    batch = [("A", "1", 1, 6), ("A", "1", 1, 7), ("A", None, 1, 8)]
    got = bag(upsert(spark.createDataFrame(target, ROW), spark.createDataFrame(batch, ROW)))
    assert got == Counter(upsert_rows(target, batch))
    assert got[("A", None, 0, 4)] == 1 and got[("A", "1", 1, 6)] == 1


def test_upsert_twice_is_once_for_keyed_rows(spark):
    target = spark.createDataFrame([("A", "1", 0, 1), ("A", "3", 0, 2)], ROW)
    batch = spark.createDataFrame([("A", "1", 1, 3), ("A", "2", 1, 4), ("A", "2", 1, 4)], ROW)
    once = upsert(target, batch)
    assert bag(upsert(once, batch)) == bag(once)


def test_delete_matching_with_other_keys(spark):
    target = spark.createDataFrame([("A", "1", 0, 1), ("B", "2", 0, 2)], ROW)
    keys = spark.createDataFrame([("2",), (None,)], "call_id string")
    assert bag(delete_matching(target, keys, ["call_id"])) == Counter([("A", "1", 0, 1)])


def test_empty_like(spark):
    df = spark.createDataFrame([("A", "1", 0, 1)], ROW)
    assert empty_like(df).schema == df.schema and empty_like(df).count() == 0


def test_fold_with_run_order_and_missing_page_numbers(spark):
    rows = [("A", "r1", 5, 1), ("A", "r2", 0, 2), ("A", "r2", None, 3), ("B", "r1", None, 4), (None, "r1", None, 5)]
    df = spark.createDataFrame(rows, "call_id string, run_id string, page_seq int, v int")
    assert sorted(r.v for r in fold_pages(df, ["call_id"], ["run_id", "page_seq"]).collect()) == [2, 4, 5]
    assert sorted(r.v for r in fold_pages(df, ["call_id"], "page_seq").collect()) == [1, 4, 5]


rows = st.lists(
    st.tuples(
        st.sampled_from(["A", "B"]),
        st.sampled_from(["1", "2", "3", None]),
        st.integers(0, 3),
        st.integers(0, 9),
    ),
    max_size=25,
)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows)
def test_fold_equals_upserts_page_by_page(spark, pages):
    want = []
    for seq in range(4):
        want = upsert_rows(want, [row for row in pages if row[2] == seq])
    assert bag(fold_pages(spark.createDataFrame(pages, ROW))) == Counter(want)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows, rows)
def test_upsert_equals_brute_force(spark, target, batch):
    got = bag(upsert(spark.createDataFrame(target, ROW), spark.createDataFrame(batch, ROW)))
    assert got == Counter(upsert_rows(target, batch))


def skewed(spark, n):
    """A third of the rows have one key, a third have none."""
    third = F.col("id") % 3
    key = F.when(third == 0, F.lit("hot")).when(third == 1, F.col("id").cast("string"))
    return spark.range(0, n, 1, 8).select(
        F.lit("A").alias("dataset"), key.alias("call_id"), F.expr("id div 1000").cast("int").alias("page_seq"),
        F.sha2(F.col("id").cast("string"), 256).alias("v"),
    )


@pytest.fixture
def sort_merge(conf):
    conf(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="64KB",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="1.5",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="64KB",
    )


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_key_of_the_target_is_split(spark, sort_merge):
    target = skewed(spark, 60_000)
    batch = spark.range(0, 60_000, 7).select(F.lit("A").alias("dataset"), F.col("id").cast("string").alias("call_id"))
    result = delete_matching(target, batch).agg(F.count("*"), F.max("v"))
    assert "SortMergeJoin(skew=true)" in final_plan(result)
    gone = {str(i) for i in range(0, 60_000, 7)}
    assert result.first()[0] == sum(r.call_id is None or r.call_id not in gone for r in target.collect())


def test_hot_key_of_the_fold_is_spread_by_page(spark, sort_merge):
    pages = skewed(spark, 60_000)
    result = fold_pages(pages)
    assert result.where("call_id is null").count() == 20_000
    hot = result.where("call_id = 'hot'")
    assert hot.select("page_seq").distinct().collect() == [(59,)]
    assert hot.count() == pages.where("call_id = 'hot' and page_seq = 59").count()
    plan = final_plan(result)
    join = next(line for line in plan.split("\n") if "SortMergeJoin" in line)
    assert "call_id" in join and "page_seq" in join and "LeftOuter" in join
    assert "SortAggregate" not in plan
