import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from callharmony.llm import mixing


def unit(key):
    return (int(hashlib.md5(key.encode()).hexdigest()[:13], 16) + 0.5) / 2**52


def poisson_inverse(u, mean):
    p = total = math.exp(-mean)
    k = 0
    while total < u:
        k += 1
        p *= mean / k
        total += p
    return k


def sources(spark, rows=900):
    return spark.range(rows).selectExpr("id AS doc_id", "repeat('x', 10) AS text", "CASE WHEN id % 3 = 0 THEN 'a' WHEN id % 3 = 1 THEN 'b' END AS source")


def test_counts_are_the_inverse_of_the_distribution(spark):
    docs = sources(spark)
    weights = {"a": 6.0, None: 0.3, "b": 1.0}
    out = mixing.mix(docs, weights, budget=20.0, seed=7)
    counts = Counter(row["doc_id"] for row in out.collect())
    for row in docs.collect():
        rate = 20 * 900 * weights[row["source"]] / sum(weights.values()) / 300
        steps = max(1, math.ceil(rate / mixing.STEP))
        want = sum(poisson_inverse(unit(f"7:{row['doc_id']}:{step}"), rate / steps) for step in range(1, steps + 1))
        assert counts[row["doc_id"]] == want


def test_target_weights_are_met(spark):
    out = mixing.mix(sources(spark), {"a": 3.0, "b": 1.0}, budget=4.0)
    got = Counter(row["source"] for row in out.collect())
    assert None not in got and abs(got["a"] / (got["a"] + got["b"]) - 0.75) < 0.03


def test_copies_are_numbered_and_in_order_of_place(spark):
    rows = mixing.mix(sources(spark), budget=3.0).collect()
    places = [row["place"] for row in rows]
    assert places == sorted(places) and len({(row["doc_id"], row["copy"]) for row in rows}) == len(rows)
    most = Counter()
    for row in rows:
        most[row["doc_id"]] = max(most[row["doc_id"]], row["copy"])
    assert most == Counter(row["doc_id"] for row in rows)


def test_odd_rows(odd, empty):
    out = mixing.mix(odd, budget=5.0)
    assert out.columns == [*(c for c in odd.columns if c != "copy"), "copy", "place"]
    rows = Counter((row["doc_id"], row["text"]) for row in out.collect())
    assert set(rows) <= {(row["doc_id"], row["text"]) for row in odd.collect()}
    assert rows == Counter((row["doc_id"], row["text"]) for row in mixing.mix(odd, budget=5.0).collect())
    assert mixing.mix(empty).count() == 0


@pytest.mark.parametrize("weights", [{}, {"nowhere": 1.0}, {"a": 0.0, "b": 0.0}])
def test_weights_that_name_no_present_source_give_no_rows(spark, weights):
    assert mixing.mix(sources(spark), weights).collect() == []


@pytest.mark.parametrize("weight", [-1.0, float("nan"), float("inf")])
def test_weights_that_are_none(spark, weight):
    with pytest.raises(ValueError, match="weights"):
        mixing.mix(sources(spark), {"a": 1.0, "b": weight})


def test_the_count_is_not_computed_again_for_a_filter(spark):
    plan = mixing.mix(sources(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1


def test_rows_that_share_the_key_are_split_between_ranges(spark, conf):
    conf(spark__sql__adaptive__coalescePartitions__enabled="false", spark__sql__shuffle__partitions="8")
    rows = spark.range(3000).selectExpr("CAST(NULL AS LONG) AS doc_id", "'same text' AS text", "'a' AS source")
    out = mixing.mix(rows, budget=4.0)
    sizes = [row["count"] for row in out.groupBy(F.spark_partition_id().alias("part")).count().collect()]
    assert sum(sizes) % 3000 == 0 and max(sizes) <= sum(sizes) / 4
    assert [row["place"] for row in out.collect()] == sorted(row["place"] for row in out.collect())
