import hashlib
from collections import Counter, defaultdict

from callharmony.llm import exact


def expected(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[row["text"] or ""].append(row["doc_id"])
    out = Counter()
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        digest = hashlib.sha256(text.encode()).hexdigest()
        first = True
        for i in sorted(ids, key=lambda i: (i is None, i or 0)):
            out[(i, keep, len(ids), i == keep and first, digest)] += 1
            first = first and i != keep
    return out


def found(df):
    return Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in df.collect())


def test_odd_rows(odd):
    assert found(exact.exact_dedup(odd)) == expected(odd.collect())


def test_heavy_groups_take_the_other_path_with_the_same_result(spark, monkeypatch):
    rows = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('t', id % 700) END AS text")
    both = []
    for parts in (2048, 2):
        monkeypatch.setattr(exact, "HEAVY_PARTS", parts)
        both.append(found(exact.exact_dedup(rows)))
    assert both[0] == both[1] == expected(rows.collect())


def test_a_third_of_the_rows_without_id_and_text(spark, conf):
    """They are one heavy group, and no task of a window or join takes them in: nothing but the broadcast names them."""
    rows = spark.range(3000).selectExpr("nullif(id % 3, 0) * id AS doc_id", "CASE WHEN id % 3 > 0 THEN concat('t', id % 700) END AS text")
    assert found(exact.exact_dedup(rows)) == expected(rows.collect())
    left = exact.drop_copies(rows).collect()
    assert sorted(row["text"] or "" for row in left) == sorted({row["text"] or "" for row in rows.collect()})
    digests = rows.selectExpr("doc_id", "unhex(sha2(coalesce(text, ''), 256)) AS digest", "monotonically_increasing_id() AS row_no")
    won = exact.winners(digests, "digest", "doc_id", exact.heavy_digests(digests, "digest"), "row_no")
    hot = won.where("w_digest = unhex(sha2('', 256))").collect()
    assert [(row["w_keep"], row["w_size"]) for row in hot] == [(None, 1000)]
    assert exact.mark_tail(digests, won, "digest", "doc_id").where("doc_id IS NULL").count() == 0


def test_every_heavy_digest_is_named(spark):
    rows = spark.range(5000).selectExpr("id AS doc_id", "unhex(sha2(CASE WHEN id % 4 = 0 THEN 'x' ELSE cast(id AS string) END, 256)) AS digest")
    assert hashlib.sha256(b"x").hexdigest().upper() in exact.heavy_digests(rows, "digest")


def test_tasks_without_rows(spark, conf):
    conf(spark__sql__adaptive__coalescePartitions__enabled="false", spark__sql__shuffle__partitions="40")
    rows = spark.range(10).selectExpr("id AS doc_id", "'same' AS text")
    assert found(exact.exact_dedup(rows)) == expected(rows.collect())


def test_empty_table(empty):
    assert exact.exact_dedup(empty).count() == 0 and exact.drop_copies(empty).count() == 0


def test_drop_copies_keeps_columns_and_one_row_per_text(odd):
    left = exact.drop_copies(odd)
    assert left.columns == odd.columns
    texts = [row["text"] or "" for row in left.collect()]
    assert sorted(texts) == sorted({row["text"] or "" for row in odd.collect()})
    assert {row["doc_id"] for row in left.collect() if row["text"] and row["text"].startswith("the quick")} == {2}


def test_the_main_path_runs_no_python(spark, odd):
    plan = exact.exact_dedup(odd)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
