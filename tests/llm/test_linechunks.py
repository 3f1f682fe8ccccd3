import oracle
import pytest
from pyspark.sql import functions as F

from callharmony.llm import linechunks
from callharmony.llm.linechunks import drop_repeated_chunks


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def cleaned(df):
    return {row["doc_id"]: row["text"] for row in drop_repeated_chunks(df).collect()}


PASSAGE = "\n".join(f"shared line {i}" for i in range(40))


def test_a_shifted_passage_is_found(spark):
    before = "\n".join(f"own line {i}" for i in range(7))
    out = cleaned(docs(spark, PASSAGE, f"{before}\n{PASSAGE}\nlast line"))
    assert out[0] == PASSAGE
    left = out[1].split("\n")
    assert sum(line.startswith("shared") for line in left) <= 12
    assert [line for line in left if not line.startswith("shared")] == [*before.split("\n"), "last line"]


def test_single_lines_and_unique_chunks_stay(spark):
    texts = ("same", "same", "same", "a\nb\nc", "d\ne\nf")
    assert cleaned(docs(spark, *texts)) == dict(enumerate(texts))


def test_repeats_within_a_document(spark):
    out = cleaned(docs(spark, "\n".join([PASSAGE] * 3)))
    assert len(out[0]) < 2 * len(PASSAGE) and out[0].startswith(PASSAGE[:200])


def line(name):
    return " ".join(f"{name}{i}" for i in range(30))


@pytest.mark.parametrize("n", [2, 3, 4, 5, 6])
def test_short_passages_go_whole_wherever_they_stand(spark, n):
    """Passages of ``n`` lines and over 50 words, each after and before lines of its own."""
    passages = ["\n".join(line(f"p{p}l{i}w") for i in range(n)) for p in range(20)]
    around = [(line(f"before{p}w"), line(f"after{p}w")) for p in range(20)]
    texts = passages + [f"{a}\n{passage}\n{b}" for (a, b), passage in zip(around, passages, strict=True)]
    out = cleaned(docs(spark, *texts))
    assert [out[i] for i in range(20)] == passages
    assert [out[20 + i] for i in range(20)] == [f"{a}\n{b}" for a, b in around]


def test_copies_go_whole(spark):
    text = "\n".join(line(f"l{i}w") for i in range(9))
    assert cleaned(docs(spark, text, text, f"{text}\n\nown")) == {0: text, 1: "", 2: "\nown"}


def test_blank_lines_neither_hide_nor_make_a_chunk(spark):
    out = cleaned(docs(spark, "a\nb", "x\n\n\ny", "a\n \nb\nz", "u\n\n\nv", "b\na"))
    assert out == {0: "a\nb", 1: "x\n\n\ny", 2: "z", 3: "u\n\n\nv", 4: "b\na"}


def test_single_lines_between_others_stay(spark):
    texts = ("a\nsame\nb", "c\nsame\nd", "\n", "\n")
    assert cleaned(docs(spark, *texts)) == dict(enumerate(texts))


def test_overlaps_within_a_document(spark):
    out = cleaned(docs(spark, "a\nb\na\nb\na\nb", "x\nx\nx", "y\ny\ny\ny\ny"))
    assert out == {0: "a\nb", 1: "x\nx\nx", 2: "y\ny"}


@pytest.mark.parametrize("values", [1, 3])
def test_windows_that_share_a_hash_are_told_apart_by_their_bytes(spark, monkeypatch, values):
    texts = [f"{i % 7}\n{i % 5}\n{i % 3}\nown {i}" for i in range(40)]
    right = cleaned(docs(spark, *texts))
    monkeypatch.setattr(linechunks, "window_hash", lambda above, below: F.pmod(F.xxhash64(above, below), F.lit(values)))
    assert cleaned(docs(spark, *texts)) == right and any(right[i] != text for i, text in enumerate(texts))


def test_no_run_of_lines_seen_in_an_earlier_document_is_left(spark):
    """Over the test documents: what stays holds no two lines that an earlier document had as neighbours."""
    con = oracle.connect("/root/testdata/sf0.01")
    texts = dict(con.execute("SELECT doc_id, coalesce(text, '') FROM documents ORDER BY doc_id").fetchall())
    out = {row["doc_id"]: row for row in drop_repeated_chunks(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()}
    seen, removed = set(), 0
    for doc_id, text in texts.items():
        lines = text.split("\n")
        filled = [i for i, one in enumerate(lines) if one.strip(" \t\n\v\f\r")]
        pairs = [(lines[a], lines[b]) for a, b in zip(filled, filled[1:])]
        gone = {i for pair, a, b in zip(pairs, filled, filled[1:]) if pair in seen for i in range(a, b + 1)}
        assert out[doc_id]["n_removed"] >= len(gone)
        removed += len(gone)
        if not set(pairs) & seen and len(set(pairs)) == len(pairs):
            assert out[doc_id]["text"] == text
        seen.update(pairs)
    assert removed > 0


def test_odd_rows(odd, empty):
    out = drop_repeated_chunks(odd)
    rows = out.collect()
    assert out.columns == ["doc_id", "text", "n_lines", "n_removed"] and len(rows) == odd.count()
    assert {row["text"] for row in rows if row["doc_id"] in (3, 4)} == {""}
    assert [row["text"] for row in rows if row["doc_id"] == 8] == ["a\nb"]
    assert drop_repeated_chunks(empty).count() == 0


def test_a_hot_chunk(spark):
    rows = spark.range(600).selectExpr("id AS doc_id", f"'{PASSAGE}' AS text")
    out = drop_repeated_chunks(rows).collect()
    whole = [row["doc_id"] for row in out if row["n_removed"] == 0]
    assert whole == [0] and {row["n_removed"] for row in out} != {0}


def test_the_main_path_runs_no_python(odd):
    plan = drop_repeated_chunks(odd)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
