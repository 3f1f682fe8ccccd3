import random
import sys
from pathlib import Path

import pytest
from hypothesis import given, settings, strategies as st

sys.path.append(str(Path(__file__).parent))
from brute import link_groups, shingle_set  # noqa: E402

from callharmony.llm import jaccard  # noqa: E402
from callharmony.llm.components import components  # noqa: E402


def compare(docs, percent=75):
    rows = sorted(((row["doc_id"], row["text"]) for row in docs.collect()))
    sets = [shingle_set(text) for _, text in rows]
    groups = link_groups(sets, percent)
    want = {doc: (len(own), rows[group][0]) for (doc, _), own, group in zip(rows, sets, groups, strict=True)}
    found = {row["doc_id"]: (row["n_shingles"], row["component_id"]) for row in jaccard.jaccard_join(docs, percent=percent).collect()}
    assert found == want
    return want


@settings(deadline=None)
@given(st.text(st.sampled_from("aB \nÉ"), max_size=40))
def test_set_sizes(text):
    assert len(jaccard.shingles(text)) == len(shingle_set(text))


@pytest.mark.parametrize("seed", [1, 2])
def test_drifting_and_mixed_texts(spark, monkeypatch, seed):
    """Chains of edits, groups around a centre, and texts that share most of a passage without being linked."""
    monkeypatch.setattr(jaccard, "SMALL_REGION", 3)
    random.seed(seed)

    def words(n):
        return [f"w{random.randrange(10**6)}" for _ in range(n)]

    def edited(text, edits):
        text = list(text)
        for _ in range(edits):
            text[random.randrange(len(text))] = words(1)[0]
        return text

    texts, passage = [], words(60)
    for _ in range(4):
        chain = words(80)
        for _ in range(12):
            chain = edited(chain, 1)
            texts.append(chain)
    for _ in range(3):
        centre = words(70)
        texts += [edited(centre, k % 4) for k in range(15)]
    texts += [passage + words(random.randrange(4, 25)) for _ in range(40)]
    texts += [words(random.randrange(1, 7)) for _ in range(10)] + [["a", "b"]] * 3
    random.shuffle(texts)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    groups = {group for _, group in compare(docs).values()}
    assert 20 < len(groups) < len(texts)
    compare(docs, percent=60)


def test_documents(spark):
    compare(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_odd_rows(odd, empty):
    rows = jaccard.jaccard_join(odd).collect()
    assert len(rows) == odd.count()
    found = {row["doc_id"]: (row["n_shingles"], row["component_id"]) for row in rows if row["doc_id"] is not None}
    assert found[2] == found[1] and found[1][1] == 1
    assert found[3] == (0, 3) and found[4] == (0, 4) and found[10] == found[9] == (1, 9)
    left = jaccard.drop_near_copies(odd)
    assert left.columns == odd.columns
    assert sorted(row["doc_id"] or 0 for row in left.collect()) == [0, 0, 1, 3, 4, 5, 6, 7, 8, 9]
    assert jaccard.jaccard_join(empty).count() == 0 and jaccard.drop_near_copies(empty).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    edges = spark.createDataFrame([*chain, *star, (7, 7), (500, 501), (501, 500)], "a long, b long")
    labels = {row["node"]: row["label"] for row in components(edges).collect()}
    assert len(labels) == 61 + 200 + 2
    assert len({labels[i] for i in range(61)}) == len({labels[1000 + i] for i in range(200)}) == len({labels[500], labels[501]}) == 1
    assert len(set(labels.values())) == 3
    assert components(edges.limit(0)).count() == 0
