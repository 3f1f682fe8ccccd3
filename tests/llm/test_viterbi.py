import tracemalloc

from hypothesis import given, settings, strategies as st
from tokenizers.models import Unigram

from callharmony.llm import viterbi
from callharmony.llm.words import words_of

PIECES = viterbi.vocabulary(viterbi.PIECES)
LIBRARY = Unigram([("<unk>", 0.0), *PIECES], unk_id=0, byte_fallback=False)
OWN = viterbi.Counter(PIECES)


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=20), st.text(st.sampled_from("aeinthor\x01\x02日😀▁"), max_size=20)))
def test_counts_equal_the_library(text):
    assert OWN.count(viterbi.MARK + text) == len(LIBRARY.tokenize(viterbi.MARK + text))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text("abc", min_size=1, max_size=4), st.sampled_from([-1.0, -2.0, -3.0])), min_size=1, max_size=9, unique_by=lambda p: p[0]), st.text("abcd", max_size=12))
def test_ties_on_small_vocabularies(pieces, text):
    library = Unigram([("<unk>", 0.0), *pieces], unk_id=0, byte_fallback=False)
    assert viterbi.Counter(pieces).count(text) == len(library.tokenize(text))


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {row["doc_id"]: row["text"] for row in docs.collect()}
    for row in viterbi.token_counts(docs).collect():
        words = [word.decode() for word in words_of(texts[row["doc_id"]])]
        assert row["n_words"] == len(words)
        assert row["n_tokens"] == sum(len(LIBRARY.tokenize(viterbi.MARK + word)) for word in words)


def test_odd_rows(odd, empty):
    rows = viterbi.token_counts(odd).collect()
    assert len(rows) == odd.count()
    assert {tuple(row)[1:] for row in rows if row["doc_id"] in (3, 4, 5)} == {(0, 0)}
    assert viterbi.token_counts(empty).count() == 0


def test_memory_does_not_grow_with_a_word():
    peaks = []
    for size in (30_000, 300_000):
        text = ("interationsx日" * size)[:size]
        tracemalloc.start()
        count = OWN.count(text)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert size / OWN.longest <= count <= size
    assert peaks[1] < peaks[0] + 5 * 300_000  # the text itself, which the automaton copies
    assert OWN.count("interationsx日" * 3_000) == len(LIBRARY.tokenize("interationsx日" * 3_000))
