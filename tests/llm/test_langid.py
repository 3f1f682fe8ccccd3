from collections import Counter

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from callharmony.llm import langid


def brute_grams(text):
    text = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    words = text.split(" ")
    padded = " " + " ".join(w for w in words if w) + " "
    out = Counter(c for c in padded if c != " ")
    out.update(padded[i : i + 2] for i in range(len(padded) - 1))
    out.update(padded[i : i + 3] for i in range(len(padded) - 2) if padded[i + 1] != " ")
    return out if any(map(str.isalpha, text)) else Counter()


def number(gram):
    out = 0
    for c in gram:
        out = (out << langid.SHIFT) | ord(c)
    return out


@settings(deadline=None)
@given(st.text(st.sampled_from("abÉ ß1.\n日"), max_size=30))
def test_grams(text):
    values = Counter(langid.grams(text).tolist())
    assert values == Counter({number(gram): n for gram, n in brute_grams(text).items()})


def test_distance():
    rows = [("x", number("a"), 1), ("x", number("b"), 2), ("y", number("b"), 1)]
    profiles = langid.Profiles(rows, 10)
    own = [int(g) for g in langid.ranked(langid.grams("ab"), 10)]
    places = {"x": {number("a"): 0, number("b"): 1}, "y": {number("b"): 0}}
    far = {lang: sum(abs(known[g] - i) if g in known else 10 for i, g in enumerate(own)) for lang, known in places.items()}
    assert profiles.predict("ab") == ("x", 1 - far["x"] / (10 * len(own)))
    assert profiles.predict("123 !") == ("und", 0.0) and profiles.predict(None) == ("und", 0.0)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("out", F.crc32(F.col("doc_id").cast("string")) % 4 == 2)
    found = langid.identify(docs.where("out"), langid.learn(docs.where("NOT out"))).select("lang", "lang_pred", "score").collect()
    assert len(found) > 200 and all(0 <= row["score"] <= 1 for row in found)
    assert sum(row["lang"] == row["lang_pred"] for row in found) >= 0.97 * len(found)


def test_odd_rows(odd, empty):
    profiles = langid.learn(odd)
    assert {row["lang"] for row in profiles.collect()} == {"en", "xx"}
    found = langid.identify(odd, profiles)
    assert found.columns == [*odd.columns, "lang_pred", "score"] and found.count() == odd.count()
    assert {row["lang_pred"] for row in found.where("doc_id IN (3, 4, 5)").collect()} == {"und"}
    again = langid.identify(found, profiles)
    assert again.columns == found.columns
    assert langid.learn(empty).count() == 0 and langid.identify(empty, profiles).count() == 0
    assert {row["lang_pred"] for row in langid.identify(odd, langid.learn(empty)).collect()} == {"und"}
