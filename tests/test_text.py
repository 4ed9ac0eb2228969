import pytest
from pyspark.sql import functions as F

from lexweave.functions import text as T


def words(spark, fn, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("t"))).collect()]


def test_tokens(spark):
    got = words(spark, T.token_array, "Don't stop, l'été U.S.A. well-known", "", None, "42!")
    assert got == [["don't", "stop", "l", "t", "u", "s", "a", "well", "known"], [], [], []]
    df = spark.createDataFrame([(1, "a B", 0), (2, None, 0), (3, "", 0)], "doc_id long, text string, pos int")
    assert [(r.doc_id, r.pos, r.surface, r.token) for r in T.tokens(df).orderBy("doc_id", "pos").collect()] == [(1, 1, "a", "a"), (1, 2, "B", "b")]


def test_word_split(spark):
    got = words(spark, T.word_split, "Don't can't won't I'm.", "John's well-being at 42, café.", "a" * 65, "I cannot, we're gonna; 'tis \"fine\".", "")
    assert got == [["do", "n't", "ca", "n't", "wo", "n't", "i", "'m"], ["john", "'s", "well-being", "at", "café"], [], ["i", "can", "not", "we", "'re", "gon", "na", "'t", "is", "fine"], []]


def test_keys(spark):
    assert words(spark, T.lemma_key, " Ｉce__Cream  Straße ", None) == ["ice cream strasse", None]
    assert words(spark, T.flemma_form, " Don’t ") == ["don't"]
    assert words(spark, T.pos_key, "Noun", " s ", "adv") == ["n", "a", "r"]
    with pytest.raises(Exception, match="unknown part of speech"):
        words(spark, T.pos_key, "zzz")
    assert words(spark, T.is_lookup_form, "'cause", "Word", "well-being", "a--b", "x" * 65, None) == [True, False, True, False, False, False]
    assert words(spark, T.suffix_of, "modernization", "walking", "red", "tiny") == ["ization", "ing", None, None]
    assert words(spark, T.is_uppercase, "NASA", "A", "Don't") == [True, False, False]
    assert words(spark, T.is_capitalized, "Tokyo", "NASA", "don't") == [True, False, False]


def test_canonical_double(spark):
    df = spark.createDataFrame([(float("nan"),), (-0.0,), (0.12345678901250,), (None,)], "x double")
    assert [r[0] for r in df.select(T.canonical_double("x")).collect()] == [None, 0.0, 0.123456789012, None]
    with pytest.raises(Exception, match="infinite"):
        spark.createDataFrame([(float("inf"),)], "x double").select(T.canonical_double("x")).collect()


def test_compatible_texts(spark):
    df = spark.createDataFrame([(1, "ﬁne", "k"), (2, "plain", "k"), (3, None, "k")], "i int, text string, other string")
    assert {r.i: r.text for r in T.compatible_texts(df).collect()} == {1: "fine", 2: "plain", 3: None}
