import pytest
from hypothesis import given
from hypothesis import strategies as st

from inkwell.functions.distance import aligned_distance, closest, damerau, levenshtein, within
from inkwell.functions.text import Analyzer, stem, with_stems
from pyspark.sql import functions as F

STEMS = dict(
    p.split(">")
    for p in (
        "running>run flies>fli tries>tri caress>caress cats>cat studies>studi hopping>hop sing>sing troubled>troubl amazing>amaz connection>connect "
        "relational>rel sensitivity>sensit organization>organ computer>comput walking>walk jumping>jump beautiful>beauti quickly>quick a>a is>is run>run national>nat"
    ).split()
)


@pytest.mark.parametrize("word, expected", STEMS.items())
def test_stem(word, expected):
    assert stem(word) == expected


def test_stems_as_columns(spark):
    words = [*STEMS, "Running", "ional", "eed", "agreed", "falling", "yes", "ing", "sses"]
    rows = with_stems(spark.createDataFrame([(w,) for w in words], "w string"), "w").collect()
    assert {r["w"]: r["term"] for r in rows} == {w: stem(w) for w in words}


def tokens(spark, text, **options):
    return spark.createDataFrame([(text,)], "text string").select(Analyzer(**options).tokens("text").alias("t")).first()["t"]


def test_tokens(spark):
    assert tokens(spark, "the camelCase HTTPServer snake_case-x", stem=False) == ["camel", "Case", "HTTPServer", "snake", "case", "x"]
    assert tokens(spark, "the cat", remove_stop_words=False) == ["the", "cat"]
    assert tokens(spark, "the cat", custom_stop_words=frozenset()) == ["the", "cat"]
    assert tokens(spark, "a bb ccc", min_token_length=3) == ["ccc"]
    assert tokens(spark, "camelCase", split_camel_case=False) == ["camelCase"]
    assert tokens(spark, "café") == ["caf"]
    assert tokens(spark, "") == []


def test_distances(spark):
    pairs = [("kitten", "sitting", 3), ("saturday", "sunday", 3), ("café", "cafe", 1), ("", "ab", 2)]
    df = spark.createDataFrame(pairs, "a string, b string, d int")
    assert all(r["d"] == r["x"] and r["y"] and not r["z"] for r in df.select("d", levenshtein("a", "b").alias("x"), within(F.col("a"), F.col("b"), 3).alias("y"), within(F.col("a"), F.col("b"), -1).alias("z")).collect())
    swaps = spark.createDataFrame([("ab", "ba"), ("ca", "abc"), (None, "a")], "a string, b string")
    assert [r[0] for r in swaps.select(damerau("a", "b")).collect()] == [1, 3, None]
    words = spark.createDataFrame([("hello",), ("help",), ("hallo",), ("world",)], "w string")
    assert [tuple(r) for r in closest(words, "hello", "w", 2, 3).collect()] == [("hello", 0), ("hallo", 1), ("help", 2)]


@given(st.text("abc", max_size=7), st.text("abc", max_size=7))
def test_alignment_is_symmetric(a, b):
    assert aligned_distance(a, b) == aligned_distance(b, a) <= max(len(a), len(b))
