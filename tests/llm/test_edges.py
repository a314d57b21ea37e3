"""Nulls, empty tables, very long texts, repeated rows and clashing columns, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from inkwell.llm import contamination, language, lines, lm, near, pieces, pii, quality, substrings, toxicity

LONG = "word another third " * 20_000
COLUMNS = "doc_id long, text string, lang string, row string, n string, score string, node string, __row string, hash string, kept string, label string, source string, n_chars long"
BENCHMARK = "the quick brown fox jumps over the lazy dog and runs away from here"


def documents(spark, empty=False):
    rows = [(1, "hello world again", "en"), (1, "hello world again", "en"), (2, None, "en"), (3, "", None), (None, "a\nb\nc", "fr"), (4, LONG, "en"), (5, "   \n\n", "en"), (6, "日本語", None), (None, None, None)]
    full = [(d, t, g, "r", "n", "s", "x", "y", "h", "k", "l", "z", None) for d, t, g in rows]
    return spark.createDataFrame([] if empty else full, COLUMNS)


def tables(spark):
    labels = spark.createDataFrame([(1, 1, 1), (4, 0, 0), (None, 1, 1), (4, 0, 0), (2, None, None)], "doc_id long, quality int, toxic int")
    return labels, spark.createDataFrame([(1, BENCHMARK), (2, None), (3, ""), (None, "hello world again")], "item_id long, text string")


OPERATORS = {
    "near": lambda s, d: near.near_duplicates(d),
    "dedup": lambda s, d: near.deduplicated(d),
    "contained": lambda s, d: contamination.contained(d, tables(s)[1]),
    "decontaminated": lambda s, d: contamination.decontaminated(d, tables(s)[1]),
    "no items": lambda s, d: contamination.decontaminated(d, tables(s)[1].limit(0)),
    "toxicity": lambda s, d: toxicity.judged(d, tables(s)[0]),
    "no labels": lambda s, d: toxicity.judged(d, tables(s)[0].limit(0)),
    "language": lambda s, d: language.identified(d),
    "substrings": lambda s, d: substrings.repeated_passages(d),
    "judged": lambda s, d: quality.judged(d),
    "quality": lambda s, d: quality.quality_rules(d),
    "lines": lambda s, d: lines.line_dedup(d, removed="n"),
    "pii": lambda s, d: pii.personal_data(d),
    "pieces": lambda s, d: pieces.tokenised(d, decoded=True),
    "lm": lambda s, d: lm.scored(d),
}
PER_ROW = ("near", "toxicity", "no labels", "language", "judged", "lines", "pieces", "lm", "no items")


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    found = OPERATORS[name](spark, documents(spark)).collect()
    if name in PER_ROW:
        assert len(found) == 9


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, name):
    assert OPERATORS[name](spark, documents(spark, empty=True)).collect() == []


def test_repeated_rows_and_nulls(spark):
    found = near.near_duplicates(documents(spark)).collect()
    assert sum(x["kept"] for x in found if x["doc_id"] == 1) == 1
    empty = [x for x in found if x["group_size"] == 3]  # two nulls and the empty text
    assert len(empty) == 3
    clean = contamination.decontaminated(documents(spark), tables(spark)[1]).collect()
    assert len(clean) == 7 and all(x["text"] != "hello world again" for x in clean)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages(spark, tmp_path, name, stage):
    tables(spark)[1].write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (documents(spark), documents(spark, empty=True)):
        out = stage(spark, docs, str(tmp_path))
        assert set(docs.columns) - {"n"} <= set(out.columns)
        if name != "tokenise":
            assert out.columns == docs.columns
        out.write.mode("overwrite").parquet(str(tmp_path / "out"))


def test_pipeline(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert {"doc_id", "text", "lang", "source", "n_chars", "ids", "n_tokens", "round_trip"} == set(out.columns)
    held = out.agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("d"), F.min(F.col("round_trip").cast("int")).alias("r")).first()
    assert 100 < held["n"] == held["d"] and held["r"] == 1
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "tokenise"]
