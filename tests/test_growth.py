"""Steps whose cost must grow no faster than the documents."""

import re
from collections import defaultdict
from dataclasses import replace
from functools import reduce

import pytest

from inkwell import queries
from inkwell.functions.text import STOP_WORDS, Analyzer, stem
from inkwell.operators.index import Index
from inkwell.plans.compile import Compiler
from inkwell.plans.syntax import Node, parse
from inkwell.sources import store

SF = "/root/testdata/sf0.001"
TEXTS = ["Running runs ran; the camelCase RUNNING", "", None, "x " * 3000 + "last", "one two one-two two"]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(k, f"d{k}", t) for k, t in enumerate(TEXTS)], "doc_id long, path string, text string")


@pytest.mark.parametrize("stemmed", [False, True])
def test_postings_need_no_exchange(spark, docs, stemmed):
    index = Index.build(docs, Analyzer(stem=stemmed))
    assert "Exchange" not in plan(index.postings) and "Exchange" not in plan(index.documents)
    want = defaultdict(list)
    for k, text in enumerate(TEXTS):
        words = re.findall("[a-zA-Z0-9]+", re.sub("([a-z])([A-Z])", r"\1 \2", text or ""))
        for at, w in enumerate(w.lower() for w in words if w.lower() not in STOP_WORDS):
            want[stem(w) if stemmed else w, k].append(at)
    got = {(r["term"], r["doc_id"]): r for r in index.postings.collect()}
    assert {k: r["positions"] for k, r in got.items()} == want
    assert all(r["term_freq"] == len(r["positions"]) for r in got.values())
    assert {r["doc_id"]: r["length"] for r in got.values()} == {r["doc_id"]: r["length"] for r in index.documents.collect() if r["length"]}
    assert index.documents.count() == len(TEXTS)


@pytest.mark.parametrize("name", ["q_not_strict", "q_term_stemmed", "q_or_13"])
def test_searches_hold_no_index_in_memory(spark, name):
    assert "InMemoryTableScan" not in plan(queries.QUERIES[name](spark, SF))


def test_long_and_goes_through_the_postings_once(spark):
    words = [x * 2 for x in "abcdefgh"]
    docs = spark.createDataFrame([(k, f"d{k}", " ".join(words[: 4 + k % 5] + words[k % 8 :])) for k in range(40)], "doc_id long, path string, text string")
    compiler = Compiler(Index.build(docs, Analyzer(stem=False)), "compat")
    found = compiler.plan(parse(" AND ".join(words)), 2, 0.0)
    leaves = found._jdf.queryExecution().optimizedPlan().collectLeaves()
    assert sum(bool(re.search("positions|text", leaves.apply(i).toString())) for i in range(leaves.size())) <= 1
    nested = reduce(lambda left, w: Node("and", parts=(left, Node("term", w))), words[1:], Node("term", words[0]))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, compiler.plan(nested, 2, 0.0).collect()))


def test_save_counts_what_it_wrote(spark, docs, tmp_path):
    index = Index.build(docs, Analyzer(stem=False))
    store.save(replace(index, terms=index.terms.where("false")), tmp_path / "i")  # the given terms aren't computed
    saved = store.load(spark, tmp_path / "i")
    assert sorted(map(tuple, saved.terms.collect())) == sorted(map(tuple, index.terms.collect()))
    assert saved.stats().first() == index.stats().first() and saved.totals() == index.totals()


def test_build_without_ids_joins_no_texts_twice(spark, tmp_path):
    rows = [("b", "old"), ("a", "one two"), ("c", ""), ("b", "new")]
    for k, r in enumerate(rows):
        spark.createDataFrame([r], "path string, text string").coalesce(1).write.parquet(f"{tmp_path}/{k}")
    docs = spark.read.parquet(*(f"{tmp_path}/{k}" for k in range(len(rows))))
    for given in (docs, docs.repartition(3)):  # read straight from files or not
        index = Index.build(given, Analyzer(stem=False))
        assert "Join" not in plan(index.documents) and "Join" not in plan(index.postings)
        assert [tuple(r) for r in index.documents.select("doc_id", "path").orderBy("doc_id").collect()] == [(0, "a"), (1, "b"), (2, "c")]
        got = {(r["term"], r["doc_id"]) for r in index.postings.collect()}
        assert got - {("old", 1), ("new", 1)} == {("one", 0), ("two", 0)} and len(got) == 3


def test_batch_adds_up_a_document_in_one_place(spark):
    assert not re.search(r"hashpartitioning\(item_id#\d+L?, doc_id", plan(queries.QUERIES["bm25_batch"](spark, SF)))
