import json
import random
import time

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from inkwell import cli
from inkwell.engine import Engine
from inkwell.functions.text import Analyzer
from inkwell.operators.index import Index
from inkwell.plans.compile import Compiler
from inkwell.plans.syntax import Node, parse
from inkwell.sources import files, store
from inkwell.streaming.ingest import ingest

LOG = pytest.approx


def engine(spark, texts, **options):
    e = Engine(spark, **options)
    e.add(spark.createDataFrame([(f"d{k}", t, None, None) for k, t in enumerate(texts, 1)], "path string, text string, title string, metadata string"))
    return e


def found(e, query, *args):
    return [(r.path, r.score) for r in e.search(query, *args)]


@pytest.mark.parametrize(
    "texts, query, expected",
    [
        (["hello world", "hello foo"], "hello", [("d1", 0.1823), ("d2", 0.1823)]),
        (["hello hello hello world", "hello foo bar"], "hello", [("d1", 0.2934), ("d2", 0.1948)]),
        (["hello world", "hello foo", "world foo"], "hello AND world", [("d1", 0.94)]),
        (["hello world", "foo bar", "baz qux"], "hello OR foo", [("d1", 0.9808), ("d2", 0.9808)]),
        (["hello world", "foo bar"], "NOT hello", []),
        (["hello world", "foo bar"], "hello AND NOT foo", []),
        (["the quick brown fox jumps", "the brown quick fox"], '"quick brown"', [("d1", 0.0)]),
        (["hello world"], "helo~1", [("d1", 0.2877)]),
        (["hello world"], "   ", []),
        (["the cat"], "the cat", []),
        (["machine learning"], "machine-learning", []),
    ],
)
def test_search(spark, texts, query, expected):
    assert found(engine(spark, texts), query) == [(p, LOG(s, abs=1e-4)) for p, s in expected]


def test_more_queries(spark):
    e = engine(spark, ["hello world", "help me", "foo"])
    assert {p for p, _ in found(e, "hel*")} == {"d1", "d2"}
    assert {p for p, _ in found(e, "hello NOT foo")} == {"d1", "d3"}  # a bag of words
    assert found(e, "hello", 0) == []
    assert {p for p, _ in found(e, '"foo, bar"')} == set()  # a bag of words with their marks
    with pytest.raises(ValueError):
        e.search("hello", -1)
    strict = engine(spark, ["hello world", "help me", "foo"], mode="strict")
    assert {p for p, _ in found(strict, "NOT hello")} == {"d2", "d3"}


def test_limit_and_min_score(spark):
    e = engine(spark, [f"hello world term{k}" for k in range(20)])
    assert len(found(e, "hello", 5)) == 5
    assert found(e, "hello", 5, 1e6) == []


def test_upsert_delete_and_explain(spark):
    e = Engine(spark)
    assert e.index_text("hello world", "a", metadata={"author": "x", "version": 1}) == 0
    assert e.index_text("hello there", "b", title="") == 1
    assert e.index_text("goodbye", "a") == 0
    assert e.index_info()["num_documents"] == 2
    assert found(e, "world") == []
    assert e.explain("hello", 1)["term_freq"] == 1
    assert "error" in e.explain("hello", 0) and "error" in e.explain("zzz", 9)
    assert e.remove("b") and not e.remove("b")
    assert e.index.doc_freq("hello") == 0
    e.clear()
    assert e.index_info() == {"num_documents": 0, "num_terms": 0, "total_tokens": 0, "avg_doc_length": 0.0}


def test_positions_and_json(spark):
    docs = spark.createDataFrame([("p", ["hello", "world", "hello"], 3)], "path string, tokens array<string>, doc_length int")
    index = Index.empty(spark).add_tokens(docs)
    assert index.postings_for("hello").first()["positions"] == [0, 2]
    again = Index.from_json(spark, index.export_json())
    assert again.to_dict() == index.to_dict()
    assert again.doc_freq("hello") == 1


def test_save_and_load(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        store.load(spark, tmp_path / "none")
    with Engine(spark, tmp_path / "i", Analyzer(stem=False)) as e:
        e.index_text("running cats", "a", metadata={"n": 1})
    again = Engine(spark, tmp_path / "i")
    assert not again.index.analyzer.stem
    assert again.search("running")[0].metadata == {"n": 1}
    for _ in range(3):
        again.save()
        assert again.exists and len(list((tmp_path / "i").glob("v-*"))) == 2  # the last one and the one before
    again.close()
    assert Engine(spark, f"file://{tmp_path}/i").index.totals() == (1, 2.0)


def test_two_writers(spark, tmp_path):
    one, other = Engine(spark, tmp_path / "i"), Engine(spark, tmp_path / "i")
    one.index_text("alpha", "a")
    one.save()
    with pytest.raises(Exception):
        store._Folder(spark, tmp_path / "i").create(store.LOG, next(iter(store._entries(store._Folder(spark, tmp_path / "i")))))
    other.index_text("beta", "b")
    other.save()  # a later version, as the log had not changed while it was written
    assert [r.path for r in Engine(spark, tmp_path / "i").search("beta")] == ["b"]


@pytest.fixture
def many(spark):
    """Documents without ids, of which Spark reads several partitions."""
    n = 200_000
    rows = spark.range(0, n, 1, 16).select(F.md5(F.col("id").cast("string")).alias("path"), F.concat(F.lit("w"), F.col("id"), F.repeat(F.lit(" filler text"), 8)).alias("text"))
    return n, rows


def test_numbering_of_many_documents(spark, many):
    n, rows = many
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        for partitions, adaptive in ((16, "true"),):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            spark.conf.set("spark.sql.adaptive.enabled", adaptive)
            made = Index.build(rows, Analyzer(stem=False))
            got = made.documents.agg(F.count("*"), F.countDistinct("doc_id"), F.min("doc_id"), F.max("doc_id")).first()
            assert tuple(got) == (n, n, 0, n - 1) and made.next_doc_id == n
            own = made.postings.where("term like 'w%'").join(made.documents, "doc_id").join(rows.select("path", F.regexp_extract("text", "^w[0-9]+", 0).alias("own")), "path")
            assert own.where("term != own").count() == 0 and own.count() == n
            order = made.documents.select("doc_id", "path", F.lag("path").over(Window.orderBy("doc_id")).alias("before")).where("before >= path")
            assert order.isEmpty()
        more = made.upsert(rows.limit(1000).union(rows.select(F.concat("path", F.lit("x")), "text")))
        assert more.documents.count() == 2 * n and more.documents.select("doc_id").distinct().count() == 2 * n
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_of_one_path_the_last_stays(spark):
    rows = [("a", "zebra"), ("b", "one"), ("a", "apple"), ("b", "two"), ("a", "mango")]
    docs = spark.createDataFrame(rows, "path string, text string").coalesce(1)
    for index in (Index.build(docs), Index.empty(spark).upsert(docs), Index.build(docs.limit(2)).upsert(docs)):
        assert [tuple(r) for r in index.documents.select("doc_id", "path", "first_line").orderBy("path").collect()] == [(0, "a", "mango"), (1, "b", "two")]
        assert {r["term"] for r in index.terms.collect()} == {"mango", "two"}
    tokens = spark.createDataFrame([("a", ["x"], 1), ("a", ["y", "y"], 2)], "path string, tokens array<string>, doc_length int").coalesce(1)
    index = Index.empty(spark).add_tokens(tokens)
    assert [tuple(r) for r in index.postings.select("term", "doc_id", "term_freq", "length").collect()] == [("y", 0, 2, 2)]


@pytest.mark.parametrize("mode", ["compat", "strict"])
def test_long_queries(spark, mode):
    """Chains give what operators inside one another give."""
    r = random.Random(3)
    e = engine(spark, [" ".join(r.choice("abcdefgh") * 2 for _ in range(r.randint(3, 30))) for _ in range(40)], analyzer=Analyzer(stem=False), mode=mode)
    words = [x * 2 for x in "abcdefgh"]
    compiler = Compiler(e.index, mode)
    for n, k in ((2, 3), (3, 2), (5, 1), (5, 10), (8, 2)):
        for kind in ("and", "or"):
            whole = parse(f" {kind} ".join(words[:n]))
            nested = Node("term", words[0])
            for w in words[1:n]:
                nested = Node(kind, parts=(nested, Node("term", w)))
            got = [[(x["doc_id"], round(x["score"], 6)) for x in sorted(compiler.top(compiler.plan(node, k, 0.0), k, "rank", "doc_id").collect(), key=lambda x: x["rank"])] for node in (whole, nested)]
            assert got[0] == got[1], (n, k, kind)
    began = time.time()
    assert found(e, " ".join(words[i % 8] for i in range(200)), 5) is not None
    assert found(e, " OR ".join(words[i % 8] for i in range(200)), 5)
    assert time.time() - began < 60


def test_command_line_puts_all_paths_in_at_once(spark, tmp_path, capsys):
    (tmp_path / "sub").mkdir()
    for name, text in (("one.txt", "alpha"), ("sub/two.txt", "beta"), ("sub/three.md", "beta")):
        (tmp_path / name).write_text(text)
    db = str(tmp_path / "db")
    assert cli.main(["index", str(tmp_path / "one.txt"), str(tmp_path / "sub"), str(tmp_path / "none"), "-d", db], spark) == 0
    said = capsys.readouterr()
    assert "3 files in" in said.out and "2 files of" in said.out and "none isn't there" in said.err


def test_files(spark, tmp_path):
    for name, body in {"a.txt": b"alpha", "__init__.py": b"beta", ".dot.txt": b"gamma", "empty.txt": b"", "big.txt": b"x" * 50, "x.bin": b"alpha", "bad.md": b"\xff delta", "sub/B.TXT": b"alpha", ".git/c.txt": b"alpha", "node_modules/d.txt": b"alpha"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(body)
    rows = files.read_files(spark, files.listed(tmp_path), 40).collect()
    assert {r["path"] for r in rows} == {"a.txt", "__init__.py", ".dot.txt", "bad.md", "sub/B.TXT"}
    assert {r["path"] for r in files.read_files(spark, files.listed(tmp_path, recursive=False), 40).collect()} == {"a.txt", "__init__.py", ".dot.txt", "bad.md"}
    e = Engine(spark, max_file_size=40)
    assert e.index_directory(tmp_path) == 5
    assert e.index_file(tmp_path / "x.bin") is None and e.index_file(tmp_path / "empty.txt") is None
    assert e.index_file(tmp_path / "a.txt", relative_to=tmp_path) is not None
    assert e.index_info()["num_documents"] == 5
    with pytest.raises(ValueError):
        e.index_file(tmp_path / "a.txt", relative_to=tmp_path / "sub")


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.txt").write_text("hello world")
    db = str(tmp_path / "db")
    run = lambda *a: cli.main(list(a), spark)
    assert run("clear", "-d", db) == 1
    assert run("info", "-d", db) == 0 and "empty" in capsys.readouterr().out
    assert run("index", str(tmp_path / "a.txt"), "-d", db) == 0
    capsys.readouterr()
    assert run("search", "hello", "--json", "-d", db) == 0
    assert len(json.loads(capsys.readouterr().out)) == 1
    assert run("export", "-d", db, "-o", str(tmp_path / "o.json")) == 0
    assert json.loads((tmp_path / "o.json").read_text())["next_doc_id"] == 1
    assert run("clear", "-y", "-d", db) == 0
    assert cli.main([], spark) == 0


def test_stream(spark, tmp_path):
    schema = "path string, text string, title string, metadata string"
    spark.createDataFrame([("a", "hello", None, None), ("b", "world", None, None)], schema).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        ingest(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), tmp_path / "i", tmp_path / "c").awaitTermination(120)
    assert Engine(spark, tmp_path / "i").index_info()["num_documents"] == 2
