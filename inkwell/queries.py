"""The registered queries over the driver's tables, and the same as SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import distance
from .functions.text import RAW, Analyzer, stem_step_sql, stems_sql, token_offsets, token_rows, tokens_sql, with_stems
from .lineage import shared_folder
from .operators.index import Index
from .operators.ranking import explained, idf, ranked, tf_norm
from .plans.compile import Compiler
from .sources import store, tables

DEFAULT, PLAIN = Analyzer(), Analyzer(stem=False)
EVERY = Analyzer(remove_stop_words=False, stem=False)

_held: dict[tuple, Index] = {}


def index_of(spark: SparkSession, sf_dir: str, analyzer: Analyzer = PLAIN) -> Index:
    """The documents' index, built once in a session."""
    key = (spark.sparkContext.applicationId, sf_dir, analyzer)
    if key not in _held:
        _held[key] = Index.build(tables.corpus(spark, sf_dir), analyzer)
    return _held[key]


def _tokens(name: str, text: str, key: str, analyzer: Analyzer) -> tuple[Callable, str]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = tables.table(spark, sf_dir, name)
        return rows.select(*[F.col(k) for k in key.split(", ")], F.size(analyzer.tokens(text)).alias("tokens"))

    return run, f"SELECT {key}, len({tokens_sql(text, analyzer)})::int AS tokens FROM {name}"


def _positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_rows(tables.table(spark, sf_dir, "documents"), PLAIN)


def _offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_offsets(tables.table(spark, sf_dir, "documents"), PLAIN)


_TOK = f"SELECT doc_id, unnest({tokens_sql('text', PLAIN)}) AS token, unnest(range(len({tokens_sql('text', PLAIN)})))::int AS pos FROM documents"
_VOCABULARY = f"SELECT DISTINCT lower(token) AS token FROM ({_TOK})"


def _stem_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = token_rows(tables.table(spark, sf_dir, "documents"), PLAIN).select(F.lower("token").alias("token")).distinct()
    return with_stems(words, "token").select("token", "term")


def _stem_step(k: int) -> tuple[Callable, str]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from .functions.text import stem_step

        words = token_rows(tables.table(spark, sf_dir, "documents"), PLAIN).select(F.lower("token").alias("token")).distinct()
        return words.select("token", stem_step(F.col("token"), k).alias("stemmed"))

    return run, f"SELECT token, {stem_step_sql('token', k)} AS stemmed FROM ({_VOCABULARY})"


_OFFSETS = f"""WITH raw AS (SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS k FROM (SELECT doc_id, regexp_extract_all(text, '[^a-zA-Z0-9]*{RAW}') AS p FROM documents)),
word AS (SELECT doc_id, k, word, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY k) - length(word) AS start FROM (SELECT *, regexp_extract(piece, '{RAW}$') AS word FROM raw)),
part AS (SELECT doc_id, k, start, unnest(t) AS token, generate_subscripts(t, 1) AS j FROM (SELECT *, {tokens_sql('word', EVERY)} AS t FROM word)),
placed AS (SELECT *, start + sum(length(token) + 1) OVER (PARTITION BY doc_id, k ORDER BY j) - length(token) - 1 AS place FROM part)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k, j) - 1)::int AS pos, token, place::int AS "offset" FROM placed WHERE len({tokens_sql('token', Analyzer(stem=False, split_camel_case=False))}) > 0"""

# SQL of the index tables, without and with stems

_DOCS = f"SELECT doc_id, concat_ws('/', source, doc_id) AS path, len({tokens_sql('text', PLAIN)}) AS length, nullif(left(regexp_split_to_array(text, '\\r\\n|[\\n\\x0B\\f\\r\\x{{85}}\\x{{2028}}\\x{{2029}}]')[1], 200), '') AS line FROM documents"
_POSTS = f"SELECT lower(token) AS term, doc_id, count(*)::int AS term_freq, list_sort(list(pos)) AS positions FROM ({_TOK}) GROUP BY ALL"
_STEMMED = f"SELECT s.term, t.doc_id, count(*)::int AS term_freq, list_sort(list(t.pos)) AS positions FROM ({_TOK}) t JOIN ({stems_sql(_VOCABULARY)}) s ON lower(t.token) = s.token GROUP BY ALL"


def _with(stemmed: bool = False) -> str:
    return f"""WITH docs AS MATERIALIZED ({_DOCS}), post AS MATERIALIZED ({_STEMMED if stemmed else _POSTS}),
terms AS MATERIALIZED (SELECT term, count(*) AS doc_freq, sum(term_freq)::bigint AS total_freq FROM post GROUP BY term),
stats AS (SELECT count(*) AS n, coalesce(avg(length), 0) AS avgdl FROM docs)"""


def _score(k1: float = 1.5, b: float = 0.75) -> str:
    return f"ln((n - doc_freq + 0.5::double) / (doc_freq + 0.5::double) + 1) * (term_freq * ({k1}::double + 1) / (term_freq + {k1}::double * (1 - {b}::double + {b}::double * length / greatest(avgdl, 1.0::double))))"


def _ranked_sql(wanted: str, k: int, min_score: float = 0.0, k1: float = 1.5, b: float = 0.75) -> str:
    """(doc_id, score, rank) of the best for a query of (i, term)."""
    return f"""SELECT doc_id, round(s, 4) AS score, row_number() OVER (ORDER BY round(s, 8) DESC, f, doc_id) AS rank FROM (
SELECT doc_id, sum({_score(k1, b)}) AS s, min(i) AS f FROM ({wanted}) JOIN post USING (term) JOIN terms USING (term) JOIN docs USING (doc_id), stats GROUP BY doc_id
) WHERE s >= {min_score}::double ORDER BY rank LIMIT {k}"""


def _words_sql(*terms: str) -> str:
    return " UNION ALL ".join(f"SELECT {i} AS i, '{t}' AS term" for i, t in enumerate(terms))


def _phrase_sql(terms: list[str], k: int) -> str:
    n = len(terms)
    found = f"SELECT DISTINCT doc_id FROM (SELECT doc_id, p - i AS start, count(DISTINCT i) AS c FROM (SELECT doc_id, i, unnest(positions) AS p FROM ({_words_sql(*terms)}) JOIN post USING (term)) GROUP BY ALL) WHERE c = {n}"
    best = _ranked_sql(_words_sql(terms[0]), 1)
    return f"SELECT doc_id, coalesce(score, 0) AS score, row_number() OVER (ORDER BY coalesce(score, 0) DESC, doc_id) AS rank FROM ({found}) LEFT JOIN ({best}) b USING (doc_id) ORDER BY rank LIMIT {k}"


def _results_sql(found: str, stemmed: bool = False) -> str:
    return f"{_with(stemmed)} SELECT f.doc_id, d.path, f.score, f.rank::int AS rank FROM ({found}) f JOIN docs d USING (doc_id)"


def _search(query: str, k: int = 20, mode: str = "compat", analyzer: Analyzer = PLAIN, min_score: float = 0.0) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Compiler(index_of(spark, sf_dir, analyzer), mode).search(query, k, min_score).select("doc_id", "path", "score", "rank")

    return run


def _rank(terms: list[str], k: int = 20, min_score: float = 0.0, k1: float = 1.5, b: float = 0.75) -> tuple[Callable, str]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return ranked(index_of(spark, sf_dir), terms, k, min_score, k1, b)

    return run, f"{_with()} SELECT doc_id, score, rank::int AS rank FROM ({_ranked_sql(_words_sql(*terms), k, min_score, k1, b)})"


def _of_index(f: Callable[[Index], DataFrame], analyzer: Analyzer = PLAIN) -> Callable:
    return lambda spark, sf_dir: f(index_of(spark, sf_dir, analyzer))


def _and_sql(left: str, right: str, k: int) -> str:
    return f"SELECT doc_id, s AS score, row_number() OVER (ORDER BY s DESC, rank) AS rank FROM (SELECT l.doc_id, l.score + r.score AS s, l.rank FROM ({left}) l JOIN ({right}) r USING (doc_id)) ORDER BY 3 LIMIT {k}"


def _or_sql(left: str, right: str, k: int) -> str:
    both = f"SELECT 0 AS side, * FROM ({left}) UNION ALL SELECT 1 AS side, * FROM ({right})"
    best = f"SELECT doc_id, max(score) AS s, min(side * 1000000 + rank) AS f FROM ({both}) GROUP BY doc_id"
    return f"SELECT doc_id, s AS score, row_number() OVER (ORDER BY s DESC, f) AS rank FROM ({best}) ORDER BY 3 LIMIT {k}"


def _term_sql(t: str, k: int) -> str:
    return _ranked_sql(_words_sql(t), k)


def _closest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distance.closest(index_of(spark, sf_dir).terms, "ention", "term", 2, 20)


_PAIRS = "SELECT a.p_partkey, a.p_name, b.p_name AS other FROM part a JOIN part b ON a.p_partkey = b.p_partkey + 1"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = tables.table(spark, sf_dir, "part").select("p_partkey", "p_name")
    other = names.select((F.col("p_partkey") + 1).alias("p_partkey"), F.col("p_name").alias("other"))
    return names.join(other, "p_partkey")


def _lev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("p_partkey", distance.levenshtein("p_name", "other").alias("distance"))


def _within(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("p_partkey", distance.within(F.col("p_name"), F.col("other"), 8).alias("near"))


def _osa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("p_partkey", distance.damerau("p_name", "other").alias("distance"))


_OSA = f"""WITH RECURSIVE pair AS ({_PAIRS}), s AS (
SELECT p_partkey, p_name AS a, other AS b, 0 AS i, range(0, length(other) + 1) AS old, NULL::bigint[] AS older FROM pair
UNION ALL
SELECT p_partkey, a, b, i + 1, list_transform(base, lambda x, j: j - 1 + list_min(list_transform(base[1:j], lambda y, t: y - (t - 1)))), old FROM (
  SELECT *, list_prepend(i + 1, list_transform(range(1, length(b) + 1), lambda j: least(old[j + 1] + 1, old[j] + CASE WHEN a[i + 1] = b[j] THEN 0 ELSE 1 END,
    CASE WHEN i >= 1 AND j >= 2 AND a[i + 1] = b[j - 1] AND a[i] = b[j] THEN older[j - 1] + 1 ELSE 100000 END))) AS base FROM s WHERE i < length(a)))
SELECT p_partkey, old[-1]::int AS distance FROM s WHERE i = length(a)"""


def _without_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of an index that gave them ids, with the tokens that their postings have."""
    made = Index.build(tables.corpus(spark, sf_dir).drop("doc_id"), PLAIN)
    held = made.postings.groupBy("doc_id").agg(F.sum("term_freq").alias("tokens"), F.min("term").alias("least"))
    return made.documents.join(held, "doc_id", "left").select("doc_id", "path", "length", "tokens", "least")


def _explain(index: Index) -> DataFrame:
    """Two terms in the first document that has each."""
    first = {t: index.postings.where(F.col("term") == t).agg(F.min("doc_id")).first()[0] for t in ("thst", "ention")}
    return explained(index, "thst", first["thst"]).unionByName(explained(index, "ention", first["ention"])).drop("k1", "b")


def _upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.corpus(spark, sf_dir)
    base = Index.build(docs, PLAIN)
    changed = docs.where("doc_id % 5 = 0").select("path", F.concat("text", F.lit(" updated")).alias("text"), "title", "metadata")
    added = tables.as_documents(tables.table(spark, sf_dir, "benchmark"), "text", F.concat(F.lit("benchmark/"), F.col("item_id").cast("string")))
    return base.upsert(changed.unionByName(added)).stats()


def _delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = index_of(spark, sf_dir)
    return base.delete(base.documents.where("doc_id % 3 = 0").select("path")).stats()


def _roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    store.save(index_of(spark, sf_dir), folder)
    return store.load(spark, folder).stats()


def _stats_sql(docs: str) -> str:
    """Statistics of (id, text) rows."""
    tok = f"SELECT id, {tokens_sql('text', PLAIN)} AS t FROM ({docs})"
    return f"""WITH d AS MATERIALIZED ({tok}) SELECT (SELECT count(*) FROM d) AS num_documents, (SELECT count(DISTINCT lower(x)) FROM (SELECT unnest(t) AS x FROM d)) AS num_terms,
(SELECT sum(len(t))::bigint FROM d) AS total_tokens, (SELECT round(avg(len(t)), 2) FROM d) AS avg_doc_length"""


def _batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item as a bag-of-words query, in one plan: the best document of each."""
    index = index_of(spark, sf_dir)
    items = token_rows(tables.table(spark, sf_dir, "benchmark"), PLAIN, "item_id").select(F.col("doc_id").alias("item_id"), F.lower("token").alias("term"))
    wanted = items.groupBy("item_id", "term").agg(F.count("*").alias("times"))
    (n, mean), freq = index.totals(), F.col("doc_freq")
    wanted = wanted.join(index.terms.select("term", "doc_freq"), "term").select("item_id", "term", (idf(F.lit(float(n)), freq) * F.col("times")).alias("weight"))
    norm = tf_norm(F.col("term_freq"), F.col("length"), F.lit(mean))
    posts = index.postings.join(F.broadcast(items.select("term").distinct()), "term", "left_semi").select("doc_id", "term", norm.alias("norm"))
    hits = posts.repartition("doc_id").join(F.broadcast(wanted), "term")  # a document's hits, many times its postings, are added up where those are
    scored = hits.groupBy("item_id", "doc_id").agg(F.round(F.sum(F.col("weight") * F.col("norm")), 4).alias("score"))
    best = W.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(best)).where("rank = 1").select("item_id", "doc_id", "score")


_BATCH = f"""{_with()}, item AS (SELECT item_id, lower(unnest({tokens_sql('text', PLAIN)})) AS term FROM benchmark)
SELECT item_id, doc_id, score FROM (SELECT item_id, doc_id, round(sum({_score()}), 4) AS score FROM item JOIN post USING (term) JOIN terms USING (term) JOIN docs USING (doc_id), stats GROUP BY item_id, doc_id)
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) = 1"""


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = Compiler(index_of(spark, sf_dir)).search("the idiot OR stupid", 50)
    return found.select("doc_id", "score").join(tables.table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "score", "quality", "toxic")


_K = 20
#: Words that many documents have.
_COMMON = "th er re nd ha ti es ly ou ed nt ea st".split()


def _chain_sql(terms: list[str], k: int) -> str:
    """AND from the left: both sides of every step are cut to twice what it gives."""
    return _term_sql(terms[0], k) if len(terms) == 1 else _and_sql(_chain_sql(terms[:-1], 2 * k), _term_sql(terms[-1], 2 * k), k)


_PREFIX = "SELECT row_number() OVER (ORDER BY term) - 1 AS i, term FROM terms WHERE starts_with(term, 'thst')"
_FUZZY = "SELECT row_number() OVER (ORDER BY d, term) - 1 AS i, term FROM (SELECT term, levenshtein(term, 'ention') AS d FROM terms WHERE levenshtein(term, 'ention') <= 1 ORDER BY d, term LIMIT 20)"

_ALL: dict[str, tuple[Callable, str | None]] = {
    "tok_count_per_doc": _tokens("documents", "text", "doc_id", DEFAULT),
    "tok_camel_off": _tokens("documents", "text", "doc_id", Analyzer(split_camel_case=False)),
    "tok_stopwords_kept": _tokens("documents", "text", "doc_id", EVERY),
    "tok_custom_stopwords": _tokens("documents", "text", "doc_id", Analyzer(custom_stop_words=frozenset({"ention", "thst"}))),
    "tok_min_len": _tokens("documents", "text", "doc_id", Analyzer(min_token_length=4)),
    "tok_pages_html": _tokens("pages", "html", "page_id", DEFAULT),
    "tok_conversations": _tokens("conversations", "text", "conv_id, turn", DEFAULT),
    "tok_positions": (_positions, f"SELECT doc_id, pos, token FROM ({_TOK})"),
    "tok_char_offsets": (_offsets, _OFFSETS),
    "stem_vocab": (_stem_vocabulary, f"SELECT token, term FROM ({stems_sql(_VOCABULARY)})"),
    **{f"stem_step{k}": _stem_step(k) for k in range(1, 6)},
    "postings_positions": (_of_index(lambda i: i.postings.select("term", "doc_id", "term_freq", F.array_join(F.transform("positions", lambda p: p.cast("string")), ",").alias("positions"))), f"SELECT term, doc_id, term_freq, array_to_string(positions, ',') AS positions FROM ({_POSTS})"),
    "term_freq": (_of_index(lambda i: i.postings.select("term", "doc_id", "term_freq"), DEFAULT), f"SELECT term, doc_id, term_freq FROM ({_STEMMED})"),
    "doc_freq": (_of_index(lambda i: i.terms.select("term", "doc_freq")), f"{_with()} SELECT term, doc_freq FROM terms"),
    "total_freq": (_of_index(lambda i: i.terms.select("term", "total_freq"), DEFAULT), f"{_with(True)} SELECT term, total_freq FROM terms"),
    "doc_lengths": (_of_index(lambda i: i.documents.select("doc_id", "path", "length")), f"SELECT doc_id, path, length::int AS length FROM ({_DOCS})"),
    "first_lines": (_of_index(lambda i: i.documents.select("doc_id", "first_line")), f"SELECT doc_id, line AS first_line FROM ({_DOCS})"),
    "corpus_stats": (_of_index(Index.stats), _stats_sql("SELECT doc_id AS id, text FROM documents")),
    "vocab_sorted": (_of_index(Index.vocabulary), f"{_with()} SELECT term FROM terms ORDER BY term"),
    "top_terms": (_of_index(Index.top_terms, DEFAULT), f"{_with(True)} SELECT term, doc_freq, total_freq FROM terms ORDER BY total_freq DESC, term LIMIT 20"),
    "idf_all": (_of_index(lambda i: i.terms.select("term", F.round(idf(F.lit(float(i.totals()[0])), F.col("doc_freq")), 6).alias("idf"))), f"{_with()} SELECT term, round(ln((n - doc_freq + 0.5::double) / (doc_freq + 0.5::double) + 1), 6) AS idf FROM terms, stats"),
    "bm25_term": _rank(["ention"]),
    "bm25_multi": _rank(["ention", "thst", "nope"]),
    "bm25_repeat_term": _rank(["ention", "thst", "ention"]),
    "bm25_k1_b": _rank(["ention", "inen"], k1=1.2, b=0.5),
    "bm25_min_score": _rank(["ention", "thst"], k=1000, min_score=4.0),
    "bm25_explain": (_of_index(_explain), f"{_with()} SELECT term, doc_id, path AS doc_path, term_freq, doc_freq, n AS total_docs, length::int AS doc_length, round(avgdl, 2) AS avg_doc_length, round(ln((n - doc_freq + 0.5::double) / (doc_freq + 0.5::double) + 1), 4) AS idf, round(term_freq * 2.5::double / (term_freq + 1.5::double * (0.25::double + 0.75::double * length / greatest(avgdl, 1.0::double))), 4) AS tf_normalized, round({_score()}, 4) AS score FROM post JOIN terms USING (term) JOIN docs USING (doc_id), stats WHERE term IN ('thst', 'ention') AND doc_id = (SELECT min(p.doc_id) FROM post p WHERE p.term = terms.term)"),
    "bm25_batch": (_batch, _BATCH),
    "q_term": (_search("ention"), _results_sql(_term_sql("ention", _K))),
    "q_term_stemmed": (_search("entions inened", analyzer=DEFAULT), _results_sql(_and_sql(_term_sql(DEFAULT.term("entions"), 40), _term_sql(DEFAULT.term("inened"), 40), _K), True)),
    "q_phrase": (_search('"attion thanedble"'), _results_sql(_phrase_sql(["attion", "thanedble"], _K))),
    "q_phrase_none": (_search('"ention thst"'), _results_sql(_phrase_sql(["ention", "thst"], _K))),
    "q_phrase_3": (_search('"attion thanedble anea"'), _results_sql(_phrase_sql(["attion", "thanedble", "anea"], _K))),
    "q_prefix": (_search("thst*"), _results_sql(_ranked_sql(_PREFIX, _K))),
    "q_fuzzy": (_search("ention~1"), _results_sql(_ranked_sql(_FUZZY, _K))),
    "q_and": (_search("ention AND inen"), _results_sql(_and_sql(_term_sql("ention", 40), _term_sql("inen", 40), _K))),
    "q_and_implicit": (_search("ention inen"), _results_sql(_and_sql(_term_sql("ention", 40), _term_sql("inen", 40), _K))),
    "q_or": (_search("ention OR thst"), _results_sql(_or_sql(_term_sql("ention", 20), _term_sql("thst", 20), _K))),
    "q_and_13": (_search(" AND ".join(_COMMON), 100), _results_sql(_chain_sql(_COMMON, 100))),
    "q_or_13": (_search(" OR ".join(_COMMON)), _results_sql(reduce(lambda l, t: _or_sql(l, _term_sql(t, _K), _K), _COMMON[1:], _term_sql(_COMMON[0], _K)))),
    "q_nested": (_search("(ention OR inen) AND (thst OR haea)"), _results_sql(_and_sql(_or_sql(_term_sql("ention", 40), _term_sql("inen", 40), 40), _or_sql(_term_sql("thst", 40), _term_sql("haea", 40), 40), _K))),
    "q_not_compat": (_search("ention AND NOT inen"), _results_sql("SELECT 0::bigint AS doc_id, 0::double AS score, 0 AS rank WHERE false")),
    "q_and_strict": (_search("ention AND inen", 100_000, "strict"), _results_sql(_and_sql(_term_sql("ention", 10**9), _term_sql("inen", 10**9), 100_000).replace("ORDER BY s DESC, rank", "ORDER BY s DESC, doc_id"))),
    "q_not_strict": (_search("ention AND NOT inen", 100_000, "strict"), _results_sql(f"SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM ({_term_sql('ention', 10**9)}) WHERE doc_id NOT IN (SELECT doc_id FROM post WHERE term = 'inen')")),
    "q_fallback": (_search("ention NOT (inen"), _results_sql(_ranked_sql(_words_sql("ention", "not", "(inen"), _K))),
    "search_labels": (_labelled, f"SELECT doc_id, score, quality, toxic FROM ({_results_sql(_or_sql(_and_sql(_term_sql('the', 100), _term_sql('idiot', 100), 50), _term_sql('stupid', 50), 50))}) JOIN labels USING (doc_id)"),
    "build_without_ids": (_without_ids, f"SELECT row_number() OVER (ORDER BY path) - 1 AS doc_id, path, length::int AS length, t.tokens, t.least FROM ({_DOCS}) LEFT JOIN (SELECT doc_id, count(*) AS tokens, min(lower(token)) AS least FROM ({_TOK}) GROUP BY doc_id) t USING (doc_id)"),
    "lev_pairs": (_lev, f"SELECT p_partkey, levenshtein(p_name, other)::int AS distance FROM ({_PAIRS})"),
    "lev_within": (_within, f"SELECT p_partkey, levenshtein(p_name, other) <= 8 AS near FROM ({_PAIRS})"),
    "osa_pairs": (_osa, _OSA),
    "closest_terms": (_closest, f"{_with()} SELECT term, levenshtein(term, 'ention')::int AS distance FROM terms WHERE levenshtein(term, 'ention') <= 2 ORDER BY distance, term LIMIT 20"),
    "upsert_stats": (_upsert, _stats_sql("SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN text || ' updated' ELSE text END AS text FROM documents UNION ALL SELECT -1 - item_id AS id, text FROM benchmark")),
    "delete_stats": (_delete, _stats_sql("SELECT doc_id AS id, text FROM documents WHERE doc_id % 3 <> 0")),
    "save_load_roundtrip": (_roundtrip, _stats_sql("SELECT doc_id AS id, text FROM documents")),
    "export_json_rows": (_of_index(Index.export_rows), f"""{_with()} SELECT 'document' AS kind, doc_id::varchar AS key, '{{"path":"' || path || '","length":' || length || ',"title":"' || path || '","metadata":null}}' AS value FROM docs
UNION ALL SELECT 'term', term, '{{"doc_freq":' || count(*) || ',"postings":[' || string_agg('{{"doc_id":' || doc_id || ',"term_freq":' || term_freq || ',"positions":[' || array_to_string(positions, ',') || ']}}', ',' ORDER BY doc_id) || ']}}' FROM post GROUP BY term"""),
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for k, (f, _) in _ALL.items()}
ORACLE_SQL: dict[str, str] = {k: s for k, (_, s) in _ALL.items() if s}
