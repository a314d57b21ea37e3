"""BM25 over the index tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .index import Index

K1, B = 1.5, 0.75


def idf(n: Column, df: Column) -> Column:
    return F.when(df == 0, 0.0).otherwise(F.log((n - df + 0.5) / (df + 0.5) + 1))


def tf_norm(tf: Column, length: Column, avg_length: Column, k1: float = K1, b: float = B) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / F.greatest(avg_length, F.lit(1.0))))


def score(index: Index, doc_freq: Column, k1: float = K1, b: float = B) -> Column:
    """What a row of the postings is worth, given its term's document frequency."""
    n, avg = index.totals()
    weight = idf(F.lit(float(n)), doc_freq)
    return F.when(weight > 0, weight * tf_norm(F.col("term_freq"), F.col("length"), F.lit(avg), k1, b)).otherwise(0.0)


def term_scores(index: Index, terms: list[str], k1: float = K1, b: float = B) -> DataFrame:
    """(i, doc_id, s) of query words: one filtered scan of the postings and no exchange.

    Frequencies and totals are literals, looked up beforehand.  A word that comes
    more than once has rows under each of its numbers.
    """
    freq = index.frequencies(terms)
    if not freq:
        return index.postings.sparkSession.createDataFrame([], "i int, doc_id long, s double")
    hits = index.postings.where(F.col("term").isin(sorted(freq))).select("term", "doc_id", "term_freq", "length")
    if len(freq) == 1:
        ((term, df),) = freq.items()
        hits = hits.withColumn("doc_freq", F.lit(df))
    else:
        hits = hits.withColumn("doc_freq", _lookup(freq))
    at = {t: [i for i, x in enumerate(terms) if x == t] for t in freq}
    if max(map(len, at.values())) == 1:
        place = _lookup({t: x[0] for t, x in at.items()}) if len(at) > 1 else F.lit(next(iter(at.values()))[0])
    else:
        place = F.explode(_lookup(at))
    return hits.select(place.alias("i"), "doc_id", score(index, F.col("doc_freq"), k1, b).alias("s"))


def _lookup(values: dict) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), F.col("term"))


def expansion_scores(index: Index, wanted: DataFrame, terms: Column | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """As ``term_scores``, of a DataFrame (i, term); ``terms`` is a filter of the postings that holds for all of them.

    How the two are joined is left to the optimiser, as an expansion may be a
    large share of the vocabulary.
    """
    postings, found = index.postings, index.terms
    if terms is not None:
        postings, found = postings.where(terms), found.where(terms)
    hits = postings.select("term", "doc_id", "term_freq", "length").join(wanted.join(found.select("term", "doc_freq"), "term"), "term")
    return hits.select("i", "doc_id", score(index, F.col("doc_freq"), k1, b).alias("s"))


def added(scores: DataFrame, single: bool = False) -> DataFrame:
    """(doc_id, score, first): sums in the order of ``i``, so that they don't depend on the plan.

    ``single``: every document has one row, so that nothing is to be grouped.
    """
    if single:
        return scores.select("doc_id", F.col("s").alias("score"), F.col("i").alias("first"))
    parts = F.array_sort(F.collect_list(F.struct("i", "s")))
    return scores.groupBy("doc_id").agg(F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x["s"]).alias("score"), F.min("i").alias("first"))


def best(scored: DataFrame, k: int | None, min_score: float = 0.0) -> DataFrame:
    """(doc_id, score, rank): the ``k`` best; equal ones in the order in which the terms reach them.

    Without ``k`` all of them, in no order and with a null rank.
    """
    kept = scored.where(F.col("score") >= min_score)
    if k is None:
        return kept.select("doc_id", F.round("score", 4).alias("score"), F.lit(None).cast("int").alias("rank"))
    order = [F.desc("score"), "first", "doc_id"]
    top = kept.orderBy(*order).limit(max(0, k))
    return top.select("doc_id", F.round("score", 4).alias("score"), F.row_number().over(W.orderBy(*order)).alias("rank"))  # over the k wanted rows


def ranked(index: Index, wanted: DataFrame | list[str], k: int | None, min_score: float = 0.0, k1: float = K1, b: float = B) -> DataFrame:
    """(doc_id, score, rank): the ``k`` best documents for words, or for an expansion (i, term).

    A word may come more than once.
    """
    if isinstance(wanted, DataFrame):
        return best(added(expansion_scores(index, wanted, None, k1, b)), k, min_score)
    return best(added(term_scores(index, wanted, k1, b), len(wanted) == 1), k, min_score)


def explained(index: Index, term: str, doc_id: int, k1: float = K1, b: float = B) -> DataFrame:
    """How a term scores in a document: one row, or none if either lacks the other."""
    hit = index.postings.where((F.col("term") == term) & (F.col("doc_id") == doc_id)).select("term", "doc_id", "term_freq")
    rows = hit.join(index.term_info(term).select("term", "doc_freq"), "term").join(index.document(doc_id).select("doc_id", "path", "length"), "doc_id").withColumns(dict(zip(("n", "avg_length"), map(F.lit, index.totals()))))
    weight, norm = idf(F.col("n"), F.col("doc_freq")), tf_norm(F.col("term_freq"), F.col("length"), F.col("avg_length"), k1, b)
    return rows.select(
        "term", "doc_id", F.col("path").alias("doc_path"), "term_freq", "doc_freq", F.col("n").alias("total_docs"), F.col("length").alias("doc_length"),
        F.round("avg_length", 2).alias("avg_doc_length"), F.round(weight, 4).alias("idf"), F.round(norm, 4).alias("tf_normalized"),
        F.round(weight * norm, 4).alias("score"), F.lit(float(k1)).alias("k1"), F.lit(float(b)).alias("b"),
    )
