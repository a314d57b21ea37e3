"""From a syntax tree to one lazy DataFrame.

``compat`` keeps the established semantics: each side of AND is cut to twice the
wanted number, OR takes the larger score, NOT finds nothing.  ``strict`` is an
extension: full sets, negation by anti join, and ``min_score`` everywhere.

A chain of operators is one node.  Cuts that are wider than the corpus do
nothing, so that the first parts of a long AND are evaluated as whole sets in
one aggregation, and only the last ones, as many as the corpus has doublings,
one by one.  The words of an OR are scored in one scan and merged in one task,
which gets ``k`` rows of each.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.distance import closest
from ..operators.index import Index
from ..operators.ranking import B, K1, added, best, expansion_scores, ranked, term_scores
from .syntax import Node, QueryError, parse

#: Results of which the documents' columns are fetched by a broadcast.
FEW = 100_000
FUZZY_TERMS = 20
#: Words of an AND that are read from the postings one by one; of more, the postings are written beforehand.
SCANS = 2


class Compiler:
    """Plans over one index."""

    def __init__(self, index: Index, mode: str = "compat", k1: float = K1, b: float = B):
        if mode not in ("compat", "strict"):
            raise ValueError(f"mode is compat or strict, not {mode!r}")
        self.index, self.strict, self.k1, self.b = index, mode == "strict", k1, b
        self.spark = index.documents.sparkSession

    def search(self, query: str, k: int = 10, min_score: float = 0.0) -> DataFrame:
        """Decorated results in the order of ``rank``; a query that can't be parsed is a bag of its words."""
        if k < 0:
            raise ValueError("max_results can't be negative")
        if not query.strip():
            return self.decorated(self.nothing())
        try:
            tree = parse(query)
            self.index.frequencies(self.words(tree))  # of all words at once
            found = self.plan(tree, k, min_score)
        except QueryError:
            found = self.bag(query.split(), k, min_score)
        if self.strict:
            found = self.top(found.where(F.col("score") >= min_score), k, "doc_id")
        return self.decorated(found, k)

    def decorated(self, found: DataFrame, k: int = 0) -> DataFrame:
        docs = self.index.documents
        phrase = F.coalesce(F.col("snippet"), F.col("first_line"))
        rows = (F.broadcast(found) if k <= FEW else found).join(docs, "doc_id").select(
            "doc_id", "path", "score", "title", phrase.alias("snippet"), F.lit(None).cast("int").alias("line_number"),
            F.when(F.col("bare"), F.lit(None)).otherwise(F.col("metadata")).alias("metadata"), "rank",
        )
        return rows.repartition(1).sortWithinPartitions("rank") if k <= FEW else rows.orderBy("rank")

    # every plan gives (doc_id, score, rank, snippet, bare); bare ones lose their metadata.
    # k is None: all of them, unranked.

    def nothing(self) -> DataFrame:
        return self.spark.createDataFrame([], "doc_id long, score double, rank int, snippet string, bare boolean")

    @staticmethod
    def plain(found: DataFrame) -> DataFrame:
        return found.select("doc_id", "score", "rank", F.lit(None).cast("string").alias("snippet"), F.lit(False).alias("bare"))

    def words(self, node: Node) -> list[str]:
        """The terms that are looked up for a tree's words and phrases."""
        said = [node.text] if node.kind == "term" else node.words[:1]
        return [self.index.analyzer.term(w) for w in said] + [w for p in node.parts for w in self.words(p)]

    def bag(self, words: list[str], k: int | None, min_score: float) -> DataFrame:
        return self.plain(ranked(self.index, [self.index.analyzer.term(w) for w in words], k, min_score, self.k1, self.b))

    def plan(self, node: Node, k: int | None, min_score: float) -> DataFrame:
        if self.strict and node.kind in ("and", "or", "not"):
            return self.full(node)
        if node.kind == "and":
            return self.both(node.parts, k)
        if node.kind == "or":
            return self.either(node.parts, k, min_score)
        if node.kind == "not":
            return self.nothing()
        return self.leaf(node, k, min_score)

    def leaf(self, node: Node, k: int | None, min_score: float) -> DataFrame:
        term = self.index.analyzer.term
        if node.kind == "term":
            return self.bag([node.text], k, min_score)
        if node.kind == "phrase":
            return self.phrase([term(w) for w in node.words], k, min_score)
        if node.kind == "prefix":
            of = F.col("term").startswith(term(node.text))
            wanted = self.index.terms.where(of).select(F.col("term").alias("i"), "term")
        else:
            near = closest(self.index.terms, term(node.text), "term", node.distance, FUZZY_TERMS)
            of, wanted = None, near.select(F.struct("distance", "term").alias("i"), "term")
        return self.plain(best(added(expansion_scores(self.index, wanted, of, self.k1, self.b)), k, min_score))

    def phrase(self, terms: list[str], k: int | None, min_score: float) -> DataFrame:
        """Documents with the terms at successive positions: one exchange, by document, and no self-join."""
        n, each = len(terms), {t: [i for i, x in enumerate(terms) if x == t] for t in terms}
        places = F.element_at(F.create_map(*[F.lit(x) for pair in each.items() for x in pair]), F.col("term"))
        at = self.index.postings.where(F.col("term").isin(sorted(each))).select("doc_id", "positions", F.explode(places).alias("i")).select("doc_id", "i", F.explode("positions").alias("p"))
        found = at.groupBy("doc_id", (F.col("p") - F.col("i")).alias("start")).agg(F.countDistinct("i").alias("c")).where(F.col("c") == n).select("doc_id").distinct()
        first = ranked(self.index, terms[:1], None if self.strict else 1, 0.0, self.k1, self.b)
        scored = found.join(first.select("doc_id", "score"), "doc_id", "left").select("doc_id", F.coalesce("score", F.lit(0.0)).alias("score"))
        top = self.top(scored, k, "doc_id").where(F.col("score") >= min_score)
        return top.select("doc_id", "score", "rank", F.lit(" ".join(terms)).alias("snippet"), F.lit(True).alias("bare"))

    @staticmethod
    def top(found: DataFrame, k: int | None, *ties: str) -> DataFrame:
        """The ``k`` best, ranked anew."""
        if k is None:
            return found.withColumn("rank", F.lit(None).cast("int"))
        order = [F.desc("score"), *ties]
        return found.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(W.orderBy(*order)))

    def sides(self, parts: tuple[Node, ...], k: int | None, min_score: float = 0.0) -> DataFrame:
        """(i, doc_id, score, rank, snippet, bare) of every part's ``k`` best; all plain terms in one scan.

        Without ``k``, all of them; the rank then orders each part's documents, but doesn't count them.
        """
        plain = [i for i, p in enumerate(parts) if p.kind == "term"]
        out = []
        if plain:
            scores = term_scores(self.index, [self.index.analyzer.term(parts[i].text) for i in plain], self.k1, self.b).where(F.col("s") >= min_score)
            if k is None:
                scores = scores.withColumn("rank", -F.col("s"))
            else:
                order = W.partitionBy("i").orderBy(F.desc("s"), "doc_id")
                scores = scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("double"))
            number = F.element_at(F.lit(plain), F.col("i") + 1)
            out.append(scores.select(number.alias("i"), "doc_id", F.round("s", 4).alias("score"), "rank", F.lit(None).cast("string").alias("snippet"), F.lit(False).alias("bare")))
        every = self.index.totals()[0]
        for i, p in enumerate(parts):
            if p.kind != "term":
                whole = k if k is not None else None if self.strict else every
                out.append(self.plan(p, whole, min_score).select(F.lit(i).alias("i"), "doc_id", "score", F.col("rank").cast("double").alias("rank"), "snippet", "bare"))
        return reduce(DataFrame.unionByName, out)

    def both(self, parts: tuple[Node, ...], k: int) -> DataFrame:
        n, every = len(parts), max(1, self.index.totals()[0])
        if k == 0:
            return self.nothing()
        near = self
        whole = next((m for m in range(n, 1, -1) if k << (n - m) >= every), 0)  # so many first parts are cut nowhere
        words = [w for p in parts[whole:] if p.kind == "term" for w in self.words(p)]
        if len(words) > SCANS:
            self.index.totals()
            near = Compiler(self.index.of_words(words), "strict" if self.strict else "compat", self.k1, self.b)
        if whole:
            rows = F.array_sort(F.collect_list(F.struct("i", "score", "rank", "snippet")))
            found = self.sides(parts[:whole], None).groupBy("doc_id").agg(rows.alias("x")).where(F.size("x") == whole)
            # ties come in the order of the sums before, and at last in that of the first part
            begin = F.struct(F.col("x")[0]["score"].alias("sum"), F.array(F.col("x")[0]["rank"]).alias("key"))
            sums = F.aggregate(F.slice("x", 2, whole), begin, lambda acc, x: F.struct((acc["sum"] + x["score"]).alias("sum"), F.concat(F.array(-(acc["sum"] + x["score"])), acc["key"]).alias("key")))
            said = F.element_at(F.filter(F.transform("x", lambda x: x["snippet"]), lambda s: s.isNotNull()), 1)
            left = found.select("doc_id", sums.alias("s"), F.when(F.exists("x", lambda x: x["snippet"].isNotNull()), said).alias("snippet")).select("doc_id", F.col("s.sum").alias("score"), F.col("s.key").alias("rank"), "snippet")
            if whole == n:
                return self.top(left.withColumn("bare", F.lit(True)), k, "rank", "doc_id").select("doc_id", "score", "rank", "snippet", "bare")
        else:
            left, whole = (near if parts[0].kind == "term" else self).plan(parts[0], min(every, k << (n - 1)), 0.0), 1
        for m in range(whole + 1, n + 1):
            part = parts[m - 1]
            right = (near if part.kind == "term" else self).plan(part, min(every, k << (n - m + 1)), 0.0)
            other = right.select("doc_id", F.col("score").alias("other"), F.col("snippet").alias("other_snippet"))
            joined = left.join(other, "doc_id").select("doc_id", (F.col("score") + F.col("other")).alias("score"), "rank", F.coalesce("snippet", "other_snippet").alias("snippet"), F.lit(True).alias("bare"))
            left = self.top(joined, min(every, k << (n - m)), "rank", "doc_id").select("doc_id", "score", "rank", "snippet", "bare")
        return left

    def either(self, parts: tuple[Node, ...], k: int, min_score: float) -> DataFrame:
        """Of a document's scores the largest counts; parts are merged from the left, each time cut to ``k``."""
        found = self.sides(parts, k, min_score)
        if len(parts) > 2:  # at most k rows of each part, whatever the corpus
            return found.groupBy().applyInPandas(_merged(k, min_score), "doc_id long, score double, rank int, snippet string, bare boolean")
        better = F.struct((-F.col("score")).alias("s"), "i")
        merged = found.groupBy("doc_id").agg(F.max("score").alias("score"), F.min(F.struct("i", "rank")).alias("first"), F.min_by(F.struct("snippet", "bare"), better).alias("of"))
        kept = merged.where(F.col("score") >= min_score).select("doc_id", "score", "first", "of.snippet", "of.bare")
        return self.top(kept, k, "first").select("doc_id", "score", "rank", "snippet", "bare")

    def full(self, node: Node) -> DataFrame:
        """Strict evaluation over whole sets, in no order."""
        if node.kind == "not":
            other = self.plan(node.parts[0], None, 0.0)
            found = self.index.documents.select("doc_id").join(other, "doc_id", "left_anti").withColumn("score", F.lit(0.0))
        else:
            each = self.sides(node.parts, None).groupBy("doc_id")
            if node.kind == "or":
                found = each.agg(F.max("score").alias("score"))
            else:
                parts = F.array_sort(F.collect_list(F.struct("i", "score")))
                found = each.agg(parts.alias("x")).where(F.size("x") == len(node.parts)).select("doc_id", F.aggregate("x", F.lit(0.0), lambda acc, x: acc + x["score"]).alias("score"))
        return found.select("doc_id", "score", F.lit(None).cast("int").alias("rank"), F.lit(None).cast("string").alias("snippet"), F.lit(False).alias("bare"))


def _merged(k: int, min_score: float):
    """Merges the parts of an OR one after the other."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        held: dict = {}
        for i, part in sorted(rows.groupby("i"), key=lambda x: x[0]):
            first = {doc: (0, x[1]) for doc, x in held.items()}
            for doc, score, rank, snippet, bare in part[["doc_id", "score", "rank", "snippet", "bare"]].itertuples(index=False):
                first.setdefault(doc, (1, rank))
                if doc not in held or score > held[doc][0]:
                    held[doc] = (score, rank, snippet, bare)
            best = sorted((doc for doc, x in held.items() if x[0] >= min_score), key=lambda d: (-held[d][0], first[d]))[:k]
            held = {doc: (held[doc][0], at, *held[doc][2:]) for at, doc in enumerate(best, 1)}
        out = pd.DataFrame([(doc, *x) for doc, x in held.items()], columns=["doc_id", "score", "rank", "snippet", "bare"])
        return out.astype({"snippet": object}).where(out.notna(), None)

    return run
