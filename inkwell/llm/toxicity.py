"""Toxicity by class-conditional Kneser-Ney models.

Two letter n-gram models, of toxic and of ordinary documents, have the counts
of their lower orders in common: an expression that a class has seen too rarely
gets its probability from these shared backoff counts, the same in both models.
A document is toxic if its log-likelihood per letter is larger by a margin under
the toxic model.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._lex import fresh, pieces
from ._store import written
from .language import LETTERS
from .quality import KneserNey, counted, gram_codes

#: Labelled documents of each class, of which the models are fitted, at most.
SAMPLE = 5000
#: Recall counts so many times as much as precision where the margin is chosen.
BETA = 2.0
#: By cross-validation on labelled documents: longer n-grams of so few documents are noise.
ORDER, SHARED = 4, 3


def labelled(labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id") -> DataFrame:
    """(doc, label) of each labelled document; of one with both labels the toxic one counts."""
    rows = labels.select(F.col(doc_id).alias("doc"), F.col(label).cast("int").alias("label")).where("doc is not null and label in (0, 1)")
    return rows.groupBy("doc").agg(F.max("label").alias("label"))


def sampled(docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", most: int = SAMPLE) -> DataFrame:
    """(doc, text, label): of each class the ``most`` labelled documents of least hash, or all."""
    rows, chosen = labelled(labels, label, doc_id), None
    for c in (0, 1):
        part = rows.where(F.col("label") == c).orderBy(F.xxhash64("doc"), "doc").limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text"))
    return texts.join(F.broadcast(chosen), "doc")


def margin(y: np.ndarray, s: np.ndarray, weight: np.ndarray, beta: float = BETA) -> float:
    """The score above which F-beta is best, half way to the next one below; equal scores stay together.

    ``y``: 1 for toxic; ``weight``: how many documents each stands for.
    """
    order = np.argsort(-s, kind="stable")
    y, s, weight = y[order], s[order], weight[order]
    hit, found = np.cumsum(weight * y), np.cumsum(weight)
    value = (1 + beta**2) * hit / (found + beta**2 * (weight * y).sum())
    last = np.flatnonzero(np.r_[s[1:] != s[:-1], True])
    k = int(last[value[last].argmax()])
    return float(s[k] + s[min(k + 1, len(s) - 1)]) / 2 if k + 1 < len(s) else float(np.nextafter(s[k], -np.inf))


class Models:
    """Log-likelihood ratios under the models of two classes."""

    def __init__(self, counts: list[tuple[np.ndarray, np.ndarray]]):
        """``counts``: for each class its n-grams, sorted, and how often it has them."""
        self.threshold, self.classes = 0.0, None
        if not all(len(c) for c, _ in counts):
            return
        code, inv = np.unique(np.concatenate([c for c, _ in counts]), return_inverse=True)
        n = np.bincount(inv, np.concatenate([n for _, n in counts])).astype(np.int64)
        short, inv = np.unique(code & ((1 << 7 * SHARED) - 1), return_inverse=True)
        shared = KneserNey(short, np.bincount(inv, n).astype(np.int64), SHARED)
        self.classes = [KneserNey(c, n, ORDER, base=shared) for c, n in counts]

    def scores(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Mean log-ratio, toxic to ordinary, of each row's letters; NaN for an empty text."""
        size = np.diff(offs)
        out = np.full(len(size), np.nan)
        if self.classes is None or not len(data):
            return out
        code = gram_codes(data, offs, ORDER, LETTERS)
        ratio = self.classes[1].logp(code).astype(np.float64) - self.classes[0].logp(code)
        at = np.flatnonzero(size)
        out[at] = np.round(np.add.reduceat(ratio, offs[:-1][at]) / size[at], 6)
        return out


def _models(rows: DataFrame) -> Models:
    counts = counted(rows.select("text", F.col("label").cast("string").alias("lang")), ORDER, symbols=LETTERS)
    parts = []
    for c in "01":  # one class at a time, as integers: the driver holds no more than it needs
        part = counts.where(F.col("lang") == c).select("code", "n").toArrow()
        code, n = (part.column(k).to_numpy() for k in ("code", "n"))
        order = np.argsort(code)
        parts.append((code[order], n[order]))
        del part, code, n
    return Models(parts)


def fitted(docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", most: int = SAMPLE) -> Models:
    """Models of the sample; the margin is the best on a fifth of it, scored by models of the rest.

    There a document of either class counts as often as it stands for others in ``labels``.
    """
    have = dict(labelled(labels, label, doc_id).groupBy("label").count().collect())
    held = written(sampled(docs, labels, label, doc_id, text, most), "labelled")
    apart = F.pmod(F.xxhash64("doc", F.lit("held out")), F.lit(5)) == 0
    trial = _models(held.where(~apart))
    shared = held.sparkSession.sparkContext.broadcast(trial)
    del trial
    test = held.where(apart).select("label", _score(shared)(F.col("text")).alias("s")).where("s is not null").toPandas()
    shared.destroy()
    out = _models(held)
    y, s = test["label"].to_numpy(), test["s"].to_numpy()
    if y.sum():
        weight = np.where(y == 1, have.get(1, 0) / min(most, max(1, have.get(1, 0))), have.get(0, 0) / min(most, max(1, have.get(0, 0))))
        out.threshold = margin(y, s, weight)
    return out


def _score(shared):
    def run(text: pa.Array) -> pa.Array:
        out = np.full(len(text), np.nan)
        for i, j, data, offs in pieces(text):
            out[i:j] = shared.value.scores(data, offs)
        return pa.array(out, from_pandas=True)

    return F.arrow_udf(run, "double")


def judged(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", most: int = SAMPLE) -> DataFrame:
    """``docs`` with ``toxic_score`` (log-ratio per letter) and ``toxic``.

    The models are fitted from all labelled documents of each class, ``most`` at
    most; repeated labels count once, and of two the toxic one; every document
    is scored, repeated rows and ties alike.  An empty table gives an empty
    result.  Null and empty texts have a null score and aren't toxic; nor is anything, without
    labels of both classes.  Columns of these names in ``docs`` are replaced.
    """
    models = fitted(docs, labels, label, doc_id, text, most)
    shared = docs.sparkSession.sparkContext.broadcast(models)
    (score,) = fresh(docs, "score")
    out = docs.withColumn(score, _score(shared)(F.col(text)))
    cols = [docs[c] for c in docs.columns if c.lower() not in ("toxic_score", "toxic")]
    return out.select(*cols, F.col(score).alias("toxic_score"), F.coalesce(F.col(score) > models.threshold, F.lit(False)).alias("toxic"))
