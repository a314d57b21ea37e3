"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1.  A trigram's vector binds its
letters' vectors, permuted by their place, by multiplication; a text's vector
bundles its trigrams' by addition.  A language's prototype bundles all its
documents; a document has the language of the prototype of largest cosine,
where its own vector is taken out of the prototype that it was bundled into.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._lex import fresh, pieces
from .quality import BITS, CLASS, counted, gram_codes

DIMENSIONS = 1024
ORDER = 3
#: Letters without case, bytes of other scripts in classes, and the rest as spaces.
LETTERS = CLASS.copy()
LETTERS[:128] = 32
LETTERS[97:123] = np.arange(97, 123)
LETTERS[65:91] = np.arange(97, 123)
LETTERS[128:160] = LETTERS[160:192]
_VECTORS = np.random.Generator(np.random.PCG64(7)).integers(0, 2, (1 << BITS, DIMENSIONS)).astype(np.int8) * 2 - 1
_PERMUTED = [np.roll(_VECTORS, k, 1) for k in range(ORDER)]


def bound(codes: np.ndarray) -> np.ndarray:
    """[code, dimension] vectors of packed n-grams."""
    out = _PERMUTED[0][codes & ((1 << BITS) - 1)]
    for k in range(1, ORDER):
        out = out * _PERMUTED[k][codes >> BITS * k & ((1 << BITS) - 1)]
    return out.astype(np.float32)


def prototypes(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and their prototypes, from all documents that have a language."""
    held = counted(docs.where(F.col(lang).isNotNull()), ORDER, text, lang, LETTERS).toPandas()
    names = sorted(held["lang"].unique())
    out = np.zeros((len(names), DIMENSIONS))
    for k, name in enumerate(names):
        mine = held[held["lang"] == name]
        code, n = mine["code"].to_numpy(), mine["n"].to_numpy(np.float64)
        for i in range(0, len(code), 4096):
            out[k] += n[i : i + 4096] @ bound(code[i : i + 4096])
    return names, out


def cosines(data: np.ndarray, offs: np.ndarray, prototypes: np.ndarray, own: np.ndarray) -> np.ndarray:
    """[row, language] cosines of texts with prototypes; 0 for an empty text.

    ``own``: the language of which the prototype has the text in it, or -1.
    """
    n = len(offs) - 1
    code = gram_codes(data, offs, ORDER, LETTERS)
    row = np.repeat(np.arange(n), np.diff(offs))
    seen = np.bincount(code, minlength=1)
    codes = np.flatnonzero(seen)
    column = np.zeros(len(seen), np.int64)
    column[codes] = np.arange(len(codes))
    out, length = np.zeros((n, len(prototypes))), (prototypes**2).sum(1)
    if not len(codes):
        return out
    vectors, place = bound(codes), row * len(codes) + column[code]
    step = max(1, 8_000_000 // len(codes))
    for i in range(0, n, step):
        j = min(n, i + step)
        part = place[offs[i] : offs[j]] - i * len(codes)
        text = np.bincount(part, minlength=(j - i) * len(codes)).reshape(j - i, len(codes)).astype(np.float32) @ vectors
        square = (text.astype(np.float64) ** 2).sum(1)
        dot, norm = text.astype(np.float64) @ prototypes.T, np.repeat(length[None], j - i, 0)
        mine = np.flatnonzero(own[i:j] >= 0)
        at = own[i:j][mine]
        norm[mine, at] -= 2 * dot[mine, at] - square[mine]
        dot[mine, at] -= square[mine]
        size = np.sqrt(np.maximum(norm, 0) * square[:, None])
        out[i:j] = np.where(size > 0, dot / np.where(size > 0, size, 1), 0)
    return out


def _classify(shared):
    def run(text: pa.Array, lang: pa.Array) -> pa.Array:
        names, bundles = shared.value
        place = {name: k for k, name in enumerate(names)}
        own = np.array([place.get(x, -1) for x in lang.to_pylist()], np.int64)
        found, best, margin = [None] * len(text), np.full(len(text), np.nan), np.full(len(text), np.nan)
        for i, j, data, offs in pieces(text):
            c = np.round(cosines(data, offs, bundles, own[i:j]), 5)
            if not len(names):
                continue
            top = c.argmax(1)
            order = np.sort(c, 1)
            for r in np.flatnonzero(np.diff(offs)):
                found[i + r] = names[top[r]]
                best[i + r] = order[r, -1]
                margin[i + r] = order[r, -1] - (order[r, -2] if len(names) > 1 else 0)
        return pa.StructArray.from_arrays([pa.array(found, pa.string()), pa.array(best, from_pandas=True), pa.array(np.round(margin, 5), from_pandas=True)], names=["lang", "cosine", "margin"])

    return F.arrow_udf(run, "lang string, cosine double, margin double")


def identified(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` with ``predicted``, ``cosine`` and ``margin`` to the second language.

    Prototypes come from all rows whose ``lang`` isn't null; all rows are
    classified, by prototypes without themselves (repeated rows are in them for
    each other).  Null and empty texts have null in all three; of equal cosines
    the first language by name wins.  Without any prototype, and so for an empty
    table, nothing is predicted.  Columns of these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(prototypes(docs, text, lang))
    (found,) = fresh(docs, "found")
    out = docs.withColumn(found, _classify(shared)(F.col(text), F.col(lang).cast("string")))
    cols = [docs[c] for c in docs.columns if c.lower() not in ("predicted", "cosine", "margin")]
    return out.select(*cols, F.col(found)["lang"].alias("predicted"), F.col(found)["cosine"].alias("cosine"), F.col(found)["margin"].alias("margin"))
