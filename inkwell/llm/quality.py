"""Quality rules: character n-gram perplexity under a modified Kneser-Ney model.

Spark counts the n-grams of every document per language and estimates their
probabilities by aggregations and joins of these counts, one order after the
other.  As every n-gram of the corpus is in the model, a document's perplexity
is a sum over the highest order alone, which workers look up in sorted hash
arrays.  A model of more than ``SLICE_ROWS`` n-grams is searched a slice at a
time, each in a scan of its own, so that neither the driver nor a worker ever
holds more.  Lower and upper bands by language and length, over all documents'
perplexities, decide which documents are rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._lex import HashArray, fresh, pieces
from ._store import numbered, written

ORDER = 5
BITS = 7
SYMBOLS = 1 << BITS
#: Bands: so many robust standard deviations below and above the median.
LOW, HIGH = 3.5, 3.5
#: Log-perplexities are compared in steps of this size.
STEP = 0.002
#: N-grams of all languages that the driver and each worker hold at a time.
SLICE_ROWS = 16_000_000
#: Documents of like length that a language's bands are taken from, if it has so many.
ENOUGH = 500
#: Distinct n-grams of several pieces that a worker holds before it merges them, beside as many as are merged.
UNMERGED = 500_000

#: 128 symbol classes: ASCII as it is (digits alike, control characters as
#: space), bytes of other characters folded into 31 classes; 0 is the padding.
CLASS = np.arange(256, dtype=np.int64)
CLASS[:33] = 32
CLASS[127] = 32
CLASS[48:58] = 48
CLASS[128:] = 1 + (np.arange(128, 256) * 37 >> 2) % 31


def gram_codes(data: np.ndarray, offs: np.ndarray, order: int, symbols: np.ndarray = CLASS) -> np.ndarray:
    """The n-gram ending at each byte, as a packed integer; rows start with padding."""
    s = symbols[data]
    code = s.copy()
    start = np.repeat(offs[:-1], np.diff(offs))
    place = np.arange(len(s)) - start
    for k in range(1, order):
        code[k:] |= np.where(place[k:] >= k, s[:-k], 0) << (BITS * k)
    return code


def counted(docs: DataFrame, order: int = ORDER, text: str = "text", lang: str = "lang", symbols: np.ndarray = CLASS) -> DataFrame:
    """(lang, code, n): n-gram counts over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def fold(key) -> None:
            code = np.concatenate([c for c, _ in held[key]])
            n = np.concatenate([m for _, m in held[key]])
            u, inv = np.unique(code, return_inverse=True)
            held[key] = [(u, np.bincount(inv, n, len(u)).astype(np.int64))]

        for b in batches:
            langs = b.column(0).to_pylist()
            for i, j, data, offs in pieces(b.column(1)):
                code = gram_codes(data, offs, order, symbols)
                tags = langs[i:j]
                size = np.diff(offs)
                for key in set(tags):
                    mine = np.fromiter((t == key for t in tags), bool, len(tags))
                    part = np.sort(code[np.repeat(mine, size)] if not mine.all() else code)
                    if not len(part):
                        continue
                    cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
                    held.setdefault(key, []).append((part[cut], np.diff(np.r_[cut, len(part)])))
                    if sum(len(c) for c, _ in held[key][1:]) > max(UNMERGED, len(held[key][0][0])):
                        fold(key)
        for key in held:
            fold(key)
            code, n = held[key][0]
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(code), pa.string()), pa.array(code), pa.array(n)], names=["lang", "code", "n"])

    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    return rows.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def _discounts(n: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 1, 2 and above."""
    n1, n2, n3, n4 = (float((n == k).sum()) for k in (1, 2, 3, 4))
    if not (n1 and n2):
        return np.array([0.0, 0.5, 0.5, 0.5])
    y = n1 / (n1 + 2 * n2)
    d3 = 3 - 4 * y * n4 / n3 if n3 else 1.5
    return np.array([0.0, np.clip(1 - 2 * y * n2 / n1, 0.05, 0.95), np.clip(2 - 3 * y * n3 / n2, 0.05, 1.95), np.clip(d3, 0.05, 2.95)])


class KneserNey:
    """Interpolated modified Kneser-Ney over packed symbols, one hash array per order.

    With ``base``, a model of lower order, its orders are taken over from it.
    """

    def __init__(self, code: np.ndarray, n: np.ndarray, order: int = ORDER, bits: int = BITS, base: KneserNey | None = None):
        self.order, self.bits = order, bits
        tables = [(code, n)]
        for m in range(order - 1, 0, -1):  # continuation counts: distinct left neighbours
            tables.append(np.unique(tables[-1][0] & ((1 << bits * m) - 1), return_counts=True))
        tables.reverse()
        self.grams, self.contexts = [], []
        below: tuple | None = None
        for m, (codes, c) in enumerate(tables, 1):
            if base is not None and m <= base.order:
                self.grams.append(base.grams[m - 1])
                self.contexts.append(base.contexts[m - 1])
                below = (codes, np.exp(base.logp(codes).astype(np.float64))) if m == base.order else None
                continue
            d = _discounts(c)
            ctx, inv = np.unique(codes >> bits, return_inverse=True)
            total = np.bincount(inv, c, len(ctx))
            cut = d[np.minimum(c, 3)]
            gamma = np.bincount(inv, cut, len(ctx)) / total
            if below is None:
                rest = np.full(len(codes), 1.0 / (1 << bits))
            else:
                rest = below[1][np.searchsorted(below[0], codes & ((1 << bits * (m - 1)) - 1))]
            p = (c - cut) / total[inv] + gamma[inv] * rest
            below = (codes, p)
            self.grams.append(HashArray(codes, np.log(p).astype(np.float32)))
            self.contexts.append(HashArray(ctx, np.log(np.maximum(gamma, 1e-12)).astype(np.float32)))

    def logp(self, code: np.ndarray) -> np.ndarray:
        """Log-probability of each n-gram's last symbol given the rest."""
        out = np.zeros(len(code), np.float32)
        at = np.arange(len(code))
        for m in range(self.order, 0, -1):
            part = code & ((1 << self.bits * m) - 1)
            i = self.grams[m - 1].find(part)
            hit = i >= 0
            if hit.all():
                out[at] += self.grams[m - 1].values[0][i]
                return out
            out[at[hit]] += self.grams[m - 1].values[0][i[hit]]
            at, part, code = at[~hit], part[~hit], code[~hit]
            i = self.contexts[m - 1].find(part >> self.bits)
            out[at] += np.where(i >= 0, self.contexts[m - 1].values[0][i], 0)
        out[at] -= np.float32(self.bits * np.log(2))
        return out


def _discounted(table: DataFrame) -> DataFrame:
    """(lang, code, n) with what modified Kneser-Ney takes from each count, as ``cut``."""
    many = [F.count_if(F.col("n") == k).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)]
    n1, n2, n3, n4 = (F.col(f"n{k}") for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2)
    clip = lambda x, high: F.least(F.greatest(x, F.lit(0.05)), F.lit(high))
    third = clip(F.when(n3 > 0, 3 - 4 * y * n4 / F.nullif(n3, F.lit(0.0))).otherwise(1.5), 2.95)
    each = table.groupBy("lang").agg(*many).select("lang", *[F.when((n1 > 0) & (n2 > 0), d).otherwise(0.5).alias(f"d{k}") for k, d in ((1, clip(1 - 2 * y * n2 / F.nullif(n1, F.lit(0.0)), 0.95)), (2, clip(2 - 3 * y * n3 / F.nullif(n2, F.lit(0.0)), 1.95)), (3, third))])
    cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    return table.join(each, "lang").select("lang", "code", "n", cut.alias("cut"))


def estimated(counts: DataFrame, order: int = ORDER, bits: int = BITS) -> DataFrame:
    """(lang, code, p): interpolated modified Kneser-Ney probabilities of the (lang, code, n) n-grams.

    As ``KneserNey`` computes them; here no machine holds all of them.
    """
    tables = [written(counts, "counts")]
    for m in range(order - 1, 0, -1):  # continuation counts: distinct left neighbours
        below = tables[-1].groupBy("lang", F.col("code").bitwiseAND(F.lit((1 << bits * m) - 1)).alias("code")).agg(F.count("*").alias("n"))
        tables.append(written(below, "continuations"))
    p = None
    for m, table in enumerate(reversed(tables), 1):
        context = W.partitionBy("lang", F.shiftright("code", bits))
        rows = _discounted(table).withColumns({"total": F.sum("n").over(context), "gamma": F.sum("cut").over(context) / F.sum("n").over(context)})
        if p is None:
            rows = rows.withColumn("rest", F.lit(1.0 / (1 << bits)))
        else:
            suffix = p.select("lang", F.col("code").alias("suffix"), F.col("p").alias("rest"))
            rows = rows.withColumn("suffix", F.col("code").bitwiseAND(F.lit((1 << bits * (m - 1)) - 1))).join(suffix, ["lang", "suffix"])
        p = written(rows.select("lang", "code", ((F.col("n") - F.col("cut")) / F.col("total") + F.col("gamma") * F.col("rest")).alias("p")), "probabilities")
    return p


def _slices(model: DataFrame, most: int) -> Iterator[dict]:
    """The model's hash arrays by language, a part of at most about ``most`` n-grams at a time."""
    names = sorted(r[0] for r in model.select("lang").distinct().collect())
    n = -(-model.count() // most)
    if not n:
        return
    number = F.element_at(F.create_map(*[F.lit(x) for k, name in enumerate(names) for x in (name, k)]), F.col("lang"))
    rows = model.select(number.alias("k"), "code", F.log("p").cast("float").alias("logp"))
    for at in range(n):
        held = (rows if n == 1 else rows.where(F.pmod(F.xxhash64("code"), F.lit(n)) == at)).toArrow()
        k, code, logp = (held.column(c).to_numpy() for c in ("k", "code", "logp"))
        del held
        yield {names[i]: HashArray(code[mine], logp[mine]) for i in range(len(names)) if (mine := k == i).any()}


def _log_likelihood(shared, order: int):
    """Column function (lang, text) -> the sum of log-probabilities of a text's bytes that the shared slice has."""

    @F.arrow_udf("double")
    def score(lang: pa.Array, text: pa.Array) -> pa.Array:
        models, langs = shared.value, lang.to_pylist()
        out = np.zeros(len(langs))
        for i, j, data, offs in pieces(text):
            size = np.diff(offs)
            if not len(data):
                continue
            code, tags = gram_codes(data, offs, order), langs[i:j]
            lp = np.zeros(len(code))
            for key in set(tags) & set(models):
                mine = np.repeat(np.fromiter((t == key for t in tags), bool, len(tags)), size)
                at = models[key].find(code if mine.all() else code[mine])
                lp[mine] = np.where(at >= 0, models[key].values[0][at], 0)
            at = np.flatnonzero(size > 0)
            out[i:j][at] = np.add.reduceat(lp, offs[:-1][at])
        return pa.array(out)

    return score


def _tag(lang: str):
    """A language as text that is never null."""
    return F.when(F.col(lang).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(lang).cast("string")))


def bands(scored: DataFrame, low: float = LOW, high: float = HIGH, enough: int = ENOUGH) -> DataFrame:
    """(lang, bits, floor, ceiling) from all documents' (lang, size, ppl), exactly to ``STEP``.

    ``bits`` is the length of the size in binary digits.  Perplexities of short
    texts vary more, so that each length has bands of its own; where it has
    fewer than ``enough`` documents, the nearest lengths on both sides count in.
    """
    rows = scored.where("ppl is not null").groupBy("lang", F.length(F.bin("size")).alias("bits"), F.round(F.col("ppl") / STEP).cast("long").alias("s")).agg(F.count("*").alias("n"))
    out = []
    for key, g in rows.toPandas().groupby("lang"):
        g = g.sort_values("s")
        bits, s, n = (g[c].to_numpy() for c in ("bits", "s", "n"))
        for b in sorted(set(bits.tolist())):
            near = abs(bits - b)
            held = next((near <= d for d in range(int(near.max()) + 1) if n[near <= d].sum() >= enough), near >= 0)
            x, upto = s[held] * STEP, np.cumsum(n[held])
            q25, mid, q75 = (float(x[np.searchsorted(upto, q * upto[-1])]) for q in (0.25, 0.5, 0.75))
            out.append((key, b, mid - low * max(mid - q25, STEP) / 0.6745, mid + high * max(q75 - mid, STEP) / 0.6745))
    return scored.sparkSession.createDataFrame(out, "lang string, bits int, floor double, ceiling double")


def judged(docs: DataFrame, text: str = "text", lang: str = "lang", low: float = LOW, high: float = HIGH, order: int = ORDER, most: int = SLICE_ROWS, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``ppl`` (log-perplexity per byte) and ``kept``.

    A null or empty text has a null ``ppl`` and isn't kept.  Documents without a
    language are one language of their own.  Repeated rows are judged alike, and
    so are ties: a perplexity on a band is kept.  Columns of ``docs`` named
    ``ppl`` or ``kept`` are replaced; ``keep`` names those to carry, without it
    all.  A document's own n-grams are in the model.  ``most`` changes the
    number of scans, not the result.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    row, tag, size, ppl, bits, floor, ceiling, part = fresh(docs, "row", "lang", "size", "ppl", "bits", "floor", "ceiling", "part")
    counts = counted(docs.select(_tag(lang).alias("lang"), F.col(text).alias("text")), order)
    model = estimated(counts, order)
    carried = [c for c in docs.columns if c.lower() not in ("ppl", "kept") and (keep is None or c in keep)]
    rows = docs.select(*[docs[c] for c in docs.columns], _tag(lang).alias(tag), F.octet_length(text).alias(size))
    several, parts = model.count() > most, []
    if several:
        rows = numbered(rows, row)
    for held in _slices(model, most):
        shared = spark.sparkContext.broadcast(held)
        del held
        found = rows.withColumn(part, _log_likelihood(shared, order)(F.col(tag), F.col(text)))
        if several:
            parts.append(written(found.select(row, part), "parts"))
            shared.destroy()
    if several:
        total = reduce(DataFrame.unionByName, parts).groupBy(row).agg(F.sum(part).alias(part))
        found = rows.join(total, row)
    elif model.isEmpty():
        found = rows.withColumn(part, F.lit(0.0))
    value = F.when(F.col(size) > 0, -F.col(part) / F.col(size))
    scored = written(found.select(*carried, tag, size, value.alias(ppl)), "scored")
    cut = bands(scored.select(F.col(tag).alias("lang"), F.col(size).alias("size"), F.col(ppl).alias("ppl")), low, high).toDF(tag, bits, floor, ceiling)
    out = scored.withColumn(bits, F.length(F.bin(size))).join(F.broadcast(cut), [tag, bits], "left")  # a row for each language and power of two
    kept = F.coalesce((F.round(F.col(ppl) / STEP) * STEP).between(F.col(floor), F.col(ceiling)), F.lit(False))
    return out.select(*carried, F.col(ppl).alias("ppl"), kept.alias("kept"))


def quality_rules(docs: DataFrame, text: str = "text", lang: str = "lang", **options) -> DataFrame:
    """The documents that ``judged`` keeps, with the columns of ``docs``, whatever their names.

    Null and empty texts go; repeated rows stay or go together; an empty table
    gives an empty result.
    """
    (row,) = fresh(docs, "whole")
    found = judged(docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.struct(*docs.columns).alias(row)), keep=[row], **options)
    return found.where("kept").select(f"{row}.*")
