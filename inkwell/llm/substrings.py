"""Repeated passages by level-wise doubling.

Windows of ``MIN_WORDS`` words that occur twice are the first survivors.  Only
where two survivors of one length adjoin can a window of twice the length be
repeated; those are the candidates of the next level, until none survive.

The first level counts no window that can't be repeated: every repeated window
holds a repeated anchor, the smallest hash of the half-length windows in it, so
only windows around repeated anchors are candidates.  Documents of the same
words are taken as one, which is repeated as a whole.

Windows that one batch of rows has several times are known to be repeated: of
these one is counted along with other batches' windows, and the others spread
over the cluster, so that a passage that a third of all documents have is no
burden to one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._lex import GRAM, fresh, mix, pieces, words
from ._store import numbered, written

MIN_WORDS = 50
_U = np.uint64
_ROWS = "hash long, row long, at int, salt short"


def _counted_once(h: np.ndarray, row: pa.Array, at: np.ndarray) -> pa.RecordBatch:
    """Windows with what a batch knows of them: of those it has twice the first have a negative place and the others a salt."""
    order = np.argsort(h, kind="stable")
    new = np.r_[True, h[order][1:] != h[order][:-1]][: len(h)]
    group = np.cumsum(new) - 1
    several = (np.bincount(group) > 1)[group] if len(h) else new
    salt = np.zeros(len(h), np.int16)
    salt[order] = np.where(new, 0, 1 + np.arange(len(h)) % 1024)
    at = at.astype(np.int32)
    first = order[new & several]
    at[first] = ~at[first]
    return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), row, pa.array(at), pa.array(salt)], names=["hash", "row", "at", "salt"])


def _windows(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of n words within rows, by doubling, and their first words."""
    out, at, width, bit = None, 0, 1, mix(h + GRAM[33])
    length = n
    while length:
        if length & 1:
            part = bit[at:] if out is None else bit[at : at + len(out)]
            if out is None:
                out, at = part.copy(), width
            else:
                m = min(len(out), max(0, len(bit) - at))
                out = mix(out[:m] * GRAM[34] + bit[at : at + m])
                at += width
        length >>= 1
        if length:
            m = max(0, len(bit) - width)
            bit = mix(bit[:m] * GRAM[35] + bit[width : width + m])
            width *= 2
    m = max(0, len(h) - n + 1)
    first = np.flatnonzero(row[:m] == row[n - 1 : n - 1 + m])
    return out[first] if m else np.zeros(0, np.uint64), first


def _minima(h: np.ndarray, row: np.ndarray, width: int) -> np.ndarray:
    """Indices of the smallest (of equal ones the last) of every ``width`` successive hashes of a row."""
    m = len(h) - width + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    low, at, span = h.copy(), np.arange(len(h)), 1

    def least(a, b, i, j):
        take = b <= a
        return np.where(take, b, a), np.where(take, j, i)

    while span * 2 <= width:
        low, at = least(low[: len(low) - span], low[span:], at[: len(at) - span], at[span:])
        span *= 2
    rest = width - span
    low, at = least(low[: len(low) - rest], low[rest:], at[: len(at) - rest], at[rest:]) if rest else (low, at)
    return np.unique(at[:m][row[:m] == row[width - 1 : width - 1 + m]])


def _lists(values: np.ndarray, size: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.array(values))


def _anchors(n: int):
    half = n // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offs in pieces(b.column(2)):
                h, at = words(data, offs)
                size = np.bincount(at, minlength=j - i)
                starts = np.cumsum(size) - size
                long = np.flatnonzero(size >= n)
                if not len(long):
                    continue
                place = (np.arange(len(h)) - starts[at]).astype(np.uint64)
                one, two = (np.add.reduceat(mix(h * GRAM[q] + mix(place + GRAM[q + 1])), starts[size > 0]) for q in (36, 38))
                full = np.cumsum(size > 0) - 1
                g, first = _windows(h, at, half)
                chosen = _minima(g, at[first], n - half + 1)
                where = first[chosen]
                m = np.bincount(at[where], minlength=j - i)
                cols = [b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(one[full].view(np.int64)), pa.array(two[full].view(np.int64)), pa.array(size), _lists(g[chosen].view(np.int64), m), _lists(place[where].astype(np.int32), m)]
                yield pa.RecordBatch.from_arrays([c.take(pa.array(long)) for c in cols], names=["row", "doc_id", "one", "two", "n", "anchors", "places"])

    return run


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each of the rows' anchors."""
    for b in batches:
        owner = np.repeat(np.arange(b.num_rows), b.column(1).value_lengths().to_numpy(zero_copy_only=False))
        yield _counted_once(b.column(1).flatten().to_numpy().view(np.uint64), b.column(0).take(pa.array(owner)), b.column(2).flatten().to_numpy())


def _candidates(n: int):
    half = n // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes, rows, ats = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, j, data, offs in pieces(b.column(1)):
                h, at = words(data, offs)
                size = np.bincount(at, minlength=j - i)
                starts = np.cumsum(size) - size
                places = b.column(2).slice(i, j - i)
                owner = np.repeat(np.arange(j - i), places.value_lengths().to_numpy(zero_copy_only=False))
                a = places.flatten().to_numpy() + starts[owner]
                mark = np.zeros(len(h) + 1, np.int64)  # windows that hold the anchor
                np.add.at(mark, np.maximum(a - (n - half), starts[owner]), 1)
                np.add.at(mark, a + 1, -1)
                g, first = _windows(h, at, n)
                mine = np.cumsum(mark)[first] > 0
                first = first[mine]
                hashes.append(g[mine])
                rows.append(at[first] + i)
                ats.append(first - starts[at[first]])
            yield _counted_once(np.concatenate(hashes), b.column(0).take(pa.array(np.concatenate(rows))), np.concatenate(ats))

    return run


def _doubled(length: int):
    """Candidates of twice the length from a row's surviving windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column(1).flatten()
            at, h = flat.field(0).to_numpy().astype(np.int64), flat.field(1).to_numpy().view(np.uint64)
            row = np.repeat(np.arange(b.num_rows), b.column(1).value_lengths().to_numpy(zero_copy_only=False))
            key = row << 32 | at
            order = np.argsort(key)
            key, at, h, row = key[order], at[order], h[order], row[order]
            other = np.searchsorted(key, key + length)
            ok = np.flatnonzero(other < len(key))
            ok = ok[key[other[ok]] == key[ok] + length]
            new = mix(h[ok] * GRAM[34] + h[other[ok]])
            yield _counted_once(new, b.column(0).take(pa.array(row[ok])), at[ok])

    return run


def _merged(n: int):
    """Covered passages of each row, and the longest level that survived in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, starts, sizes, longest = [], [], [], []
            for row, windows in zip(b.column(0).to_pylist(), b.column(1)):
                flat = windows.values
                at, length = flat.field(0).to_numpy(), flat.field(1).to_numpy()
                base = np.sort(at[length == n])
                cut = np.flatnonzero(np.r_[True, np.diff(base) > n])
                begin, last = base[cut], base[np.r_[cut[1:], len(base)] - 1]
                most = np.zeros(len(begin), np.int64)
                np.maximum.at(most, np.searchsorted(begin, at, "right") - 1, length)
                rows += [row] * len(begin)
                starts.append(begin)
                sizes.append(last + n - begin)
                longest.append(most)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(np.concatenate(starts).astype(np.int64)), pa.array(np.concatenate(sizes).astype(np.int64)), pa.array(np.concatenate(longest))], names=["row", "start_word", "n_words", "longest"])

    return run


def repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, start_word, n_words, longest): passages that ``docs`` have more than once.

    A passage is a maximal run of words covered by windows of ``min_words`` words
    that occur at least twice in the corpus, in one document or in several,
    whatever the case and punctuation.  ``longest`` is the length, ``min_words``
    times a power of two, of the longest window of it that occurs twice.  Null
    and empty texts and those of fewer words have no passages.  Repeated rows
    have their passages each.  ``doc_id`` is a number, or text that holds one.
    An empty table gives an empty result.  Windows are compared by 64-bit hashes.
    """
    (row,) = fresh(docs, "row")
    rows = numbered(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), row).select(row, "doc_id", "text")
    read = written(rows.mapInArrow(_anchors(min_words), "row long, doc_id long, one long, two long, n long, anchors array<long>, places array<int>"), "anchors")
    same = written(read.groupBy("one", "two").agg(F.min("row").alias("row"), F.count("*").alias("copies")), "same")
    once = read.join(same.select("row"), "row", "left_semi")
    anchors = _repeated(once.select("row", "anchors", "places").mapInArrow(_spread, _ROWS)).groupBy("row").agg(F.collect_list("at").alias("places")).withColumnRenamed("row", row)
    found = rows.select(row, "text").join(anchors, row).mapInArrow(_candidates(min_words), _ROWS)
    length, levels = min_words, None
    while True:
        alive = written(_repeated(found), "windows")
        if alive.isEmpty():
            break
        level = alive.select("row", "at", F.lit(length).cast("long").alias("length"))
        if levels is not None:  # of a longer length, the ends of each run will do
            w = W.partitionBy("row").orderBy("at")
            level = level.withColumn("before", F.lag("at").over(w)).where("before is null or before < at - 1").drop("before")
        levels = level if levels is None else levels.unionByName(level)
        found = alive.groupBy("row").agg(F.collect_list(F.struct("at", "hash")).alias("w")).mapInArrow(_doubled(length), _ROWS)
        length *= 2
    whole = read.join(same.where("copies > 1").select("one", "two"), ["one", "two"], "left_semi")
    doublings = F.length(F.bin(F.floor(F.col("n") / min_words))) - 1
    out = whole.select("doc_id", F.lit(0).cast("long").alias("start_word"), F.col("n").alias("n_words"), (F.lit(min_words) * F.pow(F.lit(2), doublings)).cast("long").alias("longest"))
    if levels is None:
        return out
    spans = levels.groupBy("row").agg(F.collect_list(F.struct("at", "length")).alias("w")).mapInArrow(_merged(min_words), "row long, start_word long, n_words long, longest long")
    single = read.join(same.where("copies = 1").select("row"), "row", "left_semi").select("row", "doc_id")
    return out.unionByName(spans.join(single, "row").select("doc_id", "start_word", "n_words", "longest"))


def _repeated(windows: DataFrame) -> DataFrame:
    """Those that occur twice, of rows of ``_counted_once``: one exchange, which spills."""
    n = F.count("*").over(W.partitionBy("hash", "salt"))
    return windows.withColumn("n", n).where("n > 1 or salt > 0 or at < 0").select("hash", "row", F.when(F.col("at") < 0, F.bitwise_not("at")).otherwise(F.col("at")).alias("at"))
