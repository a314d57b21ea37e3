"""Line dedup by hashes of runs of lines.

Every run of ``k`` lines is hashed and joined with its earliest occurrence; the
lines of each later one are deleted.  A longer repeated run is one whose runs of
``k`` lines all occur earlier, wherever each of them does, so that no match has
to be extended and none is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._lex import fresh, grams, pieces, run_hashes, spans
from ._store import numbered, written

K = 1
_LINE = np.ones(256, bool)
_LINE[10] = False


def _lists(values: np.ndarray, size: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.array(values, kind))


def _read(docs: DataFrame, row: str, doc_id: str, text: str, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offs in pieces(b.column(2)):
                start, end, at, mask = spans(data, offs, _LINE)
                h = run_hashes(data, start, end, mask, fold=False)
                g, first = grams(h, at, k)
                place = np.arange(len(h)) - np.searchsorted(at, at)
                m = np.bincount(at[first], minlength=j - i)
                has = np.flatnonzero(m > 0)
                keep = pa.array(has)
                cols = [b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), _lists(g.view(np.int64), m, pa.int64()), _lists(place[first].astype(np.int32), m, pa.int32())]
                yield pa.RecordBatch.from_arrays([c.take(keep) for c in cols], names=["row", "doc", "prints", "places"])

    return docs.select(row, F.col(doc_id).cast("long"), text).mapInArrow(run, "row long, doc long, prints array<long>, places array<int>")


def _without(text: pa.Array, gone: pa.Array) -> pa.Array:
    out = []
    for t, g in zip(text.to_pylist(), gone.to_pylist()):
        if t is None or not g:
            out.append(t)
            continue
        drop, n, kept = set(g), 0, []
        for line in t.split("\n"):
            if line:
                n += 1
                if n - 1 in drop:
                    continue
            kept.append(line)
        out.append("\n".join(kept))
    return pa.array(out, pa.string())


def line_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K, removed: str | None = None) -> DataFrame:
    """``docs`` with later repeated runs of lines deleted from ``text``.

    ``doc_id`` is a number, or text that holds one.  Lines are separated by a line feed and compared as they are; empty lines
    don't count and stay.  Documents come in the order of ``doc_id`` (nulls
    last), equal ones in the order of the rows read, so of repeated rows the
    first keeps its lines.  A run may also repeat an earlier part of its own
    document.  Documents of under ``k`` lines, null and empty texts stay as they
    are; a text of which all lines go is empty.  Every line of every run of ``k``
    or more lines that occurs earlier is deleted: with ``k`` 1 every line seen
    before, however short.  ``removed`` names a column for the number of deleted lines.
    """
    row, gone, key = fresh(docs, "row", "gone", "key")
    rows = numbered(docs, row)
    read = written(_read(rows, row, doc_id, text, k), "lines")
    place = F.struct(F.col("doc").isNull().alias("none"), "doc", "row", "at")
    seen = read.select("row", "doc", F.explode(F.arrays_zip("prints", "places")).alias("p")).select(F.col("p.prints").alias("print"), "row", "doc", F.col("p.places").alias("at"))
    first = seen.groupBy("print").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("print", "first")
    later = seen.join(first, "print").where((F.col("row") != F.col("first.row")) | (F.col("at") != F.col("first.at")))
    lines = later.select("row", F.explode(F.sequence("at", F.col("at") + F.lit(k - 1))).alias("line"))
    cut = lines.groupBy("row").agg(F.collect_set("line").alias(gone)).withColumnRenamed("row", key)
    out = rows.join(cut, F.col(row) == F.col(key), "left")
    cleaned = F.when(F.col(gone).isNull(), F.col(text)).otherwise(F.arrow_udf(_without, "string")(F.when(F.col(gone).isNotNull(), F.col(text)), F.col(gone)))
    cols = [cleaned.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    if removed:
        cols = [c for c, name in zip(cols, docs.columns) if name != removed] + [F.coalesce(F.size(gone), F.lit(0)).alias(removed)]
    return out.select(*cols)


def line_dedup_brute(rows: list[tuple], k: int = K, h=None) -> list[tuple]:
    """The same over (doc_id, text) rows in the order read, without Spark or hashes: (text, deleted lines).

    ``h`` isn't used: each run is compared with all earlier ones.
    """
    texts = [t for _, t in rows]
    split = [[x for x in (t or "").split("\n") if x] for t in texts]
    gone: list[set] = [set() for _ in rows]
    before: list[list[str]] = []
    for r in sorted(range(len(rows)), key=lambda r: (rows[r][0] is None, rows[r][0] or 0, r)):
        ls = split[r]
        for i in range(len(ls) - k + 1):
            run = ls[i : i + k]
            if run in before:
                gone[r] |= set(range(i, i + k))
            before.append(run)
    out = []
    for t, g in zip(texts, gone):
        if t is None:
            out.append((None, 0))
            continue
        n, kept = -1, []
        for line in t.split("\n"):
            n += bool(line)
            if not (line and n in g):
                kept.append(line)
        out.append(("\n".join(kept), len(g)))
    return out
