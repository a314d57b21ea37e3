"""Benchmark decontamination: MinHash containment search partitioned by size.

Every test item keeps the smallest hashes of its shingles as a MinHash sketch.
Items are partitioned by the size of their shingle set, by powers of two; each
partition has its sketch size.  From it and an item's own size come the least
number of sketch hashes that a document must hold, so that containment at the
threshold is missed with a probability under ``MISS`` whatever the size and
whichever other items there are, and the least document size.  Documents probe the
sketches once, whatever their length; candidates are verified by exact shingle
containment from the same scan, so no document is shuffled.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._lex import HashArray, grams, pieces, words
from ._store import written

SHINGLE = 5
THRESHOLD = 0.5
MINIMA = 24
MISS = 1e-3
#: Bytes of items that are searched for in one scan; more take more scans.
ITEM_BYTES = 64 << 20


@functools.cache
def _hits_needed(size: int, sketch: int, threshold: float) -> int:
    """Most hits to ask for: fewer have probability under MISS at the threshold (hypergeometric)."""
    shared = int(np.ceil(threshold * size - 1e-9))
    total, p = comb(size, sketch), 0.0
    for r in range(sketch + 1):
        p += comb(shared, r) * comb(size - shared, sketch - r) / total
        if p >= MISS:
            return max(1, r)
    return max(1, sketch)


class Items:
    """Sketches and shingle sets of test items, by shingle length."""

    def __init__(self, texts: pa.Array, n: int = SHINGLE, minima: int = MINIMA, threshold: float = THRESHOLD):
        self.threshold = threshold
        sets: dict[int, list[tuple[int, np.ndarray]]] = {}
        for i, j, data, offs in pieces(texts):
            h, row = words(data, offs)
            size = np.bincount(row, minlength=j - i)
            at = np.cumsum(size) - size
            for k in range(j - i):
                if size[k]:
                    m = min(n, int(size[k]))
                    g = np.unique(grams(h[at[k] : at[k] + size[k]], np.zeros(size[k], np.int64), m)[0])
                    sets.setdefault(m, []).append((i + k, g))
        self.count = len(texts)
        self.sizes = np.zeros(self.count, np.int64)
        self.needed = np.ones(self.count, np.int64)
        self.tables = {}
        for m, found in sets.items():
            sketch = []
            for i, g in found:
                self.sizes[i] = len(g)
                s = min(minima, 1 << int(len(g)).bit_length() - 1)  # of a partition the same: its least size
                self.needed[i] = _hits_needed(len(g), s, threshold)
                sketch.append((i, g[:s]))  # sorted, so these are the minima
            self.tables[m] = (self._table(sketch), self._table(found))

    @staticmethod
    def _table(sets: list[tuple[int, np.ndarray]]) -> tuple[HashArray, np.ndarray]:
        """Hash array of the shingles, with each one's first and last+1 place in a list of items."""
        g = np.concatenate([x for _, x in sets])
        i = np.repeat([k for k, _ in sets], [len(x) for _, x in sets])
        order = np.argsort(g, kind="stable")
        g, i = g[order], i[order]
        cut = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        return HashArray(g[cut], cut, np.r_[cut[1:], len(g)]), i

    @staticmethod
    def _counts(table, g: np.ndarray, row: np.ndarray, items: int) -> tuple[np.ndarray, np.ndarray]:
        """(row * items + item, how many of the item's distinct shingles the row has)."""
        array, owners = table
        at = array.find(g)
        hit = at >= 0
        if not hit.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pair = np.unique(row[hit] * len(array.keys) + at[hit])
        row, at = pair // len(array.keys), pair % len(array.keys)
        first, last = array.values[0][at], array.values[1][at]
        n = last - first
        owner = owners[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        return np.unique(np.repeat(row, n) * items + owner, return_counts=True)

    def search(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, item, shared shingles) of the rows that hold items."""
        h, row = words(data, offs)
        out = [(np.zeros(0, np.int64),) * 2]
        for m, (sketch, full) in self.tables.items():
            g, first = grams(h, row, m)
            at = row[first]
            key, hits = self._counts(sketch, g, at, self.count)
            item = key % self.count
            enough = np.bincount(at, minlength=len(offs))[key // self.count] >= self.threshold * self.sizes[item]
            key = key[(hits >= self.needed[item]) & enough]
            if not len(key):
                continue
            mine = np.isin(at, key // self.count)
            every, shared = self._counts(full, g[mine], at[mine], self.count)
            exact = np.isin(every, key) & (shared >= self.threshold * self.sizes[every % self.count] - 1e-9)
            out.append((every[exact], shared[exact]))
        key, shared = (np.concatenate(x) for x in zip(*out))
        order = np.argsort(key)
        return key[order] // max(1, self.count), key[order] % max(1, self.count), shared[order]


def _slices(items: DataFrame, item_id: str, text: str) -> tuple[int, Iterator[pa.Table]]:
    """The items in pieces of at most about ITEM_BYTES, each to be held by every worker, and how many."""
    rows = items.select(F.col(item_id).cast("long").alias("item"), F.col(text).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // ITEM_BYTES) or 1
    part = F.pmod(F.xxhash64("item", "text"), F.lit(n))
    return n, (rows.where(part == k).toArrow() for k in range(n))


def contained(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, shared, containment) of every document that holds a test item.

    Containment is the share of the item's distinct ``n``-word shingles that the
    document has; an item of fewer words is one shingle.  Null, empty and
    wordless texts hold nothing and are held by nothing.  Repeated rows, of
    either table, each give their own pairs.  An empty table gives no pairs.
    """
    spark, found = docs.sparkSession, None
    several, tables = _slices(items, item_id, item_text)
    for table in tables:
        shared = spark.sparkContext.broadcast((Items(table.column("text").combine_chunks(), n, MINIMA, threshold), table.column("item").to_numpy(zero_copy_only=False) if not table.column("item").null_count else np.array(table.column("item").to_pylist(), object)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index, ids = shared.value
            for b in batches:
                for i, _, data, offs in pieces(b.column(1)):
                    row, item, count = index.search(data, offs)
                    if len(row):
                        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row + i)), pa.array(ids[item], pa.int64()), pa.array(count), pa.array(count / index.sizes[item])], names=["doc_id", "item_id", "shared", "containment"])

        part = docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(run, "doc_id long, item_id long, shared long, containment double")
        if several > 1:  # no more than one slice is held at a time
            part = written(part, "contained")
            shared.destroy()
        found = part if found is None else found.unionByName(part)
    return found


def decontaminated(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that hold no test item (see ``contained``), with the columns of ``docs``.

    Documents with null, empty and wordless texts stay, and so do all without any
    item; repeated rows stay or go together; an empty table gives an empty result.
    """
    several, tables = _slices(items, item_id, item_text)
    for table in tables:
        shared = docs.sparkSession.sparkContext.broadcast(Items(table.column("text").combine_chunks(), n, MINIMA, threshold))
        docs = docs.where(_clean(shared)(F.col(text)))
        if several > 1:
            docs = written(docs, "clean")
            shared.destroy()
    return docs


def _clean(shared):
    def clean(texts: pa.Array) -> pa.Array:
        out = np.ones(len(texts), bool)
        for i, _, data, offs in pieces(texts):
            out[i + shared.value.search(data, offs)[0]] = False
        return pa.array(out)

    return F.arrow_udf(clean, "boolean")


#: The exact answer in SQL, for the production parameters.
SQL = f"""
WITH low AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents
), item AS (
  SELECT item_id, row_number() OVER () AS r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM benchmark
), item_shingle AS (
  SELECT DISTINCT r, item_id, least({SHINGLE}, len(w)) AS m, array_to_string(list_slice(w, i, i + least({SHINGLE}, len(w)) - 1), ' ') AS g
  FROM (SELECT r, item_id, w, unnest(generate_series(1, len(w) - least({SHINGLE}, len(w)) + 1)) AS i FROM item WHERE len(w) > 0)
), size AS (
  SELECT r, count(*) AS n FROM item_shingle GROUP BY r
), doc AS (
  SELECT row_number() OVER () AS d, doc_id, w FROM low
), doc_shingle AS (
  SELECT DISTINCT d, doc_id, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS g
  FROM (SELECT d, doc_id, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM doc, (SELECT DISTINCT m FROM item_shingle) WHERE len(w) >= m)
), shared AS (
  SELECT d, doc_id, r, item_id, count(*) AS shared FROM doc_shingle JOIN item_shingle USING (m, g) GROUP BY d, doc_id, r, item_id
)
SELECT doc_id, item_id, shared, shared::double / n AS containment FROM shared JOIN size USING (r) WHERE shared >= {THRESHOLD}::double * n - 1e-9
"""
