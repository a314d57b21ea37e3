"""Language-model scoring: stupid backoff over hash-partitioned n-gram tables.

Documents are scored under the bigrams of all other documents.  Runs of whole
documents, the chunks, are exploded into their distinct words and word pairs
with counts.  N-grams go to the partition of their hash, where the counts of all
chunks are summed to that partition's count table and joined to the exploded
n-grams; the counts go back to the chunks.  Each chunk's documents then take
their own occurrences out, back off where none is left, and sum up.

What a chunk has for one partition travels as one row, its sorted hashes as
compressed differences: plain rows of hash, chunk, place and count need 2.6 times
the bytes.  No group holds an n-gram's documents: an n-gram, however common, is
one number in each chunk, a chunk is a bounded number of words, or one document,
and there are as many partitions as the corpus has ``PARTITION_BYTES``.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._lex import GRAM, fresh, pieces, release, words
from ._store import numbered, written

ALPHA = 0.4
#: Words of a chunk, each document counting as one more, and bytes of text for each
#: partition of the count table.  A chunk's row for a partition should hold some
#: n-grams, so that a corpus above a few TB wants larger chunks.
CHUNK, PARTITION_BYTES = 3_000_000, 16 << 20
#: What a word counts that no other document has.
UNSEEN = 0.5
_U = np.uint64


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as byte planes, compressed."""
    parts = [struct.pack("<i", len(arrays))]
    for a in arrays:
        parts += [struct.pack("<ciq", a.dtype.kind.encode(), a.dtype.itemsize, len(a)), a.view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _unpack(body: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(body)
    (n,), at, out = struct.unpack_from("<i", raw), 4, []
    for _ in range(n):
        kind, width, size = struct.unpack_from("<ciq", raw, at)
        at += struct.calcsize("<ciq")
        plane = np.frombuffer(raw, np.uint8, width * size, at).reshape(width, size)
        out.append(np.ascontiguousarray(plane.T).view(kind.decode() + str(width)).reshape(size))
        at += width * size
    return out


def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, list, np.ndarray, np.ndarray]]:
    """(number, ids, words of each, word hashes): whole documents, cut at the same ones whatever the batches."""
    first, ids, sizes, hashes, n = None, [], [], [], 0
    for b in batches:
        for i, j, data, offs in pieces(b.column(2)):
            h, at = words(data, offs)
            size = np.bincount(at, minlength=j - i)
            ends, k = np.cumsum(size), 0
            while k < j - i:
                if first is None:
                    first = b.column(0)[i + k].as_py()
                upto = min(j - i, k + int(np.searchsorted(np.cumsum(size[k:] + 1), most - n)) + 1)
                part = slice(ends[k] - size[k], ends[upto - 1])
                ids += b.column(1).slice(i + k, upto - k).to_pylist()
                sizes.append(size[k:upto])
                hashes.append(h[part].copy())
                n += int(size[k:upto].sum()) + upto - k
                k = upto
                if n >= most:
                    yield first, ids, np.concatenate(sizes), np.concatenate(hashes)
                    first, ids, sizes, hashes, n = None, [], [], [], 0
    if first is not None:
        yield first, ids, np.concatenate(sizes), np.concatenate(hashes)


def _pairs(h: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word pairs within documents, and the places of their second words."""
    first = np.zeros(len(h) + 1, bool)
    first[np.cumsum(size) - size] = True
    at = np.flatnonzero(~first[:-1])
    two = (h[at - 1] * GRAM[30] + h[at]) * GRAM[31]
    two ^= two >> _U(31)
    return two * GRAM[32], at


def _exploded(most: int, buckets: int):
    """A row for each chunk and partition: sorted hashes of words and pairs, and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, _, size, h in _chunks(batches, most):
            key, n = (np.concatenate(x) for x in zip(*[np.unique(x, return_counts=True) for x in (h, _pairs(h, size)[0])]))
            order = np.argsort(key, kind="stable")
            key, n = key[order], n[order].astype(np.uint32)
            bucket = ((key >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)
            cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(key) else np.zeros(0, np.int64)
            for at in range(0, len(cut), 1024):
                part = [(i, j) for i, j in zip(cut[at : at + 1024], np.r_[cut[1:], len(key)][at : at + 1024])]
                bodies = [_pack(np.r_[key[i : i + 1], np.diff(key[i:j])], n[i:j]) for i, j in part]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[cut[at : at + 1024]]), pa.array(np.full(len(part), chunk)), pa.array(bodies, pa.binary())], names=["bucket", "chunk", "body"])
        release()

    return run


def _joined(table: pa.Table) -> pa.Table:
    """One partition's count table, joined to what each chunk exploded: the counts in the order of its hashes."""
    bodies = [_unpack(x) for x in table.column("body").to_pylist()]
    keys = np.concatenate([np.cumsum(k, dtype=np.uint64) for k, _ in bodies])
    _, at = np.unique(keys, return_inverse=True)
    total = np.bincount(at, np.concatenate([n for _, n in bodies]).astype(np.float64)).astype(np.uint64)[at]
    ends = np.cumsum([len(k) for k, _ in bodies])
    back = [_pack(total[j - len(k) : j]) for j, (k, _) in zip(ends, bodies)]
    return pa.Table.from_arrays([table.column("chunk"), table.column("bucket"), pa.array(back, pa.binary())], names=["chunk", "bucket", "totals"])


def _packed(most: int):
    """A row for each chunk: its documents' words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, ids, size, h in _chunks(batches, most):
            word, place = np.unique(h, return_inverse=True)
            known = np.array([x is not None for x in ids], np.uint8)
            body = _pack(np.array([x or 0 for x in ids], np.int64), known, size.astype(np.int64), np.r_[word[:1], np.diff(word)], place.astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([body], pa.binary())], names=["chunk", "body"])

    return run


def _own(doc: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """How often each occurrence's n-gram is in the occurrence's document."""
    _, at, n = np.unique(doc * (int(gram.max(initial=0)) + 1) + gram, return_inverse=True, return_counts=True)
    return n[at]


def _score(alpha: float):
    def run(text: pa.Table, counts: pa.Table) -> pa.Table:
        """(doc_id, n_words, backed, part): log-scores before the total is known, which ``backed`` words are divided by."""
        ids, known, size, word, place = _unpack(text.column("body")[0].as_py())
        word = np.cumsum(word, dtype=np.uint64)
        two, second = _pairs(word[place], size)
        pair, inv = np.unique(two, return_inverse=True)
        total = np.zeros(len(word) + len(pair), np.int64)
        back = sorted(zip(counts.column("bucket").to_pylist(), counts.column("totals").to_pylist()))
        if back:
            total[np.argsort(np.r_[word, pair], kind="stable")] = np.concatenate([_unpack(x)[0] for _, x in back])
        doc = np.repeat(np.arange(len(size)), size)
        one = total[: len(word)][place] - _own(doc, place.astype(np.int64))
        both = total[len(word) :][inv] - _own(doc[second], inv)
        value = np.log(np.where(one > 0, one, UNSEEN))
        value[second] += np.log(alpha)
        seen = both > 0
        at = second[seen]
        value[at] = np.log(both[seen]) - np.log(one[at - 1])
        backed = np.ones(len(value))
        backed[at] = 0
        cols = [pa.array(ids, mask=known == 0), pa.array(size), pa.array(np.bincount(doc, backed, len(size)).astype(np.int64)), pa.array(np.bincount(doc, value, len(size)).astype(np.float64))]
        return pa.Table.from_arrays(cols, names=["doc_id", "n_words", "backed", "part"])

    return run


def scored(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", alpha: float = ALPHA, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_words, log_score): every document's mean log-score per word.

    A word's score is the count of its pair with the word before over the count
    of that word; for a pair that no other document has it is ``alpha`` times,
    and for a first word once, the word's count over that of all words, where a
    word that no other document has counts as ``UNSEEN``.  Counts are those of
    all other documents: repeated rows count for each other.  A document alone
    in the corpus has a total of one.  ``chunk`` changes what is shuffled, not the result.  ``doc_id`` is a number, or text that
    holds one.  Null, empty and wordless texts have 0 words and a null score;
    every row has one result.  An empty table gives an empty result.
    """
    (row,) = fresh(docs, "row")
    rows = numbered(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), row).select(row, "doc_id", "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, -(-size // PARTITION_BYTES))
    grams = rows.mapInArrow(_exploded(chunk, buckets), "bucket long, chunk long, body binary")
    counts = grams.groupBy("bucket").applyInArrow(_joined, "chunk long, bucket long, totals binary")
    texts = rows.mapInArrow(_packed(chunk), "chunk long, body binary")
    sums = written(texts.groupBy("chunk").cogroup(counts.groupBy("chunk")).applyInArrow(_score(alpha), "doc_id long, n_words long, backed long, part double"), "sums")
    total = sums.agg(F.sum("n_words")).first()[0] or 0
    rest = F.log(F.greatest(F.lit(total) - F.col("n_words"), F.lit(1)).cast("double"))
    mean = (F.col("part") - F.col("backed") * rest) / F.col("n_words")
    return sums.select("doc_id", "n_words", F.when(F.col("n_words") > 0, F.round(mean, 6)).alias("log_score"))


SQL = f"""
WITH t AS (
  SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents
), x AS MATERIALIZED (
  SELECT d, unnest(w) AS word, unnest(list_prepend(NULL, w[:-2])) AS before, len(w) AS n FROM t WHERE len(w) > 0
), own1 AS MATERIALIZED (
  SELECT d, word, count(*) AS c FROM x GROUP BY d, word
), own2 AS MATERIALIZED (
  SELECT d, before, word, count(*) AS c FROM x WHERE before IS NOT NULL GROUP BY d, before, word
), one AS (
  SELECT d, word, c_all - c AS c FROM (SELECT *, sum(c) OVER (PARTITION BY word) AS c_all FROM own1)
), two AS (
  SELECT d, before, word, c_all - c AS c FROM (SELECT *, sum(c) OVER (PARTITION BY before, word) AS c_all FROM own2)
), s AS (
  SELECT x.d, sum(CASE WHEN two.c > 0 THEN ln(two.c::double / ctx.c)
    ELSE CASE WHEN x.before IS NULL THEN 0 ELSE ln({ALPHA}::double) END + ln(CASE WHEN one.c > 0 THEN one.c::double ELSE {UNSEEN} END / greatest((SELECT count(*) FROM x) - x.n, 1)) END) AS part
  FROM x JOIN one ON x.d = one.d AND x.word = one.word LEFT JOIN one AS ctx ON x.d = ctx.d AND x.before = ctx.word LEFT JOIN two ON x.d = two.d AND x.before = two.before AND x.word = two.word GROUP BY x.d
)
SELECT t.doc_id, coalesce(len(t.w), 0)::bigint AS n_words, round(s.part / len(t.w), 6) AS log_score FROM t LEFT JOIN s USING (d)
"""
