"""Near-duplicate documents by Order MinHash, verified by banded alignment.

A sketch is the ``L`` smallest of the document's ``K``-word k-mers, each
labelled with its occurrence, under one hash function, kept in text order; so
equal sketches speak for a small edit distance and not only for a common
vocabulary.  Texts of at most ``SHORT`` words have ``SHORT_SKETCHES`` of single
words, as few of their k-mers survive edits; those that a longer text can be
alike to have both.  Documents with the same words are one node.  Nodes that
share a sketch are joined in stars around the first of each bucket, then around
the member that has aligned most often; then every pair of a bucket that is
neither verified nor in one group is verified, with no limit.  In buckets of over
``SMALL`` such members only pairs that can be alike are formed: of two documents
within the edit distance the rarest words, as many as one has edits and one
more, have a word in common, so that none is lost.  A pair counts if the word edit distance, by an alignment in a widening band, is within
``1 - SIMILARITY`` of the longer document.  Groups are the components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._components import components
from ._lex import GRAM, fresh, grams, mix, pieces, release, words
from ._store import numbered, written

K, L, SKETCHES, SIMILARITY = 2, 3, 32, 0.8
SHORT, SHORT_SKETCHES = 50, 24
#: Members of a bucket of which all pairs are formed.
SMALL = 100
_U = np.uint64
_MAX = _U(2**64 - 1)


def sketches(h: np.ndarray, row: np.ndarray, k: int = K, least: int = L, n: int = SKETCHES) -> tuple[np.ndarray, np.ndarray]:
    """(rows with k-mers, [row, n] ordered sketches) of word hashes."""
    g, first = grams(h, row, k)
    if not len(g):
        return np.zeros(0, np.int64), np.zeros((0, n), np.uint64)
    at = row[first]
    order = np.argsort(g, kind="stable")  # label occurrences within each row
    order = order[np.argsort(at[order], kind="stable")]
    same = np.r_[False, (g[order][1:] == g[order][:-1]) & (at[order][1:] == at[order][:-1])]
    place = np.arange(len(g))
    nth = place - np.maximum.accumulate(np.where(same, 0, place))
    label = np.empty(len(g), np.uint64)
    label[order] = nth.astype(np.uint64)
    x = mix(g + label * GRAM[40])
    cut = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    size = np.diff(np.r_[cut, len(at)])
    out = np.zeros((len(cut), n), np.uint64)
    for s in range(n):
        v = x * GRAM[2 + s % 60] + _U(s)
        v ^= v >> _U(29)
        v *= _U(0xBF58476D1CE4E5B9)
        v ^= v >> _U(32)
        chosen = np.full((len(cut), least), len(g), np.int64)
        for j in range(least):
            low = np.minimum.reduceat(v, cut)
            hit = np.flatnonzero(v == np.repeat(low, size))
            group = np.searchsorted(cut, hit, "right") - 1
            one = np.r_[True, group[1:] != group[:-1]]
            hit, group = hit[one], group[one]
            left = size[group] > j
            chosen[group[left], j] = hit[left]
            v[hit] = _MAX
        chosen.sort(1)
        key = np.full(len(cut), _U(s + 1))
        padded = np.r_[g, _U(0)]
        for j in range(least):
            key = mix(key * GRAM[61] + padded[chosen[:, j]])
        out[:, s] = key
    return at[cut], out


def _sketched(h: np.ndarray, at: np.ndarray, n: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(sketches in the order of rows, how many each row has) of word hashes; ``n``: words of each row."""
    owner, every = [], []
    for part, k, count in ((n <= SHORT, 1, SHORT_SKETCHES), (n >= SHORT * similarity, K, SKETCHES)):
        mine = part[at]
        rows, sk = sketches(h[mine], at[mine], k, n=count)
        owner.append(np.repeat(rows, count))
        every.append(sk.ravel())
    owner = np.concatenate(owner)
    return np.concatenate(every)[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(n))


def _read(docs: DataFrame, row: str, doc_id: str, text: str, similarity: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offs in pieces(b.column(2)):
                h, at = words(data, offs)
                n = np.bincount(at, minlength=j - i)
                one, two = np.zeros(j - i, np.uint64), np.zeros(j - i, np.uint64)
                some = np.flatnonzero(n)
                if len(some):
                    place = (np.arange(len(h)) - np.repeat((np.cumsum(n) - n)[some], n[some])).astype(np.uint64)
                    starts = (np.cumsum(n) - n)[some]
                    one[some] = mix(np.add.reduceat(mix(h + place * GRAM[50]), starts))
                    two[some] = mix(np.add.reduceat(mix(h * GRAM[51] ^ mix(place + _U(7))), starts))
                for r in np.flatnonzero((n == 0) & (np.diff(offs) > 0)):  # no words: by the bytes
                    raw = data[offs[r] : offs[r + 1]].astype(np.uint64)
                    place = mix(np.arange(len(raw), dtype=np.uint64))
                    one[r], two[r] = (mix(np.array([np.add.reduce(mix(raw + place * GRAM[q]))]))[0] for q in (52, 53))
                sk, m = _sketched(h, at, n, similarity)
                listed = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(m)].astype(np.int32)), pa.array(sk.view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(n), listed], names=["row", "doc", "one", "two", "n", "sketches"])

    return docs.select(row, F.col(doc_id).cast("long"), text).mapInArrow(run, "row long, doc long, one long, two long, n long, sketches array<long>")


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, j, data, offs in pieces(b.column(1)):
            h, at = words(data, offs)
            n = np.bincount(at, minlength=j - i)
            listed = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array((h >> _U(32)).astype(np.uint32).view(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), listed], names=["node", "words"])


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of each document, told apart by their occurrence, and how many it has."""
    for b in batches:
        size = b.column(1).value_lengths().to_numpy(zero_copy_only=False)
        row, word = np.repeat(np.arange(b.num_rows), size), b.column(1).flatten().to_numpy().view(np.uint32).astype(np.uint64)
        key = mix(word + row.astype(np.uint64) * GRAM[41])
        order = np.argsort(key, kind="stable")
        same, place = np.r_[False, key[order][1:] == key[order][:-1]][: len(key)], np.arange(len(key))
        nth = np.empty(len(key), np.uint64)
        nth[order] = (place - np.maximum.accumulate(np.where(same, 0, place))).astype(np.uint64)
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(mix(word * GRAM[42] + nth * GRAM[43]).view(np.int64)), pa.array(size[row].astype(np.int64))], names=["node", "element", "size"])


def _rarest(tokens: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """(node, element): as many of each document's rarest words as it may have edits, and one more."""
    elements = tokens.join(nodes, "node", "left_semi").mapInArrow(_elements, "node long, element long, size long")
    often = elements.groupBy("element").agg(F.count("*").alias("often"))
    rank = F.row_number().over(W.partitionBy("node").orderBy("often", "element"))
    return elements.join(often, "element").withColumn("rank", rank).where(F.col("rank") <= F.floor((1 - similarity) * F.col("size") + 1e-9) + 1).select("node", "element")


def _banded(a: list[np.ndarray], b: list[np.ndarray], band: int) -> np.ndarray:
    """Upper bounds of the edit distances; exact where they are at most ``band``."""
    p, na, nb = len(a), np.array([len(x) for x in a]), np.array([len(x) for x in b])
    rows, w = int(na.max(initial=0)), 2 * band + 1
    far = 1 << 28
    x = np.full((p, rows + 1), -1, np.int64)
    y = np.full((p, rows + 2 * band + 2), -2, np.int64)
    for i in range(p):
        x[i, : na[i]] = a[i]
        y[i, band : band + min(nb[i], rows + band)] = b[i][: rows + band]
    lane = np.arange(w, dtype=np.int32)
    # d[j] is the cell (row, row + j - band) of the table
    d = np.where(lane >= band, lane - band, far).astype(np.int32)[None].repeat(p, 0)
    d[(lane - band)[None] > nb[:, None]] = far
    out = np.full(p, far, np.int64)

    def take(r: int, d: np.ndarray) -> None:
        done = np.flatnonzero(na == r)
        j = nb[done] - r + band
        ok = (j >= 0) & (j < w)
        out[done[ok]] = d[done[ok], j[ok]]

    take(0, d)
    live = np.arange(p)
    for r in range(1, rows + 1):
        keep = na[live] >= r
        if not keep.all():
            live, d = live[keep], d[keep]
        cell = d + (y[live, r - 1 : r - 1 + w] != x[live, r - 1 : r])
        cell[:, :-1] = np.minimum(cell[:, :-1], d[:, 1:] + 1)
        column = r + lane - band
        cell[:, column < 0] = far
        if r <= band:
            cell[:, band - r] = r
        cell = np.minimum.accumulate(cell - lane, 1) + lane
        cell[:, column < 0] = far
        d = cell
        done = np.flatnonzero(na[live] == r)
        if len(done):
            j = nb[live[done]] - r + band
            ok = (j >= 0) & (j < w)
            out[live[done[ok]]] = d[done[ok], j[ok]]
    return out


def alike(a: list[np.ndarray], b: list[np.ndarray], similarity: float = SIMILARITY) -> np.ndarray:
    """Whether each pair's edit distance is within (1 - similarity) of the longer one."""
    n = np.array([max(len(x), len(y)) for x, y in zip(a, b)])
    limit = np.floor((1 - similarity) * n + 1e-9).astype(np.int64)
    out = np.zeros(len(a), bool)
    todo = []
    for i in np.flatnonzero(np.array([abs(len(x) - len(y)) for x, y in zip(a, b)]) <= limit):
        u, counts = np.unique(a[i], return_counts=True)
        v, other = np.unique(b[i], return_counts=True)
        _, p, q = np.intersect1d(u, v, assume_unique=True, return_indices=True)
        if n[i] - np.minimum(counts[p], other[q]).sum() <= limit[i]:  # else no alignment can do
            todo.append(i)
    todo = np.array(todo, np.int64)
    band = 8
    while len(todo):
        todo = todo[np.argsort(n[todo], kind="stable")]
        left, at = [], 0
        while at < len(todo):
            size = max(1, int(2_000_000 // ((2 * band + 1) * 8 + int(n[todo[at]]) + 1)))
            part = todo[at : at + size]
            part = part[n[part] <= 2 * n[part[0]] + 16]
            at += len(part)
            d = _banded([a[i] for i in part], [b[i] for i in part], band)
            ok = d <= limit[part]
            out[part[ok]] = True
            left.append(part[~ok & (limit[part] > band)])
        todo, band = np.concatenate(left), band * 4
        if len(todo):
            band = min(band, int(limit[todo].max()))
    return out


def _verify(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                p = whole.slice(at, 500)
                both = []
                for c in (2, 3):
                    flat = p.column(c).flatten().to_numpy()
                    n = p.column(c).value_lengths().to_numpy(zero_copy_only=False)
                    both.append(np.split(flat, np.cumsum(n)[:-1]))
                yield pa.RecordBatch.from_arrays([p.column(0), p.column(1), pa.array(alike(*both, similarity))], names=["a", "b", "alike"])
        release()

    return run


def _verified(pairs: DataFrame, tokens: DataFrame, similarity: float) -> DataFrame:
    one = tokens.select(F.col("node").alias("a"), F.col("words").alias("x"))
    two = tokens.select(F.col("node").alias("b"), F.col("words").alias("y"))
    # hubs first, while rows are narrow: the wide ones meet by members, of which each has few pairs
    return written(pairs.join(two, "b").join(one, "a").select("a", "b", "x", "y").mapInArrow(_verify(similarity), "a long, b long, alike boolean"), "verified")


def near_groups(docs: DataFrame, row: str, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, small: int = SMALL) -> DataFrame:
    """(row, doc, label): the group of every row of ``docs``, whose column ``row`` numbers the rows."""
    read = written(_read(docs, row, doc_id, text, similarity), "sketches")
    nodes = written(read.groupBy("one", "two").agg(F.min("row").alias("node"), F.first("n").alias("n"), F.first("sketches").alias("sketches")), "nodes")
    member = nodes.select("node", "n", F.explode("sketches").alias("bucket"))
    full = member.groupBy("bucket").agg(F.count("*").alias("c"), F.min_by(F.struct("node", "n"), "node").alias("hub")).where("c > 1").drop("c")
    member = written(member.join(full, "bucket").select("bucket", "node", "n", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n")), "members")
    wanted = member.select(F.col("node").alias(row)).distinct()
    tokens = written(docs.select(row, text).join(wanted, row, "left_semi").mapInArrow(_tokens, "node long, words array<int>"), "words")

    def near(a: str, b: str):
        return F.least(a, b) >= F.greatest(a, b) * (similarity - 1e-9)

    pairs = member.where((F.col("node") != F.col("hub")) & near("n", "hub_n")).select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    checked = _verified(pairs, tokens, similarity)
    for around_hubs in (True, False):
        aligned = checked.where("alike").select("a", "b")
        label = components(aligned)
        named = member.join(label, "node", "left").select("bucket", "node", "n", F.coalesce("label", "node").alias("label"))
        mixed = named.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").select("bucket")
        left = written(named.join(mixed, "bucket"), "mixed")
        x, y = left.toDF("bucket", "a", "an", "al"), left.toDF("bucket", "b", "bn", "bl")
        if around_hubs:
            degree = aligned.select("a").unionByName(aligned.select(F.col("b").alias("a"))).groupBy("a").count()
            x = x.join(degree, "a", "left").groupBy("bucket").agg(F.max_by(F.struct("a", "an", "al"), F.struct(F.coalesce("count", F.lit(0)), -F.col("a"))).alias("hub")).select("bucket", "hub.*")
        else:
            many = left.groupBy("bucket").agg(F.count("*").alias("c")).where(F.col("c") > small).select("bucket")
            large = left.join(many, "bucket", "left_semi")
            rare = _rarest(tokens, large.select("node").distinct(), similarity)
            large = written(large.join(rare, "node").select("bucket", "node", "n", "label", "element"), "rarest")
            few = left.join(many, "bucket", "left_anti").select("bucket", "node", "n", "label", F.lit(None).cast("long").alias("element"))
            left = few.unionByName(large)
            x, y = left.toDF("bucket", "a", "an", "al", "element"), left.toDF("bucket", "b", "bn", "bl", "element")
        on = ["bucket"] if around_hubs else [x["bucket"] == y["bucket"], x["element"].eqNullSafe(y["element"])]
        unlike = x.join(y, on).where((F.col("al") != F.col("bl")) & near("an", "bn"))
        if not around_hubs:
            unlike = unlike.where("a > b")
        rest = unlike.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().join(checked.select("a", "b"), ["a", "b"], "left_anti")
        checked = checked.unionByName(_verified(rest, tokens, similarity))
    edges = checked.where("alike").select("a", "b")
    label = components(edges)
    grouped = nodes.select("one", "two", "node").join(label, "node", "left").select("one", "two", F.coalesce("label", "node").alias("label"))
    return read.select("row", "doc", "one", "two").join(grouped, ["one", "two"]).select("row", "doc", "label")


def _first(groups: DataFrame) -> DataFrame:
    return groups.groupBy("label").agg(F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "row")).alias("first"), F.count("*").alias("size"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, group_doc_id, group_size, kept) of every row of ``docs``.

    ``doc_id`` is a number, or text that holds one.  A group is named by its least
    ``doc_id`` (nulls last); that row is the one
    kept, of repeated rows the first read.  Rows with the same words in order
    are alike, whatever their case and punctuation.  Documents without words
    are alike if their texts are equal, a null text being an empty one; at
    ``SIMILARITY`` those of under 5 words only if their words are the same.  An empty table gives an
    empty result.
    """
    (row,) = fresh(docs, "row")
    groups = written(near_groups(numbered(docs.select(doc_id, text), row), row, doc_id, text, similarity), "groups")
    return groups.join(_first(groups), "label").select(F.col("doc").alias("doc_id"), F.col("first.doc").alias("group_doc_id"), F.col("size").alias("group_size"), (F.col("row") == F.col("first.row")).alias("kept"))


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The one document of each group of ``near_duplicates`` that is kept, with the columns of ``docs``.

    Nulls, empty texts, repeated rows, ties and empty tables are as there.
    """
    (row,) = fresh(docs, "row")
    rows = numbered(docs, row)
    kept = _first(near_groups(rows, row, doc_id, text, similarity)).select(F.col("first.row").alias(row))
    return rows.join(kept, row, "left_semi").select(*docs.columns)
