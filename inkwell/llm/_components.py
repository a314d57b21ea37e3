"""Connected components: in one task up to ``ONE_TASK`` edges, by alternating large and small stars while there are more."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._lex import release
from ._store import written

#: Edges that one task labels.  Every round of stars is several jobs, whose plans, classes and threads the driver holds.
ONE_TASK = 4_000_000


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not large:
        both = both.where("b < a")
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = both.join(least, "a")
    if large:
        return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").unionByName(least.select("a", F.col("m").alias("b")).where("a != b")).distinct()


def labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes in order, the least node of each one's component) of edges."""
    nodes = np.unique(np.concatenate([a, b]))
    a, b = np.searchsorted(nodes, a), np.searchsorted(nodes, b)
    root = np.arange(len(nodes))
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
    return nodes, nodes[root]


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = [], []
    for batch in batches:
        a.append(batch.column(0).to_numpy())
        b.append(batch.column(1).to_numpy())
    if a:
        columns = labels(np.concatenate(a), np.concatenate(b))
        del a, b
        for i in range(0, len(columns[0]), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 100_000]) for c in columns], names=["node", "label"])
    release()


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of its component, of every node with an edge (a, b)."""
    edges = written(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now[0] <= ONE_TASK:
            return written(edges.select("a", "b").coalesce(1).mapInArrow(_labelled, "node long, label long"), "labels")
        if now == mark:
            break
        mark = now
        edges = written(_star(_star(edges, True), False), "edges")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots)
