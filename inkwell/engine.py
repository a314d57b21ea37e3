"""The search engine's Python interface."""

from __future__ import annotations

import json
import warnings
from collections.abc import Iterable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from . import schemas
from .functions.text import Analyzer
from .operators.index import Index
from .operators.ranking import B, K1, explained
from .plans.compile import Compiler
from .sources import files, store


@dataclass
class Result:
    """One ranked document."""

    path: str
    score: float
    title: str | None = None
    snippet: str | None = None
    line_number: int | None = None
    metadata: dict = field(default_factory=dict)


class Engine:
    """An index in a folder, or in memory only, with its analyser and ranking parameters."""

    def __init__(self, spark: SparkSession, index_path: str | Path | None = None, analyzer: Analyzer | None = None, k1: float = K1, b: float = B, extensions: Iterable[str] | None = None, max_file_size: int = files.MAX_BYTES, mode: str = "compat"):
        self.spark, self.index_path, self.k1, self.b, self.mode = spark, index_path, k1, b, mode
        self.extensions, self.max_file_size = set(extensions or ()) or None, max_file_size
        if index_path and store.exists(spark, index_path):
            self.index = store.load(spark, index_path)
            if analyzer is not None and analyzer != self.index.analyzer:
                warnings.warn("the index was made by another analyser; queries use its own", stacklevel=2)
        else:
            self.index = Index.empty(spark, analyzer)

    @property
    def exists(self) -> bool:
        """Whether the index has been saved."""
        return bool(self.index_path) and store.exists(self.spark, self.index_path)

    def close(self) -> None:
        """Gives up what the index holds in memory; nothing is saved."""
        self.index.close()

    def __enter__(self) -> Engine:
        return self

    def __exit__(self, *_: object) -> None:
        self.save()

    def save(self) -> None:
        if self.index_path:
            store.save(self.index, self.index_path)
            self.index = store.load(self.spark, self.index_path)

    def add(self, docs: DataFrame) -> int:
        """Upsert documents (path, text and maybe title, metadata); how many the index has then."""
        self.index = self.index.upsert(docs).settled()
        return self.index.documents.count()

    def _id(self, path: str) -> int:
        return self.index.documents.where(self.index.documents.path == path).first()["doc_id"]

    def index_text(self, text: str, path: str, title: str | None = None, metadata: dict | None = None) -> int:
        row = (path, text, title, json.dumps(metadata) if metadata else None)
        self.add(self.spark.createDataFrame([row], schemas.INPUT))
        return self._id(path)

    def index_file(self, file: str | Path, relative_to: str | Path | None = None, metadata: dict | None = None) -> int | None:
        found = files.one_file(file, relative_to, self.extensions)
        rows = files.read_files(self.spark, found, self.max_file_size).collect() if found else []
        if not rows:
            return None
        return self.index_text(rows[0]["text"], rows[0]["path"], rows[0]["title"], metadata)

    def index_directory(self, folder: str | Path, recursive: bool = True, extensions: Iterable[str] | None = None) -> int:
        found = files.listed(folder, recursive, set(extensions or ()) or self.extensions)
        if not found:
            return 0
        docs = files.read_files(self.spark, found, self.max_file_size).cache()
        n = docs.count()
        self.add(docs)
        return n

    def index_paths(self, paths: Iterable[str | Path], recursive: bool = True) -> dict[str, int]:
        """Files and folders, put into the index at once: how many documents each gave; those missing aren't named."""
        out, every = {}, None
        for name in map(str, paths):
            if Path(name).is_dir():
                found = files.listed(name, recursive, self.extensions)
            elif Path(name).is_file():
                found = files.one_file(name, None, self.extensions)
            else:
                continue
            docs = files.read_files(self.spark, found, self.max_file_size).cache() if found else None
            out[name] = docs.count() if found else 0
            if docs is not None:
                every = docs if every is None else every.unionByName(docs)
        if every is not None:
            self.add(every)
        return out

    def remove(self, path: str) -> bool:
        """Whether the path was there."""
        had = not self.index.documents.where(self.index.documents.path == path).isEmpty()
        if had:
            self.index = self.index.delete(self.spark.createDataFrame([(path,)], "path string")).settled()
        return had

    def results(self, query: str, max_results: int = 10, min_score: float = 0.0) -> DataFrame:
        """The ranked documents as a DataFrame."""
        return Compiler(self.index, self.mode, self.k1, self.b).search(query, max_results, min_score)

    def search(self, query: str, max_results: int = 10, min_score: float = 0.0) -> list[Result]:
        rows = self.results(query, max_results, min_score).orderBy("rank").collect()
        return [Result(r["path"], r["score"], r["title"], r["snippet"], r["line_number"], json.loads(r["metadata"] or "{}")) for r in rows]

    def explain(self, term: str, doc_id: int) -> dict:
        row = explained(self.index, term, doc_id, self.k1, self.b).first()
        if row:
            return row.asDict()
        known = not self.index.term_info(term).isEmpty() and not self.index.document(doc_id).isEmpty()
        return {"error": "Term not found in document" if known else "Term or document not found"}

    def index_info(self) -> dict:
        return self.index.stats().first().asDict()

    def clear(self) -> None:
        self.index = self.index.cleared()
