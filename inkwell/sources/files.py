"""Text files as documents.

The driver lists and prunes; executors read.  Spark's own directory scan drops
names that start with ``_`` or ``.``, which count here.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import PRUNED, SUFFIXES

MAX_BYTES = 10 << 20
_LISTED = "file string, path string, title string, size long"


def _suffix(name: str) -> str:
    return Path(name).suffix.lower()


def listed(folder: str | Path, recursive: bool = True, extensions: Iterable[str] | None = None) -> list[tuple[str, str, str]]:
    """(file, display path, name) under a folder, in the order of paths; none if it isn't a folder."""
    root, wanted, out = Path(folder), set(extensions or ()) or SUFFIXES, []
    if not root.is_dir():
        return []
    for here, folders, names in os.walk(root):
        folders[:] = sorted(f for f in folders if f not in PRUNED and not f.startswith(".")) if recursive else []
        out += [(str(Path(here, n)), str(Path(here, n).relative_to(root)), n) for n in names if _suffix(n) in wanted]
    return sorted(out, key=lambda x: x[1])


def one_file(file: str | Path, relative_to: str | Path | None = None, extensions: Iterable[str] | None = None) -> list[tuple[str, str, str]]:
    """As ``listed``, of a single file; none if it is missing or of another kind."""
    path, wanted = Path(file), set(extensions or ()) or SUFFIXES
    if not path.is_file() or _suffix(path.name) not in wanted:
        return []
    shown = path.resolve().relative_to(Path(relative_to).resolve()) if relative_to is not None else path
    return [(str(path), str(shown), path.name)]


def _read(most: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for file, path, title in zip(b["file"], b["path"], b["title"]):
                try:
                    size = os.path.getsize(file)
                    if not 0 < size <= most:
                        continue
                    with open(file, encoding="utf-8", errors="replace") as f:
                        rows.append((path, f.read(), title, None))
                except OSError:
                    continue
            yield pd.DataFrame(rows, columns=["path", "text", "title", "metadata"]).astype({"metadata": object})

    return run


def read_files(spark: SparkSession, found: list[tuple[str, str, str]], max_bytes: int = MAX_BYTES) -> DataFrame:
    """Documents (path, text, title, metadata) of listed files; empty, too large and unreadable ones are left out."""
    rows = spark.createDataFrame(found, "file string, path string, title string")
    return rows.mapInPandas(_read(max_bytes), "path string, text string, title string, metadata string")


def read_remote(spark: SparkSession, folder: str, extensions: Iterable[str] | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """The same from a store that only Spark reads; names that start with ``_`` or ``.`` are lost there."""
    wanted = sorted(set(extensions or ()) or SUFFIXES)
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).where(F.col("length").between(1, max_bytes))
    name = F.regexp_extract("path", "[^/]+$", 0)
    rows = rows.where(F.lower(F.regexp_extract(name, "[^.](\\.[^.]+)$", 1)).isin(wanted))
    return rows.select(F.url_decode("path").alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"), F.url_decode(name).alias("title"), F.lit(None).cast("string").alias("metadata"))
