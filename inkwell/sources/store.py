"""Saved indexes: a folder of versions, each of four Parquet tables, and a log of them.

Everything goes through Hadoop's FileSystem, so that the folder may be on any
store that Spark reaches.  A version counts once its entry in the log is there;
entries are numbered and created, never overwritten, so that of two writers at
a time one fails.  The version before the last stays for those who read it.
Postings and terms are sorted by term within files, so that a query reads only
the row groups that can hold its terms; a term of many documents takes several
files.
"""

from __future__ import annotations

import json
import uuid
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import Analyzer
from ..operators.index import Index, terms_of

LOG = "versions"


class _Folder:
    """A folder of any file system that Hadoop knows."""

    def __init__(self, spark: SparkSession, folder: str | Path):
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(str(folder))
        self.fs = path.getFileSystem(conf)
        self.path = self.fs.makeQualified(path)
        self.at = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join([self.path.toString(), *parts]))

    def names(self, *parts: str) -> list[str]:
        """Sorted names in a subfolder; none if it isn't there."""
        at = self.at(*parts)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def create(self, *parts: str) -> None:
        """An empty file; an error if it exists."""
        self.fs.create(self.at(*parts), False).close()

    def remove(self, *parts: str) -> None:
        self.fs.delete(self.at(*parts), True)


def _entries(folder: _Folder) -> list[str]:
    """The log, oldest first: ``number@version``."""
    return [n for n in folder.names(LOG) if "@" in n]


def exists(spark: SparkSession, folder: str | Path) -> bool:
    return bool(_entries(_Folder(spark, folder)))


def save(index: Index, folder: str | Path) -> None:
    """As a new version; of the older ones the last stays."""
    spark = index.documents.sparkSession
    root, name = _Folder(spark, folder), f"v-{uuid.uuid4().hex}"
    before, to = _entries(root), root.at(name).toString()
    index.documents.write.parquet(f"{to}/documents")
    by_term = index.postings.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id")
    by_term.write.option("parquet.bloom.filter.enabled#term", "true").parquet(f"{to}/postings")
    documents, postings = (spark.read.schema(s).parquet(f"{to}/{n}") for n, s in (("documents", schemas.DOCUMENTS), ("postings", schemas.POSTINGS)))
    # a term's postings are together now, so that little is exchanged to count them
    terms_of(postings).repartitionByRange(F.col("term")).sortWithinPartitions("term").write.parquet(f"{to}/terms")
    totals = documents.agg(F.count("*").alias("num_documents"), F.coalesce(F.sum("length"), F.lit(0)).alias("total_tokens")).first()
    a = index.analyzer
    config = {
        "next_doc_id": index.next_doc_id,
        "num_documents": totals["num_documents"],
        "total_tokens": totals["total_tokens"],
        "analyzer": json.dumps({"remove_stop_words": a.remove_stop_words, "stem": a.stem, "split_camel_case": a.split_camel_case, "min_token_length": a.min_token_length, "custom_stop_words": None if a.custom_stop_words is None else sorted(a.custom_stop_words)}),
    }
    spark.createDataFrame([(k, str(v)) for k, v in config.items()], schemas.CONFIG).coalesce(1).write.parquet(f"{to}/config")
    number = int(before[-1].split("@")[0]) + 1 if before else 0
    if _entries(root) != before:
        root.remove(name)
        raise RuntimeError(f"another writer has changed the index in {folder}")
    root.create(LOG, f"{number:012d}@{name}")
    for old in before[:-1]:
        root.remove(LOG, old)
        root.remove(old.split("@")[1])


def load(spark: SparkSession, folder: str | Path) -> Index:
    """The last version; FileNotFoundError if there is none."""
    root = _Folder(spark, folder)
    versions = _entries(root)
    if not versions:
        raise FileNotFoundError(f"no index in {folder}")
    at = root.at(versions[-1].split("@")[1]).toString()
    config = {r["key"]: r["value"] for r in spark.read.schema(schemas.CONFIG).parquet(f"{at}/config").collect()}
    said = json.loads(config["analyzer"])
    if said["custom_stop_words"] is not None:
        said["custom_stop_words"] = frozenset(said["custom_stop_words"])
    read = {n: spark.read.schema(s).parquet(f"{at}/{n}") for n, s in (("documents", schemas.DOCUMENTS), ("postings", schemas.POSTINGS), ("terms", schemas.TERMS))}
    n, tokens = int(config["num_documents"]), int(config["total_tokens"])
    return Index(read["documents"], read["postings"], read["terms"], Analyzer(**said), int(config["next_doc_id"]), {"totals": (n, tokens / n if n else 0.0)})
