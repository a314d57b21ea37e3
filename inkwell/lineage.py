"""Cutting lineage, so that an index changed many times keeps a short plan and texts are read once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch: tokens of whole texts are wide, and the JVM and the worker each hold a batch or two.
BATCH_BYTES = "4m"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def narrow_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to ``BATCH_BYTES``, unless its configuration names a size."""
    if spark.sparkContext.getConf().get(_BATCH) is None:
        spark.conf.set(_BATCH, BATCH_BYTES)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a local folder only where it is unset on a local master."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="inkwell-")
        sc.setCheckpointDir(folder)
    return folder


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed and put into the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _steady(plan) -> bool:
    """Whether a plan is a scan of files with projections and filters, which gives its rows in one order always."""
    if not plan.deterministic():
        return False
    name, children = plan.nodeName(), plan.children()
    if children.isEmpty():
        return name in ("LogicalRelation", "LocalRelation")
    return name in ("Project", "Filter") and _steady(children.head())


def numbered(rows: DataFrame, at: str) -> DataFrame:
    """``rows`` with their places, in the order in which they are read, the same whenever it is computed.

    What isn't read straight from files, and so might come in another order when
    it is computed again, is written once, with its places.
    """
    placed = rows.withColumn(at, F.monotonically_increasing_id())
    return placed if _steady(rows._jdf.queryExecution().optimizedPlan()) else written(placed, "rows")
