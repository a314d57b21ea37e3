"""Documents that arrive as a stream, put into a saved index batch by batch."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import Analyzer
from ..operators.index import Index
from ..sources import store


def ingest(stream: DataFrame, folder: str | Path, checkpoint: str | Path, analyzer: Analyzer | None = None) -> StreamingQuery:
    """Upsert (path, text, title, metadata) rows; a batch that comes again changes nothing, as paths are keys."""

    def put(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        index = store.load(spark, folder) if store.exists(spark, folder) else Index.empty(spark, analyzer)
        store.save(index.upsert(batch), folder)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
