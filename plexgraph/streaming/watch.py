"""Continuous updates: new or changed source files trigger an update of the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from plexgraph.engine import Engine

_FILES = "path string, modificationTime timestamp, length long, content binary"


def watch(engine: Engine, source: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Follow a source tree. Each batch of new files runs one update, which finds out by content what has changed; the
    checkpoint keeps what was seen, so a restart goes on where it stopped. Removed files are noticed with the next batch.
    """
    files = engine.spark.readStream.schema(_FILES).format("binaryFile").option("recursiveFileLookup", True).load(source).select("path")

    def apply(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            engine.update(source)

    w = files.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime="10 seconds")).start()
