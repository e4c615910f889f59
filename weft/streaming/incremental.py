"""Files that arrive over time, loaded by the same planner and store.

Each micro-batch of the file source goes through a job's own expressions and into the
store; the store's ledger makes a repeated batch harmless, and the stream's checkpoint
remembers which files were read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def available_now(spark: SparkSession, folder: str, schema: str, checkpoint: str, load: Callable[[DataFrame, int], None], separator: str = "\t", files_at_once: int = 100) -> None:
    """Feed the files of ``folder`` that no earlier run saw to ``load``, and stop."""
    stream = spark.readStream.schema(schema).option("sep", separator).option("header", True).option("maxFilesPerTrigger", files_at_once).csv(folder)
    query = stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
