"""Subtitle files as they arrive: a file is whole when it is seen, so each batch is parsed by itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cuemill.operators.cues import explode_lines, parse_cues


def stream_cues(spark: SparkSession, folder: str, checkpoint: str, sink: Callable[[DataFrame, int], None], glob: str = "*") -> StreamingQuery:
    """Starts a query that hands the cues of each batch of new files to ``sink`` with the batch's id.

    ``checkpoint`` is a folder that survives restarts; a sink that writes by batch id is exactly-once.
    """
    files = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", glob).load(folder)
    bodies = files.select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("body"))
    return bodies.writeStream.foreachBatch(lambda batch, number: sink(parse_cues(explode_lines(batch)), number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
