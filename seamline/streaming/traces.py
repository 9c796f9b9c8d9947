"""Traces as a stream: envelopes that a collector writes as files become rows, and rows become files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from seamline.sources.otlp import flattened


def stream_spans(spark: SparkSession, path: str, service: str | None = None, files_at_once: int = 100) -> DataFrame:
    """The spans of read_spans(), from each new file of a folder; a line is an envelope."""
    return flattened(spark.readStream.schema("value string").option("maxFilesPerTrigger", files_at_once).text(path), service)


def write_stream(rows: DataFrame, path: str, checkpoint: str, by: tuple[str, ...] = (), until_done: bool = False) -> StreamingQuery:
    """Lines of JSON in batches, each once; the checkpoint folder remembers what is done, so a run that was stopped goes on. until_done: only what is there now."""
    out = rows.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    if by:
        out = out.partitionBy(*by)
    return (out.trigger(availableNow=True) if until_done else out).start()
