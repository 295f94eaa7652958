"""Documents compiled as they arrive, and usage counted by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import registry
from ..sources.store import RunStore
from ..sources.text import split_pages

PAGES = "document_id string, text string"


def compile_stream(spark: SparkSession, source: str, store: RunStore, checkpoint: str) -> StreamingQuery:
    """New JSON documents below ``source`` are split, compiled and stored by document; a replayed batch overwrites only its own."""
    arriving = spark.readStream.schema(PAGES).json(source)

    def compile_batch(batch: DataFrame, _: int) -> None:
        store.save(registry.compile_documents(split_pages(batch)), "compiled")

    return arriving.writeStream.foreachBatch(compile_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def usage_windows(events: DataFrame, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Calls and totals by stage and window of event time; later rows than the watermark do not count."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "stage").agg(F.count("*").alias("n_calls"), F.sum("value").alias("total"))
