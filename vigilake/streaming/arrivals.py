"""Scanning files as they arrive: a stream of documents, rules on each batch, findings upserted by content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from vigilake.operators import rules
from vigilake.operators.catalog import Rule
from vigilake.sources.corpus import files_from_documents


def scan(spark: SparkSession, folder: str, schema: StructType, chosen: list[Rule], sink: str, checkpoint: str) -> StreamingQuery:
    """Findings of each new file of documents, appended to sink once: the batch number is part of the path."""

    def write(batch: DataFrame, number: int) -> None:
        rules.run(files_from_documents(batch), chosen).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", "1000").parquet(folder)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, delay: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Counts and sums by window and type over a stream of events, late ones dropped behind the watermark."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
