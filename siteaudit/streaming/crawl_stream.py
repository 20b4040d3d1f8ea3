"""Micro-batch forms: first-seen pages, running summaries, scored texts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..operators import audit
from ..operators.cuts import shared_folder
from ..packs.language import Pack


def read_stream(spark: SparkSession, folder: str, schema: T.StructType | str, files: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream, some files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def first_seen(stream: DataFrame, key: str, time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Rows whose key wasn't there before; with a time column the state is dropped after the delay."""
    if time is None:
        return stream.dropDuplicates([key])
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def running_summary(stream: DataFrame) -> DataFrame:
    """Counts of pages by status class and their mean response time, updated with every batch."""
    ok = F.col("status") == 200
    return stream.groupBy((F.floor(F.col("status") / 100) * 100).cast("int").alias("class")).agg(F.count("*").alias("pages"), F.floor(F.avg(F.when(ok, F.col("response_time_ms")))).cast("long").alias("avg_ms"))


def issue_stream(pages: DataFrame) -> DataFrame:
    """Issues of single pages as they arrive; facts of other pages are left to the batch."""
    for name in ("title_duplicate", "description_duplicate"):
        if name not in pages.columns:
            pages = pages.withColumn(name, F.lit(False))
    return audit.page_issues(pages)


def scored_stream(texts: DataFrame, pack: Pack, text: str = "text") -> DataFrame:
    return texts.withColumn("ledger", pack.ledger(F.col(text)))


def windowed_counts(events: DataFrame, time: str, key: str, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    return events.withWatermark(time, delay).groupBy(F.window(time, window), key).agg(F.count("*").alias("n"))


def run_to_end(stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None, folder: str | None = None) -> DataFrame:
    """Runs what is there and returns it, as rows of Parquet files; nothing passes through the driver.

    Files and progress go to a folder of their own in spark.checkpoint.dir, or to `folder`. In complete mode each batch
    replaces the result of the one before.
    """
    folder = f"{folder or shared_folder(stream.sparkSession)}/{name}-{uuid.uuid4().hex}"
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint or f"{folder}/progress").queryName(name)
    rows, spark, schema = f"{folder}/rows", stream.sparkSession, stream.schema
    if mode == "append":
        query: StreamingQuery = writer.format("parquet").option("path", rows).start()
    else:
        query = writer.outputMode(mode).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(rows)).start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(rows)


def stop_after(query: StreamingQuery, pages: int) -> int:
    """Ends a running query once it has taken so many rows; what it has written stays. Returns the rows taken."""
    while query.isActive:
        done = sum(p.numInputRows for p in query.recentProgress)
        if done >= pages:
            query.stop()
        query.awaitTermination(0.2) if query.isActive else None
    return sum(p.numInputRows for p in query.recentProgress)


class Progress(StreamingQueryListener):
    """Calls back with started, progress and done events."""

    def __init__(self, tell: object) -> None:
        self.tell = tell

    def onQueryStarted(self, event: object) -> None:
        self.tell({"event": "started", "id": str(event.id)})

    def onQueryProgress(self, event: object) -> None:
        self.tell({"event": "progress", "rows": event.progress.numInputRows})

    def onQueryIdle(self, event: object) -> None:
        pass

    def onQueryTerminated(self, event: object) -> None:
        self.tell({"event": "done", "id": str(event.id)})
