"""Streams of review events: a journal without doubles, and a registry that follows the log.

The batch replay is the specification: the streaming registry keeps, as state of each finding, its events so far, and gives for each finding with news the row that a batch replay over all of them gives. Events may come in any order; the sequence number decides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators import audit as A


def read_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Events from JSON files that are added to a folder."""
    return spark.readStream.schema(schema).json(path)


def without_doubles(events: DataFrame, key: str = "event_id", time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Each event once: ever, or within the delay of an event time, beyond which its key is forgotten."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark([key]) if time else events.dropDuplicates([key])


def into_journal(events: DataFrame, path: str, checkpoint: str):
    """A query that appends events to a journal, exactly once by its checkpoint."""
    return events.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


#: Parts of the log by finding; a batch reads those of its own findings.
BUCKETS = 64


def registry_updates(log_path: str, write: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: adds a batch's events to the log (once for each batch number) and hands over the rows of the findings that it is about, replayed over their whole log. The log lies in parts by a hash of the finding, and only the batch's own parts are read."""

    def update(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.withColumn("bucket", F.pmod(F.xxhash64("finding_id"), F.lit(BUCKETS)).cast("int")).write.mode("overwrite").partitionBy("bucket").parquet(f"{log_path}/batch={number}")
        if batch.isEmpty():
            return
        log = spark.read.option("basePath", log_path).parquet(f"{log_path}/batch=*")
        own = log.filter(F.col("batch") == number)
        buckets = [r["bucket"] for r in own.select("bucket").distinct().collect()]  # BUCKETS at most
        theirs = log.filter((F.col("batch") <= number) & F.col("bucket").isin(buckets)).drop("batch", "bucket")
        write(A.replay(theirs.join(own.select("finding_id").distinct(), "finding_id", "left_semi")))

    return update


def follow(events: DataFrame, log_path: str, checkpoint: str, write: Callable[[DataFrame], None]):
    """A query that keeps a registry current."""
    return events.writeStream.foreachBatch(registry_updates(log_path, write)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
