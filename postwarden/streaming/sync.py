"""Structured Streaming: drop folders and change feeds into tables, exactly once by batch."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.sync import apply_changes, net_changes
from ..sources.tables import Tables, shared_folder


def drained(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet") -> DataFrame:
    """All that is in a folder, or in one file, now, taken as a stream into a table that goes when the driver ends."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    whole = re.sub(r"([\\*?\[\]{}])", r"\\\1", path.rstrip("/"))
    stream = spark.readStream.schema(schema).format(fmt).load(whole[:-1] + f"[{whole[-1]}]")  # a pattern of one name, as a stream takes a single file by pattern only
    stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{folder}/rows")


def mail_folder(spark: SparkSession, path: str, per_batch: int = 1000) -> DataFrame:
    """A stream of .eml files: path, received_at (file time) and raw bytes."""
    stream = spark.readStream.format("binaryFile").option("pathGlobFilter", "*.eml").option("maxFilesPerTrigger", per_batch).load(path)
    return stream.select("path", F.col("modificationTime").alias("received_at"), F.col("content").alias("raw"))


def follow(changes: DataFrame, fetch, tables: Tables, checkpoint: str, every: str | None = None):
    """Applies a stream of change records to the messages table, batch by batch.

    ``fetch(ids)`` gives the messages of inserted ids. Version 0 is the table as it was before;
    batch n writes version n + 1, and a batch that runs again after a failure finds it there. Without
    ``every`` the stream ends when it has caught up.
    """

    def step(batch: DataFrame, number: int) -> None:
        if tables.last_batch("messages") > number:
            return
        net = net_changes(batch).persist()
        try:
            fetched = fetch(net.where("action = 'insert'").select("gmail_id"))
            tables.write("messages", apply_changes(tables.read("messages"), net, fetched), batch=number + 1)
        finally:
            net.unpersist()

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return changes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def contact_counts(stream: DataFrame, lateness: str = "30 days") -> DataFrame:
    """Contact counters as a stateful stream in update mode, repeats of a message within ``lateness`` counted once."""
    once = stream.withWatermark("received_at", lateness).dropDuplicatesWithinWatermark(["account_id", "gmail_id", "canonical_email"])
    return once.groupBy("account_id", "canonical_email").agg(F.count_if(~F.col("outbound")).alias("inbound_count"), F.count_if("outbound").alias("outbound_count"), F.max("received_at").alias("last_seen"))
