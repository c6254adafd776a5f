"""A log as a stream: the extents of atoms follow new messages, whatever their order and lateness.

Replies may come at any time, so nothing expires by a watermark. Each micro-batch is folded into a table of extents per
root; a message whose parent is known by a root joins it, and roots that a late parent connects are merged, so that the
table always equals the batch result over all messages so far. Writes are versioned folders, so a failed batch leaves the
last version in place, and a repeated batch id is not applied twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chains
from ..schema import MESSAGE


def read_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Message files as they arrive under path."""
    return spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", files_per_batch).json(path)


def per_day(messages: DataFrame, late: str = "2 days") -> DataFrame:
    """Messages and senders per day over event time; days close once the watermark has passed them."""
    m = messages.withColumn("ts", F.to_timestamp("date")).withWatermark("ts", late)
    return m.groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("messages"), F.approx_count_distinct("sender_id").alias("senders"))


class Extents:
    """State: per message its root, per root its extent. apply() is the body of foreachBatch."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _version(self) -> int:
        try:
            done = self.spark.read.parquet(f"{self.path}/versions").agg(F.max("batch")).collect()[0][0]
        except Exception as e:  # no version yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            done = None
        return -1 if done is None else done

    def messages(self) -> DataFrame | None:
        """id, date, reply_to, post_id, topic_id, sender and root of all messages so far."""
        v = self._version()
        return None if v < 0 else self.spark.read.parquet(f"{self.path}/state/{v}")

    def extents(self) -> DataFrame:
        """root, n_members, leaf_date."""
        return self.messages().groupBy("root").agg(F.count("*").alias("n_members"), F.max("date").alias("leaf_date"))

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        v = self._version()
        if batch_id <= v:
            return
        new = batch.select("id", "date", "reply_to", "post_id")
        old = self.messages()
        every = new if old is None else old.drop("root").unionByName(new)
        chains.with_root(every).write.mode("overwrite").parquet(f"{self.path}/state/{batch_id}")
        self.spark.range(1).select(F.lit(batch_id).cast("long").alias("batch")).write.mode("append").parquet(f"{self.path}/versions")

    def start(self, stream: DataFrame, checkpoint: str):
        return stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
