"""A partitioned, offset-addressed log on a versioned table: the file stand-in for a message broker.

Keys are dealt to partitions as a broker's default partitioner deals them; each partition's records have dense offsets from 0 in the order they were produced. A produce is one commit;
a concurrent one loses its version and may be tried again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslake.functions.canonical import key_partition
from corpuslake.sources.lake import Table

LOG = "partition int, offset bigint, key string, value string, headers map<string,string>, produced_at string"


class Log:
    def __init__(self, spark: SparkSession, root: str, topic: str, partitions: int) -> None:
        if partitions < 1:
            raise ValueError("a topic has at least one partition")
        self.partitions, self.table = partitions, Table(spark, root, topic, LOG, ["partition", "offset"])

    def high_watermarks(self) -> DataFrame:
        """``partition, high_watermark``: the offset that each partition's next record gets."""
        spark = self.table.spark
        each = spark.range(self.partitions).select(F.col("id").cast("int").alias("partition"))
        last = self.table.read().groupBy("partition").agg(F.max("offset").alias("last"))
        return each.join(last, "partition", "left").select("partition", (F.coalesce("last", F.lit(-1)) + 1).cast("long").alias("high_watermark"))

    def produce(self, records: DataFrame, order: list[str], produced_at: str, metadata: dict | None = None) -> int | None:
        """Append ``records(key, value[, headers])`` in order within each partition; the version, or None without records. A record without a key is an error."""
        key = F.coalesce("key", F.raise_error(F.lit("a record has no key")))
        r = records.withColumn("key", key).withColumn("partition", key_partition("key", self.partitions))
        if "headers" not in r.columns:
            r = r.withColumn("headers", F.lit(None).cast("map<string,string>"))
        place = F.row_number().over(Window.partitionBy("partition").orderBy(*order)) - 1
        placed = r.withColumn("__place", place).join(self.high_watermarks(), "partition")
        rows = placed.select("partition", (F.col("high_watermark") + F.col("__place")).cast("long").alias("offset"), "key", "value", "headers", F.lit(produced_at).alias("produced_at"))
        return self.table.append(rows, metadata)

    def fetch(self, offsets: DataFrame) -> DataFrame:
        """Records from an offset on in each partition: offsets(partition, next_offset); a partition that isn't named isn't read."""
        return self.table.read().join(F.broadcast(offsets.select("partition", "next_offset")), "partition").where(F.col("offset") >= F.col("next_offset")).drop("next_offset")

    def lag(self, offsets: DataFrame, consumer: str) -> DataFrame:
        """``consumer, partition, next_offset, high_watermark``, for ``consumer_lag``."""
        return self.high_watermarks().join(offsets, "partition", "left").select(F.lit(consumer).alias("consumer"), "partition", F.coalesce("next_offset", F.lit(0)).cast("long").alias("next_offset"), "high_watermark")
