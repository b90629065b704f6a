"""The event reducer as a stream: at-least-once delivery, idempotent effect.

Lines arrive in files (any text source will do in place of a message log). Each micro-batch types its events, quarantines what is malformed, and merges the
rest into a table whose key is the event's identity; a replayed batch, a replayed file or a restart inserts nothing twice. There is no
watermark on identity: late duplicates are ignored, late conflicts are quarantined. State is the table itself, bounded by runs.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from corpuslake.operators.quality import split_events
from corpuslake.sources.batches import shape_event
from corpuslake.sources.lake import Table

EVENTS = "crawl_run_id string, event_id string, event_type string, source_id string, event_at string, payload_sha256 string, record_json string"
EFFECTS = f"effect_key string, {EVENTS}, problem string, disposition string"


class Reduced:
    """One table of effects: accepted events and held lines of a micro-batch are one commit, so that no reader sees one without the other."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.table = Table(spark, root, "crawl_event_effects", EFFECTS, ["effect_key"])

    def events(self) -> DataFrame:
        return self.table.read().where("disposition = 'accepted'").drop("effect_key", "problem", "disposition")

    def held(self) -> DataFrame:
        return self.table.read().where("disposition <> 'accepted'").drop("effect_key")

    def version(self) -> int:
        return self.table.version()


def reduce_batch(batch: DataFrame, into: Reduced, metadata: dict, run: str | None = None) -> dict[str, int]:
    """Effects of one micro-batch, committed at once; running it again changes nothing. With ``run``, events of other runs are skipped."""
    typed = shape_event(batch.select("record_json")).withColumn("line", F.sha2("record_json", 256))
    typed = typed.where(F.coalesce(F.col("crawl_run_id") == run, F.lit(True))) if run is not None else typed
    split = split_events(typed, into.events().select("crawl_run_id", "event_id", "payload_sha256")).where("disposition <> 'duplicate'")
    key = F.when(F.col("disposition") == "accepted", F.concat_ws("/", F.lit("e"), "crawl_run_id", "event_id")).otherwise(F.concat_ws("/", F.lit("q"), "line"))
    _, n = into.table.merge_insert(split.withColumn("effect_key", key).select([f.name for f in into.table.schema.fields]), metadata)
    return {"effects": n}


def run_reduce(
    spark: SparkSession, source: str, root: str, follow: bool = False, max_files: int = 100, max_bytes: str | None = None, run: str | None = None, until: str | None = "corpus_snapshot_published", seconds: float | None = None, every: str = "1 second"
) -> Reduced:
    """Reduce what is there and stop; or follow until the run's terminal event (``until``, of ``run``) has been reduced or so many ``seconds`` are over. A micro-batch takes at most ``max_files`` files or
    ``max_bytes``. The checkpoint keeps which files are done; effects are keyed by identity, not by batch id, and are flushed before the checkpoint moves on."""
    into = Reduced(spark, root)
    limit = {"maxBytesPerTrigger": max_bytes} if max_bytes else {"maxFilesPerTrigger": max_files}
    stream = spark.readStream.schema("value string").options(**limit).format("text").load(source).withColumnRenamed("value", "record_json")

    def each(batch: DataFrame, number: int) -> None:
        reduce_batch(batch, into, {"batch": str(number), "input_kind": "events"}, run)

    def over() -> bool:
        return until is not None and bool(into.events().where((F.col("event_type") == until) & (F.lit(run is None) | (F.col("crawl_run_id") == run))).head(1))

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{root}/_checkpoint")
    running = (writer.trigger(processingTime=every) if follow else writer.trigger(availableNow=True)).start()
    end = time.monotonic() + seconds if seconds is not None else None
    if follow:
        while running.isActive and not over() and (end is None or time.monotonic() < end):
            running.awaitTermination(1)
        running.stop()
    else:
        running.awaitTermination()
    if running.exception() is not None:
        raise running.exception()
    return into


def next_batch(pending: DataFrame, max_records: int = 128, max_bytes: int = 1 << 20, terminal: str = "corpus_snapshot_published") -> DataFrame:
    """The next micro-batch of each run: its pending events in order (created_at, event_id) up to so many records and bytes, ending with the first terminal event.

    pending: crawl_run_id, event_id, event_type, created_at, size. An event above ``max_bytes`` by itself is marked ``quarantine`` and takes no room.
    """
    order = Window.partitionBy("crawl_run_id").orderBy("created_at", "event_id")
    first = pending.withColumn("n", F.row_number().over(order)).where(F.col("n") <= max_records)
    large = F.col("size") > max_bytes
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    taken = first.withColumn("quarantine", large).withColumn("bytes", F.sum(F.when(large, 0).otherwise(F.col("size"))).over(so_far)).withColumn("ended", F.coalesce(F.max((F.col("event_type") == terminal).cast("int")).over(before), F.lit(0)))
    return taken.where((F.col("bytes") <= max_bytes) & (F.col("ended") == 0)).drop("n", "bytes", "ended")


def seal(spark: SparkSession, reduced: Reduced, results: DataFrame, sealed: Table) -> int:
    """Seal each run that is complete (see ``completed_runs``), once: a row of ``sealed(crawl_run_id, event_count)``; the number of new seals."""
    done = completed_runs(reduced.events(), results)
    counts = reduced.events().groupBy("crawl_run_id").agg(F.count("*").alias("event_count"))
    return sealed.merge_insert(done.join(counts, "crawl_run_id").select("crawl_run_id", "event_count"), {"input_kind": "seal"})[1]


def completed_runs(events: DataFrame, results: DataFrame) -> DataFrame:
    """Runs to seal: a completion was seen and no expected result is missing; results: crawl_run_id, event_id expected."""
    done = events.where("event_type = 'crawl_completed'").select("crawl_run_id").distinct()
    lacking = results.join(events.select("crawl_run_id", "event_id"), ["crawl_run_id", "event_id"], "left_anti").select("crawl_run_id").distinct()
    return done.join(lacking, "crawl_run_id", "left_anti")


def parity(replica: DataFrame, live: DataFrame) -> DataFrame:
    """Snapshots whose replica differs: id, page and alias counts."""
    r = replica.select("snapshot_id", F.col("page_count").alias("p"), F.col("alias_count").alias("a"))
    return live.join(r, "snapshot_id", "full").where("NOT (page_count <=> p AND alias_count <=> a)").select("snapshot_id")


def consumer_lag(offsets: DataFrame) -> DataFrame:
    """max(0, high watermark - next offset) by topic and partition, and in all."""
    return offsets.withColumn("lag", F.greatest(F.lit(0), F.col("high_watermark") - F.col("next_offset"))).groupBy("consumer").agg(F.sum("lag").alias("lag"), F.max("lag").alias("largest_lag"))


def keyed_deduplicate(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """An optional bounded-state variant: duplicates within a watermark are dropped by the engine's own state (event_time timestamp)."""
    return stream.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["crawl_run_id", "event_id"])


class Progress(StreamingQueryListener):
    """Rows and backlog of each micro-batch, for lag metrics."""

    def __init__(self) -> None:
        self.batches: list[dict] = []

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self.batches.append({"batch": event.progress.batchId, "rows": event.progress.numInputRows})

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass
