"""Operational events, crawl runs and durable-event status.

``log``: snapshot_id, batch_id, record_id, source_id, record_json (event, outcome, component, timestamp, run_id, data.task_id, data.task_attempt, data.source_id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.operators.history import at, only_top, ratio


def field(path: str, column: str = "record_json") -> Column:
    return F.get_json_object(column, f"$.{path}")


def operational_summary(log: DataFrame) -> DataFrame:
    """Counts by event, outcome and component; a record that several batches replay counts once, and history.* events not at all."""
    once = only_top(log.where(~field("event").startswith("history.")), ["snapshot_id", "record_id"], [F.col("batch_id")])
    e = once.select(
        "snapshot_id", field("run_id").alias("run_id"), F.coalesce("source_id", field("data.source_id")).alias("source_id"), field("event").alias("event_name"), field("outcome").alias("outcome"),
        field("component").alias("component"), field("timestamp").alias("event_at"), field("data.task_id").alias("task_id"), F.expr("try_cast(get_json_object(record_json, '$.data.task_attempt') AS BIGINT)").alias("attempt"),
    )
    again = F.col("attempt") > 1
    return e.groupBy("snapshot_id", "run_id", "source_id", "event_name", "outcome", "component").agg(
        F.count("*").alias("event_count"),
        F.countDistinct("task_id").alias("distinct_task_count"),
        F.count_if(again).alias("retry_claim_event_count"),
        F.countDistinct(F.when(again, F.col("task_id"))).alias("retried_task_count"),
        F.min("event_at").alias("first_event_at"),
        F.max("event_at").alias("last_event_at"),
        F.count_if(F.col("outcome").isin("failure", "error")).alias("failure_outcome_count"),
    )


def crawl_runs(batches: DataFrame, manifests: DataFrame) -> DataFrame:
    """Summary and duration of each complete batch's crawl manifest; batches: batch_id, snapshot_id, status, operational_log_present."""
    m = manifests.select(
        "batch_id", field("run_id").alias("run_id"), field("started_at_utc").alias("started_at"), field("completed_at_utc").alias("completed_at"), field("summary.stop_reason").alias("stop_reason"),
        *[F.expr(f"try_cast(get_json_object(record_json, '$.summary.{c}') AS BIGINT)").alias(c) for c in ("captured_page_count", "page_count", "alias_count", "passage_count", "rejected_count", "failed_count")],
    )
    out = batches.where("status = 'complete'").join(m, "batch_id")
    return out.withColumn("crawl_duration_seconds", F.unix_timestamp(at("completed_at")) - F.unix_timestamp(at("started_at")))


def effectiveness(runs: DataFrame, summary: DataFrame) -> DataFrame:
    """Ratios per task claim; a count whose event type never occurred is unknown, so null."""
    name, n = F.col("event_name"), F.col("event_count")
    total = lambda x: F.sum(F.when(name == x, n).otherwise(0))
    seen = lambda x: F.max(F.when(name == x, 1).otherwise(0))
    e = summary.groupBy("snapshot_id").agg(
        total("task.claimed").alias("claims"), F.when(seen("capture.accepted") == 1, total("capture.accepted")).alias("capture_accept_event_count"),
        F.when(seen("worker.task_failed") == 1, total("worker.task_failed")).alias("worker_task_failure_event_count"), F.when(seen("page.rejected") == 1, total("page.rejected")).alias("page_rejected_event_count"),
        F.sum("retry_claim_event_count").alias("retries"), F.sum("retried_task_count").alias("retried"),
    )
    some = F.col("claims") > 0
    return runs.join(e, "snapshot_id", "left").select(
        *runs.columns, F.when(some, F.col("claims")).alias("task_claim_attempts"), "capture_accept_event_count", "worker_task_failure_event_count", "page_rejected_event_count",
        F.when(some, F.col("retries")).alias("retry_claim_event_count"), F.when(some, F.col("retried")).alias("retried_task_count"),
        F.when(some, ratio("captured_page_count", "claims")).alias("captured_pages_per_task_claim"), F.when(some, ratio("failed_count", "claims")).alias("fetch_failures_per_task_claim"),
        F.when(F.col("crawl_duration_seconds") > 0, 60.0 * ratio("page_count", "crawl_duration_seconds")).alias("pages_per_minute"),
        F.when(~F.col("operational_log_present"), "operational log absent").when(F.col("operational_log_present").isNull(), "operational log availability unknown")
        .when(F.coalesce("claims", F.lit(0)) == 0, "no claims; attempts unknown").otherwise("task claim count").alias("attempt_denominator_status"),
    )


def error_rates(summary: DataFrame) -> DataFrame:
    """Failed outcomes as a percentage of observed operational events."""
    out = summary.groupBy("snapshot_id", "source_id").agg(
        F.sum("event_count").alias("observed_event_count"),
        F.sum("failure_outcome_count").alias("failed_outcome_event_count"),
        *[F.sum(F.when(F.col("event_name") == e, F.col("event_count")).otherwise(0)).alias(c) for e, c in (("fetch.failed", "fetch_failed_event_count"), ("worker.task_failed", "worker_task_failed_event_count"), ("page.rejected", "page_rejected_event_count"))],
    )
    return out.withColumn("failed_outcome_percent", 100.0 * ratio("failed_outcome_event_count", "observed_event_count"))


def ingestion_metrics(attempts: DataFrame, runs: DataFrame) -> DataFrame:
    """Ingestion attempts beside the crawl run of their batch."""
    return attempts.join(runs.select("batch_id", "run_id", "stop_reason"), "batch_id", "left")


# ------------------------------------------------------------ durable events
def committed_events(records: DataFrame, batches: DataFrame) -> DataFrame:
    """Accepted or re-delivered events of complete batches; records: batch_id, crawl_run_id, event_id, event_type, source_id, event_at, record_json, disposition, first_seen_at."""
    done = batches.where("status = 'complete'").select("batch_id")
    return records.where(F.col("disposition").isin("accepted", "duplicate")).join(done, "batch_id", "left_semi")


def run_status(records: DataFrame, batches: DataFrame, quarantine: DataFrame, as_of: str) -> DataFrame:
    """What the durable events say about each run so far."""
    e = committed_events(records, batches)
    pick = lambda kind, path: F.max(F.when(F.col("event_type") == kind, field(f"data.{path}")))
    capture = F.col("event_type") == "capture_committed"
    lag = F.unix_timestamp(at("first_seen_at")) - F.unix_timestamp(at("event_at"))
    per_run = e.groupBy("crawl_run_id").agg(
        F.countDistinct(F.when(capture, F.col("event_id"))).alias("capture_count"), F.countDistinct(F.when(capture, F.col("source_id"))).alias("source_count"),
        F.min("event_at").alias("first_event_at"), F.max("event_at").alias("last_event_at"), F.max(lag).alias("max_ingestion_lag_seconds"),
        pick("crawl_completed", "stop_reason").alias("stop_reason"), pick("corpus_snapshot_published", "snapshot_id").alias("published_snapshot_id"),
    )
    held = quarantine.groupBy("crawl_run_id").agg(F.count("*").alias("quarantined_record_count"))
    out = batches.select("crawl_run_id").distinct().join(per_run, "crawl_run_id", "left").join(held, "crawl_run_id", "left")
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("capture_count", "source_count", "quarantined_record_count")}
    return out.withColumns(zero).withColumn("last_event_age_seconds", F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(at("last_event_at"))).withColumn("evidence_status", F.when(F.col("published_snapshot_id").isNull(), "provisional").otherwise("snapshot_publication_event_seen"))


def source_captures(records: DataFrame, batches: DataFrame, as_of: str) -> DataFrame:
    e = committed_events(records, batches).where("event_type = 'capture_committed'")
    return e.groupBy("crawl_run_id", "source_id").agg(F.countDistinct("event_id").alias("capture_count"), F.min("event_at").alias("first_capture_at"), F.max("event_at").alias("last_capture_at")).withColumn(
        "last_capture_age_seconds", F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(at("last_capture_at"))
    )


def ingestion_status(batches: DataFrame, attempts: DataFrame) -> DataFrame:
    """Each batch with its latest attempt; attempts: batch_id, attempt_id, started_at, execution_millis."""
    last = only_top(attempts, ["batch_id"], [F.col("started_at").desc(), F.col("attempt_id").desc()])
    return batches.join(last.select("batch_id", "attempt_id", "execution_millis"), "batch_id", "left").withColumn("pending", F.when(F.col("status") == "complete", 0).otherwise(1))


def trailing_rates(events: DataFrame, time: str, as_of: str, windows: tuple[int, ...] = (60, 300), elapsed: int | None = None) -> DataFrame:
    """Events per second within trailing windows, over min(window, elapsed) seconds."""
    spark = events.sparkSession
    now = F.lit(as_of).cast("timestamp")
    age = F.unix_timestamp(now) - F.unix_timestamp(F.col(time).cast("timestamp"))
    recent = events.select(age.alias("age")).where(f"age >= 0 AND age < {max(windows)}")
    w = spark.createDataFrame([(x,) for x in windows], "window_seconds int")
    out = recent.crossJoin(F.broadcast(w)).groupBy("window_seconds").agg(F.count_if(F.col("age") < F.col("window_seconds")).alias("n"))
    out = F.broadcast(w).join(out, "window_seconds", "left").withColumn("event_count", F.coalesce("n", F.lit(0)).cast("long"))
    return out.select("window_seconds", "event_count", (F.col("event_count") / F.least(F.col("window_seconds"), F.lit(elapsed if elapsed is not None else 2**31 - 1))).alias("per_second"))


def dashboard(tasks: DataFrame, limit: int, offset: int) -> DataFrame:
    """A page of tasks with counts by status beside them: paging keeps (offset, limit) after a total order."""
    counts = tasks.agg(*[F.count_if(F.col("status") == s).alias(f"{s}_count") for s in ("pending", "leased", "succeeded", "failed")])
    page = tasks.orderBy("task_id").offset(offset).limit(limit)
    return page.crossJoin(F.broadcast(counts))


def run_dashboard(tasks: DataFrame, attempts: DataFrame, permits: DataFrame, as_of: str, windows: tuple[int, ...] = (60, 300), leases: int = 20) -> DataFrame:
    """One row of each run: ``tasks, outcomes, permits`` (counts by status, as maps), ``rates`` (finished attempts per second in trailing windows, over the run's age where that is less, as a map by seconds), ``leased``
    (how many) and ``oldest_leases`` (the first ``leases`` of them by deadline: a page of the report, as ordered structs).

    tasks: crawl_run_id, task_id, status, lease_owner, lease_deadline; attempts: crawl_run_id, outcome, finished_at; permits: crawl_run_id, status.
    """
    run = "crawl_run_id"

    def counts(df: DataFrame, column: str, out: str) -> DataFrame:
        n = df.groupBy(run, column).agg(F.count("*").alias("n"))
        return n.groupBy(run).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(column, "n")))).alias(out))

    age = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(F.col("finished_at").cast("timestamp"))
    a = attempts.withColumn("age", age).where("age >= 0")
    per = lambda w: F.count_if(F.col("age") < w).cast("double") / F.greatest(F.lit(1), F.least(F.lit(w), F.max("age")))
    rates = a.groupBy(run).agg(F.map_from_arrays(F.array(*map(F.lit, windows)), F.array(*[per(w) for w in windows])).alias("rates"))
    held = tasks.where("status = 'leased'")
    first = held.withColumn("r", F.row_number().over(Window.partitionBy(run).orderBy("lease_deadline", "task_id"))).where(F.col("r") <= leases)
    listed = first.groupBy(run).agg(F.array_sort(F.collect_list(F.struct("lease_deadline", "task_id", "lease_owner"))).alias("oldest_leases"))
    out = counts(tasks, "status", "tasks").join(held.groupBy(run).agg(F.count("*").alias("leased")), run, "left").withColumn("leased", F.coalesce("leased", F.lit(0)).cast("long"))
    for x in (counts(attempts, "outcome", "outcomes"), counts(permits, "status", "permits"), rates, listed):
        out = out.join(x, run, "left")
    return out


def counter_increase(samples: DataFrame, series: list[str], time: str, value: str, seconds: int) -> DataFrame:
    """Increase of counters over a trailing range at each sample: sums of positive steps, where a fall is a reset to zero."""
    w = Window.partitionBy(*series).orderBy(time)
    step = F.when(F.lag(value).over(w).isNull(), F.lit(0.0)).when(F.col(value) >= F.lag(value).over(w), F.col(value) - F.lag(value).over(w)).otherwise(F.col(value))
    stepped = samples.withColumn("__step", step.cast("double")).withColumn("__t", F.unix_timestamp(F.col(time).cast("timestamp")))
    inside = Window.partitionBy(*series).orderBy("__t").rangeBetween(-seconds, 0)
    return stepped.withColumn("increase", F.sum("__step").over(inside)).withColumn("rate", F.col("increase") / seconds).withColumn("max_over_time", F.max(value).over(inside)).drop("__step", "__t")


def held_for(samples: DataFrame, series: list[str], time: str, condition: Column, seconds: int) -> DataFrame:
    """Whether a condition has held without a break for so long: the length of the current run of true samples."""
    w = Window.partitionBy(*series).orderBy(time)
    s = samples.withColumn("__on", F.coalesce(condition, F.lit(False))).withColumn("__run", F.sum(F.when(F.col("__on"), 0).otherwise(1)).over(w))
    start = F.min(F.when(F.col("__on"), F.col(time))).over(Window.partitionBy(*series, "__run"))
    return s.withColumn("firing", F.col("__on") & (F.unix_timestamp(F.col(time).cast("timestamp")) - F.unix_timestamp(start.cast("timestamp")) >= seconds)).drop("__on", "__run")


def gauge_delta(samples: DataFrame, series: list[str], time: str, value: str, seconds: int) -> DataFrame:
    """Change of gauges over a trailing range at each sample: ``delta``, the sample minus the first within the range."""
    s = samples.withColumn("__t", F.unix_timestamp(F.col(time).cast("timestamp")))
    inside = Window.partitionBy(*series).orderBy("__t").rangeBetween(-seconds, 0)
    return s.withColumn("delta", F.col(value) - F.first(value).over(inside)).drop("__t")


def count_up(samples: DataFrame, job: list[str], instance: str, time: str, up: Column, as_of: str, stale: int = 300) -> DataFrame:
    """Instances of each job whose last sample, not older than ``stale`` seconds, is up: ``up_count``; jobs without any fresh sample are absent."""
    now = F.unix_timestamp(F.lit(as_of).cast("timestamp"))
    fresh = samples.withColumn("__age", now - F.unix_timestamp(F.col(time).cast("timestamp"))).where(f"__age >= 0 AND __age <= {stale}")
    last = only_top(fresh.withColumn("__up", F.coalesce(up, F.lit(False))), [*job, instance], [F.col("__age")])
    return last.groupBy(*job).agg(F.count_if("__up").alias("up_count"))


def and_on(left: DataFrame, right: DataFrame, labels: list[str]) -> DataFrame:
    """Rows of the left side for whose labels the right side has any row."""
    return left.join(right.select(*labels).distinct(), labels, "left_semi")
