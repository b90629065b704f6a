"""SQL over a lake: its tables and the views that derive from them, registered under their names.

What other systems keep up with triggers is derived here: run and event history, artifacts and coverage fingerprints are views over the event table, so that they can't lag or drift.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.operators.operations import field
from corpuslake.operators.reconcile import fingerprints
from corpuslake.sources.lake import Files, Table


def run_history(runs: DataFrame, deleted: DataFrame) -> DataFrame:
    """Each run that ever was, with when it was first recorded and first deleted; runs, deleted: crawl_run_id, config_digest, at (a run may recur)."""
    first = runs.groupBy("crawl_run_id").agg(F.min_by("config_digest", "at").alias("config_digest"), F.min("at").alias("created_at"))
    gone = deleted.groupBy("crawl_run_id").agg(F.min("at").alias("deleted_at"))
    return first.join(gone, "crawl_run_id", "left")


def event_history(events: DataFrame) -> DataFrame:
    """The first of each event_id by time: event_id, crawl_run_id, event_type, schema_version, dedupe_key, payload_sha256, created_at."""
    columns = ["crawl_run_id", "event_type", "schema_version", "dedupe_key", "payload_sha256", "created_at"]
    return events.groupBy("event_id").agg(F.min(F.struct("created_at", *[c for c in columns if c != "created_at"])).alias("e")).select("event_id", *[f"e.{c}" for c in columns])


def event_artifacts(events: DataFrame) -> DataFrame:
    """Files that events refer to: the body of a capture, both manifests of a publication; events: event_id, crawl_run_id, event_type, record_json."""
    kinds = (("capture_committed", "body_artifact", "body"), ("corpus_snapshot_published", "snapshot_manifest", "snapshot_manifest"), ("corpus_snapshot_published", "crawl_manifest", "crawl_manifest"))
    all_of = F.array(*[
        F.when((F.col("event_type") == t) & field(f"data.{f}").isNotNull(), F.struct(F.lit(k).alias("artifact_kind"), field(f"data.{f}.uri").alias("artifact_uri"), field(f"data.{f}.sha256").alias("sha256"), F.expr(f"try_cast(get_json_object(record_json, '$.data.{f}.byte_size') AS BIGINT)").alias("byte_size")))
        for t, f, k in kinds
    ])
    return events.select("event_id", "crawl_run_id", F.explode(F.array_compact(all_of)).alias("a")).select("event_id", "crawl_run_id", "a.*").distinct()


def event_coverage(history: DataFrame) -> DataFrame:
    """Number and order-free fingerprint of each run's events."""
    return fingerprints(history, ["crawl_run_id"], ["event_id", "event_type", "schema_version", "dedupe_key", "payload_sha256", "created_at"])


def register_views(spark: SparkSession, tables: Iterable[Table] = (), frames: dict[str, DataFrame] | None = None) -> list[str]:
    """Temporary views of the tables (empty ones with their schema) and of other frames; their names."""
    named = {t.name: t.read() for t in tables} | (frames or {})
    for name, df in named.items():
        df.createOrReplaceTempView(name)
    return sorted(named)


def register_folder(spark: SparkSession, folder: str) -> list[str]:
    """Views of every Parquet file or table (with a log) below a folder, by name."""
    files, out = Files(spark, folder), {}
    for name in files.names(folder):
        path = f"{folder.rstrip('/')}/{name}"
        if name.endswith(".parquet"):
            out[name.removesuffix(".parquet")] = spark.read.parquet(path)
        elif "_log" in files.names(path):
            t = Table(spark, folder, name, "x int", [])
            live = [f"{t.root}/{d}" for d in t.live()]
            if live:
                out[name] = spark.read.parquet(*live)
    return register_views(spark, frames=out)


def run_sql(spark: SparkSession, sql: str | None = None, file: str | None = None) -> DataFrame:
    """One statement, given as text or as a file that Spark reads."""
    if (sql is None) == (file is None):
        raise ValueError("give either text or a file")
    text = sql if sql is not None else spark.read.text(file, wholetext=True).first()[0]
    return spark.sql(text.strip().rstrip(";"))
