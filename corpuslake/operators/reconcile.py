"""Event and snapshot reconciliation: which durable events a validated snapshot confirms.

``events``: committed events (crawl_run_id, event_id, event_type, source_id, record_json).
``snapshots``: one row per complete ingested batch (crawl_run_id, snapshot_id, batch_id, snapshot_sha, crawl_sha, crawl_bytes, page_count, alias_count,
passage_count, capture_count, manifest_ok).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.operators.operations import field

BINDING = ("snapshot_sha", "crawl_sha", "crawl_bytes", "page_count", "alias_count", "passage_count")


def complete_events(identity: DataFrame, records: DataFrame, batches: DataFrame) -> DataFrame:
    """Identities confirmed by any exact replay whose own batch completed, not by the batch that first brought them."""
    done = batches.where("status = 'complete'").select("batch_id", "crawl_run_id")
    good = records.where(F.col("disposition").isin("accepted", "duplicate")).join(done, ["batch_id", "crawl_run_id"], "left_semi")
    return identity.join(good.select("crawl_run_id", "event_id", "event_type", "record_json"), ["crawl_run_id", "event_id", "event_type", "record_json"], "left_semi").select("crawl_run_id", "event_id", "event_type", "source_id", "record_json").distinct()


def publications(events: DataFrame) -> DataFrame:
    big = lambda p: F.expr(f"try_cast(get_json_object(record_json, '$.data.{p}') AS BIGINT)")
    return events.where("event_type = 'corpus_snapshot_published'").select(
        "crawl_run_id", "event_id", field("data.snapshot_id").alias("snapshot_id"), field("data.snapshot_manifest.sha256").alias("snapshot_sha"), field("data.crawl_manifest.sha256").alias("crawl_sha"),
        big("crawl_manifest.byte_size").alias("crawl_bytes"), big("page_count").alias("page_count"), big("alias_count").alias("alias_count"), big("passage_count").alias("passage_count"),
    ).distinct()


def authority(events: DataFrame, snapshots: DataFrame, runs: DataFrame) -> DataFrame:
    """``crawl_run_id, snapshot_id, capture_event_count, expected_capture_count, matching_publications, publications_seen, authority_status``.

    Three cases: snapshots, judged by a ladder; publication events without a snapshot; runs with neither.
    """
    meta = F.to_json(F.struct(*BINDING, "capture_count"), {"ignoreNullFields": "false"})
    s = snapshots.where("crawl_run_id IS NOT NULL").groupBy("crawl_run_id", "snapshot_id").agg(
        *[F.min(c).alias(c) for c in BINDING], F.min("capture_count").alias("expected_capture_count"), F.countDistinct(meta).alias("variants"), F.min(F.when(F.col("manifest_ok"), 1).otherwise(0)).alias("ok")
    )
    pub = publications(events)
    task = F.expr("try_cast(get_json_object(record_json, '$.data.task_id') AS BIGINT)")
    cap = events.where("event_type = 'capture_committed'").select("crawl_run_id", "event_id", task.alias("task_id")).distinct()
    cap = cap.groupBy("crawl_run_id").agg(F.countDistinct("event_id").alias("capture_event_count"), F.countDistinct("task_id").alias("tasks"), F.count_if(F.col("task_id").isNull()).alias("taskless"))
    seen = pub.groupBy("crawl_run_id", "snapshot_id").agg(F.countDistinct("event_id").alias("publications_seen"))
    match = pub.join(s.select("crawl_run_id", "snapshot_id", *BINDING), ["crawl_run_id", "snapshot_id", *BINDING], "left_semi").groupBy("crawl_run_id", "snapshot_id").agg(F.countDistinct("event_id").alias("matching_publications"))
    judged = s.join(match, ["crawl_run_id", "snapshot_id"], "left").join(seen, ["crawl_run_id", "snapshot_id"], "left").join(cap, "crawl_run_id", "left").na.fill(0, ["matching_publications", "publications_seen", "capture_event_count", "tasks", "taskless"])
    n, want = F.col("capture_event_count"), F.col("expected_capture_count")
    status = (
        F.when(F.col("variants") != 1, "snapshot_metadata_conflict")
        .when(F.col("ok") != 1, "snapshot_manifest_mismatch")
        .when((F.col("matching_publications") == 0) & (F.col("publications_seen") > 0), "publication_binding_mismatch")
        .when(F.col("matching_publications") == 0, "awaiting_publication_event")
        .when(n < want, "awaiting_capture_events")
        .when((n > want) | (F.col("tasks") != n) | (F.col("taskless") > 0), "capture_event_count_mismatch")
        .otherwise("authoritative")
    )
    columns = ["crawl_run_id", "snapshot_id", "capture_event_count", "expected_capture_count", "matching_publications", "publications_seen", "authority_status"]
    first = judged.withColumn("authority_status", status).select(columns)
    zero = F.lit(0).cast("long")
    lone = seen.join(s, ["crawl_run_id", "snapshot_id"], "left_anti").join(cap, "crawl_run_id", "left").select(
        "crawl_run_id", "snapshot_id", F.coalesce("capture_event_count", zero).alias("capture_event_count"), F.lit(None).cast("long").alias("expected_capture_count"), zero.alias("matching_publications"), "publications_seen",
        F.lit("awaiting_validated_snapshot_batch").alias("authority_status"),
    )
    none = runs.select("crawl_run_id").distinct().join(s, "crawl_run_id", "left_anti").join(pub, "crawl_run_id", "left_anti").select(
        "crawl_run_id", F.lit(None).cast("string").alias("snapshot_id"), zero.alias("capture_event_count"), F.lit(None).cast("long").alias("expected_capture_count"), zero.alias("matching_publications"), zero.alias("publications_seen"),
        F.lit("provisional_no_validated_snapshot").alias("authority_status"),
    )
    return first.unionByName(lone).unionByName(none)


def authoritative(history: DataFrame, judged: DataFrame) -> DataFrame:
    """History rows (pages or aliases) of authoritative snapshots, with their run."""
    return history.join(judged.where("authority_status = 'authoritative'").select("crawl_run_id", "snapshot_id"), "snapshot_id")


def capture_outcomes(events: DataFrame, judged: DataFrame, manifest_pages: DataFrame, operations: DataFrame, pages: DataFrame, aliases: DataFrame) -> DataFrame:
    """What became of each capture event: admitted, alias, superseded, ambiguous or unmatched.

    manifest_pages: crawl_run_id, snapshot_id, source_id, requested_url, page_id, capture_id, selected_capture_id, admission_status, alias_of, body_sha256, content_sha256;
    operations: crawl_run_id, snapshot_id, task_id, source_id, requested_url, body_sha256 of accepted captures.
    """
    task = F.expr("try_cast(get_json_object(record_json, '$.data.task_id') AS BIGINT)")
    e = events.where("event_type = 'capture_committed'").select("crawl_run_id", "event_id", task.alias("task_id"), "source_id", field("data.content_sha256").alias("content_sha256"), field("data.body_artifact.sha256").alias("body_sha256")).distinct()
    sure = judged.where("authority_status = 'authoritative'").select("crawl_run_id", "snapshot_id")
    m = manifest_pages.join(sure, ["crawl_run_id", "snapshot_id"], "left_semi").distinct()
    chosen = m.select("crawl_run_id", "snapshot_id", "source_id", F.col("capture_id").alias("selected_capture_id"), F.col("alias_of").alias("chosen_alias_of"), F.col("page_id").alias("chosen_page_id"))
    m = m.join(chosen, ["crawl_run_id", "snapshot_id", "source_id", "selected_capture_id"], "left").withColumn("representative_page_id", F.coalesce("alias_of", "chosen_alias_of", "chosen_page_id", "page_id"))
    run = ["crawl_run_id", "snapshot_id", "source_id"]
    found = (
        e.join(sure, "crawl_run_id")
        .join(operations.distinct(), [*run, "task_id", "body_sha256"])
        .join(m.distinct(), [*run, "requested_url", "body_sha256", "content_sha256"])
        .join(pages.select("snapshot_id", "source_id", F.col("page_id").alias("representative_page_id")).distinct(), ["snapshot_id", "source_id", "representative_page_id"], "left_semi")
        .join(aliases.select("snapshot_id", "source_id", F.col("alias_page_id").alias("page_id"), "representative_page_id", F.lit(True).alias("is_alias")).distinct(), ["snapshot_id", "source_id", "page_id", "representative_page_id"], "left")
        .where("admission_status <> 'exact-alias' OR is_alias")
    )
    key = F.to_json(F.struct("capture_id", "source_id", "requested_url", "body_sha256"), {"ignoreNullFields": "false"})
    found = found.groupBy("crawl_run_id", "snapshot_id", "event_id").agg(F.countDistinct(key).alias("candidates"), *[F.max(c).alias(c) for c in ("capture_id", "requested_url", "admission_status", "representative_page_id")])
    out = e.join(judged.select("crawl_run_id", "snapshot_id", "authority_status"), "crawl_run_id", "left").join(found, ["crawl_run_id", "snapshot_id", "event_id"], "left")
    kind = F.col("admission_status")
    status = (
        F.when(F.coalesce(F.col("authority_status") != "authoritative", F.lit(True)), "provisional_snapshot_or_capture_gate")
        .when(F.col("candidates").isNull(), "provisional_unmatched")
        .when(F.col("candidates") != 1, "provisional_ambiguous")
        .when(kind == "admitted", "authoritative_admitted")
        .when(kind == "exact-alias", "authoritative_alias")
        .when(kind == "superseded-capture", "authoritative_superseded")
        .otherwise("provisional_unknown_admission")
    )
    return out.withColumn("reconciliation_status", status).withColumn("canonical_page_id", F.when(F.col("candidates") == 1, F.col("representative_page_id")))


def rejected_tasks(log: DataFrame, judged: DataFrame) -> DataFrame:
    """Rejections of reconciled runs; log: crawl_run_id, snapshot_id, record_id, record_json."""
    task = F.expr("try_cast(get_json_object(record_json, '$.data.task_id') AS BIGINT)")
    r = log.where(field("event") == "page.rejected").join(judged.select("crawl_run_id", "snapshot_id", "authority_status"), ["crawl_run_id", "snapshot_id"])
    return r.select(
        "crawl_run_id", "snapshot_id", "record_id", task.alias("task_id"), field("data.source_id").alias("source_id"), field("data.url").alias("requested_url"), field("data.rejection_reason").alias("rejection_reason"),
        F.when(F.col("authority_status") == "authoritative", "authoritative_rejected_task").otherwise("provisional_rejected_task").alias("reconciliation_status"),
    ).distinct()


# ------------------------------------------------------------ replay equality and fingerprints
def multiset_difference(left: DataFrame, right: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose number differs between two tables: ``row_json, left_count, right_count``. One aggregate over the counted union; null equals null."""
    columns = [c for c in left.columns if c not in exclude]
    as_json = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("row_json")
    both = left.select(as_json, F.lit(1).alias("l"), F.lit(0).alias("r")).unionAll(right.select(as_json, F.lit(0), F.lit(1)))
    return both.groupBy("row_json").agg(F.sum("l").alias("left_count"), F.sum("r").alias("right_count")).where("left_count <> right_count")


def replay_verdicts(baseline: dict[str, DataFrame], replay: dict[str, DataFrame], exclude: dict[str, tuple[str, ...]] | None = None) -> list[dict]:
    """For each table whether a replay equals the baseline as a multiset of rows; columns that exist in one only make it unequal."""
    out = []
    for name in sorted(baseline.keys() | replay.keys()):
        a, b = baseline.get(name), replay.get(name)
        if a is None or b is None or set(a.columns) != set(b.columns):
            out.append({"table": name, "equal": False, "differing_rows": None})
            continue
        n = multiset_difference(a, b.select(a.columns), (exclude or {}).get(name, ())).count()
        out.append({"table": name, "equal": n == 0, "differing_rows": n})
    return out


def fingerprints(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """An order-free checksum of each group: four 64-bit slices of the rows' SHA-256, combined by exclusive or, and their count."""
    row = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]), 256)
    part = lambda i: F.conv(F.substring(row, 16 * i + 1, 16), 16, -10).cast("bigint")
    return df.groupBy(*keys).agg(F.count("*").alias("row_count"), *[F.bit_xor(part(i)).alias(f"fingerprint_{i}") for i in range(4)])


def fingerprint_check(live: DataFrame, recorded: DataFrame, keys: list[str]) -> DataFrame:
    """Groups whose recorded fingerprint is not the live one."""
    values = ["row_count", *[f"fingerprint_{i}" for i in range(4)]]
    same = None
    for v in values:
        eq = F.col(f"l.{v}").eqNullSafe(F.col(f"r.{v}"))
        same = eq if same is None else same & eq
    on = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    return recorded.alias("r").join(live.alias("l"), on, "left").where(~same).select("r.*")
