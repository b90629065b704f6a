"""Snapshot history: changes, presence, freshness, coverage and duplicate rates.

Inputs are DataFrames of these shapes (times are RFC 3339 text, parsed where they are ordered):
``pages``: snapshot_id, source_id, page_id, url, content_sha256, scope, contract, observed_at.
``sources``: snapshot_id, source_id, scope, contract, observed_at, page_count, stop_reason, failed_count, rejected_count.
``evidence``: snapshot_id, source_id, page_id ('' for a whole source), kind (tombstone | coverage), scope, complete, expected_page_count, evidence_at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def at(column: str | Column) -> Column:
    """A time that orders; malformed text is null rather than an error."""
    return F.try_to_timestamp(F.col(column) if isinstance(column, str) else column)


def only_top(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; Spark prunes it as a window group limit."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def ratio(a: Column | str, b: Column | str, digits: int | None = None) -> Column:
    """a / b, null where b is zero."""
    out = F.try_divide((F.col(a) if isinstance(a, str) else a).cast("double"), (F.col(b) if isinstance(b, str) else b).cast("double"))
    return out if digits is None else F.round(out, digits)


# ------------------------------------------------------------ changes between snapshots of a source
def snapshot_changes(pages: DataFrame) -> DataFrame:
    """Each source's snapshot against the one before it that contains the source. First: no previous, all pages added, rates null."""
    w = Window.partitionBy("source_id").orderBy(at("observed_at"), "snapshot_id")
    chain = pages.groupBy("source_id", "snapshot_id").agg(F.min("observed_at").alias("observed_at")).withColumn("previous_snapshot_id", F.lag("snapshot_id").over(w))
    new = chain.join(pages.select("source_id", "snapshot_id", "page_id", F.col("content_sha256").alias("new_sha")), ["source_id", "snapshot_id"]).select("source_id", "snapshot_id", "page_id", "new_sha", F.lit(None).cast("string").alias("old_sha"))
    old = chain.join(
        pages.select("source_id", F.col("snapshot_id").alias("previous_snapshot_id"), "page_id", F.col("content_sha256").alias("old_sha")), ["source_id", "previous_snapshot_id"]
    ).select("source_id", "snapshot_id", "page_id", F.lit(None).cast("string").alias("new_sha"), "old_sha")
    both = new.unionByName(old).groupBy("source_id", "snapshot_id", "page_id").agg(F.max("new_sha").alias("new_sha"), F.max("old_sha").alias("old_sha"))
    counted = both.groupBy("source_id", "snapshot_id").agg(
        F.count("new_sha").alias("page_count"),
        F.count_if(F.col("old_sha").isNull()).alias("added"),
        F.count_if(F.col("new_sha").isNull()).alias("removed"),
        F.count_if(F.col("new_sha") != F.col("old_sha")).alias("changed"),
        F.count_if(F.col("new_sha") == F.col("old_sha")).alias("unchanged"),
    )
    known = F.col("previous_snapshot_id").isNotNull()
    return chain.select("source_id", "snapshot_id", "previous_snapshot_id").join(counted, ["source_id", "snapshot_id"]).select(
        "*",
        F.when(known, ratio("changed", F.col("changed") + F.col("unchanged"))).alias("change_rate"),
        F.when(known, ratio(F.col("added") + F.col("removed") + F.col("changed"), F.col("added") + F.col("removed") + F.col("changed") + F.col("unchanged"))).alias("churn_rate"),
    )


def change_rate_report(changes: DataFrame) -> DataFrame:
    """Changes that have a predecessor, rates rounded to three places."""
    return changes.where("previous_snapshot_id IS NOT NULL").select(
        "source_id", "snapshot_id", "added", "removed", "changed", "unchanged", F.round("change_rate", 3).alias("change_rate"), F.round("churn_rate", 3).alias("churn_rate")
    )


# ------------------------------------------------------------ freshness and duplicates by origin
def origin_freshness(pages: DataFrame, captures: DataFrame) -> DataFrame:
    """Newest snapshot of each origin, its number of snapshots, and the newest capture of any source that ever held the origin.

    pages also has ``origin``; captures: source_id, captured_at.
    """
    seen = pages.groupBy("origin", "snapshot_id").agg(F.min("observed_at").alias("observed_at"))
    w = Window.partitionBy("origin")
    ranked = seen.withColumn("snapshot_count", F.count("*").over(w)).withColumn("r", F.row_number().over(w.orderBy(at("observed_at").desc(), F.col("snapshot_id").desc())))
    newest = captures.groupBy("source_id").agg(F.max("captured_at").alias("captured_at"))
    by_origin = pages.select("origin", "source_id").distinct().join(newest, "source_id").groupBy("origin").agg(F.max("captured_at").alias("last_capture_at"))
    return ranked.where("r = 1").join(by_origin, "origin", "left").select("origin", F.col("snapshot_id").alias("newest_snapshot_id"), F.col("observed_at").alias("newest_snapshot_at"), "snapshot_count", "last_capture_at")


def freshness_age(freshness: DataFrame, as_of: str) -> DataFrame:
    """Age in hours of each origin's newest snapshot at a given time, oldest first."""
    return freshness.select("origin", "newest_snapshot_id", (F.timestamp_diff("SECOND", at("newest_snapshot_at"), F.lit(as_of).cast("timestamp")) / 3600.0).alias("age_hours")).orderBy(F.desc("age_hours"), "origin")


def duplicate_rates(pages: DataFrame, aliases: DataFrame, near: DataFrame) -> DataFrame:
    """Exact rate aliases / (pages + aliases) and near rate of each snapshot and origin that has pages; near: snapshot_id, origin, near_duplicate_page_count."""
    p = pages.groupBy("snapshot_id", "origin").agg(F.count("*").alias("page_count"))
    a = aliases.groupBy("snapshot_id", "origin").agg(F.count("*").alias("alias_count"))
    out = p.join(a, ["snapshot_id", "origin"], "left").join(near, ["snapshot_id", "origin"], "left").withColumn("alias_count", F.coalesce("alias_count", F.lit(0)).cast("long"))
    return out.select(
        "snapshot_id", "origin", "page_count", "alias_count", ratio("alias_count", F.col("page_count") + F.col("alias_count")).alias("exact_duplicate_rate"),
        "near_duplicate_page_count", ratio("near_duplicate_page_count", "page_count").alias("near_duplicate_rate"),
    )


def newest_duplicate_rates(rates: DataFrame, freshness: DataFrame) -> DataFrame:
    """Rates in the newest snapshot of each origin."""
    newest = freshness.select("origin", F.col("newest_snapshot_id").alias("snapshot_id"))
    return rates.join(newest, ["origin", "snapshot_id"]).select("origin", "snapshot_id", F.round("exact_duplicate_rate", 3).alias("exact_duplicate_rate"), F.round("near_duplicate_rate", 3).alias("near_duplicate_rate"))


# ------------------------------------------------------------ comparisons within scope and contract
def source_comparisons(sources: DataFrame) -> DataFrame:
    """Each source observation against the one before it."""
    w = Window.partitionBy("source_id").orderBy(at("observed_at"), "snapshot_id")
    out = sources.select("*", *[F.lag(c).over(w).alias(f"previous_{c}") for c in ("snapshot_id", "scope", "contract")])
    same = (F.col("scope") == F.col("previous_scope")) & (F.col("contract") == F.col("previous_contract"))
    return out.withColumn("comparison_status", F.when(F.col("previous_snapshot_id").isNull(), "first_observation").when(same, "compatible").otherwise("incompatible_scope_or_extraction_contract"))


def page_changes(pages: DataFrame) -> DataFrame:
    """Each page against its own last observation under the same scope and contract: new, changed (within an interval) or unchanged."""
    w = Window.partitionBy("source_id", "page_id", "scope", "contract").orderBy(at("observed_at"), "snapshot_id")
    out = pages.select("*", *[F.lag(c).over(w).alias(f"previous_{c}") for c in ("snapshot_id", "content_sha256", "observed_at")])
    known = F.col("previous_snapshot_id").isNotNull()
    changed = known & (F.col("content_sha256") != F.col("previous_content_sha256"))
    return out.select(
        "*",
        F.when(~known, "new").when(F.col("content_sha256") == F.col("previous_content_sha256"), "unchanged").otherwise("changed").alias("change_status"),
        F.when(changed, F.col("previous_observed_at")).alias("change_interval_start"),
        F.when(changed, F.col("observed_at")).alias("change_interval_end"),
    )


def change_frequency(changes: DataFrame) -> DataFrame:
    """Monthly counts of page observations and the changed share of comparable ones."""
    month = F.date_format(F.date_trunc("MONTH", at("observed_at")), "yyyy-MM-dd").alias("observation_month")
    out = changes.groupBy("source_id", "scope", "contract", month).agg(
        F.min("observed_at").alias("first_observed_at"),
        F.max("observed_at").alias("last_observed_at"),
        F.count("*").alias("page_observations"),
        *[F.count_if(F.col("change_status") == s).alias(f"{s}_page_observations") for s in ("new", "changed", "unchanged")],
        F.count("previous_snapshot_id").alias("comparable_page_observations"),
    )
    return out.withColumn("changed_percent", 100.0 * ratio("changed_page_observations", "comparable_page_observations"))


def page_presence(pages: DataFrame, sources: DataFrame, evidence: DataFrame) -> DataFrame:
    """Pages of the latest compatible earlier snapshot that a snapshot lacks, as removed (with evidence) or unobserved.

    A source's snapshots are numbered in order and cut into runs of unchanged scope and contract. An observation of a page makes it
    missing in the snapshots of its run up to its next observation: a range, so nothing is compared pairwise.
    """
    order = Window.partitionBy("source_id").orderBy(at("observed_at"), "snapshot_id")
    prior = {c: F.lag(c).over(order) for c in ("scope", "contract")}
    numbered = sources.withColumn("number", F.row_number().over(order)).withColumn("breaks", F.when((F.col("scope") == prior["scope"]) & (F.col("contract") == prior["contract"]), 0).otherwise(1))
    numbered = numbered.withColumn("run", F.sum("breaks").over(order)).withColumn("last_number", F.max("number").over(Window.partitionBy("source_id", "run")))
    seen = pages.select("snapshot_id", "source_id", "page_id", "scope", "contract").join(numbered.select("snapshot_id", "source_id", "scope", "contract", "number", "run", "last_number", F.col("observed_at").alias("previous_observed_at")), ["snapshot_id", "source_id", "scope", "contract"])
    following = F.lead("number").over(Window.partitionBy("source_id", "run", "page_id").orderBy("number"))
    gaps = seen.withColumn("first", F.col("number") + 1).withColumn("final", F.coalesce(following - 1, F.col("last_number"))).where("first <= final")
    missing = gaps.select("source_id", "page_id", F.col("snapshot_id").alias("previous_snapshot_id"), "previous_observed_at", F.explode(F.sequence("first", "final")).alias("number"))
    now = missing.join(numbered.select("source_id", "number", "snapshot_id", "scope", "contract", "observed_at", "stop_reason", "failed_count", "rejected_count", "page_count"), ["source_id", "number"])
    tombs = evidence.where("kind = 'tombstone'").select("snapshot_id", "source_id", "page_id", "scope", F.col("evidence_at").alias("tombstoned_at"))
    cover = evidence.where("kind = 'coverage' AND complete AND page_id = ''").select("snapshot_id", "source_id", "scope", F.col("evidence_at").alias("asserted_at"), "expected_page_count")
    with_cover = now.join(tombs, ["snapshot_id", "source_id", "page_id", "scope"], "left").join(cover, ["snapshot_id", "source_id", "scope"], "left")
    whole = (F.col("expected_page_count").isNull() | (F.col("expected_page_count") == F.col("page_count"))) & (F.col("stop_reason") == "frontier_exhausted") & (F.col("failed_count") == 0) & (F.col("rejected_count") == 0)
    out = with_cover.withColumn("asserted_at", F.when(whole, F.col("asserted_at")))
    removed = F.col("tombstoned_at").isNotNull() | F.col("asserted_at").isNotNull()
    return out.select(
        "snapshot_id", "source_id", "page_id", "previous_snapshot_id", "scope", "contract", "previous_observed_at", "observed_at",
        F.when(removed, "removed").otherwise("unobserved").alias("presence_status"),
        F.when(F.col("tombstoned_at").isNotNull(), "explicit_tombstone").when(F.col("asserted_at").isNotNull(), "complete_scope_assertion").otherwise("no_removal_evidence").alias("removal_basis"),
        F.coalesce("tombstoned_at", "asserted_at").alias("removal_evidence_at"),
    )


def alias_observations(aliases: DataFrame) -> DataFrame:
    return aliases.select("snapshot_id", "source_id", "alias_page_id", "representative_page_id", "alias_url", "observed_at")


def exact_alias_groups(aliases: DataFrame) -> DataFrame:
    """Members of each representative, sorted, as canonical JSON."""
    return aliases.groupBy("snapshot_id", "source_id", "representative_page_id").agg(
        F.countDistinct("alias_page_id").alias("alias_count"),
        F.to_json(F.sort_array(F.collect_set(F.struct("alias_page_id", "alias_url")))).alias("alias_members"),
        F.min("observed_at").alias("first_observed_at"),
        F.max("observed_at").alias("last_observed_at"),
    )


def history_counts(sources: DataFrame, pages: DataFrame, aliases: DataFrame) -> DataFrame:
    s = sources.groupBy("snapshot_id").agg(F.min("observed_at").alias("observed_at"), F.countDistinct("source_id").alias("source_count"))
    p = pages.groupBy("snapshot_id").agg(F.countDistinct("page_id").alias("page_count"))
    a = aliases.groupBy("snapshot_id").agg(F.countDistinct("alias_page_id").alias("alias_count"))
    return s.join(p, "snapshot_id", "left").join(a, "snapshot_id", "left").select("snapshot_id", "observed_at", "source_count", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("page_count", "alias_count")])


def snapshot_count_report(batches: DataFrame, records: DataFrame) -> DataFrame:
    """Expected against actual records of each complete batch; batches: batch_id, snapshot_id, status, expected_{page,alias,passage}_count; records: batch_id, record_type."""
    kinds = {"page": "page", "alias": "page_alias", "passage": "passage"}
    actual = records.groupBy("batch_id").agg(*[F.count_if(F.col("record_type") == t).alias(f"actual_{k}_count") for k, t in kinds.items()])
    return batches.where("status = 'complete'").join(actual, "batch_id", "left").select(
        "batch_id", "snapshot_id", *[f"expected_{k}_count" for k in kinds], *[F.coalesce(f"actual_{k}_count", F.lit(0)).cast("long").alias(f"actual_{k}_count") for k in kinds]
    )


def coverage(sources: DataFrame, requests: DataFrame, evidence: DataFrame) -> DataFrame:
    """How much of each source's scope a snapshot covers, by the strongest basis there is; sources also has ``allowed_urls array<string>``."""
    allowed = sources.select("snapshot_id", "source_id", "allowed_urls").where("allowed_urls IS NOT NULL")
    hit = requests.join(allowed, ["snapshot_id", "source_id"]).where(F.array_contains("allowed_urls", F.col("requested_url")))
    hit = hit.groupBy("snapshot_id", "source_id").agg(F.countDistinct("requested_url").alias("captured"))
    full = (F.col("kind") == "coverage") & F.col("complete")
    said = evidence.groupBy("snapshot_id", "source_id", "scope").agg(
        F.max(F.when(full, 1).otherwise(0)).alias("attested"), F.max(F.when(full, F.col("expected_page_count"))).alias("expected"), F.max(F.when(full, F.col("evidence_at"))).alias("attested_at")
    )
    s = sources.join(said, ["snapshot_id", "source_id", "scope"], "left").join(hit, ["snapshot_id", "source_id"], "left")
    attested, expected = F.coalesce(F.col("attested") == 1, F.lit(False)), F.col("expected").isNotNull()
    listed, size = F.col("allowed_urls").isNotNull(), F.size("allowed_urls").cast("long")
    got = F.coalesce("captured", F.lit(0)).cast("long")
    s = s.withColumn("denominator", F.when(attested, F.col("expected")).when(listed, size)).withColumn("numerator", F.when(attested & expected, F.col("page_count")).when(attested, None).when(listed, got))
    return s.select(
        "snapshot_id", "source_id", "scope", "page_count",
        F.col("denominator").cast("long").alias("coverage_denominator"), F.col("numerator").cast("long").alias("coverage_numerator"),
        F.when(attested & expected, "measured_complete_scope_assertion").when(attested, "attested_complete_no_denominator").when(listed, "measured_exact_allowed_urls").otherwise("unknown_open_scope").alias("coverage_basis"),
        F.when(attested & ~expected, "attested_complete").when(attested | listed, "measured").otherwise("unknown").alias("coverage_status"),
        F.when(F.col("denominator") > 0, 100.0 * ratio("numerator", "denominator")).alias("coverage_percent"),
        F.when(attested, F.col("attested_at")).alias("attested_at"),
        F.when(attested & ~expected, "attested without a denominator").when(attested & (F.col("expected") == 0), "attested denominator is zero")
        .when(attested, "attested denominator").when(listed & (size == 0), "allowlist is empty").when(listed, "exact allowlist matches").otherwise("no finite inventory").alias("coverage_reason"),
    )


def page_freshness(pages: DataFrame, sources: DataFrame, presence: DataFrame, as_of: str) -> DataFrame:
    """Latest observation of each page, whether its source still has it, and its age in days at ``as_of`` (a date)."""
    order = [at("observed_at").desc(), F.col("snapshot_id").desc()]
    page = only_top(pages, ["source_id", "page_id"], order)
    source = only_top(sources, ["source_id"], order).select("source_id", F.col("snapshot_id").alias("latest_snapshot_id"), F.col("scope").alias("latest_scope"), F.col("contract").alias("latest_contract"))
    last = only_top(presence, ["snapshot_id", "source_id", "page_id"], [F.col("previous_observed_at").desc()]).select(F.col("snapshot_id").alias("latest_snapshot_id"), "source_id", "page_id", "presence_status")
    both = page.join(source, "source_id").join(last, ["latest_snapshot_id", "source_id", "page_id"], "left")
    same = (F.col("scope") == F.col("latest_scope")) & (F.col("contract") == F.col("latest_contract"))
    now = F.when(F.col("snapshot_id") == F.col("latest_snapshot_id"), "observed_in_latest_source_snapshot").otherwise("no_compatible_presence_comparison")
    return both.select(
        "source_id", "page_id", "snapshot_id", "latest_snapshot_id", "content_sha256",
        F.when(same, F.coalesce("presence_status", now)).otherwise("scope_or_extraction_contract_changed").alias("current_presence_status"),
        F.datediff(F.lit(as_of).cast("date"), at("observed_at").cast("date")).cast("long").alias("observation_age_days"),
    )


def content_quality(pages: DataFrame, passages: DataFrame, short: int = 200) -> DataFrame:
    """Screening flags; pages: snapshot_id, source_id, page_id, title, content; passages: snapshot_id, source_id, page_id, passage_id."""
    counted = passages.groupBy("snapshot_id", "source_id", "page_id").agg(F.countDistinct("passage_id").alias("passage_count"))
    content = F.coalesce("content", F.lit(""))
    p = pages.join(counted, ["snapshot_id", "source_id", "page_id"], "left").select(
        "snapshot_id", "source_id", "page_id", F.length(content).cast("long").alias("content_chars"), F.octet_length(content).cast("long").alias("content_bytes"),
        F.coalesce("passage_count", F.lit(0)).cast("long").alias("passage_count"), (F.length(F.trim(F.coalesce("title", F.lit("")))) == 0).alias("missing_title"),
    )
    p = p.withColumn("short_content", F.col("content_chars") < short).withColumn("no_passages", F.col("passage_count") == 0)
    return p.withColumn("needs_review", F.col("short_content") | F.col("missing_title") | F.col("no_passages"))


def manifest_requests(manifests: DataFrame) -> DataFrame:
    """Distinct requested URLs of crawl manifests; manifests: snapshot_id, record_json with $.pages[]."""
    schema = "array<struct<source_id:string,page_id:string,requested_url:string>>"
    p = manifests.select("snapshot_id", F.explode(F.from_json(F.get_json_object("record_json", "$.pages"), schema)).alias("p"))
    return p.where("p.source_id IS NOT NULL AND p.requested_url IS NOT NULL").select("snapshot_id", "p.source_id", "p.page_id", "p.requested_url").distinct()
