"""Recrawl intervals: evidence gates, proposals, their validation and their life as policy.

``inputs``: generation_id, source_id, generated_at, expires_at, expected_policy_version, minimum/current/maximum_interval_hours, max_adjustment_fraction, minimum_completed_snapshots,
minimum_comparable_page_observations, maximum_evidence_age_days, maximum_provisional_event_age_seconds, snapshot_ids array, provisional_run_id, provisional_event_ids array.
``sources`` and ``changes``: see ``history``. ``events``: crawl_run_id, event_id, source_id, event_type, event_at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.operators.history import at, only_top, ratio

# Fixed values of the policy.
SHORTEN_FROM, LENGTHEN_UP_TO, SHORTEN_BY, LENGTHEN_BY = 0.25, 0.02, 0.5, 1.5
HIGH_SNAPSHOTS, HIGH_COMPARABLE = 4, 100
SEVERITY = ("valid", "provisional_review_required", "unsupported", "out_of_scope", "stale", "invalid")
KEY = ["generation_id", "source_id"]


def _evidence(inputs: DataFrame, sources: DataFrame, changes: DataFrame, events: DataFrame) -> DataFrame:
    asked = inputs.select(*KEY, "snapshot_ids", F.explode_outer("snapshot_ids").alias("asked_id"))
    newest = only_top(sources, ["snapshot_id", "source_id"], [F.col("observed_at").desc()])
    known = newest.select(F.col("snapshot_id").alias("asked_id")).distinct().withColumn("exists", F.lit(1))
    s = asked.join(newest.select(F.col("snapshot_id"), F.col("snapshot_id").alias("asked_id"), "source_id", "scope", "contract", "observed_at", "stop_reason", "failed_count", "rejected_count"), ["asked_id", "source_id"], "left").join(known, "asked_id", "left")
    incomplete = F.col("snapshot_id").isNotNull() & ((F.col("stop_reason") != "frontier_exhausted") | (F.coalesce("failed_count", F.lit(-1)) != 0) | (F.coalesce("rejected_count", F.lit(-1)) != 0))
    stats = s.groupBy(*KEY).agg(
        F.countDistinct("snapshot_id").alias("validated"), F.countDistinct(F.when(F.col("exists") == 1, F.col("asked_id"))).alias("existing"), F.count_if((F.col("exists") == 1) & F.col("snapshot_id").isNull()).alias("foreign_snapshots"),
        F.countDistinct("scope").alias("scopes"), F.countDistinct("contract").alias("contracts"), F.count_if(incomplete).alias("incomplete"), F.max(at("observed_at")).alias("latest_observed_at"),
    )
    c = changes.select("source_id", F.col("snapshot_id").alias("asked_id"), "page_id", "change_status", "previous_snapshot_id").where("previous_snapshot_id IS NOT NULL")
    moved = asked.join(c, ["source_id", "asked_id"]).where(F.array_contains("snapshot_ids", F.col("previous_snapshot_id")))
    spot = F.struct("asked_id", "page_id")
    moved = moved.groupBy(*KEY).agg(F.countDistinct(spot).alias("comparable"), F.countDistinct(F.when(F.col("change_status") == "changed", spot)).alias("changed"))
    want = inputs.select(*KEY, "provisional_run_id", "generated_at", F.explode("provisional_event_ids").alias("event_id"))
    own = events.select("event_id", F.col("crawl_run_id").alias("provisional_run_id"), F.col("source_id").alias("event_source"), "event_type", "event_at")
    anyone = events.select("event_id").distinct().withColumn("event_exists", F.lit(1))
    p = want.join(own, ["event_id", "provisional_run_id"], "left").join(anyone, "event_id", "left")
    capture = F.col("event_type") == "capture_committed"
    mine = capture & (F.col("event_source") == F.col("source_id")) & (at("event_at") <= at("generated_at"))
    wrong = (F.col("event_exists") == 1) & (F.col("event_type").isNull() | (capture & ~F.col("event_source").eqNullSafe(F.col("source_id"))))
    prov = p.groupBy(*KEY).agg(F.countDistinct(F.when(mine, F.col("event_id"))).alias("accepted_events"), F.count_if(wrong).alias("foreign_events"), F.count_if(F.col("event_type").isNotNull() & ~capture).alias("other_events"))
    state = inputs.select(*KEY, "provisional_run_id", "generated_at").join(events.select(F.col("crawl_run_id").alias("provisional_run_id"), "event_type", "event_at"), "provisional_run_id").where(at("event_at") <= at("generated_at"))
    state = state.groupBy(*KEY).agg(F.max(at("event_at")).alias("latest_run_event_at"), F.max(F.when(F.col("event_type").isin("crawl_completed", "corpus_snapshot_published"), 1).otherwise(0)).alias("terminal"))
    in_scope = newest.select("source_id").union(events.select("source_id").where("source_id IS NOT NULL")).distinct().withColumn("in_scope", F.lit(True))
    out = inputs.join(stats, KEY, "left").join(moved, KEY, "left").join(prov, KEY, "left").join(state, KEY, "left").join(in_scope, "source_id", "left")
    counts = ["validated", "existing", "foreign_snapshots", "scopes", "contracts", "incomplete", "comparable", "changed", "accepted_events", "foreign_events", "other_events", "terminal"]
    return out.na.fill(0, counts).withColumn("in_scope", F.coalesce("in_scope", F.lit(False)))


def _valid_input() -> Column:
    text = lambda c: F.coalesce(F.length(F.trim(c)) > 0, F.lit(False))
    h = [F.col(f"{k}_interval_hours") for k in ("minimum", "current", "maximum")]
    rules = [
        F.col("generated_at").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ$"), F.col("expires_at").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ$"), at("expires_at") > at("generated_at"),
        text("generation_id"), text("source_id"), text("expected_policy_version"), F.col("copies") == 1,
        h[0] > 0, h[1].between(h[0], h[2]), F.col("max_adjustment_fraction").between(0, 0.5), F.col("minimum_completed_snapshots").between(3, 5),
        F.col("minimum_comparable_page_observations") > 0, F.col("maximum_evidence_age_days") > 0, F.col("maximum_provisional_event_age_seconds") > 0,
        F.col("snapshot_ids").isNotNull() & (F.size("snapshot_ids") <= 5), F.col("provisional_event_ids").isNotNull() & (F.size("provisional_event_ids") <= 1000),
        F.size(F.array_distinct("snapshot_ids")) == F.size("snapshot_ids"), F.size(F.array_distinct("provisional_event_ids")) == F.size("provisional_event_ids"),
        F.when(F.col("provisional_run_id").isNull(), F.size("provisional_event_ids") == 0).otherwise((F.size("snapshot_ids") == 0) & (F.size("provisional_event_ids") > 0)),
        F.forall("provisional_event_ids", lambda x: x.rlike("^[A-Za-z0-9._:-]{1,512}$")), *[c == F.round(c, 3) for c in h], F.col("max_adjustment_fraction") == F.round("max_adjustment_fraction", 6),
    ]
    out = F.lit(True)
    for r in rules:
        out = out & F.coalesce(r, F.lit(False))
    return out


def candidates(inputs: DataFrame, sources: DataFrame, changes: DataFrame, events: DataFrame) -> DataFrame:
    """Every input with its evidence, proposal, confidence, reasons, canonical JSON and id. Rounding is always toward the current interval."""
    one = inputs.withColumn("copies", F.count("*").over(Window.partitionBy(*KEY)))
    c = _evidence(one, sources, changes, events).withColumn("valid_input", _valid_input())
    age = F.unix_timestamp(at("generated_at")) - F.unix_timestamp("latest_run_event_at")
    asked = F.size("provisional_event_ids")
    live = F.col("provisional_run_id").isNotNull() & (asked > 0) & (F.col("accepted_events") == asked) & (F.col("terminal") == 0) & age.between(0, F.col("maximum_provisional_event_age_seconds"))
    n = F.size("snapshot_ids")
    days = F.datediff(at("generated_at").cast("date"), F.col("latest_observed_at").cast("date"))
    whole = (
        (F.col("validated") >= F.col("minimum_completed_snapshots")) & (F.col("validated") == n) & (F.col("existing") == n) & (F.col("scopes") == 1) & (F.col("contracts") == 1) & (F.col("incomplete") == 0)
        & (F.col("comparable") >= F.col("minimum_comparable_page_observations")) & (F.col("latest_observed_at") <= at("generated_at")) & days.between(0, F.col("maximum_evidence_age_days"))
    )
    c = c.withColumn("provisional_ok", F.coalesce(live, F.lit(False))).withColumn("completed_ok", F.coalesce(whole, F.lit(False)))
    c = c.withColumn("change_fraction", F.when(F.col("completed_ok"), ratio("changed", "comparable")))
    ok = F.col("valid_input")
    c = c.withColumn("evidence_status", F.when(ok & F.col("provisional_run_id").isNotNull() & F.col("provisional_ok"), "provisional").when(ok & F.col("provisional_run_id").isNull() & F.col("completed_ok"), "completed_history").otherwise("unsupported"))
    now, done = F.col("current_interval_hours"), F.col("evidence_status") == "completed_history"
    c = c.withColumn("target", F.when(done & (F.col("change_fraction") >= SHORTEN_FROM), now * SHORTEN_BY).when(done & (F.col("change_fraction") <= LENGTHEN_UP_TO), now * LENGTHEN_BY).otherwise(now))
    step = F.col("max_adjustment_fraction")
    near = F.greatest(now * (1 - step), F.least(now * (1 + step), F.col("target")))
    c = c.withColumn("capped", F.greatest("minimum_interval_hours", F.least("maximum_interval_hours", near)).cast("decimal(18,6)"))
    thousand = lambda f: (f(F.col("capped") * 1000).cast("decimal(21,0)") / 1000).cast("double")
    c = c.withColumn("proposed_interval_hours", F.when(ok, F.when(F.col("target") < now, thousand(F.ceil)).when(F.col("target") > now, thousand(F.floor)).otherwise(now)))
    c = c.withColumn("adjustment_hours", F.round(F.col("proposed_interval_hours") - now, 3)).withColumn("adjustment_fraction", F.round(ratio("adjustment_hours", "current_interval_hours"), 6))
    c = c.withColumn("adjustment_type", F.when(F.col("adjustment_hours") > 0, "increase").when(F.col("adjustment_hours") < 0, "decrease").otherwise("hold"))
    high = (F.col("validated") >= HIGH_SNAPSHOTS) & (F.col("comparable") >= HIGH_COMPARABLE)
    c = c.withColumn("confidence", F.when(done & high, "high").when(done, "medium").when(F.col("evidence_status") == "provisional", "provisional").otherwise("low"))
    reasons = F.array(
        F.when(done, "compared complete snapshots of one scope"), F.when(F.col("evidence_status") == "provisional", "active captures are provisional"), F.when(F.col("evidence_status") == "unsupported", "evidence does not suffice"),
        F.when(done & (F.col("change_fraction") >= SHORTEN_FROM), "shortened: many pages changed"), F.when(done & (F.col("change_fraction") <= LENGTHEN_UP_TO), "lengthened: few pages changed"),
        F.when(done & (F.col("change_fraction") > LENGTHEN_UP_TO) & (F.col("change_fraction") < SHORTEN_FROM), "held: between thresholds"), F.when(F.col("proposed_interval_hours") != F.col("target"), "capped by policy"),
    )
    c = c.withColumn("reasons", F.array_compact(reasons))
    dec = lambda x, d: F.coalesce(F.col(x).cast(f"decimal(18,{d})").cast("string"), F.lit(""))
    basis = F.struct(
        *KEY, "generated_at", "expires_at", "expected_policy_version", *[dec(x, 3).alias(x) for x in ("minimum_interval_hours", "current_interval_hours", "maximum_interval_hours", "proposed_interval_hours", "adjustment_hours")],
        dec("adjustment_fraction", 6).alias("adjustment_fraction"), dec("max_adjustment_fraction", 6).alias("max_adjustment_fraction"), "minimum_completed_snapshots", "minimum_comparable_page_observations", "maximum_evidence_age_days",
        "maximum_provisional_event_age_seconds", "evidence_status", F.array_sort("snapshot_ids").alias("snapshot_ids"), "provisional_run_id", F.array_sort("provisional_event_ids").alias("provisional_event_ids"), "comparable", "changed", dec("change_fraction", 6).alias("change_fraction"),
    )
    c = c.withColumn("idempotency_basis", F.to_json(basis, {"ignoreNullFields": "false"}))
    return c.withColumn("recommendation_id", F.when(ok, F.concat(F.lit("sha256:"), F.sha2("idempotency_basis", 256))))


def recommendations(candidate: DataFrame) -> DataFrame:
    """The public columns."""
    return candidate.select(
        "recommendation_id", *KEY, "expected_policy_version", "minimum_interval_hours", "current_interval_hours", "maximum_interval_hours", "proposed_interval_hours", "adjustment_hours", "adjustment_type",
        "adjustment_fraction", "evidence_status", F.col("comparable").alias("comparable_page_observations"), F.col("changed").alias("changed_page_observations"), F.round("change_fraction", 6).alias("change_fraction"), "confidence", "reasons",
    )


def validation(candidate: DataFrame, as_of: str, by_elapsed_time: bool = False) -> DataFrame:
    """Status of each recommendation at a time; evidence ages by calendar days, or by elapsed time as importers count."""
    now = F.lit(as_of).cast("timestamp")
    days = (F.unix_timestamp(now) - F.unix_timestamp("latest_observed_at")) / 86400.0 if by_elapsed_time else F.datediff(now.cast("date"), F.col("latest_observed_at").cast("date"))
    old = F.coalesce(days > F.col("maximum_evidence_age_days"), F.lit(False))
    expired = F.coalesce(at("expires_at") <= now, F.lit(True))
    ladder = (
        (~F.col("valid_input"), "invalid", "invalid input or duplicate row"), (expired, "stale", "expired"), (old, "stale", "evidence is too old"),
        (F.col("foreign_snapshots") > 0, "out_of_scope", "a snapshot of another source"), (F.col("foreign_events") > 0, "out_of_scope", "an event of another source or run"), (~F.col("in_scope"), "out_of_scope", "source without evidence"),
        (F.col("other_events") > 0, "unsupported", "events other than captures"), (F.col("provisional_run_id").isNotNull() & F.col("provisional_ok"), "provisional_review_required", "provisional evidence needs review"),
        ((F.col("evidence_status") == "completed_history") & F.col("completed_ok"), "valid", "complete, compatible, fresh and comparable"), (F.col("provisional_run_id").isNotNull(), "unsupported", "provisional run lacks captures"),
        (F.col("validated") < F.size("snapshot_ids"), "unsupported", "a snapshot is missing"), ((F.col("scopes") > 1) | (F.col("contracts") > 1), "unsupported", "scope or contract changes"), (F.col("incomplete") > 0, "unsupported", "incomplete crawls"),
    )
    status, reason = F, F
    for condition, s, r in ladder:
        status, reason = status.when(condition, s), reason.when(condition, r)
    return candidate.select("recommendation_id", *KEY, "expected_policy_version", "evidence_status", "proposed_interval_hours", status.otherwise("unsupported").alias("validation_status"), reason.otherwise("too few comparable observations").alias("validation_reason"))


def accumulate(df: DataFrame, rules: list[tuple[Column, str, str]], out: str = "verdict") -> DataFrame:
    """Status of greatest severity among the rules that fire, with all of their reasons: ``struct<status, reasons>``."""
    fired = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(SEVERITY.index(s)).alias("rank"), F.lit(r).alias("reason"))) for c, s, r in rules]))
    top = F.coalesce(F.array_max(F.transform(fired, lambda x: x["rank"])), F.lit(0))
    return df.withColumn(out, F.struct(F.element_at(F.array(*map(F.lit, SEVERITY)), top + 1).alias("status"), F.array_sort(F.array_distinct(F.transform(fired, lambda x: x["reason"]))).alias("reasons")))


def bound(recommendation: DataFrame, policy: DataFrame) -> DataFrame:
    """Whether a recommendation is what its id says (hash and nested fields of its basis) and still meets the current policy; policy: source_id, policy_version, interval_hours, enabled."""
    b = F.from_json("idempotency_basis", "generation_id string, source_id string, proposed_interval_hours string, expected_policy_version string")
    r = recommendation.withColumn("b", b)
    intact = (
        F.col("recommendation_id").eqNullSafe(F.concat(F.lit("sha256:"), F.sha2("idempotency_basis", 256))) & F.col("b.source_id").eqNullSafe(F.col("source_id")) & F.col("b.generation_id").eqNullSafe(F.col("generation_id"))
        & F.expr("try_cast(b.proposed_interval_hours AS double)").eqNullSafe(F.round("proposed_interval_hours", 3))
    )
    j = r.withColumn("basis_intact", intact).drop("b").join(policy, "source_id", "left")
    return j.withColumn("policy_current", (F.col("policy_version") == F.col("expected_policy_version")) & (F.col("interval_hours") == F.col("current_interval_hours")))


def import_outcomes(recommendation: DataFrame, known: DataFrame, policy: DataFrame, routine_fraction: float = 0.25) -> DataFrame:
    """What importing does: existing, rejected, disabled, pending_review or scheduled; recommendation also has validation_status."""
    j = recommendation.join(known.select("recommendation_id").distinct().withColumn("there", F.lit(True)), "recommendation_id", "left").join(policy.select("source_id", "policy_version", "enabled"), "source_id", "left")
    review = (
        (F.col("validation_status") == "provisional_review_required") | ~F.col("policy_version").eqNullSafe(F.col("expected_policy_version")) | ((F.col("adjustment_type") == "decrease") & (F.abs("adjustment_fraction") > routine_fraction))
        | F.col("confidence").isin("low", "provisional")
    )
    outcome = F.when(F.col("there"), "existing").when(~F.col("validation_status").isin("valid", "provisional_review_required"), "rejected").when(~F.coalesce("enabled", F.lit(False)), "disabled").when(review, "pending_review").otherwise("scheduled")
    return j.withColumn("import_outcome", outcome).drop("there")


def decide(pending: DataFrame, decisions: DataFrame, policy: DataFrame) -> DataFrame:
    """First decision on each pending recommendation; stale if the policy's version or interval moved since."""
    first = only_top(decisions, ["recommendation_id"], [F.col("decided_at"), F.col("decision_id")])
    j = pending.join(first, "recommendation_id").join(policy.select("source_id", F.col("policy_version").alias("now_version"), F.col("interval_hours").alias("now_hours")), "source_id", "left")
    same = F.col("now_version").eqNullSafe(F.col("expected_policy_version")) & F.col("now_hours").eqNullSafe(F.col("current_interval_hours"))
    return j.withColumn("decision_outcome", F.when(~same, "stale").when(F.col("decision") == "approve", "scheduled").otherwise("rejected"))


def schedule(policy: DataFrame, as_of: str) -> DataFrame:
    """Next due time (last scheduled plus interval; now if never) and whether it is due."""
    now = F.lit(as_of).cast("timestamp")
    due = F.coalesce(F.col("last_scheduled_at").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("interval_hours") * 3600).cast("decimal(18,6)")), now)
    return policy.withColumn("next_due_at", due).withColumn("due", F.coalesce("enabled", F.lit(True)) & (due <= now))


def advance(policy: DataFrame, finished: DataFrame, as_of: str) -> DataFrame:
    """Sources of finished runs are scheduled as of now; others keep their time."""
    done = finished.select("source_id").distinct().withColumn("done", F.lit(True))
    return policy.join(done, "source_id", "left").withColumn("last_scheduled_at", F.when(F.col("done"), F.lit(as_of).cast("timestamp")).otherwise(F.col("last_scheduled_at").cast("timestamp"))).drop("done")


def replay_preflight(required: DataFrame, live: DataFrame, batched: DataFrame, archived: DataFrame) -> DataFrame:
    """Status of each run's replay: events that are live are complete, those in a batch or archive replayable, others unrecoverable; gaps sorted."""
    mark = lambda d, name: d.select("crawl_run_id", "event_id").distinct().withColumn(name, F.lit(True))
    j = required
    for d, name in ((live, "live"), (batched, "batched"), (archived, "archived")):
        j = j.join(mark(d, name), ["crawl_run_id", "event_id"], "left")
    rank = F.when(F.col("live"), 0).when(F.coalesce("batched", F.lit(False)) | F.coalesce("archived", F.lit(False)), 1).otherwise(2)
    j = j.withColumn("rank", rank)
    out = j.groupBy("crawl_run_id").agg(F.max("rank").alias("worst"), F.array_sort(F.collect_set(F.when(F.col("rank") == 2, F.col("event_id")))).alias("gaps"), F.count_if(F.col("rank") == 1).alias("replayable_count"))
    return out.select("crawl_run_id", F.element_at(F.array(F.lit("complete"), F.lit("replayable"), F.lit("unrecoverable")), F.col("worst") + 1).alias("replay_status"), "replayable_count", "gaps")
