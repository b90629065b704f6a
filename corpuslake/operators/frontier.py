"""Crawl-frontier relations and folds: queues, claims, leases, permits, throttling and retention, as batch expressions over event histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.operators.history import only_top
from corpuslake.session import keep, numbered


# ------------------------------------------------------------ queue
def enqueue(known: DataFrame, incoming: DataFrame, keys: tuple[str, ...] = ("source_id", "url")) -> DataFrame:
    """The rows that an idempotent enqueue adds."""
    return incoming.dropDuplicates(list(keys)).join(known.select(*keys).distinct(), list(keys), "left_anti").select(*keys)


def status_counts(tasks: DataFrame, now: int) -> DataFrame:
    """Tasks by source and status; leases past their time show apart."""
    s = F.col("status")
    return tasks.groupBy("source_id").agg(*[F.count_if(s == x).alias(x) for x in ("pending", "leased", "succeeded", "failed")], F.count_if((s == "leased") & (F.col("lease_expires_at") <= now)).alias("expired"))


def unfinished_counts(tasks: DataFrame, exclude: list[str]) -> DataFrame:
    left = tasks.where(F.col("status").isin("pending", "leased") & ~F.col("source_id").isin(exclude))
    return left.groupBy("source_id").agg(F.count("*").alias("unfinished"))


def dead_letters(tasks: DataFrame, limit: int | None = None) -> DataFrame:
    out = tasks.where("status = 'failed'").orderBy("task_id")
    return out if limit is None else out.limit(limit)


def requeue(tasks: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Failed tasks among the chosen ids return to pending with a fresh attempt count; the other ids are reported as skipped."""
    dead = tasks.where("status = 'failed'")
    back = dead.join(chosen.select("task_id").distinct(), "task_id", "left_semi").withColumn("status", F.lit("pending")).withColumn("attempts", F.lit(0))
    return back, chosen.select("task_id").distinct().join(dead.select("task_id"), "task_id", "left_anti")


def content_groups(captures: DataFrame, quotas: DataFrame) -> DataFrame:
    """Distinct contents of each source against its quota."""
    n = captures.groupBy("source_id").agg(F.countDistinct("content_sha256").alias("groups"))
    out = quotas.join(n, "source_id", "left").withColumn("groups", F.coalesce("groups", F.lit(0)).cast("long"))
    return out.select("source_id", "groups", "quota", (F.col("groups") >= F.col("quota")).alias("quota_met"))


def run_completed(captures: DataFrame, quotas: DataFrame, target: int) -> bool:
    """Target reached and every quota met."""
    g = content_groups(captures, quotas).agg(F.sum("groups").alias("n"), F.bool_and("quota_met").alias("met")).first()
    return (g["n"] or 0) >= target and bool(g["met"])


def quiescent(tasks: DataFrame, outbox: DataFrame) -> DataFrame:
    """Runs with nothing pending or leased and no undelivered event."""
    t = tasks.groupBy("crawl_run_id").agg(F.count_if(F.col("status").isin("pending", "leased")).alias("open"))
    o = outbox.groupBy("crawl_run_id").agg(F.count_if(F.col("delivered_at").isNull()).alias("undelivered"))
    return t.join(o, "crawl_run_id", "left").select("crawl_run_id", ((F.col("open") == 0) & (F.coalesce("undelivered", F.lit(0)) == 0)).alias("quiescent"))


def missing_events(required: DataFrame, there: DataFrame, sample: int = 20) -> DataFrame:
    """Required events that are missing: how many of each run, and the first few in order."""
    gone = required.join(there.select("crawl_run_id", "event_id"), ["crawl_run_id", "event_id"], "left_anti")
    w = Window.partitionBy("crawl_run_id")
    ranked = gone.withColumn("n", F.count("*").over(w)).withColumn("r", F.row_number().over(w.orderBy("event_id"))).where(F.col("r") <= sample)
    return ranked.groupBy("crawl_run_id").agg(F.first("n").alias("missing_count"), F.array_sort(F.collect_list("event_id")).alias("sample"))


def due_deliveries(outbox: DataFrame, checkpoints: DataFrame, now: int, skip_waiting: bool) -> DataFrame:
    """Events a consumer hasn't acknowledged, oldest first. A relay stops at a head that is backing off; a poller may skip it."""
    j = outbox.join(checkpoints, ["crawl_run_id", "event_id"], "left").where("acked IS NULL OR NOT acked").withColumn("waiting", F.coalesce(F.col("next_attempt_at") > now, F.lit(False)))
    if skip_waiting:
        return j.where("NOT waiting").orderBy("created_at", "event_id")
    w = Window.partitionBy("crawl_run_id").orderBy("created_at", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return j.withColumn("held", F.max(F.col("waiting").cast("int")).over(w)).where("held = 0").drop("held").orderBy("created_at", "event_id")


# ------------------------------------------------------------ fairness
def fair_order(tasks: DataFrame, key: str, cursor: str, within: list[str]) -> DataFrame:
    """Round-robin claims: keys after the cursor first, then from the start, a task of each key a turn; ``turn`` counts from 1.

    A task's round is its place in its key. A turn is the number of tasks of earlier rounds, which one row per round adds up, and the key's place in the round.
    """
    ranked = keep(tasks.withColumn("__round", F.row_number().over(Window.partitionBy(key).orderBy(*within))), "rounds")
    place = F.row_number().over(Window.partitionBy("__round").orderBy(F.when(F.col(key) > cursor, 0).otherwise(1), key))
    sizes = numbered(ranked.groupBy("__round").agg(F.count("*").alias("__size")), ["__round"], "__n", "rounds")
    before = Window.partitionBy("__block").orderBy("__n").rowsBetween(Window.unboundedPreceding, -1)
    # Rounds are added up in blocks of a thousand, and so are blocks.
    blocks = sizes.withColumn("__block", F.floor(F.col("__n") / 1_000)).withColumn("__inside", F.coalesce(F.sum("__size").over(before), F.lit(0)))
    totals = blocks.groupBy("__block").agg(F.sum("__size").alias("__total"))
    earlier = totals.select("__block", F.coalesce(F.sum("__total").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__earlier"))
    offsets = blocks.join(earlier, "__block").select("__round", (F.col("__inside") + F.col("__earlier")).alias("__before"))
    return ranked.withColumn("__place", place).join(offsets, "__round").withColumn("turn", (F.col("__before") + F.col("__place")).cast("long")).drop("__round", "__place", "__before")


def select_permits(requests: DataFrame, spacing: DataFrame, limits: DataFrame, now: int, global_limit: int, default_limit: int, cursor: str) -> DataFrame:
    """Pending requests that may start, in fair order (``turn`` from 1): unexpired, room in all and in their origin, no open spacing on origin or key."""
    active = requests.where("status = 'active'").groupBy("origin").agg(F.count("*").alias("n"))
    total = active.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    held = spacing.where(F.col("until") > now).select("key")
    p = requests.where((F.col("status") == "pending") & (F.col("expires_at") > now)).join(active, "origin", "left").join(limits, "origin", "left").crossJoin(F.broadcast(total))
    p = p.where((F.col("total") < global_limit) & (F.coalesce("n", F.lit(0)) < F.coalesce("max_active", F.lit(default_limit))))
    p = p.join(held.withColumnRenamed("key", "origin"), "origin", "left_anti").join(held.withColumnRenamed("key", "schedule_key"), "schedule_key", "left_anti")
    return numbered(p.withColumn("__past", F.when(F.col("schedule_key") > cursor, 0).otherwise(1)), ["__past", "schedule_key", "queued_at", "request_id"], "turn", "permits").drop("__past")


def group_spacing(members: DataFrame) -> DataFrame:
    """A group's spacing is the largest of its members'."""
    return members.groupBy("group").agg(F.max("spacing_ms").alias("spacing_ms"))


# ------------------------------------------------------------ folds
# Fixed values of the throttle: first and largest back-off, floor, and the divisor of recovery.
FIRST_MS, MOST_MS, FLOOR_MS, RECOVERY = 1_000, 60_000, 100, 8
RETRYABLE = (408, 429, 500, 502, 503, 504)
RETRY_AFTER_CAP_S = 300


THROTTLED, HEALTHY, NEUTRAL = "throttled", "healthy", "neutral"


def signal(status: int | None) -> str:
    """What an answer says about its origin: 429 and 503 throttle, any other below 500 is healthy, other server errors and transport failures (null) say nothing."""
    if status in (429, 503):
        return THROTTLED
    return HEALTHY if status is not None and status < 500 else NEUTRAL


def next_backoff(extra: int, said: str) -> int:
    """Doubles from one second to a minute when throttled; falls by an eighth when healthy, to nothing below a tenth of a second; stays when neutral."""
    if said == THROTTLED:
        return min(MOST_MS, extra * 2 if extra >= FIRST_MS else FIRST_MS)
    less = extra - extra // RECOVERY
    return extra if said == NEUTRAL else 0 if less < FLOOR_MS else less


def outcome_status(outcome: Column | str) -> Column:
    """The status of a reported outcome: ``success`` as 200, ``http_<status>`` as that, any other (a transport failure) as null."""
    c = F.col(outcome) if isinstance(outcome, str) else outcome
    return F.when(c == "success", 200).otherwise(F.nullif(F.regexp_extract(c, r"^http_(\d{1,4})$", 1), F.lit("")).cast("int"))


def throttle(events: DataFrame, keys: list[str], order: str, status: str) -> DataFrame:
    """Back-off of each key after its answers in order: a fold over a sorted array, inside generated code."""
    seq = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(status)))), lambda x: x[status])
    grow = lambda a: F.least(F.lit(MOST_MS), F.when(a >= FIRST_MS, a * 2).otherwise(FIRST_MS))
    shrink = lambda a: F.when(a - F.floor(a / RECOVERY).cast("int") < FLOOR_MS, 0).otherwise(a - F.floor(a / RECOVERY).cast("int"))
    fold = F.aggregate(seq, F.lit(0), lambda a, s: F.when(s.isin(429, 503), grow(a)).when(s < 500, shrink(a)).otherwise(a).cast("int"))
    return events.groupBy(*keys).agg(fold.alias("backoff_ms"), F.count("*").alias("answers"))


def retry_after_ms(header: Column | str, now: Column | str) -> Column:
    """Milliseconds that a Retry-After header asks for: seconds, or one of the three forms of an HTTP date (a past one asks for none); else null."""
    c = F.trim(F.col(header) if isinstance(header, str) else header)
    at = F.col(now) if isinstance(now, str) else now
    part = lambda pattern: F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))
    fixed = F.try_to_timestamp(part(r"^[A-Z][a-z]{2}, (\d\d [A-Z][a-z]{2} \d{4} \d\d:\d\d:\d\d) GMT$"), F.lit("dd MMM yyyy HH:mm:ss"))
    short = F.try_to_timestamp(part(r"^[A-Z][a-z]{5,8}, (\d\d-[A-Z][a-z]{2}-\d\d \d\d:\d\d:\d\d) GMT$"), F.lit("dd-MMM-yy HH:mm:ss"))
    short = F.when(short > F.add_months(at, 600), short - F.expr("INTERVAL '100' YEAR")).otherwise(short)  # two digits of a year name the last century if else more than 50 years ahead
    old = F.try_to_timestamp(F.regexp_replace(part(r"^[A-Z][a-z]{2} ([A-Z][a-z]{2} [ \d]\d \d\d:\d\d:\d\d \d{4})$"), " +", " "), F.lit("MMM d HH:mm:ss yyyy"))
    wait = F.unix_millis(F.coalesce(fixed, short, old)) - F.unix_millis(at)
    seconds = F.when(c.rlike(r"^\+?\d{1,15}$"), F.regexp_replace(c, r"^\+", "").cast("long") * 1_000)
    return F.coalesce(seconds, F.when(wait < 0, 0).otherwise(wait)).cast("long")


def hold_ms(extra: Column | str, asked: Column | str) -> Column:
    """How long an origin waits after a throttling answer: its back-off, or what the header asks for (to its cap), whichever is longer."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return F.greatest(c(extra), F.least(F.coalesce(c(asked), F.lit(0)), F.lit(1_000 * RETRY_AFTER_CAP_S))).cast("long")


def retry_delay_ms(attempt, base: int, most: int):
    return F.least(F.lit(most).cast("double"), base * F.pow(F.lit(2.0), F.col(attempt) - 1)).cast("long")


def fold_leases(events: DataFrame, max_attempts: int = 3) -> DataFrame:
    """State of each task after its events in order: ``status, epoch, attempts, owner, stale``.

    claim (epoch + 1, if free), renew (owner only), expire (back to pending), fail (retry, or dead at the last attempt), succeed, requeue (a dead task starts afresh). Events
    that don't fit the state, as those of a worker that doesn't hold the lease, are stale and counted. A fold over a sorted array; a task's history is bounded by its attempts.
    """
    seq = F.array_sort(F.collect_list(F.struct("seq", "action", "worker")))

    def state(status, epoch, attempts, owner, stale):
        return F.struct(status.cast("string").alias("status"), epoch.cast("int").alias("epoch"), attempts.cast("int").alias("attempts"), owner.cast("string").alias("owner"), stale.cast("int").alias("stale"))

    def step(a, e):
        leased, mine = a["status"] == "leased", (a["status"] == "leased") & (a["owner"] == e["worker"])
        nobody = F.lit(None)
        return (
            F.when((e["action"] == "claim") & (a["status"] == "pending"), state(F.lit("leased"), a["epoch"] + 1, a["attempts"] + 1, e["worker"], a["stale"]))
            .when((e["action"] == "expire") & leased, state(F.lit("pending"), a["epoch"], a["attempts"], nobody, a["stale"]))
            .when((e["action"] == "renew") & mine, a)
            .when((e["action"] == "fail") & mine, state(F.when(a["attempts"] >= max_attempts, "failed").otherwise("pending"), a["epoch"], a["attempts"], nobody, a["stale"]))
            .when((e["action"] == "succeed") & mine, state(F.lit("succeeded"), a["epoch"], a["attempts"], nobody, a["stale"]))
            .when((e["action"] == "requeue") & (a["status"] == "failed"), state(F.lit("pending"), a["epoch"], F.lit(0), nobody, a["stale"]))
            .otherwise(state(a["status"], a["epoch"], a["attempts"], a["owner"], a["stale"] + 1))
        )

    start = state(F.lit("pending"), F.lit(0), F.lit(0), F.lit(None), F.lit(0))
    return events.groupBy("task_id").agg(F.aggregate(seq, start, step).alias("s")).select("task_id", "s.*")


def accept_results(attempts: DataFrame, leases: DataFrame) -> DataFrame:
    """What each delivered result is, in order: Stale for an unknown task; the first from the live lease is Accepted; after it, another owner or
    epoch is Stale, the same with another payload an Error, and the same again a Duplicate; without one, a lease that isn't live is Stale.

    attempts: task_id, seq, epoch, owner, payload; leases: task_id, live_epoch, live_owner.
    """
    j = attempts.join(leases, "task_id", "left")
    live = (F.col("epoch") == F.col("live_epoch")) & (F.col("owner") == F.col("live_owner"))
    w = Window.partitionBy("task_id")
    first = F.min(F.when(live, F.col("seq"))).over(w)
    j = j.withColumn("live", F.coalesce(live, F.lit(False))).withColumn("first", first).withColumn("accepted_payload", F.max(F.when(F.col("seq") == F.col("first"), F.col("payload"))).over(w))
    outcome = (
        F.when(F.col("live_epoch").isNull() | ~F.col("live"), "stale").when(F.col("seq") == F.col("first"), "accepted").when(F.col("payload") != F.col("accepted_payload"), "error").otherwise("duplicate")
    )
    return j.select("task_id", "seq", outcome.alias("outcome"))


# ------------------------------------------------------------ retention
def prunable(events: DataFrame, completed: DataFrame, consumers: DataFrame, receipts: DataFrame, now: int, broken: DataFrame | None = None) -> DataFrame:
    """Events that may go: their run is complete and its history fingerprint intact (it is not in ``broken``, see ``reconcile.fingerprint_check``), no active consumer's replay
    window is open, and every consumer that was required (not retired before the event) has a receipt.

    events: event_id, crawl_run_id, created_at; consumers: consumer, replay_window, retired_at; receipts: event_id, consumer.
    """
    c = F.broadcast(consumers.select("consumer", "replay_window", "retired_at"))  # a row per registered consumer
    widest = consumers.where("retired_at IS NULL").agg(F.max("replay_window").alias("w"))
    whole = completed if broken is None else completed.join(broken.select("crawl_run_id"), "crawl_run_id", "left_anti")
    done = events.join(whole, "crawl_run_id", "left_semi").crossJoin(F.broadcast(widest)).where(F.col("created_at") + F.coalesce("w", F.lit(0)) <= now).drop("w")
    owed = done.join(c, F.col("retired_at").isNull() | (F.col("retired_at") > F.col("created_at"))).join(receipts, ["event_id", "consumer"], "left_anti")
    return done.join(owed.select("event_id").distinct(), "event_id", "left_anti").select("event_id", "crawl_run_id")


def receipts_complete(receipts: DataFrame, batches: DataFrame) -> DataFrame:
    """Receipts that count: the batch is complete, counts and checksum are equal, nothing is quarantined."""
    return receipts.join(batches.where("status = 'complete'").select("batch_id", F.col("record_count").alias("n"), F.col("records_sha256").alias("sha")), "batch_id").where("record_count = n AND records_sha256 = sha AND quarantined = 0").drop("n", "sha")


def write_receipts(batches: DataFrame, consumer: str) -> DataFrame:
    """The receipt of each complete batch, as a row to append: a batch that isn't complete gets none."""
    done = batches.where("status = 'complete'")
    return done.select(F.lit(1).alias("schema_version"), F.lit(consumer).alias("consumer"), "batch_id", "record_count", "records_sha256", F.col("quarantined").alias("quarantined"))


# ------------------------------------------------------------ permits
def admit(requests: DataFrame, permits: DataFrame, policy: DataFrame, origins: DataFrame, spacing: DataFrame, now: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One admission in each run: ``(decisions, permits afterwards, spacing afterwards)``.

    requests: crawl_run_id, request_id, worker_id, schedule_key, origin, request_kind (one of each run, at most). permits: the same and status, queued_at, pending_deadline, expires_at.
    policy: crawl_run_id, global_concurrency, origin_concurrency, spacing_ms, lifetime_ms, max_attempts, max_pending, total_attempts, cursor. origins: crawl_run_id, origin,
    origin_concurrency, spacing_ms, group (or null). spacing: crawl_run_id, key, next_allowed_at.

    In order: active permits past their time expire and pending ones past their deadline go; a known request_id answers as it stands (with other metadata: an error); a new one
    is refused at the cap of pending requests, or else queued; at the cap of attempts it is refused and leaves the queue; the fair selection then starts one pending request, which
    must be the asked one to be acquired. A start takes an attempt, moves the cursor and spaces its origin and its group (by the group's largest spacing).
    """
    same = ["worker_id", "schedule_key", "origin", "request_kind"]
    live = permits.where((F.col("status") != "pending") | (F.col("pending_deadline") > now)).withColumn("status", F.when((F.col("status") == "active") & (F.col("expires_at") <= now), "expired").otherwise(F.col("status")))
    live = keep(live, "permits")
    prior = live.select("crawl_run_id", "request_id", *[F.col(c).alias(f"was_{c}") for c in (*same, "status")])
    queued = live.where("status = 'pending'").groupBy("crawl_run_id").agg(F.count("*").alias("waiting"))
    q = requests.join(prior, ["crawl_run_id", "request_id"], "left").join(queued, "crawl_run_id", "left").join(policy, "crawl_run_id")
    other = F.lit(False)
    for c in same:
        other = other | (F.col(c) != F.col(f"was_{c}"))
    known = F.col("was_status").isNotNull()
    spent = F.col("total_attempts") >= F.col("max_attempts")
    decision = (
        F.when(known & other, "error_reused_request_id").when(F.col("was_status") == "active", "acquired").when(F.col("was_status") == "completed", "already_completed")
        .when(known & (F.col("was_status") != "pending"), F.concat(F.lit("error_"), F.col("was_status"))).when(~known & (F.coalesce("waiting", F.lit(0)) >= F.col("max_pending")), "error_pending_limit").when(spent, "error_attempt_limit").otherwise("queued")
    )
    q = keep(q.withColumn("decision", decision).withColumn("known", known), "decided")
    asked = q.where("decision = 'queued'")
    columns = live.columns
    fresh = asked.where("NOT known").select("crawl_run_id", "request_id", *same, F.lit("pending").alias("status"), F.lit(now).cast("long").alias("queued_at"), (F.lit(now) + F.col("lifetime_ms")).cast("long").alias("pending_deadline"), F.lit(None).cast("long").alias("expires_at"))
    renewed = asked.where("known").select("crawl_run_id", "request_id", (F.lit(now) + F.col("lifetime_ms")).alias("__deadline"))
    refused = q.where("decision = 'error_attempt_limit'").select("crawl_run_id", "request_id", F.lit(True).alias("__refused"))
    state = live.join(renewed, ["crawl_run_id", "request_id"], "left").join(refused, ["crawl_run_id", "request_id"], "left").where("__refused IS NULL OR status <> 'pending'")
    state = state.withColumn("pending_deadline", F.coalesce("__deadline", "pending_deadline").cast("long")).select(columns).unionByName(fresh.select(columns))
    state = keep(state, "permits")
    active = state.where("status = 'active'")
    in_all = active.groupBy("crawl_run_id").agg(F.count("*").alias("n_all"))
    in_origin = active.groupBy("crawl_run_id", "origin").agg(F.count("*").alias("n_origin"))
    held = spacing.where(F.col("next_allowed_at") > now).select("crawl_run_id", "key").distinct()
    own = origins.select("crawl_run_id", "origin", F.col("origin_concurrency").alias("own_concurrency"), F.col("spacing_ms").alias("own_spacing"), "group")
    p = state.where("status = 'pending'").join(asked.select("crawl_run_id").distinct(), "crawl_run_id", "left_semi").join(policy, "crawl_run_id").join(own, ["crawl_run_id", "origin"], "left").join(in_all, "crawl_run_id", "left").join(in_origin, ["crawl_run_id", "origin"], "left")
    p = p.where((F.coalesce("n_all", F.lit(0)) < F.col("global_concurrency")) & (F.coalesce("n_origin", F.lit(0)) < F.coalesce("own_concurrency", "origin_concurrency")))
    p = p.join(held.withColumnRenamed("key", "origin"), ["crawl_run_id", "origin"], "left_anti").join(held.withColumnRenamed("key", "schedule_key"), ["crawl_run_id", "schedule_key"], "left_anti")
    past = F.when(F.col("cursor").isNull() | (F.col("schedule_key") > F.col("cursor")), 0).otherwise(1)
    chosen = keep(only_top(p, ["crawl_run_id"], [past, F.col("schedule_key"), F.col("queued_at"), F.col("request_id")]), "chosen")
    started = chosen.select("crawl_run_id", "request_id", (F.lit(now) + F.col("lifetime_ms")).cast("long").alias("__expires"))
    after = state.join(started, ["crawl_run_id", "request_id"], "left").withColumn("status", F.when(F.col("__expires").isNotNull(), "active").otherwise(F.col("status"))).withColumn("expires_at", F.coalesce("__expires", "expires_at")).select(columns)
    gaps = own.where("group IS NOT NULL").join(policy.select("crawl_run_id", F.col("spacing_ms").alias("default_ms")), "crawl_run_id")
    widest = group_spacing(gaps.select(F.struct("crawl_run_id", "group").alias("group"), F.coalesce("own_spacing", "default_ms").alias("spacing_ms"))).select("group.crawl_run_id", "group.group", F.col("spacing_ms").alias("group_ms"))
    marks = chosen.join(widest, ["crawl_run_id", "group"], "left")
    made = marks.select("crawl_run_id", F.col("origin").alias("key"), (F.lit(now) + F.coalesce("own_spacing", "spacing_ms")).cast("long").alias("next_allowed_at"))
    made = made.unionByName(marks.where("schedule_key <> origin").select("crawl_run_id", F.col("schedule_key").alias("key"), (F.lit(now) + F.coalesce("group_ms", "own_spacing", "spacing_ms")).cast("long").alias("next_allowed_at")))
    spaced = spacing.unionByName(made).groupBy("crawl_run_id", "key").agg(F.max("next_allowed_at").alias("next_allowed_at"))
    got = q.join(started.select("crawl_run_id", "request_id", F.lit(True).alias("__started")), ["crawl_run_id", "request_id"], "left")
    decisions = got.select("crawl_run_id", "request_id", F.when((F.col("decision") == "queued") & F.col("__started"), "acquired").otherwise(F.col("decision")).alias("decision"))
    return decisions, after, spaced
