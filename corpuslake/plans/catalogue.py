"""Every query of the engine, over the driver's tables, and its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslake.functions import text as tx
from corpuslake.functions import urls
from corpuslake.operators import dedup, evaluation, extract, frontier, history, operations, quality, recrawl, reconcile, search
from corpuslake.plans import derive as d
from corpuslake.plans import crawling, judging, storage
from corpuslake.plans.oracles import ORACLES as _ORACLES
from corpuslake.streaming import reduce as streaming

AS_OF = "2001-01-01T00:00:00Z"
QUERIES: dict = {**storage.QUERIES, **crawling.QUERIES, **judging.QUERIES}
ORACLES: dict[str, str] = {**_ORACLES, **storage.ORACLES, **crawling.ORACLES, **judging.ORACLES}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select([F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


# ------------------------------------------------------------ history
@query
def snapshot_changes(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(history.snapshot_changes(d.observations(spark, sf)))


@query
def change_rate(spark: SparkSession, sf: str) -> DataFrame:
    return history.change_rate_report(history.snapshot_changes(d.observations(spark, sf)))


def _captures_by_user(spark: SparkSession, sf: str) -> DataFrame:
    names = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    source = F.element_at(F.array(*map(F.lit, names)), (F.col("user_id") % 5 + 1).cast("int"))
    return d.table(spark, sf, "events").select(source.alias("source_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("captured_at"))


@query
def origin_freshness(spark: SparkSession, sf: str) -> DataFrame:
    return history.origin_freshness(d.observations(spark, sf), _captures_by_user(spark, sf))


@query
def freshness_by_origin(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(history.freshness_age(history.origin_freshness(d.observations(spark, sf), _captures_by_user(spark, sf)), AS_OF))


def _near_counts(spark: SparkSession, sf: str) -> DataFrame:
    return d.observations(spark, sf).where("page_id % 11 = 0").groupBy("snapshot_id", "origin").agg(F.count("*").alias("near_duplicate_page_count"))


def _rates(spark: SparkSession, sf: str) -> DataFrame:
    a = d.aliases(spark, sf)
    pages = d.observations(spark, sf).join(a.select("snapshot_id", "source_id", F.col("alias_page_id").alias("page_id")), ["snapshot_id", "source_id", "page_id"], "left_anti")
    return history.duplicate_rates(pages, a, _near_counts(spark, sf))


@query
def duplicate_rates(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_rates(spark, sf))


@query
def duplicate_rate_newest(spark: SparkSession, sf: str) -> DataFrame:
    return history.newest_duplicate_rates(_rates(spark, sf), history.origin_freshness(d.observations(spark, sf), _captures_by_user(spark, sf)))


@query
def scope_comparisons(spark: SparkSession, sf: str) -> DataFrame:
    return history.source_comparisons(d.sources(spark, sf)).select("snapshot_id", "source_id", "scope", "previous_snapshot_id", "previous_scope", "comparison_status")


@query
def page_change_observations(spark: SparkSession, sf: str) -> DataFrame:
    return history.page_changes(d.observations(spark, sf)).select("snapshot_id", "source_id", "page_id", "scope", "previous_snapshot_id", "change_status", "change_interval_start", "change_interval_end")


@query
def change_frequency_monthly(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(history.change_frequency(history.page_changes(d.observations(spark, sf))))


def _presence(spark: SparkSession, sf: str) -> DataFrame:
    o = d.observations(spark, sf).withColumn("page_id", F.col("page_id").cast("string"))
    return history.page_presence(o, d.sources(spark, sf), d.evidence(spark, sf))


@query
def page_presence(spark: SparkSession, sf: str) -> DataFrame:
    return _presence(spark, sf)


@query
def alias_observations(spark: SparkSession, sf: str) -> DataFrame:
    return history.alias_observations(d.aliases(spark, sf))


@query
def exact_alias_groups(spark: SparkSession, sf: str) -> DataFrame:
    return history.exact_alias_groups(d.aliases(spark, sf))


@query
def history_counts(spark: SparkSession, sf: str) -> DataFrame:
    return history.history_counts(d.sources(spark, sf), d.observations(spark, sf), d.aliases(spark, sf))


@query
def snapshot_count_report(spark: SparkSession, sf: str) -> DataFrame:
    s = d.sources(spark, sf)
    status = F.when(F.max("failed_count") > 0, "processing").otherwise("complete")
    batches = s.groupBy("snapshot_id").agg(F.sum("page_count").alias("expected_page_count"), status.alias("status")).select(F.concat(F.lit("b-"), F.col("snapshot_id")).alias("batch_id"), "snapshot_id", "status", "expected_page_count", F.lit(0).cast("long").alias("expected_alias_count"), F.lit(0).cast("long").alias("expected_passage_count"))
    records = d.observations(spark, sf).select(F.concat(F.lit("b-"), F.col("snapshot_id")).alias("batch_id"), F.lit("page").alias("record_type"))
    more = d.aliases(spark, sf).select(F.concat(F.lit("b-"), F.col("snapshot_id")).alias("batch_id"), F.lit("page_alias").alias("record_type"))
    return history.snapshot_count_report(batches, records.unionByName(more))


@query
def coverage_report(spark: SparkSession, sf: str) -> DataFrame:
    requests = d.observations(spark, sf).select("snapshot_id", "source_id", F.col("url").alias("requested_url"))
    return _rounded(history.coverage(d.sources(spark, sf), requests, d.evidence(spark, sf)))


@query
def page_freshness(spark: SparkSession, sf: str) -> DataFrame:
    o = d.observations(spark, sf).withColumn("page_id", F.col("page_id").cast("string"))
    return history.page_freshness(o, d.sources(spark, sf), _presence(spark, sf), "2001-01-01")


@query
def content_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = d.texts(spark, sf)
    pages = docs.select(F.col("lang").alias("snapshot_id"), F.col("source").alias("source_id"), F.col("doc_id").alias("page_id"), F.when(F.col("doc_id") % 9 != 0, F.substring("text", 1, 20)).alias("title"), F.col("text").alias("content"))
    lines = docs.where("doc_id % 13 <> 0").select(F.col("lang").alias("snapshot_id"), F.col("source").alias("source_id"), F.col("doc_id").alias("page_id"), F.explode(F.split("text", "\n")).alias("passage_id"))
    return history.content_quality(pages, lines)


@query
def manifest_page_requests(spark: SparkSession, sf: str) -> DataFrame:
    o = d.observations(spark, sf)
    page = F.struct("source_id", F.col("page_id").cast("string").alias("page_id"), F.col("url").alias("requested_url"))
    m = o.groupBy("snapshot_id").agg(F.to_json(F.struct(F.collect_list(page).alias("pages"))).alias("record_json"))
    return history.manifest_requests(m)


# ------------------------------------------------------------ operations and events
@query
def event_operational_summary(spark: SparkSession, sf: str) -> DataFrame:
    return operations.operational_summary(d.event_log(spark, sf))


@query
def event_error_rate(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(operations.error_rates(operations.operational_summary(d.event_log(spark, sf))))


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    e = d.table(spark, sf, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("snapshot_id")).agg(
        F.date_format(F.min("ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("started_at_utc"), F.date_format(F.max("ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("completed_at_utc"), F.count_if(F.col("event_type") == "purchase").alias("captured"), F.count_if(F.col("event_type") == "error").alias("failed")
    )
    doc = F.to_json(F.struct(F.lit("run-1").alias("run_id"), "started_at_utc", "completed_at_utc", F.struct(F.lit("frontier_exhausted").alias("stop_reason"), F.col("captured").alias("captured_page_count"), F.col("captured").alias("page_count"), F.col("failed").alias("failed_count")).alias("summary")))
    m = e.select(F.concat(F.lit("b-"), F.col("snapshot_id")).alias("batch_id"), "snapshot_id", doc.alias("record_json"))
    batches = m.select("batch_id", "snapshot_id", F.lit("complete").alias("status"), F.lit(True).alias("operational_log_present"))
    return operations.crawl_runs(batches, m)


@query
def crawl_run_report(spark: SparkSession, sf: str) -> DataFrame:
    return _runs(spark, sf).select("batch_id", "snapshot_id", "run_id", "started_at", "completed_at", "stop_reason", "captured_page_count", "page_count", "failed_count", "crawl_duration_seconds")


@query
def event_effectiveness(spark: SparkSession, sf: str) -> DataFrame:
    out = operations.effectiveness(_runs(spark, sf), operations.operational_summary(d.event_log(spark, sf)))
    return _rounded(out.select("snapshot_id", "captured_page_count", "task_claim_attempts", "capture_accept_event_count", "worker_task_failure_event_count", "page_rejected_event_count", "retry_claim_event_count", "captured_pages_per_task_claim", "fetch_failures_per_task_claim", "pages_per_minute", "attempt_denominator_status"))


@query
def ingestion_metrics(spark: SparkSession, sf: str) -> DataFrame:
    attempts = d.table(spark, sf, "events").select(F.col("event_id").alias("attempt_id"), F.concat(F.lit("b-"), F.date_format("ts", "yyyy-MM-dd")).alias("batch_id"), "user_id")
    return operations.ingestion_metrics(attempts, _runs(spark, sf))


def _durable(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Records, batches and quarantine of the durable events; batches are thousands of events, every seventh is still processing."""
    e = d.table(spark, sf, "events")
    batch = F.concat(F.lit("b"), F.floor(F.col("event_id") / 1000).cast("string"))
    run = F.concat(F.lit("run-"), (F.col("user_id") % 20).cast("string"))
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    kind = F.when(F.col("event_type") == "signup", "crawl_completed").when(F.col("event_type") == "purchase", "corpus_snapshot_published").otherwise("capture_committed")
    doc = F.to_json(F.struct(F.struct(F.concat(F.lit("r"), (F.col("event_id") % 3).cast("string")).alias("stop_reason"), F.concat(F.lit("snap-"), (F.col("event_id") % 17).cast("string")).alias("snapshot_id")).alias("data")))
    records = e.where("event_type <> 'error'").select(batch.alias("batch_id"), run.alias("crawl_run_id"), F.col("event_id").cast("string").alias("event_id"), kind.alias("event_type"), F.concat(F.lit("s"), (F.col("user_id") % 10).cast("string")).alias("source_id"), at.alias("event_at"), F.date_format(F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("event_id") % 90).cast("decimal(18,6)")), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("first_seen_at"), doc.alias("record_json"), F.when(F.col("event_id") % 4 == 0, "duplicate").otherwise("accepted").alias("disposition"))
    batches = e.select(batch.alias("batch_id"), run.alias("crawl_run_id"), F.when(F.floor(F.col("event_id") / 1000) % 7 == 6, "processing").otherwise("complete").alias("status")).distinct()
    return records, batches, e.where("event_type = 'error'").select(run.alias("crawl_run_id"))


@query
def event_run_status(spark: SparkSession, sf: str) -> DataFrame:
    records, batches, quarantine = _durable(spark, sf)
    return operations.run_status(records, batches, quarantine, "2024-12-31T00:00:00Z")


@query
def source_capture_summary(spark: SparkSession, sf: str) -> DataFrame:
    records, batches, _ = _durable(spark, sf)
    return operations.source_captures(records, batches, "2024-12-31T00:00:00Z")


@query
def event_ingestion_status(spark: SparkSession, sf: str) -> DataFrame:
    _, batches, _ = _durable(spark, sf)
    attempts = d.table(spark, sf, "events").select(F.concat(F.lit("b"), F.floor(F.col("event_id") / 1000).cast("string")).alias("batch_id"), F.col("event_id").alias("attempt_id"), F.date_format("ts", "yyyy-MM-dd").alias("started_at"), F.col("user_id").alias("execution_millis"))
    return operations.ingestion_status(batches.groupBy("batch_id").agg(F.max("status").alias("status")), attempts)


@query
def event_identity_split(spark: SparkSession, sf: str) -> DataFrame:
    from corpuslake.sources.batches import shape_event

    e = shape_event(d.durable_events(spark, sf))
    none = spark.createDataFrame([], "crawl_run_id string, event_id string, payload_sha256 string")
    return quality.split_events(e, none).select("line", "crawl_run_id", "event_id", "disposition")


@query
def rates_trailing(spark: SparkSession, sf: str) -> DataFrame:
    e = d.table(spark, sf, "events")
    shifted = e.select((F.lit("2024-06-01T00:00:00Z").cast("timestamp") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("event_id") % 1000).cast("decimal(18,6)"))).alias("at"))
    return _rounded(operations.trailing_rates(shifted, "at", "2024-06-01T00:00:00Z"))


@query
def counter_rates(spark: SparkSession, sf: str) -> DataFrame:
    e = d.table(spark, sf, "events").select((F.col("user_id") % 50).alias("series"), F.col("event_id").alias("n"), F.timestamp_seconds(F.col("event_id") * 30).alias("at"), (F.col("event_id") % 977).cast("double").alias("v"))
    return _rounded(operations.counter_increase(e, ["series"], "at", "v", 600).select("series", "n", "increase", "rate", "max_over_time"))


@query
def alert_hold(spark: SparkSession, sf: str) -> DataFrame:
    e = d.table(spark, sf, "events").select((F.col("user_id") % 20).alias("series"), F.col("event_id").alias("n"), F.timestamp_seconds(F.col("event_id") * 30).alias("at"), (F.col("event_type") != "error").alias("up"))
    return operations.held_for(e, ["series"], "at", F.col("up"), 1800).select("series", "n", "firing")


@query
def live_dashboard(spark: SparkSession, sf: str) -> DataFrame:
    return operations.dashboard(_tasks(spark, sf), 6, 12).select("task_id", "status", "pending_count", "leased_count", "succeeded_count", "failed_count")


# ------------------------------------------------------------ reconciliation, recrawl, replay
def _recrawl_inputs(spark: SparkSession, sf: str) -> DataFrame:
    s = d.sources(spark, sf).where("stop_reason = 'frontier_exhausted' AND failed_count = 0 AND scope = 'scope-0'")
    w = Window.partitionBy("source_id").orderBy(F.desc("observed_at"))
    last = s.withColumn("r", F.row_number().over(w)).where("r <= 3").groupBy("source_id").agg(F.array_sort(F.collect_list("snapshot_id")).alias("snapshot_ids"), F.max("observed_at").alias("newest"))
    return last.select(
        F.lit("g1").alias("generation_id"), "source_id", F.concat(F.substring("newest", 1, 10), F.lit("T12:00:00Z")).alias("generated_at"), F.lit("2030-01-01T00:00:00Z").alias("expires_at"), F.lit("p1").alias("expected_policy_version"),
        F.lit(6.0).alias("minimum_interval_hours"), F.lit(24.0).alias("current_interval_hours"), F.lit(168.0).alias("maximum_interval_hours"), F.lit(0.25).alias("max_adjustment_fraction"), F.lit(3).alias("minimum_completed_snapshots"),
        F.when(F.col("source_id") < "D", 1).otherwise(10_000_000).alias("minimum_comparable_page_observations"), F.lit(30).alias("maximum_evidence_age_days"), F.lit(3600).alias("maximum_provisional_event_age_seconds"),
        "snapshot_ids", F.lit(None).cast("string").alias("provisional_run_id"), F.array().cast("array<string>").alias("provisional_event_ids"),
    )


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    changes = history.page_changes(d.observations(spark, sf))
    events = spark.createDataFrame([], "crawl_run_id string, event_id string, source_id string, event_type string, event_at string")
    return recrawl.candidates(_recrawl_inputs(spark, sf), d.sources(spark, sf), changes, events)


@query
def recrawl_recommendation(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(recrawl.recommendations(_candidates(spark, sf)).select("source_id", "proposed_interval_hours", "adjustment_hours", "adjustment_type", "evidence_status", "comparable_page_observations", "changed_page_observations", "change_fraction", "confidence"))


@query
def recrawl_validation(spark: SparkSession, sf: str) -> DataFrame:
    return recrawl.validation(_candidates(spark, sf), AS_OF).select("source_id", "evidence_status", "validation_status", "validation_reason")


@query
def replay_equality(spark: SparkSession, sf: str) -> DataFrame:
    li = d.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    changed = li.where("l_orderkey % 100 <> 0").unionAll(li.where("l_orderkey % 250 = 1"))
    diff = reconcile.multiset_difference(li, changed)
    return diff.agg(F.count("*").alias("differing_rows"), F.sum("left_count").alias("left_rows"), F.sum("right_count").alias("right_rows"))


@query
def fingerprint_coverage(spark: SparkSession, sf: str) -> DataFrame:
    e = d.table(spark, sf, "events").withColumn("g", F.col("user_id") % 25)
    return reconcile.fingerprints(e, ["g"], ["event_id", "user_id", "event_type"])


# ------------------------------------------------------------ captures, duplicates and text
@query
def url_winner_select(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.url_winners(d.captures(spark, sf)).select("source_id", "final_url", "row_id")


@query
def capture_status(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.reduce_captures(d.captures(spark, sf))[2].select("row_id", "admission_status", "selection_reason")


@query
def capture_aliases(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.reduce_captures(d.captures(spark, sf))[1]


@query
def simhash_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return d.texts(spark, sf).select("doc_id", tx.simhash64("text").alias("fingerprint"))


@query
def near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.near_duplicates(d.texts(spark, sf), "lang", ["doc_id"], "text").select("lang", "doc_id", "ordinal", "near_ordinal", "distance")


@query
def near_duplicate_report(spark: SparkSession, sf: str) -> DataFrame:
    docs = d.texts(spark, sf)
    near = dedup.near_duplicates(docs, "lang", ["doc_id"], "text")
    return _rounded(dedup.near_report(docs, near, docs.where("doc_id % 10 = 0"), "lang"))


@query
def shingle_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    docs = d.texts(spark, sf).withColumn("sha", F.sha2("text", 256))
    return _rounded(dedup.shingle_similarity(docs, ["doc_id"], "text", "sha", sample=None, max_chars=None, max_bytes=None))


@query
def html_extract(spark: SparkSession, sf: str) -> DataFrame:
    p = extract.extract_html(d.table(spark, sf, "pages").select("page_id", "url", "html"))
    return p.select("page_id", "extracted.extraction_method", "extracted.title", "extracted.language", "extracted.useful_chars", F.size("extracted.links").alias("link_count"), "extracted.error")


@query
def url_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return d.table(spark, sf, "pages").select("page_id", urls.normalize_url("url").alias("normalized"), urls.origin_key("url").alias("origin"))


@query
def url_owner(spark: SparkSession, sf: str) -> DataFrame:
    p = d.table(spark, sf, "pages").select("page_id", "url")
    origins = p.select(urls.origin_key("url").alias("o")).distinct().agg(F.array_sort(F.collect_set("o")).alias("allowed_origins"))
    kinds = spark.createDataFrame([(1, "en", ["/en/1"], ["/en/10"]), (2, "fr", ["/fr"], []), (3, "rest", ["/"], ["/de/2"])], "ordinal int, source_id string, path_prefixes array<string>, deny_prefixes array<string>")
    src = kinds.crossJoin(F.broadcast(origins)).withColumn("allowed_urls", F.lit(None).cast("array<string>"))
    return urls.owner_of(p, src).select("page_id", "owner")


@query
def robots_allows(spark: SparkSession, sf: str) -> DataFrame:
    p = d.table(spark, sf, "pages").select("page_id", "url")
    text = "User-agent: *\nDisallow: /\n\nUser-agent: mybot\nDisallow: /fr\nAllow: /fr/1\nDisallow: /en/2\nAllow: /en/2"
    r = urls.robots_table(p.select(urls.origin_key("url").alias("origin"), F.lit(text).alias("text")).distinct(), "origin", "text")
    return urls.robots_allows(p, r, "MyBot").select("page_id", "allowed")


@query
def sitemap_locs(spark: SparkSession, sf: str) -> DataFrame:
    g = d.table(spark, sf, "pages").groupBy((F.col("page_id") % 20).alias("g")).agg(F.concat(F.lit("<urlset>"), F.array_join(F.collect_list(F.concat(F.lit("<url><LOC> "), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</LOC></url>"))), ""), F.lit("</urlset>")).alias("x"))
    return g.select("g", F.explode(urls.sitemap_locs("x")).alias("loc"))


# ------------------------------------------------------------ retrieval
@query
def cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    e = d.table(spark, sf, "embeddings")
    v = e.select(F.col("vec_id").alias("passage_id"), F.col("label").cast("string").alias("source_id"), F.col("embedding").alias("vector"))
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return _rounded(search.vector_topk(v, q, 10).select("query_id", "rank", "passage_id", "score"))


@query
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    q = d.keyword_queries(spark, sf).where("query_id % 2 = 0")
    index = search.build_postings(d.catalog(spark, sf), ("title", "body"), q)
    return _rounded(search.keyword_topk(*index, q, 10).select("query_id", "rank", "passage_id", "score"))


@query
def bm25_indexed(spark: SparkSession, sf: str) -> DataFrame:
    """All queries, words and phrases, on an index that was written before."""
    from corpuslake.session import scratch_path

    folder, q = scratch_path(spark, "index"), d.keyword_queries(spark, sf)
    search.write_index(d.catalog(spark, sf), folder, ("title", "body"), 64)
    return _rounded(search.keyword_topk(*search.open_index(spark, folder, q), q, 10).select("query_id", "rank", "passage_id", "score"))


@query
def keyword_phrase(spark: SparkSession, sf: str) -> DataFrame:
    q = d.keyword_queries(spark, sf).where("query_id % 2 = 1")
    index = search.build_postings(d.catalog(spark, sf), ("title", "body"), q)
    return _rounded(search.keyword_topk(*index, q, 10).select("query_id", "rank", "passage_id", "score"))


def _two_rankings(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    docs = d.table(spark, sf, "documents").select((F.col("doc_id") % 16).alias("query_id"), F.col("doc_id").alias("passage_id"), "n_chars")
    by = lambda *o: F.row_number().over(Window.partitionBy("query_id").orderBy(*o))
    return docs.withColumn("rank", by(F.desc("n_chars"), "passage_id")), docs.withColumn("rank", by(F.col("passage_id") % 37, "passage_id"))


@query
def rrf_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(search.rrf(*_two_rankings(spark, sf), depth=50), 9)


@query
def page_group_max(spark: SparkSession, sf: str) -> DataFrame:
    out = search.page_results(search.rrf(*_two_rankings(spark, sf), depth=50), d.catalog(spark, sf), 10)
    return _rounded(out.select("query_id", "rank", "page_id", "score", "winning_passage_id"), 9)


@query
def catalog_keys(spark: SparkSession, sf: str) -> DataFrame:
    c = d.catalog(spark, sf).withColumnRenamed("body", "content")
    a = d.table(spark, sf, "documents").where("doc_id % 25 = 3").select(F.floor(F.col("doc_id") / 20).cast("long").alias("representative_page_id"), F.col("doc_id").alias("alias_page_id"))
    return search.build_catalog(c, a).select("passage_id", "page_id", "vector_key", F.size("alias_page_ids").alias("alias_count"), F.sha2("text", 256).alias("text_sha256"))


# ------------------------------------------------------------ evaluation and statistics
def _evaluation(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    docs = d.table(spark, sf, "documents").join(d.table(spark, sf, "labels"), "doc_id").select((F.col("doc_id") % 12).cast("string").alias("query_id"), F.col("doc_id").alias("page_id"), "n_chars", (F.col("quality") * 2 + F.col("toxic")).cast("int").alias("grade"))
    rank = lambda mode, *o: docs.select(F.lit(mode).alias("mode"), "query_id", "page_id", F.row_number().over(Window.partitionBy("query_id").orderBy(*o)).alias("rank"))
    return rank("length", F.desc("n_chars"), "page_id").unionByName(rank("modulo", F.col("page_id") % 31, "page_id")), docs.select("query_id", "page_id", "grade")


@query
def ndcg_mrr_recall(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(evaluation.ranking_metrics(*_evaluation(spark, sf), strict=False))


@query
def eval_slices(spark: SparkSession, sf: str) -> DataFrame:
    m = evaluation.ranking_metrics(*_evaluation(spark, sf), strict=False)
    n = F.col("query_id").cast("int")
    q = m.select("query_id").distinct().select("query_id", F.when(n < 4, "development").otherwise("held-out").alias("split"), F.concat(F.lit("s"), (n % 2).cast("string")).alias("source"), F.concat(F.lit("i"), (n % 3).cast("string")).alias("intent"))
    return _rounded(evaluation.slices(m, q))


@query
def latency_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(evaluation.distribution(d.table(spark, sf, "events"), "value", ["event_type"]))


@query
def scaling_table(spark: SparkSession, sf: str) -> DataFrame:
    e = d.table(spark, sf, "events").select(F.pow(F.lit(2), F.col("user_id") % 4).cast("long").alias("w"), (F.col("value") * F.pow(F.lit(1.8), F.col("user_id") % 4)).alias("v"))
    return _rounded(evaluation.scaling(e, "w", "v"))


@query
def histogram_buckets(spark: SparkSession, sf: str) -> DataFrame:
    e = d.table(spark, sf, "events").withColumn("part", (F.col("event_id") % 700).cast("string"))  # more series than have a name of their own
    return evaluation.cumulative_buckets(e, ["part", "event_type"], "value", [5.0, 10.0, 20.0, 50.0, 100.0])


@query
def latency_pairs(spark: SparkSession, sf: str) -> DataFrame:
    e = d.table(spark, sf, "events").select("user_id", F.when(F.col("event_type") == "view", "start").when(F.col("event_type") == "click", "finish").otherwise("other").alias("kind"), F.col("event_id").alias("at"))
    return evaluation.pair_latencies(e, ["user_id"]).groupBy("user_id").agg(F.count("*").alias("n"), F.sum("latency").alias("total"))


@query
def crawl_windows(spark: SparkSession, sf: str) -> DataFrame:
    e = d.table(spark, sf, "events").select((F.col("user_id") % 7).alias("run"), (F.col("user_id") % 3).alias("worker"), F.col("event_id").alias("at"), F.col("event_type"))
    return evaluation.crawl_window(e.where("event_type = 'view'"), e.where("event_type = 'click'"))


# ------------------------------------------------------------ lake and quality
@query
def merge_insert_idempotent(spark: SparkSession, sf: str) -> DataFrame:
    """Two loads of nations and regions into a fresh table; the second inserts nothing."""
    from corpuslake.session import scratch_path
    from corpuslake.sources.lake import Table

    n = d.table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("r"))
    t = Table(spark, scratch_path(spark, "lake"), "nations", "k int, name string, r int", ["k"])
    t.merge_insert(n.where("k < 20"), {"load_id": "1"})
    t.merge_insert(n.unionAll(n), {"load_id": "2"})
    version, rows = t.merge_insert(n)
    return t.read().withColumn("versions", F.lit(t.version() + 1)).withColumn("third_load_rows", F.lit(rows)).withColumn("third_load_committed", F.lit(version is not None))


@query
def lineage_history(spark: SparkSession, sf: str) -> DataFrame:
    from corpuslake.session import scratch_path
    from corpuslake.sources.lake import Table, lineage

    root = scratch_path(spark, "lake")
    r = d.table(spark, sf, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"))
    t = Table(spark, root, "regions", "k int, name string", ["k"])
    for i in (1, 2):
        t.merge_insert(r.where(f"k < {2 * i}"), {"load_id": f"load-{i}", "snapshot_id": f"snap-{i}"})
    log = Table(spark, root, "lineage_loads", "table_name string, table_version bigint, row_count bigint, load_id string, run_id string, snapshot_id string, batch_id string, input_kind string, input_ref string, silver_versions string", ["table_name", "table_version"])
    lineage([t], log)
    lineage([t], log)
    return log.read().select("table_name", "table_version", "row_count", "load_id", "snapshot_id")


def checked(spark: SparkSession, *results) -> DataFrame:
    """Rules with how many rows fail and the first examples."""
    return spark.createDataFrame([(r.rule, r.failing, ",".join(r.examples)) for r in results], "rule string, failing bigint, examples string")


@query
def dq_unique(spark: SparkSession, sf: str) -> DataFrame:
    li = d.table(spark, sf, "lineitem").withColumn("k", F.col("l_orderkey") % 1000)
    return checked(spark, quality.unique(li, ["k", "l_linenumber"], "unique.lines"))


@query
def dq_referential(spark: SparkSession, sf: str) -> DataFrame:
    li, o = d.table(spark, sf, "lineitem"), d.table(spark, sf, "orders").where("o_orderkey % 5 <> 0")
    return checked(spark, quality.referential(li, o, {"l_orderkey": "o_orderkey"}, ["l_orderkey", "l_linenumber"], "referential.lines"))


@query
def dq_counts(spark: SparkSession, sf: str) -> DataFrame:
    o = d.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.lit(4).cast("long").alias("lines"))
    n = d.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("lines"))
    return checked(spark, quality.counts_match(o, n, ["k"], ["lines"], "counts.lines"))


@query
def dq_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Rules of the library over customers and orders, as a table."""
    c, o = d.table(spark, sf, "customer"), d.table(spark, sf, "orders")
    checks = [
        quality.unique(c, ["c_custkey"]), quality.not_null(c, ["c_name", "c_mktsegment"], ["c_custkey"]), quality.unique(o, ["o_custkey", "o_orderstatus"], "unique.customer_status"),
        quality.referential(o, c.where("c_custkey % 50 <> 7"), {"o_custkey": "c_custkey"}, ["o_orderkey"], "referential.customer"), quality.types(c.withColumn("x", F.concat(F.lit("1"), F.when(F.col("c_custkey") % 100 == 3, "x").otherwise("0"))), {"x": "int"}, ["c_custkey"]),
    ]
    return spark.createDataFrame([(r.rule, r.failing) for r in checks], "rule string, failing bigint")


# ------------------------------------------------------------ frontier and streaming
def _tasks(spark: SparkSession, sf: str) -> DataFrame:
    o = d.table(spark, sf, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("o_orderkey") % 11 == 0, "failed").when(F.col("o_orderstatus") == "P", "leased").otherwise("pending")
    return o.select(
        F.col("o_orderkey").alias("task_id"), F.lit("run-1").alias("crawl_run_id"), F.concat(F.lit("s"), (F.col("o_custkey") % 8).cast("string")).alias("source_id"), F.concat(F.lit("k"), (F.col("o_custkey") % 30).cast("string")).alias("schedule_key"),
        status.alias("status"), (F.col("o_orderkey") % 1000).alias("lease_expires_at"), (F.col("o_custkey") % 100).alias("retry_at"), (F.col("o_orderkey") % 5).alias("attempts"),
    )


@query
def frontier_status_counts(spark: SparkSession, sf: str) -> DataFrame:
    return frontier.status_counts(_tasks(spark, sf), now=500)


@query
def unfinished_counts(spark: SparkSession, sf: str) -> DataFrame:
    return frontier.unfinished_counts(_tasks(spark, sf), ["s0", "s3"])


@query
def fair_claim_order(spark: SparkSession, sf: str) -> DataFrame:
    return frontier.fair_order(_tasks(spark, sf).where("status = 'pending' AND retry_at <= 50"), "schedule_key", "k2", ["retry_at", "task_id"]).select("schedule_key", "task_id", "turn")


@query
def dead_letters(spark: SparkSession, sf: str) -> DataFrame:
    return frontier.dead_letters(_tasks(spark, sf)).select("task_id", "source_id", "attempts")


@query
def enqueue_new(spark: SparkSession, sf: str) -> DataFrame:
    c = d.captures(spark, sf).select("source_id", F.col("final_url").alias("url"))
    return frontier.enqueue(c.where("length(url) % 2 = 0"), c)


@query
def source_completion(spark: SparkSession, sf: str) -> DataFrame:
    groups = d.captures(spark, sf).select("source_id", "content_sha256")
    quota = spark.createDataFrame([("s0", 10), ("s1", 10_000_000), ("s2", 100)], "source_id string, quota bigint")
    return frontier.content_groups(groups, quota)


def _answers():
    """Every kind of answer: throttling, healthy, server errors, and a transport failure as null."""
    kind = F.col("event_type")
    outcome = F.when(F.col("event_id") % 13 == 0, "transport_error").when(kind == "error", "http_429").when(kind == "signup", "http_503").when(kind == "purchase", "http_500").when(kind == "click", "http_404").otherwise("success")
    return frontier.outcome_status(outcome)


@query
def throttle_fold(spark: SparkSession, sf: str) -> DataFrame:
    e = d.table(spark, sf, "events").select("user_id", "event_id", _answers().alias("status"))
    return frontier.throttle(e, ["user_id"], "event_id", "status")


@query
def lease_fold(spark: SparkSession, sf: str) -> DataFrame:
    e = d.table(spark, sf, "events")
    action = F.when(F.col("event_type") == "view", "claim").when(F.col("event_type") == "click", "renew").when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "purchase", "succeed").otherwise("expire")
    ev = e.select(F.concat(F.lit("t"), (F.col("user_id") % 300).cast("string")).alias("task_id"), F.col("event_id").alias("seq"), action.alias("action"), (F.col("event_id") % 4).cast("string").alias("worker"))
    return frontier.fold_leases(ev)


@query
def result_acceptance(spark: SparkSession, sf: str) -> DataFrame:
    li = d.table(spark, sf, "lineitem")
    a = li.select(F.col("l_orderkey").alias("task_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), (F.col("l_linenumber") % 2).alias("epoch"), (F.col("l_suppkey") % 2).alias("owner"), F.col("l_quantity").cast("int").alias("payload"))
    return frontier.accept_results(a, li.select(F.col("l_orderkey").alias("task_id"), F.lit(1).alias("live_epoch"), (F.col("l_orderkey") % 2).alias("live_owner")).distinct())


@query
def retention_blockers(spark: SparkSession, sf: str) -> DataFrame:
    e = d.table(spark, sf, "events").select("event_id", F.concat(F.lit("run-"), (F.col("user_id") % 20).cast("string")).alias("crawl_run_id"), (F.col("event_id") % 1000).alias("created_at"))
    done = spark.createDataFrame([(f"run-{i}",) for i in range(0, 20, 2)], "crawl_run_id string")
    consumers = spark.createDataFrame([("a", 300, None), ("b", 0, 400)], "consumer string, replay_window bigint, retired_at bigint")
    receipts = e.where("event_id % 3 <> 0").select("event_id", F.lit("a").alias("consumer")).unionByName(e.where("event_id % 5 <> 0").select("event_id", F.lit("b").alias("consumer")))
    recorded = reconcile.fingerprints(e.where("NOT (crawl_run_id = 'run-4' AND event_id % 500 = 24)"), ["crawl_run_id"], ["event_id"])
    broken = reconcile.fingerprint_check(reconcile.fingerprints(e, ["crawl_run_id"], ["event_id"]), recorded, ["crawl_run_id"])
    return frontier.prunable(e, done, consumers, receipts, now=1000, broken=broken)


@query
def recrawl_schedule(spark: SparkSession, sf: str) -> DataFrame:
    c = d.table(spark, sf, "customer")
    p = c.select(F.col("c_custkey").alias("source_id"), (F.col("c_custkey") % 48 + 1).cast("double").alias("interval_hours"), F.when(F.col("c_custkey") % 10 != 0, F.timestamp_seconds(F.lit(946684800) - F.col("c_custkey") * 600)).alias("last_scheduled_at"), (F.col("c_custkey") % 6 != 0).alias("enabled"))
    return recrawl.schedule(p, "2000-01-01T00:00:00Z").select("source_id", F.unix_timestamp("next_due_at").alias("next_due"), "due")


@query
def redirect_chains(spark: SparkSession, sf: str) -> DataFrame:
    n = d.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("url"), ((F.col("c_custkey") * 7 + 3) % 200).cast("string").alias("location"))
    return urls.resolve_redirects(n.select("url"), n).select("url", "final_url", F.size("chain").alias("hops"), "outcome")


@query
def link_frontier(spark: SparkSession, sf: str) -> DataFrame:
    li = d.table(spark, sf, "lineitem").select((F.col("l_partkey") % 500).cast("string").alias("url"), (F.col("l_suppkey") * 7 % 500).cast("string").alias("target")).distinct()
    return urls.links_frontier(spark.createDataFrame([("1",)], "url string"), li, 100_000)


@query
def permit_selection(spark: SparkSession, sf: str) -> DataFrame:
    o = d.table(spark, sf, "orders").select(F.col("o_orderkey").alias("request_id"), F.concat(F.lit("o"), (F.col("o_custkey") % 40).cast("string")).alias("origin"), F.concat(F.lit("k"), (F.col("o_custkey") % 40).cast("string")).alias("schedule_key"), F.when(F.col("o_orderkey") % 50 == 1, "active").otherwise("pending").alias("status"), (F.col("o_orderkey") % 97).alias("queued_at"), (F.col("o_orderkey") % 1000).alias("expires_at"))
    spacing = spark.createDataFrame([("o3", 900), ("o5", 100)], "key string, until bigint")
    limits = spark.createDataFrame([("o7", 100_000)], "origin string, max_active bigint")
    return frontier.select_permits(o, spacing, limits, now=500, global_limit=1_000_000, default_limit=5, cursor="k12").select("request_id", "origin", "queued_at", "turn")


@query
def stream_reduce(spark: SparkSession, sf: str) -> DataFrame:
    """All durable lines through the streaming reducer in several micro-batches, available now, and then once more: what each run accepted and held, and what the replay added."""
    from corpuslake.session import scratch_path

    root = scratch_path(spark, "stream")
    lines = d.durable_events(spark, sf).select("record_json")
    lines.repartition(4).write.text(f"{root}/in")
    t = streaming.run_reduce(spark, f"{root}/in", root, max_files=2)
    before = t.table.read().count()
    lines.repartition(2).write.mode("append").text(f"{root}/in")
    added = streaming.run_reduce(spark, f"{root}/in", root).table.read().count() - before
    of = lambda s: F.count_if(F.col("disposition") == s)
    return t.table.read().groupBy("crawl_run_id").agg(of("accepted").alias("accepted"), of("identity_conflict").alias("conflicts"), of("quarantined").alias("quarantined")).withColumn("added_by_replay", F.lit(added))
