"""Queries of reconciliation, quality rules, recrawl policy, evaluation and passages, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslake.operators import evaluation, operations, quality, reconcile, recrawl, search
from corpuslake.operators.evaluation import paired_bootstrap
from corpuslake.plans import derive as d
from corpuslake.plans.oracles import _RECRAWL, EVAL, EVI
from corpuslake.session import keep, scratch_path
from corpuslake.sources import batches
from corpuslake.sources.lake import Files

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def checked(spark: SparkSession, *results) -> DataFrame:
    return spark.createDataFrame([(r.rule, r.failing, ",".join(r.examples)) for r in results], "rule string, failing bigint, examples string")


# ------------------------------------------------------------ reconciliation
def _events(spark: SparkSession, sf: str) -> DataFrame:
    """An order is a capture of one of twenty runs, delivered in one of thirteen batches and partly again; runs 0 to 16 and 19 publish, but for run 7."""
    o = d.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 20).alias("r"))
    run = F.concat(F.lit("run-"), F.col("r").cast("string"))
    text = lambda p, x: F.concat(F.lit(p), F.col(x).cast("string"))
    task = F.when(F.col("r") == 8, F.floor(F.col("k") / 40) * 40).otherwise(F.col("k"))
    doc = F.to_json(F.struct(F.struct(task.alias("task_id"), F.concat(F.lit("c"), (F.col("k") % 7).cast("string")).alias("content_sha256"), F.struct(text("y", "k").alias("sha256")).alias("body_artifact")).alias("data")))
    caps = o.select(run.alias("crawl_run_id"), text("c", "k").alias("event_id"), F.lit("capture_committed").alias("event_type"), F.concat(F.lit("s"), (F.col("k") % 3).cast("string")).alias("source_id"), doc.alias("record_json"), F.concat(F.lit("b"), (F.col("k") % 13).cast("string")).alias("batch_id"), (F.col("k") % 3 == 0).alias("again"))
    p = spark.range(20).withColumnRenamed("id", "r").where("r < 17 OR r = 19").where("r <> 7")
    said = F.to_json(F.struct(F.struct(text("snap-", "r").alias("snapshot_id"), F.struct(F.when(F.col("r") == 6, "other").otherwise(text("s", "r")).alias("sha256")).alias("snapshot_manifest"), F.struct(text("m", "r").alias("sha256"), (F.col("r") + 100).alias("byte_size")).alias("crawl_manifest"), F.lit(10).alias("page_count"), F.lit(2).alias("alias_count"), F.lit(30).alias("passage_count")).alias("data")))
    pubs = p.select(run.alias("crawl_run_id"), text("p", "r").alias("event_id"), F.lit("corpus_snapshot_published").alias("event_type"), F.lit(None).cast("string").alias("source_id"), said.alias("record_json"), F.lit("b0").alias("batch_id"), F.lit(False).alias("again"))
    identity = caps.unionByName(pubs)
    records = identity.withColumn("disposition", F.lit("accepted")).unionByName(identity.where("again").withColumns({"batch_id": F.lit("d"), "disposition": F.lit("duplicate")}))
    done = records.select("batch_id", "crawl_run_id").distinct().withColumn("status", F.when(F.col("batch_id") == "b5", "processing").otherwise("complete"))
    return reconcile.complete_events(identity.drop("batch_id", "again"), records, done)


def _judged(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    events = keep(_events(spark, sf), "events")
    n = events.where("event_type = 'capture_committed'").groupBy("crawl_run_id").agg(F.count("*").alias("n"))
    s = spark.range(17).withColumnRenamed("id", "r").withColumn("crawl_run_id", F.concat(F.lit("run-"), F.col("r").cast("string"))).join(n, "crawl_run_id", "left")
    text = lambda p: F.concat(F.lit(p), F.col("r").cast("string"))
    s = s.select(
        "crawl_run_id", text("snap-").alias("snapshot_id"), text("b").alias("batch_id"), text("s").alias("snapshot_sha"), text("m").alias("crawl_sha"), (F.col("r") + 100).alias("crawl_bytes"), F.lit(10).cast("long").alias("page_count"), F.lit(2).cast("long").alias("alias_count"), F.lit(30).cast("long").alias("passage_count"),
        (F.coalesce("n", F.lit(0)) + F.when(F.col("r") % 5 == 1, 1).when(F.col("r") % 5 == 2, -1).otherwise(0)).alias("capture_count"), (F.col("r") != 3).alias("manifest_ok"),
    )
    s = s.unionByName(s.where("crawl_run_id = 'run-4'").withColumn("page_count", F.lit(11).cast("long")))
    runs = spark.range(20).select(F.concat(F.lit("run-"), F.col("id").cast("string")).alias("crawl_run_id"))
    return events, keep(reconcile.authority(events, s, runs), "judged")


JUDGED = """
ce AS (SELECT o_orderkey AS k, o_orderkey % 20 AS r FROM orders WHERE o_orderkey % 13 <> 5 OR o_orderkey % 3 = 0),
cn AS (SELECT r, count(*) AS n, count(DISTINCT CASE WHEN r = 8 THEN k // 40 * 40 ELSE k END) AS t FROM ce GROUP BY 1),
rs AS (SELECT i AS r, coalesce(n, 0) AS n, coalesce(t, 0) AS t, coalesce(n, 0) + CASE i % 5 WHEN 1 THEN 1 WHEN 2 THEN -1 ELSE 0 END AS want FROM range(20) g(i) LEFT JOIN cn ON cn.r = i),
ju AS (SELECT r, n, CASE WHEN r < 17 THEN want END AS want, CASE WHEN r IN (6, 7) OR r >= 17 THEN 0 ELSE 1 END AS matching, CASE WHEN r IN (7, 17, 18) THEN 0 ELSE 1 END AS seen,
  CASE WHEN r IN (17, 18) THEN 'provisional_no_validated_snapshot' WHEN r = 19 THEN 'awaiting_validated_snapshot_batch' WHEN r = 4 THEN 'snapshot_metadata_conflict' WHEN r = 3 THEN 'snapshot_manifest_mismatch' WHEN r = 6 THEN 'publication_binding_mismatch' WHEN r = 7 THEN 'awaiting_publication_event'
    WHEN n < want THEN 'awaiting_capture_events' WHEN n > want OR t <> n THEN 'capture_event_count_mismatch' ELSE 'authoritative' END AS status FROM rs)"""


@query(f"""WITH {JUDGED} SELECT 'run-' || r::VARCHAR AS crawl_run_id, CASE WHEN r NOT IN (17, 18) THEN 'snap-' || r::VARCHAR END AS snapshot_id, CASE WHEN r IN (17, 18) THEN 0 ELSE n END AS capture_event_count, want AS expected_capture_count, matching AS matching_publications, seen AS publications_seen, status AS authority_status FROM ju""")
def reconcile_authority(spark: SparkSession, sf: str) -> DataFrame:
    return _judged(spark, sf)[1]


def _captured(spark: SparkSession, sf: str) -> DataFrame:
    o = d.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 20).cast("string").alias("r"))
    text = lambda p, x="k": F.concat(F.lit(p), F.col(x).cast("string"))
    return o.select("k", text("run-", "r").alias("crawl_run_id"), text("snap-", "r").alias("snapshot_id"), F.concat(F.lit("s"), (F.col("k") % 3).cast("string")).alias("source_id"), text("u").alias("requested_url"), text("p").alias("page_id"), text("y").alias("body_sha256"), F.concat(F.lit("c"), (F.col("k") % 7).cast("string")).alias("content_sha256"))


@query(f"""WITH {JUDGED}, x AS (SELECT k, status = 'authoritative' AS sure FROM ce JOIN ju ON ju.r = ce.r)
SELECT 'c' || k::VARCHAR AS event_id, CASE WHEN NOT sure THEN 'provisional_snapshot_or_capture_gate' WHEN k % 10 = 9 OR (k % 4 = 1 AND k % 8 <> 1) THEN 'provisional_unmatched' WHEN k % 10 = 8 THEN 'provisional_ambiguous' WHEN k % 4 = 0 THEN 'authoritative_admitted' WHEN k % 4 = 1 THEN 'authoritative_alias' WHEN k % 4 = 2 THEN 'authoritative_superseded' ELSE 'provisional_unknown_admission' END AS reconciliation_status,
CASE WHEN sure AND k % 10 < 8 THEN CASE WHEN k % 4 <> 1 THEN 'p' || k::VARCHAR WHEN k % 8 = 1 THEN 'p0' END END AS canonical_page_id FROM x""")
def reconcile_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    events, judged = _judged(spark, sf)
    c = _captured(spark, sf)
    kind = F.when(F.col("k") % 4 == 0, "admitted").when(F.col("k") % 4 == 1, "exact-alias").when(F.col("k") % 4 == 2, "superseded-capture").otherwise("odd")
    own = F.concat(F.lit("k"), F.col("k").cast("string"))
    other = c.where("k % 10 = 8").withColumn("requested_url", F.concat(F.lit("v"), F.col("k").cast("string")))
    both = c.unionByName(other)
    operations = both.where("k % 10 <> 9").select("crawl_run_id", "snapshot_id", F.col("k").alias("task_id"), "source_id", "requested_url", "body_sha256")
    manifest = both.select("crawl_run_id", "snapshot_id", "source_id", "requested_url", "page_id", own.alias("capture_id"), own.alias("selected_capture_id"), kind.alias("admission_status"), F.when(F.col("k") % 4 == 1, "p0").alias("alias_of"), "body_sha256", "content_sha256")
    pages = c.where("k % 4 <> 1").select("snapshot_id", "source_id", "page_id").unionByName(c.select("snapshot_id", "source_id").distinct().withColumn("page_id", F.lit("p0")))
    aliases = c.where("k % 8 = 1").select("snapshot_id", "source_id", F.col("page_id").alias("alias_page_id"), F.lit("p0").alias("representative_page_id"))
    return reconcile.capture_outcomes(events, judged, manifest, operations, pages, aliases).select("event_id", "reconciliation_status", "canonical_page_id")


@query(f"""WITH {JUDGED} SELECT o_orderkey::VARCHAR AS record_id, o_orderkey AS task_id, 'u' || o_orderkey::VARCHAR AS requested_url, 'too_short' AS rejection_reason, CASE WHEN status = 'authoritative' THEN 'authoritative_rejected_task' ELSE 'provisional_rejected_task' END AS reconciliation_status FROM orders JOIN ju ON r = o_orderkey % 20 WHERE o_orderkey % 10 = 9 AND r NOT IN (17, 18)""")
def reconcile_rejections(spark: SparkSession, sf: str) -> DataFrame:
    _, judged = _judged(spark, sf)
    c = _captured(spark, sf)
    data = F.struct(F.col("k").alias("task_id"), "source_id", F.col("requested_url").alias("url"), F.lit("too_short").alias("rejection_reason"))
    log = c.select("crawl_run_id", "snapshot_id", F.col("k").cast("string").alias("record_id"), F.to_json(F.struct(F.when(F.col("k") % 10 == 9, "page.rejected").otherwise("page.seen").alias("event"), data.alias("data"))).alias("record_json"))
    return reconcile.rejected_tasks(log, judged).select("record_id", "task_id", "requested_url", "rejection_reason", "reconciliation_status")


@query(f"""WITH {JUDGED} SELECT 'p' || o_orderkey::VARCHAR AS page_id, 'run-' || r::VARCHAR AS crawl_run_id FROM orders JOIN ju ON r = o_orderkey % 20 WHERE status = 'authoritative'""")
def reconcile_pages(spark: SparkSession, sf: str) -> DataFrame:
    return reconcile.authoritative(_captured(spark, sf).select("snapshot_id", "page_id"), _judged(spark, sf)[1]).select("page_id", "crawl_run_id")


# ------------------------------------------------------------ rules on the lake
@query("""
WITH pg AS (SELECT c_nationkey % 5 AS s, c_custkey // 2 AS p FROM customer), sp AS (SELECT r_regionkey AS s, (SELECT count(*) FROM pg WHERE pg.s = r_regionkey) AS n FROM region),
up AS (SELECT 'r' || s::VARCHAR || '/' || p::VARCHAR AS x FROM pg GROUP BY s, p HAVING count(*) > 1)
SELECT 'unique.page_per_snapshot' AS rule, (SELECT count(*) FROM up) AS failing, coalesce((SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT x FROM up ORDER BY x LIMIT 5)), '') AS examples
UNION ALL SELECT 'unique.passage_per_snapshot', 0, '' UNION ALL SELECT 'unique.event', 1, 'run-3/e3' UNION ALL SELECT 'counts.silver_match_snapshot', 1, 'r2' UNION ALL SELECT 'counts.events_match_snapshot', 1, 'r2' UNION ALL SELECT 'lineage.every_snapshot_traced', 1, 'r4' UNION ALL SELECT 'freshness.sla_24h', 2, 'r0,r1'""")
def dq_lake(spark: SparkSession, sf: str) -> DataFrame:
    """The rules on what is stored, over tables with one fault of each kind."""
    snap = lambda c: F.concat(F.lit("r"), c.cast("string")).alias("snapshot_id")
    pages = d.table(spark, sf, "customer").select(snap(F.col("c_nationkey") % 5), F.floor(F.col("c_custkey") / 2).alias("page_id"))
    passages = d.table(spark, sf, "supplier").select(snap(F.col("s_suppkey") % 5), F.col("s_suppkey").alias("passage_id"))
    aliases = d.table(spark, sf, "nation").select(snap(F.col("n_regionkey")), F.col("n_nationkey").alias("alias_page_id"))
    s = d.table(spark, sf, "region").select(snap(F.col("r_regionkey")), "r_regionkey")
    for df, c in ((pages, "page_count"), (aliases, "alias_count"), (passages, "passage_count")):
        s = s.join(df.groupBy("snapshot_id").agg(F.count("*").alias(c)), "snapshot_id", "left").na.fill(0, [c])
    said = F.to_json(F.struct(F.struct("snapshot_id", "page_count", "alias_count", "passage_count").alias("data")))
    key = F.col("r_regionkey").cast("string")
    events = s.select(F.concat(F.lit("run-"), key).alias("crawl_run_id"), F.concat(F.lit("e"), key).alias("event_id"), F.lit("corpus_snapshot_published").alias("event_type"), said.alias("record_json"), "r_regionkey")
    snapshots = s.withColumn("page_count", F.col("page_count") + F.when(F.col("r_regionkey") == 2, 1).otherwise(0)).withColumn("created_at_utc", F.concat(F.lit("2024-01-0"), (F.col("r_regionkey") + 1).cast("string"), F.lit("T00:00:00Z")))
    tables = {"silver_pages": pages, "silver_passages": passages, "silver_page_aliases": aliases, "silver_snapshots": snapshots, "silver_crawl_events": events.unionByName(events.where("r_regionkey = 3")), "lineage_loads": s.where("r_regionkey <> 4")}
    return checked(spark, *quality.check_lake(tables.__getitem__, "2024-01-03T12:00:00Z"))


@query(f"""WITH {EVI}, t AS (SELECT DISTINCT e.snapshot_id || '/' || e.page_id AS x, count(*) AS n FROM evi e JOIN obs o ON o.snapshot_id = e.snapshot_id AND o.source_id = e.source_id AND o.page_id::VARCHAR = e.page_id WHERE e.kind = 'tombstone' GROUP BY e.snapshot_id, e.source_id, e.page_id),
c AS (SELECT e.snapshot_id || '/' || e.source_id AS x FROM evi e LEFT JOIN src s ON s.snapshot_id = e.snapshot_id AND s.source_id = e.source_id WHERE e.kind = 'coverage' AND e.complete AND (s.stop_reason IS NULL OR s.stop_reason <> 'frontier_exhausted' OR s.failed_count <> 0 OR s.rejected_count <> 0 OR e.expected_page_count <> s.page_count))
SELECT 'evidence.tombstone_absent' AS rule, (SELECT count(*) FROM t) AS failing, coalesce((SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT x FROM t ORDER BY x LIMIT 5)), '') AS examples UNION ALL SELECT 'evidence.complete_assertion', (SELECT count(*) FROM c), coalesce((SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT x FROM c ORDER BY x LIMIT 5)), '')
UNION ALL SELECT 'lineage.near_duplicates', (SELECT count(*) FROM (SELECT DISTINCT snapshot_id, origin FROM obs WHERE origin = 'origin-3')), coalesce((SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT snapshot_id || '/origin-3' AS x FROM obs WHERE origin = 'origin-3' ORDER BY x LIMIT 5)), '')""")
def dq_evidence(spark: SparkSession, sf: str) -> DataFrame:
    pages = d.observations(spark, sf).withColumn("page_id", F.col("page_id").cast("string"))
    report = pages.groupBy("snapshot_id", "origin").agg((F.count("*") + F.max(F.when(F.col("origin") == "origin-3", 1).otherwise(0))).alias("page_count"))
    return checked(spark, *quality.check_evidence(d.evidence(spark, sf), pages, d.sources(spark, sf)), quality.check_near_duplicates(report, pages))


@query("""WITH f AS (SELECT n_nationkey::VARCHAR || '/' || CASE WHEN n_nationkey % 5 = 1 THEN 'missing b' WHEN n_nationkey % 5 = 2 THEN 'extra z' ELSE 'no object' END AS x FROM nation WHERE n_nationkey % 5 IN (1, 2, 3))
SELECT 'schema.drift' AS rule, (SELECT count(*) FROM f) AS failing, (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT x FROM f ORDER BY x LIMIT 5)) AS examples
UNION ALL SELECT 'immutable.snapshot', count(*) FILTER (n_nationkey % 6 = 5), (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT n_nationkey::VARCHAR AS x FROM nation WHERE n_nationkey % 6 = 5 ORDER BY x LIMIT 5)) FROM nation""")
def dq_drift(spark: SparkSession, sf: str) -> DataFrame:
    n = d.table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    k = F.col("k") % 5
    doc = F.when(k == 1, '{"a":1}').when(k == 2, '{"a":1,"b":2,"z":3}').when(k == 3, "[1]").when(k == 4, '{"a":1,"b":2,"c":null}').otherwise('{"b":2,"a":1}')
    later = n.withColumn("name", F.when(F.col("k") % 6 == 5, "other").otherwise(F.col("name")))
    return checked(spark, quality.drift(n.withColumn("record_json", doc), "record_json", ["a", "b"], ["k"], ["c"]), quality.immutable(later, n, ["k"], ["name"]))


@query("""SELECT * FROM (VALUES ('generation.unique_passage', 0), ('generation.unique_ordinal', 0), ('generation.dense_keys', 0)) v(rule, failing) UNION ALL SELECT 'generation.derived_ids', (SELECT count(*) FROM documents WHERE doc_id % 40 = 7)
UNION ALL SELECT 'generation.postings', 1 UNION ALL SELECT 'generation.vectors', (SELECT count(*) FROM documents WHERE doc_id % 50 = 9)""")
def dq_generation(spark: SparkSession, sf: str) -> DataFrame:
    """A search generation with some wrong ids, a posting of no passage, and passages without vectors."""
    from corpuslake.functions.urls import sha256_id

    c = d.table(spark, sf, "documents").select(F.floor(F.col("doc_id") / 10).cast("long").alias("page_id"), (F.col("doc_id") % 10).cast("int").alias("ordinal"), F.col("text").alias("content"), "doc_id")
    c = c.withColumn("passage_id", F.concat(sha256_id("passage", F.col("page_id").cast("string"), F.col("ordinal").cast("string"), "content"), F.when(F.col("doc_id") % 40 == 7, "x").otherwise("")))
    catalog = keep(search.build_catalog(c, spark.createDataFrame([], "representative_page_id bigint, alias_page_id string")), "catalog")
    postings = catalog.select("passage_id").unionByName(spark.createDataFrame([("none",)], "passage_id string"))
    return checked(spark, *quality.check_generation(catalog, postings, catalog.where("doc_id % 50 <> 9"))).drop("examples")


@query("""WITH c AS (SELECT c_custkey AS k, sha256('p' || c_custkey::VARCHAR) AS id FROM customer), s AS (SELECT s_suppkey AS k, sha256('q' || s_suppkey::VARCHAR) AS id FROM supplier), g AS (SELECT count(DISTINCT c_mktsegment) AS n FROM customer)
SELECT 'batch.identity' AS rule, (SELECT count(*) FROM c WHERE k % 40 = 1) AS failing UNION ALL SELECT 'batch.source', (SELECT count(*) FROM c WHERE k % 40 = 2) UNION ALL SELECT 'batch.content_hash', (SELECT count(*) FROM c WHERE k % 40 = 3) + (SELECT count(*) FROM s WHERE k % 5 = 3)
UNION ALL SELECT 'batch.id_form', (SELECT count(*) FROM nation WHERE n_nationkey % 7 = 4) UNION ALL SELECT 'batch.operational', (SELECT count(*) FROM region WHERE r_regionkey IN (1, 2)) UNION ALL SELECT 'batch.unique', 1 UNION ALL SELECT 'batch.known_source', (SELECT count(*) FROM c WHERE k % 40 = 5)
UNION ALL SELECT 'batch.known_page', (SELECT count(*) FROM nation WHERE n_nationkey % 7 = 6) UNION ALL SELECT 'batch.same_source', (SELECT count(*) FROM s JOIN customer ON c_custkey = 1 + k % 4 WHERE c_mktsegment <> 'BUILDING') + (SELECT count(*) FROM nation JOIN customer ON c_custkey = 1 WHERE n_nationkey % 7 <> 6 AND c_mktsegment <> 'BUILDING')
UNION ALL SELECT 'batch.snapshot_record', 0 UNION ALL SELECT 'batch.crawl_manifest', 1 UNION ALL SELECT 'batch.crawl_sources', 1""")
def dq_envelopes(spark: SparkSession, sf: str) -> DataFrame:
    """A batch with faults of each kind: ids, sources, hashes, forms, references, and a crawl manifest of another run that lists a source too many."""
    sha = lambda p, c: F.sha2(F.concat(F.lit(p), c.cast("string")), 256)
    c, s, n, r = (d.table(spark, sf, t) for t in ("customer", "supplier", "nation", "region"))
    row = lambda df, t, i, src, doc: df.select(F.lit(t).alias("record_type"), i.alias("record_id"), src.alias("source_id"), F.to_json(doc).alias("record_json"))
    k, seg = F.col("c_custkey"), F.col("c_mktsegment")
    pid = sha("p", k)
    text = F.concat(F.lit("t"), k.cast("string"))
    own = F.when(k % 40 == 5, "nobody").otherwise(seg)
    rows = row(c, "page", pid, own, F.struct(F.when(k % 40 == 1, "other").otherwise(pid).alias("page_id"), F.when(k % 40 == 2, "other").otherwise(own).alias("source_id"), text.alias("content_identity"), F.when(k % 40 == 3, "0").otherwise(F.sha2(text, 256)).alias("content_sha256")))
    q = F.col("s_suppkey")
    qid, building = sha("q", q), F.lit("BUILDING")
    body = F.concat(F.lit("b"), q.cast("string"))
    rows = rows.unionByName(row(s, "passage", qid, building, F.struct(qid.alias("passage_id"), sha("p", 1 + q % 4).alias("page_id"), building.alias("source_id"), body.alias("content"), F.when(q % 5 == 3, "0").otherwise(F.sha2(body, 256)).alias("content_sha256"))))
    a = F.col("n_nationkey")
    aid = F.when(a % 7 == 4, F.concat(F.lit("alias"), a.cast("string"))).otherwise(sha("a", a))
    rows = rows.unionByName(row(n, "page_alias", aid, building, F.struct(aid.alias("alias_page_id"), building.alias("source_id"), F.when(a % 7 == 6, "none").otherwise(sha("p", F.lit(1))).alias("representative_page_id"))))
    e = F.col("r_regionkey")
    rows = rows.unionByName(row(r, "operational", e.cast("string"), F.lit(None).cast("string"), F.struct(F.when(e == 1, "v0").otherwise("v1").alias("schema_version"), F.when(e == 2, "run-2").otherwise("run-1").alias("run_id"))))
    sources = c.select(seg).distinct()
    rows = rows.unionByName(row(sources, "source", seg, seg, F.struct(seg.alias("source_id"))))
    counts = {"page_count": c.count(), "alias_count": n.count(), "passage_count": s.count()}
    numbers = [F.lit(v).alias(x) for x, v in counts.items()]
    listed = sources.agg(F.array_append(F.collect_list(F.struct(seg.alias("source_id"))), F.struct(F.lit("extra").alias("source_id"))).alias("sources"))
    said = [F.lit("complete").alias("status"), F.lit("s1").alias("snapshot_id")]
    rows = rows.unionByName(row(spark.range(1), "snapshot", F.lit("s1"), F.lit(None).cast("string"), F.struct(*said, *numbers)))
    rows = rows.unionByName(row(listed, "crawl_manifest", F.lit("m1"), F.lit(None).cast("string"), F.struct(*said, F.lit("sha").alias("manifest_sha256"), F.lit("run-9").alias("run_id"), "sources", F.struct(*numbers).alias("summary"))))
    rows = keep(rows.unionByName(rows.where("record_type = 'operational' AND record_id = '0'")), "envelopes")
    manifest = {"run_id": "run-1", "snapshot_id": "s1", "crawl_manifest_sha256": "sha", "operational_schema": "v1"} | counts
    return checked(spark, *quality.check_envelopes(rows, manifest)).drop("examples")


# ------------------------------------------------------------ recrawl policy
def _recommendations(spark: SparkSession, sf: str) -> DataFrame:
    """Recommendations for customers: some with a basis that isn't theirs, of another policy version, of each validation status."""
    k = F.col("c_custkey")
    c = d.table(spark, sf, "customer").select(k.alias("k"), F.concat(F.lit("s"), k.cast("string")).alias("source_id"), F.lit("g1").alias("generation_id"), F.when(k % 7 == 0, "p0").otherwise("p1").alias("expected_policy_version"), ((k % 20) + 1.5).cast("double").alias("proposed_interval_hours"), F.lit(24.0).alias("current_interval_hours"))
    told = F.when(F.col("k") % 11 == 3, "s0").otherwise(F.col("source_id"))
    basis = F.to_json(F.struct("generation_id", told.alias("source_id"), F.col("proposed_interval_hours").cast("decimal(18,3)").cast("string").alias("proposed_interval_hours"), "expected_policy_version"))
    c = c.withColumn("idempotency_basis", basis).withColumn("recommendation_id", F.concat(F.lit("sha256:"), F.when(F.col("k") % 13 == 5, "0").otherwise(F.sha2("idempotency_basis", 256))))
    k = F.col("k") % 6
    return c.withColumns({
        "validation_status": F.when(k == 0, "stale").when(k == 1, "provisional_review_required").otherwise("valid"), "adjustment_type": F.when(k == 2, "decrease").otherwise("increase"), "adjustment_fraction": F.when(F.col("k") % 4 == 0, -0.5).otherwise(0.1), "confidence": F.when(k == 3, "low").otherwise("high"),
    })


def _policy(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    return d.table(spark, sf, "customer").where("c_custkey % 17 <> 1").select(F.concat(F.lit("s"), k.cast("string")).alias("source_id"), F.lit("p1").alias("policy_version"), F.when(k % 9 == 0, 48.0).otherwise(24.0).alias("interval_hours"), (k % 10 != 0).alias("enabled"))


@query("""SELECT c_custkey AS k, c_custkey % 11 <> 3 AND c_custkey % 13 <> 5 AS basis_intact, CASE WHEN c_custkey % 17 = 1 THEN NULL ELSE c_custkey % 7 <> 0 AND c_custkey % 9 <> 0 END AS policy_current FROM customer""")
def recrawl_binding(spark: SparkSession, sf: str) -> DataFrame:
    return recrawl.bound(_recommendations(spark, sf), _policy(spark, sf)).select("k", "basis_intact", "policy_current")


_IMPORT = """CASE WHEN c_custkey % 15 = 4 THEN 'existing' WHEN c_custkey % 6 = 0 THEN 'rejected' WHEN c_custkey % 17 = 1 OR c_custkey % 10 = 0 THEN 'disabled' WHEN c_custkey % 6 = 1 OR c_custkey % 7 = 0 OR (c_custkey % 6 = 2 AND c_custkey % 4 = 0) OR c_custkey % 6 = 3 THEN 'pending_review' ELSE 'scheduled' END"""


@query(f"SELECT c_custkey AS k, {_IMPORT} AS import_outcome FROM customer")
def recrawl_imports(spark: SparkSession, sf: str) -> DataFrame:
    r = _recommendations(spark, sf).withColumn("recommendation_id", F.concat("recommendation_id", F.lit("/"), F.col("k").cast("string")))
    return recrawl.import_outcomes(r, r.where("k % 15 = 4"), _policy(spark, sf)).select("k", "import_outcome")


@query("""SELECT c_custkey AS k, CASE WHEN c_custkey % 17 = 1 OR c_custkey % 7 = 0 OR c_custkey % 9 = 0 THEN 'stale' WHEN c_custkey % 3 = 0 THEN 'rejected' ELSE 'scheduled' END AS decision_outcome FROM customer""")
def recrawl_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Two decisions on each recommendation: the first counts."""
    r = _recommendations(spark, sf).withColumn("recommendation_id", F.col("k").cast("string"))
    first = F.when(F.col("k") % 3 == 0, "reject").otherwise("approve")
    d1 = r.select("recommendation_id", F.lit(1).alias("decided_at"), F.lit("a").alias("decision_id"), first.alias("decision"))
    d2 = r.select("recommendation_id", F.lit(2).alias("decided_at"), F.lit("b").alias("decision_id"), F.lit("approve").alias("decision"))
    return recrawl.decide(r, d1.unionByName(d2), _policy(spark, sf)).select("k", "decision_outcome")


@query("""SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN 1704067200 WHEN c_custkey % 2 = 0 THEN 86400 * c_custkey END AS scheduled FROM customer""")
def recrawl_advances(spark: SparkSession, sf: str) -> DataFrame:
    c = d.table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_custkey").alias("source_id"), F.when(F.col("c_custkey") % 2 == 0, F.timestamp_seconds(F.col("c_custkey") * 86_400)).alias("last_scheduled_at"))
    return recrawl.advance(c, c.where("k % 5 = 0"), "2024-01-01T00:00:00Z").select("k", F.unix_timestamp("last_scheduled_at").alias("scheduled"))


@query("""SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN 'stale' WHEN c_custkey % 3 = 0 THEN 'out_of_scope' WHEN c_custkey % 2 = 0 THEN 'unsupported' ELSE 'valid' END AS status,
CASE WHEN c_custkey % 12 = 0 THEN 'even,old,third' WHEN c_custkey % 4 = 0 THEN 'even,old' WHEN c_custkey % 6 = 0 THEN 'even,third' WHEN c_custkey % 3 = 0 THEN 'third' WHEN c_custkey % 2 = 0 THEN 'even' ELSE '' END AS reasons FROM customer""")
def recrawl_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k")
    rules = [(k % 2 == 0, "unsupported", "even"), (k % 3 == 0, "out_of_scope", "third"), (k % 4 == 0, "stale", "old"), (F.lit(None).cast("boolean"), "invalid", "never")]
    out = recrawl.accumulate(d.table(spark, sf, "customer").select(F.col("c_custkey").alias("k")), rules)
    return out.select("k", "verdict.status", F.array_join("verdict.reasons", ",").alias("reasons"))


@query("""SELECT c_custkey AS source_id, CASE c_custkey % 5 WHEN 0 THEN 'invalid' WHEN 1 THEN 'provisional_review_required' WHEN 4 THEN 'stale' ELSE 'out_of_scope' END AS validation_status, CASE WHEN c_custkey % 5 IN (1, 4) THEN 'provisional' ELSE 'unsupported' END AS evidence_status,
CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE 71 END AS id_length FROM customer""")
def recrawl_provisional(spark: SparkSession, sf: str) -> DataFrame:
    """Recommendations from running crawls: invalid input, accepted captures, another source's event, another run's event, and one that has expired."""
    k = F.col("source_id") % 5
    c = d.table(spark, sf, "customer").select(F.col("c_custkey").alias("source_id"))
    run, ids = F.concat(F.lit("run-"), F.col("source_id").cast("string")), F.concat(F.lit("e"), F.col("source_id").cast("string"))
    inputs = c.select(
        F.lit("g1").alias("generation_id"), F.col("source_id").cast("string").alias("source_id"), F.lit("2024-01-01T12:00:00Z").alias("generated_at"), F.when(k == 4, "2024-01-01T13:00:00Z").otherwise("2030-01-01T00:00:00Z").alias("expires_at"), F.lit("p1").alias("expected_policy_version"), F.when(k == 0, -1.0).otherwise(6.0).alias("minimum_interval_hours"),
        F.lit(24.0).alias("current_interval_hours"), F.lit(168.0).alias("maximum_interval_hours"), F.lit(0.25).alias("max_adjustment_fraction"), F.lit(3).alias("minimum_completed_snapshots"), F.lit(5).alias("minimum_comparable_page_observations"), F.lit(30).alias("maximum_evidence_age_days"), F.lit(3600).alias("maximum_provisional_event_age_seconds"),
        F.array().cast("array<string>").alias("snapshot_ids"), run.alias("provisional_run_id"), F.array(ids).alias("provisional_event_ids"),
    )
    events = c.select(F.when(k == 3, "run-other").otherwise(run).alias("crawl_run_id"), ids.alias("event_id"), F.when(k == 2, "someone").otherwise(F.col("source_id").cast("string")).alias("source_id"), F.lit("capture_committed").alias("event_type"), F.lit("2024-01-01T11:45:00Z").alias("event_at"))
    sources = spark.createDataFrame([], "snapshot_id string, source_id string, scope string, contract string, observed_at string, stop_reason string, failed_count bigint, rejected_count bigint")
    changes = spark.createDataFrame([], "source_id string, snapshot_id string, page_id string, change_status string, previous_snapshot_id string")
    v = recrawl.validation(recrawl.candidates(inputs, sources, changes, events), "2024-01-02T00:00:00Z")
    return v.select(F.col("source_id").cast("long").alias("source_id"), "validation_status", "evidence_status", F.coalesce(F.length("recommendation_id"), F.lit(0)).alias("id_length"))


@query("""
WITH o AS (SELECT o_orderkey AS k, o_custkey % 12 AS r, CASE WHEN o_orderstatus = 'F' THEN 'succeeded' WHEN o_orderstatus = 'P' THEN 'failed' WHEN o_orderkey % 3 = 0 THEN 'leased' ELSE 'pending' END AS st FROM orders),
t AS (SELECT r, string_agg(st || '=' || n::VARCHAR, ',' ORDER BY st) AS tasks FROM (SELECT r, st, count(*) AS n FROM o GROUP BY 1, 2) GROUP BY 1),
e AS (SELECT user_id % 12 AS r, event_type, event_id % 500 AS age FROM events), u AS (SELECT r, string_agg(event_type || '=' || n::VARCHAR, ',' ORDER BY event_type) AS outcomes FROM (SELECT r, event_type, count(*) AS n FROM e GROUP BY 1, 2) GROUP BY 1),
p AS (SELECT r, string_agg(s || '=' || n::VARCHAR, ',' ORDER BY s) AS permits FROM (SELECT o_custkey % 12 AS r, CASE WHEN o_orderkey % 5 = 0 THEN 'active' ELSE 'completed' END AS s, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1),
v AS (SELECT r, round(count(*) FILTER (age < 60) / greatest(1, least(60, max(age))), 6) AS rate_60, round(count(*) FILTER (age < 300) / greatest(1, least(300, max(age))), 6) AS rate_300 FROM e GROUP BY 1),
l AS (SELECT r, string_agg(k::VARCHAR || '@w' || (k % 4)::VARCHAR, ',' ORDER BY k % 700, k) AS oldest FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY k % 700, k) AS n FROM o WHERE st = 'leased') WHERE n <= 20 GROUP BY 1)
SELECT 'run-' || t.r::VARCHAR AS crawl_run_id, tasks, outcomes, permits, rate_60, rate_300, (SELECT count(*) FROM o WHERE o.r = t.r AND st = 'leased') AS leased, oldest FROM t LEFT JOIN u ON u.r = t.r LEFT JOIN p ON p.r = t.r LEFT JOIN v ON v.r = t.r LEFT JOIN l ON l.r = t.r""")
def run_dashboard(spark: SparkSession, sf: str) -> DataFrame:
    o = d.table(spark, sf, "orders").withColumn("crawl_run_id", F.concat(F.lit("run-"), (F.col("o_custkey") % 12).cast("string")))
    k = F.col("o_orderkey")
    tasks = o.select("crawl_run_id", k.alias("task_id"), F.when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("o_orderstatus") == "P", "failed").when(k % 3 == 0, "leased").otherwise("pending").alias("status"), F.concat(F.lit("w"), (k % 4).cast("string")).alias("lease_owner"), (k % 700).alias("lease_deadline"))
    e = d.table(spark, sf, "events").select(F.concat(F.lit("run-"), (F.col("user_id") % 12).cast("string")).alias("crawl_run_id"), F.col("event_type").alias("outcome"), (F.lit("2024-06-01T00:00:00Z").cast("timestamp") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("event_id") % 500).cast("decimal(18,6)"))).alias("finished_at"))
    out = operations.run_dashboard(tasks, e, o.select("crawl_run_id", F.when(k % 5 == 0, "active").otherwise("completed").alias("status")), "2024-06-01T00:00:00Z")
    flat = lambda c: F.array_join(F.transform(F.map_entries(c), lambda x: F.concat_ws("=", x["key"], x["value"].cast("string"))), ",").alias(c)
    return out.select("crawl_run_id", flat("tasks"), flat("outcomes"), flat("permits"), *[F.round(F.col("rates")[w], 6).alias(f"rate_{w}") for w in (60, 300)], "leased", F.array_join(F.transform("oldest_leases", lambda x: F.concat_ws("@", x["task_id"].cast("string"), x["lease_owner"])), ",").alias("oldest"))


@query(_RECRAWL + """, b AS (SELECT source_id, '{"generation_id":"g1","source_id":"' || source_id || '","generated_at":"' || newest[1:10] || 'T12:00:00Z","expires_at":"2030-01-01T00:00:00Z","expected_policy_version":"p1","minimum_interval_hours":"6.000","current_interval_hours":"24.000","maximum_interval_hours":"168.000","proposed_interval_hours":"' ||
proposed::DECIMAL(18, 3)::VARCHAR || '","adjustment_hours":"' || (proposed - 24)::DECIMAL(18, 3)::VARCHAR || '","adjustment_fraction":"' || ((proposed - 24) / 24)::DECIMAL(18, 6)::VARCHAR || '","max_adjustment_fraction":"0.250000","minimum_completed_snapshots":3,"minimum_comparable_page_observations":' || CASE WHEN source_id < 'D' THEN 1 ELSE 10000000 END::VARCHAR ||
',"maximum_evidence_age_days":30,"maximum_provisional_event_age_seconds":3600,"evidence_status":"' || CASE WHEN ok THEN 'completed_history' ELSE 'unsupported' END || '","snapshot_ids":["' || array_to_string(list_sort((SELECT ids FROM e WHERE e.source_id = p.source_id)), '","') || '"],"provisional_run_id":null,"provisional_event_ids":[],"comparable":' || comparable::VARCHAR || ',"changed":' || changed::VARCHAR ||
',"change_fraction":"' || coalesce(cf::DECIMAL(18, 6)::VARCHAR, '') || '"}' AS j FROM p) SELECT source_id, j AS idempotency_basis, 'sha256:' || sha256(j) AS recommendation_id FROM b""")
def recrawl_basis(spark: SparkSession, sf: str) -> DataFrame:
    """The canonical JSON of each recommendation and the id that derives from it."""
    from corpuslake.plans.catalogue import _candidates

    return _candidates(spark, sf).select("source_id", "idempotency_basis", "recommendation_id")


# ------------------------------------------------------------ evaluation
EVAL3 = EVAL.replace("'length' AS mode", "'keyword' AS mode").replace("SELECT 'modulo',", "SELECT 'semantic',").replace("ORDER BY page_id % 31, page_id) FROM ed)", "ORDER BY page_id % 31, page_id) FROM ed UNION ALL SELECT 'hybrid', query_id, page_id, grade, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, page_id) FROM ed)")


def _package(spark: SparkSession, sf: str) -> dict:
    """An evaluation package written to the shared folder and read again: documents as pages, their quality and toxicity as grades, twelve queries."""
    docs = d.table(spark, sf, "documents").join(d.table(spark, sf, "labels"), "doc_id").select((F.col("doc_id") % 12).cast("string").alias("query_id"), F.col("doc_id"), "n_chars", (F.col("quality") * 2 + F.col("toxic")).cast("int").alias("grade"))
    folder = scratch_path(spark, "package")
    page, n = F.col("doc_id").cast("string"), F.col("query_id").cast("int")
    docs.select("query_id", page.alias("page_id"), F.lit(0).alias("grade"), F.lit("a").alias("judge_id"), F.col("grade").alias("adjudicated_grade"), F.create_map(F.lit("b"), F.lit(1), F.lit("a"), F.lit(2)).alias("judge_grades")).write.json(f"{folder}/judgments.jsonl")
    docs.select("query_id").distinct().select("query_id", F.lit("words").alias("query"), F.concat(F.lit("s"), (n % 2).cast("string")).alias("source"), F.concat(F.lit("i"), (n % 3).cast("string")).alias("intent"), F.when(n < 4, "development").otherwise("held-out").alias("split")).write.json(f"{folder}/queries.jsonl")
    listed = lambda *o: F.transform(F.array_sort(F.collect_list(F.struct(*o, page.alias("p")))), lambda x: x["p"])
    docs.groupBy("query_id").agg(listed((-F.col("n_chars")).alias("a"), F.col("doc_id").alias("b")).alias("keyword"), listed((F.col("doc_id") % 31).alias("a"), F.col("doc_id").alias("b")).alias("semantic"), listed((-F.col("grade")).alias("a"), F.col("doc_id").alias("b")).alias("hybrid")).write.json(f"{folder}/rankings.jsonl")
    Files(spark, folder).write(f"{folder}/metadata.json", b'{"judges": ["a", "b"]}')
    return batches.evaluation_package(spark, folder)


def _package_metrics(spark: SparkSession, sf: str) -> tuple[dict, DataFrame]:
    p = _package(spark, sf)
    judged = evaluation.normalise_judgments(p["judgments"], p["queries"], p["metadata"]["judges"])
    return p, keep(evaluation.ranking_metrics(p["rankings"], judged, strict=False), "metrics")


@query(f"WITH {EVAL3} SELECT mode, query_id, round(ndcg10, 6) AS ndcg10, round(mrr10, 6) AS mrr10, round(recall10, 6) AS recall10, round(recall100, 6) AS recall100 FROM mt")
def package_metrics(spark: SparkSession, sf: str) -> DataFrame:
    m = _package_metrics(spark, sf)[1]
    return m.select("mode", "query_id", *[F.round(c, 6).alias(c) for c in evaluation.METRICS])


def bootstrap_sql(deltas: str, seed: int) -> str:
    """The resampled means of ``deltas`` (a query of d in order n from 0): states of the generator by recursion, one row per resampling."""
    a, c, m = "6364136223846793005::UHUGEINT", "1442695040888963407::UHUGEINT", "18446744073709551616::UHUGEINT"
    return f"""dl AS ({deltas}), xs AS (SELECT list(d ORDER BY n) AS x, count(*)::BIGINT AS k, avg(d) AS mean FROM dl),
jp AS (SELECT list_transform(range(1, k + 1), lambda i: list_reduce(range(0, i), lambda s, j: [s[1] * {a} % {m}, (s[2] * {a} + {c}) % {m}], [1::UHUGEINT, 0::UHUGEINT])) AS ac, x, k, mean FROM xs),
st(i, s) AS (SELECT 0, {seed}::UHUGEINT UNION ALL SELECT i + 1, (s * ac[k][1] % {m} + ac[k][2]) % {m} FROM st, jp WHERE i < 9999),
vs AS (SELECT list_sum(list_transform(ac, lambda p: x[((s * p[1] % {m} + p[2]) % {m} % k::UHUGEINT)::BIGINT + 1])) / k AS v FROM st, jp), ms AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS r FROM vs)
SELECT round(any_value(mean), 6) AS mean, round(max(v) FILTER (r = 249), 6) AS low, round(max(v) FILTER (r = 9749), 6) AS high FROM ms, jp"""


_DELTAS = "SELECT row_number() OVER (ORDER BY a.query_id::INT) - 1 AS n, a.ndcg10 - b.ndcg10 AS d FROM mt a JOIN mt b ON a.query_id = b.query_id AND a.mode = '{}' AND b.mode = '{}'"


@query("WITH RECURSIVE " + EVAL + ", " + bootstrap_sql(_DELTAS.format("length", "modulo"), 0x53434F55545F4556))
def bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    from corpuslake.plans.catalogue import _evaluation

    m = evaluation.ranking_metrics(*_evaluation(spark, sf), strict=False).groupBy("query_id").pivot("mode", ["length", "modulo"]).agg(F.first("ndcg10")).orderBy(F.col("query_id").cast("int"))
    mean, low, high = paired_bootstrap([r["length"] - r["modulo"] for r in m.collect()])  # a row per evaluation query
    return spark.createDataFrame([(round(mean, 6), round(low, 6), round(high, 6))], "mean double, low double, high double")


@query(f"WITH {EVAL3}, a AS (SELECT mode, avg(ndcg10) AS n, avg(mrr10) AS m, avg(recall100) AS r FROM mt GROUP BY 1) SELECT o.mode AS against, round(h.n - o.n, 6) AS gain, h.n - o.n >= 0.03 AND o.m - h.m <= 0.02 AND o.r - h.r <= 0.02 AS passed FROM a h JOIN a o ON h.mode = 'hybrid' AND o.mode <> 'hybrid'")
def held_out_gate(spark: SparkSession, sf: str) -> DataFrame:
    """The ideal ranking as hybrid: both gates hold, with intervals above zero."""
    gate = evaluation.held_out_gate(_package_metrics(spark, sf)[1])
    return spark.createDataFrame([(o, round(g["gain"], 6), bool(g["passed"])) for o, g in gate.items()], "against string, gain double, passed boolean")


@query(f"""WITH {EVAL3}, q AS (SELECT DISTINCT query_id::INT AS n FROM ed), c AS (SELECT 's' || (n % 2)::VARCHAR || '/i' || (n % 3)::VARCHAR || ': ' || count(*)::VARCHAR AS problem FROM q GROUP BY n % 2, n % 3 HAVING count(*) <> 4)
SELECT problem FROM c UNION ALL SELECT s || ': ' || n::VARCHAR FROM (SELECT 'development' AS s, count(*) FILTER (n < 4) AS n, 16 AS w FROM q UNION ALL SELECT 'held-out', count(*) FILTER (n >= 4), 48 FROM q) WHERE n <> w""")
def package_problems(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(x,) for x in evaluation.package_shape(_package(spark, sf)["queries"])], "problem string")


@query(f"""WITH {EVAL3}, a AS (SELECT mode, avg(ndcg10) AS x, avg(mrr10) AS y, count(*) AS n FROM mt GROUP BY 1), l AS (SELECT mode, unnest(['ndcg10', 'mrr10']) AS metric, unnest([x, y]) AS v, n FROM a)
SELECT mode, metric, CASE WHEN mode = 'hybrid' AND metric = 'mrr10' THEN 'missing' WHEN mode = 'keyword' AND metric = 'mrr10' THEN 'query_count_changed' WHEN mode = 'semantic' AND metric = 'ndcg10' THEN 'regressed' WHEN mode = 'semantic' THEN 'ok' WHEN mode = 'keyword' THEN 'ok' ELSE 'new' END AS status FROM l""")
def metric_regressions(spark: SparkSession, sf: str) -> DataFrame:
    m = _package_metrics(spark, sf)[1].groupBy("mode").agg(F.avg("ndcg10").alias("ndcg10"), F.avg("mrr10").alias("mrr10"), F.count("*").alias("query_count"))
    base = m.unpivot(["mode", "query_count"], ["ndcg10", "mrr10"], "metric", "value").select("mode", "metric", "value", "query_count")
    is_ = lambda a, b: (F.col("mode") == a) & (F.col("metric") == b)
    now = base.where(~is_("hybrid", "mrr10")).withColumn("query_count", F.col("query_count") + is_("keyword", "mrr10").cast("int")).withColumn("value", F.col("value") - F.when(is_("semantic", "ndcg10"), 0.021).when(is_("semantic", "mrr10"), 0.02).otherwise(0.0))
    return evaluation.regressions(base.where(~is_("hybrid", "ndcg10")), now).select("mode", "metric", "status")


@query("""WITH RECURSIVE s(i, st, l) AS (SELECT 99, 7::UHUGEINT, range(100) UNION ALL
SELECT i - 1, nx, list_transform(range(1, 101), lambda p: CASE WHEN p = i + 1 THEN l[j + 1] WHEN p = j + 1 THEN l[i + 1] ELSE l[p] END) FROM (SELECT i, l, (st * 6364136223846793005::UHUGEINT + 1442695040888963407::UHUGEINT) % 18446744073709551616::UHUGEINT AS nx, ((st * 6364136223846793005::UHUGEINT + 1442695040888963407::UHUGEINT) % 18446744073709551616::UHUGEINT % (i + 1)::UHUGEINT)::BIGINT AS j FROM s WHERE i > 0))
SELECT unnest(range(100)) AS place, unnest(l) AS item FROM s WHERE i = 0""")
def shuffled_pool(spark: SparkSession, sf: str) -> DataFrame:
    """A judging pool of a hundred in an order that the generator decides."""
    return spark.createDataFrame(list(enumerate(evaluation.shuffled(list(range(100)), 7))), "place int, item int")


# ------------------------------------------------------------ passages
@query(r"""
WITH RECURSIVE ln AS (SELECT doc_id, unnest(str_split(text, chr(10))) AS t, unnest(range(len(str_split(text, chr(10))))) AS l FROM documents),
lw AS (SELECT doc_id, l, t, list_filter(str_split_regex(t, '\s+'), lambda x: x <> '') AS w FROM ln WHERE trim(t) <> ''),
pc AS (SELECT doc_id, l, 0 AS c, regexp_replace(t, '^\s+$', '') AS p, len(w) AS n FROM lw WHERE len(w) <= 384 UNION ALL SELECT doc_id, l, c, array_to_string(w[c * 384 + 1 : c * 384 + 384], ' '), len(w[c * 384 + 1 : c * 384 + 384]) FROM (SELECT *, unnest(range((len(w) + 383) // 384)) AS c FROM lw WHERE len(w) > 384)),
pn AS (SELECT doc_id, p, n, row_number() OVER (PARTITION BY doc_id ORDER BY l, c) AS i FROM pc),
wk(doc_id, i, g, size) AS (SELECT doc_id, i, 0, n FROM pn WHERE i = 1 UNION ALL SELECT pn.doc_id, pn.i, CASE WHEN size + n > 384 THEN g + 1 ELSE g END, CASE WHEN size + n > 384 THEN n ELSE size + n END FROM wk JOIN pn ON pn.doc_id = wk.doc_id AND pn.i = wk.i + 1),
ps AS (SELECT doc_id, g, string_agg(p, chr(10) || chr(10) ORDER BY wk.i) AS content, sum(n)::BIGINT AS tokens FROM wk JOIN pn USING (doc_id, i) GROUP BY 1, 2)
SELECT doc_id AS page_id, g AS ordinal, tokens, sha256('passage' || chr(0) || doc_id::VARCHAR || chr(0) || g::VARCHAR || chr(0) || content) AS passage_id FROM ps""")
def passages(spark: SparkSession, sf: str) -> DataFrame:
    from corpuslake.functions import text as tx
    from corpuslake.operators import extract

    docs = d.texts(spark, sf).select(F.col("doc_id").alias("page_id"), extract.line_blocks("text").alias("blocks"))
    return extract.passages(docs, max_tokens=384).select("page_id", "ordinal", tx.token_count("content").alias("tokens"), "passage_id")
