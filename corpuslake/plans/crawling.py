"""Queries of URLs, frontier, permits, streams, text and extraction, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.functions import text as tx
from corpuslake.functions import urls
from corpuslake.operators import dedup, evaluation, extract, frontier, operations, recrawl, search
from corpuslake.plans import derive as d
from corpuslake.streaming import reduce as streaming

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# ------------------------------------------------------------ URLs
@query(r"""WITH p AS (SELECT page_id, regexp_replace(url, '[#?].*$', '') AS u FROM pages), q AS (SELECT page_id, CASE WHEN u SIMILAR TO 'https?://[^/?]+' THEN u || '/' ELSE u END AS u FROM p)
SELECT page_id, CASE page_id % 8 WHEN 5 THEN NULL WHEN 6 THEN rtrim(u, '/') || '/caf%C3%A9%20x?a=%27' WHEN 7 THEN regexp_replace(u, '^(https?)://[^/]+', '\1://192.0.2.7:8080') ELSE u END AS canonical,
  CASE page_id % 8 WHEN 5 THEN NULL ELSE CASE WHEN page_id % 8 = 7 THEN regexp_extract(u, '^https?') || '://192.0.2.7:8080' ELSE regexp_extract(u, '^https?://[^/]+') END END AS origin FROM q""")
def url_canonical(spark: SparkSession, sf: str) -> DataFrame:
    """Pages' URLs written in other ways: upper case, default port, dot segments, backslashes, credentials, other characters, addresses in hexadecimal."""
    p = d.table(spark, sf, "pages").select("page_id", F.regexp_replace("url", "[#?].*$", "").alias("u"))
    scheme, rest = F.regexp_extract("u", "^(https?)://", 1), F.regexp_extract("u", "^https?://([^/]+)", 1)
    path = F.regexp_extract("u", "^https?://[^/]+(.*)$", 1)
    port = F.when(scheme == "https", ":443").otherwise(":80")
    k = F.col("page_id") % 8
    url = (
        F.when(k == 0, F.col("u")).when(k == 1, F.concat(F.upper(scheme), F.lit("://"), F.upper(rest), path)).when(k == 2, F.concat(scheme, F.lit("://"), rest, port, path, F.lit("#f"))).when(k == 3, F.concat(scheme, F.lit("://"), rest, F.lit("/x/./%2e%2E"), F.when(path == "", "/").otherwise(path)))
        .when(k == 4, F.concat(F.lit(" "), scheme, F.lit(":\\\\"), rest, F.replace(path, F.lit("/"), F.lit("\\")), F.lit("\t"))).when(k == 5, F.concat(scheme, F.lit("://user@"), rest, path)).when(k == 6, F.concat(scheme, F.lit("://"), rest, F.rtrim(path, F.lit("/")), F.lit("/café x?a='")))
        .otherwise(F.concat(scheme, F.lit("://0xC0.0.0x2.7:8080"), path))
    )
    out = p.select("page_id", urls.canonical_url(url).alias("canonical"))
    return out.withColumn("origin", urls.origin_key("canonical"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'group:g' || (page_id % 4)::VARCHAR ELSE regexp_extract(url, '^https?://[^/?]+') END AS schedule_key FROM pages")
def schedule_keys(spark: SparkSession, sf: str) -> DataFrame:
    group = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("g"), (F.col("page_id") % 4).cast("string")))
    return d.table(spark, sf, "pages").select("page_id", urls.schedule_key("url", group).alias("schedule_key"))


def _sources(spark: SparkSession) -> DataFrame:
    rows = [(1, "en", ["https://a.example"], ["/en", "/x"], ["/en/13"], ["https://a.example/en", "https://a.example/map"]), (2, "all", ["https://a.example", "https://b.example"], ["/"], ["/9"], []), (3, "deep", ["https://b.example"], ["/en/1"], [], ["https://b.example/none"])]
    s = spark.createDataFrame(rows, "ordinal int, source_id string, allowed_origins array<string>, path_prefixes array<string>, deny_prefixes array<string>, sitemap_url_prefixes array<string>")
    return s.withColumn("allowed_urls", F.lit(None).cast("array<string>"))


@query("SELECT * FROM (VALUES ('en', 'all'), ('all', 'deep')) v(left_source, right_source)")
def source_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    return urls.overlapping_sources(_sources(spark))


@query("""SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN true WHEN 1 THEN true ELSE false END AS sitemap_allowed FROM customer""")
def sitemap_allowed(spark: SparkSession, sf: str) -> DataFrame:
    """The first source's prefixes don't matter where another of the same origin takes any; an origin without a source is refused."""
    k = F.col("c_custkey")
    host = F.when(k % 3 == 0, "https://a.example").when(k % 3 == 1, "https://b.example").otherwise("https://c.example")
    c = d.table(spark, sf, "customer").select(k.alias("k"), F.concat(host, F.lit("/en/"), k.cast("string")).alias("url"))
    return urls.sitemap_url_allowed(c, _sources(spark)).select("k", "sitemap_allowed")


def _robots(spark: SparkSession) -> DataFrame:
    files = spark.createDataFrame([("https://a.example", "User-agent: *\nDisallow: /15\nDisallow: /hidden"), ("https://b.example", "User-agent: other\nDisallow: /")], "origin string, text string")
    return urls.robots_table(files, "origin", "text")


@query("""WITH RECURSIVE h AS (SELECT 'https://a.example/' || c_custkey::VARCHAR AS u, CASE WHEN c_custkey % 11 = 0 THEN 'https://b.example/' ELSE 'https://a.example/' END || ((c_custkey * 7 + 3) % 200)::VARCHAR AS l FROM customer),
o AS (SELECT *, NOT starts_with(regexp_replace(l, '^https://[^/]+', ''), '/9') AS owned, NOT (starts_with(l, 'https://a.example/15')) AS allowed FROM h),
w AS (SELECT u, u AS cur, [u] AS chain, NULL::VARCHAR AS stopped FROM h
  UNION ALL SELECT w.u, o.l, list_append(w.chain, o.l), CASE WHEN NOT owned THEN 'redirect_outside_source_allowlist' WHEN list_contains(w.chain, o.l) THEN 'redirect_loop' WHEN NOT allowed THEN 'redirect_robots_denied' END FROM w JOIN o ON o.u = w.cur WHERE stopped IS NULL AND len(chain) <= 10),
z AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY len(chain) DESC) AS r FROM w)
SELECT z.u AS url, len(chain)::INT AS hops, coalesce(stopped, CASE WHEN h.u IS NOT NULL THEN 'redirect_limit_exceeded' ELSE 'ok' END) AS outcome,
  CASE WHEN stopped IS NULL AND h.u IS NULL THEN cur END AS final_url, CASE WHEN stopped IS NULL AND h.u IS NULL THEN 'all' END AS owner FROM z LEFT JOIN h ON h.u = z.cur WHERE r = 1""")
def redirect_owners(spark: SparkSession, sf: str) -> DataFrame:
    """Redirects by relative and absolute locations; each hop has an owner of its own and must be allowed by robots."""
    k = F.col("c_custkey")
    to = ((k * 7 + 3) % 200).cast("string")
    hops = d.table(spark, sf, "customer").select(F.concat(F.lit("https://a.example/"), k.cast("string")).alias("url"), F.when(k % 11 == 0, F.concat(F.lit("https://b.example/"), to)).when(k % 2 == 0, F.concat(F.lit("/"), to)).otherwise(to).alias("location"))
    out = urls.resolve_redirects(hops.select("url"), hops, sources=_sources(spark), rules=_robots(spark), agent="mine")
    return out.select("url", F.size("chain").alias("hops"), "outcome", "final_url", "owner")


@query("""SELECT DISTINCT 'https://a.example/en/' || c_custkey::VARCHAR AS loc FROM customer WHERE c_custkey % 4 = 0 AND NOT starts_with(c_custkey::VARCHAR, '9')
UNION SELECT 'https://b.example/p/' || c_custkey::VARCHAR FROM customer WHERE c_custkey % 4 = 1""")
def sitemap_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages under two roots: an index on its own origin is followed, one on another origin, one that robots forbid and one beyond the depth are not; pages need an owner."""
    a, b = "https://a.example", "https://b.example"
    tree = [(f"{a}/map/root.xml", f"{a}/map/en.xml", True), (f"{a}/map/root.xml", f"{a}/hidden/no.xml", True), (f"{a}/map/root.xml", f"{b}/other.xml", True), (f"{b}/root.xml", f"{b}/p.xml", True), (f"{a}/map/en.xml", f"{a}/map/root.xml", True)]
    tree += [(f"{b}/d{i}.xml", f"{b}/d{i + 1}.xml", True) for i in range(7)] + [(f"{b}/root.xml", f"{b}/d0.xml", True)]
    k = F.col("c_custkey")
    leaf = F.when(k % 4 == 0, f"{a}/map/en.xml").when(k % 4 == 1, f"{b}/p.xml").when(k % 4 == 2, f"{a}/hidden/no.xml").otherwise(f"{b}/d7.xml")
    page = F.concat(F.when(k % 4 == 1, f"{b}/p/").when((k % 4 == 0) & k.cast("string").startswith("9"), "https://c.example/").otherwise(f"{a}/en/"), k.cast("string"))
    entries = d.table(spark, sf, "customer").select(leaf.alias("sitemap"), page.alias("loc"), F.lit(False).alias("is_index"))
    sources = _sources(spark).withColumn("deny_prefixes", F.array().cast("array<string>"))
    return urls.expand_sitemaps(spark.createDataFrame([(f"{a}/map/root.xml",), (f"{b}/root.xml",)], "sitemap string"), entries.unionByName(spark.createDataFrame(tree, entries.schema)), sources=sources, rules=_robots(spark), agent="mine")


@query("SELECT c_custkey AS k, c_custkey % 2 = 0 AS is_index, CASE c_custkey % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'en-US' WHEN 2 THEN NULL ELSE 'zh-Hant-TW' END AS tag FROM customer")
def markup_flags(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    text = F.when(k % 2 == 0, "<?xml?><SitemapIndex xmlns='x'>").otherwise("<urlset><!-- sitemapindexes -->")
    tag = F.when(k % 4 == 0, "en").when(k % 4 == 1, "en-US").when(k % 4 == 2, "x").otherwise("zh-Hant-TW")
    return d.table(spark, sf, "customer").select(k.alias("k"), urls.is_sitemap_index(text).alias("is_index"), urls.language_tag(tag).alias("tag"))


# ------------------------------------------------------------ frontier
@query("""WITH o AS (SELECT o_custkey % 50 AS r, count(*) FILTER (o_orderstatus = 'O' AND o_custkey % 50 > 5) AS open, count(*) FILTER (o_orderstatus = 'P' AND o_custkey % 50 % 3 = 0) AS undelivered FROM orders GROUP BY 1) SELECT r AS crawl_run_id, open = 0 AND undelivered = 0 AS quiescent FROM o""")
def quiescent_runs(spark: SparkSession, sf: str) -> DataFrame:
    o = d.table(spark, sf, "orders").withColumn("crawl_run_id", F.col("o_custkey") % 50)
    tasks = o.select("crawl_run_id", F.when((F.col("o_orderstatus") == "O") & (F.col("crawl_run_id") > 5), "pending").otherwise("succeeded").alias("status"))
    outbox = o.where("o_orderstatus = 'P'").select("crawl_run_id", F.when(F.col("crawl_run_id") % 3 != 0, F.col("o_orderkey")).alias("delivered_at"))
    return frontier.quiescent(tasks, outbox)


@query("""WITH g AS (SELECT user_id % 30 AS r, event_id, row_number() OVER (PARTITION BY user_id % 30 ORDER BY event_id) AS n, count(*) OVER (PARTITION BY user_id % 30) AS c FROM events WHERE event_id % 9 = 4)
SELECT r AS crawl_run_id, any_value(c) AS missing_count, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) FILTER (n <= 20) AS sample FROM g GROUP BY 1""")
def missing_events(spark: SparkSession, sf: str) -> DataFrame:
    e = d.table(spark, sf, "events").select((F.col("user_id") % 30).alias("crawl_run_id"), "event_id")
    return frontier.missing_events(e, e.where("event_id % 9 <> 4")).withColumn("sample", F.array_join(F.transform("sample", lambda x: x.cast("string")), ","))


_DUE = """WITH e AS (SELECT user_id % 20 AS r, event_id, event_id % 50 AS created_at, event_id % 4 = 0 AS acked, CASE WHEN event_id % 7 = 3 THEN event_id % 200 END AS next_at FROM events), p AS (SELECT *, coalesce(next_at > 100, false) AS waiting FROM e WHERE NOT acked)"""


def _deliveries(spark: SparkSession, sf: str, skip: bool) -> DataFrame:
    e = d.table(spark, sf, "events").select((F.col("user_id") % 20).alias("crawl_run_id"), "event_id", (F.col("event_id") % 50).alias("created_at"))
    c = e.where("event_id % 4 = 0 OR event_id % 7 = 3").select("crawl_run_id", "event_id", (F.col("event_id") % 4 == 0).alias("acked"), F.when(F.col("event_id") % 7 == 3, F.col("event_id") % 200).alias("next_attempt_at"))
    return frontier.due_deliveries(e, c, 100, skip).select("crawl_run_id", "event_id")


@query(f"{_DUE} SELECT r AS crawl_run_id, event_id FROM p WHERE NOT waiting")
def poller_deliveries(spark: SparkSession, sf: str) -> DataFrame:
    return _deliveries(spark, sf, True)


@query(f"{_DUE}, h AS (SELECT *, max(waiting::INT) OVER (PARTITION BY r ORDER BY created_at, event_id ROWS UNBOUNDED PRECEDING) AS held FROM p) SELECT r AS crawl_run_id, event_id FROM h WHERE held = 0")
def relay_deliveries(spark: SparkSession, sf: str) -> DataFrame:
    """A relay sends in order and stops at a head that is backing off."""
    return _deliveries(spark, sf, False)


@query("""WITH r AS (SELECT user_id % 40 AS r, CASE WHEN event_id % 3 = 0 THEN 0 WHEN event_id % 5 = 0 OR user_id % 40 < 30 THEN 1 ELSE 2 END AS k, event_id FROM events)
SELECT r AS crawl_run_id, CASE max(k) WHEN 0 THEN 'complete' WHEN 1 THEN 'replayable' ELSE 'unrecoverable' END AS replay_status, count(*) FILTER (k = 1) AS replayable_count, count(DISTINCT CASE WHEN k = 2 THEN event_id END) AS gap_count, min(CASE WHEN k = 2 THEN event_id END) AS first_gap FROM r GROUP BY 1""")
def replay_states(spark: SparkSession, sf: str) -> DataFrame:
    e = d.table(spark, sf, "events").select((F.col("user_id") % 40).alias("crawl_run_id"), "event_id")
    out = recrawl.replay_preflight(e, e.where("event_id % 3 = 0"), e.where("event_id % 5 = 0"), e.where("crawl_run_id < 30"))
    return out.select("crawl_run_id", "replay_status", "replayable_count", F.size("gaps").alias("gap_count"), F.element_at(F.when(F.size("gaps") > 0, F.col("gaps")), 1).alias("first_gap"))


@query("""SELECT o_orderkey AS task_id, CASE WHEN o_orderstatus = 'F' THEN 'requeued' ELSE 'skipped' END AS outcome FROM orders WHERE o_orderkey % 7 = 0 GROUP BY ALL""")
def requeued_tasks(spark: SparkSession, sf: str) -> DataFrame:
    o = d.table(spark, sf, "orders").select(F.col("o_orderkey").alias("task_id"), F.when(F.col("o_orderstatus") == "F", "failed").otherwise("succeeded").alias("status"), F.lit(3).alias("attempts"))
    back, skipped = frontier.requeue(o, o.where("task_id % 7 = 0"))
    return back.where("status = 'pending' AND attempts = 0").select("task_id", F.lit("requeued").alias("outcome")).unionByName(skipped.select("task_id", F.lit("skipped").alias("outcome")))


@query("""WITH g AS (SELECT l_suppkey % 3 AS s, count(DISTINCT l_partkey % 97) AS n FROM lineitem GROUP BY 1) SELECT t AS target, bool_and(n >= 40) AND sum(n) >= t AS completed FROM g CROSS JOIN (VALUES (100), (100000)) v(t) GROUP BY t""")
def run_completion(spark: SparkSession, sf: str) -> DataFrame:
    c = d.table(spark, sf, "lineitem").select((F.col("l_suppkey") % 3).alias("source_id"), (F.col("l_partkey") % 97).alias("content_sha256"))
    quotas = spark.createDataFrame([(i, 40) for i in range(3)], "source_id bigint, quota int")
    return spark.createDataFrame([(t, frontier.run_completed(c, quotas, t)) for t in (100, 100_000)], "target int, completed boolean")


@query("""WITH e AS (SELECT event_id, event_id % 6 AS k FROM events)
SELECT event_id, CASE k WHEN 0 THEN 120000 WHEN 1 THEN 60000 + event_id % 50 * 1000 WHEN 2 THEN 0 WHEN 3 THEN 3600000 WHEN 4 THEN NULL ELSE 86400000 END::BIGINT AS asked_ms,
  greatest(5000, least(coalesce(CASE k WHEN 0 THEN 120000 WHEN 1 THEN 60000 + event_id % 50 * 1000 WHEN 2 THEN 0 WHEN 3 THEN 3600000 WHEN 5 THEN 86400000 END, 0), 300000))::BIGINT AS hold_ms, least(30000, 500 * pow(2, event_id % 10))::BIGINT AS retry_ms FROM e""")
def retry_holds(spark: SparkSession, sf: str) -> DataFrame:
    """Retry-After in seconds, in each form of date, in the past and as nonsense; holds with a back-off of five seconds; delays of retries."""
    e = d.table(spark, sf, "events").select("event_id", (F.col("event_id") % 6).alias("k"), (F.col("event_id") % 10 + 1).alias("attempt"))
    at = F.lit("1994-11-06T08:48:37Z").cast("timestamp")
    later = F.date_format(at + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(1), (F.col("event_id") % 50).cast("decimal(18,6)")), "HH:mm:ss")
    header = (
        F.when(F.col("k") == 0, " 120 ").when(F.col("k") == 1, F.concat(F.lit("Sun, 06 Nov 1994 "), later, F.lit(" GMT"))).when(F.col("k") == 2, "Sunday, 06-Nov-94 08:00:00 GMT").when(F.col("k") == 3, "Sun Nov  6 09:48:37 1994").when(F.col("k") == 4, "soon")
        .otherwise("Mon, 07 Nov 1994 08:48:37 GMT")
    )
    asked = e.withColumn("asked_ms", frontier.retry_after_ms(header, at))
    return asked.select("event_id", "asked_ms", frontier.hold_ms(F.lit(5_000), "asked_ms").alias("hold_ms"), frontier.retry_delay_ms("attempt", 500, 30_000).alias("retry_ms"))


def _permit_tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """A run for each customer: orders are its permits, and each run asks for one request, old or new."""
    o = d.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    k = F.col("o_orderkey")
    permits = o.select(
        F.col("o_custkey").cast("string").alias("crawl_run_id"), F.concat(F.lit("r"), k.cast("string")).alias("request_id"), F.lit("w").alias("worker_id"), F.concat(F.lit("k"), (k % 5).cast("string")).alias("schedule_key"), F.concat(F.lit("https://o"), (k % 3).cast("string")).alias("origin"), F.lit("page").alias("request_kind"),
        F.when(k % 4 == 0, "active").when(k % 4 == 1, "completed").otherwise("pending").alias("status"), (k % 100).alias("queued_at"), (k % 300).alias("pending_deadline"), F.when(k % 4 < 2, k % 200).alias("expires_at"),
    )
    c = d.table(spark, sf, "customer").select("c_custkey")
    first = o.groupBy("o_custkey").agg(F.min("o_orderkey").alias("old"))
    r = c.join(first, F.col("c_custkey") == F.col("o_custkey"), "left")
    old = F.col("old").isNotNull() & (F.col("c_custkey") % 2 == 0)
    key = F.when(old, F.col("old")).otherwise(F.col("c_custkey"))
    requests = r.select(
        F.col("c_custkey").cast("string").alias("crawl_run_id"), F.when(old, F.concat(F.lit("r"), key.cast("string"))).otherwise("new").alias("request_id"), F.when(F.col("c_custkey") % 10 == 4, "thief").otherwise("w").alias("worker_id"),
        F.concat(F.lit("k"), (key % 5).cast("string")).alias("schedule_key"), F.concat(F.lit("https://o"), (key % 3).cast("string")).alias("origin"), F.lit("page").alias("request_kind"),
    )
    run = F.col("c_custkey").cast("string").alias("crawl_run_id")
    policy = c.select(run, F.lit(4).alias("global_concurrency"), F.lit(2).alias("origin_concurrency"), F.lit(50).alias("spacing_ms"), F.lit(1_000).alias("lifetime_ms"), F.lit(100).alias("max_attempts"), F.lit(4).alias("max_pending"), (F.col("c_custkey") % 103).alias("total_attempts"), F.when(F.col("c_custkey") % 3 == 0, "k2").alias("cursor"))
    origins = c.where("c_custkey % 5 = 0").select(run, F.lit("https://o1").alias("origin"), F.lit(1).alias("origin_concurrency"), F.lit(200).alias("spacing_ms"), F.lit("g").alias("group"))
    spacing = c.where("c_custkey % 6 = 0").select(run, F.lit("k3").alias("key"), F.lit(150).cast("long").alias("next_allowed_at"))
    return {"requests": requests, "permits": permits, "policy": policy, "origins": origins, "spacing": spacing}


PERMITS = """
pm AS (SELECT o_custkey AS run, 'r' || o_orderkey::VARCHAR AS id, 'k' || (o_orderkey % 5)::VARCHAR AS k, 'https://o' || (o_orderkey % 3)::VARCHAR AS o, o_orderkey % 100 AS q,
  CASE WHEN o_orderkey % 4 = 0 AND o_orderkey % 200 <= 100 THEN 'expired' WHEN o_orderkey % 4 = 0 THEN 'active' WHEN o_orderkey % 4 = 1 THEN 'completed' ELSE 'pending' END AS st FROM orders WHERE o_orderkey % 4 < 2 OR o_orderkey % 300 > 100),
rq AS (SELECT c_custkey AS run, CASE WHEN old IS NOT NULL AND c_custkey % 2 = 0 THEN 'r' || old::VARCHAR ELSE 'new' END AS id, c_custkey % 10 = 4 AS thief, CASE WHEN old IS NOT NULL AND c_custkey % 2 = 0 THEN old ELSE c_custkey END AS n FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS old FROM orders GROUP BY 1) ON o_custkey = c_custkey),
st AS (SELECT rq.*, pm.st AS was, (SELECT count(*) FROM pm p WHERE p.run = rq.run AND p.st = 'pending') AS waiting FROM rq LEFT JOIN pm ON pm.run = rq.run AND pm.id = rq.id),
de AS (SELECT *, CASE WHEN was IS NOT NULL AND thief THEN 'error_reused_request_id' WHEN was = 'active' THEN 'acquired' WHEN was = 'completed' THEN 'already_completed' WHEN was = 'expired' THEN 'error_expired' WHEN was IS NULL AND waiting >= 4 THEN 'error_pending_limit'
  WHEN run % 103 >= 100 THEN 'error_attempt_limit' ELSE 'queued' END AS decision FROM st),
qu AS (SELECT run, id, k, o, q FROM pm WHERE st = 'pending' UNION ALL SELECT run, id, 'k' || (n % 5)::VARCHAR, 'https://o' || (n % 3)::VARCHAR, 100 FROM de WHERE decision = 'queued' AND was IS NULL),
ok AS (SELECT qu.*, row_number() OVER (PARTITION BY run ORDER BY run % 3 = 0 AND k <= 'k2', k, q, id) AS place FROM qu WHERE run IN (SELECT run FROM de WHERE decision = 'queued')
  AND (SELECT count(*) FROM pm a WHERE a.run = qu.run AND a.st = 'active') < 4 AND (SELECT count(*) FROM pm a WHERE a.run = qu.run AND a.st = 'active' AND a.o = qu.o) < CASE WHEN run % 5 = 0 AND o = 'https://o1' THEN 1 ELSE 2 END AND NOT (run % 6 = 0 AND k = 'k3')),
ch AS (SELECT * FROM ok WHERE place = 1)"""


@query(f"WITH {PERMITS} SELECT de.run::VARCHAR AS crawl_run_id, de.id AS request_id, CASE WHEN decision = 'queued' AND ch.id = de.id THEN 'acquired' ELSE decision END AS decision FROM de LEFT JOIN ch ON ch.run = de.run")
def permit_decisions(spark: SparkSession, sf: str) -> DataFrame:
    return frontier.admit(**_permit_tables(spark, sf), now=100)[0]


@query(f"""WITH {PERMITS}, af AS (SELECT run, CASE WHEN (run, id) IN (SELECT run, id FROM ch) THEN 'active' ELSE st END AS st FROM pm WHERE NOT (st = 'pending' AND (run, id) IN (SELECT run, id FROM de WHERE decision = 'error_attempt_limit'))
UNION ALL SELECT run, CASE WHEN (run, id) IN (SELECT run, id FROM ch) THEN 'active' ELSE 'pending' END FROM de WHERE decision = 'queued' AND was IS NULL) SELECT run::VARCHAR AS crawl_run_id, st AS status, count(*) AS permits FROM af GROUP BY 1, 2""")
def permit_states(spark: SparkSession, sf: str) -> DataFrame:
    return frontier.admit(**_permit_tables(spark, sf), now=100)[1].groupBy("crawl_run_id", "status").agg(F.count("*").alias("permits"))


@query(f"""WITH {PERMITS}, mk AS (SELECT run, o AS key, 100 + CASE WHEN run % 5 = 0 AND o = 'https://o1' THEN 200 ELSE 50 END AS t FROM ch UNION ALL SELECT run, k, 100 + CASE WHEN run % 5 = 0 AND o = 'https://o1' THEN 200 ELSE 50 END FROM ch UNION ALL SELECT c_custkey, 'k3', 150 FROM customer WHERE c_custkey % 6 = 0)
SELECT run::VARCHAR AS crawl_run_id, key, max(t) AS next_allowed_at FROM mk GROUP BY 1, 2""")
def permit_spacing(spark: SparkSession, sf: str) -> DataFrame:
    return frontier.admit(**_permit_tables(spark, sf), now=100)[2]


# ------------------------------------------------------------ streams
@query("""WITH e AS (SELECT user_id % 25 AS r, event_id, event_id % 400 AS at, CASE WHEN event_id % 90 = 5 THEN 9000 ELSE 10 + event_id % 50 END AS size, event_id % 60 = 7 AS terminal, row_number() OVER (PARTITION BY user_id % 25 ORDER BY event_id % 400, event_id) AS n FROM events),
f AS (SELECT *, sum(CASE WHEN size > 4096 THEN 0 ELSE size END) OVER w AS b, max(terminal::INT) OVER (PARTITION BY r ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ended FROM e WHERE n <= 128 WINDOW w AS (PARTITION BY r ORDER BY n ROWS UNBOUNDED PRECEDING))
SELECT r AS crawl_run_id, event_id, size > 4096 AS quarantine FROM f WHERE b <= 4096 AND coalesce(ended, 0) = 0""")
def next_micro_batch(spark: SparkSession, sf: str) -> DataFrame:
    e = d.table(spark, sf, "events").select((F.col("user_id") % 25).alias("crawl_run_id"), "event_id", F.when(F.col("event_id") % 60 == 7, "corpus_snapshot_published").otherwise("capture_committed").alias("event_type"), (F.col("event_id") % 400).alias("created_at"), F.when(F.col("event_id") % 90 == 5, 9_000).otherwise(F.col("event_id") % 50 + 10).alias("size"))
    return streaming.next_batch(e, max_bytes=4_096).select("crawl_run_id", "event_id", "quarantine")


@query("SELECT user_id % 35 AS crawl_run_id FROM events GROUP BY 1 HAVING bool_or(event_type = 'signup' AND event_id % 2 = 0) AND NOT bool_or(user_id % 35 % 4 = 1 AND event_type = 'error')")
def completed_runs(spark: SparkSession, sf: str) -> DataFrame:
    e = d.table(spark, sf, "events").select((F.col("user_id") % 35).alias("crawl_run_id"), "event_id", "event_type")
    seen = e.where("NOT (crawl_run_id % 4 = 1 AND event_type = 'error')").withColumn("event_type", F.when((F.col("event_type") == "signup") & (F.col("event_id") % 2 == 0), "crawl_completed").otherwise("capture_committed"))
    return streaming.completed_runs(seen, e.select("crawl_run_id", "event_id"))


@query("SELECT DISTINCT o_custkey AS snapshot_id FROM orders WHERE o_custkey % 9 = 2 OR o_custkey % 11 = 3")
def replica_parity(spark: SparkSession, sf: str) -> DataFrame:
    n = d.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("snapshot_id")).agg(F.count("*").alias("page_count"), F.max("o_orderkey").alias("alias_count"))
    replica = n.where("snapshot_id % 9 <> 2").withColumn("page_count", F.when(F.col("snapshot_id") % 11 == 3, F.col("page_count") + 1).otherwise(F.col("page_count")))
    return streaming.parity(replica, n)


# ------------------------------------------------------------ text, duplicates and extraction
@query(r"""WITH t AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents), c AS (SELECT doc_id, t, list_filter(range(1, least(length(t), 240) + 1), lambda n: octet_length(encode(t[1:n])) >= 240)[1] AS n FROM t) SELECT doc_id, rtrim(CASE WHEN n IS NULL THEN t ELSE t[1:n] END) AS snippet FROM c""")
def snippets(spark: SparkSession, sf: str) -> DataFrame:
    return d.texts(spark, sf).select("doc_id", tx.trim_snippet(tx.normalize_text("text"), 240).alias("snippet"))


_EMBED = r"""k AS (SELECT item_id, unnest(regexp_extract_all(lower('part ' || (item_id % 4)::VARCHAR || chr(10) || text), '[\p{L}\p{N}]+')) AS w FROM benchmark),
h AS (SELECT item_id, sha256(w) AS x FROM k), b AS (SELECT item_id, j, ('0x' || x[j*2+7:j*2+8] || x[j*2+5:j*2+6] || x[j*2+3:j*2+4] || x[j*2+1:j*2+2])::UBIGINT % 16 AS bucket, CASE WHEN ('0x' || x[j*2+9:j*2+10])::UBIGINT % 2 = 1 THEN 1 ELSE -1 END AS v FROM h CROSS JOIN (VALUES (0), (8)) q(j)),
g AS (SELECT item_id, bucket, sum(v) AS v FROM b GROUP BY 1, 2), n AS (SELECT item_id, sqrt(sum(v * v)) AS n FROM g GROUP BY 1)"""


@query(f"WITH {_EMBED} SELECT g.item_id, bucket::INT AS bucket, round(v / n, 5)::DOUBLE AS value FROM g JOIN n ON n.item_id = g.item_id WHERE v <> 0")
def passage_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of passages under headings; half of them are in the cache already."""
    b = d.table(spark, sf, "benchmark").select(F.col("item_id").alias("key"), tx.embedding_input(F.array(F.lit("part"), (F.col("item_id") % 4).cast("string")), "text").alias("text"))
    half = b.where("key % 2 = 0").select(F.sha2("text", 256).alias("input_sha"), tx.hash_embed("text", 16).alias("vector")).dropDuplicates(["input_sha"])
    out = tx.embed_missing(b, half, 16)
    return out.select(F.col("key").alias("item_id"), F.posexplode("vector").alias("bucket", "v")).where("v <> 0").select("item_id", "bucket", F.round(F.col("v").cast("double"), 5).alias("value"))


@query("""WITH v AS (SELECT doc_id, n_chars FROM documents), w AS (SELECT fp, d.k FROM (SELECT 1) x(fp), (SELECT unnest(range(0)) AS k) d)
SELECT no::INT AS no, count(*) AS documents FROM documents CROSS JOIN (SELECT unnest(range(7)) AS no) WHERE len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) >= 3 GROUP BY 1""")
def fingerprint_bands(spark: SparkSession, sf: str) -> DataFrame:
    """Each fingerprint's seven bands put together again are the fingerprint."""
    f = d.texts(spark, sf).select(tx.simhash64("text").alias("fp")).where("fp IS NOT NULL")
    b = f.select("fp", tx.bands("fp").alias("b"))
    whole = F.lit(0).cast("long")
    for i, (low, _) in enumerate(tx.BANDS):
        whole = whole.bitwiseOR(F.shiftleft(F.col("b")[i]["val"].cast("long"), low))
    return b.where(whole == F.col("fp")).select(F.explode("b").alias("x")).groupBy("x.no").agg(F.count("*").alias("documents"))


@query(r"""WITH d AS (SELECT doc_id, text, text || ' ' || text AS t FROM documents), s0 AS (SELECT doc_id, sha256(text) AS sha, text FROM documents ORDER BY doc_id LIMIT 200),
w AS (SELECT doc_id, sha, list_filter(str_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM s0 WHERE length(text) <= 1000 AND octet_length(encode(text)) <= 4000),
s AS (SELECT DISTINCT doc_id, sha, array_to_string(w[i : i + 4], ' ') AS h FROM (SELECT doc_id, sha, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), r AS (SELECT h FROM s GROUP BY 1 HAVING count(*) BETWEEN 2 AND 5),
p AS (SELECT a.doc_id AS l, b.doc_id AS r, count(*) AS shared FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id AND a.sha <> b.sha WHERE a.h IN (SELECT h FROM r) GROUP BY 1, 2 HAVING count(*) >= 3),
j AS (SELECT l, r, shared, shared / (x.n + y.n - shared) AS jaccard FROM p JOIN n x ON x.doc_id = l JOIN n y ON y.doc_id = p.r)
SELECT l AS left_doc_id, r AS right_doc_id, shared, round(jaccard, 6) AS jaccard, row_number() OVER (ORDER BY jaccard DESC, shared DESC, l, r)::INT AS candidate_rank FROM j WHERE jaccard >= 0.1 QUALIFY candidate_rank <= 500""")
def shingle_sample_report(spark: SparkSession, sf: str) -> DataFrame:
    """The report with its own bounds: the first 200 texts by id, of up to 1,000 characters and 4,000 bytes (here with pairs from a similarity of 0.1)."""
    docs = d.texts(spark, sf).withColumn("sha", F.sha2("text", 256))
    out = dedup.shingle_similarity(docs, ["doc_id"], "text", "sha", at_least=0.1)
    return out.withColumn("jaccard", F.round("jaccard", 6))


_LADDER = """CASE WHEN k = 0 THEN 'redirect_missing_location' WHEN k = 1 THEN 'url_not_normalizable' WHEN k = 2 THEN 'redirect_outside_source_allowlist' WHEN k = 3 THEN 'redirect_loop' WHEN k = 4 THEN 'redirect_robots_denied' WHEN k = 5 THEN 'non_html_content_type'
WHEN k = 6 THEN 'body_limit_exceeded' WHEN k = 7 THEN 'body_decode_failed' WHEN k = 8 THEN 'useful_content_below_minimum' WHEN k = 9 THEN 'extraction_cpu_budget_exceeded' WHEN k = 10 THEN 'redirect_limit_exceeded' ELSE 'admitted' END"""


@query(f"SELECT event_id, {_LADDER} AS admission FROM (SELECT event_id, event_id % 13 AS k FROM events)")
def response_admission(spark: SparkSession, sf: str) -> DataFrame:
    """Raw responses with one fault each; later faults stand beside it where an earlier rule must win."""
    k = F.col("event_id") % 13
    body = F.when(k == 6, F.expr("cast(repeat('a', 6000000) AS binary)")).when(k == 7, F.lit(b"\xff\xfe")).otherwise(F.lit(b"<p>x</p>"))
    r = d.table(spark, sf, "events").select(
        "event_id", F.when(k.isin(0, 2, 4), 301).otherwise(200).alias("status_code"), F.when(k.isin(2, 4), "https://b").alias("location"), F.when(k == 1, "ftp://x").otherwise("https://a.example/").alias("final_url"), (k != 2).alias("owned"), (k == 3).alias("loop"), (~k.isin(0, 4)).alias("robots_allowed"),
        F.when(k == 5, "text/plain").when(k == 11, "").otherwise("Text/HTML; charset=utf-8").alias("content_type"), body.alias("body"), F.when(k.isin(6, 8), 10).otherwise(500).alias("useful_chars"), F.when(k == 9, 9_000).otherwise(10).alias("cpu_ms"), F.when(k.isin(9, 10), 11).otherwise(0).alias("hops"),
    )
    return extract.admission(r).select("event_id", "admission")


@query("""WITH v AS (SELECT * FROM (VALUES (1, 'q', 10, 'hybrid'), (2, '', 10, 'hybrid'), (3, 'q', 0, 'hybrid'), (4, 'q', 101, 'keyword'), (5, 'q', 100, 'vector'), (6, 'q', 1, 'semantic')) v(k, q, n, m))
SELECT k, CASE WHEN k IN (1, 6) THEN 'ok' WHEN k = 2 THEN 'a query has 1 to 10000 characters' WHEN k IN (3, 4) THEN 'the limit is 1 to 100' ELSE 'unknown mode: vector' END AS said FROM v""")
def request_validation(spark: SparkSession, sf: str) -> DataFrame:
    out = []
    for k, q, n, m in ((1, "q", 10, "hybrid"), (2, "", 10, "hybrid"), (3, "q", 0, "hybrid"), (4, "q", 101, "keyword"), (5, "q", 100, "vector"), (6, "q", 1, "semantic")):
        try:
            search.validate_request(q, n, m)
            out.append((k, "ok"))
        except ValueError as e:
            out.append((k, str(e)))
    return spark.createDataFrame(out, "k int, said string")


# ------------------------------------------------------------ metrics
@query("""WITH s AS (SELECT user_id % 30 AS series, event_id AS n, event_id * 30 AS t, value AS v FROM events) SELECT series, n, round(v - first_value(v) OVER (PARTITION BY series ORDER BY t RANGE BETWEEN 900 PRECEDING AND CURRENT ROW), 6) AS delta FROM s""")
def gauge_deltas(spark: SparkSession, sf: str) -> DataFrame:
    e = d.table(spark, sf, "events").select((F.col("user_id") % 30).alias("series"), F.col("event_id").alias("n"), F.timestamp_seconds(F.col("event_id") * 30).alias("at"), F.col("value").cast("double").alias("v"))
    return operations.gauge_delta(e, ["series"], "at", "v", 900).select("series", "n", F.round("delta", 6).alias("delta"))


@query("""WITH s AS (SELECT user_id % 6 AS job, user_id % 30 AS i, arg_max(event_type <> 'error', event_id) AS up, max(event_id) AS n FROM events WHERE event_id % 1000 <= 300 GROUP BY 1, 2), l AS (SELECT user_id % 6 AS job, user_id % 30 AS i, event_type <> 'error' AS up, row_number() OVER (PARTITION BY user_id % 6, user_id % 30 ORDER BY event_id % 1000, event_id) AS r FROM events WHERE event_id % 1000 <= 300)
SELECT job, count(*) FILTER (up) AS up_count FROM l WHERE r = 1 AND job IN (SELECT DISTINCT user_id % 6 FROM events WHERE user_id % 6 <> 4) GROUP BY 1""")
def instances_up(spark: SparkSession, sf: str) -> DataFrame:
    e = d.table(spark, sf, "events").select((F.col("user_id") % 6).alias("job"), (F.col("user_id") % 30).alias("instance"), "event_id", "event_type", (F.col("event_id") % 1000).alias("age"))
    e = dedup.only_top(e, ["job", "instance", "age"], [F.col("event_id")])
    s = e.withColumn("at", F.lit("2024-01-01T01:00:00Z").cast("timestamp") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("age").cast("decimal(18,6)")))
    up = operations.count_up(s, ["job"], "instance", "at", F.col("event_type") != "error", "2024-01-01T01:00:00Z")
    return operations.and_on(up, e.where("job <> 4"), ["job"])


@query("""WITH b AS (SELECT event_type AS s, le, count(*) FILTER (value <= le) AS n, count(*) FILTER (value <= le AND event_id % 3 = 0) AS m FROM events CROSS JOIN (VALUES (5), (10), (20), (50), (100)) v(le) GROUP BY 1, 2),
t AS (SELECT event_type AS s, count(*) - count(*) FILTER (event_id % 3 = 0) AS total FROM events GROUP BY 1), c AS (SELECT b.s, le, n - m AS c, coalesce(lag(le) OVER w, 0) AS lo, coalesce(lag(n - m) OVER w, 0) AS below, total FROM b JOIN t ON t.s = b.s WINDOW w AS (PARTITION BY b.s ORDER BY le))
SELECT s AS series, round(coalesce(any_value(CASE WHEN c >= 0.5 * total AND below < 0.5 * total THEN lo + (le - lo) * (0.5 * total - below) / (c - below) END), 100), 6) AS quantile FROM c GROUP BY 1""")
def latency_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    """The median of what a histogram gained between two samples."""
    e = d.table(spark, sf, "events")
    bounds = [5.0, 10.0, 20.0, 50.0, 100.0]
    before, after = (evaluation.cumulative_buckets(x, ["event_type"], "value", bounds) for x in (e.where("event_id % 3 = 0"), e))
    return evaluation.histogram_quantile(evaluation.histogram_delta(before, after), 0.5).select("series", F.round("quantile", 6).alias("quantile"))


@query("""WITH s AS (SELECT user_id % 15 AS pod, event_id AS t, (event_id % 500)::DOUBLE AS c FROM events), l AS (SELECT *, lag(c) OVER (PARTITION BY pod ORDER BY t) AS p FROM s)
SELECT pod, round(sum(CASE WHEN p IS NULL THEN 0 WHEN c >= p THEN c - p ELSE c END) / nullif(max(t) - min(t), 0), 6) AS average_cores FROM l GROUP BY 1""")
def pod_cores(spark: SparkSession, sf: str) -> DataFrame:
    e = d.table(spark, sf, "events").select((F.col("user_id") % 15).alias("pod"), F.col("event_id").alias("t"), (F.col("event_id") % 500).cast("double").alias("c"))
    return evaluation.average_cores(e, ["pod"], "t", "c").select("pod", F.round("average_cores", 6).alias("average_cores"))
