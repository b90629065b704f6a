"""Queries of the lake, batches, logs, hashes and views, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake import views
from corpuslake.functions import canonical
from corpuslake.operators import quality, reconcile
from corpuslake.plans import derive as d
from corpuslake.session import scratch_path
from corpuslake.sources import batches, plugins
from corpuslake.sources.lake import Files, Generations, Table, batch_status, lineage, lineage_report, publish_folder, refresh_gold
from corpuslake.sources.log import Log
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


# ------------------------------------------------------------ batches
def _snapshot_tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Segments as sources, customers as pages, suppliers as passages of the page of their id, nations as aliases."""
    c, s, n = (d.table(spark, sf, x) for x in ("customer", "supplier", "nation"))
    text = F.concat_ws(" ", "c_name", "c_mktsegment")
    pages = c.select(
        F.col("c_custkey").cast("string").alias("page_id"), F.col("c_mktsegment").alias("source_id"), F.concat(F.lit("https://example.com/"), F.col("c_custkey").cast("string")).alias("normalized_final_url"), F.col("c_name").alias("title"),
        F.lit("main").alias("extraction_method"), text.alias("content"), F.sha2(text, 256).alias("content_identity"), F.sha2(text, 256).alias("content_sha256"), F.sha2(text, 256).alias("body_sha256"), F.lit("b").alias("body_file"),
    )
    sources = c.select(F.col("c_mktsegment").alias("source_id")).distinct().withColumn("allowed_origins", F.array(F.lit("https://example.com"), F.lit("https://a.example")))
    passages = s.select(F.concat(F.lit("q"), F.col("s_suppkey").cast("string")).alias("passage_id"), F.col("s_suppkey").cast("string").alias("page_id"), F.lit("BUILDING").alias("source_id"), (F.col("s_suppkey") % 3).cast("int").alias("ordinal"), F.array(F.lit("a"), F.lit("b")).alias("heading_path"), F.col("s_name").alias("content"))
    aliases = n.select(F.concat(F.lit("a"), F.col("n_nationkey").cast("string")).alias("alias_page_id"), F.lit("BUILDING").alias("source_id"), F.concat(F.lit("https://a.example/"), "n_name").alias("alias_url"), F.lit("1").alias("representative_page_id"), F.lit("exact-alias").alias("alias_kind"))
    return {"pages": pages, "sources": sources, "passages": passages, "aliases": aliases}


def _published(spark: SparkSession, sf: str) -> tuple[str, dict, DataFrame]:
    folder = f"{scratch_path(spark, 'batch')}/b1"
    t = _snapshot_tables(spark, sf)
    near = d.table(spark, sf, "nation").groupBy(F.lit("s1").alias("snapshot_id"), F.col("n_regionkey").cast("string").alias("origin")).agg(F.count("*").alias("page_count"), F.lit(0).cast("long").alias("near_duplicate_page_count"))
    batches.export_snapshot(spark, folder, {"batch_id": "b1", "snapshot_id": "s1"}, t["pages"], t["passages"], t["aliases"], t["sources"], near)
    (found,) = batches.published_batches(spark, folder.rsplit("/", 1)[0])
    return folder, *batches.validate_batch(spark, found)


KEYS = {
    "bronze_snapshot_records": ["batch_id", "record_type", "record_id"], "silver_sources": ["snapshot_id", "source_id"], "silver_pages": ["snapshot_id", "page_id"], "silver_passages": ["snapshot_id", "passage_id"],
    "silver_page_aliases": ["snapshot_id", "alias_page_id"], "silver_snapshots": ["snapshot_id"],
}


@query("""
WITH n AS (SELECT (SELECT count(*) FROM customer) AS c, (SELECT count(*) FROM supplier) AS s, (SELECT count(*) FROM nation) AS n, (SELECT count(DISTINCT c_mktsegment) FROM customer) AS g)
SELECT 'bronze_snapshot_records' AS table_name, c + s + n + g AS row_count, c + s + n + g AS inserted, 0 AS again, 0 AS version FROM n
UNION ALL SELECT 'silver_sources', g, g, 0, 0 FROM n UNION ALL SELECT 'silver_pages', c, c, 0, 0 FROM n UNION ALL SELECT 'silver_passages', s, s, 0, 0 FROM n
UNION ALL SELECT 'silver_page_aliases', n, n, 0, 0 FROM n UNION ALL SELECT 'silver_snapshots', 0, 0, 0, -1 FROM n""")
def batch_load(spark: SparkSession, sf: str) -> DataFrame:
    """A published batch, validated, shaped and loaded twice: the second load inserts nothing."""
    _, _, rows = _published(spark, sf)
    shaped, root = batches.shape_snapshot(rows), scratch_path(spark, "lake")
    tables = {name: Table(spark, root, name, df.schema, KEYS[name]) for name, df in shaped.items()}
    first, second = batches.load_snapshot(tables, shaped, {"load_id": "1"}), batches.load_snapshot(tables, shaped, {"load_id": "2"})
    return spark.createDataFrame([(n, tables[n].read().count(), first.inserted[n], second.inserted[n], tables[n].version()) for n in tables], "table_name string, row_count bigint, inserted bigint, again bigint, version int")


@query("""
SELECT c_custkey::VARCHAR AS page_id, c_mktsegment AS source_id, 'https://example.com/' || c_custkey::VARCHAR AS url, c_name AS title, NULL::VARCHAR AS language, sha256(c_name || ' ' || c_mktsegment) AS content_sha256, length(c_name || ' ' || c_mktsegment) AS content_chars FROM customer""")
def batch_pages(spark: SparkSession, sf: str) -> DataFrame:
    return batches.shape_snapshot(_published(spark, sf)[2])["silver_pages"].drop("snapshot_id")


@query("SELECT 'q' || s_suppkey::VARCHAR AS passage_id, s_suppkey::VARCHAR AS page_id, s_suppkey % 3 AS ordinal, 'a > b' AS heading_path, s_name AS content FROM supplier")
def batch_passages(spark: SparkSession, sf: str) -> DataFrame:
    return batches.shape_snapshot(_published(spark, sf)[2])["silver_passages"].select("passage_id", "page_id", "ordinal", "heading_path", "content")


@query("SELECT n_regionkey::VARCHAR AS origin, count(*) AS page_count FROM nation GROUP BY 1")
def near_sidecar(spark: SparkSession, sf: str) -> DataFrame:
    return batches.near_sidecar(spark, _published(spark, sf)[0]).select("origin", "page_count")


@query("""
WITH p AS (SELECT DISTINCT c_mktsegment AS s FROM customer), k AS (SELECT count(*) AS c FROM customer)
SELECT * FROM (VALUES ('not_null.required_columns', 0), ('unique.keys', 0), ('schema.drift', 0), ('counts.match_snapshot', 1), ('referential.aliases', 0)) v(rule, failing) WHERE rule <> 'referential.aliases'
UNION ALL SELECT 'referential.pages', (SELECT count(*) FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer)) UNION ALL SELECT 'referential.pages', 0 UNION ALL SELECT 'referential.pages', 0 UNION ALL SELECT 'immutable.snapshot', 1""")
def dq_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """The input rules of a snapshot batch whose manifest counts one page too many and whose alias count was another before."""
    _, _, rows = _published(spark, sf)
    shaped = batches.shape_snapshot(rows)
    n = {r["record_type"]: r["count"] for r in rows.groupBy("record_type").count().collect()}  # a row per record type
    said = "snapshot_id string, batch_id string, status string, created_at_utc string, page_count bigint, alias_count bigint, passage_count bigint"
    shaped["silver_snapshots"] = spark.createDataFrame([("s1", "b1", "complete", "2024-01-01T00:00:00Z", n["page"] + 1, n["page_alias"], n["passage"])], said)
    before = spark.createDataFrame([("s1", "b0", "complete", "2024-01-01T00:00:00Z", n["page"] + 1, 0, n["passage"])], said)
    return spark.createDataFrame([(r.rule, r.failing) for r in quality.check_snapshot(shaped, rows, {"silver_snapshots": before})], "rule string, failing bigint")


# ------------------------------------------------------------ event lines and plugins
_LINES = "WITH n AS (SELECT count(*) + count(*) FILTER (event_id % 7 = 0) + count(*) FILTER (event_id % 51 = 0) AS n FROM events)"


@query(f"{_LINES} SELECT reader, n AS lines, n AS refs, n AS last_line FROM n CROSS JOIN (VALUES ('text_lines'), ('event_lines')) v(reader)")
def event_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Event lines by two readers: each line has a reference of its own."""
    path = f"{scratch_path(spark, 'lines')}"
    d.durable_events(spark, sf).select("record_json").coalesce(1).write.text(path)
    plugins.register(spark)
    both = plugins.JsonLines(path).records(spark).withColumn("reader", F.lit("text_lines"))
    both = both.unionByName(spark.read.format("event_lines").load(path).withColumn("reader", F.lit("event_lines")))
    number = F.element_at(F.split("ref", ":"), -1).cast("int")
    return both.groupBy("reader").agg(F.count("*").alias("lines"), F.countDistinct("ref").alias("refs"), F.max(number).alias("last_line"))


@query(f"{_LINES}, e AS (SELECT 'run-' || (user_id % 5)::VARCHAR AS crawl_run_id, event_id, user_id FROM events) SELECT crawl_run_id, count(DISTINCT event_id) AS events, count(DISTINCT 's' || (user_id % 10)::VARCHAR) AS sources FROM e GROUP BY 1")
def typed_event_lines(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "lines")
    d.durable_events(spark, sf).select("record_json").write.text(path)
    return batches.event_records(batches.text_lines(spark, path)).groupBy("crawl_run_id").agg(F.countDistinct("event_id").alias("events"), F.countDistinct("source_id").alias("sources"))


# ------------------------------------------------------------ a partitioned log
MURMUR = """
hx AS (SELECT event_id, k, hex(encode(k)) AS x, octet_length(encode(k)) AS n FROM (SELECT event_id, 'user-' || user_id::VARCHAR AS k FROM events)),
wd AS (SELECT *, list_transform(range(0, n // 4), lambda i: ('0x' || x[8*i+7:8*i+8] || x[8*i+5:8*i+6] || x[8*i+3:8*i+4] || x[8*i+1:8*i+2])::UHUGEINT) AS ws,
  CASE n % 4 WHEN 3 THEN ('0x' || x[2*n-1:2*n] || x[2*n-3:2*n-2] || x[2*n-5:2*n-4])::UHUGEINT WHEN 2 THEN ('0x' || x[2*n-1:2*n] || x[2*n-3:2*n-2])::UHUGEINT WHEN 1 THEN ('0x' || x[2*n-1:2*n])::UHUGEINT END AS tl FROM hx),
m1 AS (SELECT *, list_transform(list_transform(ws, lambda w: w * 1540483477 % 4294967296), lambda w: xor(w, w >> 24) * 1540483477 % 4294967296) AS ks FROM wd),
m2 AS (SELECT *, list_reduce(ks, lambda h, w: xor(h * 1540483477 % 4294967296, w), xor(2538058380::UHUGEINT, n::UHUGEINT)) AS h FROM m1),
m3 AS (SELECT *, CASE WHEN tl IS NULL THEN h ELSE xor(h, tl) * 1540483477 % 4294967296 END AS h2 FROM m2),
m4 AS (SELECT *, xor(h2, h2 >> 13) * 1540483477 % 4294967296 AS h3 FROM m3),
mm AS (SELECT event_id, k, xor(h3, h3 >> 15)::BIGINT AS murmur FROM m4),
lg AS (SELECT *, ((murmur & 2147483647) % 12)::INT AS p FROM mm),
lo AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY event_id % 2, event_id) - 1 AS o FROM lg)"""


def _log(spark: SparkSession, sf: str) -> Log:
    e = d.table(spark, sf, "events").select("event_id", F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("key"), F.col("event_id").cast("string").alias("value"))
    log = Log(spark, scratch_path(spark, "log"), "events", 12)
    for part in (0, 1):
        log.produce(e.where(F.col("event_id") % 2 == part), ["event_id"], f"2024-01-0{part + 1}")
    return log


@query(f"WITH {MURMUR} SELECT DISTINCT k AS key, murmur, p AS partition FROM lg")
def murmur_partitions(spark: SparkSession, sf: str) -> DataFrame:
    e = d.table(spark, sf, "events").select(F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("key")).distinct()
    return e.select("key", canonical.murmur2("key").alias("murmur"), canonical.key_partition("key", 12).alias("partition"))


@query(f"WITH {MURMUR} SELECT p AS partition, o AS offset, k AS key, event_id::VARCHAR AS value FROM lo WHERE o >= p * 10 AND p <> 3")
def log_fetch(spark: SparkSession, sf: str) -> DataFrame:
    offsets = spark.range(12).where("id <> 3").select(F.col("id").cast("int").alias("partition"), (F.col("id") * 10).alias("next_offset"))
    return _log(spark, sf).fetch(offsets).select("partition", "offset", "key", "value")


@query(f"WITH {MURMUR}, w AS (SELECT p, count(*) AS n FROM lo GROUP BY 1) SELECT 'c' AS consumer, sum(greatest(0, n - CASE WHEN p < 6 THEN p * 10 ELSE 0 END))::BIGINT AS lag, max(greatest(0, n - CASE WHEN p < 6 THEN p * 10 ELSE 0 END)) AS largest_lag FROM w")
def log_lag(spark: SparkSession, sf: str) -> DataFrame:
    offsets = spark.range(6).select(F.col("id").cast("int").alias("partition"), (F.col("id") * 10).alias("next_offset"))
    return streaming.consumer_lag(_log(spark, sf).lag(offsets, "c"))


# ------------------------------------------------------------ the lake
def _regions(spark: SparkSession, sf: str, root: str) -> Table:
    r = d.table(spark, sf, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"))
    t = Table(spark, root, "regions", "k int, name string", ["k"])
    for i in (1, 2):
        t.merge_insert(r.where(f"k < {2 * i}"), {"load_id": f"load-{i}", "snapshot_id": f"snap-{i}", "run_id": f"run-{i}"})
    return t


@query("SELECT * FROM (VALUES ('regions', 0, 'run-1', 'snap-1', 'snap-1'), ('regions', 1, 'run-2', 'snap-2', 'snap-2'), ('gold', 0, NULL, NULL, 'regions=1')) v(table_name, table_version, run_id, snapshot_id, built_from)")
def lineage_report_rows(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch_path(spark, "lake")
    t = _regions(spark, sf, root)
    gold = Table(spark, root, "gold", "n bigint", ["n"])
    refresh_gold([t], {gold: t.read().groupBy().count().select(F.col("count").alias("n"))})
    log = Table(spark, root, "lineage_loads", "table_name string, table_version bigint, row_count bigint, load_id string, run_id string, snapshot_id string, batch_id string, input_kind string, input_ref string, silver_versions string", ["table_name", "table_version"])
    lineage([t, gold], log)
    return lineage_report(log.read())


@query("SELECT true AS first_refresh, false AS second_refresh, true AS third_refresh, count(*) AS n, 1 AS version FROM region WHERE r_regionkey <= 4")
def gold_refresh(spark: SparkSession, sf: str) -> DataFrame:
    """Gold is rebuilt only when a Silver version has moved."""
    root = scratch_path(spark, "lake")
    t, gold = _regions(spark, sf, root), Table(spark, root, "gold", "n bigint", ["n"])
    count = lambda: {gold: t.read().groupBy().count().select(F.col("count").alias("n"))}
    said = [refresh_gold([t], count()), refresh_gold([t], count())]
    t.merge_insert(spark.createDataFrame([(4, "late")], "k int, name string"))
    said.append(refresh_gold([t], count()))
    return gold.read().select(*[F.lit(x).alias(f"{n}_refresh") for n, x in zip(("first", "second", "third"), said)], "n", F.lit(gold.version()).alias("version"))


@query("""WITH s AS (SELECT 'b' || (event_id // 1000)::VARCHAR AS batch_id, count(*) FILTER (event_type = 'click') AS n, bool_or(event_type = 'purchase' AND event_id % 1000 < 40) AS done FROM events GROUP BY 1)
SELECT batch_id, CASE WHEN done THEN 'complete' ELSE 'processing' END AS status, n + 1 AS attempts, n AS retries FROM s""")
def batch_attempts(spark: SparkSession, sf: str) -> DataFrame:
    e = d.table(spark, sf, "events").withColumn("batch_id", F.concat(F.lit("b"), F.floor(F.col("event_id") / 1000).cast("string")))
    log = e.select("batch_id", F.lit("processing").alias("status"), F.lit(1).cast("long").alias("attempts"), F.lit(0).cast("long").alias("retries")).distinct()
    return batch_status(log, e.where("event_type = 'click'").select("batch_id"), e.where("event_type = 'purchase' AND event_id % 1000 < 40").select("batch_id"))


@query("SELECT o_orderpriority AS k, 'fixed' AS v, min(strftime(o_orderdate, '%Y-%m-%d')) AS at, min('b' || year(o_orderdate)::VARCHAR) AS batch FROM orders GROUP BY 1")
def history_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Observations merged newest first: the earliest time and batch of each key win all the same."""
    o = d.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("k"), F.lit("fixed").alias("v"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("at"), F.concat(F.lit("b"), F.year("o_orderdate").cast("string")).alias("batch"))
    t = Table(spark, scratch_path(spark, "lake"), "h", "k string, v string, at string, batch string", ["k"])
    for rows in (o.where("at >= '1996'"), o.where("at < '1996'"), o):
        t.merge_history(rows, ["v"], "at", "batch")
    return t.read()


@query("SELECT n_nationkey AS k, n_name AS name, 2 AS version, 'silver_nations: changed rows for known keys' AS refused FROM nation")
def append_only_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Overwritten, then appended to; a changed row for a known key is refused."""
    n = d.table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    t = Table(spark, scratch_path(spark, "lake"), "silver_nations", "k int, name string", ["k"])
    t.merge_insert(n.limit(3))
    t.overwrite(n.where("k < 5"))
    t.merge_append_only(n, ["name"])
    try:
        t.merge_append_only(n.withColumn("name", F.lit("other")), ["name"])
        said = ""
    except ValueError as e:
        said = str(e).split(": [")[0]
    return t.read().select("k", "name", F.lit(t.version()).alias("version"), F.lit(said).alias("refused"))


@query("SELECT 'g2' AS current, 'g3' AS pruned, true AS published, 1 AS folders, count(*) AS rows FROM region")
def generations(spark: SparkSession, sf: str) -> DataFrame:
    """Folders staged and published in one rename, generations activated and pruned, a table compacted."""
    root = scratch_path(spark, "generations")
    r = d.table(spark, sf, "region").select("r_regionkey")
    for g in ("g1", "g2", "g3"):
        r.write.parquet(f"{root}/_staged/{g}")
        publish_folder(spark, f"{root}/_staged/{g}", f"{root}/{g}")
    Files(spark, root).delete(f"{root}/_staged")
    g = Generations(spark, root)
    g.activate("g1")
    g.activate("g2")
    pruned = g.prune()
    t = Table(spark, scratch_path(spark, "lake"), "r", "r_regionkey int", ["r_regionkey"])
    for k in range(5):
        t.merge_insert(r.where(f"r_regionkey = {k}"))
    t.compact(2)
    return spark.createDataFrame([(g.current(), ",".join(pruned), len(t.live()), t.read().count())], "current string, pruned string, folders int, rows bigint").withColumn("published", F.lit("g1" in Files(spark, root).names(root)))


@query("""WITH l AS (SELECT (row_number() OVER (ORDER BY c_mktsegment, c_custkey) - 1) // 400 AS part, row_number() OVER (ORDER BY c_mktsegment, c_custkey) AS n, '{"c_mktsegment":"' || c_mktsegment || '","c_custkey":' || c_custkey::VARCHAR || ',"c_name":"' || c_name || '"}' AS v FROM customer),
p AS (SELECT part, sha256(string_agg(v, chr(10) ORDER BY n)) AS s FROM l GROUP BY 1) SELECT sha256(string_agg(s, '' ORDER BY part)) AS digest, (SELECT count(*) FROM customer) AS lines FROM p""")
def digested_lines(spark: SparkSession, sf: str) -> DataFrame:
    c, folder = d.table(spark, sf, "customer").select("c_mktsegment", "c_custkey", "c_name"), scratch_path(spark, "digested")
    digest = batches.write_digested(c, folder, ["c_mktsegment", "c_custkey"], 400)
    return spark.read.text(folder).agg(F.count("*").alias("lines")).withColumn("digest", F.lit(digest))


@query("""SELECT 'snapshot-' || sha256('cfg' || chr(0) || '[' || (SELECT string_agg('{"p":' || c_custkey::VARCHAR || '}', ',' ORDER BY c_mktsegment, c_name) FROM customer) || ']' || chr(0) || '[' || (SELECT string_agg('{"q":' || s_suppkey::VARCHAR || '}', ',' ORDER BY s_nationkey::VARCHAR, s_name, s_suppkey) FROM supplier) || ']') AS snapshot_id""")
def snapshot_identity(spark: SparkSession, sf: str) -> DataFrame:
    pages = d.table(spark, sf, "customer").select(F.col("c_mktsegment").alias("source_id"), F.col("c_name").alias("url"), F.to_json(F.struct(F.col("c_custkey").alias("p"))).alias("payload_json"))
    passages = d.table(spark, sf, "supplier").select(F.col("s_nationkey").cast("string").alias("source_id"), F.col("s_name").alias("url"), F.col("s_suppkey").alias("ordinal"), F.to_json(F.struct(F.col("s_suppkey").alias("q"))).alias("payload_json"))
    return spark.createDataFrame([(batches.snapshot_identity("cfg", pages, passages),)], "snapshot_id string")


# ------------------------------------------------------------ hashes
def _source(nation, key):
    s = lambda *x: F.array_sort(F.array(*x)) if False else F.array(*x)
    return F.struct(
        F.concat(F.lit("s"), key.cast("string")).alias("source_id"), s(F.lit("z/"), F.concat(F.lit("a"), nation.cast("string"))).alias("seeds"), F.when(key % 2 == 0, s(F.lit("u\"q"), F.lit("é"))).alias("allowed_urls"), s(F.lit("https://b"), F.lit("https://a")).alias("allowed_origins"),
        s(F.lit("/")).alias("path_prefixes"), F.array().cast("array<string>").alias("deny_path_prefixes"), F.when(key % 3 == 0, s(F.concat(F.lit("p"), key.cast("string")), F.lit("b"))).alias("sitemap_url_prefixes"),
    )


_SCOPE = """WITH c AS (SELECT c_custkey AS k, '{"allowed_origins":["https://a","https://b"],"allowed_urls":' || CASE WHEN c_custkey % 2 = 0 THEN '["u\\"q","é"]' ELSE 'null' END || ',"deny_path_prefixes":[],"path_prefixes":["/"],"seeds":["a' || c_nationkey::VARCHAR || '","z/"],"sitemap_url_prefixes":' ||
CASE WHEN c_custkey % 3 = 0 THEN '["b","p' || c_custkey::VARCHAR || '"]' ELSE '[]' END || ',"source_id":"s' || c_custkey::VARCHAR || '"}' AS j FROM customer)"""


@query(f"{_SCOPE} SELECT k, sha256(j) AS scope, sha256(j) AS by_sql FROM c")
def scope_hash(spark: SparkSession, sf: str) -> DataFrame:
    c = d.table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), _source(F.col("c_nationkey"), F.col("c_custkey")).alias("source"))
    canonical.register(spark)
    names = sorted((*canonical.SCOPE_FIELDS,))
    arg = F.struct(F.col("source.source_id"), *[F.col(f"source.{n}") for n in names])
    return c.withColumn("arg", arg).selectExpr("k", "source", "scope_sha256(arg) AS by_sql").select("k", canonical.scope_sha256("source").alias("scope"), "by_sql")


@query("""SELECT c_custkey AS k, sha256('{"extraction_schema":' || CASE WHEN c_custkey % 2 = 0 THEN '"v2"' ELSE 'null' END || ',"max_decoded_body_bytes":5242880,"max_extraction_bytes":null,"max_extraction_millis":' || c_nationkey::VARCHAR || ',"min_content_chars":200}') AS contract FROM customer""")
def contract_hash(spark: SparkSession, sf: str) -> DataFrame:
    policy = F.struct(F.lit(200).alias("min_content_chars"), F.lit(5_242_880).alias("max_decoded_body_bytes"), F.lit(None).cast("int").alias("max_extraction_bytes"), F.col("c_nationkey").alias("max_extraction_millis"), F.when(F.col("c_custkey") % 2 == 0, "v2").alias("extraction_schema"))
    return d.table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), canonical.contract_sha256(policy).alias("contract"))


# ------------------------------------------------------------ derived history, and SQL over views
@query("""WITH e AS (SELECT event_id, user_id % 5 AS r, user_id, event_id % 2 = 0 AS cap FROM events)
SELECT event_id::VARCHAR AS event_id, 'run-' || r::VARCHAR AS crawl_run_id, k AS artifact_kind, 'f://' || event_id::VARCHAR || '/' || k AS artifact_uri, sha256(k) AS sha256, user_id AS byte_size
FROM e JOIN (VALUES ('body', true), ('snapshot_manifest', false), ('crawl_manifest', false)) v(k, c) ON e.cap = c""")
def event_artifacts(spark: SparkSession, sf: str) -> DataFrame:
    e = d.table(spark, sf, "events")
    file = lambda k: F.struct(F.concat(F.lit("f://"), F.col("event_id").cast("string"), F.lit(f"/{k}")).alias("uri"), F.sha2(F.lit(k), 256).alias("sha256"), F.col("user_id").alias("byte_size"))
    cap = F.col("event_id") % 2 == 0
    doc = F.when(cap, F.to_json(F.struct(F.struct(file("body").alias("body_artifact")).alias("data")))).otherwise(F.to_json(F.struct(F.struct(file("snapshot_manifest").alias("snapshot_manifest"), file("crawl_manifest").alias("crawl_manifest")).alias("data"))))
    rows = e.select(F.col("event_id").cast("string").alias("event_id"), F.concat(F.lit("run-"), (F.col("user_id") % 5).cast("string")).alias("crawl_run_id"), F.when(cap, "capture_committed").otherwise("corpus_snapshot_published").alias("event_type"), doc.alias("record_json"))
    return views.event_artifacts(rows.unionByName(rows.where("event_id % 3 = 0")))


def _history_rows(spark: SparkSession, sf: str) -> DataFrame:
    e = d.table(spark, sf, "events")
    rows = e.select(F.col("event_id").cast("string").alias("event_id"), F.concat(F.lit("run-"), (F.col("user_id") % 5).cast("string")).alias("crawl_run_id"), "event_type", F.lit(1).alias("schema_version"), F.concat(F.lit("k"), F.col("event_id").cast("string")).alias("dedupe_key"), F.sha2(F.col("event_id").cast("string"), 256).alias("payload_sha256"), F.timestamp_seconds(F.col("event_id") * 10).alias("created_at"))
    late = rows.where("event_id % 4 = 0").withColumns({"created_at": F.col("created_at") + F.expr("INTERVAL '1' DAY"), "payload_sha256": F.lit("late")})
    return rows.unionByName(late)


@query("""WITH h AS (SELECT 'run-' || (user_id % 5)::VARCHAR AS crawl_run_id, sha256('[' || event_id::VARCHAR || ', ' || event_type || ', 1, k' || event_id::VARCHAR || ', ' || sha256(event_id::VARCHAR) || ', ' || strftime(make_timestamp(event_id * 10000000), '%Y-%m-%dT%H:%M:%S.%fZ') || ']') AS s FROM events),
u AS (SELECT crawl_run_id, [('0x' || s[16 * i + 1 : 16 * i + 16])::UBIGINT FOR i IN range(4)] AS u FROM h), x AS (SELECT crawl_run_id, count(*) AS event_count, bit_xor(u[1]) AS a, bit_xor(u[2]) AS b, bit_xor(u[3]) AS c, bit_xor(u[4]) AS d FROM u GROUP BY 1)
SELECT crawl_run_id, event_count, """ + ", ".join(f"(CASE WHEN {c} >= 9223372036854775808::UBIGINT THEN {c}::HUGEINT - 18446744073709551616::HUGEINT ELSE {c}::HUGEINT END)::BIGINT AS coverage_{i}" for i, c in enumerate("abcd")) + " FROM x")
def event_history_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """The first version of each event, and each run's count and fingerprint by the SQL function."""
    canonical.register(spark)
    h = views.event_history(_history_rows(spark, sf)).withColumn("created_at", F.to_timestamp("created_at"))
    h = h.selectExpr("crawl_run_id", "history_fingerprint(event_id, event_type, schema_version, dedupe_key, payload_sha256, created_at) AS f")
    return h.groupBy("crawl_run_id").agg(F.count("*").alias("event_count"), *[F.bit_xor(F.col("f")[i]).alias(f"coverage_{i}") for i in range(4)])


@query("""SELECT o_custkey % 30 AS crawl_run_id, arg_min(o_orderpriority, o_orderkey) AS config_digest, min(o_orderkey) AS created_at, min(CASE WHEN o_orderstatus = 'P' THEN o_orderkey END) AS deleted_at FROM orders GROUP BY 1""")
def run_history(spark: SparkSession, sf: str) -> DataFrame:
    o = d.table(spark, sf, "orders").select((F.col("o_custkey") % 30).alias("crawl_run_id"), F.col("o_orderpriority").alias("config_digest"), F.col("o_orderkey").alias("at"), "o_orderstatus")
    return views.run_history(o, o.where("o_orderstatus = 'P'"))


_FREE = "SELECT n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name HAVING count(*) > 1"


@query(_FREE.replace("sum(c_acctbal)", "sum(c_acctbal::DOUBLE)"))
def sql_over_views(spark: SparkSession, sf: str) -> DataFrame:
    """Free SQL, from a file, over every table of the folder."""
    views.register_folder(spark, sf)
    path = f"{scratch_path(spark, 'sql')}/query.sql"
    Files(spark, path).write(path, (_FREE.replace("sum(c_acctbal)", "sum(double(c_acctbal))") + ";\n").encode())
    return views.run_sql(spark, file=path)


@query("""SELECT 'customer' AS table, false AS equal, (SELECT count(*) FROM customer WHERE c_custkey % 10 = 0) AS differing_rows UNION ALL SELECT 'nation', true, 0 UNION ALL SELECT 'region', false, NULL UNION ALL SELECT 'supplier', true, 0""")
def replay_tables(spark: SparkSession, sf: str) -> DataFrame:
    t = {n: d.table(spark, sf, n) for n in ("customer", "nation", "region", "supplier")}
    again = {"customer": t["customer"].where("c_custkey % 10 <> 0"), "nation": t["nation"].unionAll(t["nation"].limit(0)), "supplier": t["supplier"].withColumn("s_name", F.lit("x"))}
    out = reconcile.replay_verdicts(t, again, {"supplier": ("s_name",)})
    return spark.createDataFrame([(r["table"], r["equal"], r["differing_rows"]) for r in out], "table string, equal boolean, differing_rows bigint")


@query("SELECT user_id % 25 AS g FROM events GROUP BY 1 HAVING bool_or(event_id % 300 = 7)")
def fingerprint_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Groups whose live rows are no longer those that were recorded."""
    e = d.table(spark, sf, "events").withColumn("g", F.col("user_id") % 25)
    live, recorded = (reconcile.fingerprints(x, ["g"], ["event_id", "event_type"]) for x in (e.withColumn("event_type", F.when(F.col("event_id") % 300 == 7, "changed").otherwise(F.col("event_type"))), e))
    return reconcile.fingerprint_check(live, recorded, ["g"]).select("g")
