"""The driver's tables as the engine's inputs: each function builds one input table from ``sf_dir``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as pages, market segments as sources, quarters of order dates as snapshots; a page's content is its largest priority and status."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", F.concat("o_orderpriority", "o_orderstatus").alias("content"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    q = F.concat_ws("-q", F.year("o_orderdate"), F.quarter("o_orderdate"))
    at = F.concat(F.date_format(F.date_trunc("QUARTER", "o_orderdate"), "yyyy-MM-dd"), F.lit("T00:00:00Z"))
    g = j.groupBy(q.alias("snapshot_id"), at.alias("observed_at"), F.col("c_mktsegment").alias("source_id"), F.col("o_custkey").alias("page_id"), F.col("c_nationkey").alias("nation")).agg(F.max("content").alias("content"))
    return g.select(
        "snapshot_id", "observed_at", "source_id", "page_id", F.concat(F.lit("https://example.com/"), F.col("page_id").cast("string")).alias("url"), F.concat(F.lit("origin-"), F.col("nation").cast("string")).alias("origin"),
        F.sha2("content", 256).alias("content_sha256"), F.concat(F.lit("scope-"), (F.substring("snapshot_id", 1, 4).cast("int") % 2).cast("string")).alias("scope"), F.lit("contract-1").alias("contract"),
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source observations: a fourth quarter is a bounded crawl, a second quarter of every third year had a failure."""
    quarter, year = F.substring("snapshot_id", 7, 1), F.substring("snapshot_id", 1, 4).cast("int")
    g = observations(spark, sf_dir).groupBy("snapshot_id", "observed_at", "source_id", "scope", "contract").agg(F.count("*").alias("page_count"), F.min("page_id").alias("low"), F.max("page_id").alias("high"))
    listed = F.when(F.col("source_id") < "C", F.transform(F.sequence(F.col("low"), F.col("high"), F.lit(7)), lambda x: F.concat(F.lit("https://example.com/"), x.cast("string"))))
    return g.select(
        "snapshot_id", "observed_at", "source_id", "scope", "contract", "page_count", F.when(quarter == "4", "page_target_reached").otherwise("frontier_exhausted").alias("stop_reason"),
        F.when((quarter == "2") & (year % 3 == 0), 1).otherwise(0).cast("long").alias("failed_count"), F.lit(0).cast("long").alias("rejected_count"), listed.alias("allowed_urls"),
    )


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Third quarters assert full coverage (without a denominator from sources after M); every page with an id divisible by 97 has a tombstone in every snapshot of 1996."""
    s = sources(spark, sf_dir).where("substring(snapshot_id, 7, 1) = '3'")
    cover = s.select(
        "snapshot_id", "source_id", F.lit("").alias("page_id"), F.lit("coverage").alias("kind"), "scope", F.lit(True).alias("complete"), F.when(F.col("source_id") < "M", F.col("page_count")).alias("expected_page_count"), F.col("observed_at").alias("evidence_at")
    )
    pages = observations(spark, sf_dir).where("page_id % 97 = 0").select("source_id", "page_id").distinct()
    tombs = sources(spark, sf_dir).where("substring(snapshot_id, 1, 4) = '1996'").join(pages, "source_id").select(
        "snapshot_id", "source_id", F.col("page_id").cast("string").alias("page_id"), F.lit("tombstone").alias("kind"), "scope", F.lit(None).cast("boolean").alias("complete"), F.lit(None).cast("long").alias("expected_page_count"), F.col("observed_at").alias("evidence_at")
    )
    return cover.unionByName(tombs)


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a snapshot and source whose content another, smaller page there has."""
    o = observations(spark, sf_dir)
    rep = o.groupBy("snapshot_id", "source_id", "content_sha256").agg(F.min("page_id").alias("representative_page_id"))
    return o.join(rep, ["snapshot_id", "source_id", "content_sha256"]).where("page_id > representative_page_id").select(
        "snapshot_id", "source_id", F.col("page_id").alias("alias_page_id"), "representative_page_id", F.col("url").alias("alias_url"), "observed_at", "origin"
    )


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as an operational log: days are snapshots, users' last digits are sources; every tenth record is replayed by a second batch."""
    e = table(spark, sf_dir, "events")
    name = F.when(F.col("event_type") == "error", "fetch.failed").when(F.col("event_type") == "click", "task.claimed").when(F.col("event_type") == "purchase", "capture.accepted").when(F.col("event_type") == "signup", "page.rejected").otherwise("page.viewed")
    data = F.to_json(F.struct(
        name.alias("event"), F.when(F.col("event_type") == "error", "failure").otherwise("success").alias("outcome"), F.lit("worker").alias("component"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.lit("run-1").alias("run_id"),
        F.struct(F.col("user_id").alias("task_id"), (F.col("event_id") % 3 + 1).alias("task_attempt"), F.concat(F.lit("s"), (F.col("user_id") % 10).cast("string")).alias("source_id")).alias("data"),
    ))
    rows = e.select(F.date_format("ts", "yyyy-MM-dd").alias("snapshot_id"), F.lit("b1").alias("batch_id"), F.col("event_id").cast("string").alias("record_id"), F.lit(None).cast("string").alias("source_id"), data.alias("record_json"), "event_id")
    return rows.unionByName(rows.where("event_id % 10 = 0").withColumn("batch_id", F.lit("b2"))).drop("event_id")


def durable_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as delivered lines: each once, every seventh again, every fifty-first again with another payload, every hundred-and-first broken."""
    e = table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"), "user_id", "value")

    def line(payload, order: int):
        j = F.concat(
            F.lit('{"event_type":"capture_committed","data":{"event_id":"e'), F.col("event_id").cast("string"), F.lit('","schema_version":1,"crawl_run_id":"run-'), (F.col("user_id") % 5).cast("string"),
            F.lit('","source_id":"s'), (F.col("user_id") % 10).cast("string"), F.lit('","task_id":'), F.when(F.col("event_id") % 101 == 0, F.lit("true")).otherwise(F.col("event_id").cast("string")), F.lit(',"committed_at_utc":"'), F.col("at"),
            F.lit('","result_sha256":"'), payload, F.lit('","content_sha256":"c","body_artifact":{}}}'),
        )
        return [(F.col("event_id") * 10 + order).alias("line"), j.alias("record_json")]

    first = e.select(*line(F.lit("a"), 0))
    again = e.where("event_id % 7 = 0").select(*line(F.lit("a"), 1))
    other = e.where("event_id % 51 = 0").select(*line(F.lit("b"), 2))
    return first.unionByName(again).unionByName(other)


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as captures: suppliers' thirds are sources, parts are URLs, quantities are content."""
    li = table(spark, sf_dir, "lineitem")
    row = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    url = F.concat(F.lit("https://example.com/p/"), F.col("l_partkey").cast("string"))
    c = li.select(
        row.alias("row_id"), F.concat(F.lit("s"), (F.col("l_suppkey") % 3).cast("string")).alias("source_id"), F.when(F.col("l_linenumber") == 1, F.concat(url, F.lit("?r"))).otherwise(url).alias("requested_url"), url.alias("final_url"),
        F.sha2(F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("/"), (F.col("l_partkey") % 20).cast("string")), 256).alias("content_sha256"),
    )
    return c.withColumn("selection_key", F.sha2(F.concat_ws("|", "content_sha256", "requested_url", F.col("row_id").cast("string")), 256))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as passages of pages (ten documents a page), the first sixty characters as title."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("passage_id"), F.floor(F.col("doc_id") / 10).cast("long").alias("page_id"), F.col("source").alias("source_id"), F.substring("text", 1, 60).alias("title"), F.lit("").alias("heading"), F.col("text").alias("body")
    )


def keyword_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries from the benchmark: two words, and a quoted phrase of three, of each item."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.split(F.regexp_replace(F.lower("text"), "[^a-z]+", " "), " ").alias("w"))
    two = b.select((F.col("item_id") * 2).alias("query_id"), F.array_join(F.slice("w", 2, 2), " ").alias("query"))
    phrase = b.select((F.col("item_id") * 2 + 1).alias("query_id"), F.concat(F.lit('"'), F.array_join(F.slice("w", 4, 3), " "), F.lit('"')).alias("query"))
    return two.unionByName(phrase)
