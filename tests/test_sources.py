"""Logs, data sources, streams, views and URLs, on small hand-made inputs."""

import hashlib
import io
import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from corpuslake import views
from corpuslake.functions import canonical, urls
from corpuslake.operators import frontier, search
from corpuslake.plans.catalogue import QUERIES
from corpuslake.plans.storage import KEYS  # noqa: F401
from corpuslake.session import numbered
from corpuslake.sources import batches, plugins
from corpuslake.sources.lake import Files, Table
from corpuslake.sources.log import Log
from corpuslake.streaming import reduce as streaming


def event(kind, i, run="r1"):
    data = {"event_id": f"e{i}", "schema_version": 1, "crawl_run_id": run}
    if kind == "capture_committed":
        data |= {"source_id": "s", "task_id": i, "committed_at_utc": "2024-01-01T00:00:00Z", "result_sha256": "a", "content_sha256": "c", "body_artifact": {}}
    elif kind == "crawl_completed":
        data |= {"completed_at_utc": "2024-01-01T00:00:00Z", "stop_reason": "x", "config_sha256": "c"}
    else:
        data |= {"snapshot_id": "s", "published_at_utc": "2024-01-01T00:00:00Z", "snapshot_manifest": {}, "crawl_manifest": {}, "page_count": 1, "alias_count": 0, "passage_count": 1}
    return json.dumps({"event_type": kind, "data": data})


def test_numbers_are_dense_and_ordered(spark):
    df = spark.range(1_000).select(((F.col("id") * 37) % 1_000).alias("k"))
    got = numbered(df, ["k"], "n").collect()
    assert sorted((r["k"], r["n"]) for r in got) == [(i, i + 1) for i in range(1_000)]
    assert numbered(df.limit(0), ["k"], "n").count() == 0


def test_murmur_of_known_keys(spark):
    # Values that every implementation of this hash gives for these keys.
    want = {"21": -973932308, "foobar": -790332482, "a-little-bit-long-string": -985981536, "a-little-bit-longer-string": -1486304829, "lkjh234lh9fiuh90y23oiuhsafujhadof229phr9h19h89h8": -58897971, "abc": 479470107, "": 275646681}
    got = spark.createDataFrame([(k,) for k in want], "k string").select("k", canonical.murmur2("k").alias("h")).collect()
    assert {r["k"]: r["h"] for r in got} == {k: v % 2**32 for k, v in want.items()}


def test_log_offsets_and_conflicts(spark, tmp_path):
    log = Log(spark, f"file://{tmp_path}", "t", 3)
    df = spark.createDataFrame([(f"k{i % 5}", str(i)) for i in range(20)], "key string, value string").withColumn("n", F.col("value").cast("int"))
    assert log.produce(df, ["n"], "now") == 0 and log.produce(df.limit(0), ["n"], "now") is None
    assert log.produce(df, ["n"], "later") == 1
    rows = log.table.read().collect()
    for p in {r["partition"] for r in rows}:
        own = sorted((r["offset"], int(r["value"]), r["produced_at"]) for r in rows if r["partition"] == p)
        assert [o for o, *_ in own] == list(range(len(own))) and [v for _, v, t in own if t == "now"] == sorted(v for _, v, t in own if t == "now")
    assert sum(r["high_watermark"] for r in log.high_watermarks().collect()) == 40
    with pytest.raises(Exception, match="no key"):
        log.produce(spark.createDataFrame([(None, "x", 1)], "key string, value string, n int"), ["n"], "now")
    with pytest.raises(ValueError):
        Log(spark, f"file://{tmp_path}", "t", 0)


def test_spool_and_lines_as_data_sources(spark, tmp_path):
    con = sqlite3.connect(tmp_path / "spool.sqlite3")
    for table, columns in plugins.SPOOL.items():
        con.execute(f"CREATE TABLE {table} ({columns.replace('bigint', 'INTEGER').replace('string', 'TEXT')})")
    con.executemany("INSERT INTO captures VALUES (?, 's', ?, 'h', 'k', '{}')", [(i, f"https://x/{i}") for i in range(1, 26)])
    con.execute("INSERT INTO sitemap_origins VALUES ('https://x', 7)")
    con.commit()
    con.close()
    plugins.register(spark)
    spool = lambda t: spark.read.format("capture_spool").option("table", t).option("rows", "10").load(f"file://{tmp_path}/spool.sqlite3")
    assert sorted(r["row_id"] for r in spool("captures").collect()) == list(range(1, 26)) and spool("captures").rdd.getNumPartitions() == 3
    assert [tuple(r) for r in spool("sitemap_origins").collect()] == [("https://x", 7)] and spool("visited_urls").count() == 0
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text("one\n\ntwo\r\n")
    (tmp_path / "in" / "b.jsonl").write_text("three")
    want = [("a.jsonl:1", "one"), ("a.jsonl:3", "two"), ("b.jsonl:1", "three")]
    assert sorted(map(tuple, spark.read.format("event_lines").load(f"{tmp_path}/in").collect())) == want
    assert sorted(map(tuple, plugins.JsonLines(f"file://{tmp_path}/in").records(spark).collect())) == want


def test_standard_input_and_references(spark):
    lines = batches.stream_lines(spark, io.StringIO(event("capture_committed", 1) + "\n\n" + event("capture_committed", 2) + "\n"))
    got = sorted((r["ref"], r["event_id"]) for r in batches.event_records(lines).collect())
    assert got == [("stdin:1", "e1"), ("stdin:3", "e2")] and batches.stream_lines(spark, io.StringIO("")).count() == 0
    with pytest.raises(Exception, match="file:line"):
        batches.event_records(lines.withColumn("ref", F.lit("stdin"))).collect()


def test_following_ends_at_the_terminal_event_and_seals_once(spark, tmp_path):
    src, root = tmp_path / "in", f"file://{tmp_path}/lake"
    src.mkdir()
    (src / "a.txt").write_text("\n".join([event("capture_committed", 1), event("capture_committed", 2, "other"), event("crawl_completed", 3), event("corpus_snapshot_published", 4)]) + "\n")
    t = streaming.run_reduce(spark, f"file://{src}", root, follow=True, run="r1", seconds=120, every="200 milliseconds")
    assert sorted(r["event_id"] for r in t.events().collect()) == ["e1", "e3", "e4"] and t.version() == 0
    sealed = Table(spark, root, "sealed", "crawl_run_id string, event_count bigint", ["crawl_run_id"])
    want = spark.createDataFrame([("r1", "e1"), ("r2", "e9")], "crawl_run_id string, event_id string")
    assert streaming.seal(spark, t, want, sealed) == 1 and streaming.seal(spark, t, want, sealed) == 0
    assert [tuple(r) for r in sealed.read().collect()] == [("r1", 3)]


def test_keyed_deduplication_keeps_one(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.createDataFrame([("r", "e", "2024-01-01T00:00:00Z")] * 3 + [("r", "f", "2024-01-01T00:00:01Z")], "crawl_run_id string, event_id string, event_time string").write.mode("append").json(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("crawl_run_id string, event_id string, event_time timestamp").json(f"file://{tmp_path}/in")
    q = streaming.keyed_deduplicate(stream).writeStream.format("memory").queryName("deduplicated").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("deduplicated").count() == 2


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("HTTP://Example.COM:80/a/../b/./c?x#f", "http://example.com/b/c?x"), ("http://münchen.de/ü", "http://xn--mnchen-3ya.de/%C3%BC"), ("http://[::0:1]:8080", "http://[::1]:8080/"), ("http://0x7f.1/", "http://127.0.0.1/"), ("http://u:p@h/", None), ("ftp://x/", None),
        ("http://h:99999/", None), (" https:\\\\e.com\\p ", "https://e.com/p"), ("http://1.2.3.256/", None), ("https://e.com/a//b/..", "https://e.com/a//"), ("http://exa mple/", None), ("https://e.com/%2e%2E/x y?q='", "https://e.com/x%20y?q=%27"), (None, None), ("http://", None),
    ],
)
def test_urls_have_one_form(given, want):
    assert urls.parse_url(given) == want


def test_simple_urls_stay_in_the_jvm(spark):
    rows = ["https://a.example/x/y?z=1", "HTTPS://A.example:443/x", "https://a.example/a/../b", "https://a.example"]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in rows], "u string").select(urls.canonical_url("u")).collect()]
    assert got == ["https://a.example/x/y?z=1", "https://a.example/x", "https://a.example/b", "https://a.example/"] == [urls.parse_url(u) for u in rows]


def test_scope_hash_rejects_what_is_no_list(spark):
    fields = {f: F.array(F.lit("b"), F.lit("a")) for f in canonical.SCOPE_FIELDS}
    one = lambda **k: spark.range(1).select(canonical.scope_sha256(F.struct(F.lit("s").alias("source_id"), *[v.alias(n) for n, v in (fields | k).items()]))).first()[0]
    none, empty = F.lit(None).cast("array<string>"), F.array().cast("array<string>")
    assert one() == one(seeds=F.array(F.lit("a"), F.lit("b"))) and one(allowed_urls=none) != one(allowed_urls=empty) and one(sitemap_url_prefixes=none) == one(sitemap_url_prefixes=empty)
    with pytest.raises(Exception, match="list of strings"):
        one(seeds=none)
    with pytest.raises(Exception, match="list of strings"):
        one(path_prefixes=F.array(F.lit(None).cast("string")))


def test_sql_over_a_folder(spark, tmp_path, capsys):
    from corpuslake.__main__ import main

    t = Table(spark, f"file://{tmp_path}", "things", "k int, v string", ["k"])
    t.merge_insert(spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string"))
    spark.range(3).write.parquet(f"file://{tmp_path}/numbers.parquet")
    assert views.register_folder(spark, f"file://{tmp_path}") == ["numbers", "things"]
    assert [tuple(r) for r in views.run_sql(spark, "SELECT k, v, (SELECT count(*) FROM numbers) AS n FROM things ORDER BY k;").collect()] == [(1, "a", 3), (2, "c", 3)]
    with pytest.raises(ValueError):
        views.run_sql(spark)
    assert main(["tables", "--lake", f"file://{tmp_path}"]) == 0 and capsys.readouterr().out.split() == ["numbers", "things"]
    assert main(["query", "--lake", f"file://{tmp_path}", "--sql", "SELECT max(id) AS top FROM numbers"]) == 0 and "top" in capsys.readouterr().out


def test_vector_search_in_blocks(spark):
    rows = [(i, "s", [float(i % 7), 1.0]) for i in range(50)] + [(99, "s", [0.0, 0.0]), (98, "s", None), (97, "s", [1.0, 2.0, 3.0])]
    v = spark.createDataFrame(rows, "passage_id int, source_id string, vector array<double>")
    q = v.where("passage_id < 5").select(F.col("passage_id").alias("query_id"), "vector")
    got = [sorted((r["query_id"], r["rank"], r["passage_id"]) for r in search.vector_topk(v, q, 3, block=b).collect()) for b in (2, 100)]
    assert got[0] == got[1] and [x for x in got[0] if x[0] == 0] == [(0, 1, 0), (0, 2, 7), (0, 3, 14)]
    assert search.vector_topk(v, q.limit(0), 3).count() == 0


def test_receipts_of_complete_batches_only(spark):
    b = spark.createDataFrame([("b1", "complete", 3, "x", 0), ("b2", "processing", 1, "y", 0), ("b3", "complete", 2, "z", 1)], "batch_id string, status string, record_count int, records_sha256 string, quarantined int")
    r = frontier.write_receipts(b, "c")
    assert sorted(x["batch_id"] for x in r.collect()) == ["b1", "b3"] and [x["batch_id"] for x in frontier.receipts_complete(r, b).collect()] == ["b1"]


@pytest.mark.parametrize("name", ["batch_pages", "near_sidecar", "batch_load", "batch_passages", "dq_snapshot"])
def test_records_of_a_batch_never_come_to_the_driver(spark, monkeypatch, name):
    read = Files.read
    monkeypatch.setattr(Files, "read", lambda self, p: pytest.fail("records read whole") if p.endswith(batches.RECORDS) else read(self, p))
    monkeypatch.setattr(type(spark.range(0)), "toLocalIterator", lambda *_: pytest.fail("records sent to the driver"))
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_a_batch_of_many_parts_is_one_file_in_order_or_none(spark, tmp_path):
    rows = spark.range(5_000).repartition(7).select(*[F.lit("1").alias(c) for c in ("schema_version", "batch_id", "snapshot_id")], F.when(F.col("id") % 3 == 0, "page").otherwise("source").alias("record_type"), F.concat(F.lit("\u00e9"), F.col("id").cast("string")).alias("record_id"), F.lit("{}").alias("record_json"))
    said = {"batch_id": "1", "snapshot_id": "1"}
    with pytest.raises(batches.SourceError, match="larger"):
        batches.publish_batch(spark, f"file://{tmp_path}/b0", rows, said, max_records=4_999)
    assert not (tmp_path / "b0").exists()
    made = batches.publish_batch(spark, f"file://{tmp_path}/b1", rows, said, max_records=5_000)
    raw = (tmp_path / "b1" / batches.RECORDS).read_bytes()
    keys = [(r["record_type"], r["record_id"]) for r in map(json.loads, raw.decode().splitlines())]
    assert keys == sorted(keys) and len(set(keys)) == 5_000 and made["counts"] == {"page": 1_667, "source": 3_333}
    assert made["records_bytes"] == len(raw) and made["records_sha256"] == hashlib.sha256(raw).hexdigest() and batches.validate_batch(spark, f"file://{tmp_path}/b1")[0] == made


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_lines_are_numbered_across_splits(spark, tmp_path, monkeypatch, end):
    text = type(spark.read).text
    monkeypatch.setattr(type(spark.read), "text", lambda self, *a, **b: pytest.fail("a file as one row") if b.get("wholetext") else text(self, *a, **b))
    want = []
    for name, n in (("a.jsonl", 400), ("b.jsonl", 3), ("c.jsonl", 150)):
        lines = ["" if i % 7 == 3 else " \t" if i % 11 == 5 else f"line {i} \u00e9" * (i % 5 + 1) for i in range(1, n + 1)]
        (tmp_path / name).write_bytes(end.join(lines).encode())
        want += [(f"{name}:{i}", x) for i, x in enumerate(lines, 1) if x.strip()]
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k, v in zip(old, ("97", "1")):
            spark.conf.set(k, v)
        assert sorted(map(tuple, batches.text_lines(spark, f"file://{tmp_path}").collect())) == sorted(want)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    plugins.register(spark)
    assert sorted(map(tuple, spark.read.format("event_lines").load(f"file://{tmp_path}").collect())) == sorted(want)


def test_event_lines_are_read_from_stores_that_are_not_local(tmp_path, monkeypatch):
    from pyarrow import fs

    (tmp_path / "a.jsonl").write_text("one\n\ntwo")
    monkeypatch.setattr(plugins, "store", lambda _: (fs.SubTreeFileSystem(str(tmp_path), fs.LocalFileSystem()), ""))
    reader = plugins.EventLinesReader("other://store/in")
    assert [x for p in reader.partitions() for x in reader.read(p)] == [("a.jsonl:1", "one"), ("a.jsonl:3", "two")]


def _catalog_of(spark, n=60):
    bodies = [" ".join(f"w{(i * 7 + j * j) % 5}" for j in range(i % 13)) for i in range(n)]
    return bodies, spark.createDataFrame([(i, "s" if i % 3 else None, x[:5], x) for i, x in enumerate(bodies)], "passage_id bigint, source_id string, title string, body string").repartition(3)


def test_words_are_scored_where_their_passage_is(spark):
    _, catalog = _catalog_of(spark)
    q = spark.createDataFrame([(1, "w1 w3"), (2, "w1 w1")], "query_id bigint, query string")
    made = search.keyword_topk(*search.build_postings(catalog, ("title", "body"), q), q, 10)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(positions" not in plan and "collect_list(pos" not in plan and plan.count("RepartitionByExpression") == 1
    assert made.count() == 20


def test_packed_postings_are_those_of_plain_counting(spark, tmp_path):
    bodies, catalog = _catalog_of(spark)
    want = sorted((f"w{w}", i, [j for j, x in enumerate(b.split()) if x == f"w{w}"]) for i, b in enumerate(bodies) for w in range(5) if f"w{w}" in b.split())
    for block in (7, 1_000_000):
        blocks = search._blocks(catalog, ("title", "body"), None, block)
        got = search._unpacked(blocks).where("field = 'body'").collect()
        assert sorted((r["term"], r["passage_id"], list(r["positions"])) for r in got) == want
        assert all(r["tf"] == len(r["positions"]) and r["length"] == len(bodies[r["passage_id"]].split()) and r["source_id"] == ("s" if r["passage_id"] % 3 else None) for r in got)
        stats = {r["field"]: (r["n"], r["avg_length"]) for r in search._counted(blocks)[1].collect()}
        assert stats["body"] == (60, sum(len(b.split()) for b in bodies) / 60)


def test_phrases_are_met_by_lists_of_starts(spark):
    bodies, catalog = _catalog_of(spark)
    asked = spark.createDataFrame([(1, '"w1 w2"'), (2, '"w1 w1"'), (3, '"w3 w2 w4" w1')], "query_id bigint, query string")
    made = search.keyword_topk(*search.build_postings(catalog, ("body",), asked), asked, 100)
    assert "explode(positions" not in made._jdf.queryExecution().optimizedPlan().toString()
    got = {k: {r["passage_id"] for r in made.collect() if r["query_id"] == k} for k in (1, 2, 3)}
    has = lambda *p: {i for i, b in enumerate(bodies) if f" {' '.join(p)} " in f" {b} "}
    assert got == {1: has("w1", "w2"), 2: has("w1", "w1"), 3: has("w3", "w2", "w4") | has("w1")}


def test_an_index_is_packed_and_moves_no_postings(spark, tmp_path):
    _, catalog = _catalog_of(spark)
    search.write_index(catalog, f"file://{tmp_path}/i", ("title", "body"), 4)
    kept = spark.read.parquet(f"file://{tmp_path}/i/postings")
    assert "positions" in kept.columns and dict(kept.dtypes)["passage_ids"] == "array<bigint>" and not list((tmp_path / "i" / "postings").glob("bucket=*"))
    asked = spark.createDataFrame([(1, 'w1 "w3 w2"'), (2, "w4")], "query_id bigint, query string")
    plain = search.keyword_topk(*search.build_postings(catalog, ("title", "body"), asked), asked, 10)
    found = search.keyword_topk(*search.open_index(spark, f"file://{tmp_path}/i", asked), asked, 10)
    assert sorted((r["query_id"], r["rank"], r["passage_id"], round(r["score"], 9)) for r in found.collect()) == sorted((r["query_id"], r["rank"], r["passage_id"], round(r["score"], 9)) for r in plain.collect()) != []
