"""Goldens and properties of the operators, on small hand-made inputs."""

import hashlib
import json
import os
import random
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit, urlunsplit

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslake.functions import text as tx
from corpuslake.functions import urls
from corpuslake.operators import dedup, evaluation, extract, frontier, history, quality, recrawl, reconcile, search
from corpuslake.sources import batches
from corpuslake.sources.lake import Conflict, Generations, Table
from corpuslake.streaming import reduce as streaming

PAGE = "snapshot_id string, source_id string, page_id string, url string, content_sha256 string, scope string, contract string, observed_at string, origin string"


def pages(spark, rows):
    """(snapshot, source, page, sha) rows; snapshot n is day n."""
    return spark.createDataFrame([(f"s{n}", s, p, f"https://x/{p}", c, "a", "k", f"2024-01-0{n}T00:00:00Z", f"https://{s}") for n, s, p, c in rows], PAGE)


def two_snapshots(spark):
    docs = [(1, "docs", f"p{i}", "1") for i in range(4)] + [(2, "docs", "p1", "1"), (2, "docs", "p2", "2"), (2, "docs", "p3", "2"), (2, "docs", "p4", "1")]
    ref = [(1, "ref", "a", "1"), (1, "ref", "b", "1"), (1, "ref", "c", "1"), (2, "ref", "b", "1"), (2, "ref", "c", "2"), (2, "ref", "d", "1")]
    return pages(spark, docs + ref)


def test_snapshot_changes_golden(spark):
    rows = {(r["source_id"], r["snapshot_id"]): r for r in history.snapshot_changes(two_snapshots(spark)).collect()}
    d = rows["docs", "s2"]
    assert (d["added"], d["removed"], d["changed"], d["unchanged"]) == (1, 1, 2, 1)
    assert d["change_rate"] == pytest.approx(2 / 3) and d["churn_rate"] == pytest.approx(4 / 5)
    r = rows["ref", "s2"]
    assert (r["added"], r["removed"], r["changed"], r["unchanged"]) == (1, 1, 1, 1)
    assert rows["docs", "s1"]["previous_snapshot_id"] is None and rows["docs", "s1"]["added"] == 4 and rows["docs", "s1"]["change_rate"] is None


def test_presence_stops_at_a_scope_change(spark):
    p = pages(spark, [(1, "s", "a", "1"), (1, "s", "b", "1"), (2, "s", "a", "1"), (3, "s", "a", "1"), (4, "s", "a", "1")])
    src = p.groupBy("snapshot_id", "source_id", "contract", "observed_at").agg(F.count("*").alias("page_count")).withColumn("scope", F.when(F.col("snapshot_id") == "s3", "b").otherwise("a"))
    src = src.withColumns({"stop_reason": F.lit("frontier_exhausted"), "failed_count": F.lit(0), "rejected_count": F.lit(0)})
    p = p.drop("scope").join(src.select("snapshot_id", "scope"), "snapshot_id")
    ev = spark.createDataFrame([("s2", "s", "b", "tombstone", "a", None, None, "t")], "snapshot_id string, source_id string, page_id string, kind string, scope string, complete boolean, expected_page_count bigint, evidence_at string")
    got = [(r["snapshot_id"], r["page_id"], r["presence_status"], r["removal_basis"]) for r in history.page_presence(p, src, ev).collect()]
    assert got == [("s2", "b", "removed", "explicit_tombstone")]


def test_arrival_order_does_not_matter(spark, tmp_path):
    t = Table(spark, f"file://{tmp_path}", "h", "k string, v string, at string, b string", ["k"])
    rows = [("x", "1", "2024-01-02", "b2"), ("x", "1", "2024-01-01", "b1"), ("y", "2", "2024-01-03", "b3")]
    for r in [rows[0], rows[2], rows[1], rows[0]]:
        t.merge_history(spark.createDataFrame([r], "k string, v string, at string, b string"), ["v"], "at", "b")
    assert sorted(map(tuple, t.read().select("k", "v", "at", "b").collect())) == [("x", "1", "2024-01-01", "b1"), ("y", "2", "2024-01-03", "b3")]
    with pytest.raises(ValueError, match="immutable"):
        t.merge_history(spark.createDataFrame([("x", "9", "2024-01-05", "b5")], "k string, v string, at string, b string"), ["v"], "at", "b")


def test_table_reload_inserts_nothing_and_conflicts(spark, tmp_path):
    t = Table(spark, f"file://{tmp_path}", "t", "k int, v string", ["k"])
    assert t.read().count() == 0 and t.version() == -1
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k int, v string")
    assert t.merge_insert(df) == (0, 2)
    assert t.merge_insert(df) == (None, 0) and t.version() == 0
    with pytest.raises(ValueError):
        t.merge_append_only(spark.createDataFrame([(1, "z")], "k int, v string"), ["v"])
    t.overwrite(spark.createDataFrame([(5, "e")], "k int, v string"))
    assert t.read(0).count() == 2 and [r["k"] for r in t.read().collect()] == [5]
    assert len(t.vacuum(1)) == 1
    with pytest.raises(Conflict):
        t.files.create_new(f"{t.root}/_log/{1:020d}.json", b"{}")


def test_generations(spark, tmp_path):
    for g in ("g1", "g2", "g3"):
        (tmp_path / g).mkdir()
    g = Generations(spark, f"file://{tmp_path}")
    g.activate("g1")
    g.activate("g2")
    assert g.current() == "g2" and g.prune() == ["g3"]
    (tmp_path / "g2").rmdir()
    assert g.current() == "g1"


def test_captures_are_reduced_the_same_in_any_order(spark):
    rows = [(i, "s", f"https://x/{i % 5}?r" if i % 3 else f"https://x/{i % 5}", f"https://x/{i % 5}", hashlib.sha256(str(i % 4).encode()).hexdigest()) for i in range(24)]
    seen = []
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        c = spark.createDataFrame(rows, "row_id int, source_id string, requested_url string, final_url string, content_sha256 string").withColumn("selection_key", dedup.selection_key("content_sha256", "requested_url"))
        p, a, m = dedup.reduce_captures(c)
        seen.append([sorted(map(tuple, x.collect())) for x in (p.select("page_id", "content_sha256"), a, m.select("row_id", "admission_status"))])
    assert seen[0] == seen[1]


def test_simhash_matches_a_plain_loop():
    def plain(t):
        counts = [0] * 64
        for i in range(len(t) - 2):
            h = tx.FNV_OFFSET
            for b in " ".join(t[i : i + 3]).encode():
                h = ((h ^ b) * tx.FNV_PRIME) % 2**64
            h = ((h ^ h >> 30) * tx.MIX_1) % 2**64
            h = ((h ^ h >> 27) * tx.MIX_2) % 2**64
            h ^= h >> 31
            for k in range(64):
                counts[k] += 1 if h >> k & 1 else -1
        v = sum(1 << k for k in range(64) if counts[k] > 0)
        return v - 2**64 if v >> 63 else v

    words = "one two three four five six seven eight nine ten eleven".split()
    assert tx.simhash_of(words) == plain(words) and tx.simhash_of(words[:2]) is None
    assert [b - a for a, b in tx.BANDS] == [9, 9, 9, 9, 9, 9, 10]


def test_near_duplicate_is_the_earliest(spark):
    df = spark.createDataFrame([("o", 1, 0), ("o", 2, 7), ("o", 3, 1), ("p", 4, 0), ("o", 5, 2**40 - 1)], "g string, id int, fp bigint")
    got = {r["id"]: (r["near_ordinal"], r["distance"]) for r in dedup.near_duplicates(df, "g", ["id"], "fp", fingerprint="fp").collect()}
    assert got == {2: (1, 3), 3: (1, 1)}


def test_url_rules(spark):
    df = spark.createDataFrame([("HTTP://Ex.com:80/a?x#f",), ("https://ex.com:8443",), ("ftp://x/",), ("https://u:p@x/",), (None,), ("http://[::1]:80/x",)], "url string")
    got = [tuple(r) for r in df.select(urls.normalize_url("url"), urls.origin_key("url")).collect()]
    assert got == [("http://ex.com/a?x", "http://ex.com"), ("https://ex.com:8443/", "https://ex.com:8443"), (None, None), (None, None), (None, None), ("http://[::1]/x", "http://[::1]")]


def test_robots(spark):
    text = "User-agent: *\nDisallow: /\nUser-agent: bot\nDisallow: /a\nAllow: /a/b # c\nDisallow: /q\nAllow: /q\nDisallow:\n"
    rules = urls.robots_table(spark.createDataFrame([("https://x", text)], "o string, t string"), "o", "t")
    df = spark.createDataFrame([(f"https://x{p}",) for p in ("/a", "/a/b/c", "/q", "/z")] + [("https://y/a",)], "url string")
    of = lambda agent: {r["url"]: r["allowed"] for r in urls.robots_allows(df, rules, agent).collect()}
    assert of("Bot") == {"https://x/a": False, "https://x/a/b/c": True, "https://x/q": True, "https://x/z": True, "https://y/a": True}
    assert of("other")["https://x/z"] is False


def test_sitemaps_redirects_and_owner(spark):
    df = spark.createDataFrame([("<sitemapindex><LOC> https://x/b&amp;c </LOC><loc>https://x/a</loc></sitemapindex>",)], "t string")
    assert df.select(urls.sitemap_locs("t").alias("l"), urls.is_sitemap_index("t").alias("i")).first() == (["https://x/a", "https://x/b&c"], True)
    hops = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "d")] + [(f"n{i}", f"n{i + 1}") for i in range(15)], "url string, location string")
    got = {r["url"]: r["outcome"] for r in urls.resolve_redirects(spark.createDataFrame([("a",), ("c",), ("z",), ("n0",)], "url string"), hops).collect()}
    assert got == {"a": "redirect_loop", "c": "ok", "z": "ok", "n0": "redirect_limit_exceeded"}
    src = spark.createDataFrame([(1, "one", ["https://x"], ["/d"], ["/d/no"], None), (2, "two", ["https://x"], ["/"], None, ["https://x/only"])], "ordinal int, source_id string, allowed_origins array<string>, path_prefixes array<string>, deny_prefixes array<string>, allowed_urls array<string>")
    got = {r["url"]: r["owner"] for r in urls.owner_of(spark.createDataFrame([("https://x/d/1",), ("https://x/d/no",), ("https://x/only",), ("https://y/d",)], "url string"), src).collect()}
    assert got == {"https://x/d/1": "one", "https://x/d/no": None, "https://x/only": "two", "https://y/d": None}
    assert urls.overlapping_sources(src).count() == 1
    entries = spark.createDataFrame([("r", "i", True), ("i", "u1", False), ("r", "u2", False), ("i", "r", True)], "sitemap string, loc string, is_index boolean")
    assert {r["loc"] for r in urls.expand_sitemaps(spark.createDataFrame([("r",)], "sitemap string"), entries).collect()} == {"u1", "u2"}


def test_snippets(spark):
    df = spark.createDataFrame([("héllo wörld",), ("short ",), (None,)], "t string")
    assert [r[0] for r in df.select(tx.trim_snippet("t", 2)).collect()] == ["hé", "sh", None]


LONG = "word " * 60


@pytest.mark.parametrize(
    ("html", "method"),
    [
        (f"<main><p>{LONG}</p></main><p>no</p>", "main"), (f"<main><p>{LONG}</p></main><main><p>{LONG}</p></main>", "body"), (f"<article><p>{LONG}</p></article>", "readability"), (f"<p>{LONG}", "body"),
        (f"<main><p>{LONG}</p></main><div aria-hidden=true><p>{LONG}</p></div>", "main"), ("<p>too short", None),
    ],
)
def test_extraction_methods(html, method):
    got = extract.extract(html, "https://x/d/")
    assert got["extraction_method"] == method and (got["error"] is None) == (method is not None)


def test_extraction_details():
    html = f"<html lang=en><head><title>  A  b </title><base href='/r/'><link rel=canonical href=c><meta name=Description content=' d '></head><body><nav><p>{LONG}</p></nav><h1>H</h1><pre>a\n  b</pre><ul><li><p>{LONG}</p></li></ul><a href='q#f'>l</a><a href='https://u@v/'>n</a></body></html>"
    got = extract.extract(html, "https://x/d/")
    assert (got["title"], got["description"], got["language"], got["canonical_url"], got["links"]) == ("A b", "d", "en", "https://x/r/c", ["https://x/r/q"])
    assert [(b["kind"], b["level"]) for b in got["blocks"]] == [("heading", 1), ("code", 0), ("prose", 0)] and got["blocks"][1]["text"] == "a\n  b"


def test_passages_pack_and_split():
    blocks = [{"kind": "heading", "level": 1, "text": "A"}, {"kind": "prose", "level": 0, "text": "a b c"}, {"kind": "prose", "level": 0, "text": "d e"}, {"kind": "heading", "level": 2, "text": "B"}, {"kind": "prose", "level": 0, "text": "1 2 3 4 5 6 7"}, {"kind": "heading", "level": 1, "text": "C"}, {"kind": "prose", "level": 0, "text": "z"}]
    got = extract.pack_passages(blocks, 5)
    assert [(p["ordinal"], p["heading_path"], p["content"]) for p in got] == [(0, ["A"], "a b c\n\nd e"), (1, ["A", "B"], "1 2 3 4 5"), (2, ["A", "B"], "6 7"), (3, ["C"], "z")]
    assert extract.pack_passages([], 5) == [] and extract.pack_passages(None, 5) == []


def test_query_parser_and_hostile_text():
    assert search.parse_query("rust analyzer") == [["rust"], ["analyzer"]]
    assert search.parse_query('"rust analyzer"') == [["rust", "analyzer"]] and search.parse_query('"open to end') == [["open", "to", "end"]]
    assert search.parse_query("field:word") == [["field", "word"]] and search.parse_query("* ( ---") == []
    rng = random.Random(5)
    for _ in range(2_000):
        q = "".join(rng.choice('ab "():*-+^~é\\/[]{}!&|\n') for _ in range(rng.randint(0, 30)))
        assert all(t for lit in search.parse_query(q) for t in lit)


def test_search_end_to_end(spark):
    rows = [(f"p{i}", f"g{i // 2}", "s" if i % 2 else "t", "title", "h", body) for i, body in enumerate(["red apple pie", "green apple tart", "blue sky", "apple apple apple", ""])]
    catalog = spark.createDataFrame(rows, "passage_id string, page_id string, source_id string, title string, heading string, body string")
    vectors = catalog.select("passage_id", "source_id", tx.hash_embed("body", 32).alias("vector"))
    for mode in ("keyword", "semantic", "hybrid"):
        got = search.search(catalog, vectors, "apple", mode, dims=32).collect()
        assert got[0]["page_id"] in ("g0", "g1") and [r["rank"] for r in got] == list(range(1, len(got) + 1))
    phrase = search.search(catalog, None, '"green apple"', "keyword").collect()
    assert [r["winning_passage_id"] for r in phrase] == ["p1"]
    for bad in (dict(query=""), dict(query="x", limit=0), dict(query="x", limit=101), dict(query="x", mode="y")):
        with pytest.raises(ValueError):
            search.search(catalog, vectors, **bad)
    assert search.search(catalog, None, "???", "keyword").count() == 0


def test_source_filter_is_after_the_depth(spark):
    v = spark.createDataFrame([(i, "a" if i < 3 else "b", [1.0, float(i)]) for i in range(6)], "passage_id int, source_id string, vector array<double>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id int, vector array<double>")
    assert search.vector_topk(v, q, 3, source="b").count() == 0 and search.vector_topk(v, q, 4, source="b").count() == 1


def test_ndcg_golden(spark):
    r = spark.createDataFrame([("m", "q", f"p{i}", i + 1) for i in range(4)], "mode string, query_id string, page_id string, rank int")
    j = spark.createDataFrame([("q", f"p{i}", g) for i, g in enumerate((3, 0, 2, 1))], "query_id string, page_id string, grade int")
    m = evaluation.ranking_metrics(r, j).first()
    assert m["ndcg10"] == pytest.approx(0.9508013338940989) and m["mrr10"] == 1 and m["recall10"] == 1
    late = spark.createDataFrame([("m", "q", f"x{i}", i + 1) for i in range(10)] + [("m", "q", "p0", 11)], "mode string, query_id string, page_id string, rank int")
    m = evaluation.ranking_metrics(late, j).first()
    assert (m["recall10"], m["recall100"], m["mrr10"]) == (0, 0.5, 0)
    with pytest.raises(ValueError):
        evaluation.ranking_metrics(r, j.withColumn("grade", F.lit(1)))


def test_bootstrap_equals_the_sequential_generator():
    x, seed, n = [0.1, -0.2, 0.4, 0.0, 0.3], 99, 200
    state, means = seed, []
    for _ in range(n):
        total = 0.0
        for _ in x:
            state = evaluation.lcg(state)
            total += x[state % len(x)]
        means.append(total / len(x))
    means.sort()
    got = evaluation.paired_bootstrap(x, seed, n)
    assert got == pytest.approx((float(np.mean(x)), means[(n - 1) * 25 // 1000], means[(n - 1) * 975 // 1000]))


def test_histogram_quantile(spark):
    b = evaluation.cumulative_buckets(spark.createDataFrame([("a", float(v)) for v in (1, 3, 5, 50)], "s string, v double"), ["s"], "v", [2.0, 4.0, 8.0])
    assert [r["cumulative_count"] for r in b.orderBy("le").collect()] == [1, 2, 3, 4]
    assert evaluation.histogram_quantile(b, 0.5).first()["quantile"] == pytest.approx(4.0)


def test_throttle_golden(spark):
    extra, seen = 0, []
    for _ in range(8):
        extra = frontier.next_backoff(extra, frontier.THROTTLED)
        seen.append(extra)
    assert seen == [1000, 2000, 4000, 8000, 16000, 32000, 60000, 60000]
    answers = [429, 429, 200, 500, None, 200, 503, 502, 404]
    extra = 0
    for a in answers:
        extra = frontier.next_backoff(extra, frontier.signal(a))
    assert extra == frontier.next_backoff(min(60_000, 2 * (2_000 - 250 - 218)), frontier.HEALTHY)
    df = spark.createDataFrame([("o", i, a) for i, a in enumerate(answers)], "k string, i int, s int")
    assert frontier.throttle(df, ["k"], "i", "s").first()["backoff_ms"] == extra


def test_leases_and_results(spark):
    ev = spark.createDataFrame([("t", 1, "claim", "a"), ("t", 2, "renew", "b"), ("t", 3, "expire", None), ("t", 4, "claim", "b"), ("t", 5, "succeed", "a"), ("t", 6, "succeed", "b")], "task_id string, seq int, action string, worker string")
    r = frontier.fold_leases(ev).first()
    assert (r["status"], r["epoch"], r["attempts"], r["stale"]) == ("succeeded", 2, 2, 2)
    a = spark.createDataFrame([("t", 1, 1, "x", "p"), ("t", 2, 2, "y", "p"), ("t", 3, 2, "y", "p"), ("t", 4, 2, "y", "q"), ("u", 5, 1, "x", "p")], "task_id string, seq int, epoch int, owner string, payload string")
    lease = spark.createDataFrame([("t", 2, "y")], "task_id string, live_epoch int, live_owner string")
    assert [r["outcome"] for r in frontier.accept_results(a, lease).orderBy("seq").collect()] == ["stale", "accepted", "duplicate", "error", "stale"]


def test_queue_helpers(spark):
    t = spark.createDataFrame([("r", "t1", "s", "failed", 3), ("r", "t2", "s", "pending", 0)], "crawl_run_id string, task_id string, source_id string, status string, attempts int")
    back, skipped = frontier.requeue(t, spark.createDataFrame([("t1",), ("t2",), ("t9",)], "task_id string"))
    assert [r["status"] for r in back.collect()] == ["pending"] and {r["task_id"] for r in skipped.collect()} == {"t2", "t9"}
    out = spark.createDataFrame([("r", "e1", "d")], "crawl_run_id string, event_id string, delivered_at string")
    assert frontier.quiescent(t, out).first()["quiescent"] is False
    need = spark.createDataFrame([("r", f"e{i:02}") for i in range(30)], "crawl_run_id string, event_id string")
    m = frontier.missing_events(need, need.where("event_id < 'e05'")).first()
    assert m["missing_count"] == 25 and len(m["sample"]) == 20
    o = spark.createDataFrame([("r", "e1", 1), ("r", "e2", 2)], "crawl_run_id string, event_id string, created_at int")
    c = spark.createDataFrame([("r", "e1", False, 99)], "crawl_run_id string, event_id string, acked boolean, next_attempt_at int")
    assert frontier.due_deliveries(o, c, 5, False).count() == 0 and [r["event_id"] for r in frontier.due_deliveries(o, c, 5, True).collect()] == ["e2"]


def event(i, run="r", kind="capture_committed", **over):
    data = {"event_id": f"e{i}", "schema_version": 1, "crawl_run_id": run, "source_id": "s", "task_id": i, "committed_at_utc": "2024-01-01T00:00:00Z", "result_sha256": "x", "content_sha256": "c", "body_artifact": {}}
    return json.dumps({"event_type": kind, "data": {**data, **over}})


def test_event_rules_name_what_is_wrong(spark):
    bad = [event(1, task_id=True), event(2, committed_at_utc="2024-01-01T00:00:00"), event(3, extra=1), event(4, schema_version=2), "not json", json.dumps({"event_type": "zzz", "data": {}}), event(5, task_id="7")]
    df = batches.shape_event(spark.createDataFrame([(x,) for x in [event(0), *bad]], "record_json string"))
    problems = [r["p"] for r in df.select(quality.event_problem().alias("p")).collect()]
    assert problems[0] is None and all(problems[1:])
    none = spark.createDataFrame([], "crawl_run_id string, event_id string, payload_sha256 string")
    with pytest.raises(quality.QualityError, match="event.schema"):
        quality.require(quality.check_events(df, none))
    clash = batches.shape_event(spark.createDataFrame([(event(1),), (event(1, result_sha256="y"),)], "record_json string"))
    with pytest.raises(quality.QualityError, match="event.identity"):
        quality.require(quality.check_events(clash, none))


def snapshot_batch(spark, drop=None, extra=None):
    page = {k: "v" for k in quality.PAGE_FIELDS} | {"page_id": "p1", "source_id": "src"} | (extra or {})
    rows = [("snapshot", "snap", {"status": "complete", "created_at_utc": "2024-01-01T00:00:00Z", "page_count": 1, "alias_count": 0, "passage_count": 1}), ("source", "src", {"allowed_origins": ["b", "a"]}), ("page", "p1", page), ("passage", "q1", {"page_id": "p1", "ordinal": 0, "heading_path": ["H", "I"], "content": "c"})]
    return spark.createDataFrame([("v1", "batch", "snap", "m", "c", t, i, "src" if t in ("page", "passage") else None, json.dumps(j)) for t, i, j in rows if t != drop], batches.ENVELOPE.rsplit(",", 1)[0])


TABLES = {
    "bronze_snapshot_records": (batches.ENVELOPE.rsplit(",", 1)[0] + ", record_sha256 string", ["batch_id", "record_type", "record_id"]), "silver_snapshots": ("snapshot_id string, batch_id string, status string, created_at_utc string, page_count bigint, alias_count bigint, passage_count bigint", ["snapshot_id"]),
    "silver_sources": ("snapshot_id string, source_id string, origins string", ["snapshot_id", "source_id"]), "silver_pages": ("snapshot_id string, page_id string, source_id string, url string, title string, language string, content_sha256 string, content_chars bigint", ["snapshot_id", "page_id"]),
    "silver_passages": ("snapshot_id string, passage_id string, page_id string, source_id string, ordinal bigint, heading_path string, content string", ["snapshot_id", "passage_id"]), "silver_page_aliases": ("snapshot_id string, alias_page_id string, source_id string, alias_url string, representative_page_id string, alias_kind string", ["snapshot_id", "alias_page_id"]),
}


def test_load_is_idempotent_and_checked(spark, tmp_path):
    tables = {n: Table(spark, f"file://{tmp_path}", n, s, k) for n, (s, k) in TABLES.items()}
    good = snapshot_batch(spark)
    shaped = batches.shape_snapshot(good)
    quality.require(quality.check_snapshot(shaped, good, {}))
    assert sum(batches.load_snapshot(tables, shaped, {"load_id": "1", "snapshot_id": "snap"}).inserted.values()) == 8
    assert sum(batches.load_snapshot(tables, shaped, {"load_id": "2"}).inserted.values()) == 0 and tables["silver_pages"].version() == 0
    assert tables["silver_sources"].read().first()["origins"] == "a,b" and tables["silver_passages"].read().first()["heading_path"] == "H > I"
    for bad, rule in ((snapshot_batch(spark, extra={"surprise": 1}), "schema.drift"), (snapshot_batch(spark, drop="page"), "referential.pages"), (snapshot_batch(spark, drop="passage"), "counts.match_snapshot")):
        with pytest.raises(quality.QualityError, match=rule):
            quality.require(quality.check_snapshot(batches.shape_snapshot(bad), bad, {}))


def test_published_batch_round_trip_and_tampering(spark, tmp_path):
    folder = f"file://{tmp_path}/b1"
    batches.publish_batch(spark, folder, snapshot_batch(spark), {"batch_id": "batch", "snapshot_id": "snap"})
    manifest, rows = batches.validate_batch(spark, folder)
    assert manifest["counts"]["page"] == 1 and rows.count() == 4
    assert batches.published_batches(spark, f"file://{tmp_path}") == [folder]
    (tmp_path / "b1" / ".records.jsonl.crc").unlink(missing_ok=True)
    with (tmp_path / "b1" / "records.jsonl").open("a") as f:
        f.write("{}\n")
    with pytest.raises(batches.SourceError):
        batches.validate_batch(spark, folder)


def test_stream_restart_and_replay_change_nothing(spark, tmp_path):
    src, root = tmp_path / "in", f"file://{tmp_path}/lake"
    src.mkdir()
    (src / "a.txt").write_text("\n".join([event(1), event(2), event(2), "junk"]) + "\n")
    t = streaming.run_reduce(spark, f"file://{src}", root)
    assert t.events().count() == 2
    (src / "b.txt").write_text("\n".join([event(2), event(3), event(1, result_sha256="other")]) + "\n")
    t = streaming.run_reduce(spark, f"file://{src}", root)
    assert {r["event_id"] for r in t.events().collect()} == {"e1", "e2", "e3"}
    assert sorted(r["disposition"] for r in t.held().collect()) == ["identity_conflict", "quarantined"]
    before = t.version()
    streaming.reduce_batch(spark.createDataFrame([(event(1),)], "record_json string"), t, {})
    assert t.version() == before


def test_replay_verdicts_and_fingerprints(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "k int, v string")
    v = reconcile.replay_verdicts({"t": a, "u": a}, {"t": a.orderBy(F.desc("k")), "u": a.distinct()})
    assert [(x["table"], x["equal"]) for x in v] == [("t", True), ("u", False)]
    f1, f2 = reconcile.fingerprints(a, ["k"], ["v"]), reconcile.fingerprints(a.where("k = 2"), ["k"], ["v"])
    assert reconcile.fingerprint_check(f1, f1, ["k"]).count() == 0 and reconcile.fingerprint_check(f2, f1, ["k"]).count() == 1


def test_authority_ladder(spark):
    pub = lambda run, snap, sha="m": json.dumps({"data": {"snapshot_id": snap, "snapshot_manifest": {"sha256": sha}, "crawl_manifest": {"sha256": "c", "byte_size": 9}, "page_count": 1, "alias_count": 0, "passage_count": 2}})
    cap = lambda task: json.dumps({"data": {"task_id": task, "content_sha256": "x", "body_artifact": {"sha256": "b"}}})
    ev = [("r1", "p", "corpus_snapshot_published", None, pub("r1", "s1")), ("r1", "c1", "capture_committed", "s", cap(1)), ("r2", "p", "corpus_snapshot_published", None, pub("r2", "s2", "zz")), ("r3", "p", "corpus_snapshot_published", None, pub("r3", "s3")), ("r5", "p", "corpus_snapshot_published", None, pub("r5", "s5"))]
    events = spark.createDataFrame(ev, "crawl_run_id string, event_id string, event_type string, source_id string, record_json string")
    snap = spark.createDataFrame([(f"r{i}", f"s{i}", f"b{i}", "m", "c", 9, 1, 0, 2, 1, i != 4) for i in (1, 2, 3, 4)] + [("r6", "s6", "b6", "m", "c", 9, 1, 0, 2, 1, True)], "crawl_run_id string, snapshot_id string, batch_id string, snapshot_sha string, crawl_sha string, crawl_bytes bigint, page_count bigint, alias_count bigint, passage_count bigint, capture_count bigint, manifest_ok boolean")
    runs = spark.createDataFrame([(f"r{i}",) for i in range(1, 8)], "crawl_run_id string")
    got = {r["crawl_run_id"]: r["authority_status"] for r in reconcile.authority(events, snap, runs).collect()}
    assert got == {"r1": "authoritative", "r2": "publication_binding_mismatch", "r3": "awaiting_capture_events", "r4": "snapshot_manifest_mismatch", "r5": "awaiting_validated_snapshot_batch", "r6": "awaiting_publication_event", "r7": "provisional_no_validated_snapshot"}


def test_recrawl_demo_policy(spark):
    cols = "generation_id string, source_id string, generated_at string, expires_at string, expected_policy_version string, minimum_interval_hours double, current_interval_hours double, maximum_interval_hours double, max_adjustment_fraction double, minimum_completed_snapshots int, minimum_comparable_page_observations int, maximum_evidence_age_days int, maximum_provisional_event_age_seconds int, snapshot_ids array<string>, provisional_run_id string, provisional_event_ids array<string>"
    p = pages(spark, [(n, "s", f"p{i}", str(n) if i < 5 else "same") for n in (1, 2, 3) for i in range(12)])
    src = p.groupBy("snapshot_id", "source_id", "scope", "contract", "observed_at").agg(F.count("*").alias("page_count")).withColumns({"stop_reason": F.lit("frontier_exhausted"), "failed_count": F.lit(0), "rejected_count": F.lit(0)})
    base = ["g", "s", "2024-01-04T00:00:00Z", "2024-02-01T00:00:00Z", "v", 6.0, 24.0, 168.0, 0.25, 3, 20, 10, 600, ["s1", "s2", "s3"], None, []]
    none = spark.createDataFrame([], "crawl_run_id string, event_id string, source_id string, event_type string, event_at string")
    c = recrawl.candidates(spark.createDataFrame([tuple(base)], cols), src, history.page_changes(p), none)
    r = c.first()
    assert r["proposed_interval_hours"] == 18.0 and r["adjustment_type"] == "decrease" and r["recommendation_id"].startswith("sha256:")
    assert recrawl.validation(c, "2024-01-05T00:00:00Z").first()["validation_status"] == "valid"
    assert recrawl.validation(c, "2024-03-05T00:00:00Z").first()["validation_status"] == "stale"
    broken = recrawl.candidates(spark.createDataFrame([tuple(["g", "s", "yesterday", *base[3:]])], cols), src, history.page_changes(p), none)
    assert recrawl.validation(broken, "2024-01-05T00:00:00Z").first()["validation_status"] == "invalid"
    policy = spark.createDataFrame([("s", "v", 24.0, True)], "source_id string, policy_version string, interval_hours double, enabled boolean")
    bound = recrawl.bound(c.drop("snapshot_ids"), policy).first()
    assert bound["basis_intact"] and bound["policy_current"]
    rec = recrawl.recommendations(c).withColumn("validation_status", F.lit("valid"))
    out = recrawl.import_outcomes(rec, rec.limit(0), policy)
    assert out.first()["import_outcome"] == "scheduled" and recrawl.import_outcomes(rec, rec, policy).first()["import_outcome"] == "existing"
    rules = [(F.lit(True), "stale", "old"), (F.lit(True), "unsupported", "few"), (F.lit(None).cast("boolean"), "invalid", "no")]
    v = recrawl.accumulate(rec, rules).first()["verdict"]
    assert v["status"] == "stale" and v["reasons"] == ["few", "old"]


def test_replay_preflight(spark):
    e = lambda *ids: spark.createDataFrame([("r", i) for i in ids] or [], "crawl_run_id string, event_id string")
    r = recrawl.replay_preflight(e("a", "b", "c"), e("a"), e("b"), e()).first()
    assert r["replay_status"] == "unrecoverable" and r["gaps"] == ["c"] and r["replayable_count"] == 1


def test_vector_file_and_embed_cache(spark, tmp_path):
    x = np.arange(6, dtype="<f4")
    (tmp_path / "v.bin").write_bytes(b"VEC1" + (3).to_bytes(4, "little") + (2).to_bytes(8, "little") + x.tobytes())
    assert [list(r["vector"]) for r in batches.read_vectors(spark, f"file://{tmp_path}/v.bin", b"VEC1").orderBy("vector_key").collect()] == [[0, 1, 2], [3, 4, 5]]
    i = spark.createDataFrame([("k1", "a b"), ("k2", "a b"), ("k3", "c")], "key string, text string")
    first = tx.embed_missing(i.limit(1), spark.createDataFrame([], "input_sha string, vector array<float>"), 8)
    assert tx.embed_missing(i, first.select("input_sha", "vector"), 8).count() == 3
    assert tx.embed_tokens([], 4) == [1, 0, 0, 0]


# ------------------------------------------------------------ whole inputs of registered queries
def test_throttle_and_redirect_queries_take_all_rows(spark, tmp_path):
    from corpuslake.plans.catalogue import QUERIES

    rng = random.Random(5)
    events = [(i, rng.choice([3, 39, 40, 77, 1_499]), rng.choice(["error", "view"])) for i in range(300)]
    spark.createDataFrame(events, "event_id bigint, user_id bigint, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    spark.range(1, 402).select(F.col("id").alias("c_custkey")).write.parquet(f"{tmp_path}/customer.parquet")
    want = {}
    for i, user, kind in events:
        a, n = want.get(user, (0, 0))
        less = a - a // 8
        want[user] = (a if i % 13 == 0 else min(60_000, a * 2 if a >= 1_000 else 1_000) if kind == "error" else less if less >= 100 else 0, n + 1)
    assert {r["user_id"]: (r["backoff_ms"], r["answers"]) for r in QUERIES["throttle_fold"](spark, str(tmp_path)).collect()} == want
    hops = {str(k): str((k * 7 + 3) % 200) for k in range(1, 402)}
    got = {r["url"]: (r["final_url"], r["hops"], r["outcome"]) for r in QUERIES["redirect_chains"](spark, str(tmp_path)).collect()}
    assert set(got) == set(hops)
    for url, found in got.items():
        chain, looped = [url], False
        while chain[-1] in hops and not looped and len(chain) <= 10:
            looped = hops[chain[-1]] in chain
            chain.append(hops[chain[-1]])
        assert found == ((None, len(chain), "redirect_loop") if looped else (None, len(chain), "redirect_limit_exceeded") if chain[-1] in hops else (chain[-1], len(chain), "ok"))
    assert {x[2] for x in got.values()} >= {"ok"} and len({x[2] for x in got.values()}) > 1


def test_ingestion_and_manifest_queries_take_all_rows(spark, tmp_path):
    from corpuslake.plans.catalogue import QUERIES

    events = spark.range(1, 121).selectExpr("id AS event_id", "id % 7 AS user_id", "timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, int(id % 3)) AS ts", "IF(id % 2 = 0, 'purchase', 'error') AS event_type")
    events.write.parquet(f"{tmp_path}/events.parquet")
    got = QUERIES["ingestion_metrics"](spark, str(tmp_path)).collect()
    assert sorted((r["attempt_id"], r["batch_id"], r["user_id"], r["run_id"]) for r in got) == [(i, f"b-2024-01-0{i % 3 + 1}", i % 7, "run-1") for i in range(1, 121)]
    spark.range(1, 13).selectExpr("id AS c_custkey", "IF(id % 2 = 0, 'A', 'B') AS c_mktsegment", "int(id % 4) AS c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(1, 49).selectExpr("id AS o_orderkey", "id % 12 + 1 AS o_custkey", "IF(id <= 24, date'2024-01-05', date'2024-04-05') AS o_orderdate", "'1' AS o_orderpriority", "'F' AS o_orderstatus").write.parquet(f"{tmp_path}/orders.parquet")
    got = sorted((r["snapshot_id"], int(r["page_id"]), r["source_id"], r["requested_url"]) for r in QUERIES["manifest_page_requests"](spark, str(tmp_path)).collect())
    assert got == [(f"2024-q{q}", k, "BA"[k % 2 == 0], f"https://example.com/{k}") for q in (1, 2) for k in range(1, 13)]


def test_shingle_query_pairs_long_texts(spark, tmp_path):
    from corpuslake.plans.catalogue import QUERIES

    rng = random.Random(6)
    texts = [[f"w{rng.randrange(5_000)}" for _ in range(n)] for n in (30, 3_000, 3_000)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(i + 10, " ".join([*t[:-1], "end"])) for i, t in enumerate(texts)] + [(20, None)]
    assert len(rows[1][1]) > 10_000
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    sets = {i: {tuple(t.split()[a : a + 5]) for a in range(len(t.split()) - 4)} for i, t in rows if t}
    want = {(a, b): round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    got = {(r["left_doc_id"], r["right_doc_id"]): round(r["jaccard"], 6) for r in QUERIES["shingle_jaccard"](spark, str(tmp_path)).collect()}
    assert got == want and set(want) == {(0, 10), (1, 11), (2, 12)}


class PageParts(HTMLParser):
    """Title, language and links of a page, by another parser."""

    def __init__(self, url):
        super().__init__()
        self.url, self.lang, self.title, self.inside, self.links = url, None, "", False, set()

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "html":
            self.lang = a.get("lang")
        if tag == "title":
            self.inside = True
        if tag == "a" and a.get("href"):
            s = urlsplit(urljoin(self.url, a["href"].strip()))
            if s.scheme in ("http", "https") and s.netloc and "@" not in s.netloc:
                self.links.add(urlunsplit((s.scheme, s.netloc.lower(), s.path or "/", s.query, "")))

    def handle_endtag(self, tag):
        self.inside = self.inside and tag != "title"

    def handle_data(self, data):
        self.title += data if self.inside else ""


def test_page_metadata_equals_another_parser(spark):
    from corpuslake.plans.catalogue import QUERIES

    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("no test data")
    got = {r["page_id"]: r for r in QUERIES["html_extract"](spark, sf).collect()}
    for p in spark.read.parquet(f"{sf}/pages.parquet").collect():
        plain = PageParts(p["url"])
        plain.feed(p["html"])
        r = got.pop(p["page_id"])
        assert (r["language"], r["title"], r["link_count"]) == (plain.lang, " ".join(plain.title.split()), len(plain.links)), p["page_id"]
        assert (r["extraction_method"] is None) == (r["error"] is not None)
    assert not got
