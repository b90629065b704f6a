"""Data-quality rules over DataFrames: each returns the failing rows' count and at most five examples; a failed check stops a load before it writes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslake.operators.history import at

EXAMPLES = 5


@dataclass(frozen=True)
class CheckResult:
    rule: str
    failing: int
    examples: tuple[str, ...] = ()

    @property
    def passed(self) -> bool:
        return self.failing == 0

    def __str__(self) -> str:
        if self.passed:
            return f"ok   {self.rule}"
        more = self.failing - len(self.examples)
        return f"FAIL {self.rule}: {', '.join(self.examples)}" + (f" (+{more} more)" if more > 0 else "")


class QualityError(RuntimeError):
    def __init__(self, results: list[CheckResult]) -> None:
        self.results = [r for r in results if not r.passed]
        super().__init__("\n".join(map(str, self.results)))


def result(rule: str, failing: DataFrame, show: list[str]) -> CheckResult:
    """One pass: the count and the first examples in order."""
    text = F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in show])
    shown = failing.select(text.alias("x"))
    rows = shown.orderBy("x").limit(EXAMPLES).collect()
    return CheckResult(rule, shown.count() if len(rows) == EXAMPLES else len(rows), tuple(r["x"] for r in rows))


def require(results: list[CheckResult]) -> list[CheckResult]:
    if any(not r.passed for r in results):
        raise QualityError(results)
    return results


# ------------------------------------------------------------ rules on any table
def types(df: DataFrame, wanted: dict[str, str], key: list[str]) -> CheckResult:
    """schema.types: values that a cast to the wanted type loses."""
    bad = F.lit(False)
    for c, t in wanted.items():
        bad = bad | (F.col(c).isNotNull() & F.expr(f"try_cast(`{c}` AS {t})").isNull())
    return result("schema.types", df.where(bad), key)


def not_null(df: DataFrame, required: list[str], key: list[str]) -> CheckResult:
    """not_null.required_columns: null or empty text."""
    bad = F.lit(False)
    for c in required:
        bad = bad | F.col(c).isNull() | (F.col(c).cast("string") == "")
    return result("not_null.required_columns", df.where(bad), key)


def unique(df: DataFrame, keys: list[str], rule: str = "unique.keys") -> CheckResult:
    return result(rule, df.groupBy(*keys).count().where("count > 1"), keys)


def drift(df: DataFrame, column: str, fields: list[str], key: list[str], optional: list[str] = ()) -> CheckResult:
    """schema.drift: JSON objects with a missing or an unknown field."""
    names = F.json_object_keys(column)
    known = F.array(*map(F.lit, [*fields, *optional]))
    missing, extra = F.array_except(F.array(*map(F.lit, fields)), names), F.array_except(names, known)
    said = F.when(F.size(missing) > 0, F.concat(F.lit("missing "), F.element_at(missing, 1))).otherwise(F.concat(F.lit("extra "), F.array_join(extra, ",")))
    bad = df.where(names.isNull() | (F.size(missing) > 0) | (F.size(extra) > 0)).withColumn("__said", F.coalesce(said, F.lit("no object")))
    return result("schema.drift", bad, [*key, "__said"])


def referential(child: DataFrame, parent: DataFrame, on: dict[str, str], show: list[str], rule: str = "referential.pages") -> CheckResult:
    """Child rows without a parent; on: child column -> parent column."""
    p = parent.select(*[F.col(b).alias(f"__{a}") for a, b in on.items()]).distinct()
    return result(rule, child.join(p, [F.col(a) == F.col(f"__{a}") for a in on], "left_anti"), show)


def counts_match(expected: DataFrame, actual: DataFrame, key: list[str], columns: list[str], rule: str = "counts.match_snapshot") -> CheckResult:
    """Counts by key on both sides; a key that one side lacks differs."""
    e, a = expected.select(*key, *[F.col(c).alias(f"e_{c}") for c in columns]), actual.select(*key, *[F.col(c).alias(f"a_{c}") for c in columns])
    bad = F.lit(False)
    for c in columns:
        bad = bad | ~F.coalesce(F.col(f"e_{c}"), F.lit(0)).eqNullSafe(F.coalesce(F.col(f"a_{c}"), F.lit(0)))
    return result(rule, e.join(a, key, "full").where(bad), key)


def immutable(incoming: DataFrame, known: DataFrame, key: list[str], columns: list[str], rule: str = "immutable.snapshot") -> CheckResult:
    k = known.select(*key, *[F.col(c).alias(f"__{c}") for c in columns])
    bad = F.lit(False)
    for c in columns:
        bad = bad | ~F.col(c).eqNullSafe(F.col(f"__{c}"))
    return result(rule, incoming.join(k, key).where(bad), key)


def freshness(df: DataFrame, time: str, key: list[str], as_of: str, hours: int = 24) -> CheckResult:
    limit = F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(0), F.lit(hours), F.lit(0), F.lit(0).cast("decimal(18,6)"))
    return result(f"freshness.sla_{hours}h", df.where(F.coalesce(at(time) < limit, F.lit(True))), key)


# ------------------------------------------------------------ snapshots and events
PAGE_FIELDS = ["page_id", "source_id", "normalized_final_url", "title", "extraction_method", "content", "content_identity", "content_sha256", "body_sha256", "body_file"]
PAGE_OPTIONAL = ["description", "language", "canonical_url"]
EVENT_FIELDS = {
    "capture_committed": ["event_id", "schema_version", "crawl_run_id", "source_id", "task_id", "committed_at_utc", "result_sha256", "content_sha256", "body_artifact"],
    "crawl_completed": ["event_id", "schema_version", "crawl_run_id", "completed_at_utc", "stop_reason", "config_sha256"],
    "corpus_snapshot_published": ["event_id", "schema_version", "crawl_run_id", "snapshot_id", "published_at_utc", "snapshot_manifest", "crawl_manifest", "page_count", "alias_count", "passage_count"],
}
INTEGERS = {"schema_version", "task_id", "page_count", "alias_count", "passage_count"}


def check_snapshot(shaped: dict[str, DataFrame], envelopes: DataFrame, lake: dict[str, DataFrame]) -> list[CheckResult]:
    """The input rules of a snapshot batch, before anything is written."""
    pages, passages, aliases, snapshot = (shaped[f"silver_{k}"] for k in ("pages", "passages", "page_aliases", "snapshots"))
    n = lambda d, c: d.groupBy("snapshot_id").agg(F.count("*").alias(c))
    actual = snapshot.select("snapshot_id").join(n(pages, "page_count"), "snapshot_id", "left").join(n(aliases, "alias_count"), "snapshot_id", "left").join(n(passages, "passage_count"), "snapshot_id", "left")
    page_key = {"snapshot_id": "snapshot_id", "page_id": "page_id"}
    results = [
        not_null(pages, ["snapshot_id", "page_id", "source_id", "url", "content_sha256"], ["page_id"]), unique(envelopes, ["batch_id", "record_type", "record_id"]),
        drift(envelopes.where("record_type = 'page'"), "record_json", PAGE_FIELDS, ["record_id"], PAGE_OPTIONAL), counts_match(snapshot, actual, ["snapshot_id"], ["page_count", "alias_count", "passage_count"]),
        referential(passages, pages, page_key, ["passage_id"]), referential(aliases, pages, {"snapshot_id": "snapshot_id", "representative_page_id": "page_id"}, ["alias_page_id"]),
        referential(pages, shaped["silver_sources"], {"snapshot_id": "snapshot_id", "source_id": "source_id"}, ["page_id"]),
    ]
    if "silver_snapshots" in lake:
        results.append(immutable(snapshot, lake["silver_snapshots"], ["snapshot_id"], ["page_count", "alias_count", "passage_count", "created_at_utc"]))
    return results


def check_envelopes(rows: DataFrame, manifest: dict) -> list[CheckResult]:
    """The rules on a batch's records beside each other and its manifest (run_id, snapshot_id, crawl_manifest_sha256, page_count, alias_count, passage_count, operational_schema)."""
    j = lambda p: F.get_json_object("record_json", f"$.{p}")
    kind = F.col("record_type")
    key = ["record_type", "record_id"]
    named = {"source": "source_id", "page": "page_id", "passage": "passage_id", "page_alias": "alias_page_id"}
    wrong_id = F.lit(False)
    for t, f in named.items():
        wrong_id = wrong_id | ((kind == t) & ~j(f).eqNullSafe(F.col("record_id")))
    owned = kind.isin("page", "passage", "page_alias")
    digest = F.sha2(F.when(kind == "page", j("content_identity")).otherwise(j("content")), 256)
    each = {
        "batch.identity": wrong_id, "batch.source": owned & ~j("source_id").eqNullSafe(F.col("source_id")), "batch.content_hash": kind.isin("page", "passage") & ~j("content_sha256").eqNullSafe(digest),
        "batch.id_form": owned & ~F.col("record_id").rlike("^[0-9a-f]{64}$"), "batch.operational": (kind == "operational") & ~(j("schema_version").eqNullSafe(F.lit(manifest["operational_schema"])) & j("run_id").eqNullSafe(F.lit(manifest["run_id"]))),
    }
    out = [result(name, rows.where(bad), key) for name, bad in each.items()] + [unique(rows, key, "batch.unique")]
    pages = rows.where("record_type = 'page'").select(F.col("record_id").alias("p"), F.col("source_id").alias("s"))
    children = rows.where(kind.isin("passage", "page_alias")).withColumn("parent", F.when(kind == "passage", j("page_id")).otherwise(j("representative_page_id")))
    known = rows.where("record_type = 'source'").select(F.col("record_id").alias("s"))
    out += [
        referential(rows.where(owned), known, {"source_id": "s"}, key, "batch.known_source"), referential(children, pages, {"parent": "p"}, key, "batch.known_page"),
        referential(children.join(pages.select(F.col("p").alias("parent")).distinct(), "parent", "left_semi"), pages, {"parent": "p", "source_id": "s"}, key, "batch.same_source"),
    ]
    counts = {c: rows.where(kind == t).count() for c, t in (("page_count", "page"), ("alias_count", "page_alias"), ("passage_count", "passage"))}

    def single(record_type: str, rule: str, wanted: list[Column]) -> CheckResult:
        """One record of its type that is all that's wanted of it."""
        found = rows.where(kind == record_type)
        good = F.lit(True)
        for w in wanted:
            good = good & F.coalesce(w, F.lit(False))
        n, ok = found.agg(F.count("*"), F.count_if(good)).first()
        return CheckResult(rule, 0 if n == ok == 1 else max(1, n - ok), () if n == ok == 1 else (f"{n} records, {ok} as they should be",))

    number = lambda p, n: F.expr(f"try_cast(get_json_object(record_json, '$.{p}') AS BIGINT)") == n
    same = [F.lit(counts[c] == manifest[c]) for c in counts]
    listed = rows.where("record_type = 'crawl_manifest'").select(F.explode(F.from_json(j("sources"), "array<struct<source_id:string>>")).alias("x")).select("x.source_id")
    sources = known.select(F.col("s").alias("source_id")).distinct()
    apart = listed.distinct().exceptAll(sources).unionAll(sources.exceptAll(listed.distinct()))
    complete = [j("status") == "complete", j("snapshot_id") == manifest["snapshot_id"]]
    return [
        *out, single("snapshot", "batch.snapshot_record", [*complete, F.col("record_id") == manifest["snapshot_id"], *same, *[number(c, counts[c]) for c in counts]]),
        single("crawl_manifest", "batch.crawl_manifest", [*complete, j("manifest_sha256") == manifest["crawl_manifest_sha256"], j("run_id") == manifest["run_id"], *[number(f"summary.{c}", manifest[c]) for c in counts]]), result("batch.crawl_sources", apart, ["source_id"]),
    ]


def event_problem(record: str = "record_json") -> Column:
    """What is wrong with an event's JSON, or null: unknown type, field set, integer fields (a boolean isn't one), version, time, ids."""
    j = lambda p: F.get_json_object(record, f"$.{p}")
    kind, names = j("event_type"), F.json_object_keys(j("data"))
    out = F.when(F.json_object_keys(record).isNull(), "not an object").when(~F.coalesce(kind.isin(*EVENT_FIELDS), F.lit(False)), "unknown event type")
    for t, fields in EVENT_FIELDS.items():
        want = F.array(*map(F.lit, sorted(fields)))
        out = out.when((kind == t) & ~F.coalesce(F.array_sort(names) == want, F.lit(False)), "field set differs")
        for f in fields:
            if f in INTEGERS:
                out = out.when((kind == t) & ~F.coalesce(j(f"data.{f}").rlike(r"^-?\d+$") & ~F.col(record).rlike(f'"{f}"\\s*:\\s*"'), F.lit(False)), f"{f} is no integer")
        time = next(f for f in fields if f.endswith("_at_utc"))
        value = j(f"data.{time}")
        out = out.when((kind == t) & ~F.coalesce(value.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)$") & F.try_to_timestamp(value).isNotNull(), F.lit(False)), "time is not RFC 3339")
    out = out.when(j("data.schema_version") != "1", "unknown version").when(F.length(F.trim(F.coalesce(j("data.event_id"), F.lit("")))) == 0, "no event id").when(F.length(F.trim(F.coalesce(j("data.crawl_run_id"), F.lit("")))) == 0, "no run id")
    return out


def check_events(events: DataFrame, known: DataFrame) -> list[CheckResult]:
    """event.schema, and event.identity: one payload per (run, event), within the input and against what is stored (crawl_run_id, event_id, payload_sha256)."""
    e = events.withColumn("__problem", event_problem())
    shown = e.where("__problem IS NOT NULL").withColumn("__id", F.coalesce("event_id", F.lit("?")))
    both = events.select("crawl_run_id", "event_id", "payload_sha256").unionByName(known.select("crawl_run_id", "event_id", "payload_sha256"))
    clash = both.groupBy("crawl_run_id", "event_id").agg(F.countDistinct("payload_sha256").alias("n")).where("n > 1")
    return [result("event.schema", shown, ["__id", "__problem"]), result("event.identity", clash, ["crawl_run_id", "event_id"])]


def split_events(events: DataFrame, known: DataFrame) -> DataFrame:
    """The disposition of every line: accepted (first of its identity), duplicate, identity_conflict or quarantined. Nothing is dropped.

    events: line (a total order), crawl_run_id, event_id, payload_sha256, record_json. This is the quarantining policy; ``check_events`` is the failing one.
    """
    from pyspark.sql import Window

    e = events.withColumn("problem", event_problem()).join(known.select("crawl_run_id", "event_id", F.col("payload_sha256").alias("known_sha")), ["crawl_run_id", "event_id"], "left")
    good = F.col("problem").isNull()
    w = Window.partitionBy("crawl_run_id", "event_id", good).orderBy("line")
    first = F.coalesce("known_sha", F.first("payload_sha256").over(w))
    state = F.when(~good, "quarantined").when(F.col("payload_sha256") != first, "identity_conflict").when(F.col("known_sha").isNotNull() | (F.row_number().over(w) > 1), "duplicate").otherwise("accepted")
    return e.withColumn("disposition", state).drop("known_sha")


def check_lake(t: Callable[[str], DataFrame], as_of: str, hours: int = 24) -> list[CheckResult]:
    """The rules on what is stored; t gives a table by name."""
    snapshots, events = t("silver_snapshots"), t("silver_crawl_events")
    n = lambda name, c: t(name).groupBy("snapshot_id").agg(F.count("*").alias(c))
    actual = snapshots.select("snapshot_id").join(n("silver_pages", "page_count"), "snapshot_id", "left").join(n("silver_page_aliases", "alias_count"), "snapshot_id", "left").join(n("silver_passages", "passage_count"), "snapshot_id", "left")
    counts = ["page_count", "alias_count", "passage_count"]
    j = lambda p: F.get_json_object("record_json", f"$.data.{p}")
    said = events.where("event_type = 'corpus_snapshot_published'").select(j("snapshot_id").alias("snapshot_id"), *[F.expr(f"try_cast(get_json_object(record_json, '$.data.{c}') AS BIGINT)").alias(c) for c in counts]).join(snapshots.select("snapshot_id"), "snapshot_id", "left_semi")
    return [
        unique(t("silver_pages"), ["snapshot_id", "page_id"], "unique.page_per_snapshot"), unique(t("silver_passages"), ["snapshot_id", "passage_id"], "unique.passage_per_snapshot"), unique(events, ["crawl_run_id", "event_id"], "unique.event"),
        counts_match(snapshots, actual, ["snapshot_id"], counts, "counts.silver_match_snapshot"), immutable(said, snapshots, ["snapshot_id"], counts, "counts.events_match_snapshot"),
        referential(snapshots, t("lineage_loads"), {"snapshot_id": "snapshot_id"}, ["snapshot_id"], "lineage.every_snapshot_traced"), freshness(snapshots, "created_at_utc", ["snapshot_id"], as_of, hours),
    ]


def check_near_duplicates(report: DataFrame, pages: DataFrame) -> CheckResult:
    """lineage.near_duplicates: a report's page counts are those of the snapshot, by origin."""
    n = pages.groupBy("snapshot_id", "origin").agg(F.count("*").alias("page_count"))
    return counts_match(report, n, ["snapshot_id", "origin"], ["page_count"], "lineage.near_duplicates")


def check_evidence(evidence: DataFrame, pages: DataFrame, sources: DataFrame) -> list[CheckResult]:
    """Tombstones name absent pages; complete assertions come from unbounded crawls without errors, with the count they assert."""
    tombs = evidence.where("kind = 'tombstone'").join(pages.select("snapshot_id", "source_id", "page_id"), ["snapshot_id", "source_id", "page_id"], "left_semi")
    said = evidence.where("kind = 'coverage' AND complete").join(sources.select("snapshot_id", "source_id", "stop_reason", "failed_count", "rejected_count", "page_count"), ["snapshot_id", "source_id"], "left")
    bad = said.where("stop_reason IS NULL OR stop_reason <> 'frontier_exhausted' OR failed_count <> 0 OR rejected_count <> 0 OR expected_page_count <> page_count")
    return [result("evidence.tombstone_absent", tombs, ["snapshot_id", "page_id"]), result("evidence.complete_assertion", bad, ["snapshot_id", "source_id"])]


def check_generation(catalog: DataFrame, postings: DataFrame, vectors: DataFrame) -> list[CheckResult]:
    """A search generation: unique ids and dense keys, ids that derive, ordinals unique per page, postings and vectors for each entry."""
    from corpuslake.functions.urls import sha256_id

    total = catalog.count()
    dense = catalog.agg(F.min("vector_key").alias("lo"), F.max("vector_key").alias("hi"), F.countDistinct("vector_key").alias("n")).where(f"n <> {total} OR lo <> 1 OR hi <> {total}") if total else catalog.limit(0).withColumns({"lo": F.lit(0), "hi": F.lit(0), "n": F.lit(0)})
    derived = catalog.where(F.col("passage_id") != sha256_id("passage", F.col("page_id").cast("string"), F.col("ordinal").cast("string"), "content"))
    return [
        unique(catalog, ["passage_id"], "generation.unique_passage"), unique(catalog, ["page_id", "ordinal"], "generation.unique_ordinal"), result("generation.dense_keys", dense, ["lo", "hi", "n"]), result("generation.derived_ids", derived, ["passage_id"]),
        referential(postings.select("passage_id").distinct(), catalog, {"passage_id": "passage_id"}, ["passage_id"], "generation.postings"), referential(catalog, vectors, {"passage_id": "passage_id"}, ["passage_id"], "generation.vectors"),
    ]
