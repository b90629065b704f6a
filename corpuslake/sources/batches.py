"""Published batches of JSON lines: reading with validation, and publishing with a marker last."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field
from itertools import islice

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslake.session import keep, numbered, scratch_path, shared_dir
from corpuslake.sources.lake import Files

ENVELOPE = "schema_version string, batch_id string, snapshot_id string, snapshot_manifest_sha256 string, crawl_manifest_sha256 string, record_type string, record_id string, source_id string, record_json string, _corrupt string"
RECORD_TYPES = ("snapshot", "source", "page", "passage", "page_alias", "crawl_manifest", "operational")
EVENT_TYPES = ("capture_committed", "crawl_completed", "corpus_snapshot_published")
#: A character that isn't white space, as Python's ``strip`` has it.
NOT_BLANK = r"[^\s\x1c-\x1f\x85\p{Z}]"
MARKER, MANIFEST, RECORDS = "_PUBLISHED", "batch-manifest.json", "records.jsonl"


class SourceError(ValueError):
    """A batch that can't be trusted."""


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with an explicit schema; lines that don't parse keep their text in ``_corrupt``."""
    return spark.read.schema(schema).option("columnNameOfCorruptRecord", "_corrupt").json(path)


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """``ref, line`` of text files without blank lines; ref is file:line, counted within each file.

    Files are read in splits. A line's number is its place in its split after the lines of the file's splits before it; lines are written once, as another scan may be split otherwise.
    """
    kept = keep(spark.read.text(path).select(F.input_file_name().alias("__path"), F.col("_metadata.file_block_start").alias("__start"), F.monotonically_increasing_id().alias("__at"), F.col("value").alias("line")), "lines")
    splits = kept.groupBy("__path", "__start").agg(F.count("*").alias("__count"), F.min("__at").alias("__first"))
    before = Window.partitionBy("__path").orderBy("__start").rowsBetween(Window.unboundedPreceding, -1)  # a row per split
    offsets = splits.select("__path", "__start", (F.coalesce(F.sum("__count").over(before), F.lit(0)) - F.col("__first") + 1).alias("__add"))
    name, number = F.element_at(F.split("__path", "/"), -1), (F.col("__at") + F.col("__add")).cast("string")
    return kept.where(F.col("line").rlike(NOT_BLANK)).join(F.broadcast(offsets), ["__path", "__start"]).select(F.concat_ws(":", name, number).alias("ref"), "line")


def stream_lines(spark: SparkSession, stream) -> DataFrame:
    """As ``text_lines`` for an open stream on the driver, as standard input: its lines go to the shared folder in bounded parts, never all to memory."""
    path, files, number, part = scratch_path(spark, "stdin"), Files(spark, shared_dir(spark)), 0, 0
    while lines := list(islice(stream, 100_000)):
        rows = [json.dumps({"ref": f"stdin:{number + i}", "line": x.rstrip("\r\n")}) for i, x in enumerate(lines, 1) if x.strip()]
        files.write(f"{path}/part-{part:05d}.json", "".join(r + "\n" for r in rows).encode())
        number, part = number + len(lines), part + 1
    return spark.read.schema("ref string, line string").json(path) if part else spark.createDataFrame([], "ref string, line string")


def event_records(lines: DataFrame) -> DataFrame:
    """Event lines with their reference, typed; a reference without a line number is an error."""
    bad = ~F.coalesce(F.col("ref").rlike(r".:\d+$"), F.lit(False))
    ref = F.when(bad, F.raise_error(F.concat(F.lit("no file:line reference: "), F.coalesce("ref", F.lit("null"))))).otherwise(F.col("ref"))
    return shape_event(lines.select(ref.alias("ref"), F.col("line").alias("record_json")))


def validate_batch(spark: SparkSession, folder: str) -> tuple[dict, DataFrame]:
    """Manifest and envelopes of a published batch: marker, checksum, exact files, counts, one batch and snapshot throughout, known types, unique keys."""
    files = Files(spark, folder)
    names = [n for n in files.names(folder) if not n.endswith(".crc")]
    if MARKER not in names:
        raise SourceError(f"{folder} is not published")
    if sorted(names) != sorted([MARKER, MANIFEST, RECORDS]):
        raise SourceError(f"unexpected files: {names}")
    raw = files.read(f"{folder}/{MANIFEST}")
    if files.read(f"{folder}/{MARKER}").decode().strip() != hashlib.sha256(raw).hexdigest():
        raise SourceError("the marker doesn't fit the manifest")
    manifest = json.loads(raw)
    rows = read_json_lines(spark, f"{folder}/{RECORDS}", ENVELOPE)
    bad = (
        F.col("_corrupt").isNotNull() | F.col("record_id").isNull() | F.col("record_json").isNull() | ~F.coalesce(F.col("record_type").isin(*RECORD_TYPES), F.lit(False))
        | ~F.col("batch_id").eqNullSafe(F.lit(manifest["batch_id"])) | ~F.col("snapshot_id").eqNullSafe(F.lit(manifest.get("snapshot_id")))
    )
    seen = rows.groupBy("record_type", "record_id").agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"))
    totals = seen.groupBy("record_type").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.max("n").alias("most")).collect()  # a row per record type
    if any(r["bad"] for r in totals) or not totals:
        raise SourceError("malformed envelopes")
    if any(r["most"] > 1 for r in totals):
        raise SourceError("repeated record keys")
    if {r["record_type"]: r["n"] for r in totals} != manifest["counts"]:
        raise SourceError("counts differ from the manifest")
    if files.digest(f"{folder}/{RECORDS}") != manifest["records_sha256"]:
        raise SourceError("records differ from their checksum")
    return manifest, rows.drop("_corrupt")


def publish_batch(spark: SparkSession, folder: str, records: DataFrame, manifest: dict, max_records: int = 1_000_000, max_bytes: int = 1 << 30) -> dict:
    """Write records in key order, the manifest, and the marker last. A batch is bounded; more is refused rather than cut, before the folder has a file.

    Tasks write the lines of sorted ranges, which are then counted and joined to one file, whose bytes pass the driver's JVM in pieces: the driver never holds the batch.
    """
    files, parts = Files(spark, folder), scratch_path(spark, "batch-lines")
    if files.names(folder):
        raise SourceError(f"{folder} exists")
    records.orderBy("record_type", "record_id").select(F.to_json(F.struct(*records.columns)).alias("value")).write.option("compression", "none").text(parts)
    lines = Files(spark, parts)
    try:
        names = sorted((n for n in lines.names(parts) if n.startswith("part-")), key=lambda n: int(n.split("-")[1]))
        kinds = spark.read.text(parts).groupBy(F.get_json_object("value", "$.record_type").alias("record_type")).count()
        counts = {r["record_type"]: r["count"] for r in kinds.collect()}  # a row per record type
        size = sum(lines.size(f"{parts}/{n}") for n in names)
        if sum(counts.values()) > max_records or size > max_bytes:
            raise SourceError("the batch is larger than its bounds")
        digest = files.join(f"{folder}/{RECORDS}", lines, [f"{parts}/{n}" for n in names])
    finally:
        lines.delete(parts)
    full = {**manifest, "counts": counts, "records_sha256": digest, "records_bytes": size}
    raw = json.dumps(full, sort_keys=True).encode()
    files.write(f"{folder}/{MANIFEST}", raw)
    files.write(f"{folder}/{MARKER}", hashlib.sha256(raw).hexdigest().encode())
    return full


def published_batches(spark: SparkSession, root: str) -> list[str]:
    """Folders below a root that carry a marker, in order."""
    files = Files(spark, root)
    out, stack = [], [root.rstrip("/")]
    while stack:
        d = stack.pop()
        for s in files.fs.listStatus(files.path(d)):
            if s.isDirectory():
                stack.append(f"{d}/{s.getPath().getName()}")
            elif s.getPath().getName() == MARKER:
                out.append(d)
    return sorted(out)


def complete_snapshots(manifests: DataFrame) -> DataFrame:
    return manifests.where("status = 'complete'").orderBy("created_at_utc", "snapshot_id")


def shape_snapshot(envelopes: DataFrame) -> dict[str, DataFrame]:
    """Bronze rows and the typed Silver rows of a batch, by record type."""
    j = lambda p: F.get_json_object("record_json", f"$.{p}")
    of = lambda t: envelopes.where(F.col("record_type") == t)
    strings = lambda p: F.from_json(j(p), "array<string>")
    page_url = F.when(F.col("record_type") == "page_alias", j("alias_url")).otherwise(j("normalized_final_url"))
    return {
        "bronze_snapshot_records": envelopes.withColumn("record_sha256", F.sha2("record_json", 256)),
        "silver_snapshots": of("snapshot").select("snapshot_id", "batch_id", j("status").alias("status"), j("created_at_utc").alias("created_at_utc"), *[F.expr(f"try_cast(get_json_object(record_json, '$.{c}') AS BIGINT)").alias(c) for c in ("page_count", "alias_count", "passage_count")]),
        "silver_sources": of("source").select("snapshot_id", F.col("record_id").alias("source_id"), F.array_join(F.array_sort(strings("allowed_origins")), ",").alias("origins")),
        "silver_pages": of("page").select("snapshot_id", F.col("record_id").alias("page_id"), "source_id", page_url.alias("url"), j("title").alias("title"), j("language").alias("language"), j("content_sha256").alias("content_sha256"), F.length(j("content")).cast("long").alias("content_chars")),
        "silver_passages": of("passage").select("snapshot_id", F.col("record_id").alias("passage_id"), j("page_id").alias("page_id"), "source_id", F.expr("try_cast(get_json_object(record_json, '$.ordinal') AS BIGINT)").alias("ordinal"), F.array_join(strings("heading_path"), " > ").alias("heading_path"), j("content").alias("content")),
        "silver_page_aliases": of("page_alias").select("snapshot_id", F.col("record_id").alias("alias_page_id"), "source_id", page_url.alias("alias_url"), j("representative_page_id").alias("representative_page_id"), j("alias_kind").alias("alias_kind")),
    }


def shape_event(events: DataFrame) -> DataFrame:
    """Typed columns of durable events, ``{event_type, data}`` in ``record_json``; the event's time is named by its type."""
    j = lambda p: F.get_json_object("record_json", f"$.{p}")
    kind = j("event_type")
    when = F.when(kind == "capture_committed", j("data.committed_at_utc")).when(kind == "crawl_completed", j("data.completed_at_utc")).when(kind == "corpus_snapshot_published", j("data.published_at_utc"))
    return events.select("*", kind.alias("event_type"), j("data.crawl_run_id").alias("crawl_run_id"), j("data.event_id").alias("event_id"), j("data.source_id").alias("source_id"), when.alias("event_at"), F.sha2("record_json", 256).alias("payload_sha256"))


def evaluation_package(spark: SparkSession, folder: str) -> dict[str, DataFrame | dict]:
    """metadata, queries, judgments and, if there, rankings (one row per query)."""
    files = Files(spark, folder)
    out: dict = {"metadata": json.loads(files.read(f"{folder}/metadata.json"))}
    out["queries"] = spark.read.schema("query_id string, query string, source string, intent string, split string, expected_page_candidates array<string>").json(f"{folder}/queries.jsonl")
    out["judgments"] = spark.read.schema("query_id string, page_id string, grade int, judge_id string, adjudicated_grade int, judge_grades map<string,int>").json(f"{folder}/judgments.jsonl")
    if "rankings.jsonl" in files.names(folder):
        r = spark.read.schema("query_id string, keyword array<string>, semantic array<string>, hybrid array<string>").json(f"{folder}/rankings.jsonl")
        if r.groupBy("query_id").count().where("count <> 1").head(1) or r.join(out["queries"], "query_id", "left_anti").head(1) or out["queries"].join(r, "query_id", "left_anti").head(1):
            raise SourceError("rankings need exactly one row per query")
        stacked = F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), F.col(m).alias("pages")) for m in ("keyword", "semantic", "hybrid")]))
        out["rankings"] = r.select("query_id", stacked.alias("x")).select("query_id", "x.mode", F.posexplode("x.pages").alias("pos", "page_id")).withColumn("rank", F.col("pos") + 1).drop("pos")
    return out


def read_vectors(spark: SparkSession, path: str, magic: bytes) -> DataFrame:
    """``vector_key, vector`` of files: magic, dims (u32), count (u64), then rows of f32, all little-endian."""
    import numpy as np
    import pyarrow as pa

    head = len(magic)

    def run(batches):
        for b in batches:
            for content in b.column("content").to_pylist():
                if content[:head] != magic:
                    raise SourceError("not a vector file")
                dims, count = int.from_bytes(content[head : head + 4], "little"), int.from_bytes(content[head + 4 : head + 12], "little")
                x = np.frombuffer(content, "<f4", offset=head + 12)
                if len(x) != dims * count:
                    raise SourceError("a vector file is cut short")
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(1, count + 1)), pa.FixedSizeListArray.from_arrays(pa.array(x), dims).cast(pa.list_(pa.float32()))], names=["vector_key", "vector"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "vector_key bigint, vector array<float>")


@dataclass
class LoadReport:
    inserted: dict[str, int] = field(default_factory=dict)
    versions: dict[str, int | None] = field(default_factory=dict)

    def add(self, table: str, version: int | None, rows: int) -> None:
        self.inserted[table], self.versions[table] = rows, version


#: Written in this order: the row of the snapshot itself makes the load visible.
WRITE_ORDER = ("bronze_snapshot_records", "silver_sources", "silver_pages", "silver_passages", "silver_page_aliases", "silver_snapshots")


def load_snapshot(tables: dict, shaped: dict[str, DataFrame], metadata: dict) -> LoadReport:
    """Insert-only writes in order; a second load of the same batch inserts nothing and commits nothing."""
    report = LoadReport()
    for name in WRITE_ORDER:
        report.add(name, *tables[name].merge_insert(shaped[name], metadata))
    return report


def write_digested(df: DataFrame, folder: str, order: list[str], max_part_rows: int = 100_000) -> str:
    """JSON lines in a total order, and one digest over them: rows are numbered by ranges, parts of ``max_part_rows`` hash their own lines, and the digest is that of the part digests in order.

    A digest of digests needs no single writer; it depends on the rows, the order and ``max_part_rows`` alone. Files hold the rows in order, by name.
    """
    lines = df.select(*order, F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))
    n = numbered(lines, order, "__n", "digested").withColumn("part", F.floor((F.col("__n") - 1) / max_part_rows))
    parts = n.groupBy("part").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__n", "value"))), lambda x: x["value"]), "\n"), 256).alias("sha")).orderBy("part")
    digest = hashlib.sha256()
    for r in parts.toLocalIterator():
        digest.update(r["sha"].encode())
    n.repartitionByRange("__n").sortWithinPartitions("__n").select("value").write.text(folder)
    return digest.hexdigest()


def snapshot_identity(config_digest: str, pages: DataFrame, passages: DataFrame) -> str:
    """``snapshot-`` and the SHA-256 of the configuration's digest, NUL, the pages' JSON as an array, NUL, and the passages' (aliases don't count).

    pages: source_id, url, payload_json; passages: the same and ordinal. Both are hashed in byte order of these. The digest is sequential by its definition, so rows stream to the
    driver from sorted ranges, a partition at a time, and none is kept.
    """
    digest = hashlib.sha256(config_digest.encode() + b"\0")
    for k, (df, order) in enumerate(((pages, ["source_id", "url"]), (passages, ["source_id", "url", "ordinal"]))):
        digest.update(b"\0[" if k else b"[")
        for i, r in enumerate(df.orderBy(*order).select("payload_json").toLocalIterator(prefetchPartitions=True)):
            digest.update(("," if i else "").encode() + r["payload_json"].encode())
        digest.update(b"]")
    return f"snapshot-{digest.hexdigest()}"


def export_snapshot(spark: SparkSession, folder: str, manifest: dict, pages: DataFrame, passages: DataFrame, aliases: DataFrame, sources: DataFrame, near: DataFrame | None = None) -> dict:
    """Publish a sealed snapshot's tables as one batch (see ``publish_batch``), each row in its envelope; ``near``, a report by origin, goes to a sidecar beside the records' folder."""
    envelope = lambda df, kind, key: df.select(
        F.lit("1").alias("schema_version"), F.lit(manifest["batch_id"]).alias("batch_id"), F.lit(manifest.get("snapshot_id")).alias("snapshot_id"), F.lit(manifest.get("snapshot_manifest_sha256")).alias("snapshot_manifest_sha256"),
        F.lit(manifest.get("crawl_manifest_sha256")).alias("crawl_manifest_sha256"), F.lit(kind).alias("record_type"), F.col(key).cast("string").alias("record_id"), F.col("source_id").cast("string").alias("source_id"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("record_json"),
    )
    rows = envelope(sources, "source", "source_id")
    for df, kind, key in ((pages, "page", "page_id"), (passages, "passage", "passage_id"), (aliases, "page_alias", "alias_page_id")):
        rows = rows.unionByName(envelope(df, kind, key))
    if near is not None:
        near.write.mode("overwrite").json(f"{folder}-near-duplicates")
    return publish_batch(spark, folder, rows, manifest)


def near_sidecar(spark: SparkSession, folder: str) -> DataFrame:
    """The near-duplicate report beside an exported snapshot; empty where there is none."""
    schema, path = "snapshot_id string, origin string, page_count bigint, near_duplicate_page_count bigint", f"{folder}-near-duplicates"
    return spark.read.schema(schema).json(path) if Files(spark, folder).names(path) else spark.createDataFrame([], schema)
