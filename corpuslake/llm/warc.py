"""WARC archives: a deterministic sharded writer with revisit records, and a reader.

Writing: payload digests group the records; each group's smallest id answers, the others revisit it. Records are range-sorted by id into shards
of a fixed width of ids (so names and contents depend on the rows alone, not on the cluster); a shard with many more rows than ids (an id that repeats, or null)
is cut into parts by hash of id and digest, as many as its row count asks for. Each part is one or more files, rolled by
compressed size, each opened by a ``warcinfo`` record. A task writes under a temporary name of its own attempt and reports what it wrote; the reports are the manifest. A second
job renames exactly the files of the manifest, and the manifest with its marker is written last. A lost or repeated task leaves only
temporary files that no manifest names. Headers, record ids and digests are regenerated from the rows, never copied.

Reading takes the files that a committed manifest names, checks block digests, and returns one row per record.

Files are reached through ``pyarrow.fs`` by URI, so that executors write to the same store that Spark reads (``s3a`` and ``s3n`` are its ``s3``); a scheme that only
Hadoop knows is an error.

Cases: a null or empty payload is a record of no bytes; payloads under ``MIN_REVISIT`` bytes are always responses; a null id sorts first, never
answers for others and never revisits; rows repeating an id are records of their own, and all rows of a group that carry the smallest id are
responses; a null url is written as ``urn:none``; control characters in a url are percent-encoded; an empty table gives an empty, committed
manifest. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.llm.common import need
from corpuslake.session import drop_path, keep

#: Least payload that a revisit stands for; ids in a shard; compressed bytes at which a file is rolled; the date written to every record.
MIN_REVISIT, SHARD_IDS, ROLL_BYTES, DATE = 100, 1_024, 8 << 20, "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "warc-record")
_REPORT = "shard bigint, cut int, part int, temporary string, name string, records bigint, bytes bigint, sha256 string"


def _fs(uri: str):
    from pyarrow import fs

    scheme, mark, rest = uri.partition("://")
    return fs.FileSystem.from_uri("s3://" + rest if mark and scheme in ("s3a", "s3n") else uri)


def record_id(key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, key)}>"


def record(page_id: int | None, copy: int, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record, uncompressed; copy counts earlier rows of the same id and payload."""
    digest = hashlib.sha256(payload).hexdigest()
    head = HTTP_HEAD % len(payload)
    block = head if refers_to is not None else head + payload
    target = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url) if url else "urn:none"
    lines = [
        "WARC/1.0",
        f"WARC-Type: {'revisit' if refers_to is not None else 'response'}",
        f"WARC-Record-ID: {record_id(f'{page_id}/{digest}/{copy}')}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(f'{refers_to}/{digest}/0')}", f"X-Refers-To-Page: {refers_to}"]
    if page_id is not None:
        lines.append(f"X-Page: {page_id}")
    lines += [f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def info(name: str) -> bytes:
    """The record that opens a file."""
    block = b"software: corpuslake\r\nformat: WARC File Format 1.0\r\n"
    lines = ["WARC/1.0", "WARC-Type: warcinfo", f"WARC-Record-ID: {record_id(f'info/{name}')}", f"WARC-Date: {DATE}", f"WARC-Filename: {name}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    """One gzip member without a time, so that equal records have equal bytes."""
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def _writer(out: str, roll: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _fs(out)
        attempt = uuid.uuid4().hex
        sink = None
        done: list[tuple] = []
        shard = previous = None
        part = records = size = copy = 0
        digest, temporary, name = hashlib.sha256(), "", ""

        def close() -> None:
            nonlocal sink, part
            if sink is not None:
                sink.close()
                sink = None
                done.append((*shard, part, temporary, name, records, size, digest.hexdigest()))
                part += 1

        for b in batches:
            for *s, page, url, refers, same, payload in zip(*[b.column(c).to_pylist() for c in ("shard", "cut", "page_id", "url", "refers_to", "digest", "payload")]):
                if s != shard:
                    close()
                    shard, part, previous = s, 0, None
                copy = copy + 1 if previous == (page, same) else 0
                previous = (page, same)
                data = _member(record(page, copy, url, payload or b"", refers))
                if sink is not None and size + len(data) > roll:
                    close()
                if sink is None:
                    stem = f"{shard[0] + 2**63:020d}-{shard[1]:05d}-{part:05d}"
                    temporary, name = f"_temporary/{attempt}/{stem}", f"shard-{stem}.warc.gz"
                    fs.create_dir(f"{root}/_temporary/{attempt}", recursive=True)
                    sink, records, size, digest = fs.open_output_stream(f"{root}/{temporary}"), 0, 0, hashlib.sha256()
                    data = _member(info(name)) + data
                sink.write(data)
                digest.update(data)
                records, size = records + 1, size + len(data)
        close()
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
        columns = list(zip(*done)) or [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["shard", "cut", "part", "temporary", "name", "records", "bytes", "sha256"])

    return run


def _renamer(out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pafs

        fs, root = _fs(out)
        for b in batches:
            for t, n in zip(b.column("temporary").to_pylist(), b.column("name").to_pylist()):
                # A repeated task finds some already renamed.
                if fs.get_file_info(f"{root}/{t}").type != pafs.FileType.NotFound:
                    fs.move(f"{root}/{t}", f"{root}/{n}")
                elif fs.get_file_info(f"{root}/{n}").type == pafs.FileType.NotFound:
                    raise FileNotFoundError(f"{root}/{n}")
            yield b

    return run


def write(pages: DataFrame, out: str, page_id: str = "page_id", url: str = "url", payload: str = "html", shard_ids: int = SHARD_IDS, roll: int = ROLL_BYTES) -> DataFrame:
    """Write ``pages`` as archives under the URI ``out`` and return the committed manifest (one row per file)."""
    need(pages, page_id, url, payload)
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("large", (F.octet_length("payload") >= MIN_REVISIT) & F.col("page_id").isNotNull())
    first = rows.where("large").groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("final")).where("first < final")
    first = keep(first.select(F.col("digest").alias("of"), "first"), "firsts")
    refers = F.when(F.col("page_id") > F.col("first"), F.col("first"))
    joined = rows.join(first, F.col("large") & (F.col("digest") == F.col("of")), "left")
    shard = F.coalesce(F.floor(F.col("page_id") / shard_ids).cast("long"), F.lit(-(2**62)))
    # Shards of many more rows than ids: few, if any. All copies of a row's id and payload lie in one part, so that they are counted there.
    full = keep(rows.groupBy(F.coalesce(F.floor(F.col("page_id") / shard_ids).cast("long"), F.lit(-(2**62))).alias("__shard")).agg(F.count("*").alias("__rows")).where(F.col("__rows") > 4 * shard_ids), "full")
    cut = F.pmod(F.xxhash64("page_id", "digest"), F.ceil(F.coalesce("__rows", F.lit(1)) / (4 * shard_ids)).cast("long")).cast("int")
    dealt = joined.withColumn("shard", shard).join(full, F.col("shard") == F.col("__shard"), "left")
    dealt = dealt.select("shard", cut.alias("cut"), "page_id", "url", refers.alias("refers_to"), "payload", "digest")
    sorted_rows = dealt.repartitionByRange("shard", "cut").sortWithinPartitions("shard", "cut", "page_id", "digest", "url")
    manifest = keep(sorted_rows.mapInArrow(_writer(out, roll), _REPORT), "manifest")
    named = manifest.repartition(F.col("name")).mapInArrow(_renamer(out), _REPORT)
    named.select("shard", "cut", "part", "name", "records", "bytes", "sha256").write.mode("overwrite").parquet(f"{out}/_manifest")
    drop_path(pages.sparkSession, f"{out}/_temporary")
    return pages.sparkSession.read.parquet(f"{out}/_manifest")


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of one archive, a gzip member at a time."""
    view = memoryview(data)
    at = 0
    while at < len(view):
        d = zlib.decompressobj(31)
        text = d.decompress(view[at:])
        if not d.eof:
            raise ValueError("an archive ends within a record")
        at = len(view) - len(d.unused_data)
        head, _, rest = text.partition(b"\r\n\r\n")
        version, *lines = head.decode().split("\r\n")
        headers = dict(x.split(": ", 1) for x in lines)
        block = rest[: int(headers["Content-Length"])]
        if not version.startswith("WARC/") or f"sha256:{hashlib.sha256(block).hexdigest()}" != headers["WARC-Block-Digest"]:
            raise ValueError(f"a broken record: {headers.get('WARC-Record-ID')}")
        yield headers, block


_ROWS = "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary"


def _reader(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
        names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
        for b in batches:
            for i in range(len(b)):
                out: list[tuple] = []
                for h, block in parse(b.column("content")[i].as_buffer().to_pybytes()):
                    kind, payload = h["WARC-Type"], block.partition(b"\r\n\r\n")[2]
                    if kind == "warcinfo":
                        continue
                    digest, n = h["WARC-Payload-Digest"].removeprefix("sha256:"), int(h["X-Payload-Length"])
                    if kind == "response" and (len(payload) != n or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"a payload differs from its digest: {h['WARC-Record-ID']}")
                    page, refers = h.get("X-Page"), h.get("X-Refers-To-Page")
                    out.append((page and int(page), h["WARC-Target-URI"], kind, n, digest, refers and int(refers), payload if with_payload and kind == "response" else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [[]] * 7, kinds)], names=names)

    return run


def read(spark: SparkSession, out: str, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives that the committed manifest under ``out`` names; payload is null for revisits."""
    manifest = spark.read.parquet(f"{out}/_manifest")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.warc.gz").load(out)
    files = files.withColumn("name", F.element_at(F.split("path", "/"), -1)).join(manifest.select("name"), "name", "left_semi")
    return files.select("content").mapInArrow(_reader(with_payload), _ROWS)
