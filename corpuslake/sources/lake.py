"""A small versioned table format on Parquet: a log of commits over immutable data folders.

``<root>/<table>/_log/<version>.json`` lists added and removed data folders, row count and metadata; ``data/<uuid>`` holds the Parquet. A commit
writes data first and then creates its log entry exclusively, so that of two writers of a version one fails (and may retry). Readers fold the log. Nothing is updated in place.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Conflict(RuntimeError):
    """Another writer made this version."""


class Files:
    """The few file operations of the log, through Hadoop, so that any store Spark reaches will do."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path(root).getFileSystem(self.conf)

    def path(self, p: str):
        return self.jvm.org.apache.hadoop.fs.Path(p)

    def names(self, folder: str) -> list[str]:
        return sorted(x.getPath().getName() for x in self.fs.listStatus(self.path(folder))) if self.fs.exists(self.path(folder)) else []

    def read(self, p: str) -> bytes:
        stream = self.fs.open(self.path(p))
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def write(self, p: str, data: bytes, overwrite: bool = False) -> None:
        stream = self.fs.create(self.path(p), overwrite)
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()

    def size(self, p: str) -> int:
        return self.fs.getFileStatus(self.path(p)).getLen()

    def _copy(self, p: str, out) -> None:
        stream = self.fs.open(self.path(p))
        try:
            self.jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 1 << 20)
        finally:
            stream.close()

    def digest(self, p: str) -> str:
        """SHA-256 of a file of any size: the JVM reads it in pieces, none of which comes to Python."""
        sha = self.jvm.java.security.MessageDigest.getInstance("SHA-256")
        self._copy(p, self.jvm.java.security.DigestOutputStream(self.jvm.java.io.OutputStream.nullOutputStream(), sha))
        return bytes(sha.digest()).hex()

    def join(self, p: str, source: Files, parts: list[str]) -> str:
        """Files of ``source`` moved into one, in order, in pieces as above; its SHA-256. Each goes once it is copied, so that the rows are on disk once."""
        sha = self.jvm.java.security.MessageDigest.getInstance("SHA-256")
        out = self.jvm.java.security.DigestOutputStream(self.fs.create(self.path(p)), sha)
        try:
            for x in parts:
                source._copy(x, out)
                source.delete(x)
        finally:
            out.close()
        return bytes(sha.digest()).hex()

    def create_new(self, p: str, data: bytes) -> None:
        """Fails if the file is there: written aside, then renamed without overwriting (local files: linked, which is exclusive)."""
        if self.fs.exists(self.path(p)):
            raise Conflict(p)
        if self.fs.getUri().getScheme() == "file":
            local = self.path(p).toUri().getPath()
            os.makedirs(os.path.dirname(local), exist_ok=True)
            try:
                fd = os.open(local, os.O_WRONLY | os.O_CREAT | os.O_EXCL)
            except FileExistsError as e:
                raise Conflict(p) from e
            with os.fdopen(fd, "wb") as f:
                f.write(data)
            return
        aside = f"{p}.{uuid.uuid4().hex}"
        self.write(aside, data)
        if not self.fs.rename(self.path(aside), self.path(p)):
            self.fs.delete(self.path(aside), False)
            raise Conflict(p)

    def delete(self, p: str) -> None:
        self.fs.delete(self.path(p), True)

    def move(self, a: str, b: str) -> None:
        if self.fs.exists(self.path(b)):
            raise Conflict(b)
        if not self.fs.rename(self.path(a), self.path(b)):
            raise OSError(f"{a} -> {b}")


class Table:
    """One table of a lake: a schema, its natural key, and a log."""

    def __init__(self, spark: SparkSession, root: str, name: str, schema: T.StructType | str, keys: Iterable[str]) -> None:
        self.spark, self.name, self.keys = spark, name, list(keys)
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.root = f"{root.rstrip('/')}/{name}"
        self.files = Files(spark, root)

    # -------------------------------------------------------- the log
    def history(self) -> list[dict]:
        return [json.loads(self.files.read(f"{self.root}/_log/{n}")) for n in self.files.names(f"{self.root}/_log") if n.endswith(".json")]

    def version(self) -> int:
        """Number of the last commit; -1 before the first."""
        names = [n for n in self.files.names(f"{self.root}/_log") if n.endswith(".json")]
        return int(names[-1][:20]) if names else -1

    def live(self, version: int | None = None) -> list[str]:
        out: list[str] = []
        for e in self.history():
            if version is not None and e["version"] > version:
                break
            out = [d for d in out if d not in e["removed"]] + e["added"]
        return out

    def read(self, version: int | None = None) -> DataFrame:
        """The current or an earlier version; an absent table is empty with its schema."""
        folders = [f"{self.root}/{d}" for d in self.live(version)]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def _commit(self, df: DataFrame | None, removed: list[str], metadata: dict, rows: int) -> int:
        version, added = self.version() + 1, []
        if df is not None:
            added = [f"data/{uuid.uuid4().hex}"]
            df.select([F.col(f.name).cast(f.dataType) for f in self.schema.fields]).write.parquet(f"{self.root}/{added[0]}")
        entry = {"version": version, "added": added, "removed": removed, "rows": rows, "metadata": metadata}
        self.files.create_new(f"{self.root}/_log/{version:020d}.json", json.dumps(entry, sort_keys=True).encode())
        return version

    # -------------------------------------------------------- writes
    def merge_insert(self, df: DataFrame, metadata: dict | None = None) -> tuple[int | None, int]:
        """Insert rows whose key is new, one for each key; without any there is no commit: ``(version or None, rows inserted)``.

        Of rows that share a key the least in column order is inserted, so that a repeated task or load inserts the same.
        """
        from corpuslake.session import Kept

        others = [c for c in df.columns if c not in self.keys]
        one = df.groupBy(*self.keys).agg(F.min(F.struct(*others)).alias("__o")).select(*self.keys, "__o.*") if others else df.select(self.keys).distinct()
        fresh = Kept(one.join(self.read().select(self.keys), self.keys, "left_anti").select(df.columns), f"merge-{self.name}")
        n = fresh.df.count()
        version = self._commit(fresh.df, [], metadata or {}, n) if n else None
        fresh.drop()
        return version, n

    def append(self, df: DataFrame, metadata: dict | None = None) -> int | None:
        """Add rows whose keys the caller knows to be new; the version, or None without rows."""
        from corpuslake.session import Kept

        rows = Kept(df.select([f.name for f in self.schema.fields]), f"append-{self.name}")
        n = rows.df.count()
        version = self._commit(rows.df, [], metadata or {}, n) if n else None
        rows.drop()
        return version

    def merge_append_only(self, df: DataFrame, immutable: list[str], metadata: dict | None = None) -> tuple[int | None, int]:
        """As above, but a known key with another value in an immutable column is an error."""
        known = self.read().select(*self.keys, *[F.col(c).alias(f"__{c}") for c in immutable])
        differs = F.lit(False)
        for c in immutable:
            differs = differs | ~F.col(c).eqNullSafe(F.col(f"__{c}"))
        if bad := df.join(known, self.keys).where(differs).select(self.keys).limit(5).collect():
            raise ValueError(f"{self.name}: changed rows for known keys: {[tuple(r) for r in bad]}")
        return self.merge_insert(df, metadata)

    def merge_history(self, df: DataFrame, immutable: list[str], time: str, batch: str, metadata: dict | None = None) -> int:
        """Upsert observations: one variant per key, earliest time and batch win, immutable columns never change."""
        w = Window.partitionBy(*self.keys)
        variants = df.groupBy(*self.keys).agg(F.countDistinct(F.to_json(F.struct(*immutable), {"ignoreNullFields": "false"})).alias("n")).where("n > 1")
        if variants.head(1):
            raise ValueError(f"{self.name}: several variants of a key in one batch")
        first = df.withColumn("__r", F.row_number().over(w.orderBy(F.col(time).asc_nulls_first(), batch))).where("__r = 1").drop("__r")
        both = self.read().withColumn("__new", F.lit(0)).unionByName(first.select([f.name for f in self.schema.fields]).withColumn("__new", F.lit(1)))
        shape = F.to_json(F.struct(*immutable), {"ignoreNullFields": "false"})
        if both.groupBy(*self.keys).agg(F.countDistinct(shape).alias("n")).where("n > 1").head(1):
            raise ValueError(f"{self.name}: immutable columns changed")
        others = [f.name for f in self.schema.fields if f.name not in (*self.keys, time, batch)]
        merged = both.groupBy(*self.keys).agg(F.min(time).alias(time), F.min(batch).alias(batch), *[F.min_by(c, "__new").alias(c) for c in others])
        n = merged.count()
        return self._commit(merged, self.live(), metadata or {}, n)

    def overwrite(self, df: DataFrame, metadata: dict | None = None) -> int:
        return self._commit(df, self.live(), metadata or {}, -1)

    def compact(self, folders: int = 8, metadata: dict | None = None) -> int | None:
        """One data folder in place of more than so many, with the same rows; the version, or None where there are no more."""
        live = self.live()
        return self._commit(self.read(), live, {**(metadata or {}), "input_kind": "compaction"}, 0) if len(live) > folders else None

    def vacuum(self, keep_versions: int = 2) -> list[str]:
        """Delete data folders that no kept version reads; returns them."""
        last = self.version()
        wanted = {d for v in range(max(0, last - keep_versions + 1), last + 1) for d in self.live(v)}
        gone = [f"data/{d}" for d in self.files.names(f"{self.root}/data") if f"data/{d}" not in wanted]
        for d in gone:
            self.files.delete(f"{self.root}/{d}")
        return gone


def latest_status(log: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Control rows are appended; the latest by order is the state of its key."""
    w = Window.partitionBy(*keys).orderBy(*[c.desc() for c in order])
    return log.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


# ------------------------------------------------------------ sealed folders and pointers
def batch_status(log: DataFrame, started: DataFrame, finished: DataFrame) -> DataFrame:
    """A control table after attempts: of each batch ``status, attempts, retries`` (rows of ``log`` are earlier states). started, finished: batch_id; a batch that is complete stays so, however
    often it is started again; a start without a finish leaves it processing."""
    was = latest_status(log, ["batch_id"], [F.col("attempts")]).select("batch_id", F.col("status").alias("was"), F.col("attempts").alias("had"))
    n = started.groupBy("batch_id").agg(F.count("*").alias("n"))
    done = finished.select("batch_id").distinct().withColumn("done", F.lit(True))
    j = was.join(n, "batch_id", "full").join(done, "batch_id", "left")
    attempts = (F.coalesce("had", F.lit(0)) + F.coalesce("n", F.lit(0))).cast("long")
    status = F.when((F.col("was") == "complete") | F.col("done"), "complete").otherwise("processing")
    return j.select("batch_id", status.alias("status"), attempts.alias("attempts"), F.greatest(F.lit(0), attempts - 1).cast("long").alias("retries"))


def publish_folder(spark: SparkSession, staged: str, final: str) -> None:
    """Make a staged folder visible in one rename; an existing one is refused."""
    Files(spark, final).move(staged, final)


class Generations:
    """Sealed generations with a current and a previous pointer."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.root, self.files = root.rstrip("/"), Files(spark, root)

    def _pointer(self, name: str) -> str | None:
        return self.files.read(f"{self.root}/{name}").decode() if name in self.files.names(self.root) else None

    def current(self) -> str | None:
        """The current generation, or the previous one if the current is gone."""
        there = set(self.files.names(self.root))
        return next((g for p in ("CURRENT", "PREVIOUS") if (g := self._pointer(p)) in there), None)

    def activate(self, generation: str) -> None:
        if generation not in self.files.names(self.root):
            raise FileNotFoundError(generation)
        if (now := self._pointer("CURRENT")) and now != generation:
            self.files.write(f"{self.root}/PREVIOUS", now.encode(), True)
        self.files.write(f"{self.root}/CURRENT", generation.encode(), True)

    def prune(self, protect: Iterable[str] = ()) -> list[str]:
        """Remove generations that nothing points to."""
        held = {self._pointer("CURRENT"), self._pointer("PREVIOUS"), *protect, "CURRENT", "PREVIOUS"}
        gone = [g for g in self.files.names(self.root) if g not in held]
        for g in gone:
            self.files.delete(f"{self.root}/{g}")
        return gone


# ------------------------------------------------------------ lineage and Gold refresh
def lineage(tables: Iterable[Table], target: Table) -> int:
    """One row per (table, version) from the logs, inserted once; a later run repairs what an earlier one missed."""
    rows = [
        (t.name, e["version"], e["rows"], *(e["metadata"].get(k) for k in ("load_id", "run_id", "snapshot_id", "batch_id", "input_kind", "input_ref", "silver_versions")))
        for t in tables for e in t.history()
    ]  # fmt: skip  one entry per commit
    schema = "table_name string, table_version bigint, row_count bigint, load_id string, run_id string, snapshot_id string, batch_id string, input_kind string, input_ref string, silver_versions string"
    return target.merge_insert(target.spark.createDataFrame(rows, schema))[1] if rows else 0


def lineage_report(table: DataFrame) -> DataFrame:
    """Versions with what they were built from."""
    built = F.when(F.col("input_kind") == "gold_refresh", F.col("silver_versions")).otherwise(F.coalesce("snapshot_id", "batch_id", "input_ref"))
    return table.select("table_name", "table_version", "run_id", "snapshot_id", built.alias("built_from")).orderBy("table_name", "table_version")


def refresh_gold(silver: list[Table], gold: dict[Table, DataFrame], metadata: dict | None = None) -> bool:
    """Rebuild Gold tables only if a Silver version moved since the last refresh."""
    vector = ",".join(f"{t.name}={t.version()}" for t in sorted(silver, key=lambda t: t.name))
    if all(h and h[-1]["metadata"].get("silver_versions") == vector for h in (t.history() for t in gold)):
        return False
    for t, df in gold.items():
        t.overwrite(df, {**(metadata or {}), "input_kind": "gold_refresh", "silver_versions": vector})
    return True
