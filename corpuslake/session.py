"""Session settings and shared scratch space."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def build_session(app: str = "corpuslake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that every query here assumes (UTC, ANSI, AQE)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or where it is unset (tests) a temporary one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    known = spark.sparkContext.getCheckpointDir() if hasattr(spark.sparkContext, "getCheckpointDir") else None
    if known:
        return known.rstrip("/")
    made = tempfile.mkdtemp(prefix="corpuslake-")
    atexit.register(shutil.rmtree, made, True)
    spark.sparkContext.setCheckpointDir(f"file://{made}")
    return f"file://{made}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; Hadoop removes it when the session's JVM ends."""
    path = f"{shared_dir(spark)}/corpuslake/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Kept:
    """A DataFrame written as Parquet to the shared folder and read again: lineage ends there."""

    def __init__(self, df: DataFrame, label: str) -> None:
        spark = df.sparkSession
        self.spark, self.path = spark, scratch_path(spark, label)
        df.write.option("compression", "zstd").parquet(self.path)
        self.df = spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        drop_path(self.spark, self.path)


def keep(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage of ``df`` with a written table in the shared folder."""
    return Kept(df, label).df


def numbered(df: DataFrame, order: list[str], name: str, label: str = "numbered") -> DataFrame:
    """``df`` with a dense number from 1 in a total order, in the column ``name``.

    Rows are sorted by ranges and counted within each; the ranges' offsets, one row each, are added up. No task sees more than its range.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    within = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    kept = keep(ranges.withColumns({"__range": F.spark_partition_id(), "__within": within}), label)
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    counts = kept.groupBy("__range").agg(F.count("*").alias("__count"))
    offsets = counts.select("__range", F.coalesce(F.sum("__count").over(before), F.lit(0)).alias("__before"))
    return kept.join(F.broadcast(offsets), "__range").withColumn(name, (F.col("__before") + F.col("__within") + 1).cast("long")).drop("__range", "__within", "__before")


def bucketed(df: DataFrame, key: str, label: str) -> DataFrame:
    """``df`` written once, dealt by a hash of ``key`` into as many buckets as there are shuffle partitions: later joins on that key move the other side alone."""
    spark = df.sparkSession
    n, path = int(spark.conf.get("spark.sql.shuffle.partitions")), scratch_path(spark, label)
    name = f"corpuslake_{label.replace('-', '_')}_{uuid.uuid4().hex}"
    writer = df.repartition(n, key).write.format("parquet").option("compression", "zstd").option("path", path)
    writer.bucketBy(n, key).sortBy(key).saveAsTable(name)
    atexit.register(_drop_table, spark, name)
    return spark.table(name)


def _drop_table(spark: SparkSession, name: str) -> None:
    try:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    except Exception:  # noqa: BLE001  the session may have ended already
        pass


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of plans nothing refers to any more."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()
