"""Packing by optimal length buckets.

The global histogram of lengths (a map-side combined aggregate) goes to the driver; dynamic programming finds the ``buckets`` upper bounds
that minimise total padding when every document is padded to the bound of its bucket. Inside a bucket of bound b, batches hold
``budget // b`` documents (one at least), so that a padded batch stays within the token budget. A bucket's documents stand in the order of
(doc_id mod chunks, doc_id); places come from counts of these chunks and a rank inside each, so no bucket is ever sorted in one task, and only a
bucket's last batch is short.

The histogram has one entry per distinct length, at most the longest length; n of them take at least n²/2 words of text, so that the driver's
table grows with the square root of the input. The result is always exactly optimal.

Cases: null texts have length 0; documents of length 0 are in the first bucket, whose bound is at least 1; a document above the budget is
a batch of its own; equal lengths share a bucket; with fewer distinct lengths than buckets each gets its own bound; of equally good bounds the
program takes those with the earlier split; rows that repeat, or have a null id, are each placed; an empty table gives an empty result; extra
columns pass through, but for those named like an output.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.llm.common import need
from corpuslake.session import keep

#: Buckets; tokens in a batch, in whatever unit the lengths count; documents in a chunk.
BUCKETS, BUDGET, CHUNK = 8, 16_384, 2_048


def optimal_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """Upper bounds that minimise padding; lengths ascending and distinct.

    best_k(j) = min over i < j of best_{k-1}(i) + l_j (C_j - C_i) - (S_j - S_i): for each k lines of slope -C_i, asked at rising l_j, so the
    lower envelope answers all j in linear time.
    """
    m = len(lengths)
    if not m:
        return []
    ls = [int(x) for x in lengths]
    c = [0, *np.cumsum(counts).tolist()]
    s = [0, *np.cumsum(lengths.astype(object) * counts.astype(object)).tolist()]
    best = [0] + [None] * m
    cuts: list[list[int]] = []
    for _ in range(min(buckets, m)):
        hull: list[tuple[int, int, int]] = []  # slope, intercept, i
        head, now, cut = 0, [None] * (m + 1), [0] * (m + 1)
        for j in range(1, m + 1):
            i = j - 1
            if best[i] is not None:
                line = (-c[i], best[i] + s[i], i)
                while len(hull) - head >= 2 and (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - line[0]) > (line[1] - hull[-2][1]) * (hull[-2][0] - hull[-1][0]):
                    hull.pop()
                hull.append(line)
            x = ls[j - 1]
            while head + 1 < len(hull) and hull[head + 1][0] * x + hull[head + 1][1] < hull[head][0] * x + hull[head][1]:
                head += 1
            if head < len(hull):
                now[j] = hull[head][0] * x + hull[head][1] + x * c[j] - s[j]
                cut[j] = hull[head][2]
        cuts.append(cut)
        best = now
    # More buckets never pad more, so all that there are lengths for are used.
    bounds, j = [], m
    for cut in reversed(cuts):
        bounds.append(ls[j - 1])
        j = cut[j]
    return bounds[::-1]


def bounds_of(df: DataFrame, length: str, buckets: int = BUCKETS) -> list[int]:
    counted = df.groupBy(F.greatest(F.col(length), F.lit(1)).cast("long").alias("l")).agg(F.count("*").alias("n"))
    table = counted.orderBy("l").toPandas()
    return optimal_bounds(table["l"].to_numpy(), table["n"].to_numpy(), buckets)


def pack(df: DataFrame, length: str, doc_id: str = "doc_id", buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """The rows of ``df`` with ``bucket int`` (from 0), ``bucket_length``, ``batch_id bigint`` (from 0 in each bucket), ``batch_slot int``, ``padding``."""
    need(df, length, doc_id)
    spark = df.sparkSession
    made = ["bucket", "bucket_length", "batch_id", "batch_slot", "padding"]
    rows = df.drop(*[c for c in made if c in df.columns])
    bounds = bounds_of(rows, length, buckets)
    if not bounds:
        return rows.select("*", F.lit(0).alias("bucket"), F.lit(0).cast("long").alias("bucket_length"), F.lit(0).cast("long").alias("batch_id"), F.lit(0).alias("batch_slot"), F.lit(0).cast("long").alias("padding"))
    size = F.greatest(F.col(length), F.lit(1)).cast("long")
    bucket = F.lit(len(bounds) - 1)
    for i in range(len(bounds) - 2, -1, -1):
        bucket = F.when(size <= bounds[i], F.lit(i)).otherwise(bucket)
    chunks = max(1, -(-rows.count() // CHUNK))
    # A chunk takes about CHUNK rows of all buckets together.
    dealt = rows.withColumn("bucket", bucket).withColumn("__chunk", F.pmod(F.coalesce(F.col(doc_id).cast("long"), size), F.lit(chunks)).cast("long"))
    counts = dealt.groupBy("bucket", "__chunk").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("bucket").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = keep(counts.select("bucket", "__chunk", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")), "offsets")
    order = Window.partitionBy("bucket", "__chunk").orderBy(doc_id, length)
    place = (F.col("__before") + F.row_number().over(order) - 1).cast("long")
    placed = dealt.withColumnRenamed("bucket", "__b").join(offsets.withColumnRenamed("__chunk", "__c"), (F.col("__b") == F.col("bucket")) & (F.col("__chunk") == F.col("__c")))
    placed = placed.withColumn("__place", place)
    bound = F.element_at(F.array(*[F.lit(b).cast("long") for b in bounds]), F.col("bucket") + 1)
    each = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / bound).cast("long"))
    return placed.select(
        *rows.columns,
        "bucket",
        bound.alias("bucket_length"),
        F.floor(F.col("__place") / each).cast("long").alias("batch_id"),
        F.pmod("__place", each).cast("int").alias("batch_slot"),
        (bound - F.coalesce(F.col(length), F.lit(0))).cast("long").alias("padding"),
    )
