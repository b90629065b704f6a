"""Retrieval evaluation and measurement statistics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.operators.history import ratio

# The generator of the bootstrap, its seed, and the gates.
LCG_A, LCG_C, SEED = 6364136223846793005, 1442695040888963407, 0x53434F55545F4556
MASK = (1 << 64) - 1
MIN_GAIN, MAX_REGRESSION, MAX_DROP, EPSILON = 0.03, 0.02, 0.02, 1e-9


def normalise_judgments(judgments: DataFrame, queries: DataFrame, judges: list[str]) -> DataFrame:
    """``query_id, page_id, grade``: the adjudicated grade before the grade; errors for grades out of 0..3, unknown queries or judges, repeats, or a judge missing."""
    final = F.coalesce("adjudicated_grade", "grade")
    j = judgments.withColumn("final", final)
    rules = {
        "grade out of range": j.where("final IS NULL OR final < 0 OR final > 3"), "unknown query": j.join(queries.select("query_id"), "query_id", "left_anti"), "repeated judgment": j.groupBy("query_id", "page_id").count().where("count > 1"),
        "unknown or missing judge": j.where(F.col("judge_grades").isNotNull() & (F.array_sort(F.map_keys("judge_grades")) != F.array_sort(F.array(*map(F.lit, judges))))),
    }
    for name, bad in rules.items():
        if bad.head(1):
            raise ValueError(name)
    return j.select("query_id", "page_id", F.col("final").cast("int").alias("grade"))


def _gain(grade: str) -> Column:
    return F.pow(F.lit(2.0), F.col(grade)) - 1


def ranking_metrics(rankings: DataFrame, judgments: DataFrame, strict: bool = True) -> DataFrame:
    """NDCG@10, MRR@10, Recall@10 and @100 of each (mode, query); rankings(mode, query_id, page_id, rank from 1), relevant from grade 2.

    A query without a relevant page is an error, or, if not strict, left out.
    """
    ideal = judgments.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "page_id"))).groupBy("query_id").agg(
        F.sum(F.when(F.col("pos") <= 10, _gain("grade") / F.log2(F.col("pos") + 1.0)).otherwise(0.0)).alias("idcg"), F.count_if(F.col("grade") >= 2).alias("relevant")
    )
    if strict and ideal.where("relevant = 0").head(1):
        raise ValueError("a query has no relevant page")
    j = rankings.join(judgments, ["query_id", "page_id"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))
    hit, first10 = F.col("grade") >= 2, F.col("rank") <= 10
    m = j.groupBy("mode", "query_id").agg(
        F.sum(F.when(first10, _gain("grade") / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"), F.min(F.when(hit & first10, F.col("rank"))).alias("first_hit"),
        F.count_if(hit & first10).alias("hits10"), F.count_if(hit & (F.col("rank") <= 100)).alias("hits100"),
    )
    return m.join(ideal.where("relevant > 0"), "query_id").select(
        "mode", "query_id", F.coalesce(ratio("dcg", "idcg"), F.lit(0.0)).alias("ndcg10"), F.coalesce(1.0 / F.col("first_hit"), F.lit(0.0)).alias("mrr10"), ratio("hits10", "relevant").alias("recall10"), ratio("hits100", "relevant").alias("recall100")
    )


METRICS = ("ndcg10", "mrr10", "recall10", "recall100")


def slices(metrics: DataFrame, queries: DataFrame, dims: tuple[str, ...] = ("split", "source", "intent")) -> DataFrame:
    """Macro averages overall and by each dimension."""
    j = metrics.join(queries, "query_id")
    cells = F.explode(F.array(F.struct(F.lit("overall").alias("dimension"), F.lit("all").alias("value")), *[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dims]))
    return j.select("mode", cells.alias("cell"), *METRICS).groupBy("mode", "cell.dimension", "cell.value").agg(F.count("*").alias("query_count"), *[F.avg(m).alias(m) for m in METRICS])


def lcg(state: int) -> int:
    return (state * LCG_A + LCG_C) & MASK


def paired_bootstrap(deltas: list[float], seed: int = SEED, iterations: int = 10_000) -> tuple[float, float, float]:
    """Mean and the 2.5 % and 97.5 % resampled means; draws are the generator's states modulo n, in order.

    States are jumped to in blocks (the generator is affine), so that the sequence is the sequential one while numpy does the work.
    """
    x = np.asarray(deltas, np.float64)
    n = len(x)
    if not n:
        raise ValueError("no deltas")
    total = n * iterations
    a, c = np.empty(n, np.uint64), np.empty(n, np.uint64)
    pa, pc = 1, 0
    for i in range(n):
        pa, pc = (pa * LCG_A) & MASK, (pc * LCG_A + LCG_C) & MASK
        a[i], c[i] = pa, pc
    means, state = np.empty(iterations), seed & MASK
    for i in range(total // n):
        s = np.uint64(state) * a + c
        means[i] = x[(s % np.uint64(n)).astype(np.intp)].sum() / n
        state = int(s[-1])
    means.sort()
    return float(x.mean()), float(means[(iterations - 1) * 25 // 1000]), float(means[(iterations - 1) * 975 // 1000])


def held_out_gate(metrics: DataFrame) -> dict:
    """Whether hybrid beats keyword and semantic on held-out queries: gain, interval above zero, no regression."""
    rows = metrics.select("mode", "query_id", *METRICS).toPandas()  # one row per query and mode of an evaluation package
    by = {m: rows[rows["mode"] == m].set_index("query_id").sort_index() for m in ("hybrid", "keyword", "semantic")}
    out = {}
    for i, other in enumerate(("keyword", "semantic")):
        d = (by["hybrid"]["ndcg10"] - by[other]["ndcg10"]).tolist()
        mean, low, high = paired_bootstrap(d, SEED + i)
        lost = max(by[other][m].mean() - by["hybrid"][m].mean() for m in ("mrr10", "recall100"))
        out[other] = {"gain": mean, "low": low, "high": high, "passed": mean >= MIN_GAIN and low > 0 and lost <= MAX_REGRESSION}
    return out


def package_shape(queries: DataFrame, per_cell: int = 4, splits: dict[str, int] | None = None) -> list[str]:
    """What is wrong with an evaluation package's shape: cells of (source, intent) and sizes of splits."""
    wrong = [f"{r['source']}/{r['intent']}: {r['count']}" for r in queries.groupBy("source", "intent").count().where(F.col("count") != per_cell).limit(100).collect()]
    for split, n in (splits or {"development": 16, "held-out": 48}).items():
        if (k := queries.where(F.col("split") == split).count()) != n:
            wrong.append(f"{split}: {k}")
    return wrong


def regressions(baseline: DataFrame, now: DataFrame, max_drop: float = MAX_DROP) -> DataFrame:
    """Metrics by (mode, metric) against a baseline: missing, query_count_changed, regressed or ok; both: mode, metric, value, query_count."""
    j = baseline.alias("b").join(now.alias("n"), ["mode", "metric"], "full")
    status = (
        F.when(F.col("n.value").isNull(), "missing").when(F.col("b.value").isNull(), "new").when(F.col("b.query_count") != F.col("n.query_count"), "query_count_changed")
        .when(F.col("n.value") < F.col("b.value") - max_drop - EPSILON, "regressed").otherwise("ok")
    )
    return j.select("mode", "metric", F.col("b.value").alias("baseline"), F.col("n.value").alias("value"), status.alias("status"))


# ------------------------------------------------------------ distributions
def distribution(df: DataFrame, value: str, by: list[str], unstable_above: float = 0.15) -> DataFrame:
    """Nearest-rank percentiles, spread (max - min) / p50, and whether it is unstable."""
    p = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY `{value}`)")
    out = df.groupBy(*by).agg(F.count(value).alias("n"), F.min(value).alias("min"), p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"), F.max(value).alias("max"))
    return out.withColumn("spread", F.try_divide(F.col("max") - F.col("min"), F.col("p50"))).withColumn("unstable", F.coalesce(F.col("spread") > unstable_above, F.lit(False)))


def scaling(df: DataFrame, workers: str, value: str) -> DataFrame:
    """Mean throughput by worker count (nulls ignored), speedup and efficiency over the fewest workers, and doublings that gain under 1.3 times."""
    m = df.groupBy(F.col(workers).cast("long").alias("workers")).agg(F.avg(value).alias("throughput"))
    w = Window.orderBy("workers")  # one row per worker count
    m = m.withColumn("base", F.first("throughput").over(w)).withColumn("fewest", F.first("workers").over(w)).withColumn("before", F.lag("throughput").over(w)).withColumn("fewer", F.lag("workers").over(w))
    gain = F.pow(F.col("throughput") / F.col("before"), 1 / F.log2(F.col("workers") / F.col("fewer")))
    return m.select("workers", "throughput", (F.col("throughput") / F.col("base")).alias("speedup"), (F.col("throughput") / F.col("base") * F.col("fewest") / F.col("workers")).alias("efficiency"), F.coalesce(gain < 1.3, F.lit(False)).alias("flattening"))


def crawl_window(claims: DataFrame, completions: DataFrame) -> DataFrame:
    """The window opens at the last worker's first claim and closes at completion: claims(run, worker, at), completions(run, page, at, finished)."""
    opens = claims.groupBy("run", "worker").agg(F.min("at").alias("first")).groupBy("run").agg(F.max("first").alias("opens"))
    closes = completions.groupBy("run").agg(F.max("at").alias("closes"))
    j = completions.join(opens.join(closes, "run"), "run")
    return j.groupBy("run", "opens", "closes").agg(F.count_if((F.col("at") >= F.col("opens")) & (F.col("at") <= F.col("closes"))).alias("pages_in_window"))


def pair_latencies(events: DataFrame, keys: list[str], kind: str = "kind", at: str = "at", start: str = "start", finish: str = "finish") -> DataFrame:
    """Latency of each finish that directly follows a start of the same key."""
    w = Window.partitionBy(*keys).orderBy(at)
    e = events.withColumn("__k", F.lag(kind).over(w)).withColumn("__a", F.lag(at).over(w))
    return e.where((F.col(kind) == finish) & (F.col("__k") == start)).select(*keys, (F.col(at) - F.col("__a")).alias("latency"))


def cumulative_buckets(df: DataFrame, series: list[str], value: str, bounds: list[float], max_series: int = 512) -> DataFrame:
    """Histogram counts at or below each bound and an overflow slot; series beyond the first ``max_series`` (in order) share one, ``overflow``."""
    names = df.select(F.concat_ws("/", *series).alias("series")).distinct().orderBy("series").limit(max_series)
    s = df.select(F.concat_ws("/", *series).alias("series"), F.col(value).alias("v")).join(F.broadcast(names.withColumn("known", F.lit(True))), "series", "left")
    s = s.withColumn("series", F.when(F.col("known"), F.col("series")).otherwise("overflow"))
    spark = df.sparkSession
    b = spark.createDataFrame([(float(x),) for x in [*bounds, float("inf")]], "le double")
    le = F.lit(float("inf"))
    for x in sorted(bounds, reverse=True):
        le = F.when(F.col("v") <= x, F.lit(float(x))).otherwise(le)
    n = s.groupBy("series", le.alias("le")).agg(F.count("*").alias("n"))
    grid = n.select("series").distinct().crossJoin(F.broadcast(b)).join(n, ["series", "le"], "left")
    return grid.select("series", "le", F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy("series").orderBy("le")).alias("cumulative_count"))


def histogram_quantile(buckets: DataFrame, q: float) -> DataFrame:
    """Quantile by linear interpolation within the bucket that reaches it; in the overflow slot, its lower bound."""
    w = Window.partitionBy("series").orderBy("le")
    b = buckets.withColumn("low", F.coalesce(F.lag("le").over(w), F.lit(0.0))).withColumn("below", F.coalesce(F.lag("cumulative_count").over(w), F.lit(0))).withColumn("total", F.max("cumulative_count").over(Window.partitionBy("series")))
    hit = b.where((F.col("cumulative_count") >= q * F.col("total")) & (F.col("below") < q * F.col("total")))
    inside = F.col("low") + (F.col("le") - F.col("low")) * (q * F.col("total") - F.col("below")) / (F.col("cumulative_count") - F.col("below"))
    return hit.select("series", F.when(F.col("le") == float("inf"), F.col("low")).otherwise(inside).alias("quantile"))


def histogram_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """What cumulative buckets gained between two samples: ``series, le, cumulative_count``; a fall is a restart, after which all counts."""
    b = before.select("series", "le", F.col("cumulative_count").alias("__b"))
    j = after.join(b, ["series", "le"], "left").withColumn("__b", F.coalesce("__b", F.lit(0)))
    fell = F.max((F.col("cumulative_count") < F.col("__b")).cast("int")).over(Window.partitionBy("series"))
    return j.withColumn("__fell", fell).select("series", "le", F.when(F.col("__fell") == 1, F.col("cumulative_count")).otherwise(F.col("cumulative_count") - F.col("__b")).alias("cumulative_count"))


def average_cores(samples: DataFrame, series: list[str], time: str, seconds: str) -> DataFrame:
    """Mean cores of each series between its first and last sample of cumulative CPU seconds; resets count from zero; null over no time."""
    w = Window.partitionBy(*series).orderBy(time)
    step = F.when(F.lag(seconds).over(w).isNull(), 0.0).when(F.col(seconds) >= F.lag(seconds).over(w), F.col(seconds) - F.lag(seconds).over(w)).otherwise(F.col(seconds))
    s = samples.withColumn("__step", step)
    return s.groupBy(*series).agg(F.try_divide(F.sum("__step").cast("double"), (F.max(time) - F.min(time)).cast("double")).alias("average_cores"))


def shuffled(items: list, seed: int) -> list:
    """Fisher-Yates with the generator above."""
    out, state = list(items), seed & MASK
    for i in range(len(out) - 1, 0, -1):
        state = lcg(state)
        j = state % (i + 1)
        out[i], out[j] = out[j], out[i]
    return out
