"""Capture selection, exact aliases, SimHash near-duplicates and shingle similarity."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.functions.text import hamming, simhash64
from corpuslake.functions.urls import sha256_id
from corpuslake.operators.history import only_top
from corpuslake.session import keep, numbered

NEAR_BITS, PAIR_LIMIT = 6, 1_000


def selection_key(*columns: str):
    """A total order over captures that depends on their content alone."""
    return sha256_id("capture", *columns)


def url_winners(captures: DataFrame) -> DataFrame:
    """One capture per (source, final URL): that of smallest selection key, then row id."""
    return only_top(captures, ["source_id", "final_url"], [F.col("selection_key"), F.col("row_id")])


def representatives(winners: DataFrame) -> DataFrame:
    """One winner per (source, content): that of smallest URL."""
    return only_top(winners, ["source_id", "content_sha256"], [F.col("final_url"), F.col("selection_key"), F.col("row_id")])


def reduce_captures(captures: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pages, aliases and the status of every capture, whatever order the captures came in.

    captures: row_id, source_id, requested_url, final_url, content_sha256, selection_key.
    """
    c = captures.withColumn("page_id", sha256_id("page", "final_url"))
    by_url = Window.partitionBy("source_id", "final_url").orderBy("selection_key", "row_id")
    won = c.withColumn("winner", F.row_number().over(by_url) == 1).withColumn("winning_sha", F.first("content_sha256").over(by_url)).withColumn("winning_key", F.first("selection_key").over(by_url))
    winners = won.where("winner").drop("winner", "winning_sha", "winning_key")
    pages = representatives(winners)
    rep = pages.select("source_id", "content_sha256", F.col("page_id").alias("representative_page_id"), F.col("final_url").alias("representative_url"))
    aliases = winners.join(rep, ["source_id", "content_sha256"]).where("final_url <> representative_url").select(
        "source_id", F.col("final_url").alias("alias_url"), F.col("page_id").alias("alias_page_id"), "representative_page_id", F.when(F.col("requested_url") != F.col("final_url"), "redirect-alias").otherwise("exact-alias").alias("alias_kind"), "requested_url"
    )
    state = won.join(rep, ["source_id", "content_sha256"], "left")
    admitted = F.col("winner") & (F.col("final_url") == F.col("representative_url"))
    status = F.when(admitted, "admitted").when(F.col("winner"), "exact-alias").otherwise("superseded-capture")
    reason = F.when(admitted, "deterministic-minimum-selection").when(F.col("winner"), "exact-content-alias").when(F.col("content_sha256") == F.col("winning_sha"), "superseded-duplicate-capture").otherwise("superseded-conflicting-content")
    manifest = state.select("row_id", "source_id", "final_url", "page_id", status.alias("admission_status"), reason.alias("selection_reason"), F.col("winning_key").alias("selected_key"))
    return pages, aliases, manifest


def block_pairs(fp: Column | str, distance: int = NEAR_BITS, equal: int = 2) -> Column:
    """``array<long>``: of ``distance + equal`` blocks of a fingerprint every choice of ``equal`` ones, with their bits. Fingerprints that differ in up to ``distance`` bits have
    at least ``equal`` equal blocks, so they share a key; a larger ``equal`` makes more keys, each of more bits and so of fewer rows."""
    c = F.col(fp) if isinstance(fp, str) else fp
    n = distance + equal
    cuts = [64 * i // n for i in range(n + 1)]
    block = lambda i: F.shiftrightunsigned(c, cuts[i]).bitwiseAND(F.lit((1 << (cuts[i + 1] - cuts[i])) - 1).cast("long"))
    return F.array(*[F.xxhash64(F.lit(k), *[block(i) for i in chosen]) for k, chosen in enumerate(combinations(range(n), equal))])


def near_duplicates(df: DataFrame, group: str, order: list[str], text: str, max_distance: int = NEAR_BITS, fingerprint: str | None = None, equal: int = 2) -> DataFrame:
    """Rows whose SimHash is near an earlier row of their group, with the *earliest* such row: ``ordinal, near_ordinal, distance`` beside the keys.

    Ordinals come from ranges of (group, order), so no group is one task. Candidates share ``equal`` of ``max_distance + equal`` blocks (pigeonhole): with two of
    eight a bucket holds about a 65,536th of a group's different fingerprints for each of its 28 keys. Rows of equal fingerprints stand as one in the join, so its pairs
    follow the number of different fingerprints in a bucket, not of copies; the keys' exchange is a plain one, which AQE splits where a bucket is large.
    """
    rows = df.select(group, *[c for c in order if c != group], (F.col(fingerprint) if fingerprint else simhash64(text)).alias("fp"))
    rows = numbered(rows, [group, *[c for c in order if c != group]], "__n", "fingerprints")
    first = rows.groupBy(group).agg(F.min("__n").alias("__first"))
    rows = rows.alias("r").join(first.alias("f"), F.col(f"r.{group}").eqNullSafe(F.col(f"f.{group}"))).select("r.*", (F.col("__n") - F.col("__first") + 1).cast("int").alias("ordinal")).drop("__n")
    some = keep(rows.where("fp IS NOT NULL"), "ordinals")
    prints = keep(some.groupBy(group, "fp").agg(F.min("ordinal").alias("first")), "prints")
    b = keep(prints.select(F.col(group).alias("g"), "fp", "first", F.explode(block_pairs("fp", max_distance, equal)).alias("k")), "blocks")
    x, y = b.alias("x"), b.alias("y")
    near = x.join(y, F.col("x.g").eqNullSafe(F.col("y.g")) & (F.col("x.k") == F.col("y.k")) & (F.col("y.first") < F.col("x.first")) & (hamming("x.fp", "y.fp") <= max_distance))
    found = near.select(F.col("x.g").alias("g"), F.col("x.fp").alias("fp"), F.struct(F.col("y.first").alias("near_ordinal"), hamming("x.fp", "y.fp").alias("distance")).alias("m"))
    found = found.unionByName(prints.select(F.col(group).alias("g"), "fp", F.struct(F.col("first").alias("near_ordinal"), F.lit(0).alias("distance")).alias("m")))  # a copy is near itself
    pairs = found.groupBy("g", "fp").agg(F.min("m").alias("m"))
    out = some.alias("s").join(pairs.alias("p"), F.col(f"s.{group}").eqNullSafe(F.col("p.g")) & (F.col("s.fp") == F.col("p.fp"))).where("p.m.near_ordinal < s.ordinal")
    return out.select("s.*", "p.m.near_ordinal", "p.m.distance")


def near_report(pages: DataFrame, near: DataFrame, aliases: DataFrame, origin: str) -> DataFrame:
    """Counts and rates by origin; origins with aliases only stay."""
    p = pages.groupBy(origin).agg(F.count("*").alias("page_count"))
    n = near.groupBy(origin).agg(F.count("*").alias("near_duplicate_page_count"))
    a = aliases.groupBy(origin).agg(F.count("*").alias("exact_duplicate_alias_count"))
    out = p.join(n, origin, "full").join(a, origin, "full").na.fill(0)
    return out.withColumn("near_duplicate_rate", F.coalesce(F.try_divide(F.col("near_duplicate_page_count").cast("double"), F.col("page_count").cast("double")), F.lit(0.0)))


def shingle_similarity(df: DataFrame, key: list[str], text: str, sha: str, sample: int | None = 200, max_chars: int | None = 1_000, max_bytes: int | None = 4_000, at_least: float = 0.8, least_df: int = 2, most_df: int = 5, least_shared: int = 3, top: int = 500) -> DataFrame:
    """Pairs by five-word shingle similarity among bounded texts: the report's own bounds (a sample in key order, text sizes, shingles of
    document frequency 2 to 5, the best ``top``) are its definition; None lifts the sample or a text size. Rare shingles alone are joined, so no shingle pairs more than ten rows."""
    rows = df.orderBy(*key).limit(sample) if sample is not None else df
    for size, most in ((F.length(text), max_chars), (F.octet_length(text), max_bytes)):
        rows = rows.where(size <= most) if most is not None else rows
    tokens = F.filter(F.split(F.trim(F.regexp_replace(F.lower(F.col(text)), r"[^\p{L}\p{N}]+", " ")), " "), lambda x: x != "")
    # The words are bound as a lambda's variable, so that they are split once and not again for each shingle; the guard keeps the sequence from counting down.
    hashes = lambda w: F.when(F.size(w) >= 5, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - 4), lambda i: F.xxhash64(F.slice(w, i, 5)))))
    rows = rows.select(F.struct(*key).alias("k"), F.col(sha).alias("sha"), F.element_at(F.transform(F.array(tokens), hashes), 1).alias("s")).where("s IS NOT NULL").withColumn("n", F.size("s"))
    each = keep(rows.select("k", "sha", "n", F.explode("s").alias("h")), "shingles")  # read three times
    rare = each.groupBy("h").agg(F.count("*").alias("df")).where(F.col("df").between(least_df, most_df)).select("h")
    each = each.join(rare, "h", "left_semi")
    a, b = each.alias("a"), each.alias("b")
    pairs = a.join(b, (F.col("a.h") == F.col("b.h")) & (F.col("a.k") < F.col("b.k"))).where("a.sha <> b.sha").groupBy("a.k", "b.k", "a.n", "b.n").agg(F.count("*").alias("shared"))
    pairs = pairs.toDF("l", "r", "ln", "rn", "shared")
    scored = pairs.where(F.col("shared") >= least_shared).withColumn("jaccard", F.col("shared").cast("double") / (F.col("ln") + F.col("rn") - F.col("shared"))).where(F.col("jaccard") >= at_least)
    best = scored.orderBy(F.desc("jaccard"), F.desc("shared"), "l", "r").limit(top)
    rank = F.row_number().over(Window.orderBy(F.desc("jaccard"), F.desc("shared"), "l", "r"))
    return best.select(*[F.col(f"l.{k}").alias(f"left_{k}") for k in key], *[F.col(f"r.{k}").alias(f"right_{k}") for k in key], "shared", "jaccard", rank.alias("candidate_rank"))
