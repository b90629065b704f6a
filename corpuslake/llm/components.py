"""Connected components of a link table, wholly as joins and aggregates (alternating large-star and small-star steps)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.session import Kept

#: Steps after which a graph that still changes is reported as an error (each pair of steps shortens paths by a constant factor).
MAX_STEPS = 60


def _canonical(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi <> lo").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())


def _star(kept: DataFrame, large: bool) -> DataFrame:
    """Large: every larger neighbour moves to the smallest of a node's neighbourhood. Small: every smaller one and the node itself do."""
    if large:
        near = kept.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(kept.select("lo", "hi"))
    else:
        near = kept.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
    # The minima are written, so that both sides of the join are plain exchanges, which AQE splits where a node has very many links.
    least = Kept(near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "star")
    joined = near.join(least.df, "u")
    if large:
        moved = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.df.select("u", "m"))
    return _canonical(moved)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every node that has a link to another node; component: the smallest node reachable.

    Null ends, self links and repeated links are ignored; an empty link table gives an empty result. Every step is written to the
    shared folder, so that a lost executor costs one step at most; nothing is collected but a count and a checksum.
    """
    linked = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    now = Kept(_canonical(linked), "links")
    state = _state(now.df)
    for _ in range(MAX_STEPS if state[0] else 0):
        wide = Kept(_star(now.df, True), "links")
        then = Kept(_star(wide.df, False), "links")
        wide.drop()
        now.drop()
        was, now, state = state, then, _state(then.df)
        if was == state:
            break
    else:
        if state[0]:
            raise RuntimeError(f"components did not settle in {MAX_STEPS} steps")
    # Settled: every node but the smallest of its component links to that one alone.
    return now.df.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(now.df.select("lo", "lo").distinct())
