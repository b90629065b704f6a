"""Embeddings near-duplicates and nearest neighbours.

Vectors that are null, empty, zero, of another length than asked for, or that hold null or non-finite components take no part.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.llm.common import need
from corpuslake.llm.components import components
from corpuslake.session import free_shuffles, keep


def usable(vector: str):
    """Whether a vector takes part: not null or empty, all components finite, not all zero."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def narrow(df: DataFrame, vector: str):
    """The vector as an array of floats where it is one already, else of doubles; -0.0 becomes 0.0."""
    kind = "float" if df.schema[vector].dataType.simpleString() == "array<float>" else "double"
    return F.transform(F.col(vector).cast(f"array<{kind}>"), lambda x: (x + F.lit(0.0)).cast(kind)), f"array<{kind}>"


def matrix(column: pa.Array, dtype=np.float64) -> np.ndarray:
    """A list column without nulls as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


# ================================================================ near-duplicates
#: Least cosine; vectors in a block; allowance for rounding in float32 products of the bounds.
THRESHOLD, BLOCK, SLACK = 0.93, 1_024, 1e-5


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Int8 codes of unit vectors, their scales, the lengths of the decoded vectors and of the rounding errors (both rounded up)."""
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    decoded = codes * scale[:, None]
    up = 1 + 1e-9
    return codes, scale, np.linalg.norm(decoded, axis=1) * up, np.linalg.norm(unit - decoded, axis=1) * up + 1e-12


def tile_links(x: np.ndarray, y: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Which pairs of rows have a cosine of at least the threshold.

    x·y = x̂·ŷ + x̂·e_y + e_x·ŷ + e_x·e_y, so |x·y - x̂·ŷ| <= |x̂||e_y| + |e_x||ŷ| + |e_x||e_y|. Products of int8 codes are exact in
    float32 while they stay below 2^24. Only pairs whose upper bound reaches the threshold are computed in double precision; the
    result is that computation, for those surely above as well.
    """
    ux, uy = x / np.linalg.norm(x, axis=1)[:, None], y / np.linalg.norm(y, axis=1)[:, None]
    (qx, sx, nx, ex), (qy, sy, ny, ey) = quantise(ux), quantise(uy)
    wide = np.float32 if x.shape[1] * 127 * 127 < 1 << 24 else np.float64
    approx = (qx.astype(wide) @ qy.astype(wide).T).astype(np.float64) * sx[:, None] * sy[None, :]
    error = nx[:, None] * ey[None, :] + ex[:, None] * ny[None, :] + ex[:, None] * ey[None, :] + SLACK
    i, j = np.nonzero(approx + error >= threshold)
    out = np.zeros(approx.shape, bool)
    for a in range(0, len(i), 65_536):
        p, q = i[a : a + 65_536], j[a : a + 65_536]
        cosine = np.einsum("ij,ij->i", x[p], y[q]) / (np.linalg.norm(x[p], axis=1) * np.linalg.norm(y[q], axis=1))
        out[p, q] = cosine >= threshold
    return out


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the given ones."""
    root = list(range(n))

    def find(a: int) -> int:
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    out = []
    for a, b in zip(i.tolist(), j.tolist()):
        p, q = find(a), find(b)
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((a, b))
    return out


_FOUND = "node bigint, other bigint, n_links bigint"


def _tile(threshold: float):
    def run(key, batch):
        side, ids, copies = batch.column("side").to_numpy(), batch.column("id").to_numpy(), batch.column("copies").to_numpy()
        m = matrix(batch.column("v").combine_chunks())
        same = key[2].as_py() == key[3].as_py()
        left = np.nonzero(side == 0)[0]
        right = left if same else np.nonzero(side == 1)[0]
        if not len(left) or not len(right):
            return pa.table({"node": pa.array([], pa.int64()), "other": pa.array([], pa.int64()), "n_links": pa.array([], pa.int64())})
        hit = tile_links(m[left], m[right], threshold)
        if same:
            np.fill_diagonal(hit, False)
        linked = np.zeros(len(ids), np.int64)
        linked[left] += hit @ copies[right]
        if not same:
            linked[right] += hit.T @ copies[left]
        i, j = np.nonzero(np.triu(hit) if same else hit)
        forest = _forest(left[i], right[j], len(ids))
        a = np.array([p for p, _ in forest], np.intp)
        b = np.array([q for _, q in forest], np.intp)
        some = np.nonzero(linked)[0]
        return pa.table(
            {
                "node": np.concatenate([ids[some], ids[a]]),
                "other": pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(ids[b], pa.int64())]),
                "n_links": np.concatenate([linked[some], np.zeros(len(a), np.int64)]),
            }
        )

    return run


def near_duplicates(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """``vec_id, n_links, component_id, kept``: one row per vector, linked with vectors of the same label by cosine.

    Equal vectors of a label collapse to one with a count. Each label's vectors are dealt by hash to blocks of about ``block``; a tile is
    a pair of blocks of one label, so a label with very many rows becomes many tiles of bounded size. A tile multiplies int8 codes, and
    computes in double precision what the error bounds can't exclude. It returns, for each vector, how many it links and a spanning
    forest of its links, so that rows stay linear in the tile while no link is lost to counts or components.

    Cases: a null label links with nothing; so do unusable vectors; vectors of unequal lengths never link; rows that share a vec_id are each
    a vector of their own: ``n_links`` counts all other rows that a row links with, whatever their ids, and a row takes the component of its own vector
    and label; a null vec_id links with nothing, its component is null and it is kept; an empty table gives an empty result. Other columns are ignored.
    """
    need(df, vec_id, vector, label)
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), narrow(df, vector)[0].alias("v"), F.col(label).cast("string").alias("label"))
    good = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable("v"))
    good = good.withColumn("dims", F.size("v"))
    # A class of equal vectors is a node by a number of its own, fixed once it is written; its smallest vec_id only names components.
    classes = good.groupBy("label", "dims", "v").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"))
    classes = keep(classes.withColumn("id", F.monotonically_increasing_id()), "vectors")
    sizes = classes.groupBy("label", "dims").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = classes.join(keep(sizes, "sizes"), ["label", "dims"]).withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    tiles = dealt.withColumn("theirs", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "label",
        "dims",
        F.least("mine", "theirs").alias("i"),
        F.greatest("mine", "theirs").alias("j"),
        F.when(F.col("mine") <= F.col("theirs"), 0).otherwise(1).alias("side"),
        "id",
        "copies",
        "v",
    )
    found = keep(tiles.groupBy("label", "dims", "i", "j").applyInArrow(_tile(threshold), _FOUND), "tiles")
    free_shuffles(df.sparkSession)
    links = found.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b"))
    # Equal vectors under one representative: their own links are counted, and they share its component.
    comp = components(links).join(classes.select(F.col("id").alias("node"), "first_id"), "node")
    named_comp = comp.groupBy("component").agg(F.min("first_id").alias("component_id"))
    comp = keep(comp.join(named_comp, "component").select("node", "component_id"), "components")
    counted = found.where("other IS NULL").groupBy("node").agg(F.sum("n_links").alias("linked"))
    named = keep(
        classes.join(comp, F.col("id") == F.col("node"), "left").drop("node").join(counted, F.col("id") == F.col("node"), "left")
        .select("label", "v", F.coalesce("component_id", "first_id").alias("component_id"), (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("linked")),
        "named",
    )
    shown = rows.withColumn("ok", F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable("v"))
    shown = shown.withColumn("v", F.when(F.col("ok"), F.col("v")))
    r, n = shown.alias("r"), named.alias("n")
    out = r.join(n, (F.col("r.label") == F.col("n.label")) & (F.col("r.v") == F.col("n.v")), "left").select(
        F.col("r.vec_id").alias("vec_id"),
        F.coalesce("linked", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
    )
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


# ================================================================ inverted multi-index
#: Centroids for each half; vectors that the codebooks are fitted on at most; queries that calibrate at most, and the share of their neighbours that they must find.
CENTROIDS, FIT_ROWS, CALIBRATE, TARGET = 64, 20_000, 256, 0.94
#: Components of the entries in a shard (4,096 vectors of 64); queries in a run.
SHARD_VALUES, QUERY_RUN = 1 << 18, 4_096
#: Far above the rounding error of a product of unit length in double precision.
MARGIN = 1e-9


def fit_half(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids of one half by Lloyd's algorithm from evenly spaced rows of the sample."""
    k = min(k, len(np.unique(x, axis=0))) or 1
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy() if len(x) else np.zeros((1, x.shape[1]))
    for _ in range(rounds):
        near = nearest(x, c)
        for j in range(len(c)):
            if (own := x[near == j]).size:
                c[j] = own.mean(axis=0)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(axis=1)[None, :] - 2 * x @ c.T).argmin(axis=1)


def traverse(first: np.ndarray, second: np.ndarray, counts: np.ndarray, least: int) -> list[int]:
    """Cells ``i * len(second) + j`` by growing ``first[i] + second[j]``, from a heap, until they hold ``least`` entries (or all are out)."""
    a, b = np.argsort(first, kind="stable").tolist(), np.argsort(second, kind="stable").tolist()
    f, s, width = first.tolist(), second.tolist(), len(b)
    heap, out, held = [(f[a[0]] + s[b[0]], 0, 0)], [], 0
    sizes = counts.tolist()
    while heap and held < least:
        _, p, q = heapq.heappop(heap)
        cell = a[p] * width + b[q]
        if sizes[cell]:
            out.append(cell)
            held += sizes[cell]
        if q + 1 < width:
            heapq.heappush(heap, (f[a[p]] + s[b[q + 1]], p, q + 1))
        if q == 0 and p + 1 < len(a):
            heapq.heappush(heap, (f[a[p + 1]] + s[b[0]], p + 1, 0))
    return out


class Codebooks:
    """Centroids of both halves."""

    def __init__(self, x: np.ndarray, half: int, k: int) -> None:
        self.half = half
        self.one = fit_half(x[:, :half], k)
        self.two = fit_half(x[:, half:], k) if x.shape[1] > half else np.zeros((1, 0))
        self.width = len(self.two)
        self.cells = len(self.one) * self.width

    def cell(self, v: np.ndarray) -> np.ndarray:
        if not len(v):
            return np.empty(0, np.int64)
        return nearest(v[:, : self.half], self.one) * self.width + (nearest(v[:, self.half :], self.two) if self.width > 1 else 0)

    def distances(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What each half adds to the distance of its centroids: here growing distance is falling inner product."""
        return -(self.one @ q[: self.half]), -(self.two @ q[self.half :])


def calibrate(books: Codebooks, ids: np.ndarray, x: np.ndarray, asked_ids: np.ndarray, asked: np.ndarray, k: int, target: float) -> float:
    """The share of entries that a walk by distance must reach to find ``target`` of the k nearest of the asked vectors among the sample ``x``.

    Nearest among a sample are further away than nearest among all, so that the share is rather too large than too small for all.
    """
    sizes, cell = np.bincount(books.cell(x), minlength=books.cells), books.cell(x)
    needed = []
    for i, q in zip(asked_ids.tolist(), asked):
        score = x @ q
        score[ids == i] = -np.inf
        top = np.argsort(-score, kind="stable")[: min(k, int((ids != i).sum()))]
        a, b = books.distances(q)
        far = (a[:, None] + b[None, :]).ravel()
        order = np.argsort(far, kind="stable")
        reached = np.empty(books.cells)
        reached[order] = np.cumsum(sizes[order])
        needed.append(reached[cell[top]] / len(x))
    flat = np.sort(np.concatenate([*needed, np.empty(0)]))
    return float(flat[min(len(flat) - 1, int(np.ceil(target * len(flat))))]) if len(flat) else 1.0


def shards_of(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each cell its first shard and in how many it lies: cells side by side share a shard of up to ``most`` entries, a larger cell is cut into parts."""
    first, parts = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64)
    shard, held = 0, 0
    for c, n in enumerate(sizes.tolist()):
        if held and held + n > most:
            shard, held = shard + 1, 0
        first[c] = shard
        if n > most:
            parts[c] = -(-n // most)
            shard += int(parts[c])
        else:
            held += n
    return first, parts


def exact(entries: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in double precision, each summed in the same order wherever its vector stands."""
    return np.einsum("ij,j->i", np.ascontiguousarray(entries), q)


class _Shard:
    """The entries of one shard, in order of cell and id."""

    def __init__(self, ids: np.ndarray, cells: np.ndarray, v: np.ndarray) -> None:
        order = np.lexsort((ids, cells))
        self.ids, self.v, sorted_cells = ids[order], v[order], cells[order]
        self.cells, self.starts = np.unique(sorted_cells, return_index=True)
        self.ends = np.append(self.starts[1:], len(order))
        self.span = np.sqrt((self.v * self.v).sum(axis=1)).max(initial=0.0)

    def best(self, ids: np.ndarray, q: np.ndarray, plans: list[bytes], k: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of each query the k nearest entries in the cells of its plan: (ids of the query repeated, ids, scores).

        Each cell is multiplied by the queries that ask for it; of a query's products those stay that can be among the k largest in double precision.
        """
        asks = np.zeros((len(plans), len(self.cells)), bool)
        for n, plan in enumerate(plans):
            asks[n] = np.isin(self.cells, np.frombuffer(plan, np.int32))
        product = np.full((len(plans), len(self.ids)), -np.inf)
        for c, (a, z) in enumerate(zip(self.starts.tolist(), self.ends.tolist())):
            if len(who := np.nonzero(asks[:, c])[0]):
                product[who, a:z] = q[who] @ self.v[a:z].T
        product[self.ids[None, :] == ids[:, None]] = -np.inf
        out = []
        for n, score in enumerate(product):
            rows = np.nonzero(score > -np.inf)[0]
            if len(rows) > k:
                cut = np.partition(score, len(score) - k)[len(score) - k]
                rows = np.nonzero(score >= cut - MARGIN * max(1.0, self.span * float(np.linalg.norm(q[n]))))[0]
            score = exact(self.v[rows], q[n])
            order = np.lexsort((self.ids[rows], -score))[:k]
            out.append((np.full(len(order), ids[n]), self.ids[rows][order], score[order]))
        return out


_HITS = "query_id bigint, vec_id bigint, score double"


def _scan(k: int):
    """Rows sorted by (shard, run, role): the entries of a run are held, its queries stream past them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, shard, waiting = None, None, []
        for b in batches:
            keys = np.stack([b.column(c).to_numpy() for c in ("shard", "run", "role")], axis=1)
            bounds = [0, *(np.nonzero((keys[1:] != keys[:-1]).any(axis=1))[0] + 1).tolist(), len(keys)]
            for a, z in zip(bounds, bounds[1:]):
                if a == z:
                    continue
                part, key, role = b.slice(a, z - a), tuple(keys[a, :2].tolist()), keys[a, 2]
                if key != now:
                    now, shard, waiting = key, None, []
                ids, v = part.column("id").to_numpy(), matrix(part.column("v"))
                if role == 0:
                    waiting.append((ids, part.column("cell").to_numpy(), v))
                    continue
                if shard is None:
                    if not waiting:
                        continue
                    shard, waiting = _Shard(*(np.concatenate(x) for x in zip(*waiting))), []
                plans = part.column("cells").to_pylist()
                for s in range(0, len(ids), 256):
                    if found := shard.best(ids[s : s + 256], v[s : s + 256], plans[s : s + 256], k):
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], names=["query_id", "vec_id", "score"])

    return run


def search(df: DataFrame, queries: DataFrame, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", scan: float | None = None, target: float = TARGET) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query its k largest inner products among all rows but its own, by an inverted multi-index.

    The two halves of a vector are quantised apart; a cell is a pair of centroids. Codebooks are fitted on at most ``FIT_ROWS`` rows (those
    of smallest hash); every row is indexed. A query walks the pairs of centroids by their summed distance with a heap until cells
    with ``scan`` of all entries are out, and their entries are reranked by the inner product in double precision. Unless given, ``scan`` is calibrated: at most
    ``CALIBRATE`` queries must find ``target`` of their nearest in the sample (clustered vectors need little of the index, unclustered ones much).

    Entries move once, to shards of neighbouring cells of bounded size (a cell above the bound lies in several, by hash of id, so that copies of one
    vector don't make a hot one). A query goes to the shards that hold cells of its plan, with those cells alone; queries of a shard come in runs of about
    ``QUERY_RUN``, each with a copy of the shard. A task holds one shard and streams queries; k hits for each query and shard go on.

    Cases: vectors that differ in length from the most frequent length take no part; nor do unusable vectors and null ids, as queries or entries; rows that
    repeat a vec_id are entries of their own, but a query never finds its own id, and queries that repeat an id are asked once (that of the least vector);
    ties go to the smaller vec_id; fewer than k candidates give fewer rows; an empty table gives none.
    """
    need(df, vec_id, vector)
    need(queries, vec_id, vector)
    spark = df.sparkSession
    as_v, kind = narrow(df, vector)
    rows = df.select(F.col(vec_id).cast("long").alias("id"), as_v.alias("v")).where(F.col("id").isNotNull() & usable("v"))
    asked = queries.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast(kind).alias("v")).where(F.col("id").isNotNull() & usable("v"))
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if lengths is None:
        return empty
    dims, total = int(lengths["d"]), int(lengths["count"])
    rows = rows.where(F.size("v") == dims)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # few bytes but much work: counts of tasks are given, so that AQE doesn't merge them
    asked = keep(asked.where(F.size("v") == dims).repartition(tasks, "id").groupBy("id").agg(F.min("v").alias("v")), "asked")

    def sample(of: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Bounded: the ids of smallest hash, then their vectors."""
        picked = of.select("id", F.xxhash64("id").alias("h")).orderBy("h", "id").limit(most).select("id").distinct()
        got = of.join(F.broadcast(picked), "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(most).select("id", "v").toArrow().combine_chunks()
        return got.column("id").to_numpy(), matrix(got.column("v").combine_chunks())

    ids, x = sample(rows, FIT_ROWS)
    books = Codebooks(x, dims // 2 if dims > 1 else 1, CENTROIDS)
    if scan is None:
        scan = calibrate(books, ids, x, *sample(asked, CALIBRATE), k, target)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(books.cell(matrix(b.column("v"))), pa.int32())], names=["id", "v", "cell"])

    entries = keep(rows.mapInArrow(index, f"id bigint, v {kind}, cell int"), "entries")
    sizes = np.zeros(books.cells, np.int64)  # bounded: one count for each pair of centroids
    for r in entries.groupBy("cell").count().collect():
        sizes[r["cell"]] = r["count"]
    least = min(total, max(int(np.ceil(scan * total)), 40 * k))
    first, parts = shards_of(sizes, max(1, SHARD_VALUES // dims))

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[int, int, bytes]] = []
            for n, q in enumerate(matrix(b.column("v"))):
                cells = np.sort(np.array(traverse(*books.distances(q), sizes, least), np.int32))
                where = first[cells]
                for a, z in zip(bounds := [0, *(np.nonzero(np.diff(where))[0] + 1).tolist()], [*bounds[1:], len(cells)]):
                    # A cell that is cut into parts lies in no shard with others.
                    out += [(n, int(where[a]) + p, cells[a:z].tobytes()) for p in range(int(parts[cells[a]]))]
            at = pa.array([n for n, _, _ in out], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([s for _, s, _ in out], pa.int32()), b.column("id").take(at), b.column("v").take(at), pa.array([c for _, _, c in out], pa.binary())], names=["shard", "id", "v", "cells"])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, spread = b.column("cell").to_numpy(), b.column("spread").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(first[cell] + spread % parts[cell], pa.int32()), *(b.column(c) for c in ("id", "v", "cell"))], names=["shard", "id", "v", "cell"])

    # Each query's plan holds about as many shards as any other's, so that all shards take one number of runs.
    runs = max(1, -(-asked.count() // QUERY_RUN))
    dealt = entries.withColumn("spread", F.pmod(F.xxhash64("id"), F.lit(1 << 40))).mapInArrow(placed, f"shard int, id bigint, v {kind}, cell int")
    left = dealt.select("shard", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run"), F.lit(0).alias("role"), "id", "v", "cell", F.lit(None).cast("binary").alias("cells"))
    right = asked.repartition(tasks, "id").mapInArrow(plan, f"shard int, id bigint, v {kind}, cells binary").select("shard", F.pmod(F.xxhash64("id"), F.lit(runs)).cast("int").alias("run"), F.lit(1).alias("role"), "id", "v", F.lit(-1).alias("cell"), "cells")
    several = min(int((first + parts).max(initial=1)) * runs, 16 * tasks)
    hits = left.union(right).repartition(several, "shard", "run").sortWithinPartitions("shard", "run", "role").mapInArrow(_scan(k), _HITS)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
