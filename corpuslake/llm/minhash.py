"""Near-duplicate documents by one-permutation MinHash with optimal densification.

1. ``signatures``: the distinct five-word shingles of each whole text, as 64-bit fingerprints; a digest of that set; one-permutation
   minima (one hash splits into bin and value), empty bins filled from a non-empty one that a fixed random order of bins, drawn
   for each bin, reaches first. All documents see the same orders, so that equal bins of two documents agree with their similarity.
2. Documents of equal sets collapse to one representative before anything is paired.
3. ``BANDS`` bands of ``ROWS`` bins hash to buckets. In every bucket each member is paired with the bucket's smallest id only
   (a star), so pairs are linear in bucket sizes. The shingle sets of documents that share a bucket are written once; stars are confirmed on them.
4. Buckets that still hold several components are cut into blocks, and pairs of blocks (tiles) look, in memory, at every pair across
   components. An upper bound of the overlap, exact for every pair, comes first: a shared shingle lies in a slot of the hash range that both occupy, so that one matrix product of
   slot counts and occupied slots bounds all overlaps of a tile. Pairs whose bound can reach the similarity are compared on full sets, unless their components have been joined
   meanwhile. Only links that join components leave a tile. No pair is a row, none inside a component is needed, and no candidate link between
   components is lost. A pair at similarity 0.75 shares no bucket with probability (1 - 0.75^4)^40 < 3e-7.

Confirming streams sorted rows: partitions hold (centre, salt) runs, the centre's set first, so that one shingle set is held at a time.

Cases: without words or text a document has an empty set and links with nothing; with one to four words its whole sequence is the one
shingle; equal texts link; every row gets a result row and takes the component of its own set (rows that share a doc_id but not a text are
confirmed on the smallest of their texts, but counted and put in buckets on their own); rows whose doc_id is null link with nothing, have a null component and are kept. Extra columns are ignored by ``components_of`` and pass through ``deduplicate``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.llm.common import as_bytes, known_words, mix, need, window_ids, word_ids
from corpuslake.llm.components import components
from corpuslake.session import free_shuffles, keep

#: Words in a shingle; similarity as a fraction; bands and bins in a band; members for each copy of a centre.
WIDTH, NUMERATOR, DENOMINATOR, BANDS, ROWS, SALT_ROWS = 5, 75, 100, 40, 4, 50
#: Members and shingles in a block of a bucket, about; slots of the hash range that bound an overlap.
BLOCK, BLOCK_SHINGLES, SLOTS = 512, 1 << 20, 4_096
BINS = BANDS * ROWS


def shingles(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct shingle fingerprints of a text; ``bytes.lower`` and ``bytes.split`` treat ASCII alone."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    ids = word_ids(words, known_words)
    return np.unique(window_ids(ids, min(width, len(ids))))


def _orders(bins: int) -> np.ndarray:
    """For each bin a fixed random order of all bins, itself first."""
    rng = np.random.default_rng(20_240_229)
    out = np.argsort(rng.random((bins, bins)), axis=1)
    for j in range(bins):
        row = out[j]
        row[row == j] = row[0]
        row[0] = j
    return out


_ORDERS = _orders(BINS)


def signature(found: np.ndarray) -> np.ndarray:
    """The densified one-permutation minima of a non-empty set."""
    hashed = mix(found ^ np.uint64(0x5851F42D4C957F2D))
    bins = (hashed % np.uint64(BINS)).astype(np.intp)
    least = np.full(BINS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, bins, hashed)
    there = np.zeros(BINS, bool)
    there[bins] = True
    if there.all():
        return least
    reached = there[_ORDERS].argmax(axis=1)
    return least[_ORDERS[np.arange(BINS), reached]]


def buckets_of(sig: np.ndarray) -> np.ndarray:
    """One 64-bit bucket key for each band."""
    rows = sig.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(ROWS):
        key = mix(key * np.uint64(0xD6E8FEB86659FD93) + rows[:, k])
    return key.view(np.int64)


def signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, digest, buckets array<long>`` of every row; digest and buckets are null for empty sets."""
    need(docs, doc_id, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, digests, keys = [], [], []
            for t in as_bytes(b.column(1)):
                found = shingles(t)
                n.append(len(found))
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                keys.append(buckets_of(signature(found)) if len(found) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "digest", "buckets"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id bigint, n_shingles bigint, digest binary, buckets array<bigint>")


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets reach the similarity; exact in integers."""
    if DENOMINATOR * min(len(x), len(y)) < NUMERATOR * max(len(x), len(y)) or not len(x):
        return False
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return DENOMINATOR * shared >= NUMERATOR * (len(both) - shared)


def sets_in(column: pa.Array) -> list[np.ndarray]:
    """The sets of a binary column, as views of its buffer."""
    if not len(column):
        return []
    _, ends, data = column.buffers()
    at = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1].tolist()
    flat = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return [flat[a:z].view(np.uint64) for a, z in zip(at, at[1:])]


def sets_of(texts: DataFrame) -> DataFrame:
    """``id, set``: the sorted shingle fingerprints of each text, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t).tobytes() for t in as_bytes(b.column(1))], pa.binary())], names=["id", "set"])

    return texts.select("id", "text").mapInArrow(run, "id bigint, set binary")


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (centre, salt, role); role 0 brings the centre's set, role 1 a member's."""
    centre, held = None, np.empty(0, np.uint64)
    for b in batches:
        a_out, b_out = [], []
        for c, salt, role, m, found in zip(*[b.column(k).to_pylist() for k in ("c", "salt", "role", "m")], sets_in(b.column("set"))):
            if role == 0:
                centre, held = (c, salt), found.copy()
            elif centre == (c, salt) and similar(held, found):
                a_out.append(c)
                b_out.append(m)
        yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``c, m, n`` (n: about how many members c has) whose full sets are similar, as ``a, b``; sets: one row for each id."""
    # The salt spreads a centre's members over runs of about SALT_ROWS; each run gets its own copy of the centre.
    pairs = pairs.withColumn("salt", F.pmod(F.xxhash64("m"), F.greatest(F.lit(1), F.ceil(F.col("n") / SALT_ROWS)).cast("long")))
    pairs = keep(pairs.select("c", "salt", "m"), "pairs")
    centres = pairs.select("c", "salt").distinct().join(sets, F.col("c") == F.col("id")).select("c", "salt", F.lit(0).alias("role"), F.lit(None).cast("long").alias("m"), "set")
    members = pairs.join(sets, F.col("m") == F.col("id")).select("c", "salt", F.lit(1).alias("role"), "m", "set")
    rows = centres.union(members).repartition("c", "salt").sortWithinPartitions("c", "salt", "role")
    return rows.mapInArrow(_confirm, "a bigint, b bigint")


def overlap_bounds(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """For every pair of sets a number that their overlap can't exceed: of each set the shingles in slots that the other occupies."""

    def counted(sets: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(sets), SLOTS), np.float32)
        for row, x in zip(out, sets):
            row += np.bincount((x % np.uint64(SLOTS)).astype(np.intp), minlength=SLOTS)
        return out

    a, b = counted(left), counted(right)
    return np.minimum(a @ (b > 0).astype(np.float32).T, (a > 0).astype(np.float32) @ b.T)


def _tile(rows: list[tuple[int, int, int, np.ndarray]], same: bool) -> list[tuple[int, int]]:
    """Links between components among the rows (side, id, label, set) of one tile: enough to join all that any of its links join."""
    ids, labels, sets = [r[1] for r in rows], np.array([r[2] for r in rows]), [r[3] for r in rows]
    root = {x: x for x in labels.tolist()}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    left = [i for i, r in enumerate(rows) if r[0] == 0]
    right = left if same else [i for i, r in enumerate(rows) if r[0] == 1]
    if not left or not right:
        return []
    sizes, out = np.array([len(x) for x in sets], np.int64), []
    most = np.minimum(overlap_bounds([sets[i] for i in left], [sets[i] for i in right]), np.minimum.outer(sizes[left], sizes[right]))
    # overlap / union >= 75 / 100, where the union is what both have but the overlap once.
    able = (DENOMINATOR + NUMERATOR) * most >= NUMERATOR * np.add.outer(sizes[left], sizes[right])
    able &= labels[left][:, None] != labels[right][None, :]
    for i, k in zip(*np.nonzero(np.triu(able, 1) if same else able)):
        i, k = left[i], right[k]
        a, b = find(int(labels[i])), find(int(labels[k]))
        if a != b and similar(sets[i], sets[k]):
            root[max(a, b)] = min(a, b)
            out.append((ids[i], ids[k]))
    return out


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (bucket, i, j), a tile at a time."""
    now, rows = None, []

    def done() -> pa.RecordBatch:
        links = _tile(rows, now[1] == now[2]) if now is not None else []
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["a", "b"])

    for b in batches:
        for bucket, i, j, side, id_, label, found in zip(*[b.column(c).to_pylist() for c in ("bucket", "i", "j", "side", "id", "label")], sets_in(b.column("set"))):
            if (bucket, i, j) != now:
                yield done()
                now, rows = (bucket, i, j), []
            rows.append((side, id_, label, found))
    yield done()


def _across(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between components in the same bucket, ``a, b``; rows: bucket, blocks, id, label.

    A bucket's members are dealt by hash to blocks of about ``BLOCK`` and of bounded sets, and a tile is a pair of blocks. Pairs are looked at inside a tile, in
    memory, and only links that join something leave it: rows stay linear in the members of a bucket.
    """
    mine = rows.withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("theirs", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = mine.select("bucket", F.least("mine", "theirs").alias("i"), F.greatest("mine", "theirs").alias("j"), F.when(F.col("mine") <= F.col("theirs"), 0).otherwise(1).alias("side"), "id", "label")
    full = tiles.join(sets, "id").select("bucket", "i", "j", "side", "id", "label", "set")
    return full.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(_tiles, "a bigint, b bigint")


def components_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``; see the module for the method and the cases."""
    spark = docs.sparkSession
    signed = keep(signatures(docs, doc_id, text), "signatures")
    # Equal sets: one representative stands for all of them.
    classes = keep(signed.where("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("rep")), "classes")
    of_rep = signed.where("digest IS NOT NULL").join(classes, (F.col("doc_id") == F.col("rep")) & signed.digest.eqNullSafe(classes.digest), "left_semi")
    rows = of_rep.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("size"), F.explode("buckets").alias("bucket"))
    centres = keep(rows.groupBy("bucket").agg(F.min("id").alias("c"), F.count("*").alias("n"), F.max("id").alias("top")).where("c < top").select("bucket", "c", "n"), "centres")
    members = keep(rows.join(centres, "bucket").select("bucket", "id", "size", "c", "n"), "members")
    free_shuffles(spark)
    stars = members.where("id <> c").groupBy("c", F.col("id").alias("m")).agg(F.max("n").alias("n"))
    wanted = members.select("id").distinct()
    first = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    sets = keep(sets_of(first.join(wanted, "id", "left_semi").groupBy("id").agg(F.min("text").alias("text"))), "sets")
    linked = keep(confirm(stars, sets), "linked")
    free_shuffles(spark)
    found = keep(components(linked), "components")
    # What stars left apart: buckets that still hold several components.
    labelled = keep(members.join(found, F.col("id") == F.col("node"), "left").select("bucket", "id", "size", F.coalesce("component", "id").alias("label")), "labelled")
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("blocks")
    mixed = labelled.groupBy("bucket").agg(F.min("label").alias("least"), F.max("label").alias("most"), blocks)
    mixed = keep(mixed.where("least < most").select("bucket", "blocks"), "mixed")
    more = keep(_across(labelled.join(mixed, "bucket"), sets), "linked")
    if more.head(1):
        found = keep(components(linked.union(more)), "components")
    free_shuffles(spark)
    named = classes.join(found, F.col("rep") == F.col("node"), "left").select(F.col("digest").alias("of"), F.coalesce("component", "rep").alias("class_component"))
    shown = signed.join(named, F.col("digest") == F.col("of"), "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_component", "doc_id")).alias("component_id"))
    return shown.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without those whose component has a smaller doc_id; all columns stay. Empty documents and rows without an id stay."""
    gone = components_of(docs, doc_id, text).where("NOT kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col(doc_id).cast("long") == F.col("__gone"), "left_anti")
