"""Removal of long word sequences that an earlier document has, by recompression.

Every text is parsed in ``ROUNDS``: a run round replaces a maximal run of one symbol by a new symbol, a pair round replaces neighbours
``ab`` where a round's coin gives a to the left and b to the right letters, so that pairs never overlap. In these low rounds a new symbol's name is a 64-bit
fingerprint of what it replaces and coins are bits of the name: names are global without a shared dictionary, and equal texts get
equal symbols wherever the neighbourhood is equal. A symbol may span ``cap`` words of its round at most; hence a round can change what
lies more than one symbol or short run inside a border never, and the symbols that lie wholly in a window of ``WINDOW`` words, at least ``EDGE``
words from either end, are the same in every document that holds this window (``EDGE`` sums what each round can reach; see ``edge``).

So, with M = WINDOW - 2 * EDGE - (longest symbol - 1) >= the longest symbol:
1. Each window takes, of the symbols that start in the M words after its first EDGE, the one of least name (the first of equal ones) as its anchor.
   Equal windows take equal anchors at equal offsets. An anchor and the EDGE words on either side of its start make one high-level symbol, known by 128 bits.
2. The last round is Spark's: it groups the high-level symbols of all documents and names those that two documents share by a number. All other windows are unique.
3. Windows of named symbols are verified: equal ones have the same name at the same offset (which is 2 * EDGE equal words) and the same fingerprint of all their words; their smallest
   doc_id, by a map-side combined aggregate, and a join give the windows that a smaller doc_id has too. The words they cover are removed. Two windows can be taken for equal
   by accident only if they share a symbol and an offset, with a probability of 2^-64 for each such pair.

Documents of at least WINDOW words that equal a smaller document wholly are left out of 1-3; all of their words go.

Cases: a null text has no words; texts under WINDOW words, or without repeats, lose nothing; a text repeated under the same doc_id is not
another document; rows that share a doc_id each lose what a smaller doc_id has; a null doc_id neither loses words nor takes them from others; an
empty table gives an empty result; extra columns pass through, but for those named like an output.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.llm.common import as_bytes, known_words, mix, need, rolling_ids, schema_with, word_ids
from corpuslake.session import bucketed, free_shuffles, keep

WINDOW = 50
#: (kind, most words in a symbol) of each round.
ROUNDS = (("run", 2), ("pair", 3), ("pair", 4), ("run", 4), ("pair", 6))


def edge(rounds=ROUNDS) -> int:
    """Words at a window's border that what lies outside can change: a run at the border of a run round, one symbol in a pair round."""
    longest, total = 1, 0
    for kind, cap in rounds:
        total += cap if kind == "run" else longest
        longest = max(longest, cap)
    return total


EDGE = edge()
LONGEST = max(cap for _, cap in ROUNDS)


def parse(ids: np.ndarray, rounds=ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Names of the high-level symbols of a word sequence, and the word at which each starts."""
    names, starts = ids, np.arange(len(ids))
    total = len(ids)
    for number, (kind, cap) in enumerate(rounds):
        if len(names) < 2:
            break
        lens = np.diff(starts, append=total)
        if kind == "run":
            head = np.concatenate([[True], names[1:] != names[:-1]])
            at = np.nonzero(head)[0]
            times = np.diff(at, append=len(names))
            fold = (times > 1) & (times * lens[at] <= cap)
            if not fold.any():
                continue
            names = names.copy()
            names[at[fold]] = mix(names[at[fold]] * np.uint64(0x9E3779B97F4A7C15) + times[fold].astype(np.uint64))
            stay = head | ~np.repeat(fold, times)
        else:
            coin = (names >> np.uint64(7 * number + 3)) & np.uint64(1)
            pair = np.nonzero((coin[:-1] == 0) & (coin[1:] == 1) & (lens[:-1] + lens[1:] <= cap))[0]
            if not len(pair):
                continue
            made = mix(names[pair] * np.uint64(0xD6E8FEB86659FD93) + mix(names[pair + 1] + np.uint64(number + 1)))
            names = names.copy()
            names[pair] = made
            stay = np.ones(len(names), bool)
            stay[pair + 1] = False
        names, starts = names[stay], starts[stay]
    return names, starts


def anchors(ids: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For each window of a document the index of the word at which its anchor starts."""
    n = len(ids) - window + 1
    if n <= 0:
        return np.empty(0, np.int64)
    names, starts = parse(ids)
    middle = window - 2 * EDGE - LONGEST + 1
    weight = np.full(len(ids), np.iinfo(np.uint64).max, np.uint64)
    weight[starts] = mix(names)
    # Words that start no symbol weigh the most; argmin takes the first of equal ones.
    zones = np.lib.stride_tricks.sliding_window_view(weight[EDGE : EDGE + n - 1 + middle], middle)
    return zones.argmin(axis=1) + np.arange(n) + EDGE


def _shingled(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """id, key, more of every distinct high-level symbol: both halves of its 128 bits."""
    for b in batches:
        docs, keys, more = [np.empty(0, np.int64)], [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
        for d, t in zip(b.column("id").to_pylist(), as_bytes(b.column("text"))):
            ids = word_ids((t or b"").split(), known_words)
            at = np.unique(anchors(ids, window)) - EDGE
            found, first = np.unique(rolling_ids(ids, 2 * EDGE)[at], return_index=True) if len(at) else (np.empty(0, np.uint64), at)
            keys.append(found)
            more.append(rolling_ids(ids, 2 * EDGE, 1)[at[first]] if len(at) else found)
            docs.append(np.full(len(found), d, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(docs)), *(pa.array(np.concatenate(x).view(np.int64)) for x in (keys, more))], names=["id", "key", "more"])


def _windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """id, pos, symbol, h of every window whose symbol has a name; symbol: the name and the window's offset from its anchor."""
    for b in batches:
        docs, places, symbols, hashes = [np.empty(0, np.int64)], [np.empty(0, np.int32)], [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
        for d, t, keys, names in zip(b.column("id").to_pylist(), as_bytes(b.column("text")), b.column("keys"), b.column("names")):
            ids = word_ids((t or b"").split(), known_words)
            at = anchors(ids, window)
            if not len(at):
                continue
            key, name = (x.values.to_numpy(zero_copy_only=False).astype(np.int64) for x in (keys, names))
            order = np.argsort(key)
            key, name = key[order], name[order]
            own = rolling_ids(ids, 2 * EDGE)[at - EDGE].view(np.int64)
            spot = np.minimum(np.searchsorted(key, own), len(key) - 1)
            pos = np.nonzero(key[spot] == own)[0]
            docs.append(np.full(len(pos), d, np.int64))
            places.append(pos.astype(np.int32))
            symbols.append((name[spot[pos]] << 6) | (at[pos] - pos))
            hashes.append(rolling_ids(ids, window)[pos])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(docs)), pa.array(np.concatenate(places)), pa.array(np.concatenate(symbols)), pa.array(np.concatenate(hashes).view(np.int64))], names=["id", "pos", "symbol", "h"]
        )


def _held(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``docs`` with ``__id``, written once in buckets of it, so that no later step moves texts again. Rows without an id are dealt by text."""
    spot = F.coalesce(F.col(doc_id).cast("long"), F.xxhash64(text))
    return bucketed(docs.select("*", spot.alias("__id"), F.col(doc_id).isNotNull().alias("__known")), "__id", "texts")


def _covered(held: DataFrame, text: str, window: int) -> DataFrame:
    """``__id, copy_of, positions``: documents that lose words; copy_of: a smaller document with the same words, which has them all; else positions:
    the first words of the windows to remove."""
    spark = held.sparkSession
    long = held.where(F.col("__known") & (F.octet_length(text) >= 2 * window - 1)).select("__id", F.col(text).alias("__text"))
    # Whole copies, by the digest of the text.
    digest = F.unhex(F.sha2(F.col("__text").cast("binary"), 256))
    digests = long.select(F.col("__id").alias("id"), digest.alias("digest"))
    firsts = keep(digests.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last"), "firsts")
    copies = keep(digests.join(firsts, "digest").where("id > first").select(F.col("id").alias("__id"), F.col("first").alias("copy_of"), "digest"), "copies")
    alone = long.join(copies.select("__id", F.col("digest").alias("__digest")), ["__id"], "left").where(F.col("__digest").isNull() | (F.col("__digest") != digest)).select(F.col("__id").alias("id"), F.col("__text").alias("text"))
    # 1: high-level symbols; 2: names for those that documents share.
    found = keep(alone.mapInArrow(lambda b: _shingled(b, window), "id bigint, key bigint, more bigint"), "symbols")
    named = found.groupBy("key", "more").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a < z")
    named = keep(named.select("key", "more", F.monotonically_increasing_id().alias("name")), "names")  # a name is fixed once it is written
    # A symbol of very many documents is one row of the other side here; AQE splits its exchange.
    wanted = keep(found.join(named, ["key", "more"]).select("id", "key", "name"), "wanted").groupBy("id").agg(F.collect_set(F.struct("key", "name")).alias("s")).select("id", F.col("s.key").alias("keys"), F.col("s.name").alias("names"))
    free_shuffles(spark)
    # 3: the windows of named symbols.
    windows = keep(alone.join(wanted, "id").select("id", "text", "keys", "names").mapInArrow(lambda b: _windows(b, window), "id bigint, pos int, symbol bigint, h bigint"), "windows")
    free_shuffles(spark)
    least = keep(windows.groupBy("symbol", "h").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("symbol", "h", "first"), "least")
    hit = windows.join(least, ["symbol", "h"]).where("id > first").select("id", "pos")
    places = hit.groupBy("id").agg(F.collect_set("pos").alias("positions"))
    places = places.select(F.col("id").alias("__id"), F.lit(None).cast("long").alias("copy_of"), "positions")
    whole = copies.groupBy("__id").agg(F.min("copy_of").alias("copy_of")).select("__id", "copy_of", F.lit(None).cast("array<int>").alias("positions"))
    out = keep(whole.union(places).groupBy("__id").agg(F.min("copy_of").alias("copy_of"), F.first("positions", True).alias("positions")), "covered")
    free_shuffles(spark)
    return out


def keep_words(words: list[bytes], positions: np.ndarray | None, whole: bool, window: int) -> list[bytes]:
    """The words that no removed window covers."""
    if whole and len(words) >= window:
        return []
    if positions is None or not len(positions):
        return words
    step = np.zeros(len(words) + 1, np.int32)
    np.add.at(step, positions, 1)
    np.add.at(step, positions + window, -1)
    stays = np.cumsum(step[:-1]) == 0
    return [w for w, s in zip(words, stays.tolist()) if s]


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, digest_only: bool = False) -> DataFrame:
    """The rows of ``docs`` with ``n_words``, ``n_removed`` and ``kept_text`` (or, with ``digest_only``, ``kept_sha256``): kept words joined by one space."""
    need(docs, doc_id, text)
    last = "kept_sha256 string" if digest_only else "kept_text string"
    stay, schema = schema_with(docs, f"n_words bigint, n_removed bigint, {last}")
    held = _held(docs, doc_id, text)
    lost = _covered(held, text, window)
    lost = lost.withColumnsRenamed({"copy_of": "__copy_of", "positions": "__positions"})
    source = text if text in stay else "__text"  # an output's name takes the column, not what it held
    joined = held.join(lost, "__id", "left").select(*stay, *([] if text in stay else [F.col(text).alias(source)]), *[F.when(F.col("__known"), F.col(c)).alias(c) for c in ("__copy_of", "__positions")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, removed, out = [], [], []
            at = b.column("__positions")
            for i, (t, whole) in enumerate(zip(as_bytes(b.column(source)), b.column("__copy_of").to_pylist())):
                words = (t or b"").split()
                places = at[i].values
                left = keep_words(words, None if places is None else places.to_numpy(zero_copy_only=False), whole is not None, window)
                n.append(len(words))
                removed.append(len(words) - len(left))
                text_left = b" ".join(left)
                out.append(hashlib.sha256(text_left).hexdigest() if digest_only else text_left)
            made = pa.array(out, pa.string()) if digest_only else pa.array(out, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in stay], pa.array(n, pa.int64()), pa.array(removed, pa.int64()), made], names=[f.name for f in schema.fields])

    return joined.mapInArrow(run, schema)
