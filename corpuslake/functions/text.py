"""Text expressions, SimHash, and the deterministic embedder."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WORD = r"[\p{IsAlphabetic}\p{N}]+"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize_text(t: Column | str) -> Column:
    """Unicode white space collapsed to single spaces, ends trimmed."""
    return F.trim(F.regexp_replace(_c(t), r"(?U)\s+", " "))


def token_count(t: Column | str) -> Column:
    return F.coalesce(F.regexp_count(_c(t), F.lit(r"(?U)\S+")), F.lit(0)).cast("long")


def useful_chars(t: Column | str) -> Column:
    return F.coalesce(F.length(F.regexp_replace(_c(t), r"(?U)\s", "")), F.lit(0)).cast("long")


def words(t: Column | str) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(_c(t)), F.lit(_WORD), 0)


def trim_snippet(t: Column | str, limit: int) -> Column:
    """The shortest prefix of at least ``limit`` bytes (the character that starts before the limit ends it), trailing white space trimmed."""
    b = _c(t).cast("binary")
    # A character's later bytes are 10xxxxxx: at most three of them can follow the limit.
    later = [F.substr(b, F.lit(limit + i), F.lit(1)).between(F.lit(b"\x80"), F.lit(b"\xbf")) for i in (1, 2, 3)]
    more = F.when(~F.coalesce(later[0], F.lit(False)), 0).when(~F.coalesce(later[1], F.lit(False)), 1).when(~F.coalesce(later[2], F.lit(False)), 2).otherwise(3)
    return F.regexp_replace(F.substr(b, F.lit(1), F.lit(limit) + more).cast("string"), r"(?U)\s+$", "")


def embedding_input(heading_path: Column | str, text: Column | str) -> Column:
    """What is embedded for a passage: its headings joined by a space, a new line, and its text; the text alone without headings."""
    path = F.array_join(_c(heading_path), " ")
    return F.when(F.coalesce(path, F.lit("")) == "", _c(text)).otherwise(F.concat(path, F.lit("\n"), _c(text)))


# ------------------------------------------------------------ SimHash
# FNV-1a (64-bit) offset and prime, and the SplitMix64 finaliser's multipliers.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
MIX_1, MIX_2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
#: Bits of each band: 64 * i / 7 to 64 * (i + 1) / 7.
BANDS = tuple((64 * i // 7, 64 * (i + 1) // 7) for i in range(7))


def _fnv(items: list[bytes]) -> np.ndarray:
    """FNV-1a of many byte strings at once: one step per byte position over a padded matrix, shorter strings standing still."""
    if not items:
        return np.empty(0, np.uint64)
    lens = np.array([len(b) for b in items])
    order = np.argsort(-lens, kind="stable")
    ends = np.cumsum(lens[order])
    flat = np.frombuffer(b"".join(items[i] for i in order), np.uint8).astype(np.uint64)
    starts = ends - lens[order]
    h = np.full(len(items), FNV_OFFSET, np.uint64)
    live = np.searchsorted(-lens[order], -np.arange(lens.max()), side="left")
    for at, n in enumerate(live.tolist()):
        h[:n] = (h[:n] ^ flat[starts[:n] + at]) * np.uint64(FNV_PRIME)
    out = np.empty_like(h)
    out[order] = h
    return out


def simhash_of(tokens: list[str]) -> int | None:
    """The signed 64-bit SimHash of word 3-shingles, or None for under three words; a bit is set if its votes are positive."""
    if len(tokens) < 3:
        return None
    h = _fnv([" ".join(tokens[i : i + 3]).encode() for i in range(len(tokens) - 2)])
    h = (h ^ (h >> np.uint64(30))) * np.uint64(MIX_1)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(MIX_2)
    h ^= h >> np.uint64(31)
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0)
    bits = 2 * ones.astype(np.int64) > len(h)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def simhash64(t: Column | str) -> Column:
    """``bigint`` fingerprint; words are split in the JVM, hashing is vectorised over each text's shingles."""

    @F.pandas_udf("bigint")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else simhash_of(list(x)) for x in s], dtype="Int64")

    return run(words(t))


def bands(fp: Column | str) -> Column:
    """``array<struct<no,val>>`` of the seven bands."""
    return F.array(*[F.struct(F.lit(i).alias("no"), F.shiftrightunsigned(_c(fp), a).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("long")).cast("int").alias("val")) for i, (a, b) in enumerate(BANDS)])


def hamming(a: Column | str, b: Column | str) -> Column:
    return F.bit_count(_c(a).bitwiseXOR(_c(b)))


# ------------------------------------------------------------ deterministic embedder
def embed_tokens(tokens: list[str], dims: int) -> list[float]:
    """Each token's SHA-256 adds a signed weight to two buckets; the vector has length one, and without weight is the first unit vector."""
    v = np.zeros(dims, np.float64)
    for t in tokens:
        d = hashlib.sha256(t.encode()).digest()
        for k in (0, 8):
            v[int.from_bytes(d[k : k + 4], "little") % dims] += 1.0 if d[k + 4] & 1 else -1.0
    n = np.sqrt((v * v).sum())
    if n == 0:
        v[0] = n = 1.0
    return (v / n).astype(np.float32).tolist()


def hash_embed(t: Column | str, dims: int = 64) -> Column:
    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else embed_tokens(list(x), dims))

    return run(words(t))


def embed_missing(inputs: DataFrame, cache: DataFrame, dims: int = 64) -> DataFrame:
    """Vectors for ``inputs(key, text)``: those whose input hash is in ``cache(input_sha, vector)`` are reused, only misses are computed, once each."""
    i = inputs.withColumn("input_sha", F.sha2("text", 256))
    fresh = i.join(cache.select("input_sha"), "input_sha", "left_anti").groupBy("input_sha").agg(F.first("text").alias("text"))
    made = fresh.select("input_sha", hash_embed("text", dims).alias("vector"))
    return i.drop("text").join(cache.select("input_sha", "vector").unionByName(made), "input_sha")
