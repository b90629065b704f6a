"""What the operators share: reading tables, words, shingles, fingerprints."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words of a text: maximal runs of characters other than these six ASCII spaces.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def need(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding them."""
    return column.cast(pa.binary()).to_pylist()


def schema_with(df: DataFrame, added: str) -> tuple[list[str], T.StructType]:
    """Columns of ``df`` that stay, and the schema once ``added`` (DDL) follows them; a clashing input column gives way."""
    new = T.StructType.fromDDL(added)
    stay = [f for f in df.schema.fields if f.name not in new.names]
    return [f.name for f in stay], T.StructType([*stay, *new.fields])


def map_added(df: DataFrame, inputs: list[str], added: str, make: Callable[..., list], after: Callable[[], None] | None = None) -> DataFrame:
    """Append columns that ``make(*input arrays) -> [arrays]`` computes from each Arrow batch; ``after`` is called when a task ends, as to forget what it remembered."""
    stay, schema = schema_with(df, added)
    names = [f.name for f in T.StructType.fromDDL(added).fields]
    sent = df.select(*stay, *[F.col(c).alias(f"__in{i}") for i, c in enumerate(inputs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = make(*[b.column(f"__in{i}") for i in range(len(inputs))])
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in stay], *made], names=[*stay, *names])
        if after is not None:
            after()

    return sent.mapInArrow(run, schema)


# ---------------------------------------------------------------- fingerprints
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (SplitMix64) over an array of uint64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class WordIds(dict):
    """word -> 64-bit fingerprint, remembered up to a bound."""

    bound = 400_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.bound:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


#: One memory of words for all operators of a worker, as workers outlive their stages.
known_words = WordIds()


def word_ids(words: list[bytes], known: WordIds) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def window_ids(ids: np.ndarray, width: int) -> np.ndarray:
    """One fingerprint for each run of ``width`` consecutive ids (none, if there are fewer)."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n]
    return mix(out ^ np.uint64(width))


#: Odd bases of two fingerprints that know nothing of each other.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def rolling_ids(ids: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """As ``window_ids``, in time that doesn't depend on the width: differences of a prefix sum, scaled back by inverse powers. which: one of two fingerprints."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    if which not in _powers or len(_powers[which][0]) <= len(ids):
        size = max(32_768, 2 * len(ids))
        made = []
        for base in (_BASES[which], pow(_BASES[which], -1, 1 << 64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            made.append(np.cumprod(steps))
        _powers[which] = made[0], made[1]
    up, down = _powers[which]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(ids * up[: len(ids)], dtype=np.uint64)])
    return mix(((total[width:] - total[:-width]) * down[:n]) ^ np.uint64(width + (which << 32)))
