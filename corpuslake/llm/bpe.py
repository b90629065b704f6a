"""Byte-level BPE encoding and decoding in DuckDB, one in-process database per Python worker.

Each Arrow batch sends its not yet known pre-tokens to a recursive query. Its rows are token positions ``(w, pos, tok)``;
each step joins neighbouring positions to the merge table, finds for every word the leftmost pair of minimum rank, contracts
it, and drops words that have no pair left. Pre-tokens above ``LONG_BYTES`` bytes take a recursion keyed by position: rows keep the rank of
their pair, so that a step changes the four positions about each contraction and joins two new pairs to the merge table, and leaves all others as they
are. Decoding joins token rows to the vocabulary and concatenates them by an
ordered aggregation. Nothing is shuffled: the work is bounded by a batch and a bounded memory of known words.

A long pre-token is first cut where no token of the vocabulary can cross: where the two bytes beside the cut are no token, and neither they with the byte
before nor with the byte after stand in any token. No pair is ever contracted across such a place, so that its parts are encoded apart.

Cases: a null text encodes as the empty text; an empty text has no ids; a null list of ids decodes as null; null ids within a list
are skipped; an id outside the vocabulary is an error. Texts of any length are split whole; a part above
``HEAP_BYTES`` bytes is contracted by the same rule (leftmost pair of minimum rank) with a heap, since the number of recursive steps grows with
its length. Repeated rows each get their own result. Extra columns pass through; a column named like an output gives way to it.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import struct
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpuslake.llm.common import map_added, need

#: Bytes above which a part takes the keyed recursion, and above which the heap; pre-tokens a worker remembers.
LONG_BYTES, HEAP_BYTES, KNOWN_WORDS = 192, 2_048, 1_000_000
#: Most rows that the steps of one recursive query make (about the sum of squared lengths), and most positions of one keyed query.
CHUNK_ROWS, CHUNK_POSITIONS = 4_000_000, 100_000
#: Tokens in one decoding query.
DECODE_TOKENS = 1_000_000

CONTRACT = """
WITH RECURSIVE t(w, pos, tok, next_pos, next_tok, live) AS (
  SELECT w, pos, tok, next_pos, next_tok, true FROM seed
  UNION ALL
  SELECT p.w, p.pos,
    CASE WHEN p.pos = b.at THEN b.m ELSE p.tok END,
    CASE WHEN p.pos = b.at THEN g.next_pos ELSE p.next_pos END,
    CASE WHEN p.pos = b.at THEN g.next_tok WHEN p.next_pos = b.at THEN b.m ELSE p.next_tok END,
    b.w IS NOT NULL
  FROM (SELECT * FROM t WHERE live) p
  LEFT JOIN (
    SELECT w, (v >> 32)::INTEGER AS m, ((v >> 16) & 65535)::INTEGER AS at, (v & 65535)::INTEGER AS gone
    FROM (
      SELECT w, min((m::BIGINT << 32) + (pos << 16) + next_pos) AS v
      FROM (SELECT w, pos, next_pos, tok * 65536::BIGINT + next_tok AS pair FROM t WHERE live AND next_tok IS NOT NULL) n
      JOIN merges USING (pair) GROUP BY w)
  ) b ON p.w = b.w
  LEFT JOIN t g ON g.live AND g.w = p.w AND p.pos = b.at AND g.pos = b.gone
  WHERE b.w IS NULL OR p.pos <> b.gone
)
SELECT w, list(tok ORDER BY pos) AS ids FROM t WHERE NOT live GROUP BY w
"""
KEYED = """
WITH RECURSIVE t(w, pos, tok, prv, nxt, m) USING KEY (w, pos) AS (
  SELECT w, pos, tok, pos - 1, coalesce(next_pos, -1), m FROM (SELECT *, tok * 65536::BIGINT + next_tok AS pair FROM seed) LEFT JOIN merges USING (pair)
  UNION ALL
  SELECT w, c.pos, c.tok, c.prv, c.nxt, CASE WHEN c.pair IS NULL THEN c.m ELSE q.m END
  FROM (
    SELECT w, unnest([
      {'pos': spot, 'tok': made, 'prv': before, 'nxt': after, 'm': NULL::INTEGER, 'pair': coalesce(made * 65536::BIGINT + after_tok, -1)},
      {'pos': gone, 'tok': -1, 'prv': -1, 'nxt': -1, 'm': NULL, 'pair': NULL},
      {'pos': after, 'tok': after_tok, 'prv': spot, 'nxt': after_nxt, 'm': after_m, 'pair': NULL},
      {'pos': before, 'tok': before_tok, 'prv': before_prv, 'nxt': spot, 'm': NULL, 'pair': before_tok * 65536::BIGINT + made}]) AS c
    FROM (
      SELECT r.w, any_value(made) AS made, any_value(spot) AS spot, any_value(gone) AS gone, max(r.prv) FILTER (pos = spot) AS before, max(r.nxt) FILTER (pos = gone) AS after,
        max(r.tok) FILTER (r.prv = gone) AS after_tok, max(r.nxt) FILTER (r.prv = gone) AS after_nxt, max(r.m) FILTER (r.prv = gone) AS after_m,
        max(r.tok) FILTER (r.nxt = spot) AS before_tok, max(r.prv) FILTER (r.nxt = spot) AS before_prv
      FROM recurring.t r JOIN (
        SELECT w, (v >> 32)::INTEGER AS made, ((v >> 16) & 65535)::INTEGER AS spot, (v & 65535)::INTEGER AS gone
        FROM (SELECT w, min((m::BIGINT << 32) + (pos << 16) + nxt) AS v FROM recurring.t WHERE m IS NOT NULL GROUP BY w)) b ON r.w = b.w
      WHERE pos = spot OR pos = gone OR r.prv = gone OR r.nxt = spot GROUP BY r.w))
  LEFT JOIN merges q ON q.pair = c.pair WHERE c.pos >= 0
)
SELECT w, list(tok ORDER BY pos) AS ids FROM t WHERE tok >= 0 GROUP BY w
"""
DECODE = "SELECT doc, list(b ORDER BY pos) AS pieces FROM tokens JOIN vocab USING (id) GROUP BY doc"


def ascii_pattern(pattern: str) -> str | None:
    """The same pattern for ASCII texts and the standard ``re``, if it only has classes known here."""
    space = r" \t\n\x0b\x0c\r"
    out = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{space}A-Za-z0-9]").replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]")
    out = out.replace(r"(?!\S)", f"(?![^{space}])").replace(r"\s", f"[{space}]")
    return None if r"\p" in out or r"\S" in out else out


class Engine:
    """The vocabulary, its merge table and the words known so far, in one worker."""

    def __init__(self, path: str, pattern: str) -> None:
        import duckdb
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        if max(self.ranks.values(), default=0) >= 65_536:
            raise ValueError("ids of 65536 and above don't fit the pair key")
        self.find = regex.compile(pattern).findall
        self.find_ascii = re.compile(p).findall if (p := ascii_pattern(pattern)) else self.find
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.decimals = [str(i) for i in range(max(self.ranks.values(), default=0) + 1)]
        self.known: dict[str, bytes] = {}  # of each pre-token its ids, as int32
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "350MB", "temp_directory": "", "preserve_insertion_order": False})
        self._fill("vocab", {"id": pa.array(self.ranks.values(), pa.int32()), "b": pa.array(self.ranks, pa.binary())})
        pairs, made = [], []
        get = self.ranks.get
        for b, rank in self.ranks.items():
            for k in range(1, len(b)):
                if (x := get(b[:k])) is not None and (y := get(b[k:])) is not None:
                    pairs.append(x * 65_536 + y)
                    made.append(rank)
        # Two bytes that are a token; three that stand side by side in one.
        self.pairs, self.triples = np.zeros(1 << 16, bool), np.zeros(1 << 24, bool)
        for b in self.ranks:
            if len(b) == 2:
                self.pairs[int.from_bytes(b)] = True
            elif len(b) > 2:
                x = np.frombuffer(b, np.uint8).astype(np.int32)
                self.triples[(x[:-2] << 16) | (x[1:-1] << 8) | x[2:]] = True
        self._fill("merges", {"pair": pa.array(pairs, pa.int64()), "m": pa.array(made, pa.int32())})

    def _fill(self, name: str, columns: dict) -> None:
        self.db.register("sent", pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM sent")
        self.db.unregister("sent")

    # ------------------------------------------------------------ encoding
    def split(self, text: str) -> list[str]:
        return self.find_ascii(text) if text.isascii() else self.find(text)

    def learn(self, words: set[str]) -> None:
        """Encode words that aren't known yet."""
        parts: dict[str, list[bytes]] = {}
        for w in words:
            b = w.encode()
            if (rank := self.ranks.get(b)) is not None:
                self.known[w] = struct.pack("i", rank)
            else:
                parts[w] = [b] if len(b) <= LONG_BYTES else self.cut(b)
        todo = sorted({b for bs in parts.values() for b in bs}, key=len)  # those of one query then take about as many steps
        made: dict[bytes, bytes] = {}
        start = steps = positions = 0
        for i, b in enumerate([*todo, None]):
            n = len(b) if b is not None else HEAP_BYTES + 1
            long = n > LONG_BYTES
            full = positions + n > CHUNK_POSITIONS if long else steps + n * n > CHUNK_ROWS
            if i > start and (full or n > HEAP_BYTES or long != (len(todo[start]) > LONG_BYTES)):
                self._contract(todo[start:i], made)
                start, steps, positions = i, 0, 0
            if n > HEAP_BYTES:
                break
            steps, positions = steps + n * n, positions + n
        for b in todo[start:]:
            made[b] = np.array(self.heap(b), np.int32).tobytes()
        for w, bs in parts.items():
            self.known[w] = made[bs[0]] if len(bs) == 1 else b"".join(map(made.__getitem__, bs))

    def cut(self, b: bytes) -> list[bytes]:
        """The parts of a pre-token between the places that no token of the vocabulary can cross."""
        x = np.frombuffer(b"\0" + b + b"\0", np.uint8).astype(np.int32)  # a zero beside the ends can only forbid a cut
        three = (x[:-2] << 16) | (x[1:-1] << 8) | x[2:]  # b[i - 1], b[i], b[i + 1]
        crossed = self.pairs[three[:-1] & 0xFFFF] | self.triples[three[:-1]] | self.triples[three[1:]]
        at = [0, *(np.nonzero(~crossed)[0] + 1).tolist(), len(b)]
        return [b[a:z] for a, z in zip(at, at[1:])]

    def _contract(self, part: list[bytes], made: dict[bytes, bytes]) -> None:
        lens = np.array([len(b) for b in part])
        flat = np.frombuffer(b"".join(part), np.uint8)
        pos = (np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)).astype(np.int32)
        tok = self.byte_ids[flat]
        last = np.zeros(len(flat), bool)
        last[np.cumsum(lens) - 1] = True
        seed = pa.table({"w": np.repeat(np.arange(len(part), dtype=np.int32), lens), "pos": pos, "tok": tok, "next_pos": pa.array(pos + 1, mask=last), "next_tok": pa.array(np.roll(tok, -1), mask=last)})
        self.db.register("seed", seed)
        got = self.db.sql(KEYED if lens.max() > LONG_BYTES else CONTRACT).to_arrow_table().combine_chunks()
        self.db.unregister("seed")
        lists = got.column(1).chunk(0)
        data, ends = lists.values.to_numpy().astype(np.int32).tobytes(), (4 * lists.offsets.to_numpy().astype(np.int64)).tolist()
        for k, w in enumerate(got.column(0).to_pylist()):
            made[part[w]] = data[ends[k] : ends[k + 1]]

    def heap(self, b: bytes) -> list[int]:
        """The same contraction for one very long pre-token: a linked list and a heap of (rank, position)."""
        n, get = len(b), self.ranks.get
        end, prev, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        pairs = [(r, i, i + 2) for i in range(n - 1) if (r := get(b[i : i + 2])) is not None]
        heapq.heapify(pairs)
        while pairs:
            _, i, stop = heapq.heappop(pairs)
            j = end[i]
            if not alive[i] or j >= n or not alive[j] or end[j] != stop:
                continue
            alive[j], end[i] = False, stop
            if stop < n:
                prev[stop] = i
                if (r := get(b[i : end[stop]])) is not None:
                    heapq.heappush(pairs, (r, i, end[stop]))
            if (p := prev[i]) >= 0 and (r := get(b[p:stop])) is not None:
                heapq.heappush(pairs, (r, p, stop))
        return [self.ranks[b[i : end[i]]] for i in range(n) if alive[i]]

    def words(self, texts: list[str | None]) -> list[list[str]]:
        """The pre-tokens of each text, all of them known afterwards."""
        split = [self.split(x) if x else [] for x in texts]
        here = set(chain.from_iterable(split))
        if len(self.known) > KNOWN_WORDS:  # those of this batch stay
            self.known = {w: self.known[w] for w in here if w in self.known}
        self.learn(here.difference(self.known))
        return split

    def ids(self, words: list[str]) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.known.__getitem__, words)), np.int32)

    def written(self, ids: np.ndarray) -> str:
        """Ids as text, joined by one space."""
        return " ".join(map(self.decimals.__getitem__, ids.tolist()))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        return [self.ids(ws) for ws in self.words(texts)]

    # ------------------------------------------------------------ decoding
    def decode(self, lists: list[np.ndarray]) -> list[bytes]:
        out: list[bytes] = []
        a = 0
        while a < len(lists):
            z, size = a, 0
            while z < len(lists) and (z == a or size + len(lists[z]) <= DECODE_TOKENS):
                size += len(lists[z])
                z += 1
            out += self._decode(lists[a:z])
            a = z
        return out

    def _decode(self, lists: list[np.ndarray]) -> list[bytes]:
        lens = np.array([len(x) for x in lists])
        ids = np.concatenate(lists) if lens.sum() else np.empty(0, np.int32)
        if len(ids) and not all(i in self.bytes_of for i in np.unique(ids).tolist()):
            raise ValueError("an id is not in the vocabulary")
        pos = np.arange(len(ids)) - np.repeat(np.cumsum(lens) - lens, lens)
        tokens = pa.table({"doc": np.repeat(np.arange(len(lists), dtype=np.int32), lens), "pos": pos.astype(np.int32), "id": ids})
        self.db.register("tokens", tokens)
        got = self.db.sql(DECODE).to_arrow_table()
        self.db.unregister("tokens")
        out = [b""] * len(lists)
        pieces = got.column(1).combine_chunks()
        if len(got):
            # The pieces of a list lie side by side in the buffer.
            starts, flat = pieces.offsets.to_numpy(), pieces.values
            spots = np.frombuffer(flat.buffers()[1], np.int32, len(flat) + 1, 4 * flat.offset)[starts].tolist()
            data = flat.buffers()[2].to_pybytes() if flat.buffers()[2] is not None else b""
            for k, doc in enumerate(got.column(0).to_pylist()):
                out[doc] = data[spots[k] : spots[k + 1]]
        return out


@cache
def engine(path: str, pattern: str) -> Engine:
    return Engine(path, pattern)


def _ids_array(lists: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*lists, np.empty(0, np.int32)]).astype(np.int32)))


def _pieces(texts: pa.Array, chars: int = 6_000_000):
    """Slices of a batch of about so many bytes, so that a batch of very long texts is not held tokenised at once."""
    lens = [len(x) if x else 0 for x in texts.to_pylist()]
    a = size = 0
    for i, n in enumerate(lens):
        if i > a and size + n > chars:
            yield a, i
            a, size = i, 0
        size += n
    if a < len(lens):
        yield a, len(lens)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Append ``ids array<int>``: the encoded text, without special tokens."""
    need(df, text)
    return map_added(df, [text], f"`{ids}` array<int>", lambda t: [_ids_array([x for a, z in _pieces(t) for x in engine(path, pattern).encode(t.slice(a, z - a).to_pylist())])])


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Append ``decoded binary``: the bytes of the ids in order."""
    need(df, ids)

    def make(column: pa.Array) -> list[pa.Array]:
        given = column.to_pylist()
        got = engine(path, pattern).decode([np.array([i for i in x or () if i is not None], np.int32) for x in given])
        return [pa.array([None if x is None else b for x, b in zip(given, got)], pa.binary())]

    return map_added(df, [ids], f"`{out}` binary", make)


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """Encode, then decode the ids in the same pass: ``n_tokens``, ``ids_sha256`` (ids as text, joined by a space), ``decoded_sha256``."""
    need(df, text)

    def make(column: pa.Array) -> list[pa.Array]:
        e, n, ids_sha, text_sha = engine(path, pattern), [], [], []
        for a, z in _pieces(column):
            lists = e.encode(column.slice(a, z - a).to_pylist())
            n += map(len, lists)
            ids_sha += [hashlib.sha256(e.written(x).encode()).hexdigest() for x in lists]
            text_sha += [hashlib.sha256(b).hexdigest() for b in e.decode(lists)]
        return [pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]

    return map_added(df, [text], "n_tokens bigint, ids_sha256 string, decoded_sha256 string", make)
