"""Token counts of a unigram tokenizer by dynamic programming over a trie of pre-tokens.

The vocabulary's pieces are byte strings with a log probability; the tokens of a pre-token are its most probable split (of equally probable
ones that of fewest pieces). The best score and count of a prefix depend on the prefix alone, so a worker puts the distinct pre-tokens of a batch
into a trie (as sorted order, where neighbours share a prefix) and computes each forward score once per shared prefix; the counts at the
terminals are what documents add up. A public rank file has no probabilities; Zipf's law stands in: p(rank) ~ 1 / (rank + 1).

Walking the distinct pre-tokens in byte order with a stack of scores is the depth-first walk of their trie: a stack entry is a node, the bytes shared with the word before
are the path that stays, and the last entry of a word is its terminal, so that no node is ever computed twice and only one path is held.

Cases: null and empty texts have 0 tokens; repeated rows are each counted; an empty table gives an empty result; all 256 bytes must be pieces, so every text has a split; pre-tokens of any length take time in
proportion to their length; extra columns pass through, but for one named like the output.
"""

from __future__ import annotations

import base64
import math
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from corpuslake.llm.common import map_added, need

#: Pre-tokens a task remembers.
KNOWN_WORDS = 500_000


def read_pieces(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


class Trie:
    """Counts of pre-tokens, shared by prefix."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex

        ranks = read_pieces(path)
        total = math.log(math.fsum(1 / (r + 1) for r in ranks.values()))
        self.score = {b: -math.log(r + 1) - total for b, r in ranks.items()}
        self.lengths: dict[int, list[int]] = {}
        by_last: dict[int, set[int]] = {}
        for b in self.score:
            by_last.setdefault(b[-1], set()).add(len(b))
        self.lengths = {k: sorted(v) for k, v in by_last.items()}
        self.find = regex.compile(pattern).findall
        self.known: dict[str, int] = {}

    def learn(self, words: set[str]) -> None:
        """Terminal counts of new pre-tokens, in byte order: the forward scores of the prefix shared with the word before stay."""
        score, lengths = self.score, self.lengths
        best, count = [0.0], [0]
        last = b""
        for b, w in sorted((w.encode(), w) for w in words):
            shared, most = 0, min(len(b), len(last))
            while shared < most and b[shared] == last[shared]:
                shared += 1
            del best[shared + 1 :], count[shared + 1 :]
            for i in range(shared, len(b)):
                end, top, n = i + 1, -math.inf, 0
                for size in lengths[b[i]]:
                    if size > end:
                        break
                    s = score.get(b[end - size : end])
                    if s is not None:
                        v, k = best[end - size] + s, count[end - size] + 1
                        if v > top or v == top and k < n:
                            top, n = v, k
                best.append(top)
                count.append(n)
            self.known[w] = count[-1]
            last = b

    def count(self, texts: list[str | None]) -> list[int]:
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        split = [self.find(t) if t else [] for t in texts]
        self.learn({w for ws in split for w in ws if w not in self.known})
        at = self.known.__getitem__
        return [sum(map(at, ws)) for ws in split]


@cache
def trie(path: str, pattern: str) -> Trie:
    return Trie(path, pattern)


def count_tokens(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """Append ``out bigint``: the number of tokens of the whole text."""
    need(df, text)

    def make(column: pa.Array) -> list[pa.Array]:
        t, counts = trie(path, pattern), []
        for a in range(0, len(column), 1_024):
            counts += t.count(column.slice(a, 1_024).to_pylist())
        return [pa.array(counts, pa.int64())]

    def forget() -> None:
        trie(path, pattern).known.clear()

    return map_added(df, [text], f"`{out}` bigint", make, forget)
