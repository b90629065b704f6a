"""Language identification by error-correcting output codes.

Each language has a codeword; for every bit one binary classifier (logistic, over hashed byte n-grams of one to four) predicts it. Decoding
weighs each bit by its logistic loss: the language whose codeword has the smallest total loss wins; the score is its share of
exp(-loss) over all languages, and a text whose two best losses are closer than ``AMBIGUOUS`` per bit is flagged.

Decoding also rejects: a text of ``SURE_LETTERS`` letters and more whose two best losses are closer than ``APART`` per bit (an even mixture), or whose
best loss is ``UNLIKE`` per bit and more (letter junk, a language not learned), and every ``und``. Shorter texts say too little to be rejected,
and some junk and other languages still pass; with one learned language no code tells texts apart, so that none with a letter is rejected.

Training takes at most ``PER_LANGUAGE`` different labelled texts of each language (those of smallest hash of the text), each whole and as some excerpts, so that short
texts are learned too; prediction reads every whole text. Only text and label train, whatever other columns hold; nothing but text predicts. Texts become
features on the executors; the driver gets at most ``PER_LANGUAGE`` times five sparse rows of a language, each of at most ``FEATURES`` features, however long the texts are.

Cases: a null text, or one without a letter, is ``und`` with score 0 and not ambiguous; with one learned language every other text gets it;
without any labelled row every text is ``und``; rows with a null label don't train; repeated rows train once and are each predicted; ties go to the language
first in byte order; an empty table gives an empty result; extra columns pass through, but for those named like an output.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.llm.common import map_added, need
from corpuslake.session import keep

#: Rows of a language that train; hashed features; least bits of a code; epochs; margin per bit under which a text is ambiguous.
PER_LANGUAGE, FEATURES, BITS, EPOCHS, AMBIGUOUS = 300, 1 << 13, 15, 60, 0.05
#: Letters from which a text can be rejected; least margin and loss per bit that reject: held-out documents of one language have more of the one and less of the other.
SURE_LETTERS, APART, UNLIKE = 80, 0.5, 0.35
#: Chosen hashes up to which they are broadcast (under 2 MB).
BROADCAST_IDS = 100_000
UNDETERMINED = "und"


def codewords(n: int, bits: int = BITS) -> np.ndarray:
    """A 0/1 matrix with a row for each language: the exhaustive code where that is short, else the best of drawn codes by least distance."""
    if n <= 2:
        return np.arange(n)[:, None].repeat(bits, axis=1) % 2
    if (1 << (n - 1)) - 1 <= bits:
        columns = [[(c >> i) & 1 for i in range(n)] for c in range(1, 1 << (n - 1))]
        return np.array(columns).T
    bits = max(bits, 4 * int(np.ceil(np.log2(n))))
    rng, best, least = np.random.default_rng(7), None, -1
    for _ in range(200):
        code = rng.integers(0, 2, (n, bits))
        near = ((code[:, None, :] != code[None, :, :]).sum(axis=2) + bits * np.eye(n, dtype=int)).min()
        if near > least and (code.min(axis=0) < code.max(axis=0)).all():
            best, least = code, near
    return best


def counts_of(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of a whole text and their square-root counts, of length one."""
    b = np.frombuffer(b" " + text.lower() + b" ", np.uint8).astype(np.uint32)
    parts, key = [], np.zeros(len(b), np.uint32)
    for n in range(1, 5):
        if len(b) < n:
            break
        key = key[: len(b) - n + 1] * np.uint32(257) + b[n - 1 :] + np.uint32(1)
        parts.append(((key * np.uint32(2654435761)) >> np.uint32(7)) % np.uint32(FEATURES))
    found = np.bincount(np.concatenate(parts), minlength=FEATURES)
    at = np.nonzero(found)[0]
    v = np.sqrt(found[at]).astype(np.float32)
    return at, v / np.sqrt((v * v).sum())


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def enough_letters(text: str) -> bool:
    return len(text) >= SURE_LETTERS and next(islice(filter(str.isalpha, text), SURE_LETTERS - 1, None), None) is not None


def excerpts(text: str, key: int) -> list[str]:
    """The whole text and a few runs of its words."""
    words = text.split()
    rng, out = np.random.default_rng(key & 0xFFFFFFFF), [text]
    for size in (1, 3, 8, 25):
        at = int(rng.integers(0, max(1, len(words) - size + 1)))
        out.append(" ".join(words[at : at + size]))
    return out


class Model:
    """Languages, their codewords, and the weights of one classifier per bit."""

    def __init__(self, languages: list[str], code: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> None:
        self.languages, self.code, self.weights, self.bias = languages, code, weights, bias

    def losses(self, texts: list[bytes]) -> np.ndarray:
        z = np.empty((len(texts), self.code.shape[1]), np.float64)
        for i, t in enumerate(texts):
            at, v = counts_of(t)
            z[i] = v @ self.weights[at] + self.bias
        # log(1 + exp(-margin)) for a bit of 1, log(1 + exp(margin)) for 0.
        one, zero = np.logaddexp(0, -z), np.logaddexp(0, z)
        return one @ self.code.T + zero @ (1 - self.code).T

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool], list[bool]]:
        names, scores, unsure, rejected = [UNDETERMINED] * len(texts), [0.0] * len(texts), [False] * len(texts), [True] * len(texts)
        some = [i for i, t in enumerate(texts) if t and self.languages and has_letter(t)]
        if some:
            loss = self.losses([texts[i].encode() for i in some])
            share = np.exp(loss.min(axis=1, keepdims=True) - loss)
            share /= share.sum(axis=1, keepdims=True)
            best, ordered = loss.argmin(axis=1), np.sort(loss, axis=1)
            for r, i in enumerate(some):
                names[i], scores[i] = self.languages[best[r]], float(share[r, best[r]])
                unsure[i] = loss.shape[1] > 1 and bool((ordered[r, 1] - ordered[r, 0]) / loss.shape[1] < AMBIGUOUS)
                least = ordered[r] / self.code.shape[1]
                rejected[i] = len(least) > 1 and bool(least[1] - least[0] < APART or least[0] >= UNLIKE) and enough_letters(texts[i])
        return names, scores, unsure, rejected


def features_of(rows: DataFrame) -> DataFrame:
    """``lang, h, part, at, v``: the sparse features (indices and values, as bytes) of each text ``t`` and its excerpts that have a letter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for lang, h, text in zip(*[b.column(c).to_pylist() for c in ("lang", "h", "t")]):
                for part, x in enumerate(excerpts(text, h)):
                    if has_letter(x):
                        at, v = counts_of(x.encode())
                        out.append((lang, h, part, at.astype(np.uint16).tobytes(), v.tobytes()))
            columns = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=["lang", "h", "part", "at", "v"])

    return rows.select("lang", "h", "t").mapInArrow(run, "lang string, h bigint, part int, at binary, v binary")


def fit(rows: list[tuple[str, bytes, bytes]], languages: list[str]) -> Model:
    """From (language, indices, values) rows: logistic regression for all bits at once, by gradient steps with momentum; a step holds 512 rows as a matrix."""
    code = codewords(len(languages))
    number = {lang: k for k, lang in enumerate(languages)}
    at, v = [np.frombuffer(r[1], np.uint16) for r in rows], [np.frombuffer(r[2], np.float32) for r in rows]
    y = code[[number[r[0]] for r in rows]].astype(np.float32) if rows else np.zeros((0, code.shape[1]), np.float32)
    w, b = np.zeros((FEATURES, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    order = np.random.default_rng(3)
    for epoch in range(EPOCHS if rows else 0):
        rate = 4.0 * (1 - epoch / EPOCHS)
        shuffled = order.permutation(len(rows))
        for a in range(0, len(rows), 512):
            part = shuffled[a : a + 512]
            x = np.zeros((len(part), FEATURES), np.float32)
            for i, k in enumerate(part.tolist()):
                x[i, at[k]] = v[k]
            error = 1 / (1 + np.exp(-(x @ w + b))) - y[part]
            vw = 0.9 * vw - rate / len(part) * (x.T @ error) - rate * 1e-6 * w
            vb = 0.9 * vb - 0.1 * rate * error.mean(axis=0)
            w += vw
            b += vb
    return Model(languages, code, w, b)


def train(df: DataFrame, text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Fit on at most ``per_language`` different texts of each language; their hashes are chosen before any text moves."""
    need(df, text, lang)
    labelled = df.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("t"), F.xxhash64(text).alias("h")).where("lang IS NOT NULL AND t IS NOT NULL")
    order = Window.partitionBy("lang").orderBy("h")
    picked = labelled.groupBy("lang", "h").agg(F.count("*").alias("n")).withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_language)
    chosen = keep(picked.select("lang", "h"), "picked")
    languages = sorted((r["lang"] for r in chosen.select("lang").distinct().collect()), key=str.encode)  # a row per language
    # At most per_language hashes of each language: few enough to send to every task, so that no text moves; beyond the bound Spark chooses.
    few = chosen.count() <= BROADCAST_IDS
    own = labelled.join(F.broadcast(chosen) if few else chosen, ["lang", "h"], "left_semi").groupBy("lang", "h").agg(F.min("t").alias("t"))
    table = features_of(own).toArrow().to_pydict()
    rows = sorted(zip(table["h"], table["lang"], table["part"], table["at"], table["v"]))
    return fit([(lang, at, v) for _, lang, _, at, v in rows], languages)


def identify(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Append ``lang_pred string, score double, ambiguous boolean, rejected boolean``."""
    need(df, text)

    def make(column: pa.Array) -> list[pa.Array]:
        names, scores, unsure, rejected = [], [], [], []
        for a in range(0, len(column), 1_024):
            n, s, u, r = model.predict(column.slice(a, 1_024).to_pylist())
            names, scores, unsure, rejected = names + n, scores + s, unsure + u, rejected + r
        return [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(unsure, pa.bool_()), pa.array(rejected, pa.bool_())]

    return map_added(df, [text], "lang_pred string, score double, ambiguous boolean, rejected boolean", make)


def held_out(doc_id: Column) -> Column:
    """Rows that never train: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def digest(model: Model) -> str:
    return hashlib.sha256(model.weights.tobytes()).hexdigest()
