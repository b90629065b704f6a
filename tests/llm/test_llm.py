"""The training-data operators against brute force, exact round trips and held-out accuracy, with nulls, ties, repeats, empties and clashing names."""

import base64
import hashlib
import itertools
import os
import random
import re
from html.parser import HTMLParser

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from corpuslake.llm import bpe, htmltext, langid, minhash, packing, recompression, registry, tokencounts, vectors, warc
from corpuslake.llm.common import rolling_ids, window_ids
from corpuslake.llm.components import components

PATH, PATTERN, SF = public_tokenizers.path(registry.VOCABULARY), public_tokenizers.PATTERN, "/root/testdata/sf0.001"
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
ODD = [None, "", " ", "a", "it's  'S\n\n x\t", "naïve 日本語 ½ 🙂", "  x", "aaaa" * 40, "x" * 3_000 + "yz" * 500, "the the the", "the the the", "\x1c\x85 q", "<|endoftext|>"]


def docs(spark, texts, **more):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").withColumns({k: F.lit(v) for k, v in more.items()})


# ------------------------------------------------------------ 1: BPE
def test_bpe_equals_tiktoken_and_round_trips(spark):
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})
    df = docs(spark, ODD, ids="clash", decoded=3)
    got = bpe.decode(bpe.encode(df, PATH, PATTERN), PATH, PATTERN).orderBy("doc_id").collect()
    for r, t in zip(got, ODD):
        assert r["ids"] == enc.encode_ordinary(t or "") and bytes(r["decoded"]) == (t or "").encode()
    done = bpe.round_trip(df, PATH, PATTERN).orderBy("doc_id").collect()
    assert done[4]["ids_sha256"] == hashlib.sha256(" ".join(map(str, enc.encode_ordinary(ODD[4]))).encode()).hexdigest()
    assert bpe.encode(df.limit(0), PATH, PATTERN).count() == 0


def test_bpe_heap_and_recursion_agree():
    e = bpe.Engine(PATH, PATTERN)
    for w in ("internationalization", "zzzzqqqq", "ab" * 30, "éé" * 9):
        e.known.clear()
        e.learn({w})
        assert np.frombuffer(e.known[w], np.int32).tolist() == ([RANKS[w.encode()]] if w.encode() in RANKS else e.heap(w.encode()))


def test_bpe_long_pre_tokens():
    import time

    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})
    e, rng = bpe.Engine(PATH, PATTERN), random.Random(5)
    letters, cjk, thai = "abcdefghijklmnopqrstuvwxyz", [chr(0x4E00 + i) for i in range(3_000)], [chr(0x0E01 + i) for i in range(46)]
    texts = ["".join(rng.choice(a) for _ in range(n)) for a, n in ((letters, 193), (letters, 700), (cjk, 5_000), (thai, 3_000), ("ab", 900), ("é", 400), ("a", 1_999), (letters, 2_049), (cjk + list(letters), 2_000))]
    for t, ids in zip(texts, e.encode(texts)):
        assert ids.tolist() == enc.encode_ordinary(t)
    some = ["".join(rng.choice(letters) for _ in range(2_000)) for _ in range(10)]
    began = time.process_time()
    got = e.encode(some)
    assert time.process_time() - began < 15  # about 0.3 s each
    assert [x.tolist() for x in got] == [enc.encode_ordinary(t) for t in some]


def test_bpe_cuts_nothing_a_token_crosses():
    e = bpe.Engine(PATH, PATTERN)
    for b in sorted(RANKS, key=len)[-2_000:]:
        assert e.cut(b) == [b]


def test_bpe_null_ids(spark):
    df = spark.createDataFrame([(None,), ([],), ([None, 64],)], "ids array<int>")
    assert [r["decoded"] and bytes(r["decoded"]) for r in bpe.decode(df, PATH, PATTERN).collect()] == [None, b"", e_bytes(64)]


def e_bytes(i):
    return next(b for b, r in RANKS.items() if r == i)


# ------------------------------------------------------------ 2: packing
def test_bounds_of_many_lengths_are_lengths(spark):
    df = spark.range(200_100).selectExpr("2 * id + 1048577 AS n")
    bounds = packing.bounds_of(df, "n", 2)
    assert all(b % 2 == 1 for b in bounds) and bounds == [1_048_577 + 2 * (200_100 // 2 - 1), 1_048_577 + 2 * 200_099]


def brute_bounds(lengths, counts, k):
    best = None
    m = len(lengths)
    for inner in itertools.combinations(range(m - 1), min(k, m) - 1):
        cuts = [*inner, m - 1]
        cost, a = 0, 0
        for c in cuts:
            cost += sum((lengths[c] - lengths[i]) * counts[i] for i in range(a, c + 1))
            a = c + 1
        best = cost if best is None else min(best, cost)
    return best


def test_bounds_are_optimal():
    rng = random.Random(3)
    for _ in range(60):
        m, k = rng.randint(1, 9), rng.randint(1, 4)
        lengths = np.array(sorted(rng.sample(range(1, 60), m)))
        counts = np.array([rng.randint(1, 20) for _ in range(m)])
        bounds = packing.optimal_bounds(lengths, counts, k)
        cost = sum((min(b for b in bounds if b >= n) - n) * c for n, c in zip(lengths.tolist(), counts.tolist()))
        assert cost == brute_bounds(lengths.tolist(), counts.tolist(), k) and len(bounds) == min(k, m)


def test_packing_places_every_row_once(spark):
    df = spark.createDataFrame([(i if i % 7 else None, (i * i) % 50, "x") for i in range(300)] + [(5, None, "x"), (5, 25, "x")], "doc_id bigint, n int, bucket string")
    got = packing.pack(df, "n", buckets=3, budget=100).collect()
    assert len(got) == 302 and all(r["padding"] == r["bucket_length"] - (r["n"] or 0) >= 0 for r in got)
    spots = {(r["bucket"], r["batch_id"], r["batch_slot"]) for r in got}
    assert len(spots) == 302
    for b in {r["bucket"] for r in got}:
        own = [r for r in got if r["bucket"] == b]
        cap = max(1, 100 // own[0]["bucket_length"])
        assert max(r["batch_id"] for r in own) == -(-len(own) // cap) - 1 and max(r["batch_slot"] for r in own) < cap
    assert packing.pack(df.limit(0), "n").count() == 0


# ------------------------------------------------------------ 3: MinHash
def plain_sets(texts):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def brute_components(n, linked):
    root = list(range(n))
    for a, b in itertools.combinations(range(n), 2):
        if root[a] != root[b] and linked(a, b):
            lo, hi = sorted((root[a], root[b]))
            root = [lo if x == hi else x for x in root]
    return root


def near_texts(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(n)] for n in (60, 200, 30, 12, 5, 4, 1)]
    texts = [" ".join(b) for b in base]
    for b in base:
        for k in (1, 2, 3, 5, 8):
            c = list(b)
            for _ in range(min(k, len(c))):
                c[rng.randrange(len(c))] = rng.choice(vocabulary)
            texts.append(" ".join(c))
        texts += [" ".join(b), " ".join(b).upper(), "  ".join(b)]
    common = " ".join(rng.choice(vocabulary) for _ in range(40))
    texts += [common + " " + " ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 60))) for _ in range(25)]
    return [*texts, None, "", "   ", "ÉCOLE école", "École école"]


def test_minhash_equals_brute_force(spark):
    texts = near_texts()
    sets = plain_sets(texts)
    want = brute_components(len(texts), lambda a, b: bool(sets[a]) and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]))
    got = minhash.components_of(docs(spark, texts, n_shingles=1, kept="x", bucket=2)).orderBy("doc_id").collect()
    assert [r["component_id"] for r in got] == want and [r["n_shingles"] for r in got] == [len(s) for s in sets]
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


@pytest.mark.parametrize("cut", [None, 40])
def test_minhash_tiles_join_all_that_links_join(cut):
    sets = [minhash.shingles(t.encode()) for t in near_texts() if t and t.strip()]
    n = len(sets)
    rows = [(0 if cut is None or i < cut else 1, i, i, x) for i, x in enumerate(sets)]
    across = lambda a, b: (cut is None or (a < cut) != (b < cut)) and minhash.similar(sets[a], sets[b])
    root = list(range(n))
    for a, b in minhash._tile(rows, cut is None):
        lo, hi = sorted((root[a], root[b]))
        root = [lo if x == hi else x for x in root]
    assert root == brute_components(n, across) and len(set(root)) < n
    joined = [(side, i, 0, x) for side, i, _, x in rows]
    assert minhash._tile(joined, cut is None) == []


def test_overlap_bounds_hold():
    rng = np.random.default_rng(8)
    pool = rng.integers(0, 2**63, 9_000).astype(np.uint64)
    sets = [np.unique(rng.choice(pool, n)) for n in (1, 2, 40, 300, 3_000, 8_000)] + [np.empty(0, np.uint64)]
    bounds = minhash.overlap_bounds(sets, sets)
    assert all(bounds[i, j] >= len(np.intersect1d(x, y)) for i, x in enumerate(sets) for j, y in enumerate(sets))
    assert bounds[3, 3] == len(sets[3]) and bounds[2, 3] < 10


def test_minhash_edges(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")], "doc_id bigint, text string")
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.components_of(df).collect()), key=str)
    assert got == [(1, 1, True), (1, 1, True), (2, 1, False), (None, None, True), (None, None, True)]
    assert minhash.components_of(df.limit(0)).count() == 0
    assert sorted(str(r["doc_id"]) for r in minhash.deduplicate(df).collect()) == ["1", "1", "None", "None"]


def test_signature_agreement_tracks_similarity():
    rng = np.random.default_rng(0)
    both = rng.integers(0, 2**63, 4_000).astype(np.uint64)
    a, b = np.sort(both[:3_500]), np.sort(both[500:])
    assert abs((minhash.signature(a) == minhash.signature(b)).mean() - 0.75) < 0.15
    assert len(minhash.signature(a[:1])) == minhash.BINS


def test_components(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3), (200, 50), (200, 60)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(path, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 200: 50, 50: 50, 60: 50}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# ------------------------------------------------------------ 4, 5: vectors
BAD = [None, [], [0.0, 0.0], [float("nan"), 1.0], [float("inf"), 1.0], [None, 1.0], [-0.0, 0.0]]


def test_search_edges_and_ties(spark):
    rows = [(i, v) for i, v in enumerate(BAD)] + [(10, [1.0, 0.0]), (11, [1.0, 0.0]), (12, [0.0, 1.0]), (20, [2.0, 0.0]), (None, [9.0, 9.0]), (30, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("rank", F.lit("clash"))
    got = [tuple(r) for r in vectors.search(df, df.where("vec_id % 20 = 0"), 20).orderBy("query_id", "rank").collect()]
    assert got == [(20, 1, 10, 2.0), (20, 2, 11, 2.0), (20, 3, 12, 0.0)]
    assert vectors.search(df.limit(0), df, 5).count() == 0


def test_search_recall(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3_000, 32)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    found = vectors.search(df, df.where("vec_id % 100 = 0"), 20).collect()
    y = x.astype(float)
    hit = 0
    for q in range(0, 3_000, 100):
        s = y @ y[q]
        s[q] = -np.inf
        own = [r for r in found if r["query_id"] == q]
        assert [r["rank"] for r in sorted(own, key=lambda r: (-r["score"], r["vec_id"]))] == list(range(1, 21))
        assert all(abs(r["score"] - s[r["vec_id"]]) < 1e-9 for r in own)
        hit += len({r["vec_id"] for r in own} & set(np.lexsort((np.arange(3_000), -s))[:20].tolist()))
    assert hit / 600 >= 0.9


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_search_recall_on_embeddings(spark, sf):
    t = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").toPandas()
    x, ids = np.stack(t["embedding"].to_numpy()).astype(float), t["vec_id"].to_numpy()
    found = registry.op4_multi_index(spark, f"/root/testdata/{sf}").toPandas()
    hit, asked = 0, np.nonzero(ids % 20 == 0)[0]
    for q in asked:
        s = x @ x[q]
        s[q] = -np.inf
        own = found[found["query_id"] == ids[q]].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21))
        hit += len(set(own["vec_id"]) & set(ids[np.lexsort((ids, -s))[:20]].tolist()))
    assert hit / (20 * len(asked)) >= 0.9


def test_search_keeps_ties_of_many_copies_in_order(spark):
    rng = np.random.default_rng(6)
    one = rng.normal(size=48)
    x = np.concatenate([np.tile(one, (700, 1)), rng.normal(size=(300, 48))])
    ids = rng.permutation(1_000)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id bigint, embedding array<double>").withColumns({"shard": F.lit(1), "cell": F.lit("c"), "cells": F.lit(2)})
    saved, vectors.SHARD_VALUES = vectors.SHARD_VALUES, 48 * 100
    try:
        found = vectors.search(df, df.where(F.col("vec_id") == int(ids[0])), 20).collect()
    finally:
        vectors.SHARD_VALUES = saved
    assert [(r["rank"], r["vec_id"]) for r in sorted(found, key=lambda r: r["rank"])] == list(enumerate(sorted(set(ids[:700].tolist()) - {int(ids[0])})[:20], 1))


def test_large_cells_lie_in_several_shards():
    first, parts = vectors.shards_of(np.array([3, 4, 30, 0, 5, 5]), 10)
    assert first.tolist() == [0, 0, 1, 4, 4, 4] and parts.tolist() == [1, 1, 3, 1, 1, 1]


def test_cells_come_by_growing_distance():
    rng = np.random.default_rng(4)
    a, b, n = rng.random(5), rng.random(7), rng.integers(0, 3, 35)
    order = vectors.traverse(a, b, n, 10**9)
    d = [a[c // 7] + b[c % 7] for c in order]
    assert d == sorted(d) and set(order) == set(np.nonzero(n)[0].tolist())
    some = vectors.traverse(a, b, n, 5)
    assert n[some].sum() >= 5 and n[some[:-1]].sum() < 5


def test_near_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(12, 16))
    x = np.concatenate([b + rng.normal(size=(15, 16)) * s for b, s in zip(base, np.linspace(0.02, 0.5, 12))]).astype(np.float32)
    x = np.concatenate([x, x[:5]])
    label = (np.arange(len(x)) // 40).tolist()
    rows = [(i, v.tolist(), n) for i, (v, n) in enumerate(zip(x, label))] + [(900 + i, v, 0) for i, v in enumerate(BAD)] + [(950, x[0].tolist(), None), (None, x[0].tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").withColumns({"n_links": F.lit(1), "v": F.lit("clash")})
    y = x.astype(float)
    unit = y / np.linalg.norm(y, axis=1)[:, None]
    link = (unit @ unit.T >= 0.93) & (np.array(label)[:, None] == np.array(label)[None, :])
    np.fill_diagonal(link, False)
    want = brute_components(len(x), lambda a, b: link[a, b])
    for block in (1_024, 8):
        got = {r["vec_id"]: r for r in vectors.near_duplicates(df, block=block).collect()}
        assert [got[i]["n_links"] for i in range(len(x))] == link.sum(axis=1).tolist() and [got[i]["component_id"] for i in range(len(x))] == want
        assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in (*range(900, 907), 950)) and got[None]["component_id"] is None
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_repeated_vector_ids_count_apart(spark):
    a, b, c = [1.0, 0.0], [0.0, 1.0], [1.0, 0.01]
    rows = [(1, a, "x"), (1, b, "x"), (2, a, "x"), (3, b, "y"), (1, a, "y"), (4, c, "x"), (1, a, "x")]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label string")).collect())
    assert got == [(1, 0, 1), (1, 0, 1), (1, 3, 1), (1, 3, 1), (2, 3, 1), (3, 0, 3), (4, 3, 1)]


def test_error_bounds_hold():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(60, 64))
    u = x / np.linalg.norm(x, axis=1)[:, None]
    q, s, n, e = vectors.quantise(u)
    exact, approx = u @ u.T, (q.astype(float) @ q.T) * s[:, None] * s[None, :]
    assert (np.abs(exact - approx) <= n[:, None] * e[None, :] + e[:, None] * n[None, :] + e[:, None] * e[None, :] + 1e-12).all()


# ------------------------------------------------------------ 6: WARC
def test_warc_round_trip(spark, tmp_path):
    big, long = "é" * 100, "x" * 300_000
    rows = [(5, "http://a/5", big), (3, None, big), (9, "http://a/\r\n9", big), (1, "u", "small"), (2, "u", "small"), (7, "u", None), (8, "u", ""), (3, "other", big), (4_000, "u", long), (None, "u", big), (-7, "u", "neg")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({"payload": F.lit(1), "shard": F.lit("c")})
    seen = []
    for run in ("a", "b"):
        out = f"file://{tmp_path}/{run}"
        manifest = warc.write(df.orderBy(F.rand()), out, roll=2_000)
        got = warc.read(spark, out).collect()
        assert len(got) == len(rows) and not os.path.exists(f"{tmp_path}/{run}/_temporary")
        by = {(r["page_id"], r["url"]): r for r in got}
        assert by[(5, "http://a/5")]["refers_to"] == 3 and by[(9, "http://a/%0D%0A9")]["record_type"] == "revisit"
        assert by[(3, "urn:none")]["record_type"] == by[(3, "other")]["record_type"] == by[(None, "u")]["record_type"] == "response"
        assert by[(2, "u")]["record_type"] == "response" and bytes(by[(4_000, "u")]["payload"]) == long.encode()
        assert by[(7, "u")]["payload_bytes"] == 0 and by[(5, "http://a/5")]["payload_digest"] == hashlib.sha256(big.encode()).hexdigest()
        seen.append(sorted((r["name"], r["sha256"]) for r in manifest.collect()))
    assert seen[0] == seen[1]
    empty = f"file://{tmp_path}/empty"
    assert warc.write(df.limit(0), empty).count() == 0 and warc.read(spark, empty).count() == 0


def test_warc_cuts_shards_of_repeated_and_null_ids(spark, tmp_path):
    rows = [(None if i % 3 else 7, f"u{i}", f"text {i % 40}") for i in range(300)] + [(i, "u", "x" * 200) for i in range(50)]
    out = f"file://{tmp_path}/hot"
    manifest = warc.write(spark.createDataFrame(rows, "page_id bigint, url string, html string"), out, shard_ids=8).collect()
    parts = {}
    for r in manifest:
        parts.setdefault(r["shard"], set()).add(r["cut"])
    assert len(parts[-(2**62)]) > 3 and len(parts[0]) > 1 and parts[5] == {0}
    got = warc.read(spark, out).collect()
    assert len(got) == len(rows) and sum(r["page_id"] is None for r in got) == 200
    first = next(iter(warc.parse(open(f"{tmp_path}/hot/{manifest[0]['name']}", "rb").read())))[0]
    assert first["WARC-Type"] == "warcinfo" and first["WARC-Filename"] == manifest[0]["name"]


def test_uncommitted_files_are_not_read(spark, tmp_path):
    out = f"file://{tmp_path}/w"
    warc.write(spark.createDataFrame([(1, "u", "x")], "page_id bigint, url string, html string"), out)
    (tmp_path / "w" / "shard-99999999999999999999-00000-00000.warc.gz").write_bytes(b"left by a lost task")
    assert warc.read(spark, out).count() == 1


# ------------------------------------------------------------ 7: token counts
def viterbi(word, score):
    best = [(0.0, 0)] + [None] * len(word)
    for i in range(1, len(word) + 1):
        best[i] = max(((best[j][0] + score[word[j:i]], -(-best[j][1] + 1)) for j in range(i) if word[j:i] in score), key=lambda x: (x[0], x[1]))
    return -best[-1][1]


def test_trie_counts_equal_viterbi(spark):
    t = tokencounts.Trie(PATH, PATTERN)
    texts = [*ODD, "internationalization internationally inter", "zqzqzq zqz"]
    got = [r["n_tokens"] for r in tokencounts.count_tokens(docs(spark, texts, n_tokens="clash"), PATH, PATTERN).orderBy("doc_id").collect()]
    assert got == [sum(viterbi(w.encode(), t.score) if len(w) < 200 else t.known.get(w) or t.count([w])[0] for w in t.find(x or "")) for x in texts]


def test_trie_counts_of_repeats_and_nothing(spark):
    got = tokencounts.count_tokens(docs(spark, ["a few words", "a few words", None]), PATH, PATTERN).orderBy("doc_id").collect()
    assert got[0]["n_tokens"] == got[1]["n_tokens"] > 0 and got[2]["n_tokens"] == 0
    assert tokencounts.count_tokens(docs(spark, ["x"]).limit(0), PATH, PATTERN).count() == 0


# ------------------------------------------------------------ 8: recompression
def brute_repeats(texts, window=50):
    words = [(t or "").split() for t in texts]
    first = {}
    for d, w in enumerate(words):
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), d)
    out = []
    for d, w in enumerate(words):
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def repeat_texts(seed):
    rng = random.Random(seed)
    few = seed % 2
    word = lambda: f"w{rng.randrange(3 if few else 500)}"
    passages = [[word() for _ in range(n)] for n in (49, 50, 51, 60, 120)] + [["run"] * 70, ["a", "b"] * 40]
    texts = []
    for _ in range(40):
        parts = [[word() for _ in range(rng.randint(0, 40))]]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, 5)
            parts += [p[a:], [word() for _ in range(rng.randint(0, 9))]]
        texts.append(" ".join(x for p in parts for x in p))
    return [*texts, texts[3], texts[5] + " ", None, "", "short"]


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_repeats_equal_brute_force(spark, seed):
    texts = repeat_texts(seed)
    got = recompression.remove_repeats(docs(spark, texts, n_words="c", positions=1, copy_of=2, key=3)).orderBy("doc_id").collect()
    assert [(r["n_words"], r["n_removed"], r["kept_text"]) for r in got] == brute_repeats(texts)


def test_equal_windows_take_equal_anchors():
    rng = np.random.default_rng(0)
    for alphabet in (2, 4, 1_000):
        names = rng.integers(1, 2**63, alphabet).astype(np.uint64)
        for _ in range(60):
            middle = names[rng.integers(0, alphabet, 50)]
            spots = set()
            for _ in range(4):
                left, right = names[rng.integers(0, alphabet, rng.integers(0, 30))], names[rng.integers(0, alphabet, rng.integers(0, 30))]
                spots.add(int(recompression.anchors(np.concatenate([left, middle, right]))[len(left)]) - len(left))
            assert len(spots) == 1 and recompression.EDGE <= min(spots) < 50 - recompression.EDGE
    ids = rng.integers(1, 2**63, 300).astype(np.uint64)
    assert len(set(rolling_ids(np.concatenate([ids, ids]), 50).tolist())) == len(set(map(bytes, np.lib.stride_tricks.sliding_window_view(np.concatenate([ids, ids]), 50).copy())))
    assert len(window_ids(ids, 5)) == 296


def test_repeat_edges(spark):
    p = " ".join(f"x{i}" for i in range(60))
    df = spark.createDataFrame([(None, p), (2, p), (2, p), (3, p)], "doc_id bigint, text string")
    got = sorted((str(r["doc_id"]), r["n_removed"]) for r in recompression.remove_repeats(df).collect())
    assert got == [("2", 0), ("2", 0), ("3", 60), ("None", 0)]
    assert recompression.remove_repeats(df.limit(0)).count() == 0


# ------------------------------------------------------------ 9: language ID
@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_language_accuracy_and_inputs(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    got = registry.op9_output_codes(spark, SF).join(d.select("doc_id", "lang"), "doc_id")
    held = got.where("held_out")
    assert held.where("lang_pred = lang").count() / held.count() >= 0.97
    model = langid.train(d.where(~langid.held_out(F.col("doc_id"))))
    odd = docs(spark, [None, "", "123 !!", "der und die das", "x"], score="c", lang="zz")
    rows = langid.identify(odd, model).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in rows[:3]] == ["und"] * 3 and all(0 <= r["score"] <= 1 for r in rows) and rows[3]["lang_pred"] in model.languages
    again = langid.train(d.where(~langid.held_out(F.col("doc_id"))).orderBy(F.rand()))
    assert langid.digest(model) == langid.digest(again)


def test_language_learns_from_text_and_label_alone(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").where(~langid.held_out(F.col("doc_id")))
    other = d.select((F.col("doc_id") * 7 + 1).alias("doc_id"), "text", "lang", F.lit("s").alias("source"))
    assert langid.digest(langid.train(d)) == langid.digest(langid.train(other.unionByName(other.limit(40))))
    assert langid.identify(d.limit(0), langid.train(d.limit(0))).count() == 0
    model = langid.train(d)
    copies = langid.identify(docs(spark, ["the and of that with", "the and of that with"]), model).collect()
    assert len(copies) == 2 and copies[0]["score"] == copies[1]["score"]


def test_language_without_or_with_one_label(spark):
    df = docs(spark, ["hello there", "x"], lang=None).withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in langid.identify(df, langid.train(df)).collect()} == {"und"}
    one = df.withColumn("lang", F.lit("en"))
    assert {r["lang_pred"] for r in langid.identify(one, langid.train(one)).collect()} == {"en"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_language_stage_rejects_what_decoding_cannot_tell(spark):
    import corpus_pipeline

    d = spark.read.parquet(f"{SF}/documents.parquet")
    rng = random.Random(4)
    junk = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(3_000))
    russian = "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства. "
    long = {r["lang"]: r["text"].split() for r in d.where("length(text) > 1500").orderBy("doc_id", ascending=False).collect()}
    even = " ".join(long["de"][:100] + long["fr"][:100])
    odd = spark.createDataFrame([(-1, junk), (-2, russian), (-3, even), (-4, "1 2 3"), (-5, None), (-6, "De.")], "doc_id bigint, text string")
    got = {r["doc_id"] for r in corpus_pipeline.language(spark, d.unionByName(odd, allowMissingColumns=True), SF).collect()}
    assert {i for i in got if i < 0} == {-6}
    clean = {r["doc_id"] for r in d.where(langid.held_out(F.col("doc_id"))).collect()}
    assert clean and clean <= got


@pytest.mark.parametrize("n", [1, 2, 3, 4, 7, 20])
def test_codewords_differ(n):
    code = langid.codewords(n)
    assert len({tuple(r) for r in code.tolist()}) == n


# ------------------------------------------------------------ 10: HTML
@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<p>a<p>b", "a\n\nb"), ("<b>a</b> <i>b</i>c", "a bc"), ("<div>a</div><div>b</div>", "a\nb"), ("a<br>b<br><br>c", "a\nb\n\nc"), ("<ul><li>a<li>b<ol start=9><li>c<li>d</ol></ul>", "- a\n- b\n   9. c\n  10. d"),
        ("<table><tr><td>a<td>bb<tr><td>ccc<td>d</table>", "a    bb\nccc  d"), ("<table><tr><th>日本<th>x<tr><td>a<td>y</table>", "日本  x\na     y"), ("<table><tr><td colspan=2>wide<td>z<tr><td>a<td>b<td>c</table>", "wide  z\na  b  c"),
        ("<pre>\n a\n  b</pre>", "a\n  b"), ("<script>x</script><style>y</style><!-- c --><p hidden>h</p><p style='DISPLAY : none'>n</p><p style=visibility:hidden>v</p>ok", "ok"), ("x &lt;b&gt; &amp; &#233;", "x <b> & é"), ("<title>t</title><p>b", "b"), ("", ""), ("<p", ""), ("1 < 2", "1 < 2"),
        ("<blockquote>q</blockquote><dl><dt>t<dd>d</dl>", "q\n\nt\n    d"), ("<p>a</p><hr><p>b</p>", "a\n\nb"), ("<table><thead><tr><th>h</thead><tfoot><tr><td>f</tfoot><tbody><tr><td>b</table>", "h\nb\nf"), ("<select><option>a<option>b</select>", "a\nb"),
    ],
)
def test_rendering(html, text):
    assert htmltext.render(html).strip() == text.strip()


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<table><tr><td><p>a<p>bb<td>c<tr><td>d<td>e</table>", "a   c\n\nbb\nd   e"), ("<table><tr><td>x<td><ul><li>a<li>b</ul><td>y</table>", "x  - a  y\n   - b"),
        ("<table><tr><td><pre>def f():\n    return 1</pre><td>z</table>", "def f():      z\n    return 1"), ("<table><tr><td><pre>  in\nout</pre></table>", "  in\nout"),
        ("<table><tr><td>o<td><table><tr><td>a<td>bb<tr><td>ccc<td>d</table></table>", "o  a    bb\n   ccc  d"), ("<table><tr><td><h1>T</h1><ul><li>a<li>b</ul><pre>f:\n  1</pre></table>", "T\n\n- a\n- b\n\nf:\n  1"),
        ("<table><tr><td colspan=2>w<br>v<td>z<tr><td>aa<td>b<td>c</table>", "w      z\nv\naa  b  c"), ("<table><tr><td rowspan=2>a<br>b<td>c<tr><td>d</table>", "a  c\nb\n   d"),
        ("<table><tr><td colspan=2>wide one<br>v<td>y<br>z<tr><td>a<td>b<td>c</table>", "wide one  y\nv         z\na  b  c"), ("<table><tr><pre>a\n  b</pre></table>", "a\n  b"),
    ],
)
def test_rendering_keeps_lines_of_cells(html, text):
    assert htmltext.render(html) == text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds", "so x=1 holds"), ("<math><semantics><mi>y</mi><annotation>\\y</annotation><annotation-xml><ci>y</ci></annotation-xml></semantics></math>!", "y!"),
        ("<math><mfrac><mn>1</mn><mn>2</mn></mfrac></math>", "1 2"), ("<svg><title>t</title><desc>d</desc><metadata>m</metadata><defs><text>n</text></defs><text>A</text><text>B</text></svg>", "A B"),
        ("<svg><defs/><title/><path d='M0'/><text>A</text></svg><p>b</p>", "A\n\nb"), ("<desc>d</desc><div/>e", "d\ne"), ("a<text>b</text>c", "abc"), ("<p>a<svg style='display:none'><text>n</text></svg>b", "ab"),
    ],
)
def test_rendering_shows_math_and_svg(html, text):
    assert htmltext.render(html) == text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<object data=x><p>instead</p></object>", "instead"), ("<div style='visibility:hidden'>a<b style='visibility: visible'>b</b>c</div>", "b"), ("<p style='visibility:hidden;visibility:visible'>v", "v"),
        ("<details>x<summary>s</summary><p>no</p>y</details>z", "s\n\nz"), ("<details open><summary>s</summary><p>yes</p></details>", "s\n\nyes"),
        ("<table style='visibility:hidden'><tr><td>a<td style='visibility:visible'>b</table>", "b"), ("<table><tbody style='visibility:hidden'><tr><td>a<td>c</tbody><tr><td>b</table>", "b"),
    ],
)
def test_rendering_follows_visibility(html, text):
    assert htmltext.render(html).strip() == text


class PlainText(HTMLParser):
    """All text of a page but that of head, scripts and styles, by another parser and without any layout."""

    def __init__(self):
        super().__init__()
        self.words, self.off = [], 0

    def handle_starttag(self, tag, attrs):
        self.off += tag in ("head", "script", "style")

    def handle_endtag(self, tag):
        self.off -= tag in ("head", "script", "style") and self.off > 0

    def handle_data(self, data):
        self.words += [] if self.off else "".join(data.split())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_rendering_keeps_all_text_of_pages(spark):
    got = registry.op10_render(spark, "/root/testdata/sf0.01").toPandas().set_index("page_id")["text"]
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").toPandas().set_index("page_id")["html"]
    assert set(got.index) == set(pages.index)
    for page, source in pages.items():
        plain = PlainText()
        plain.feed(source)
        marks = re.sub(r"(?m)^ *(- |\d+\. )", "", got[page])
        assert "".join(marks.split()) == "".join(plain.words), page


def test_rendering_survives_depth_and_nulls(spark):
    assert htmltext.render("<div>" * 20_000 + "deep").endswith("deep")
    assert "x" in htmltext.render("<table><tr><td>" * 40 + "x")
    df = spark.createDataFrame([(1, None), (2, "")], "page_id bigint, html string").withColumn("text", F.lit(7))
    assert [r["text"] for r in htmltext.extract_text(df).orderBy("page_id").collect()] == [None, ""]
    assert htmltext.extract_text(df.limit(0)).count() == 0
    assert [r["text"] for r in htmltext.extract_text(spark.createDataFrame([(1, "<p>a"), (1, "<p>a")], "page_id bigint, html string")).collect()] == ["a", "a"]


# ------------------------------------------------------------ queries and pipeline
@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = registry.QUERIES[name](spark, SF).toArrow(), con.sql(registry.ORACLES[name]).to_arrow_table()
    key = lambda t: sorted(tuple(str(r[c]) for c in sorted(t.column_names)) for r in t.to_pylist())
    assert sorted(got.column_names) == sorted(want.column_names) and key(got) == key(want)


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    word = lambda: rng.choice("the quick brown fox jumps over lazy dogs and cats while rivers run under old stone bridges near green hills".split()) + str(rng.randrange(60))
    own = lambda n: " ".join(word() for _ in range(n))
    shared, whole = own(70), own(120)
    texts = ["1 2 3", None, whole, whole, whole + " tail", f"{own(90)} {shared} {own(90)}", f"{own(200)} {shared} {own(100)}", own(40)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    df.write.parquet(f"file://{tmp_path}/documents.parquet")
    at = df
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, f"file://{tmp_path}")
        assert at.columns == df.columns
        at = spark.createDataFrame(at.collect(), df.schema)
    left = {r["doc_id"]: r for r in at.collect()}
    assert set(left) == {2, 5, 6, 7}
    assert left[5]["text"] == texts[5] and shared not in left[6]["text"] and left[6]["n_chars"] == len(left[6]["text"])
    got = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    assert {r["doc_id"] for r in got} == set(left) and all(r["n_words"] == len(left[r["doc_id"]]["text"].split()) for r in got)


CLASHES = ("lang_pred", "score", "ambiguous", "rejected", "n_shingles", "component_id", "kept", "n_words", "n_removed", "kept_text", "id", "key", "positions", "copy_of")


def test_pipeline_stages_keep_columns_of_any_name(spark, tmp_path):
    import corpus_pipeline

    long = " ".join(f"word{i % 90}" for i in range(200))
    rows = [(i, t, "en", "s", 1) for i, t in ((1, long), (2, long), (3, " ".join(f"own{i}" for i in range(150)) + " " + long), (None, "no id " * 9), (4, None), (5, "five"), (5, "five again"))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumns({c: F.concat(F.lit(f"{c}-"), F.coalesce("doc_id", F.lit(0))) for c in CLASHES})
    at = df
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = spark.createDataFrame(stage(spark, at, "").collect(), df.schema)
        assert all(r[c] == f"{c}-{r['doc_id'] or 0}" for r in at.collect() for c in CLASHES), name
        assert stage(spark, df.limit(0), "").columns == df.columns and stage(spark, df.limit(0), "").count() == 0
    assert sorted(str(r["doc_id"]) for r in at.collect()) == ["1", "3", "5", "5", "None"]
    packed = corpus_pipeline.packing_plan(spark, at, "")
    assert packed.count() == 5 and corpus_pipeline.packing_plan(spark, df.limit(0), "").count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_pipeline_equals_brute_force(spark):
    import corpus_pipeline

    d = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(d.where(~langid.held_out(F.col("doc_id"))))
    rows = sorted((r["doc_id"], r["text"]) for r in d.collect())
    rows = [r for r, gone in zip(rows, model.predict([t for _, t in rows])[3]) if not gone]
    sets = [minhash.shingles((t or "").encode()) for _, t in rows]
    classes = brute_components(len(rows), lambda a, b: minhash.similar(sets[a], sets[b]))
    rows = [r for i, r in enumerate(rows) if classes[i] == i]
    rows = [(i, t if not gone else left) for (i, t), (_, gone, left) in zip(rows, brute_repeats([t for _, t in rows]))]
    tokens = {i: len(t.split()) for i, t in rows}
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert {i: r["n_words"] for i, r in got.items()} == tokens
    lengths, counts = np.unique([max(1, n) for n in tokens.values()], return_counts=True)
    bounds = packing.optimal_bounds(lengths, counts)
    assert all(r["bucket_length"] == min(b for b in bounds if b >= r["n_words"]) for r in got.values())
    batches = {}
    for r in got.values():
        batches.setdefault((r["bucket"], r["batch_id"]), []).append(r["bucket_length"])
    assert all(len(x) == 1 or sum(x) <= packing.BUDGET for x in batches.values()) and len({(r["bucket"], r["batch_id"], r["batch_slot"]) for r in got.values()}) == len(got)
