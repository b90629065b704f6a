"""One query per operator, over its whole table, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.llm import bpe, htmltext, langid, minhash, packing, recompression, tokencounts, vectors, warc
from corpuslake.llm.common import WORD, table
from corpuslake.session import keep, scratch_path

VOCABULARY = "byte_bpe_50k.tiktoken"


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = bpe.round_trip(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return done.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op2_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A token is a word here, so that SQL can say the same; ``packing.pack`` takes any column of lengths."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_words"))
    return packing.pack(keep(docs, "lengths"), "n_words")  # texts are read once


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.components_of(table(spark, sf_dir, "documents"))


def op4_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return vectors.search(rows, rows.where(F.col("vec_id") % 20 == 0), 20)


def op5_int8_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), out)
    return warc.read(spark, out, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_trie_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokencounts.count_tokens(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN).select("doc_id", "n_tokens")


def op8_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return recompression.remove_repeats(docs, digest_only=True).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_output_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    shown = docs.select("doc_id", "text", langid.held_out(F.col("doc_id")).alias("held_out"))
    return langid.identify(shown, model).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def op10_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    return htmltext.extract_text(pages).select("page_id", "text", F.length("text").alias("n_chars"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_bpe, op2_length_buckets, op3_minhash, op4_multi_index, op5_int8_tiles, op6_warc, op7_trie_counts, op8_recompression, op9_output_codes, op10_render)
}

_W = r"[^\x20\x09-\x0D]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op2_length_buckets": f"""
WITH RECURSIVE d AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '{_W}'))::BIGINT AS n_words FROM documents),
h AS (SELECT greatest(n_words, 1) AS l, count(*) AS c FROM d GROUP BY 1),
t AS (SELECT row_number() OVER (ORDER BY l) AS j, l, (sum(c) OVER (ORDER BY l))::BIGINT AS cc, (sum(c * l) OVER (ORDER BY l))::BIGINT AS s FROM h),
z AS (SELECT j, cc, s FROM t UNION ALL SELECT 0, 0, 0),
dp(k, j, cost, cuts) AS (
  SELECT 0::BIGINT, 0::BIGINT, 0::BIGINT, []::BIGINT[]
  UNION ALL
  SELECT k, j, v.cost, v.cuts FROM (
    SELECT dp.k + 1 AS k, t.j, min({{'cost': dp.cost + t.l * (t.cc - z.cc) - (t.s - z.s), 'i': dp.j, 'cuts': list_append(dp.cuts, t.l)}}) AS v
    FROM dp JOIN z ON z.j = dp.j JOIN t ON t.j > dp.j WHERE dp.k < {packing.BUCKETS} GROUP BY dp.k, t.j)
),
best AS (SELECT cuts FROM dp WHERE j = (SELECT max(j) FROM t) AND k = least({packing.BUCKETS}, (SELECT max(j) FROM t))),
b AS (SELECT (i - 1)::INTEGER AS bucket, cuts[i]::BIGINT AS bucket_length, CASE WHEN i = 1 THEN 0 ELSE cuts[i - 1] END AS above
      FROM (SELECT cuts, unnest(range(1, len(cuts) + 1)) AS i FROM best)),
m AS (SELECT greatest(1, ceil(count(*) / {packing.CHUNK}.0))::BIGINT AS chunks FROM d),
p AS (SELECT doc_id, n_words, bucket, bucket_length, greatest(1, {packing.BUDGET} // bucket_length) AS each,
        row_number() OVER (PARTITION BY bucket ORDER BY doc_id % chunks, doc_id) - 1 AS place
      FROM d CROSS JOIN m JOIN b ON greatest(n_words, 1) > above AND greatest(n_words, 1) <= bucket_length)
SELECT doc_id, n_words, bucket, bucket_length, (place // each)::BIGINT AS batch_id, (place % each)::INTEGER AS batch_slot, bucket_length - n_words AS padding FROM p
""",
    "op3_minhash": f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_W}') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * k >= 75 * (nx.n + ny.n - k)),
sym AS (SELECT x AS a, y AS b FROM e UNION ALL SELECT y, x FROM e),
reach(a, b) AS (SELECT a, b FROM sym UNION SELECT r.a, e.b FROM reach r JOIN sym e ON r.b = e.a),
c AS (SELECT a, min(b) AS least_id FROM reach GROUP BY 1),
o AS (SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(least_id, w.doc_id)) AS component_id
      FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.a = w.doc_id)
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM o
""",
    "op5_int8_tiles": """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
g AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS least_id FROM reach GROUP BY 1),
n AS (SELECT a, count(*) AS n FROM l GROUP BY 1),
o AS (SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(v.vec_id, coalesce(least_id, v.vec_id)) AS component_id FROM v LEFT JOIN n ON n.a = v.vec_id LEFT JOIN c ON c.a = v.vec_id)
SELECT vec_id, n_links, component_id, vec_id = component_id AS kept FROM o
""",
    "op6_warc": f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {warc.MIN_REVISIT} AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {warc.MIN_REVISIT} AND page_id > first_id THEN first_id END AS refers_to
FROM f
""",
    "op8_recompression": f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_W}') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i : i + 49], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
f AS (SELECT s, min(doc_id) AS first_id FROM win GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS pos FROM win JOIN f USING (s) WHERE doc_id > first_id),
k AS (SELECT doc_id, list(x ORDER BY pos) AS kept FROM (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS pos FROM w) ANTI JOIN gone USING (doc_id, pos) GROUP BY 1)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(len(kept), 0))::BIGINT AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256
FROM w LEFT JOIN k ON k.doc_id = w.doc_id
""",
}
