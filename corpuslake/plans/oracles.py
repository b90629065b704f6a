"""DuckDB SQL for the queries of the catalogue, written apart from the operators."""

from __future__ import annotations

OBS = """
obs AS (
  SELECT year(o_orderdate)::VARCHAR || '-q' || quarter(o_orderdate)::VARCHAR AS snapshot_id, strftime(date_trunc('quarter', o_orderdate), '%Y-%m-%dT00:00:00Z') AS observed_at,
    c_mktsegment AS source_id, o_custkey AS page_id, 'https://example.com/' || o_custkey::VARCHAR AS url, 'origin-' || c_nationkey::VARCHAR AS origin,
    sha256(max(o_orderpriority || o_orderstatus)) AS content_sha256, 'scope-' || (year(o_orderdate) % 2)::VARCHAR AS scope, 'contract-1' AS contract
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""
SRC = (
    OBS
    + """,
src AS (
  SELECT snapshot_id, observed_at, source_id, scope, contract, count(*) AS page_count, CASE WHEN snapshot_id[7] = '4' THEN 'page_target_reached' ELSE 'frontier_exhausted' END AS stop_reason,
    (CASE WHEN snapshot_id[7] = '2' AND snapshot_id[1:4]::INT % 3 = 0 THEN 1 ELSE 0 END)::BIGINT AS failed_count, 0::BIGINT AS rejected_count,
    CASE WHEN source_id < 'C' THEN list_transform(range(min(page_id), max(page_id) + 1, 7), lambda x: 'https://example.com/' || x::VARCHAR) END AS allowed_urls
  FROM obs GROUP BY snapshot_id, observed_at, source_id, scope, contract)"""
)
EVI = (
    SRC
    + """,
evi AS (
  SELECT snapshot_id, source_id, '' AS page_id, 'coverage' AS kind, scope, true AS complete, CASE WHEN source_id < 'M' THEN page_count END AS expected_page_count, observed_at AS evidence_at FROM src WHERE snapshot_id[7] = '3'
  UNION ALL
  SELECT s.snapshot_id, s.source_id, p.page_id::VARCHAR, 'tombstone', s.scope, NULL, NULL, s.observed_at
  FROM src s JOIN (SELECT DISTINCT source_id, page_id FROM obs WHERE page_id % 97 = 0) p USING (source_id) WHERE s.snapshot_id[1:4] = '1996')"""
)
ALIAS = """
rep AS (SELECT snapshot_id, source_id, content_sha256, min(page_id) AS representative_page_id FROM obs GROUP BY ALL),
al AS (SELECT snapshot_id, source_id, page_id AS alias_page_id, representative_page_id, url AS alias_url, observed_at, origin FROM obs JOIN rep USING (snapshot_id, source_id, content_sha256) WHERE page_id > representative_page_id)"""
CHANGES = """
lagged AS (SELECT *, lag(snapshot_id) OVER w AS previous_snapshot_id, lag(content_sha256) OVER w AS previous_sha, lag(observed_at) OVER w AS previous_at
           FROM obs WINDOW w AS (PARTITION BY source_id, page_id, scope, contract ORDER BY observed_at, snapshot_id)),
chg AS (SELECT *, CASE WHEN previous_snapshot_id IS NULL THEN 'new' WHEN previous_sha = content_sha256 THEN 'unchanged' ELSE 'changed' END AS change_status FROM lagged)"""
PRESENCE = """
miss AS (
  SELECT c.snapshot_id, c.source_id, p.page_id, r.snapshot_id AS previous_snapshot_id, c.scope, c.contract, r.observed_at AS previous_observed_at, c.observed_at, c.stop_reason, c.failed_count, c.rejected_count, c.page_count,
    row_number() OVER (PARTITION BY c.snapshot_id, c.source_id, p.page_id ORDER BY r.observed_at DESC, r.snapshot_id DESC) AS rn
  FROM src c JOIN src r ON r.source_id = c.source_id AND (r.observed_at, r.snapshot_id) < (c.observed_at, c.snapshot_id) AND r.scope = c.scope AND r.contract = c.contract
  JOIN obs p ON p.snapshot_id = r.snapshot_id AND p.source_id = r.source_id
  WHERE NOT EXISTS (SELECT 1 FROM src i WHERE i.source_id = c.source_id AND (i.observed_at, i.snapshot_id) > (r.observed_at, r.snapshot_id) AND (i.observed_at, i.snapshot_id) < (c.observed_at, c.snapshot_id) AND (i.scope <> c.scope OR i.contract <> c.contract))
    AND NOT EXISTS (SELECT 1 FROM obs n WHERE n.snapshot_id = c.snapshot_id AND n.source_id = c.source_id AND n.page_id = p.page_id)),
pres AS (
  SELECT m.snapshot_id, m.source_id, m.page_id::VARCHAR AS page_id, previous_snapshot_id, m.scope, contract, previous_observed_at, observed_at,
    CASE WHEN t.evidence_at IS NOT NULL OR v.evidence_at IS NOT NULL THEN 'removed' ELSE 'unobserved' END AS presence_status,
    CASE WHEN t.evidence_at IS NOT NULL THEN 'explicit_tombstone' WHEN v.evidence_at IS NOT NULL THEN 'complete_scope_assertion' ELSE 'no_removal_evidence' END AS removal_basis,
    coalesce(t.evidence_at, v.evidence_at) AS removal_evidence_at
  FROM miss m LEFT JOIN evi t ON t.kind = 'tombstone' AND t.snapshot_id = m.snapshot_id AND t.source_id = m.source_id AND t.page_id = m.page_id::VARCHAR AND t.scope = m.scope
  LEFT JOIN evi v ON v.kind = 'coverage' AND v.complete AND v.page_id = '' AND v.snapshot_id = m.snapshot_id AND v.source_id = m.source_id AND v.scope = m.scope
    AND (v.expected_page_count IS NULL OR v.expected_page_count = m.page_count) AND m.stop_reason = 'frontier_exhausted' AND m.failed_count = 0 AND m.rejected_count = 0
  WHERE rn = 1)"""
SNAPCHG = """
chain AS (SELECT source_id, snapshot_id, lag(snapshot_id) OVER (PARTITION BY source_id ORDER BY min(observed_at), snapshot_id) AS previous_snapshot_id FROM obs GROUP BY 1, 2),
pairs AS (
  SELECT c.source_id, c.snapshot_id, n.content_sha256 AS new_sha, o.content_sha256 AS old_sha FROM chain c JOIN obs n ON n.source_id = c.source_id AND n.snapshot_id = c.snapshot_id
    LEFT JOIN obs o ON o.source_id = c.source_id AND o.snapshot_id = c.previous_snapshot_id AND o.page_id = n.page_id
  UNION ALL
  SELECT c.source_id, c.snapshot_id, NULL, o.content_sha256 FROM chain c JOIN obs o ON o.source_id = c.source_id AND o.snapshot_id = c.previous_snapshot_id
    WHERE NOT EXISTS (SELECT 1 FROM obs n WHERE n.source_id = c.source_id AND n.snapshot_id = c.snapshot_id AND n.page_id = o.page_id)),
sc AS (
  SELECT source_id, snapshot_id, any_value(previous_snapshot_id) AS previous_snapshot_id, count(new_sha) AS page_count, count(*) FILTER (old_sha IS NULL) AS added, count(*) FILTER (new_sha IS NULL) AS removed,
    count(*) FILTER (new_sha <> old_sha) AS changed, count(*) FILTER (new_sha = old_sha) AS unchanged
  FROM pairs JOIN chain USING (source_id, snapshot_id) GROUP BY 1, 2),
scr AS (SELECT *, CASE WHEN previous_snapshot_id IS NOT NULL AND changed + unchanged > 0 THEN changed / (changed + unchanged) END AS change_rate,
  CASE WHEN previous_snapshot_id IS NOT NULL AND added + removed + changed + unchanged > 0 THEN (added + removed + changed) / (added + removed + changed + unchanged) END AS churn_rate FROM sc)"""
FRESH = """
cap AS (SELECT (['AUTOMOBILE','BUILDING','FURNITURE','HOUSEHOLD','MACHINERY'])[user_id % 5 + 1] AS source_id, max(strftime(ts, '%Y-%m-%dT%H:%M:%SZ')) AS captured_at FROM events GROUP BY 1),
seen AS (SELECT origin, snapshot_id, min(observed_at) AS observed_at FROM obs GROUP BY 1, 2),
fr AS (
  SELECT s.origin, arg_max(s.snapshot_id, s.observed_at || s.snapshot_id) AS newest_snapshot_id, max(s.observed_at) AS newest_snapshot_at, count(*) AS snapshot_count, any_value(l.last_capture_at) AS last_capture_at
  FROM seen s LEFT JOIN (SELECT origin, max(captured_at) AS last_capture_at FROM (SELECT DISTINCT origin, source_id FROM obs) JOIN cap USING (source_id) GROUP BY 1) l ON l.origin = s.origin GROUP BY 1)"""
RATES = (
    ALIAS
    + """,
kept AS (SELECT o.* FROM obs o WHERE NOT EXISTS (SELECT 1 FROM al a WHERE a.snapshot_id = o.snapshot_id AND a.source_id = o.source_id AND a.alias_page_id = o.page_id)),
rt AS (
  SELECT p.snapshot_id, p.origin, p.page_count, coalesce(a.n, 0)::BIGINT AS alias_count, coalesce(a.n, 0) / (p.page_count + coalesce(a.n, 0)) AS exact_duplicate_rate, n.n AS near_duplicate_page_count, n.n / p.page_count AS near_duplicate_rate
  FROM (SELECT snapshot_id, origin, count(*) AS page_count FROM kept GROUP BY 1, 2) p LEFT JOIN (SELECT snapshot_id, origin, count(*) AS n FROM al GROUP BY 1, 2) a USING (snapshot_id, origin)
  LEFT JOIN (SELECT snapshot_id, origin, count(*) AS n FROM obs WHERE page_id % 11 = 0 GROUP BY 1, 2) n USING (snapshot_id, origin))"""
)
LOG = """
ops AS (
  SELECT strftime(ts, '%Y-%m-%d') AS snapshot_id, 'run-1' AS run_id, 's' || (user_id % 10)::VARCHAR AS source_id,
    CASE event_type WHEN 'error' THEN 'fetch.failed' WHEN 'click' THEN 'task.claimed' WHEN 'purchase' THEN 'capture.accepted' WHEN 'signup' THEN 'page.rejected' ELSE 'page.viewed' END AS event_name,
    CASE event_type WHEN 'error' THEN 'failure' ELSE 'success' END AS outcome, 'worker' AS component, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS event_at, user_id AS task_id, event_id % 3 + 1 AS attempt FROM events),
sm AS (
  SELECT snapshot_id, run_id, source_id, event_name, outcome, component, count(*) AS event_count, count(DISTINCT task_id) AS distinct_task_count, count(*) FILTER (attempt > 1) AS retry_claim_event_count,
    count(DISTINCT CASE WHEN attempt > 1 THEN task_id END) AS retried_task_count, min(event_at) AS first_event_at, max(event_at) AS last_event_at, count(*) FILTER (outcome IN ('failure', 'error')) AS failure_outcome_count
  FROM ops GROUP BY ALL)"""
RUNS = """
rn AS (
  SELECT 'b-' || strftime(ts, '%Y-%m-%d') AS batch_id, strftime(ts, '%Y-%m-%d') AS snapshot_id, 'run-1' AS run_id, strftime(min(ts), '%Y-%m-%dT%H:%M:%SZ') AS started_at, strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') AS completed_at,
    'frontier_exhausted' AS stop_reason, count(*) FILTER (event_type = 'purchase') AS captured_page_count, count(*) FILTER (event_type = 'purchase') AS page_count, count(*) FILTER (event_type = 'error') AS failed_count,
    floor(epoch(max(ts)))::BIGINT - floor(epoch(min(ts)))::BIGINT AS crawl_duration_seconds FROM events GROUP BY 1, 2)"""
DURABLE = """
bt AS (SELECT DISTINCT 'b' || (event_id // 1000)::VARCHAR AS batch_id, 'run-' || (user_id % 20)::VARCHAR AS crawl_run_id, CASE WHEN event_id // 1000 % 7 = 6 THEN 'processing' ELSE 'complete' END AS status FROM events),
ev AS (
  SELECT 'run-' || (user_id % 20)::VARCHAR AS crawl_run_id, event_id, CASE event_type WHEN 'signup' THEN 'crawl_completed' WHEN 'purchase' THEN 'corpus_snapshot_published' ELSE 'capture_committed' END AS kind, 's' || (user_id % 10)::VARCHAR AS source_id,
    strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS event_at, floor(epoch(ts))::BIGINT AS sec, event_id % 90 AS lag_s, 'r' || (event_id % 3)::VARCHAR AS stop_reason, 'snap-' || (event_id % 17)::VARCHAR AS snap
  FROM events WHERE event_type <> 'error' AND event_id // 1000 % 7 <> 6)"""
CAPS = """
cp AS (
  SELECT l_orderkey * 10 + l_linenumber AS row_id, 's' || (l_suppkey % 3)::VARCHAR AS source_id, 'https://example.com/p/' || l_partkey::VARCHAR AS final_url,
    'https://example.com/p/' || l_partkey::VARCHAR || CASE WHEN l_linenumber = 1 THEN '?r' ELSE '' END AS requested_url, sha256(l_quantity::INT::VARCHAR || '/' || (l_partkey % 20)::VARCHAR) AS content_sha256 FROM lineitem),
ck AS (SELECT *, sha256(content_sha256 || '|' || requested_url || '|' || row_id::VARCHAR) AS k FROM cp),
w1 AS (SELECT *, row_number() OVER (PARTITION BY source_id, final_url ORDER BY k, row_id) AS r1, first(content_sha256) OVER (PARTITION BY source_id, final_url ORDER BY k, row_id) AS win_sha FROM ck),
w2 AS (SELECT *, row_number() OVER (PARTITION BY source_id, content_sha256 ORDER BY final_url, k, row_id) AS r2, first(final_url) OVER (PARTITION BY source_id, content_sha256 ORDER BY final_url, k, row_id) AS rep_url FROM w1 WHERE r1 = 1)"""
TASKS = """
tk AS (
  SELECT o_orderkey AS task_id, 's' || (o_custkey % 8)::VARCHAR AS source_id, 'k' || (o_custkey % 30)::VARCHAR AS schedule_key,
    CASE WHEN o_orderstatus = 'F' THEN 'succeeded' WHEN o_orderkey % 11 = 0 THEN 'failed' WHEN o_orderstatus = 'P' THEN 'leased' ELSE 'pending' END AS status, o_orderkey % 1000 AS lease_expires_at, o_custkey % 100 AS retry_at, o_orderkey % 5 AS attempts FROM orders)"""
TWO = """
dx AS (SELECT doc_id % 16 AS query_id, doc_id AS passage_id, n_chars FROM documents),
ra AS (SELECT query_id, passage_id, row_number() OVER (PARTITION BY query_id ORDER BY n_chars DESC, passage_id) AS r FROM dx),
rb AS (SELECT query_id, passage_id, row_number() OVER (PARTITION BY query_id ORDER BY passage_id % 37, passage_id) AS r FROM dx),
fu AS (SELECT query_id, passage_id, sum(1.0::DOUBLE / (60 + r)) AS score FROM (FROM ra UNION ALL FROM rb) WHERE r <= 50 GROUP BY 1, 2),
rf AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, passage_id) AS rank FROM fu QUALIFY rank <= 50)"""
EVAL = """
ed AS (SELECT (doc_id % 12)::VARCHAR AS query_id, doc_id AS page_id, n_chars, (quality * 2 + toxic)::INT AS grade FROM documents JOIN labels USING (doc_id)),
rk AS (SELECT 'length' AS mode, query_id, page_id, grade, row_number() OVER (PARTITION BY query_id ORDER BY n_chars DESC, page_id) AS r FROM ed UNION ALL SELECT 'modulo', query_id, page_id, grade, row_number() OVER (PARTITION BY query_id ORDER BY page_id % 31, page_id) FROM ed),
idl AS (SELECT query_id, sum(CASE WHEN p <= 10 THEN (pow(2, grade) - 1) / log2(p + 1) ELSE 0 END) AS idcg, count(*) FILTER (grade >= 2) AS rel FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, page_id) AS p FROM ed) GROUP BY 1),
mt AS (
  SELECT mode, query_id, coalesce(sum(CASE WHEN r <= 10 THEN (pow(2, grade) - 1) / log2(r + 1) ELSE 0 END) / nullif(any_value(idcg), 0), 0) AS ndcg10, coalesce(1.0 / min(CASE WHEN grade >= 2 AND r <= 10 THEN r END), 0)::DOUBLE AS mrr10,
    count(*) FILTER (grade >= 2 AND r <= 10) / any_value(rel) AS recall10, count(*) FILTER (grade >= 2 AND r <= 100) / any_value(rel) AS recall100
  FROM rk JOIN idl USING (query_id) WHERE rel > 0 GROUP BY 1, 2)"""
U64 = "18446744073709551616::UHUGEINT"
TOK = r"[\p{L}\p{N}]+"
SIM = rf"""
sw AS (SELECT doc_id, lang, source, regexp_extract_all(lower(text), '{TOK}') AS w FROM documents),
sg AS (SELECT doc_id, encode(array_to_string(w[i : i + 2], ' ')) AS b FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM sw WHERE len(w) >= 3)),
su AS (SELECT DISTINCT b FROM sg),
fnv AS (SELECT b, list_reduce(list_transform(range(1, octet_length(b) + 1), lambda i: ('0x' || hex(b)[2 * i - 1 : 2 * i])::UTINYINT::UHUGEINT), lambda h, x: xor(h, x) * 1099511628211::UHUGEINT % {U64}, 14695981039346656037::UHUGEINT) AS h FROM su),
m1 AS (SELECT b, xor(h, h >> 30) * 13787848793156543929::UHUGEINT % {U64} AS h FROM fnv),
m2 AS (SELECT b, xor(h, h >> 27) * 10723151780598845931::UHUGEINT % {U64} AS h FROM m1),
m3 AS (SELECT b, xor(h, h >> 31)::UBIGINT AS h FROM m2),
vt AS (SELECT doc_id, bit, sum(CASE WHEN (h >> bit) & 1 = 1 THEN 1 ELSE -1 END) AS v FROM sg JOIN m3 USING (b) CROSS JOIN (SELECT unnest(range(64))::UBIGINT AS bit) GROUP BY 1, 2),
fp AS (SELECT doc_id, bit_or(CASE WHEN v > 0 THEN 1::UHUGEINT << bit::UHUGEINT ELSE 0::UHUGEINT END) AS u FROM vt GROUP BY 1),
sf AS (SELECT sw.doc_id, lang, CASE WHEN u >= 9223372036854775808::UHUGEINT THEN (u::HUGEINT - 18446744073709551616::HUGEINT)::BIGINT ELSE u::BIGINT END AS fingerprint,
        row_number() OVER (PARTITION BY lang ORDER BY sw.doc_id)::INT AS ordinal FROM sw LEFT JOIN fp ON fp.doc_id = sw.doc_id),
nd AS (
  SELECT a.lang, a.doc_id, a.ordinal, min(b.ordinal) AS near_ordinal, arg_min(bit_count(xor(a.fingerprint, b.fingerprint)), b.ordinal)::INT AS distance
  FROM sf a JOIN sf b ON a.lang = b.lang AND b.ordinal < a.ordinal AND bit_count(xor(a.fingerprint, b.fingerprint)) <= 6 GROUP BY 1, 2, 3)"""


def bm25(parity: int) -> str:
    """BM25 over title and body: single terms as words, odd queries as a phrase of three."""
    chosen = "array_to_string(w[2:3], ' ')" if not parity else "array_to_string(w[4:6], ' ')"
    return rf"""
WITH bw AS (SELECT item_id, str_split(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'), ' ') AS w FROM benchmark),
qr AS (SELECT item_id * 2 + {parity} AS query_id, {chosen} AS q FROM bw),
lt AS (SELECT query_id, q, {"str_split(q, ' ')" if not parity else "[q]"} AS lits FROM qr WHERE trim(q) <> ''),
li AS (SELECT query_id, unnest(range(1, len(lits) + 1)) AS literal, lits FROM lt),
lq AS (SELECT query_id, literal, list_filter(str_split(lits[literal], ' '), lambda x: x <> '') AS terms FROM li),
fl AS (
  SELECT doc_id AS passage_id, field, list_filter(regexp_extract_all(lower(t), '{TOK}'), lambda x: octet_length(encode(x)) < 40) AS toks
  FROM (SELECT doc_id, 'title' AS field, text[1:60] AS t FROM documents UNION ALL SELECT doc_id, 'body', text FROM documents)),
st AS (SELECT field, count(*) AS n, avg(len(toks)) AS al FROM fl GROUP BY 1),
tm AS (SELECT DISTINCT unnest(terms) AS term FROM lq),
occ AS (SELECT field, passage_id, len(toks) AS length, unnest(toks) AS term, unnest(range(1, len(toks) + 1)) AS pos FROM fl),
oc AS (SELECT * FROM occ WHERE term IN (SELECT term FROM tm)),
df AS (SELECT field, term, count(DISTINCT passage_id) AS df FROM oc GROUP BY 1, 2),
idf AS (SELECT field, term, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM df JOIN st USING (field)),
lo AS (SELECT query_id, literal, unnest(terms) AS term, unnest(range(1, len(terms) + 1)) AS off, len(terms) AS nt FROM lq),
wt AS (SELECT query_id, literal, field, sum(idf) AS idf FROM lo JOIN idf USING (term) GROUP BY 1, 2, 3),
ru AS (SELECT query_id, literal, nt, field, passage_id, length, pos - off AS s, count(DISTINCT off) AS met FROM lo JOIN oc USING (term) GROUP BY ALL),
tf AS (SELECT query_id, literal, field, passage_id, length, count(*) AS tf FROM ru WHERE met = nt GROUP BY ALL),
sc AS (
  SELECT query_id, passage_id, sum(CASE field WHEN 'title' THEN 2.0 ELSE 1.0 END * wt.idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / al))) AS score
  FROM tf JOIN wt USING (query_id, literal, field) JOIN st USING (field) GROUP BY 1, 2)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, passage_id)::INT AS rank, passage_id, round(score, 6) AS score FROM sc QUALIFY rank <= 10"""


ORACLES: dict[str, str] = {
    "snapshot_changes": f"WITH {OBS}, {SNAPCHG} SELECT source_id, snapshot_id, previous_snapshot_id, page_count, added, removed, changed, unchanged, round(change_rate, 6) AS change_rate, round(churn_rate, 6) AS churn_rate FROM scr",
    "change_rate": f"WITH {OBS}, {SNAPCHG} SELECT source_id, snapshot_id, added, removed, changed, unchanged, round(change_rate, 3) AS change_rate, round(churn_rate, 3) AS churn_rate FROM scr WHERE previous_snapshot_id IS NOT NULL",
    "origin_freshness": f"WITH {OBS}, {FRESH} SELECT * FROM fr",
    "freshness_by_origin": f"WITH {OBS}, {FRESH} SELECT origin, newest_snapshot_id, round(date_diff('second', newest_snapshot_at[1:19]::TIMESTAMP, TIMESTAMP '2001-01-01') / 3600.0::DOUBLE, 6) AS age_hours FROM fr",
    "duplicate_rates": f"WITH {OBS}, {RATES} SELECT snapshot_id, origin, page_count, alias_count, round(exact_duplicate_rate, 6) AS exact_duplicate_rate, near_duplicate_page_count, round(near_duplicate_rate, 6) AS near_duplicate_rate FROM rt",
    "duplicate_rate_newest": f"WITH {OBS}, {RATES}, {FRESH} SELECT origin, snapshot_id, round(exact_duplicate_rate, 3) AS exact_duplicate_rate, round(near_duplicate_rate, 3) AS near_duplicate_rate FROM rt JOIN fr USING (origin) WHERE snapshot_id = newest_snapshot_id",
    "scope_comparisons": f"""WITH {SRC}, l AS (SELECT *, lag(snapshot_id) OVER w AS previous_snapshot_id, lag(scope) OVER w AS previous_scope, lag(contract) OVER w AS pc FROM src WINDOW w AS (PARTITION BY source_id ORDER BY observed_at, snapshot_id))
SELECT snapshot_id, source_id, scope, previous_snapshot_id, previous_scope, CASE WHEN previous_snapshot_id IS NULL THEN 'first_observation' WHEN scope = previous_scope AND contract = pc THEN 'compatible' ELSE 'incompatible_scope_or_extraction_contract' END AS comparison_status FROM l""",
    "page_change_observations": f"WITH {OBS}, {CHANGES} SELECT snapshot_id, source_id, page_id, scope, previous_snapshot_id, change_status, CASE WHEN change_status = 'changed' THEN previous_at END AS change_interval_start, CASE WHEN change_status = 'changed' THEN observed_at END AS change_interval_end FROM chg",
    "change_frequency_monthly": f"""WITH {OBS}, {CHANGES} SELECT source_id, scope, contract, observed_at[1:8] || '01' AS observation_month, min(observed_at) AS first_observed_at, max(observed_at) AS last_observed_at, count(*) AS page_observations,
count(*) FILTER (change_status = 'new') AS new_page_observations, count(*) FILTER (change_status = 'changed') AS changed_page_observations, count(*) FILTER (change_status = 'unchanged') AS unchanged_page_observations, count(previous_snapshot_id) AS comparable_page_observations,
round(100.0 * count(*) FILTER (change_status = 'changed') / nullif(count(previous_snapshot_id), 0), 6)::DOUBLE AS changed_percent FROM chg GROUP BY ALL""",
    "page_presence": f"WITH {EVI}, {PRESENCE} SELECT * FROM pres",
    "alias_observations": f"WITH {OBS}, {ALIAS} SELECT snapshot_id, source_id, alias_page_id, representative_page_id, alias_url, observed_at FROM al",
    "exact_alias_groups": f"""WITH {OBS}, {ALIAS} SELECT snapshot_id, source_id, representative_page_id, count(DISTINCT alias_page_id) AS alias_count,
'[' || string_agg('{{"alias_page_id":' || alias_page_id::VARCHAR || ',"alias_url":"' || alias_url || '"}}', ',' ORDER BY alias_page_id) || ']' AS alias_members, min(observed_at) AS first_observed_at, max(observed_at) AS last_observed_at FROM al GROUP BY 1, 2, 3""",
    "history_counts": f"""WITH {SRC}, {ALIAS} SELECT s.snapshot_id, s.observed_at, source_count, coalesce(page_count, 0) AS page_count, coalesce(alias_count, 0) AS alias_count FROM (SELECT snapshot_id, min(observed_at) AS observed_at, count(DISTINCT source_id) AS source_count FROM src GROUP BY 1) s
LEFT JOIN (SELECT snapshot_id, count(DISTINCT page_id) AS page_count FROM obs GROUP BY 1) p USING (snapshot_id) LEFT JOIN (SELECT snapshot_id, count(DISTINCT alias_page_id) AS alias_count FROM al GROUP BY 1) a USING (snapshot_id)""",
    "snapshot_count_report": f"""WITH {SRC}, {ALIAS} SELECT 'b-' || snapshot_id AS batch_id, snapshot_id, sum(page_count)::BIGINT AS expected_page_count, 0::BIGINT AS expected_alias_count, 0::BIGINT AS expected_passage_count,
(SELECT count(*) FROM obs o WHERE o.snapshot_id = src.snapshot_id) AS actual_page_count, (SELECT count(*) FROM al a WHERE a.snapshot_id = src.snapshot_id) AS actual_alias_count, 0::BIGINT AS actual_passage_count FROM src GROUP BY snapshot_id HAVING max(failed_count) = 0""",
    "coverage_report": f"""WITH {EVI}, a AS (SELECT snapshot_id, source_id, scope, bool_or(kind = 'coverage' AND complete) AS att, max(CASE WHEN kind = 'coverage' AND complete THEN expected_page_count END) AS exp, max(CASE WHEN kind = 'coverage' AND complete THEN evidence_at END) AS at_ FROM evi GROUP BY 1, 2, 3),
g AS (SELECT s.snapshot_id, s.source_id, count(DISTINCT o.url) AS n FROM src s JOIN obs o ON o.snapshot_id = s.snapshot_id AND o.source_id = s.source_id WHERE s.allowed_urls IS NOT NULL AND list_contains(s.allowed_urls, o.url) GROUP BY 1, 2),
b AS (SELECT s.*, coalesce(att, false) AS att, exp, at_, coalesce(g.n, 0) AS got FROM src s LEFT JOIN a USING (snapshot_id, source_id, scope) LEFT JOIN g USING (snapshot_id, source_id)),
c AS (SELECT *, CASE WHEN att THEN exp WHEN allowed_urls IS NOT NULL THEN len(allowed_urls) END AS den, CASE WHEN att AND exp IS NOT NULL THEN page_count WHEN att THEN NULL WHEN allowed_urls IS NOT NULL THEN got END AS num FROM b)
SELECT snapshot_id, source_id, scope, page_count, den::BIGINT AS coverage_denominator, num::BIGINT AS coverage_numerator,
CASE WHEN att AND exp IS NOT NULL THEN 'measured_complete_scope_assertion' WHEN att THEN 'attested_complete_no_denominator' WHEN allowed_urls IS NOT NULL THEN 'measured_exact_allowed_urls' ELSE 'unknown_open_scope' END AS coverage_basis,
CASE WHEN att AND exp IS NULL THEN 'attested_complete' WHEN att OR allowed_urls IS NOT NULL THEN 'measured' ELSE 'unknown' END AS coverage_status, CASE WHEN den > 0 THEN round(100.0::DOUBLE * num / den, 6) END AS coverage_percent, CASE WHEN att THEN at_ END AS attested_at,
CASE WHEN att AND exp IS NULL THEN 'attested without a denominator' WHEN att AND exp = 0 THEN 'attested denominator is zero' WHEN att THEN 'attested denominator' WHEN len(allowed_urls) = 0 THEN 'allowlist is empty' WHEN allowed_urls IS NOT NULL THEN 'exact allowlist matches' ELSE 'no finite inventory' END AS coverage_reason FROM c""",
    "page_freshness": f"""WITH {EVI}, {PRESENCE}, lp AS (SELECT *, row_number() OVER (PARTITION BY source_id, page_id ORDER BY observed_at DESC, snapshot_id DESC) AS r FROM obs), ls AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY observed_at DESC, snapshot_id DESC) AS r FROM src)
SELECT p.source_id, p.page_id::VARCHAR AS page_id, p.snapshot_id, s.snapshot_id AS latest_snapshot_id, p.content_sha256,
CASE WHEN p.scope = s.scope AND p.contract = s.contract THEN coalesce(x.presence_status, CASE WHEN p.snapshot_id = s.snapshot_id THEN 'observed_in_latest_source_snapshot' ELSE 'no_compatible_presence_comparison' END) ELSE 'scope_or_extraction_contract_changed' END AS current_presence_status,
date_diff('day', p.observed_at[1:10]::DATE, DATE '2001-01-01') AS observation_age_days
FROM lp p JOIN ls s ON s.source_id = p.source_id AND s.r = 1 LEFT JOIN pres x ON x.snapshot_id = s.snapshot_id AND x.source_id = p.source_id AND x.page_id = p.page_id::VARCHAR WHERE p.r = 1""",
    "content_quality": """WITH p AS (SELECT lang AS snapshot_id, source AS source_id, doc_id AS page_id, CASE WHEN doc_id % 9 <> 0 THEN text[1:20] END AS title, text FROM documents), n AS (SELECT doc_id AS page_id, len(list_distinct(str_split(text, chr(10)))) AS n FROM documents WHERE doc_id % 13 <> 0),
q AS (SELECT snapshot_id, source_id, p.page_id, length(text) AS content_chars, octet_length(encode(text)) AS content_bytes, coalesce(n.n, 0)::BIGINT AS passage_count, trim(coalesce(title, '')) = '' AS missing_title FROM p LEFT JOIN n USING (page_id))
SELECT *, content_chars < 200 AS short_content, passage_count = 0 AS no_passages, content_chars < 200 OR missing_title OR passage_count = 0 AS needs_review FROM q""",
    "manifest_page_requests": f"WITH {OBS} SELECT DISTINCT snapshot_id, source_id, page_id::VARCHAR AS page_id, url AS requested_url FROM obs",
    "event_operational_summary": f"WITH {LOG} SELECT * FROM sm",
    "event_error_rate": f"""WITH {LOG} SELECT snapshot_id, source_id, sum(event_count)::BIGINT AS observed_event_count, sum(failure_outcome_count)::BIGINT AS failed_outcome_event_count, coalesce(sum(event_count) FILTER (event_name = 'fetch.failed'), 0)::BIGINT AS fetch_failed_event_count,
0::BIGINT AS worker_task_failed_event_count, coalesce(sum(event_count) FILTER (event_name = 'page.rejected'), 0)::BIGINT AS page_rejected_event_count, round(100.0::DOUBLE * sum(failure_outcome_count) / sum(event_count), 6) AS failed_outcome_percent FROM sm GROUP BY 1, 2""",
    "crawl_run_report": f"WITH {RUNS} SELECT * FROM rn",
    "event_effectiveness": f"""WITH {LOG}, {RUNS}, e AS (SELECT snapshot_id, sum(event_count) FILTER (event_name = 'task.claimed') AS c, sum(event_count) FILTER (event_name = 'capture.accepted') AS a, sum(event_count) FILTER (event_name = 'page.rejected') AS j, sum(retry_claim_event_count) AS t FROM sm GROUP BY 1)
SELECT snapshot_id, captured_page_count, c::BIGINT AS task_claim_attempts, a::BIGINT AS capture_accept_event_count, NULL::BIGINT AS worker_task_failure_event_count, j::BIGINT AS page_rejected_event_count, CASE WHEN c > 0 THEN t::BIGINT END AS retry_claim_event_count,
round(captured_page_count::DOUBLE / c, 6) AS captured_pages_per_task_claim, round(failed_count::DOUBLE / c, 6) AS fetch_failures_per_task_claim, round(60.0::DOUBLE * page_count / crawl_duration_seconds, 6) AS pages_per_minute, 'task claim count' AS attempt_denominator_status FROM rn LEFT JOIN e USING (snapshot_id)""",
    "ingestion_metrics": f"WITH {RUNS} SELECT 'b-' || strftime(ts, '%Y-%m-%d') AS batch_id, event_id AS attempt_id, user_id, run_id, stop_reason FROM events e LEFT JOIN rn ON rn.batch_id = 'b-' || strftime(ts, '%Y-%m-%d')",
    "event_run_status": f"""WITH {DURABLE}, g AS (SELECT crawl_run_id, count(DISTINCT event_id) FILTER (kind = 'capture_committed') AS cc, count(DISTINCT source_id) FILTER (kind = 'capture_committed') AS scn, min(event_at) AS f, max(event_at) AS l, max(lag_s) AS m, max(sec) AS ls, max(stop_reason) FILTER (kind = 'crawl_completed') AS sr, max(snap) FILTER (kind = 'corpus_snapshot_published') AS ps FROM ev GROUP BY 1),
q AS (SELECT 'run-' || (user_id % 20)::VARCHAR AS crawl_run_id, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1)
SELECT b.crawl_run_id, coalesce(cc, 0) AS capture_count, coalesce(scn, 0) AS source_count, f AS first_event_at, l AS last_event_at, m AS max_ingestion_lag_seconds, sr AS stop_reason, ps AS published_snapshot_id, coalesce(q.n, 0) AS quarantined_record_count,
epoch(TIMESTAMP '2024-12-31')::BIGINT - ls AS last_event_age_seconds, CASE WHEN ps IS NULL THEN 'provisional' ELSE 'snapshot_publication_event_seen' END AS evidence_status FROM (SELECT DISTINCT crawl_run_id FROM bt) b LEFT JOIN g USING (crawl_run_id) LEFT JOIN q USING (crawl_run_id)""",
    "source_capture_summary": f"WITH {DURABLE} SELECT crawl_run_id, source_id, count(DISTINCT event_id) AS capture_count, min(event_at) AS first_capture_at, max(event_at) AS last_capture_at, epoch(TIMESTAMP '2024-12-31')::BIGINT - max(sec) AS last_capture_age_seconds FROM ev WHERE kind = 'capture_committed' GROUP BY 1, 2",
    "event_ingestion_status": f"""WITH {DURABLE}, a AS (SELECT 'b' || (event_id // 1000)::VARCHAR AS batch_id, event_id AS attempt_id, user_id AS execution_millis, row_number() OVER (PARTITION BY event_id // 1000 ORDER BY strftime(ts, '%Y-%m-%d') DESC, event_id DESC) AS r FROM events)
SELECT b.batch_id, b.status, attempt_id, execution_millis, CASE WHEN b.status = 'complete' THEN 0 ELSE 1 END AS pending FROM (SELECT batch_id, max(status) AS status FROM bt GROUP BY 1) b LEFT JOIN a ON a.batch_id = b.batch_id AND a.r = 1""",
    "event_identity_split": """WITH l AS (SELECT event_id, user_id, event_id * 10 + k AS line, p FROM events CROSS JOIN (VALUES (0, 'a'), (1, 'a'), (2, 'b')) v(k, p) WHERE k = 0 OR (k = 1 AND event_id % 7 = 0) OR (k = 2 AND event_id % 51 = 0))
SELECT line, 'run-' || (user_id % 5)::VARCHAR AS crawl_run_id, 'e' || event_id::VARCHAR AS event_id, CASE WHEN event_id % 101 = 0 THEN 'quarantined' WHEN p = 'b' THEN 'identity_conflict' WHEN line % 10 = 1 THEN 'duplicate' ELSE 'accepted' END AS disposition FROM l""",
    "rates_trailing": "SELECT w::INT AS window_seconds, count(e.event_id) AS event_count, round(count(e.event_id) / w, 6) AS per_second FROM (VALUES (60), (300)) v(w) LEFT JOIN events e ON e.event_id % 1000 < w GROUP BY w",
    "counter_rates": """WITH s AS (SELECT user_id % 50 AS series, event_id AS n, event_id * 30 AS t, (event_id % 977)::DOUBLE AS v FROM events), d AS (SELECT *, lag(v) OVER (PARTITION BY series ORDER BY t) AS p FROM s), e AS (SELECT *, CASE WHEN p IS NULL THEN 0 WHEN v >= p THEN v - p ELSE v END AS st FROM d)
SELECT series, n, round(sum(st) OVER w, 6) AS increase, round(sum(st) OVER w / 600, 6) AS rate, max(v) OVER w AS max_over_time FROM e WINDOW w AS (PARTITION BY series ORDER BY t RANGE BETWEEN 600 PRECEDING AND CURRENT ROW)""",
    "alert_hold": """WITH s AS (SELECT user_id % 20 AS series, event_id AS n, event_type <> 'error' AS up FROM events), l AS (SELECT *, max(CASE WHEN NOT up THEN n END) OVER (PARTITION BY series ORDER BY n) AS down FROM s)
SELECT series, n, up AND (n - (SELECT min(x.n) FROM s x WHERE x.series = l.series AND x.n > coalesce(l.down, -1) AND x.up)) * 30 >= 1800 AS firing FROM l""",
    "live_dashboard": f"WITH {TASKS}, c AS (SELECT count(*) FILTER (status = 'pending') AS pending_count, count(*) FILTER (status = 'leased') AS leased_count, count(*) FILTER (status = 'succeeded') AS succeeded_count, count(*) FILTER (status = 'failed') AS failed_count FROM tk) SELECT task_id, status, c.* FROM (SELECT * FROM tk ORDER BY task_id LIMIT 6 OFFSET 12) CROSS JOIN c",
    "replay_equality": """WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem), b AS (SELECT * FROM a WHERE l_orderkey % 100 <> 0 UNION ALL SELECT * FROM a WHERE l_orderkey % 250 = 1),
j AS (SELECT l_orderkey, l_linenumber, l_partkey, sum(x) AS x, sum(y) AS y FROM (SELECT *, 1 AS x, 0 AS y FROM a UNION ALL SELECT *, 0, 1 FROM b) GROUP BY 1, 2, 3 HAVING sum(x) <> sum(y)) SELECT count(*) AS differing_rows, sum(x)::BIGINT AS left_rows, sum(y)::BIGINT AS right_rows FROM j""",
    "fingerprint_coverage": """WITH h AS (SELECT user_id % 25 AS g, sha256(event_id::VARCHAR || chr(31) || user_id::VARCHAR || chr(31) || event_type) AS s FROM events), p AS (SELECT g, [('0x' || s[16 * i + 1 : 16 * i + 16])::UBIGINT FOR i IN range(4)] AS u FROM h),
x AS (SELECT g, count(*) AS row_count, bit_xor(u[1]) AS a, bit_xor(u[2]) AS b, bit_xor(u[3]) AS c, bit_xor(u[4]) AS d FROM p GROUP BY 1)
SELECT g, row_count, """
    + ", ".join(f"(CASE WHEN {c} >= 9223372036854775808::UBIGINT THEN {c}::HUGEINT - 18446744073709551616::HUGEINT ELSE {c}::HUGEINT END)::BIGINT AS fingerprint_{i}" for i, c in enumerate("abcd"))
    + " FROM x",
    "url_winner_select": f"WITH {CAPS} SELECT source_id, final_url, row_id FROM w1 WHERE r1 = 1",
    "capture_status": """
WITH c AS (SELECT l_orderkey * 10 + l_linenumber AS row_id, l_suppkey % 3 AS s, l_partkey AS u, l_quantity::INT::VARCHAR || '/' || (l_partkey % 20)::VARCHAR AS t, CASE WHEN l_linenumber = 1 THEN '?r' ELSE '' END AS r FROM lineitem),
k AS (SELECT row_id, s, u, t, sha256(sha256(t) || '|https://example.com/p/' || u::VARCHAR || r || '|' || row_id::VARCHAR) AS selection FROM c),
n AS (SELECT *, row_number() OVER (PARTITION BY s, u, selection) AS copy FROM k),
w AS (SELECT s, u, min(selection) AS least_selection, arg_min(t, selection) AS won FROM k GROUP BY 1, 2),
p AS (SELECT s, won, min(u::VARCHAR) AS rep FROM w GROUP BY 1, 2),
j AS (SELECT row_id, n.u::VARCHAR AS u, t, w.won, rep, selection = least_selection AND copy = 1 AS winner FROM n JOIN w ON w.s = n.s AND w.u = n.u JOIN p ON p.s = w.s AND p.won = w.won)
SELECT row_id, CASE WHEN NOT winner THEN 'superseded-capture' WHEN u = rep THEN 'admitted' ELSE 'exact-alias' END AS admission_status,
  CASE WHEN NOT winner AND t = won THEN 'superseded-duplicate-capture' WHEN NOT winner THEN 'superseded-conflicting-content' WHEN u = rep THEN 'deterministic-minimum-selection' ELSE 'exact-content-alias' END AS selection_reason
FROM j""",
    "capture_aliases": f"""WITH {CAPS} SELECT source_id, final_url AS alias_url, sha256('page' || chr(0) || final_url) AS alias_page_id, sha256('page' || chr(0) || rep_url) AS representative_page_id, CASE WHEN requested_url <> final_url THEN 'redirect-alias' ELSE 'exact-alias' END AS alias_kind, requested_url FROM w2 WHERE final_url <> rep_url""",
    "simhash_fingerprint": f"WITH {SIM} SELECT doc_id, fingerprint FROM sf",
    "near_duplicates": f"WITH {SIM} SELECT * FROM nd",
    "near_duplicate_report": f"""WITH {SIM} SELECT lang, count(*) AS page_count, (SELECT count(*) FROM nd WHERE nd.lang = d.lang) AS near_duplicate_page_count, count(*) FILTER (doc_id % 10 = 0) AS exact_duplicate_alias_count, round((SELECT count(*) FROM nd WHERE nd.lang = d.lang) / count(*), 6) AS near_duplicate_rate FROM documents d GROUP BY lang""",
    "shingle_jaccard": r"""WITH w AS (SELECT doc_id, sha256(text) AS sha, list_filter(str_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, sha, array_to_string(w[i : i + 4], ' ') AS h FROM (SELECT doc_id, sha, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), r AS (SELECT h FROM s GROUP BY 1 HAVING count(*) BETWEEN 2 AND 5),
p AS (SELECT a.doc_id AS l, b.doc_id AS r, count(*) AS shared FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id AND a.sha <> b.sha WHERE a.h IN (SELECT h FROM r) GROUP BY 1, 2 HAVING count(*) >= 3),
j AS (SELECT l, r, shared, shared / (x.n + y.n - shared) AS jaccard FROM p JOIN n x ON x.doc_id = l JOIN n y ON y.doc_id = p.r)
SELECT l AS left_doc_id, r AS right_doc_id, shared, round(jaccard, 6) AS jaccard, row_number() OVER (ORDER BY jaccard DESC, shared DESC, l, r)::INT AS candidate_rank FROM j WHERE jaccard >= 0.8 QUALIFY candidate_rank <= 500""",
    "url_normalize": r"""WITH p AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS u FROM pages) SELECT page_id, CASE WHEN u SIMILAR TO 'https?://[^/?]+' THEN u || '/' ELSE u END AS normalized, regexp_extract(u, '^https?://[^/?]+') AS origin FROM p""",
    "url_owner": r"""WITH p AS (SELECT page_id, coalesce(nullif(regexp_extract(url, '^https?://[^/?#]+(/[^?#]*)', 1), ''), '/') AS path FROM pages)
SELECT page_id, CASE WHEN starts_with(path, '/en/1') AND NOT starts_with(path, '/en/10') THEN 'en' WHEN starts_with(path, '/fr') THEN 'fr' WHEN NOT starts_with(path, '/de/2') THEN 'rest' END AS owner FROM p""",
    "robots_allows": r"""WITH p AS (SELECT page_id, coalesce(nullif(regexp_extract(url, '^https?://[^/?#]+(/[^?#]*)', 1), ''), '/') AS path FROM pages) SELECT page_id, NOT (starts_with(path, '/fr') AND NOT starts_with(path, '/fr/1')) AS allowed FROM p""",
    "sitemap_locs": "SELECT DISTINCT page_id % 20 AS g, url AS loc FROM pages",
    "cosine_topk": """WITH s AS (SELECT q.vec_id AS query_id, v.vec_id AS passage_id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score FROM embeddings q CROSS JOIN embeddings v WHERE q.vec_id % 100 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, passage_id)::INT AS rank, passage_id, round(score, 6) AS score FROM s QUALIFY rank <= 10""",
    "bm25_topk": bm25(0),
    "keyword_phrase": bm25(1),
    "rrf_hybrid": f"WITH {TWO} SELECT query_id, passage_id, round(score, 9) AS score, rank::INT AS rank FROM rf",
    "page_group_max": f"""WITH {TWO}, g AS (SELECT query_id, passage_id // 10 AS page_id, max(round(score, 12)) AS score, arg_min(passage_id, {{'a': -round(score, 12), 'b': passage_id}}) AS winning_passage_id FROM rf GROUP BY 1, 2)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, winning_passage_id, page_id)::INT AS rank, page_id, round(score, 9) AS score, winning_passage_id FROM g QUALIFY rank <= 10""",
    "catalog_keys": r"""WITH a AS (SELECT doc_id // 20 AS p, count(DISTINCT doc_id) AS n FROM documents WHERE doc_id % 25 = 3 GROUP BY 1) SELECT doc_id AS passage_id, doc_id // 10 AS page_id, row_number() OVER (ORDER BY doc_id // 10, doc_id)::INT AS vector_key, coalesce(a.n, 0)::INT AS alias_count, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS text_sha256 FROM documents LEFT JOIN a ON a.p = doc_id // 10""",
    "ndcg_mrr_recall": f"WITH {EVAL} SELECT mode, query_id, round(ndcg10, 6) AS ndcg10, round(mrr10, 6) AS mrr10, round(recall10, 6) AS recall10, round(recall100, 6) AS recall100 FROM mt",
    "eval_slices": f"""WITH {EVAL}, q AS (SELECT *, query_id::INT AS n FROM mt), c AS (SELECT *, unnest([{{'d': 'overall', 'v': 'all'}}, {{'d': 'split', 'v': CASE WHEN n < 4 THEN 'development' ELSE 'held-out' END}}, {{'d': 'source', 'v': 's' || (n % 2)::VARCHAR}}, {{'d': 'intent', 'v': 'i' || (n % 3)::VARCHAR}}]) AS cell FROM q)
SELECT mode, cell.d AS dimension, cell.v AS value, count(*) AS query_count, round(avg(ndcg10), 6) AS ndcg10, round(avg(mrr10), 6) AS mrr10, round(avg(recall10), 6) AS recall10, round(avg(recall100), 6) AS recall100 FROM c GROUP BY 1, 2, 3""",
    "latency_distribution": """WITH d AS (SELECT event_type, count(value) AS n, min(value) AS mi, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, max(value) AS ma FROM events GROUP BY 1)
SELECT event_type, n, round(mi, 6) AS min, round(p50, 6) AS p50, round(p95, 6) AS p95, round(p99, 6) AS p99, round(ma, 6) AS max, round((ma - mi) / p50, 6) AS spread, (ma - mi) / p50 > 0.15 AS unstable FROM d""",
    "scaling_table": """WITH m AS (SELECT pow(2, user_id % 4)::BIGINT AS workers, avg(value * pow(1.8::DOUBLE, user_id % 4)) AS t FROM events GROUP BY 1), l AS (SELECT *, first(t) OVER w AS b, first(workers) OVER w AS f, lag(t) OVER w AS pt, lag(workers) OVER w AS pw FROM m WINDOW w AS (ORDER BY workers))
SELECT workers, round(t, 6) AS throughput, round(t / b, 6) AS speedup, round(t / b * f / workers, 6) AS efficiency, coalesce(pow(t / pt, 1 / log2(workers / pw)) < 1.3, false) AS flattening FROM l""",
    "histogram_buckets": """WITH s AS (SELECT (event_id % 700)::VARCHAR || '/' || event_type AS s, value FROM events), n AS (SELECT DISTINCT s FROM s ORDER BY s LIMIT 512), e AS (SELECT CASE WHEN n.s IS NULL THEN 'overflow' ELSE s.s END AS series, value FROM s LEFT JOIN n ON n.s = s.s)
SELECT series, le::DOUBLE AS le, count(*) FILTER (value <= le::DOUBLE) AS cumulative_count FROM e CROSS JOIN (VALUES ('5'), ('10'), ('20'), ('50'), ('100'), ('infinity')) b(le) GROUP BY 1, 2""",
    "latency_pairs": "WITH e AS (SELECT user_id, event_type, event_id, lag(event_type) OVER w AS p, lag(event_id) OVER w AS a FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT user_id, count(*) AS n, sum(event_id - a)::BIGINT AS total FROM e WHERE event_type = 'click' AND p = 'view' GROUP BY 1",
    "crawl_windows": """WITH o AS (SELECT run, max(f) AS opens FROM (SELECT user_id % 7 AS run, user_id % 3 AS w, min(event_id) AS f FROM events WHERE event_type = 'view' GROUP BY 1, 2) GROUP BY 1), c AS (SELECT user_id % 7 AS run, event_id FROM events WHERE event_type = 'click'), z AS (SELECT run, max(event_id) AS closes FROM c GROUP BY 1)
SELECT run, opens, closes, count(*) FILTER (event_id >= opens) AS pages_in_window FROM c JOIN o USING (run) JOIN z USING (run) GROUP BY 1, 2, 3""",
    "merge_insert_idempotent": "SELECT n_nationkey AS k, n_name AS name, n_regionkey AS r, 2 AS versions, 0 AS third_load_rows, false AS third_load_committed FROM nation",
    "lineage_history": "SELECT 'regions' AS table_name, (i - 1)::BIGINT AS table_version, count(*) AS row_count, 'load-' || i::VARCHAR AS load_id, 'snap-' || i::VARCHAR AS snapshot_id FROM region JOIN (VALUES (1), (2)) v(i) ON r_regionkey >= 2 * (i - 1) AND r_regionkey < 2 * i GROUP BY i",
    "dq_unique": "WITH f AS (SELECT (l_orderkey % 1000)::VARCHAR || '/' || l_linenumber::VARCHAR AS x FROM lineitem GROUP BY l_orderkey % 1000, l_linenumber HAVING count(*) > 1) SELECT 'unique.lines' AS rule, (SELECT count(*) FROM f) AS failing, (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT x FROM f ORDER BY x LIMIT 5)) AS examples",
    "dq_referential": "WITH f AS (SELECT l_orderkey::VARCHAR || '/' || l_linenumber::VARCHAR AS x FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 5 <> 0)) SELECT 'referential.lines' AS rule, (SELECT count(*) FROM f) AS failing, (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT x FROM f ORDER BY x LIMIT 5)) AS examples",
    "dq_counts": "WITH a AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1), f AS (SELECT o_orderkey::VARCHAR AS x FROM orders LEFT JOIN a ON k = o_orderkey WHERE coalesce(n, 0) <> 4) SELECT 'counts.lines' AS rule, (SELECT count(*) FROM f) AS failing, (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT x FROM f ORDER BY x LIMIT 5)) AS examples",
    "dq_rules": """SELECT 'unique.keys' AS rule, (SELECT count(*) FROM (SELECT c_custkey FROM customer GROUP BY 1 HAVING count(*) > 1)) AS failing UNION ALL SELECT 'not_null.required_columns', count(*) FROM customer WHERE c_name IS NULL OR c_name = '' OR c_mktsegment IS NULL OR c_mktsegment = ''
UNION ALL SELECT 'unique.customer_status', (SELECT count(*) FROM (SELECT 1 FROM orders GROUP BY o_custkey, o_orderstatus HAVING count(*) > 1)) UNION ALL SELECT 'referential.customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 50 <> 7) UNION ALL SELECT 'schema.types', count(*) FROM customer WHERE c_custkey % 100 = 3""",
    "frontier_status_counts": f"WITH {TASKS} SELECT source_id, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'leased') AS leased, count(*) FILTER (status = 'succeeded') AS succeeded, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'leased' AND lease_expires_at <= 500) AS expired FROM tk GROUP BY 1",
    "unfinished_counts": f"WITH {TASKS} SELECT source_id, count(*) AS unfinished FROM tk WHERE status IN ('pending', 'leased') AND source_id NOT IN ('s0', 's3') GROUP BY 1",
    "fair_claim_order": f"WITH {TASKS}, r AS (SELECT *, row_number() OVER (PARTITION BY schedule_key ORDER BY retry_at, task_id) AS n FROM tk WHERE status = 'pending' AND retry_at <= 50) SELECT schedule_key, task_id, row_number() OVER (ORDER BY n, schedule_key <= 'k2', schedule_key, retry_at, task_id)::INT AS turn FROM r",
    "dead_letters": f"WITH {TASKS} SELECT task_id, source_id, attempts FROM tk WHERE status = 'failed'",
    "enqueue_new": f"WITH {CAPS} SELECT DISTINCT source_id, final_url AS url FROM cp WHERE length(final_url) % 2 <> 0",
    "source_completion": f"WITH {CAPS} SELECT q.s AS source_id, count(DISTINCT content_sha256) AS groups, q.n::BIGINT AS quota, count(DISTINCT content_sha256) >= q.n AS quota_met FROM (VALUES ('s0', 10), ('s1', 10000000), ('s2', 100)) q(s, n) LEFT JOIN cp ON cp.source_id = q.s GROUP BY q.s, q.n",
    "throttle_fold": """WITH l AS (SELECT user_id, list(CASE WHEN event_id % 13 = 0 THEN 999 WHEN event_type = 'error' THEN 429 WHEN event_type = 'signup' THEN 503 WHEN event_type = 'purchase' THEN 500 WHEN event_type = 'click' THEN 404 ELSE 200 END ORDER BY event_id) AS s FROM events GROUP BY 1)
SELECT user_id, list_reduce(s, lambda a, x: CASE WHEN x IN (429, 503) THEN least(60000, CASE WHEN a >= 1000 THEN a * 2 ELSE 1000 END) WHEN x >= 500 THEN a WHEN a - a // 8 < 100 THEN 0 ELSE a - a // 8 END, 0)::INT AS backoff_ms, len(s) AS answers FROM l""",
    "result_acceptance": """WITH a AS (SELECT l_orderkey AS t, l_orderkey * 10 + l_linenumber AS seq, l_linenumber % 2 = 1 AND l_suppkey % 2 = l_orderkey % 2 AS live, l_quantity::INT AS p FROM lineitem), f AS (SELECT t, min(seq) AS seq FROM a WHERE live GROUP BY 1), g AS (SELECT f.t, f.seq, max(a.p) AS p FROM f JOIN a ON a.t = f.t AND a.seq = f.seq GROUP BY 1, 2)
SELECT a.t AS task_id, a.seq, CASE WHEN NOT live THEN 'stale' WHEN a.seq = g.seq THEN 'accepted' WHEN a.p <> g.p THEN 'error' ELSE 'duplicate' END AS outcome FROM a LEFT JOIN g ON g.t = a.t""",
    "retention_blockers": "SELECT event_id, 'run-' || (user_id % 20)::VARCHAR AS crawl_run_id FROM events WHERE user_id % 20 % 2 = 0 AND NOT (user_id % 20 = 4 AND EXISTS (SELECT 1 FROM events x WHERE x.user_id % 20 = 4 AND x.event_id % 500 = 24)) AND event_id % 1000 + 300 <= 1000 AND event_id % 3 <> 0 AND (event_id % 1000 >= 400 OR event_id % 5 <> 0)",
    "recrawl_schedule": """WITH p AS (SELECT c_custkey, c_custkey % 48 + 1 AS h, CASE WHEN c_custkey % 10 <> 0 THEN 946684800 - c_custkey * 600 + (c_custkey % 48 + 1) * 3600 ELSE 946684800 END AS d FROM customer) SELECT c_custkey AS source_id, d AS next_due, c_custkey % 6 <> 0 AND d <= 946684800 AS due FROM p""",
    "redirect_chains": """WITH RECURSIVE h AS (SELECT c_custkey::VARCHAR AS url, ((c_custkey * 7 + 3) % 200)::VARCHAR AS loc FROM customer),
w AS (SELECT url, url AS cur, [url] AS chain, false AS looped FROM h UNION ALL SELECT w.url, h.loc, list_append(w.chain, h.loc), list_contains(w.chain, h.loc) FROM w JOIN h ON h.url = w.cur WHERE NOT looped AND len(chain) <= 10),
z AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY len(chain) DESC) AS r FROM w)
SELECT z.url, CASE WHEN NOT looped AND h.url IS NULL THEN cur END AS final_url, len(chain)::INT AS hops, CASE WHEN looped THEN 'redirect_loop' WHEN h.url IS NOT NULL THEN 'redirect_limit_exceeded' ELSE 'ok' END AS outcome FROM z LEFT JOIN h ON h.url = z.cur WHERE r = 1""",
    "link_frontier": """WITH RECURSIVE l AS (SELECT DISTINCT (l_partkey % 500)::VARCHAR AS u, (l_suppkey * 7 % 500)::VARCHAR AS t FROM lineitem), f(url, depth) AS (SELECT '1', 0 UNION SELECT l.t, f.depth + 1 FROM f JOIN l ON l.u = f.url WHERE f.depth < 20) SELECT url, min(depth)::INT AS depth FROM f GROUP BY 1""",
    "permit_selection": """WITH o AS (SELECT o_orderkey AS request_id, 'o' || (o_custkey % 40)::VARCHAR AS origin, 'k' || (o_custkey % 40)::VARCHAR AS k, CASE WHEN o_orderkey % 50 = 1 THEN 'active' ELSE 'pending' END AS status, o_orderkey % 97 AS q, o_orderkey % 1000 AS x FROM orders), a AS (SELECT origin, count(*) AS n FROM o WHERE status = 'active' GROUP BY 1)
SELECT request_id, o.origin, q AS queued_at, row_number() OVER (ORDER BY k <= 'k12', k, q, request_id) AS turn FROM o LEFT JOIN a ON a.origin = o.origin WHERE status = 'pending' AND x > 500 AND coalesce(n, 0) < CASE WHEN o.origin = 'o7' THEN 100000 ELSE 5 END AND o.origin <> 'o3'""",
    "stream_reduce": """SELECT 'run-' || (user_id % 5)::VARCHAR AS crawl_run_id, count(*) FILTER (event_id % 101 <> 0) AS accepted, count(*) FILTER (event_id % 101 <> 0 AND event_id % 51 = 0) AS conflicts,
count(*) FILTER (event_id % 101 = 0) + count(*) FILTER (event_id % 101 = 0 AND event_id % 51 = 0) AS quarantined, 0 AS added_by_replay FROM events GROUP BY 1""",
}

_RECRAWL = f"""
WITH {SRC}, {CHANGES},
e AS (SELECT source_id, list(snapshot_id) AS ids, max(observed_at) AS newest FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY observed_at DESC) AS r FROM src WHERE stop_reason = 'frontier_exhausted' AND failed_count = 0 AND scope = 'scope-0') WHERE r <= 3 GROUP BY 1),
c AS (SELECT e.source_id, newest, len(ids) AS n, count(DISTINCT snapshot_id || '/' || page_id::VARCHAR) AS comparable, count(DISTINCT CASE WHEN change_status = 'changed' THEN snapshot_id || '/' || page_id::VARCHAR END) AS changed
  FROM e LEFT JOIN chg ON chg.source_id = e.source_id AND list_contains(ids, snapshot_id) AND list_contains(ids, previous_snapshot_id) GROUP BY 1, 2, 3),
k AS (SELECT *, n = 3 AND comparable >= CASE WHEN source_id < 'D' THEN 1 ELSE 10000000 END AS ok FROM c),
f AS (SELECT *, CASE WHEN ok THEN changed / comparable END AS cf FROM k),
p AS (SELECT *, CASE WHEN cf >= 0.25 THEN 18.0 WHEN cf <= 0.02 THEN 30.0 ELSE 24.0 END::DOUBLE AS proposed FROM f)"""
ORACLES |= {
    "recrawl_recommendation": f"""{_RECRAWL} SELECT source_id, proposed AS proposed_interval_hours, proposed - 24.0::DOUBLE AS adjustment_hours, CASE WHEN proposed > 24 THEN 'increase' WHEN proposed < 24 THEN 'decrease' ELSE 'hold' END AS adjustment_type,
CASE WHEN ok THEN 'completed_history' ELSE 'unsupported' END AS evidence_status, comparable AS comparable_page_observations, changed AS changed_page_observations, round(cf, 6) AS change_fraction, CASE WHEN ok THEN 'medium' ELSE 'low' END AS confidence FROM p""",
    "recrawl_validation": f"""{_RECRAWL} SELECT source_id, CASE WHEN ok THEN 'completed_history' ELSE 'unsupported' END AS evidence_status, CASE WHEN date_diff('day', newest[1:10]::DATE, DATE '2001-01-01') > 30 THEN 'stale' WHEN ok THEN 'valid' ELSE 'unsupported' END AS validation_status,
CASE WHEN date_diff('day', newest[1:10]::DATE, DATE '2001-01-01') > 30 THEN 'evidence is too old' WHEN ok THEN 'complete, compatible, fresh and comparable' ELSE 'too few comparable observations' END AS validation_reason FROM p""",
    "lease_fold": """
WITH v AS (SELECT 't' || (user_id % 300)::VARCHAR AS task_id, event_id, CASE event_type WHEN 'view' THEN 'claim' WHEN 'click' THEN 'renew' WHEN 'error' THEN 'fail' WHEN 'purchase' THEN 'succeed' ELSE 'expire' END AS ac, (event_id % 4)::VARCHAR AS w FROM events),
l AS (SELECT task_id, list({'s': '', 'e': 0, 'a': 0, 'o': NULL::VARCHAR, 'x': 0, 'ac': ac, 'w': w} ORDER BY event_id) AS ev FROM v GROUP BY 1),
r AS (SELECT task_id, list_reduce(ev, lambda p, c: CASE
    WHEN c.ac = 'claim' AND p.s = 'pending' THEN {'s': 'leased', 'e': p.e + 1, 'a': p.a + 1, 'o': c.w, 'x': p.x, 'ac': '', 'w': ''}
    WHEN c.ac = 'expire' AND p.s = 'leased' THEN {'s': 'pending', 'e': p.e, 'a': p.a, 'o': NULL::VARCHAR, 'x': p.x, 'ac': '', 'w': ''}
    WHEN c.ac = 'renew' AND p.s = 'leased' AND p.o = c.w THEN p
    WHEN c.ac = 'fail' AND p.s = 'leased' AND p.o = c.w THEN {'s': CASE WHEN p.a >= 3 THEN 'failed' ELSE 'pending' END, 'e': p.e, 'a': p.a, 'o': NULL::VARCHAR, 'x': p.x, 'ac': '', 'w': ''}
    WHEN c.ac = 'succeed' AND p.s = 'leased' AND p.o = c.w THEN {'s': 'succeeded', 'e': p.e, 'a': p.a, 'o': NULL::VARCHAR, 'x': p.x, 'ac': '', 'w': ''}
    ELSE {'s': p.s, 'e': p.e, 'a': p.a, 'o': p.o, 'x': p.x + 1, 'ac': '', 'w': ''} END,
    {'s': 'pending', 'e': 0, 'a': 0, 'o': NULL::VARCHAR, 'x': 0, 'ac': '', 'w': ''}) AS z FROM l)
SELECT task_id, z.s AS status, z.e AS epoch, z.a AS attempts, z.o AS owner, z.x AS stale FROM r""",
}
ORACLES["bm25_indexed"] = f"SELECT * FROM ({bm25(0)}) UNION ALL SELECT * FROM ({bm25(1)})"
