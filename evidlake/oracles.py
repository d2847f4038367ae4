"""DuckDB SQL with the same results as the queries, over the same Parquet files."""

from __future__ import annotations

PULLS = """
ship AS (SELECT l_orderkey, max(l_shipdate) AS shipped FROM lineitem GROUP BY 1),
pulls AS (SELECT o_orderkey AS number, o_orderstatus AS state, o_orderdate AS created_at, o_custkey AS author,
                 CASE WHEN o_orderstatus <> 'O' THEN shipped END AS merged_at
          FROM orders LEFT JOIN ship ON o_orderkey = l_orderkey)"""
RELEASES = """
releases AS (SELECT p_brand || '-' || p_partkey AS tag, p_name AS name, CASE WHEN p_size % 10 <> 0 THEN f END AS published_at
             FROM part LEFT JOIN (SELECT l_partkey, min(l_shipdate) AS f FROM lineitem GROUP BY 1) ON p_partkey = l_partkey)"""
ISSUES = """
issues AS (SELECT event_id AS number, user_id, 'error ' || props AS title, props AS body, ['Bug', json_extract_string(props, '$.k')] AS labels, ts AS created_at
           FROM events WHERE event_type = 'error')"""
COSINE = "list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0))"
WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
DIFF = """
w AS (SELECT min(published_at) AS a, max(published_at) AS b FROM releases),
c AS (SELECT o_orderkey AS sha, o_orderdate AS committed_at FROM orders, w WHERE o_orderdate > a AND o_orderdate <= b)"""
LINKS = """
SELECT 'pull_request:' || number AS pull_request, 'commit:' || c_custkey AS commit
FROM pulls JOIN customer ON author = c_custkey WHERE merged_at IS NOT NULL"""


def _tf(terms: list[str]) -> str:
    """CTE m: documents that hold every term, with the number of occurrences."""
    each = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS t{i}" for i, t in enumerate(terms))
    names = [f"t{i}" for i in range(len(terms))]
    return f"""m AS (SELECT doc_id AS chunk_id, CAST({" + ".join(names)} AS BIGINT) AS text_score
      FROM (SELECT doc_id, {each} FROM (SELECT doc_id, {WORDS} AS w FROM documents)) WHERE {" AND ".join(f"{n} > 0" for n in names)})"""


def _blend(inside: str) -> str:
    """Pools of 60, blended by 0.6, the best 15."""
    return f"""
WITH inside AS ({inside}),
v AS (SELECT vec_id AS chunk_id, {COSINE} AS vector_score FROM embeddings WHERE vec_id IN (SELECT chunk_id FROM inside) ORDER BY 2 DESC, 1 LIMIT 60),
{_tf(["and", "the"])},
n AS (SELECT count(*) AS text_match_count FROM m WHERE chunk_id IN (SELECT chunk_id FROM inside)),
f AS (SELECT * FROM m WHERE chunk_id IN (SELECT chunk_id FROM inside) ORDER BY text_score DESC, chunk_id LIMIT 60),
b AS (SELECT chunk_id, coalesce(vector_score, 0) AS vector_score, coalesce(text_score, 0)::DOUBLE AS text_score FROM v FULL JOIN f USING (chunk_id)),
s AS (SELECT *, 0.6::DOUBLE * vector_score + (1 - 0.6::DOUBLE) * CASE WHEN (SELECT max(text_score) FROM f) > 0 THEN text_score / (SELECT max(text_score) FROM f) ELSE 0 END AS blended FROM b),
k AS (SELECT * FROM s WHERE chunk_id IN (SELECT doc_id FROM documents) ORDER BY blended DESC, chunk_id LIMIT 15)"""


SQL = {
    "count_window": f"WITH {PULLS} SELECT count(*) AS n FROM pulls WHERE created_at >= '1996-01-01' AND created_at < '1998-01-01'",
    "count_merged": f"WITH {PULLS} SELECT count(merged_at) AS n FROM pulls",
    "count_labels": f"WITH {ISSUES} SELECT count(*) AS n FROM issues WHERE created_at >= '2024-01-05' AND created_at < '2024-01-20' AND list_has_any(list_transform(labels, lambda x: lower(x)), ['bug', '7'])",
    "coverage_by_field": f"WITH {PULLS} SELECT 'created_at' AS field, min(created_at) AS earliest, max(created_at) AS latest, count(created_at) AS total FROM pulls UNION ALL SELECT 'merged_at', min(merged_at), max(merged_at), count(merged_at) FROM pulls",
    "count_with_coverage": f"WITH {PULLS} SELECT count(*) FILTER (merged_at >= '1996-01-01' AND merged_at < '1998-01-01') AS n, min(merged_at) AS earliest, max(merged_at) AS latest, count(merged_at) AS total, min(merged_at) <= '1996-01-01' AND max(merged_at) >= '1998-01-01' AS complete_for_window FROM pulls",
    "list_releases_prefix": f"WITH {RELEASES} SELECT * FROM releases WHERE starts_with(tag, 'Brand#2-') ORDER BY published_at DESC NULLS LAST, tag DESC LIMIT 50",
    "list_releases_total": f"WITH {RELEASES} SELECT count(*) AS n FROM releases WHERE starts_with(tag, 'Brand#2-') AND published_at < '1999-01-01'",
    "release_diff": f"WITH {RELEASES}, {DIFF} SELECT * FROM c ORDER BY committed_at, sha LIMIT 40",
    "release_diff_total": f"WITH {RELEASES}, {DIFF} SELECT count(*) AS n FROM c",
    "find_regressions": f"WITH {ISSUES} SELECT i.number, i.user_id, i.created_at, (SELECT min_by(e.event_id, (e.ts, e.event_id)) FROM events e WHERE e.event_type = 'purchase' AND e.user_id = i.user_id AND e.ts >= i.created_at) AS fixed_by FROM issues i WHERE list_has_any(labels, ['bug', 'regression', 'Bug', 'kind:bug']) AND created_at >= '2024-01-02'",
    "regressions_total": f"""WITH {ISSUES} SELECT count(*) AS n FROM issues WHERE list_has_any(labels, ['bug', 'regression', 'Bug', 'kind:bug']) AND (title ILIKE '%"k": 1%' OR body ILIKE '%"k": 1%')""",
    "issue_fixes": f"WITH {PULLS} SELECT CAST(c_custkey AS INT) AS number, (SELECT min_by(p.number, (p.merged_at, p.number)) FROM pulls p WHERE p.author = c_custkey AND p.merged_at >= '1997-01-01') AS fixed_by FROM customer",
    "export_links": f"WITH {PULLS} {LINKS}",
    "link_adjacency": f"WITH {PULLS}, e AS ({LINKS}), b AS (SELECT pull_request AS a, commit AS o FROM e UNION SELECT commit, pull_request FROM e) SELECT a AS artefact, string_agg(o, ',' ORDER BY o) AS linked FROM b GROUP BY 1",
    "tenant_scoped_count": "SELECT t AS tenant, count(o_orderkey) AS n FROM (VALUES ('0'), ('3'), ('9')) v(t) LEFT JOIN (SELECT o_orderkey, CAST(n_regionkey AS VARCHAR) AS r FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey) ON r = t GROUP BY 1",
    "exact_vector_topk": f"SELECT vec_id AS chunk_id, label, round({COSINE}, 9) AS score FROM embeddings ORDER BY {COSINE} DESC, vec_id LIMIT 10",
    "batch_vector_topk": "SELECT qid, chunk_id, round(score, 9) AS score, CAST(rank AS INT) AS rank FROM (SELECT q.vec_id AS qid, e.vec_id AS chunk_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, e.vec_id) AS rank FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0) WHERE rank <= 5",
    "text_match_count": f"WITH {_tf(['the', 'and', 'tion'])} SELECT count(*) AS n FROM m",
    "text_topk_tf": f"WITH {_tf(['the', 'and', 'tion'])} SELECT * FROM m ORDER BY text_score DESC, chunk_id LIMIT 20",
    "text_index_topk": f"WITH {_tf(['the', 'and', 'tion'])} SELECT * FROM m ORDER BY text_score DESC, chunk_id LIMIT 20",
    "text_index_search": """WITH w AS (SELECT doc_id AS chunk_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents),
        n AS (SELECT chunk_id, len(list_filter(list_zip(w, w[2:]), lambda z: z[1] = 'the' AND z[2] = 'and')) AS a, len(list_filter(list_zip(w, w[2:]), lambda z: z[1] = 'of' AND z[2] = 'the')) AS b, len(list_filter(list_zip(w, w[2:]), lambda z: z[1] = 'the' AND z[2] = 'to')) AS c FROM w)
        SELECT chunk_id, CAST(greatest(a, b) AS BIGINT) AS text_score FROM n WHERE greatest(a, b) > 0 AND c = 0 ORDER BY 2 DESC, 1 LIMIT 40""",
    "hybrid_topk": _blend("SELECT doc_id AS chunk_id FROM documents") + " SELECT chunk_id, lang AS entity_type, round(vector_score, 9) AS vector_score, text_score, round(blended, 9) AS blended, text_match_count FROM k JOIN documents ON chunk_id = doc_id, n",
    "hybrid_filtered": _blend("SELECT doc_id AS chunk_id FROM documents WHERE lang = 'en' AND doc_id IN (SELECT o_orderkey FROM orders WHERE o_orderdate BETWEEN '1996-01-01' AND '1998-01-01') AND doc_id IN (SELECT l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_name ILIKE '%RED%')") + " SELECT chunk_id, round(vector_score, 9) AS vector_score, text_score, round(blended, 9) AS blended, text_match_count FROM k, n",
    "rrf_fusion": f"WITH {_tf(['the'])}, l AS (SELECT chunk_id, row_number() OVER (ORDER BY s DESC, chunk_id) AS r FROM (SELECT vec_id AS chunk_id, {COSINE} AS s FROM embeddings ORDER BY 2 DESC, 1 LIMIT 50) UNION ALL SELECT chunk_id, row_number() OVER (ORDER BY text_score DESC, chunk_id) FROM (SELECT * FROM m ORDER BY text_score DESC, chunk_id LIMIT 50)) SELECT chunk_id, round(sum(1.0::DOUBLE / (60 + r)), 9) AS fused FROM l GROUP BY 1",
    "unembedded_chunks": "SELECT doc_id AS chunk_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)",
    "normalise_text": r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+(\n|$)', '\1', 'g'), '\n{3,}', E'\n\n', 'g'), '^\s+|\s+$', '', 'g')) AS normal FROM documents""",
    "strip_comments": "SELECT page_id, md5(regexp_replace(html, '<!--.*?-->', '', 'gs')) AS stripped FROM pages",
    "artefact_keys": """WITH a AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'issue' WHEN 1 THEN 'commit' ELSE 'thing' END AS k, o_orderkey AS v FROM orders),
        g AS (SELECT *, CASE WHEN k = 'commit' OR (k = 'issue' AND v > 0) THEN k END AS kind FROM a)
        SELECT o_orderkey, kind, CASE WHEN kind IS NOT NULL THEN CAST(v AS VARCHAR) END AS value, k AS artefact_type, rtrim(translate(base64(encode(k || ':' || v)), '+/', '-_'), '=') || '-' || (v % 4) AS chunk_key, CASE kind WHEN 'commit' THEN 'commit/' || v WHEN 'issue' THEN 'issues/' || v END AS fragment FROM g""",
    "citation_markers": r"SELECT conv_id, turn, array_to_string(regexp_extract_all(coalesce(text, '') || ' [E' || (turn * 7 + conv_id) % 9 || ']' || ' [E' || (conv_id * 5) % 9 || ']', '\[E(\d+)\]', 1), ',') AS markers FROM conversations",
    "unresolved_markers": r"""WITH m AS (SELECT conv_id, turn, regexp_extract_all(coalesce(text, '') || ' [E' || (turn * 7 + conv_id) % 9 || ']' || ' [E' || (conv_id * 5) % 9 || ']', '\[E(\d+)\]', 1) AS l FROM conversations),
        u AS (SELECT conv_id, turn, list_filter(l, lambda x: NOT coalesce(TRY_CAST(x AS INT) BETWEEN 1 AND 5, false)) AS l FROM m)
        SELECT conv_id, turn, array_to_string(list_transform(list_filter(l, lambda x, i: list_position(l, x) = i), lambda x: 'E' || x), ',') AS unresolved FROM u""",
    "declined_answers": r"""SELECT conv_id, turn, CASE WHEN text IS NULL THEN NULL ELSE regexp_matches(lower(s), 'does not contain|do not contain|not in the evidence|no evidence|cannot be determined|cannot determine|is not available|not answerable|i don''t have|i do not have') AND NOT regexp_matches(lower(s), '\b\d+(\.\d+)?\s*(percent|%)|\bis\s+\d+') END AS declined
        FROM (SELECT *, text || CASE WHEN turn % 2 = 0 THEN ' The evidence does not contain that.' ELSE ' There is no evidence, but it is 7.' END AS s FROM conversations)""",
    "citation_metrics": """WITH a AS (SELECT conv_id, turn, [conv_id % 4, conv_id % 4, 2] AS e, list_slice([turn % 4, 2, conv_id % 5], 1, turn % 4) AS c FROM conversations)
        SELECT conv_id, turn, round(len(list_filter(e, lambda x: list_contains(c, x))) / 3, 9) AS recall, round(CASE WHEN len(c) = 0 THEN 0.0::DOUBLE ELSE len(list_filter(c, lambda x: list_contains(e, x))) / len(c) END, 9) AS precision FROM a""",
    "latency_percentiles": "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, count(*) AS n FROM events GROUP BY 1",
    "largest_remainder": """WITH c AS (SELECT lang, count(*) AS n, sum(count(*)) OVER () AS t FROM documents GROUP BY 1), f AS (SELECT lang, n, CAST(229 * n // t AS BIGINT) AS f, row_number() OVER (ORDER BY 229 * n % t DESC, lang) AS place FROM c)
        SELECT lang, n, f + CAST(place <= 229 - (SELECT sum(f) FROM f) AS BIGINT) AS seats FROM f""",
    "stratified_first_n": "SELECT role, conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) AS n FROM conversations) WHERE n <= 7",
    "failover_verdict": """WITH r AS (SELECT event_id % 2 = 0 AS before, event_type <> 'error' AS ok, user_id % 5 = 0 AS second FROM events),
        c AS (SELECT count(*) FILTER (before) AS before_total, count(*) FILTER (before AND NOT ok) AS before_failures, count(*) FILTER (NOT before) AS after_total, count(*) FILTER (NOT before AND ok) AS after_successes, count(*) FILTER (NOT before AND ok AND second) AS after_secondary FROM r)
        SELECT *, CASE WHEN before_failures < 14 THEN 'inconclusive' WHEN after_successes >= 43 AND after_secondary >= 1 THEN 'held' ELSE 'did not hold' END AS outcome FROM c""",
    "usage_totals": "SELECT CASE WHEN event_type IN ('click', 'view') THEN 'web' WHEN event_type = 'purchase' THEN 'shop' ELSE 'other' END AS label, CAST(round(sum(value)) AS BIGINT) AS total FROM events GROUP BY 1",
    "usage_reconcile": """WITH e AS (SELECT *, CASE WHEN event_type IN ('click', 'view') THEN 'web' WHEN event_type = 'purchase' THEN 'shop' ELSE 'other' END AS label FROM events),
        c AS (SELECT label, CAST(round(sum(value)) AS BIGINT) AS client FROM e WHERE event_type <> 'purchase' GROUP BY 1), m AS (SELECT label, CAST(round(sum(value)) AS BIGINT) AS metric FROM e WHERE event_id % 100 <> 0 AND event_type IN ('click', 'view', 'purchase') GROUP BY 1)
        SELECT label, client, metric, coalesce(abs(metric - client) <= 0.02 * client, false) AS within FROM c FULL JOIN m USING (label)""",
    "daily_budget": "SELECT user_id AS tenant_id, CAST(ts AS DATE) AS usage_date, CAST(sum(CAST(round(value) AS BIGINT)) AS BIGINT) AS used, sum(CAST(round(value) AS BIGINT)) < 150 AS within_budget FROM events GROUP BY 1, 2",
    "running_budget": "SELECT event_id, CAST(u AS BIGINT) AS used_before, u < 100 AS allowed FROM (SELECT event_id, coalesce(sum(CAST(round(value) AS BIGINT)) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS u FROM events)",
    "call_cost_dated": """WITH r AS (SELECT * FROM (VALUES ('click', DATE '2024-01-01', DATE '2024-01-14', 2.00, 0.20, 2.50, 10.00), ('click', DATE '2024-01-15', NULL, 3.00, 0.30, 3.75, 15.00), ('view', DATE '2024-01-10', NULL, 0.40, 0.10, 0.00, 1.60)) t(k, a, b, i, c, w, o))
        SELECT event_id, CAST((event_id * i + (event_id % 1000) * o + (event_id % 77) * c + 3 * w)::DECIMAL(30, 2)::DECIMAL(38, 11) * 0.000001 AS DECIMAL(18, 9)) AS cost_usd FROM events LEFT JOIN r ON event_type = k AND CAST(ts AS DATE) >= a AND (b IS NULL OR CAST(ts AS DATE) <= b)""",
    "error_streaks": """WITH e AS (SELECT *, CASE WHEN event_type IN ('error', 'click') THEN event_type END AS kind FROM events), c AS (SELECT *, CAST(kind IS DISTINCT FROM lag(kind) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS new FROM e),
        r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM c)
        SELECT user_id, kind, min(ts) AS first, count(*) AS length FROM r WHERE kind IS NOT NULL GROUP BY user_id, run, kind HAVING count(*) >= 3""",
    "gap_checks": "SELECT user_id, count(*) AS samples, round(min(g), 6) AS least_gap, coalesce(min(g) >= 30, true) AS spaced FROM (SELECT user_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts)) / 1e6 AS g FROM events) GROUP BY 1",
    "cursor_watermark": "SELECT event_id, max(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS cursor FROM events",
    "keyed_state": """WITH b AS (SELECT user_id, event_id % 4 AS b, max(event_id) FILTER (event_type <> 'error') AS last FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY b DESC) AS n FROM b)
        SELECT e.user_id, e.event_id, e.value FROM r JOIN events e ON r.last = e.event_id WHERE n = 1""",
    "commit_points": """WITH k AS (SELECT DISTINCT event_id * 7 AS key FROM events WHERE event_id IS NOT NULL), f AS (SELECT l_orderkey AS sha, 'p' || lpad(CAST(l_partkey AS VARCHAR), 9, '0') || '/' || l_linenumber AS path FROM lineitem),
        g AS (SELECT sha, count(*) AS n, string_agg(path, ',' ORDER BY path) AS paths FROM f GROUP BY 1)
        SELECT key, o_orderkey IS NOT NULL AS found, o_orderstatus AS message, CAST(CASE WHEN o_orderkey IS NOT NULL THEN coalesce(n, 0) END AS INT) AS n_files, CASE WHEN o_orderkey IS NOT NULL THEN coalesce(paths, '') END AS paths FROM k LEFT JOIN orders ON o_orderkey = key LEFT JOIN g ON g.sha = key""",
    "artefact_key_pages": """WITH p AS (SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 10 AS page FROM (SELECT DISTINCT user_id, event_id FROM events))
        SELECT user_id, CAST(page AS INT) AS page, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS keys FROM p GROUP BY ALL""",
    "ilike_from_index": "SELECT page_id, url FROM pages WHERE url ILIKE '%M.t%Ex_mple%25%'",
    "run_overlap": """WITH o AS (SELECT o_custkey, o_orderdate AS a, o_orderdate + to_days(CAST(o_orderkey % 200 AS INT)) AS b FROM orders), e AS (SELECT o_custkey, a AS at_, 1 AS step FROM o UNION ALL SELECT o_custkey, b, -1 FROM o),
        s AS (SELECT *, sum(step) OVER (PARTITION BY o_custkey ORDER BY at_, step ROWS UNBOUNDED PRECEDING) AS n FROM e), g AS (SELECT *, lag(n) OVER w AS was, lag(at_) OVER w AS before FROM s WINDOW w AS (PARTITION BY o_custkey ORDER BY at_, step, n DESC))
        SELECT o_custkey, count(*) FILTER (step = 1) AS intervals, CAST(max(n) AS BIGINT) AS peak, coalesce(sum(CASE WHEN was = 0 THEN epoch_us(at_) - epoch_us(before) END), 0) / 1e6 AS idle_seconds FROM g GROUP BY 1""",
    "run_acceptance": """WITH r AS (SELECT o_orderkey AS run, o_orderdate - INTERVAL 1000 DAY AS queued, o_orderdate - INTERVAL 999 DAY AS begun, CASE WHEN o_orderkey % 7 = 0 THEN o_orderdate - INTERVAL 1000 DAY ELSE o_orderdate - INTERVAL 998 DAY END AS started, o_orderdate - INTERVAL 400 DAY AS finished, o_orderdate + INTERVAL 1500 DAY AS ended,
            CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'succeeded' END AS result, CASE WHEN o_orderkey % 3 = 0 THEN 'failed' ELSE 'succeeded' END AS expected FROM orders),
        l AS (SELECT l_orderkey AS run, l_linenumber AS place, min(l_shipdate) AS t, max(l_quantity) AS q FROM lineitem GROUP BY ALL), g AS (SELECT *, lag(t) OVER (PARTITION BY run ORDER BY place) AS was FROM l),
        s AS (SELECT g.run, bool_and(t BETWEEN queued AND ended) AND bool_and(q <= 45) AND bool_or(q <= 45 AND t BETWEEN begun AND ended) AND bool_and(was IS NULL OR t >= was) AS good, count(*) >= 2 AND bool_and(q <= 40 AND t + INTERVAL 1500 DAY >= ended) AND bool_and(was IS NULL OR t - was >= INTERVAL 1 DAY) AND min(t + INTERVAL 1500 DAY) >= any_value(finished) AS idle, min(t + INTERVAL 1500 DAY) AS first_idle FROM g JOIN r USING (run) GROUP BY 1),
        k AS (SELECT l_orderkey AS run, count(*) FILTER (l_returnflag = 'N') = 1 AND count(*) FILTER (l_returnflag = 'N' AND l_linestatus = 'O') = 1 AS done, count(*) FILTER (l_returnflag = 'R') = 1 AND count(*) FILTER (l_returnflag = 'R' AND l_linestatus <> 'O') = 1 AS negated FROM lineitem GROUP BY 1),
        f AS (SELECT r.*, begun <= started AS times, coalesce(s.good, false) AS good, coalesce(s.idle, false) AS idle, first_idle, coalesce(k.done AND result = expected, false) AS built, coalesce(k.negated, false) AS negated FROM r LEFT JOIN s USING (run) LEFT JOIN k USING (run))
        SELECT run, times AND good AS on_demand, built, built AND expected = 'failed' AND negated AS refused, idle AS idle_after, CASE WHEN times THEN (epoch_us(started) - epoch_us(queued)) / 1e6 END AS queue_seconds, CASE WHEN times THEN (epoch_us(finished) - epoch_us(started)) / 1e6 END AS build_seconds,
            CASE WHEN idle THEN (epoch_us(first_idle) - epoch_us(finished)) / 1e6 END AS to_idle_seconds FROM f""",
    "deadline_seen": "SELECT u.event_id, min(o.ts) AS first_seen, min(o.ts) IS NOT NULL AS in_time FROM events u LEFT JOIN events o ON o.event_type = 'view' AND o.user_id = u.user_id AND o.ts >= u.ts AND o.ts <= u.ts + INTERVAL 7200 SECOND WHERE u.event_type = 'click' GROUP BY 1",
    "poison_within": "SELECT count(*) AS uploads, count(s) AS in_time FROM (SELECT u.event_id, min(o.ts) AS s FROM events u LEFT JOIN events o ON o.event_type = 'view' AND o.user_id = u.user_id AND o.ts >= u.ts AND o.ts <= u.ts + INTERVAL 36000 SECOND WHERE u.event_type = 'click' GROUP BY 1)",
    "dead_letter_due": "SELECT event_id AS chunk_id, CAST(event_id % 7 AS INT) AS attempts FROM events WHERE event_id % 7 < 5 AND ts <= '2024-01-10'",
    "backoff_schedule": "SELECT event_id, CAST(CASE WHEN event_id % 6 <= 1 THEN 0 ELSE pow(2, event_id % 6 - 2) END AS INT) AS minutes FROM events",
    "stale_keys": "SELECT DISTINCT rtrim(translate(base64(encode(o_orderstatus)), '+/', '-_'), '=') || '-' || (o_custkey % 100) AS chunk_id FROM orders WHERE NOT (o_orderstatus = 'O' AND o_custkey % 100 IN (SELECT c_custkey % 70 FROM customer))",
    "multiset_equal": """WITH a AS (SELECT o_custkey, o_orderstatus FROM orders), b AS (SELECT * FROM a WHERE o_custkey % 50 <> 7 UNION ALL SELECT * FROM a WHERE o_custkey % 50 = 8),
        c AS (SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) AS only_a, (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) AS only_b) SELECT *, only_a = 0 AND only_b = 0 AS equal FROM c""",
    "upsert_latest": "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1",
    "minute_usage": "SELECT date_trunc('minute', ts) AS minute, event_type, round(sum(value), 6) AS total, count(*) AS n FROM events GROUP BY 1, 2",
    "sliding_usage": "SELECT date_trunc('hour', ts) - INTERVAL 1 HOUR * h AS start, count(*) AS n FROM events, (VALUES (0), (1)) v(h) GROUP BY 1",
    "session_usage": """WITH g AS (SELECT *, CAST(coalesce(ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 8 HOUR, true) AS INT) AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
        SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""",
    "verdict_conjunction": "SELECT o_custkey, CASE WHEN bool_or(f = false) THEN 'fail' WHEN bool_and(coalesce(f, false)) THEN 'pass' ELSE 'not run' END AS verdict FROM (SELECT o_custkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice > 20000 END AS f FROM orders) GROUP BY 1",
    "exact_cover": "SELECT conv_id, count(*) AS n, min(turn) = 0 AND max(turn) = count(*) - 1 AND count(DISTINCT turn) = count(*) AS exact FROM conversations GROUP BY 1",
    "type_arm_rollup": "SELECT lang, source, count(*) AS n, CAST(sum(quality) AS BIGINT) AS good FROM labels JOIN documents USING (doc_id) GROUP BY ROLLUP (lang, source)",
    "assembled_texts": r"""WITH t AS (SELECT conv_id, turn, text, greatest(length(text), 1) AS k FROM conversations), s AS (SELECT *, sum(k) OVER w AS c, row_number() OVER w AS n FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)),
        o AS (SELECT *, max(CAST(c > 900 AS INT)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS over FROM s),
        p AS (SELECT *, CASE WHEN over = 0 THEN text WHEN n = 1 THEN left(text, length(text) * 900 // k) END AS shown FROM o)
        SELECT conv_id, md5(coalesce(string_agg(shown, E'\n\n' ORDER BY turn), '')) AS digest, CAST(sum(k) AS BIGINT) AS token_count FROM p GROUP BY 1""",
}

# Evaluation over results: the nearest twelve of every tenth vector, as two arms.
RESULTS = """
q AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings WHERE vec_id % 10 = 0),
n AS (SELECT q.vec_id AS qid, e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], q.v) AS s, 'label:' || e.label AS artefact FROM q, embeddings e),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, vec_id) AS r FROM n QUALIFY r <= 12),
h AS (SELECT qid, arm, artefact, round(s, 9) AS s, CASE arm WHEN 'E1' THEN r ELSE 13 - r END AS r FROM r, (VALUES ('E1'), ('E2')) a(arm)),
c AS (SELECT qid, arm, artefact, arg_min(s, r) AS s, row_number() OVER (PARTITION BY qid, arm ORDER BY min(r)) AS place FROM h GROUP BY 1, 2, 3),
a AS (SELECT qid, arm, max(CASE WHEN place = 1 THEN artefact END) AS first, max(CASE WHEN place = 1 THEN s END) AS s1, max(CASE WHEN place = 2 THEN s END) AS s2, string_agg(artefact, ',' ORDER BY place) AS artefacts,
             ((qid * 37 + CASE arm WHEN 'E2' THEN 11 ELSE 0 END) % 101)::DOUBLE AS ms, CASE WHEN qid % CASE arm WHEN 'E1' THEN 70 ELSE 110 END = 0 THEN 'timeout' END AS error FROM c GROUP BY 1, 2),
t AS (SELECT a.*, 'label:' || q.label AS target, c.place, a.qid % 3 AS entity_type FROM a JOIN q ON q.vec_id = a.qid LEFT JOIN c ON c.qid = a.qid AND c.arm = a.arm AND c.artefact = 'label:' || q.label),
sc AS (SELECT qid, arm, entity_type, ms, error, CASE WHEN error IS NULL THEN CAST(first = target AS INT) END AS top1, CASE WHEN error IS NULL THEN coalesce(1 / place, 0.0)::DOUBLE END AS rr, CASE WHEN error IS NULL AND first = target THEN s1 - s2 END AS margin FROM t)"""
OUTCOMES = """
o AS (SELECT doc_id AS id, doc_id % 3 AS pass_index, 'arm' || doc_id % 2 AS arm, CASE WHEN doc_id % 7 = 0 THEN 'unanswerable' ELSE 'factual' END AS category, quality::DOUBLE AS recall, quality * 0.5::DOUBLE AS prec,
             CASE WHEN doc_id % 5 <> 0 THEN quality * 0.25::DOUBLE + 0.5 END AS grounded, doc_id % 10 <> 0 AS reason, doc_id % 4 <> 0 AS must, quality = 1 AS sat, toxic = 0 AS handled, n_chars::DOUBLE AS ms, n_chars / 1024 AS cost, doc_id % 13 <> 0 AS fine, doc_id % 17 = 0 AS no_reply, doc_id % 19 = 0 AS filtered, lang AS model
      FROM labels JOIN documents USING (doc_id))"""
DELTAS = """
v AS (SELECT *, id // 8 AS q, (id // 2) % 4 AS p, CASE WHEN fine AND category <> 'unanswerable' THEN recall END AS value FROM o),
pr AS (SELECT q, p, max(CASE WHEN arm = 'arm0' THEN value END) AS x, max(CASE WHEN arm = 'arm1' THEN value END) AS y FROM v GROUP BY 1, 2),
dl AS (SELECT q, count(*) AS pairs, avg(x - y) AS delta FROM pr WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1)"""
BOOTSTRAP = """
k AS (SELECT row_number() OVER (ORDER BY q) AS i, delta AS d FROM dl),
gr AS (SELECT r, j, n FROM range(200) a(r), (SELECT count(*) AS n FROM dl), range(1, n + 1) b(j)),
dr AS (SELECT r, n, ((r * 7919 + j * 104729 + 7) * 48271 % 2147483647) * 48271 % 2147483647 % n + 1 AS i FROM gr),
ms AS (SELECT r, sum(d) / max(n) AS m FROM dr JOIN k USING (i) GROUP BY 1),
ci AS (SELECT (SELECT count(*) FROM dl) AS n, round((SELECT avg(delta) FROM dl), 9) AS mean, round(quantile_disc(m, 0.025), 9) AS ci_low, round(quantile_disc(m, 0.975), 9) AS ci_high FROM ms)"""
FINE_MEAN = "round(avg({0}) FILTER (fine AND {1}), 9) AS mean_{2}, count({0}) FILTER (fine AND {1}) AS {2}_count"

SQL |= {
    "collapse_first_appearance": f"WITH {RESULTS} SELECT qid, arm, artefacts FROM a",
    "arm_scores": f"WITH {RESULTS} SELECT qid, arm, top1, round(rr, 9) AS rr, top1 AS lenient_top1, round(margin, 6) AS margin FROM sc",
    "mrr_by_type": f"WITH {RESULTS} SELECT arm, entity_type, count(top1) AS n, count(error) AS errors, round(avg(top1), 9) AS top1, round(avg(rr), 9) AS mrr FROM sc GROUP BY 1, 2",
    "exploratory_pairs": f"WITH {RESULTS} SELECT x.arm AS x, y.arm AS y, count(*) AS n, round(avg(x.top1 - y.top1), 9) AS difference FROM sc x JOIN sc y ON x.qid = y.qid AND x.arm > y.arm WHERE x.top1 IS NOT NULL AND y.top1 IS NOT NULL GROUP BY 1, 2",
    "determinism_changes": f"WITH {RESULTS} SELECT 'E1' AS arm, count(*) FILTER (x.error IS NULL) AS compared, count(*) FILTER (x.error IS NULL AND x.qid % 3 = 0 AND x.first <> y.first) AS changed, count(*) FILTER (x.error IS NULL AND x.qid % 3 = 0 AND x.first <> y.first) > 3 AS caveat FROM a x JOIN a y ON x.qid = y.qid AND x.arm = 'E1' AND y.arm = 'E2'",
    "gate_grade": f"WITH {RESULTS}, g AS (SELECT *, CASE WHEN qid % 50 = 0 THEN 'missing' ELSE error END AS why FROM sc WHERE arm = 'E1'), f AS (SELECT count(*) AS expected, count(*) FILTER (why IS NULL) AS evaluated, CAST(coalesce(sum(top1) FILTER (why IS NULL), 0) AS BIGINT) AS correct, count(*) FILTER (why = 'missing') AS missing, 0::BIGINT AS skipped, count(*) FILTER (why <> 'missing') AS errors FROM g) SELECT *, evaluated = expected AND errors + missing + skipped = 0 AND correct >= 20 AS passed FROM f",
    "arm_summary": f"""WITH {OUTCOMES} SELECT arm, count(*) AS outcome_count, count(*) FILTER (NOT fine) AS error_count, count(*) FILTER (no_reply) AS no_reply_count, count(*) FILTER (filtered) AS filtered_count,
        {FINE_MEAN.format("recall", "category <> 'unanswerable'", "citation_recall")}, {FINE_MEAN.format("prec", "category <> 'unanswerable'", "citation_precision")}, {FINE_MEAN.format("grounded", "true", "groundedness")}, {FINE_MEAN.format("sat::INT", "must", "must_contain")},
        count(*) FILTER (fine AND grounded IS NULL AND reason) AS judge_failure_count, count(*) FILTER (fine AND category = 'unanswerable' AND handled) AS unanswerable_handled, count(*) FILTER (fine AND category = 'unanswerable') AS unanswerable_total,
        round(quantile_disc(ms, 0.5) FILTER (fine), 9) AS p50_latency_ms, round(quantile_disc(ms, 0.95) FILTER (fine), 9) AS p95_latency_ms, round(avg(cost) FILTER (fine), 9) AS mean_cost_usd_per_query, round(sum(cost), 9) AS total_cost_usd, string_agg(DISTINCT model, ',' ORDER BY model) FILTER (fine AND NOT filtered) AS models_seen FROM o GROUP BY 1""",
    "paired_deltas": f"WITH {OUTCOMES}, {DELTAS} SELECT q AS question, pairs, round(delta, 9) AS delta FROM dl",
    "bootstrap_ci_hash": f"WITH {OUTCOMES}, {DELTAS}, {BOOTSTRAP} SELECT * FROM ci",
    "verdicts": f"WITH {OUTCOMES}, {DELTAS}, {BOOTSTRAP} SELECT t::DOUBLE AS threshold, CASE WHEN abs(mean) >= t AND (ci_low > 0 OR ci_high < 0) THEN 'difference' ELSE 'inconclusive' END AS verdict FROM ci, (VALUES (0.05), (0.10)) v(t)",
}

SCOPE = "CASE m WHEN 'groundedness' THEN true WHEN 'must_contain' THEN {must} ELSE {kind} END"
METRICS = "(VALUES ('citation_recall'), ('citation_precision'), ('groundedness'), ('must_contain')) ms(m)"
CALLS = SQL["call_cost_dated"]

SQL |= {
    "link_neighbours": f"WITH {PULLS}, e AS ({LINKS}) SELECT pull_request AS artefact, commit AS other FROM e UNION SELECT commit, pull_request FROM e",
    "unembedded_page": "SELECT doc_id AS chunk_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) ORDER BY 1 LIMIT 50",
    "dead_letter_chunks": "SELECT event_id AS chunk_id, CAST(event_id % 7 AS INT) AS attempts, lang AS entity_type, ts AS next_attempt_at FROM events JOIN documents ON event_id = doc_id WHERE event_id % 7 < 5 AND ts <= '2024-01-10' ORDER BY ts, event_id LIMIT 100",
    "compare_metrics": f"""WITH {OUTCOMES},
        qs AS (SELECT DISTINCT id // 8 AS q FROM o),
        nk AS (SELECT m, count(*) FILTER ({SCOPE.format(must="q % 4 <> 0", kind="q % 7 <> 0")}) AS nominal_k FROM qs, {METRICS} GROUP BY 1),
        v AS (SELECT m, arm, id // 8 AS q, (id // 2) % 4 AS p, CASE WHEN fine AND {SCOPE.format(must="false", kind="category <> 'unanswerable'")} THEN CASE m WHEN 'citation_recall' THEN recall WHEN 'citation_precision' THEN prec ELSE grounded END END AS value FROM o, {METRICS}),
        pr AS (SELECT m, q, p, max(CASE WHEN arm = 'arm0' THEN value END) AS x, max(CASE WHEN arm = 'arm1' THEN value END) AS y FROM v GROUP BY 1, 2, 3),
        dl AS (SELECT m, q, count(*) AS pairs, avg(x - y) AS d FROM pr WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1, 2),
        k AS (SELECT m, d, row_number() OVER (PARTITION BY m ORDER BY q) AS i FROM dl),
        n AS (SELECT m, count(*) AS n, sum(pairs) AS pairs, avg(d) AS mean FROM dl GROUP BY 1),
        dr AS (SELECT m, r, n, ((r * 7919 + j * 104729 + 7) * 48271 % 2147483647) * 48271 % 2147483647 % n + 1 AS i FROM range(200) a(r), n, range(1, n + 1) b(j)),
        mn AS (SELECT m, r, sum(d) / max(n) AS x FROM dr JOIN k USING (m, i) GROUP BY 1, 2),
        ci AS (SELECT m, quantile_disc(x, 0.025) AS low, quantile_disc(x, 0.975) AS high FROM mn GROUP BY 1)
        SELECT m AS metric, nominal_k, 4 * nominal_k AS nominal_pairs, coalesce(n, 0) AS k, CAST(coalesce(pairs, 0) AS BIGINT) AS pairs, round(mean, 9) AS mean_delta, round(low, 9) AS ci_low, round(high, 9) AS ci_high,
               CASE WHEN n IS NULL THEN 'no data' WHEN abs(mean) >= 0.10 AND (low > 0 OR high < 0) THEN 'difference' ELSE 'inconclusive' END AS verdict
        FROM nk LEFT JOIN n USING (m) LEFT JOIN ci USING (m)""",
    "run_faults": """WITH q AS (SELECT vec_id AS qid FROM embeddings WHERE vec_id % 10 = 0),
        r AS (SELECT 'E1' AS arm, qid FROM q WHERE qid % 60 <> 0 UNION ALL SELECT 'E2', qid FROM q UNION ALL SELECT 'E2', qid FROM q WHERE qid % 90 = 0 UNION ALL SELECT 'E2', -qid FROM q WHERE qid % 200 = 10),
        c AS (SELECT arm, qid, count(*) AS n FROM r GROUP BY 1, 2), w AS (SELECT qid, arm FROM q, (VALUES ('E1'), ('E2')) a(arm))
        SELECT coalesce(w.arm, c.arm) AS arm, coalesce(w.qid, c.qid) AS qid, CASE WHEN w.qid IS NULL THEN 'unknown' WHEN n IS NULL THEN 'missing' ELSE 'repeated' END AS fault FROM w FULL JOIN c ON w.arm = c.arm AND w.qid = c.qid WHERE w.qid IS NULL OR n IS NULL OR n > 1""",
    "worker_faults": """WITH q AS (SELECT vec_id, label, vec_id + CAST(vec_id % 130 = 0 AS INT) AS qid FROM embeddings WHERE vec_id % 10 = 0)
        SELECT 'arm' AS fault, qid FROM q WHERE vec_id % 70 = 0 UNION ALL SELECT 'order', qid FROM q WHERE vec_id % 130 = 0 UNION ALL SELECT 'hit', qid FROM q WHERE vec_id + 1 NOT IN (SELECT vec_id FROM embeddings WHERE label = 0)""",
    "search_vectors": "SELECT vec_id AS qid, CASE WHEN vec_id % 30 <> 0 THEN len(embedding) END AS dim, CASE WHEN vec_id % 30 = 0 THEN 'no query vector' END AS error FROM embeddings WHERE vec_id % 10 = 0",
    "draw_questions": """WITH c AS (SELECT doc_id, n_chars // 4 AS t, CASE lang WHEN 'en' THEN 'commit' WHEN 'de' THEN 'issue' WHEN 'fr' THEN 'release' ELSE 'pull_request' END AS entity_type, 'document:' || doc_id AS artefact FROM documents),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY entity_type ORDER BY md5('5|' || artefact), artefact) AS INT) AS place FROM c WHERE t >= 40 AND NOT (entity_type IN ('commit', 'pull_request') AND doc_id % 9 = 0))
        SELECT entity_type, artefact, place FROM r WHERE place <= CASE entity_type WHEN 'commit' THEN 12 ELSE 5 END""",
    "audit_by_type": """WITH l AS (SELECT doc_id AS qid, doc_id % 3 AS entity_type, CASE WHEN doc_id % 77 = 0 THEN 'odd' WHEN quality = 1 THEN 'fine' ELSE 'not fine' END AS mark, doc_id % 50 <> 0 AS seen FROM labels)
        SELECT entity_type, count(*) AS questions, count(*) FILTER (seen AND qid % 35 <> 0 AND mark = 'fine') AS kept, count(*) FILTER (NOT seen) AS unmarked, count(*) FILTER (seen AND qid % 35 = 0) AS repeated,
               count(*) FILTER (seen AND mark = 'odd') AS invalid, count(*) FILTER (seen AND qid % 20 = 0 AND mark <> 'fine') AS disagreeing FROM l GROUP BY 1""",
    "cost_faults": f"SELECT event_id FROM ({CALLS}) WHERE cost_usd IS NOT NULL AND event_id % 100 = 0",
    "order_overlaps": """WITH i AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 90 AS INT) AS b FROM orders), s AS (SELECT *, max(b) OVER (PARTITION BY o_custkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM i)
        SELECT o_custkey, count(*) AS intervals, count(*) FILTER (a < seen) AS overlapping, count(*) FILTER (b < seen) = 0 AS monotone FROM s GROUP BY 1""",
}


def oracle_sql() -> dict[str, str]:
    return SQL | {"indexed_vector_topk": SQL["batch_vector_topk"]}
