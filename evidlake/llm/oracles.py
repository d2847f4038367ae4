"""DuckDB SQL with the same results as the queries that SQL can express."""

from __future__ import annotations

from . import quality

MIX = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         (CAST('0x' || substr(md5('17|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) + 0.5) / 281474976710656.0 AS u
  FROM documents),
q AS (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id),
k AS (SELECT d.doc_id, d.source, d.size, -ln(d.u) / (CASE q.q WHEN 1 THEN 2.0 WHEN 0 THEN 0.5 ELSE 1.0 END)::DOUBLE AS key
      FROM d LEFT JOIN q ON d.doc_id = q.doc_id),
s AS (SELECT source, CAST(sum(size) AS HUGEINT) AS source_size FROM k GROUP BY source),
r AS (SELECT source, source_size, 3 * source_size AS cap,
             CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS HUGEINT) AS w FROM s),
l AS (SELECT *, sum(source_size) OVER () AS total,
             coalesce(sum(cap) OVER (ORDER BY cap / w::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent,
             sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_left
      FROM r),
c AS (SELECT *, min(CAST(cap * w_left <= w * (total - spent) AS INT)) OVER (ORDER BY cap / w::DOUBLE, source NULLS LAST ROWS UNBOUNDED PRECEDING) = 1 AS capped FROM l),
t AS (SELECT source, source_size,
             CASE WHEN capped THEN cap::DOUBLE
                  ELSE (w * (total - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ()))::DOUBLE / sum(CASE WHEN capped THEN 0 ELSE w END) OVER () END AS target
      FROM c),
e AS (SELECT k.*, CAST(t.source_size AS BIGINT) AS source_size, t.target,
             CASE WHEN t.source_size > 0 THEN least(3, CAST(floor(t.target / t.source_size) AS BIGINT)) ELSE 0 END AS epochs,
             coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source),
f AS (SELECT *, CASE WHEN size > 0 THEN epochs + CASE WHEN epochs < 3 AND 2 * before + size <= 2 * (target - epochs * source_size) THEN 1 ELSE 0 END ELSE 0 END AS copies FROM e)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken, source, CAST(copies AS BIGINT) AS copies FROM f
"""

DECONTAMINATE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)),
n AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n.n, unnest(range(1, len(w) - n.n + 2)) AS i FROM d, n WHERE len(w) >= n.n)),
h AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
p AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(p.n_hit, 0) AS n_hit, coalesce(m.n_items, 0) AS n_items,
       sha256(coalesce(m.items, '')) AS items_sha256,
       coalesce(p.n_hit, 0) > 0 AND 20 * coalesce(p.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN m USING (doc_id)
"""


ARCHIVES = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n FROM pages),
t AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, n AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to
FROM t
"""


SUBSTRINGS = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
r AS (SELECT g FROM x GROUP BY g HAVING count(*) > 1),
h AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM x SEMI JOIN r USING (g)),
n AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (p - 1 <> before) AS n_spans FROM (SELECT doc_id, p, lag(p, 1, -1) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM h) GROUP BY doc_id),
u AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM u ANTI JOIN h USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256, CAST(coalesce(n_spans, 0) AS INT) AS n_spans
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)
"""


JACCARD = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE c >= 0.8::DOUBLE * (nx.n + ny.n - c) - 1e-9),
o AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, o.y FROM r JOIN o ON r.b = o.x)
SELECT d.doc_id, (SELECT min(b) FROM r WHERE a = d.doc_id) AS class_id, (SELECT count(*) FROM o WHERE x = d.doc_id) AS n_links, coalesce(n.n, 0) AS n_shingles
FROM d LEFT JOIN n USING (doc_id)
"""


def quality_sql() -> str:
    """The rules' counts, their cutoffs by exact binomial tails, and the verdicts."""
    risk = f"{quality.ALPHA}::DOUBLE"
    score = ["n_symbols / greatest(n_words, 1)", "n_dup_lines / greatest(n_lines, 1)", "n_repeat_words / greatest(n_words, 1)", "n_capitals / greatest(word_chars, 1)", "n_stutters / greatest(n_words, 1)"]
    passed = ", ".join("(" + " + ".join(f"CAST({of} <= {cut}::DOUBLE AS INT)" for cut in cuts) + f") AS t{i}" for i, (of, cuts) in enumerate(zip(score, quality.RULES.values(), strict=True)))
    declared = [(p, step, share, s) for p, (path, share) in enumerate(zip(quality.PATHS, quality.SHARES, strict=True)) for step, s in enumerate(path)]
    sets = ", ".join(f"({idx}, {p}, {step}, {share * quality.DELTA}::DOUBLE, {', '.join(map(str, s))})" for idx, (p, step, share, s) in enumerate(declared))
    rejects = " OR ".join(f"s{i} > t{i}" for i in range(len(score)))
    least = ", ".join(f"min(t{i}) AS t{i}" for i in range(len(score)))
    said = ", ".join(f"CASE WHEN s{i} > t{i} THEN '{rule}' END" for i, rule in enumerate(quality.RULES))
    return rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
g AS (SELECT doc_id, g FROM x GROUP BY ALL HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM x SEMI JOIN g USING (doc_id, g)) GROUP BY doc_id),
l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda z: regexp_matches(z, '[^\x20\x09-\x0D]')) AS ls FROM d),
c AS (SELECT l.doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda z: length(z))), 0) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
             CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, len(regexp_extract_all(t, '[A-Z]')) AS n_capitals,
             len(list_filter(list_zip(w[2:], w[:-2]), lambda z: z[1] = z[2])) AS n_stutters
      FROM l LEFT JOIN rep USING (doc_id)),
b AS MATERIALIZED (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, {passed} FROM c),
sets AS (SELECT * FROM (VALUES {sets}) v(idx, path, step, share, s0, s1, s2, s3, s4)),
good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING max(quality) = 1),
held AS (SELECT lang, doc_id, {least} FROM b SEMI JOIN good USING (doc_id) WHERE NOT base_failed GROUP BY lang, doc_id),
strata AS (SELECT greatest(1, count(*)) AS m FROM (SELECT DISTINCT lang FROM held)),
lost AS (SELECT lang, idx, path, step, share, count(*) AS n, count(*) FILTER ({rejects}) AS x FROM held, sets GROUP BY ALL),
tail AS (SELECT *, CASE WHEN x >= n THEN 1.0 ELSE list_sum(list_transform(range(0, x + 1), lambda k: exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln({risk}) + (n - k) * ln(1 - {risk})))) END AS p FROM lost),
safe AS (SELECT *, min(CAST(p <= share / (SELECT m FROM strata) AS INT)) OVER (PARTITION BY lang, path ORDER BY step) AS ok FROM tail),
gone AS (SELECT lang, idx, count(*) FILTER ({rejects}) AS gone FROM b, sets WHERE NOT base_failed GROUP BY ALL),
best AS (SELECT safe.lang, arg_max(safe.idx, (gone, -safe.idx)) AS idx FROM safe JOIN gone ON safe.lang IS NOT DISTINCT FROM gone.lang AND safe.idx = gone.idx WHERE ok = 1 GROUP BY safe.lang),
used AS (SELECT best.lang, sets.* FROM best JOIN sets USING (idx))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND (used.idx IS NULL OR NOT ({rejects})) AS kept,
       coalesce(array_to_string(list_filter([{said}], lambda z: z IS NOT NULL), ','), '') AS rejected_by
FROM b LEFT JOIN used ON b.lang IS NOT DISTINCT FROM used.lang
"""


#: All candidates: the walk meets every cell of a table of up to LEAST_EFFORT rows.
NEIGHBOURS = """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, e.vec_id, sqrt(list_sum(list_transform(list_zip(q.v, e.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS score FROM e q JOIN e ON q.vec_id <> e.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INT) AS rank, vec_id, score FROM p)
SELECT * FROM r WHERE rank <= 10
"""


def codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    nearest = """
        SELECT p.rid, p.part, min(CAST(list_dot_product(p.v, p.v) - 2 * list_dot_product(p.v, b.v) + list_dot_product(b.v, b.v) AS BIGINT) * 256 + b.entry) AS k
        FROM p JOIN b{n} b ON p.part = b.part GROUP BY p.rid, p.part"""
    moved = """
        SELECT part, entry, coalesce(m.v, b{n}.v) AS v FROM b{n} LEFT JOIN (
            SELECT part, entry, list(floored ORDER BY place) AS v FROM (
                SELECT part, entry, place, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS DOUBLE) AS floored FROM (
                    SELECT p.part, a{n}.k % 256 AS entry, unnest(range(len(p.v))) AS place, CAST(unnest(p.v) AS BIGINT) AS x FROM p JOIN a{n} USING (rid, part))
                GROUP BY part, entry, place)
            GROUP BY part, entry) m USING (part, entry)"""
    steps = ",\n".join(f"a{n} AS MATERIALIZED ({nearest.format(n=n)}),\nb{n + 1} AS MATERIALIZED ({moved.format(n=n)})" for n in range(rounds))
    return f"""
WITH e AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS rid, vec_id, label, list_transform(embedding, lambda c: floor(1024 * c::DOUBLE)) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
p AS MATERIALIZED (SELECT rid, part, list_slice(x, part * len(x) // {parts} + 1, (part + 1) * len(x) // {parts}) AS v FROM e, (SELECT unnest(range({parts})) AS part)),
b0 AS MATERIALIZED (SELECT part, rid - 1 AS entry, v FROM p WHERE rid <= {entries}),
{steps},
f AS ({nearest.format(n=rounds)}),
c AS (SELECT rid, lower(string_agg(printf('%02x', CAST(k % 256 AS INT)), '' ORDER BY part)) AS code, CAST(sum(k // 256) AS BIGINT) AS error FROM f GROUP BY rid)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, label,
       (SELECT sha256(string_agg(array_to_string(list_transform(v, lambda z: CAST(z AS BIGINT)), ','), ',' ORDER BY part, entry)) FROM b{rounds}) AS codebooks_sha256
FROM c JOIN e USING (rid)
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_source_mix": MIX, "op5_decontaminate": DECONTAMINATE, "op6_page_archives": ARCHIVES, "op7_substring_dedup": SUBSTRINGS, "op9_quality_rules": quality_sql(), "op11_vector_codes": codes_sql(), "op13_nearest_neighbours": NEIGHBOURS, "op10_jaccard_join": JACCARD}
