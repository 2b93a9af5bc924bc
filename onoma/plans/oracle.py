"""DuckDB oracles for the registered queries (run by the driver at sf0.01).

Nothing is capped here. Distinct request keys meet distinct name keys; bounds
that no answer can fail are applied before the character-level steps.
Constants are written out, not imported from the code under test.
"""

from __future__ import annotations

import sys
import unicodedata

from onoma.plans.oracle_sql import SPACE, TITLES, grams, lcs, norm, pyround, segments_sql, tokens


def accented() -> str:
    """Characters that hold a combining mark or fold to an ASCII letter without being one."""
    out = []
    for cp in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= cp <= 0xDFFF:
            continue
        ch = chr(cp)
        parts = unicodedata.normalize("NFKD", ch.lower())
        plain = [c for c in parts if not unicodedata.combining(c)]
        if not plain or plain != [ch] and any("a" <= c.lower() <= "z" for c in plain):
            out.append(ch)
    return "".join(out)


DOC_SEG = segments_sql("documents", "doc_id", "text")
BENCH_SEG = segments_sql("benchmark", "item_id", "text", "request_id", "name")
DOC_NAMES = f"SELECT id, full_name, {norm('full_name')} AS k FROM ({DOC_SEG})"
PART_NAMES = f"SELECT CAST(p_partkey AS BIGINT) AS id, p_name AS full_name, {norm('p_name')} AS k FROM part WHERE p_name IS NOT NULL"
CUSTOMER_NAMES = f"SELECT CAST(c_custkey AS BIGINT) AS id, c_name AS full_name, {norm('c_name')} AS k FROM customer WHERE c_name IS NOT NULL"

DEFAULT_REQ = (
    f"SELECT request_id, name, CAST(70.0 AS DOUBLE) AS threshold, 10 AS lim, CAST(0.65 AS DOUBLE) AS w_token, "
    f"false AS explain FROM ({BENCH_SEG})"
)
EXPLAIN_REQ = DEFAULT_REQ.replace("false AS explain", "true AS explain")
PARAM_REQ = (
    "SELECT request_id, name, CAST(40.0 AS DOUBLE) + CAST(10.0 AS DOUBLE) * ((request_id % 268435456) % 4) AS threshold, "
    "CAST(1 + (request_id % 268435456) % 7 AS INTEGER) AS lim, "
    "CAST((request_id % 268435456) % 11 AS DOUBLE) / CAST(10.0 AS DOUBLE) AS w_token, "
    f"((request_id % 268435456) % 2 = 0) AS explain FROM ({BENCH_SEG})"
)


def _dedupe_sql(names: str) -> str:
    return (
        f"SELECT min(id) AS id, arg_min(full_name, id) AS full_name, k AS normalized_name, count(*) AS member_count "
        f"FROM ({names}) WHERE length(k) > 0 GROUP BY k"
    )


def _members_sql(names: str) -> str:
    return (
        f"WITH n AS ({names}) SELECT r.rep_id, n.id AS member_id FROM n JOIN "
        f"(SELECT k, min(id) AS rep_id FROM n WHERE length(k) > 0 GROUP BY k) r USING (k) WHERE length(n.k) > 0"
    )


D = "CAST({} AS DOUBLE)"


def _token(lcs_xy: str) -> str:
    """Token-set ratio from the lengths ``x``, ``y``, ``sect``, ``g`` and an LCS (or an upper bound of it)."""
    ratio = lambda dist, total: (
        f"CASE WHEN {total} = 0 THEN {D.format('100.0')} ELSE {D.format('100.0')} - {D.format('100.0')} * CAST({dist} AS DOUBLE) / CAST({total} AS DOUBLE) END"
    )
    return (
        f"CASE WHEN len(tq) = 0 OR len(tk) = 0 THEN {D.format('0.0')} "
        f"WHEN shared > 0 AND (x = 0 OR y = 0) THEN {D.format('100.0')} "
        f"WHEN sect = 0 THEN {ratio(f'x + y - 2 * {lcs_xy}', 'x + y')} "
        f"ELSE greatest({ratio(f'x + y - 2 * {lcs_xy}', '2 * (sect + g) + x + y')}, "
        f"{ratio('g + x', '2 * sect + g + x')}, {ratio('g + y', '2 * sect + g + y')}) END"
    )


def _scored_ctes(names: str, requests: str) -> str:
    """CTEs ending in ``ranked``: the match pipeline in SQL, uncapped.

    Levenshtein distance never exceeds the InDel distance (a substitution is
    one edit there and two here), so it bounds both scores from above.
    """
    edit = lambda common: (
        f"CASE WHEN lq + lk = 0 THEN {D.format('100.0')} ELSE ({D.format('1.0')} - CAST(lq + lk - 2 * {common} AS DOUBLE) / CAST(lq + lk AS DOUBLE)) * {D.format('100.0')} END"
    )
    sim = lambda tok, ed: f"w_token * ({tok}) + ({D.format('1.0')} - w_token) * ({ed})"
    near = f"threshold - {D.format('1e-9')}"
    return f"""
names AS MATERIALIZED ({names}),
req AS MATERIALIZED (SELECT request_id, name, threshold, lim, w_token, explain, {norm('name')} AS q FROM ({requests})),
kk AS MATERIALIZED (SELECT k, count(*) AS members, {tokens('k')} AS tk, length(k) AS lk FROM names WHERE k IS NOT NULL GROUP BY k),
qq AS MATERIALIZED (SELECT q, {tokens('q')} AS tq, length(q) AS lq FROM (SELECT DISTINCT q FROM req)),
kg AS (SELECT k, unnest(list_distinct({grams('k')})) AS gram FROM kk),
qg AS (SELECT q, unnest(list_distinct({grams('q')})) AS gram FROM qq),
cand AS MATERIALIZED (SELECT DISTINCT q, k FROM qg JOIN kg USING (gram)),
qcount AS (SELECT q, CAST(sum(members) AS BIGINT) AS candidate_count FROM cand JOIN kk USING (k) GROUP BY q),
counts AS MATERIALIZED (SELECT request_id, candidate_count FROM req JOIN qcount USING (q)),
meet AS (SELECT q, k FROM cand UNION ALL
         SELECT q, k FROM qq, kk WHERE q NOT IN (SELECT q FROM qcount)),
ask AS (SELECT DISTINCT q, threshold, w_token FROM req),
p1 AS (SELECT q, k, threshold, w_token, tq, tk, lq, lk, list_intersect(tq, tk) AS inter
       FROM meet JOIN qq USING (q) JOIN kk USING (k) JOIN ask USING (q)),
p2 AS (SELECT *, len(inter) AS shared, length(array_to_string(inter, ' ')) AS sect, CASE WHEN len(inter) > 0 THEN 1 ELSE 0 END AS g,
              length(array_to_string(tq, ' ')) - length(array_to_string(inter, ' ')) - CASE WHEN len(inter) > 0 AND len(inter) < len(tq) THEN 1 ELSE 0 END AS x,
              length(array_to_string(tk, ' ')) - length(array_to_string(inter, ' ')) - CASE WHEN len(inter) > 0 AND len(inter) < len(tk) THEN 1 ELSE 0 END AS y
       FROM p1),
p3 AS (SELECT * FROM (SELECT *, {_token('least(x, y)')} AS tok_most FROM p2) WHERE {sim('tok_most', edit('least(lq, lk)'))} >= {near}),
p3b AS (SELECT * FROM (SELECT *, {edit('(lq + lk - levenshtein(q, k)) / 2.0')} AS edit_most FROM p3) WHERE {sim('tok_most', 'edit_most')} >= {near}),
p3c AS (SELECT *, array_to_string(list_filter(tq, lambda t: NOT list_contains(tk, t)), ' ') AS sx,
               array_to_string(list_filter(tk, lambda t: NOT list_contains(tq, t)), ' ') AS sy FROM p3b),
p3d AS MATERIALIZED (SELECT * FROM (SELECT *, {_token('(x + y - levenshtein(sx, sy)) / 2.0')} AS tok_near FROM p3c) WHERE {sim('tok_near', 'edit_most')} >= {near}),
p4 AS MATERIALIZED (SELECT *, {edit('common')} AS edit FROM (SELECT *, {lcs('q', 'k')} AS common FROM p3d)),
p6 AS MATERIALIZED (SELECT *, CASE WHEN len(tq) > 0 AND len(tk) > 0 AND x > 0 AND y > 0 THEN {lcs('sx', 'sy')} ELSE 0 END AS lcs_t
       FROM p4 WHERE {sim('tok_near', 'edit')} >= {near}),
p7 AS (SELECT q, k, threshold, w_token, edit, {_token('lcs_t')} AS tok FROM p6),
p8 AS (SELECT *, {sim('tok', 'edit')} AS sim FROM p7),
ranked AS (SELECT r.request_id, n.id, n.full_name, r.lim, r.explain, r.w_token, tok, edit, sim,
                  row_number() OVER (PARTITION BY r.request_id ORDER BY sim DESC, tok DESC, edit DESC, n.id ASC) AS rnk
           FROM p8 JOIN req r USING (q, threshold, w_token) JOIN names n USING (k) WHERE sim >= threshold)
"""


def _hits_sql(names: str, requests: str) -> str:
    return f"""WITH {_scored_ctes(names, requests)}
SELECT request_id, CAST(rnk AS INTEGER) AS rank, id, full_name AS name, {pyround('sim', 2)} AS similarity,
       CASE WHEN explain THEN {pyround('tok', 2)} END AS token_score,
       CASE WHEN explain THEN {pyround('edit', 2)} END AS edit_score,
       CASE WHEN explain THEN {pyround('w_token', 3)} END AS w_token
FROM ranked WHERE rnk <= lim"""


def _ties_sql(names: str, requests: str) -> str:
    return (
        f"SELECT request_id, tie_groups, by_token, by_edit, by_id FROM ({_summary_sql(names, requests)}) WHERE tie_groups > 0"
    )


def _events_log() -> str:
    return (
        "WITH lg AS (SELECT event_id AS seq, lower(event_type) || ' ' || CAST(user_id AS VARCHAR) AS query_norm, "
        "CAST(value AS DOUBLE) AS latency_ms, CAST(user_id AS BIGINT) AS candidate_count FROM events), "
        "lg2 AS (SELECT lg.*, seq > min(seq) OVER (PARTITION BY query_norm) AS is_repeat FROM lg), "
        "srch AS (SELECT * FROM lg2 WHERE NOT is_repeat ORDER BY seq DESC LIMIT 5000)"
    )


def _p95(col: str) -> str:
    return (
        f"coalesce((SELECT v FROM (SELECT {col} AS v, row_number() OVER (ORDER BY {col} ASC NULLS FIRST) AS rn, "
        f"count(*) OVER () AS n FROM srch) WHERE rn = floor(CAST(0.95 AS DOUBLE) * CAST(n - 1 AS DOUBLE)) + 1), CAST(0.0 AS DOUBLE))"
    )


def _profile_sql() -> str:
    ws = SPACE
    titles = "|".join(t.replace("i", "[iı]") for t in TITLES)
    acc = accented().replace("'", "''")
    folded = f"strip_accents(lower(regexp_replace(full_name, '^{ws}+|{ws}+$', '', 'g')))"
    flags = (
        f"SELECT length(translate(full_name, '{acc}', '')) < length(full_name) AS accent, "
        f"regexp_matches({folded}, '(?i)^(?:{titles})\\.?{ws}+') AS title, "
        f"regexp_matches({folded}, '[^a-zA-Z{ws[1:-1]}]') AS symbol, "
        f"regexp_matches(full_name, '^{ws}|{ws}$|{ws}{{2}}') AS space, {norm('full_name')} AS key FROM ({DOC_SEG})"
    )
    share = lambda c: pyround(f"CASE WHEN rows = 0 THEN CAST(0.0 AS DOUBLE) ELSE CAST({c} AS DOUBLE) / CAST(rows AS DOUBLE) END", 4)
    return (
        f"WITH f AS ({flags}), c AS (SELECT count(*) AS rows, count(*) FILTER (WHERE accent) AS with_accents, "
        "count(*) FILTER (WHERE title) AS with_titles, count(*) FILTER (WHERE symbol) AS with_symbols, "
        "count(*) FILTER (WHERE space) AS with_extra_spaces, count(*) FILTER (WHERE key = '') AS empty_keys, "
        "count(DISTINCT CASE WHEN key <> '' THEN key END) AS distinct_keys FROM f), "
        "d AS (SELECT *, rows - empty_keys - distinct_keys AS duplicate_rows FROM c) "
        f"SELECT *, {share('with_accents')} AS with_accents_share, {share('with_titles')} AS with_titles_share, "
        f"{share('with_symbols')} AS with_symbols_share, {share('with_extra_spaces')} AS with_extra_spaces_share, "
        f"{share('duplicate_rows')} AS duplicate_rows_share FROM d"
    )


def _summary_sql(names: str, requests: str) -> str:
    """Per request: q, candidate_count (all records on fallback), hits and tie counters."""
    return f"""WITH {_scored_ctes(names, requests)},
disp AS (SELECT request_id, {pyround('sim', 2)} AS s2, {pyround('tok', 2)} AS t2, {pyround('edit', 2)} AS e2
         FROM ranked WHERE rnk <= lim),
grp AS (SELECT request_id, s2, count(DISTINCT t2) AS nt, count(DISTINCT e2) AS ne FROM disp GROUP BY request_id, s2 HAVING count(*) > 1),
ties AS (SELECT request_id, count(*) AS tie_groups, count(*) FILTER (WHERE nt > 1) AS by_token,
         count(*) FILTER (WHERE nt <= 1 AND ne > 1) AS by_edit, count(*) FILTER (WHERE nt <= 1 AND ne <= 1) AS by_id FROM grp GROUP BY request_id),
nh AS (SELECT request_id, count(*) AS n_hits, max(s2) AS top_similarity FROM disp GROUP BY request_id)
SELECT r.request_id, r.q, r.threshold, r.lim, r.w_token, r.explain, c.candidate_count IS NULL AS fallback, nh.top_similarity, coalesce(t.tie_groups, 0) AS ties,
       coalesce(c.candidate_count, (SELECT count(*) FROM names)) AS candidate_count, coalesce(nh.n_hits, 0) AS n_hits,
       coalesce(t.tie_groups, 0) AS tie_groups, coalesce(t.by_token, 0) AS by_token, coalesce(t.by_edit, 0) AS by_edit, coalesce(t.by_id, 0) AS by_id
FROM req r LEFT JOIN counts c USING (request_id) LEFT JOIN nh USING (request_id) LEFT JOIN ties t USING (request_id)"""


def _match_log_ties_sql() -> str:
    share = lambda c: pyround(f"CASE WHEN g = 0 THEN CAST(0.0 AS DOUBLE) ELSE CAST({c} AS DOUBLE) / CAST(g AS DOUBLE) END", 4)
    return (
        f"WITH s AS ({_summary_sql(DOC_NAMES, DEFAULT_REQ)}), "
        "m AS (SELECT s.*, request_id > min(request_id) OVER (PARTITION BY q, threshold, lim, w_token, explain) AS is_repeat FROM s), "
        "t AS (SELECT coalesce(sum(tie_groups), 0) AS g, coalesce(sum(by_token), 0) AS bt, coalesce(sum(by_edit), 0) AS be, "
        "coalesce(sum(by_id), 0) AS bi FROM m WHERE NOT is_repeat) "
        f"SELECT CAST(g AS BIGINT) AS tie_groups_total, {share('bt')} AS resolved_by_token_pct, {share('be')} AS resolved_by_edit_pct, "
        f"{share('bi')} AS resolved_by_id_pct FROM t"
    )


def _mode_comparison_sql() -> str:
    words = f"array_to_string({tokens('k')}, ' ')"
    curated = f"SELECT id, full_name, CASE WHEN id % 4 = 0 OR {words} = '' THEN k ELSE {words} END AS k FROM ({DOC_NAMES})"
    dedup = f"SELECT id, full_name, normalized_name AS k FROM ({_dedupe_sql(curated)})"
    parts = []
    for mode, names in (("original", DOC_NAMES), ("standardized", curated), ("standardized+dedupe", dedup)):
        parts.append(
            f"SELECT '{mode}' AS mode, count(*) AS requests, CAST(sum(candidate_count) AS BIGINT) AS candidates, CAST(sum(n_hits) AS BIGINT) AS hits, "
            "count(*) FILTER (WHERE n_hits > 0) AS answered, count(*) FILTER (WHERE top_similarity = 100.0) AS exact_first "
            f"FROM ({_summary_sql(names, DEFAULT_REQ)})"
        )
    return " UNION ALL ".join(parts)


EVENT_REASON = (
    "CASE WHEN event_type IS NULL THEN 'name is required' "
    "WHEN coalesce(value, 70.0) < 0 OR coalesce(value, 70.0) > 100 OR isnan(coalesce(value, 70.0)) THEN 'threshold must be between 0 and 100' "
    "WHEN coalesce(CAST(user_id AS INTEGER), 10) < 1 OR coalesce(CAST(user_id AS INTEGER), 10) > 100 THEN 'limit must be between 1 and 100' "
    "WHEN coalesce(value / CAST(100.0 AS DOUBLE), 0.65) < 0 OR coalesce(value / CAST(100.0 AS DOUBLE), 0.65) > 1 THEN 'w_token must be between 0 and 1' END"
)


def _match_validated_sql() -> str:
    ok = (
        "SELECT event_id AS request_id, event_type AS name, coalesce(value, 70.0) AS threshold, coalesce(CAST(user_id AS INTEGER), 10) AS lim, "
        f"coalesce(value / CAST(100.0 AS DOUBLE), 0.65) AS w_token, false AS explain FROM events WHERE ({EVENT_REASON}) IS NULL"
    )
    return (
        f"SELECT request_id, CAST(candidate_count AS BIGINT) AS candidate_count, CAST(n_hits AS BIGINT) AS n_hits, CAST(NULL AS VARCHAR) AS reason FROM ({_summary_sql(PART_NAMES, ok)}) UNION ALL "
        f"SELECT event_id, 0, 0, {EVENT_REASON} FROM events WHERE ({EVENT_REASON}) IS NOT NULL"
    )


def _payload_sql() -> str:
    pos = "(request_id % 268435456)"
    reqs = DEFAULT_REQ.replace("false AS explain", f"({pos} % 2 = 0) AS explain")
    return f"SELECT request_id, rank AS pos, id, name, similarity, token_score, edit_score, w_token, {pos} % 3 <> 0 AS in_map FROM ({_hits_sql(DOC_NAMES, reqs)})"


def _pair_scores_sql() -> str:
    base = (
        f"SELECT CAST(p_partkey AS BIGINT) AS id, {norm('p_name')} AS k, "
        f"{norm(chr(39) + 'ring ' + chr(39) + ' || p_type || ' + chr(39) + ' ' + chr(39) + ' || p_brand')} AS q FROM part"
    )
    return f"""WITH b AS ({base}),
s AS (SELECT *, {tokens('q')} AS tq, {tokens('k')} AS tk FROM b),
t AS (SELECT *, list_intersect(tq, tk) AS inter, array_to_string(list_filter(tq, lambda t: NOT list_contains(tk, t)), ' ') AS sx,
             array_to_string(list_filter(tk, lambda t: NOT list_contains(tq, t)), ' ') AS sy FROM s),
u AS (SELECT *, len(inter) AS shared, length(array_to_string(inter, ' ')) AS sect, CASE WHEN len(inter) > 0 THEN 1 ELSE 0 END AS g,
             length(sx) AS x, length(sy) AS y, {lcs('sx', 'sy')} AS lcs_t, {lcs('q', 'k')} AS common FROM t),
v AS (SELECT id, q, {_token('lcs_t')} AS tok,
             (CAST(1.0 AS DOUBLE) - CAST(length(q) + length(k) - 2 * common AS DOUBLE) / CAST(length(q) + length(k) AS DOUBLE)) * CAST(100.0 AS DOUBLE) AS ed FROM u)
SELECT id, q AS q_norm, {pyround('tok', 2)} AS token, {pyround('ed', 2)} AS edit,
       {pyround('(CAST(0.65 AS DOUBLE) * tok + (CAST(1.0 AS DOUBLE) - CAST(0.65 AS DOUBLE)) * ed)', 2)} AS similarity FROM v"""


def _loader_sql(q: dict[str, str]) -> None:
    name = "'Dr. ' || s_name"
    strict = f"SELECT CAST(s_suppkey AS BIGINT) AS id, {name} AS full_name, {{}} AS normalized_name FROM supplier"
    q["load_strict"] = strict.format(norm(name))
    q["load_strict_key"] = strict.format(f"CASE WHEN s_suppkey % 5 = 0 THEN {norm(name)} ELSE 'KEY ' || CAST(s_suppkey AS VARCHAR) END")
    q["load_lenient"] = (
        f"SELECT id, full_name, k AS normalized_name FROM (SELECT *, {norm('full_name')} AS k FROM ("
        "SELECT CAST(c_custkey AS BIGINT) AS id, CASE WHEN c_custkey % 13 = 0 THEN '#12' ELSE c_mktsegment || ' ' || c_name END AS full_name "
        "FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 11 <> 0)) WHERE k <> ''"
    )
    q["load_quoted"] = (
        "SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(length(t) AS BIGINT) AS n_chars, "
        "CAST(length(t) - length(replace(t, chr(10), '')) AS BIGINT) AS n_breaks, sha256(t) AS text_sha256 "
        "FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)"
    )
    q["lenient_report"] = (
        "SELECT 'original' AS dataset_mode, count(*) AS source_rows, count(*) FILTER (WHERE kept) AS kept_rows, "
        "count(*) FILTER (WHERE NOT has_id) AS no_id, count(*) FILTER (WHERE has_id AND NOT has_name) AS no_name, "
        "count(*) FILTER (WHERE has_id AND has_name AND NOT kept) AS no_key, "
        "CASE WHEN count(*) = 0 THEN 1.0::DOUBLE ELSE (count(*) FILTER (WHERE kept))::DOUBLE / count(*)::DOUBLE END AS kept_ratio FROM ("
        "SELECT c_custkey % 7 <> 0 AS has_id, c_custkey % 11 <> 0 AS has_name, "
        "c_custkey % 7 <> 0 AND c_custkey % 11 <> 0 AND c_custkey % 13 <> 0 AS kept FROM customer)"
    )
    n = "(SELECT count(*) FROM part WHERE p_name IS NOT NULL)"
    q["store_reload"] = (
        f"SELECT 'first' AS step, CAST({n} AS BIGINT) AS loaded_rows, {n} AS records UNION ALL "
        f"SELECT 'again', CAST(-1 AS BIGINT), {n} UNION ALL SELECT 'forced', CAST({n} AS BIGINT), {n}"
    )
    title = "['Dr.', 'Ing', 'prof.', 'x', chr(160) || 'Lic.', 'SRTA'][pos % 6 + 1]"
    q["normalize_untrimmed"] = (
        f"SELECT doc_id, CAST(pos AS INTEGER) AS pos, {norm('nm')} AS normalized_name FROM ("
        f"SELECT doc_id, pos, {title} || ' ' || seg || chr(9) AS nm FROM ("
        "SELECT doc_id, unnest(parts) AS seg, unnest(range(len(parts))) AS pos FROM ("
        "SELECT doc_id, regexp_split_to_array(text, '[.!?;:,|\\n]+') AS parts FROM documents)))"
    )


def ORACLES() -> dict[str, str]:  # noqa: N802
    q: dict[str, str] = {}
    q["normalize_documents"] = f"SELECT id, full_name, k AS normalized_name FROM ({DOC_NAMES})"
    q["normalize_parts"] = f"SELECT id, full_name, k AS normalized_name FROM ({PART_NAMES})"
    q["gram_frequency"] = (
        f"SELECT gram, count(*) AS n_ids FROM (SELECT id, unnest(list_distinct({grams('k')})) AS gram FROM ({DOC_NAMES})) GROUP BY gram"
    )
    q["gram_index"] = (
        f"SELECT id, unnest(list_distinct({grams('k')})) AS gram FROM ({DOC_NAMES})"
    )
    q["dedupe_documents"] = _dedupe_sql(DOC_NAMES)
    q["dedupe_members"] = _members_sql(DOC_NAMES)
    q["dedupe_arriving"] = _dedupe_sql(DOC_NAMES)
    q["dedupe_arriving_members"] = _members_sql(DOC_NAMES)
    q["dedupe_report"] = (
        f"SELECT 'standardized+dedupe' AS dataset_mode, s.n AS sot_rows, d.n AS search_rows, d.n AS dedupe_groups, "
        f"CASE WHEN s.n = 0 THEN CAST(1.0 AS DOUBLE) ELSE CAST(d.n AS DOUBLE) / CAST(s.n AS DOUBLE) END AS dedupe_ratio "
        f"FROM (SELECT count(*) AS n FROM ({DOC_SEG})) s, (SELECT count(*) AS n FROM ({_dedupe_sql(DOC_NAMES)})) d"
    )
    q["dedupe_customers"] = _dedupe_sql(CUSTOMER_NAMES)
    q["dedupe_customer_members"] = _members_sql(CUSTOMER_NAMES)
    q["candidates"] = f"WITH {_scored_ctes(PART_NAMES, DEFAULT_REQ)} SELECT r.request_id, n.id FROM cand JOIN req r USING (q) JOIN names n USING (k)"
    q["candidate_counts"] = (
        f"WITH {_scored_ctes(DOC_NAMES, DEFAULT_REQ)} SELECT r.request_id, r.q AS q_norm, c.candidate_count IS NULL AS fallback, "
        f"coalesce(c.candidate_count, (SELECT count(*) FROM names)) AS candidate_count FROM req r LEFT JOIN counts c USING (request_id)"
    )
    nations = "SELECT CAST(n_nationkey AS BIGINT) AS request_id, n_name AS name, CAST(30.0 AS DOUBLE) AS threshold, 10 AS lim, CAST(0.65 AS DOUBLE) AS w_token, false AS explain FROM nation"
    q["fallback"] = _hits_sql(PART_NAMES, nations)
    q["match_topk"] = _hits_sql(DOC_NAMES, DEFAULT_REQ)
    q["match_indexed"] = q["match_topk"]
    q["match_explain"] = _hits_sql(DOC_NAMES, EXPLAIN_REQ)
    q["match_params"] = _hits_sql(DOC_NAMES, PARAM_REQ)
    q["match_dedupe"] = _hits_sql(
        f"SELECT id, full_name, normalized_name AS k FROM ({_dedupe_sql(DOC_NAMES)})", DEFAULT_REQ
    )
    part_req = "SELECT CAST(p_partkey AS BIGINT) AS request_id, p_name AS name, CAST(70.0 AS DOUBLE) AS threshold, 10 AS lim, CAST(0.65 AS DOUBLE) AS w_token, false AS explain FROM part WHERE p_name IS NOT NULL"
    q["match_parts"] = _hits_sql(PART_NAMES, part_req)
    q["tie_stats"] = _ties_sql(DOC_NAMES, DEFAULT_REQ)
    q["request_validation"] = f"SELECT event_id AS request_id, {EVENT_REASON} AS reason FROM events"
    q["match_validated"] = _match_validated_sql()
    q["match_payload"] = _payload_sql()
    q["pair_scores"] = _pair_scores_sql()
    _loader_sql(q)
    q["distinct_requests"] = (
        f"WITH r AS (SELECT CAST(p_partkey AS BIGINT) AS request_id, {norm('p_name')} AS q FROM part WHERE p_name IS NOT NULL) "
        "SELECT m.rep AS rep_request_id, r.request_id FROM r JOIN (SELECT q, min(request_id) AS rep FROM r GROUP BY q) m USING (q)"
    )
    ev = _events_log()
    q["log_totals"] = (
        f"{ev} SELECT count(*) AS total_requests, count(*) FILTER (WHERE is_repeat) AS total_cache_hits, "
        f"{pyround('CASE WHEN count(*) = 0 THEN CAST(0.0 AS DOUBLE) ELSE CAST(count(*) FILTER (WHERE is_repeat) AS DOUBLE) / CAST(count(*) AS DOUBLE) END', 4)} AS cache_hit_rate FROM lg2"
    )
    rolling = (
        f"{pyround('coalesce((SELECT avg(latency_ms) FROM srch), CAST(0.0 AS DOUBLE))', 2)} AS latency_ms_avg, "
        f"{pyround(_p95('latency_ms'), 2)} AS latency_ms_p95, "
        f"{pyround('coalesce((SELECT avg(candidate_count) FROM srch), CAST(0.0 AS DOUBLE))', 2)} AS candidates_avg, "
        f"{pyround(_p95('CAST(candidate_count AS DOUBLE)'), 2)} AS candidates_p95"
    )
    q["log_rolling"] = f"{ev} SELECT {rolling}"
    every = f"{ev}, a AS (SELECT seq, latency_ms AS l, CAST(candidate_count AS DOUBLE) AS c FROM lg2 WHERE NOT is_repeat)"
    q["log_running"] = (
        f"{every}, w AS (SELECT seq, count(*) OVER o AS n, list(l) OVER o AS ll, list(c) OVER o AS cl, "
        "sum(CAST(round(l * 1000000) AS HUGEINT)) OVER o AS ls, sum(CAST(round(c * 1000000) AS HUGEINT)) OVER o AS cs, "
        "count(l) OVER o AS ln, count(c) OVER o AS cn FROM a WINDOW o AS (ORDER BY seq ROWS BETWEEN 4999 PRECEDING AND CURRENT ROW)), "
        "f AS (SELECT seq, n, CASE WHEN ln = 0 THEN 0.0::DOUBLE ELSE ls::DOUBLE / (ln * 1000000)::DOUBLE END AS la, "
        "CASE WHEN cn = 0 THEN 0.0::DOUBLE ELSE cs::DOUBLE / (cn * 1000000)::DOUBLE END AS ca, "
        "coalesce(list_sort(ll, 'ASC', 'NULLS FIRST')[floor(0.95::DOUBLE * (n - 1))::BIGINT + 1], 0.0::DOUBLE) AS lp, "
        "coalesce(list_sort(cl, 'ASC', 'NULLS FIRST')[floor(0.95::DOUBLE * (n - 1))::BIGINT + 1], 0.0::DOUBLE) AS cp FROM w) "
        f"SELECT seq, n, {pyround('la', 2)} AS latency_ms_avg, {pyround('lp', 2)} AS latency_ms_p95, "
        f"{pyround('ca', 2)} AS candidates_avg, {pyround('cp', 2)} AS candidates_p95 FROM f"
    )
    nth = "(SELECT {0} FROM (SELECT {0}, row_number() OVER (ORDER BY {0}) AS r, count(*) OVER () AS n FROM a WHERE {0} IS NOT NULL) WHERE r = floor(0.95::DOUBLE * (n - 1))::BIGINT + 1)"
    q["log_percentiles"] = (
        f"{every}, f AS (SELECT coalesce({nth.format('l')}, 0.0::DOUBLE) AS lp, coalesce({nth.format('c')}, 0.0::DOUBLE) AS cp) "
        f"SELECT (SELECT count(*) FROM a) AS searches, {pyround('lp', 2)} AS latency_ms_p95, {pyround('cp', 2)} AS candidates_p95 FROM f"
    )
    q["log_last_n"] = f"{ev} SELECT seq, query_norm, latency_ms, candidate_count FROM srch"
    q["top_queries"] = (
        f"{ev} SELECT CAST(row_number() OVER (ORDER BY cnt DESC, first_seq ASC) AS INTEGER) AS position, query_norm AS query, cnt AS count "
        "FROM (SELECT query_norm, count(*) AS cnt, min(seq) AS first_seq FROM lg2 GROUP BY query_norm) ORDER BY cnt DESC, first_seq ASC LIMIT 10"
    )
    q["metrics_summary"] = (
        f"{ev} SELECT (SELECT count(*) FROM lg2) AS total_requests, (SELECT count(*) FILTER (WHERE is_repeat) FROM lg2) AS total_cache_hits, "
        f"{pyround('(SELECT CASE WHEN count(*) = 0 THEN CAST(0.0 AS DOUBLE) ELSE CAST(count(*) FILTER (WHERE is_repeat) AS DOUBLE) / CAST(count(*) AS DOUBLE) END FROM lg2)', 4)} AS cache_hit_rate, "
        f"{rolling}, CAST(0 AS BIGINT) AS tie_groups_total, CAST(0.0 AS DOUBLE) AS resolved_by_token_pct, "
        "CAST(0.0 AS DOUBLE) AS resolved_by_edit_pct, CAST(0.0 AS DOUBLE) AS resolved_by_id_pct, "
        "(SELECT string_agg(query_norm || '=' || CAST(cnt AS VARCHAR), ', ' ORDER BY cnt DESC, first_seq) FROM "
        "(SELECT query_norm, count(*) AS cnt, min(seq) AS first_seq FROM lg2 GROUP BY query_norm ORDER BY cnt DESC, first_seq ASC LIMIT 10)) AS top_queries, "
        "'parquet' AS storage, 'original' AS dataset_mode, 'part.parquet' AS dataset_path, CAST(NULL AS BIGINT) AS loaded_rows, "
        "(SELECT count(*) FROM part WHERE p_name IS NOT NULL) AS records"
    )
    q["legacy_layout"] = PART_NAMES.replace(" AS k FROM", " AS normalized_name FROM")
    q["load_report"] = (
        "SELECT 'parquet' AS storage, 'original' AS dataset_mode, 'part.parquet' AS dataset_path, CAST(NULL AS BIGINT) AS loaded_rows, "
        "count(*) AS records FROM part WHERE p_name IS NOT NULL"
    )
    q["stream_match"] = q["match_topk"]
    q["stream_log"] = (
        f"SELECT q AS query_norm, count(*) AS requests, CAST(1 AS BIGINT) AS searches, max(candidate_count) AS candidate_count, "
        f"max(tie_groups) AS tie_groups FROM ({_summary_sql(DOC_NAMES, DEFAULT_REQ)}) GROUP BY q"
    )
    q["name_profile"] = _profile_sql()
    q["match_log_ties"] = _match_log_ties_sql()
    q["mode_comparison"] = _mode_comparison_sql()
    q["match_parts_reused"] = q["match_parts"]
    return q
