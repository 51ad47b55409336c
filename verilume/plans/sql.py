"""The same results as SQL text for DuckDB, built from the same catalogues."""

from __future__ import annotations

from verilume.functions.text import SECRETS, STOP_WORDS
from verilume.operators import chunking, rules, structure

#: Lint rules that the SQL dialect's regular expressions can read: no lookaround, no back reference, repeats of 1,000 at most.
FLAT_RULES = [r.name for r in rules.LINT if r.kind != "ctx" and "(?!" not in r.pattern]


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def lexical_tokens(text: str) -> str:
    stop = "[" + ", ".join(map(quoted, STOP_WORDS)) + "]"
    camel = r"regexp_replace(regexp_replace(t, '([a-z])([A-Z])', '\1_\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1_\2', 'g')"
    parts = lambda x: f"CASE WHEN contains({x}, '_') THEN list_filter(string_split(lower({x}), '_'), lambda p: p <> '' AND NOT list_contains({stop}, p)) ELSE []::VARCHAR[] END"
    of = f"CASE WHEN list_contains({stop}, lower(t)) THEN []::VARCHAR[] ELSE list_concat([lower(t)], {parts('lower(t)')}, {parts(camel)}) END"
    return rf"flatten(list_transform(regexp_extract_all(coalesce({text}, ''), '[\p{{L}}\p{{N}}_]+'), lambda t: {of}))"


def redacted(text: str) -> str:
    for pattern, to in SECRETS:
        text = f"regexp_replace({text}, {quoted(pattern)}, {quoted(to.replace('$1', chr(92) + '1'))}, 'g')"
    return text


def bm25(queries: str, k: int) -> str:
    return f"""WITH q AS ({queries}), qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({lexical_tokens('query')}) AS term FROM q) GROUP BY ALL),
dt AS (SELECT doc_id, {lexical_tokens('text')} AS t FROM documents), dl AS (SELECT doc_id, len(t) AS dl FROM dt),
p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM dt) GROUP BY ALL),
n AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl), df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
raw AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df, n), mean AS (SELECT avg(raw) AS mean FROM raw),
idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * mean ELSE raw END AS idf FROM raw, mean),
s AS (SELECT query_id, doc_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM qt JOIN p USING (term) JOIN idf USING (term) JOIN dl USING (doc_id), n GROUP BY query_id, doc_id)
SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= {k} AND score > 0"""


def vector_search(queries: str, k: int, where: str = "true") -> str:
    total = lambda x: f"list_sum({x})"
    dot = total("list_transform(range(1, len(v.embedding) + 1), lambda i: v.embedding[i]::DOUBLE * q.embedding[i]::DOUBLE)")
    norm = lambda c: f"sqrt({total(f'list_transform({c}, lambda x: x::DOUBLE * x::DOUBLE)')})"
    return f"""WITH q AS ({queries}), s AS (SELECT q.query_id, v.vec_id, round({dot} / nullif({norm('v.embedding')} * {norm('q.embedding')}, 0), 6) AS similarity FROM embeddings v, q WHERE {where})
SELECT query_id, vec_id, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM s) WHERE rank <= {k}"""


def _plain(pattern: str) -> str:
    return pattern.replace("(?iu)", "(?i)")


def heading_role(text: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, {quoted(_plain(p))}) THEN {quoted(r)}" for p, r in structure.HEADINGS) + " END"


def is_important(text: str) -> str:
    has = lambda words: f"regexp_matches(lower({text}), {quoted('|'.join(words))})"
    return f"CASE WHEN {has(structure.SKIPPED)} THEN false ELSE {has(structure.IMPORTANT)} OR starts_with({text}, 'Section ') END"


def section_tokens(text: str) -> str:
    bare = rf"trim(regexp_replace(lower(trim({text})), '^\d+\.?\s*', ''))"
    exact = [f"WHEN {bare} IN ({', '.join(map(quoted, names))}) THEN {n}" for n, names in chunking.SECTION_TOKENS.items()]
    part = [f"WHEN contains({bare}, {quoted(x)}) THEN {n}" for n, names in chunking.SECTION_TOKENS.items() for x in names]
    return f"CASE {' '.join(exact + part)} ELSE {chunking.DEFAULT_TOKENS} END"


def _group(text: str, pattern: str) -> str:
    return f"nullif(regexp_extract({text}, {quoted('(?i)' + pattern)}, 1), '')"


def pattern_claims(source: str) -> str:
    parts, seq = [], 0
    for key, (kind, said, patterns) in rules.CLAIMS.items():
        before, after = said.split("{}")
        for p in patterns:
            parts.append(f"SELECT doc_id, {seq} AS seq, {quoted(kind)} AS claim_type, {quoted(before)} || v || {quoted(after)} AS text, {quoted(key.replace('_', ' ') + '|')} || v AS keywords, v AS expected_value FROM (SELECT doc_id, {_group('content', p)} AS v FROM src) WHERE v IS NOT NULL")
            seq += 1
    return f"WITH src AS ({source}) " + " UNION ALL ".join(parts)


def code_values(source: str) -> str:
    parts = [f"SELECT doc_id, {quoted(k)} AS key, coalesce({', '.join(_group('content', p) for p in patterns)}) AS value FROM src" for k, patterns in rules.VALUES.items()]
    return f"WITH src AS ({source}) SELECT doc_id, key, value FROM ({' UNION ALL '.join(parts)}) WHERE value IS NOT NULL"


def behaviour_type(source: str) -> str:
    scores = [f"{{'h': {' + '.join(f'regexp_matches(content, {quoted(p)})::INTEGER' for p in ps)}, 'f': {-i}, 'k': {quoted(k)}}}" for i, (k, ps) in enumerate(rules.BEHAVIOURS.items())]
    return f"WITH src AS ({source}) SELECT doc_id, CASE WHEN b.h > 0 THEN b.k END AS behavior_type FROM (SELECT doc_id, list_max([{', '.join(scores)}]) AS b FROM src)"


def lint_flags(source: str) -> str:
    parts = []
    for r in rules.LINT:
        if r.name in FLAT_RULES:
            cond = f"regexp_matches(content, {quoted('(?i)' + r.pattern)})"
            if r.kind == "abs":
                cond += " AND NOT (" + " AND ".join(f"contains(lower(content), {quoted(s.lower())})" for s in rules.SEEDS) + ")"
            parts.append(f"SELECT doc_id, {quoted(r.name)} AS pattern_type, {quoted(r.category)} AS category, {r.tier} AS tier FROM src WHERE {cond}")
    return f"WITH src AS ({source}) " + " UNION ALL ".join(parts)


def overall_score() -> str:
    points = lambda status, weights: "sum(CASE " + " ".join(f"WHEN ({status}) AND tier = {t + 1} THEN {w}" for t, w in enumerate(weights)) + " ELSE 0 END)"
    bad = "status = 'misaligned'"
    return f"""WITH rr AS (SELECT doc_id % 50 AS audit, CASE WHEN quality = 1 THEN 'aligned' WHEN doc_id % 3 = 0 THEN 'unverified' ELSE 'misaligned' END AS status, doc_id % 3 + 2 AS tier FROM labels),
ww AS (SELECT doc_id % 60 AS audit, doc_id % 4 + 1 AS tier, CASE WHEN doc_id % 2 = 0 THEN 'data_leakage' ELSE 'reproducibility' END AS category FROM labels WHERE toxic = 1),
r AS (SELECT audit, count(*) AS total, count_if(status = 'aligned') AS aligned, count_if({bad}) AS misaligned, {points(bad, (20, 12, 6, 2))} AS cp, count_if({bad} AND tier = 1) AS cc FROM rr GROUP BY audit),
w AS (SELECT audit, count(*) AS warnings, {points('true', (20, 10, 4, 1))} AS wp, count_if(tier = 1) AS cw, count_if(tier = 2) AS q, count_if(tier = 1 AND category = 'data_leakage') AS leaks FROM ww GROUP BY audit),
a AS (SELECT audit, coalesce(total, 0) AS total, coalesce(aligned, 0) AS aligned, coalesce(misaligned, 0) AS misaligned, coalesce(cp, 0) AS cp, coalesce(cc, 0) AS cc, coalesce(warnings, 0) AS warnings, coalesce(wp, 0) AS wp, coalesce(cw, 0) AS cw, coalesce(q, 0) AS q, coalesce(leaks, 0) AS leaks FROM r FULL OUTER JOIN w USING (audit)),
s AS (SELECT *, cw + cc AS critical, CASE WHEN aligned + misaligned > 0 THEN 60.0::DOUBLE * aligned / (aligned + misaligned) ELSE 42.0 END + greatest(0, 20 - cp) + greatest(0, 20 - wp) + ((aligned + misaligned)::DOUBLE / nullif(total, 0) - 0.5) * 20 AS raw FROM a),
t AS (SELECT *, round(CASE WHEN total > 0 THEN greatest(0.0, least(100.0, CASE WHEN critical > 0 THEN least(raw, 40.0) ELSE raw END)) WHEN warnings = 0 THEN 100.0 WHEN cw > 0 THEN 25.0 ELSE greatest(50.0, 100.0 - 10 * warnings) END, 1) AS score FROM s)
SELECT audit, score, total, aligned, misaligned, warnings, critical, CASE WHEN critical > 0 AND leaks > 0 THEN 'CRITICAL: data leakage' WHEN critical > 0 THEN 'CRITICAL' WHEN q > 0 OR score < 50 THEN 'WARNING' WHEN score >= 80 AND misaligned = 0 AND warnings = 0 THEN 'GOOD' WHEN score >= 80 THEN 'ACCEPTABLE' ELSE 'REVIEW NEEDED' END AS recommendation FROM t"""
