"""Queries over claims, behaviours, answers, suppressions and states, with the SQL that states the same result."""

from __future__ import annotations

from pyspark.sql import functions as F

from verilume.functions import text as tx
from verilume.operators import answers, audit, chunking, retrieval, rules, state
from verilume.plans import catalog, plugins, sql
from verilume.plans.catalog import QUERY_STEP, query, read

# Claims and behaviours


@query(f"SELECT doc_id, seq, claim_type FROM ({sql.pattern_claims(catalog._CODE)}) WHERE claim_type IN ('data_split', 'training_procedure')")
def clm07_focus(spark, sf_dir):
    claims = audit.pattern_claims(catalog._code(spark, sf_dir), text="content")
    return audit.focused(claims, ["data_split", "training_procedure"]).select("doc_id", "seq", "claim_type")


@query("""WITH d AS (SELECT doc_id, repeat(text || ' ', CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 20 END) AS text FROM documents), l AS (SELECT doc_id FROM d WHERE length(text) > 20000),
s AS (SELECT doc_id, u AS part, CASE u WHEN 1 THEN 'Introduction' WHEN 2 THEN 'Training setup' ELSE 'Section 3' END AS name, substr(text, u * 50, 9000) AS content FROM d, (SELECT unnest([1, 2, 3]) AS u))
SELECT doc_id, 0 AS part, md5(left(text, 15000)) AS content FROM d WHERE length(text) <= 20000 UNION ALL SELECT doc_id, part, md5(left(content, 8000)) FROM s JOIN l USING (doc_id) WHERE part > 1 AND length(content) >= 100""")
def clm02_clm03_excerpts(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.repeat(F.concat("text", F.lit(" ")), F.when(F.col("doc_id") % 2 == 0, 1).otherwise(20)).alias("text"))
    name = F.when(F.col("section") == 1, "Introduction").when(F.col("section") == 2, "Training setup").otherwise("Section 3")
    s = d.select("doc_id", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("section"), "text").select("doc_id", "section", name.alias("name"), F.substring(F.col("text"), F.col("section") * 50, F.lit(9000)).alias("content"))
    return audit.claim_excerpts(d, s).withColumn("content", F.md5("content"))


_ANSWER = "'Here: ```json\n[{\"text\": \"c' || event_id || '\", \"claim_type\": \"' || CASE event_id % 3 WHEN 0 THEN 'Data_Split' WHEN 1 THEN 'odd' ELSE 'hyperparameter' END || '\", \"expected_value\": ' || user_id || '}, {\"text\": \" \"}]\n```'"


@query("SELECT event_id AS query_id, 0 AS seq, 'c' || event_id AS text, CASE event_id % 3 WHEN 0 THEN 'data_split' WHEN 1 THEN 'other' ELSE 'hyperparameter' END AS claim_type, user_id::VARCHAR AS expected_value FROM events")
def clm06_parsed_claims(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return answers.parsed_claims(e.select(F.col("event_id").alias("query_id"), F.expr(_ANSWER).alias("answer"))).select("query_id", "seq", "text", "claim_type", "expected_value")


_VALUES = [quoted for quoted in rules.VALUES]
_WINDOWS = f"""src AS ({catalog._CODE}), ls AS (SELECT doc_id, string_split(content, chr(10)) AS x FROM src), ws AS (SELECT doc_id, x, unnest(range(0, greatest(len(x) - 21, 0) + 1, 80)) AS b FROM ls),
win AS (SELECT doc_id, b // 80 AS chunk, 'c' || doc_id || ':' || (b + 1) AS chunk_id, array_to_string(x[b + 1:b + 100], chr(10)) AS content FROM ws)"""
_BEHAVIOURS = f"""{_WINDOWS}, vals AS (SELECT *, {', '.join(f'coalesce({", ".join(sql._group("content", p) for p in ps)}) AS v_{k}' for k, ps in rules.VALUES.items())} FROM win WHERE length(trim(content)) >= 50),
kinds AS (SELECT *, list_max([{', '.join("{'h': " + ' + '.join(f'regexp_matches(content, {sql.quoted(p)})::INTEGER' for p in ps) + f", 'f': {-i}, 'k': {sql.quoted(k)}}}" for i, (k, ps) in enumerate(rules.BEHAVIOURS.items()))}]) AS best FROM vals WHERE coalesce({', '.join(f'v_{k}' for k in _VALUES)}) IS NOT NULL),
beh AS (SELECT doc_id, chunk, chunk_id, coalesce(CASE WHEN best.h > 0 THEN best.k END, 'implementation_detail') AS behavior_type,
  concat_ws('; ', CASE WHEN best.h > 0 THEN 'Type: ' || best.k END, array_to_string(list_filter([{', '.join(f"{sql.quoted(k.replace('_', ' '))} || ': ' || v_{k}" for k in _VALUES)}], lambda x: x IS NOT NULL), '; ')) AS description,
  coalesce({', '.join(f'v_{k}' for k in rules.VALUE_PRIORITY)}, {', '.join(f'v_{k}' for k in _VALUES)}) AS actual_value, left(content, 1000) AS code_snippet, {', '.join(f'v_{k}' for k in _VALUES)} FROM kinds)"""  # fmt: skip


@query(f"WITH {_BEHAVIOURS} SELECT chunk_id, behavior_type, description, actual_value, code_snippet FROM beh")
def beh03_beh05_behaviours(spark, sf_dir):
    return catalog._behaviours(spark, sf_dir).select("chunk_id", "behavior_type", "description", "actual_value", "code_snippet")


_CLAIMS = f"claims AS (SELECT doc_id * 100 + seq AS claim_id, claim_type, text, expected_value, string_split(keywords, '|') AS keywords FROM ({sql.pattern_claims(catalog._CODE)}) WHERE doc_id % {QUERY_STEP} = 0)"
_KEY = "CASE " + " ".join(f"WHEN contains(lower(text), {sql.quoted(w)}) THEN {sql.quoted(k)}" for w, k in rules.CLAIM_KEYS.items()) + " END"
_VALUE = "CASE k " + " ".join(f"WHEN {sql.quoted(k)} THEN v_{k}" for k in _VALUES) + " END"
_MATCHED = f"""{_BEHAVIOURS}, {_CLAIMS}, cw AS (SELECT *, {_KEY} AS k, list_filter(list_transform(list_concat(keywords, regexp_split_to_array(lower(text), '\\s+')), lambda w: lower(w)), lambda w: length(w) >= 3) AS words FROM claims),
pairs AS (SELECT claim_id, chunk_id, beh.doc_id, chunk, claim_type, expected_value, {_VALUE} AS actual, CASE WHEN behavior_type = claim_type THEN 10 ELSE 0 END + CASE WHEN coalesce({_VALUE}, '') <> '' THEN 20 ELSE 0 END
  + list_sum(list_transform(words, lambda w: CASE WHEN contains(lower(description), w) THEN 2 ELSE 0 END + CASE WHEN contains(lower(code_snippet), w) THEN 3 ELSE 0 END))
  + CASE WHEN expected_value <> '' AND contains(code_snippet, expected_value) THEN 5 ELSE 0 END + CASE WHEN expected_value <> '' AND contains(description, expected_value) THEN 3 ELSE 0 END AS score FROM beh, cw),
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY score DESC, doc_id, chunk) AS rank FROM pairs WHERE score > 0) WHERE rank <= 5)"""  # fmt: skip


@query(f"WITH {_MATCHED} SELECT claim_id, chunk_id, score::INTEGER AS score, rank FROM ranked")
def aln01_matched(spark, sf_dir):
    return audit.matched(catalog._claims(spark, sf_dir), catalog._behaviours(spark, sf_dir))


_NUM = lambda c: f"try_cast(regexp_extract(lower({c}), '(\\d+\\.?\\d*(?:e[+-]?\\d+)?)', 1) AS DOUBLE)"
_TIERS = "CASE claim_type " + " ".join(f"WHEN {sql.quoted(k)} THEN {t[0]}" for k, t in rules.CLAIM_TIERS.items()) + " ELSE 2 END"


@query(f"""WITH {_MATCHED}, best AS (SELECT claim_id, arg_min({{'c': chunk_id, 'a': actual}}, rank) AS m FROM ranked WHERE actual IS NOT NULL AND expected_value <> '' GROUP BY claim_id),
j AS (SELECT c.claim_id, c.claim_type, m.c AS chunk_id, m.a AS actual_value, {_NUM('expected_value')} AS x, {_NUM('m.a')} AS y, lower(trim(expected_value)) = lower(trim(m.a)) AS same FROM claims c LEFT JOIN best USING (claim_id)),
o AS (SELECT *, same OR coalesce(x = y OR (x <> 0 AND abs(x - y) / abs(x) <= 0.01), false) AS ok FROM j)
SELECT claim_id, claim_type, CASE WHEN chunk_id IS NULL THEN 'unverified' WHEN ok THEN 'aligned' ELSE 'misaligned' END AS status, CASE WHEN chunk_id IS NULL THEN 3 WHEN ok THEN 4 ELSE {_TIERS} END AS tier,
CASE WHEN chunk_id IS NULL THEN 0.0 ELSE 0.95 END::DOUBLE AS confidence, chunk_id, actual_value FROM o""")
def aln04_aln09_aligned(spark, sf_dir):
    return audit.aligned(catalog._claims(spark, sf_dir), catalog._behaviours(spark, sf_dir))


@query(f"SELECT doc_id, {_KEY.replace('text', 't')} AS key FROM (SELECT doc_id, split_part(text, chr(10), 1) || ' ' || ([{', '.join(map(sql.quoted, [*rules.CLAIM_KEYS, 'nothing']))}])[doc_id % {len(rules.CLAIM_KEYS) + 1} + 1] AS t FROM documents)")
def aln03_claim_keys(spark, sf_dir):
    word = F.element_at(F.array(*map(F.lit, [*rules.CLAIM_KEYS, "nothing"])), (F.col("doc_id") % (len(rules.CLAIM_KEYS) + 1) + 1).cast("int"))
    d = read(spark, sf_dir, "documents").select("doc_id", F.concat_ws(" ", F.substring_index("text", "\n", 1), word).alias("t"))
    return d.select("doc_id", audit.claim_value_key(F.col("t")).alias("key"))


@query("""SELECT event_id AS query_id, CASE event_id % 4 WHEN 0 THEN 'aligned' WHEN 1 THEN 'misaligned' WHEN 2 THEN 'misaligned' ELSE 'unverified' END AS status,
CASE WHEN event_id % 5 = 0 THEN 4 ELSE greatest(1, least(4, user_id % 7)) END::INTEGER AS tier, 0.5::DOUBLE AS confidence FROM events""")
def aln07_aln08_verdicts(spark, sf_dir):
    said = F.element_at(F.array(*map(F.lit, ("Aligned", "misaligned", "partial", "who knows"))), (F.col("event_id") % 4 + 1).cast("int"))
    tier = F.when(F.col("event_id") % 5 == 0, "").otherwise(F.concat(F.lit(', "tier": "Tier '), F.col("user_id") % 7, F.lit('"')))
    a = read(spark, sf_dir, "events").select(F.col("event_id").alias("query_id"), F.concat(F.lit('I say {"status": "'), said, F.lit('"'), tier, F.lit("}")).alias("answer"))
    return answers.parsed_verdicts(a).select("query_id", "status", "tier", "confidence")


def _files(spark, sf_dir):
    path = F.concat(F.element_at(F.array(*map(F.lit, ("src/train_", "lib/x", "data/load", "docs/a", "core/m"))), (F.col("doc_id") % 5 + 1).cast("int")), F.col("doc_id"), F.lit(".py"))
    kind = F.when(F.col("doc_id") % 7 == 0, "text").otherwise("python")
    return read(spark, sf_dir, "documents").select(path.alias("relative_path"), kind.alias("language"), F.concat("text", F.when(F.col("doc_id") % 9 == 0, "\nencoder = 1").otherwise("")).alias("content"), F.col("doc_id").alias("seq"))


_FILES = "files AS (SELECT (['src/train_', 'lib/x', 'data/load', 'docs/a', 'core/m'])[doc_id % 5 + 1] || doc_id || '.py' AS relative_path, CASE WHEN doc_id % 7 = 0 THEN 'text' ELSE 'python' END AS language, text || CASE WHEN doc_id % 9 = 0 THEN chr(10) || 'encoder = 1' ELSE '' END AS content, doc_id AS seq FROM documents)"
_WORDS = sorted({w for t in ("model_architecture", "hyperparameter") for w in rules.RELEVANCE[t]})


@query(f"WITH {_FILES} SELECT relative_path FROM files WHERE language = 'python' AND ({' OR '.join(f'contains(lower(relative_path), {sql.quoted(w)}) OR contains(left(lower(content), 5000), {sql.quoted(w)})' for w in _WORDS)}) ORDER BY seq LIMIT 10")
def beh06_files_for_claims(spark, sf_dir):
    return audit.files_for_claims(_files(spark, sf_dir), ["model_architecture", "hyperparameter"]).select("relative_path")


@query(f"WITH {_FILES} SELECT relative_path FROM files WHERE language = 'python' AND regexp_matches(lower(relative_path), {sql.quoted('|'.join(rules.LINTED_FILES))})")
def cat04_relevant_files(spark, sf_dir):
    return audit.relevant_files(_files(spark, sf_dir)).select("relative_path")


@query(f"WITH {_FILES}, l AS (SELECT relative_path, string_split(content, chr(10)) AS x FROM files), s AS (SELECT relative_path, x, unnest(range(0, len(x), 450)) AS b FROM l) SELECT relative_path, b // 450 AS chunk, b + 1 AS start_line, md5(array_to_string(x[b + 1:b + 500], chr(10))) AS content FROM s")
def cat05_lint_excerpts(spark, sf_dir):
    return audit.lint_excerpts(_files(spark, sf_dir)).select("relative_path", F.col("chunk").cast("long"), F.col("start_line").cast("long"), F.md5("content").alias("content"))


@query("SELECT 'f' || event_id AS relative_path, 'data_leakage' AS category, 'p' AS pattern_type, 3 AS tier, (user_id % 9 + 1 + event_id % 1000 - 1)::INTEGER AS line_start, (user_id % 9 + 1 + event_id % 1000 - 1)::INTEGER AS line_end FROM events WHERE event_id % 1000 > 0 AND event_id % 3 <> 0")
def cat05_completed_warnings(spark, sf_dir):
    kind = F.when(F.col("event_id") % 3 == 0, "poetry").otherwise("Data_Leakage")
    said = F.concat(F.lit('```json\n[{"category": "'), kind, F.lit('", "pattern_type": "p", "line_start": '), F.col("user_id") % 9 + 1, F.lit('}, {"category": "x"}]```'))
    a = read(spark, sf_dir, "events").filter("event_id % 1000 > 0").select(F.concat(F.lit("f"), "event_id").alias("relative_path"), (F.col("event_id") % 1000).cast("int").alias("start_line"), said.alias("answer"))
    return audit.completed_warnings(a).drop("recommendation")


@query()
def cat01_cat07_warnings(spark, sf_dir):
    files = catalog._code(spark, sf_dir).select(F.concat(F.lit("train/"), F.col("doc_id").cast("string"), F.lit(".py")).alias("relative_path"), "content")
    return audit.with_remedies(audit.distinct_warnings(audit.lint(files))).drop("seq")


# Scores, differences, suppressions


def _warnings(spark, sf_dir):
    rule = F.element_at(F.array(*[F.lit(r.name) for r in rules.LINT]), (F.col("event_id") % len(rules.LINT) + 1).cast("int"))
    kind = F.element_at(F.array(*[F.lit(r.category) for r in rules.LINT]), (F.col("event_id") % len(rules.LINT) + 1).cast("int"))
    return read(spark, sf_dir, "events").select(
        "event_id", kind.alias("category"), rule.alias("pattern_type"), (F.col("user_id") % 4 + 1).cast("int").alias("tier"), F.concat(F.lit("f"), F.col("user_id") % 20).alias("relative_path"),
        (F.col("event_id") % 30).cast("int").alias("line_start"), (F.col("event_id") % 6 == 0).alias("suppressed"),
    )


_EVENTS = f"w AS (SELECT event_id, ([{', '.join(sql.quoted(r.category) for r in rules.LINT)}])[event_id % {len(rules.LINT)} + 1] AS category, ([{', '.join(sql.quoted(r.name) for r in rules.LINT)}])[event_id % {len(rules.LINT)} + 1] AS pattern_type, (user_id % 4 + 1)::INTEGER AS tier, 'f' || user_id % 20 AS relative_path, (event_id % 30)::INTEGER AS line_start, event_id % 6 = 0 AS suppressed FROM events)"
_ADVICE = "(VALUES " + ", ".join(f"({sql.quoted(c)}, {sql.quoted(n)}, {sql.quoted(said)})" for (c, n), said in rules.REMEDIES.items()) + ") AS a(category, name, said)"


@query(f"WITH {_EVENTS} SELECT event_id, coalesce(a.said, b.said, 'Review the code.') AS recommendation FROM w LEFT JOIN {_ADVICE} ON a.category = w.category AND a.name = w.pattern_type LEFT JOIN {_ADVICE.replace('AS a(', 'AS b(')} ON b.category = w.category AND b.name = '*'")
def agg08_remedies(spark, sf_dir):
    return audit.with_remedies(_warnings(spark, sf_dir)).select("event_id", "recommendation")


@query(f"WITH {_EVENTS} SELECT CASE WHEN suppressed THEN 'suppressed' WHEN tier = 1 THEN 'tier1' WHEN tier = 2 THEN 'tier2' ELSE 'other' END AS bucket, count(*) AS n FROM w GROUP BY ALL")
def agg09_ui_buckets(spark, sf_dir):
    return audit.ui_buckets(_warnings(spark, sf_dir))


_RESULTS = "r AS (SELECT doc_id AS claim_id, doc_id % 50 AS audit, CASE WHEN quality = 1 THEN 'aligned' WHEN doc_id % 3 = 0 THEN 'error' ELSE 'misaligned' END AS status, (doc_id % 3 + 2)::INTEGER AS tier, doc_id % 4 AS matched FROM labels)"


def _results(spark, sf_dir):
    status = F.when(F.col("quality") == 1, "aligned").when(F.col("doc_id") % 3 == 0, "error").otherwise("misaligned")
    return read(spark, sf_dir, "labels").select(F.col("doc_id").alias("claim_id"), (F.col("doc_id") % 50).alias("audit"), status.alias("status"), (F.col("doc_id") % 3 + 2).cast("int").alias("tier"), F.array_repeat(F.lit("c"), (F.col("doc_id") % 4).cast("int")).alias("matched"))


@query(f"WITH {_RESULTS} SELECT claim_id, CASE WHEN status IN ('aligned', 'misaligned') THEN status ELSE 'other' END AS part FROM r")
def set09_by_status(spark, sf_dir):
    return audit.by_status(_results(spark, sf_dir)).select("claim_id", "part")


@query(f"WITH {_RESULTS}, {_EVENTS}, a AS (SELECT audit, count(*) AS claims, sum(CASE WHEN status IN ('aligned', 'misaligned') THEN matched ELSE 0 END) AS behaviours FROM r GROUP BY audit), b AS (SELECT event_id % 60 AS audit, count(*) AS warnings FROM w GROUP BY ALL) SELECT audit, coalesce(claims, 0) AS claims, coalesce(behaviours, 0)::BIGINT AS behaviours, coalesce(warnings, 0) AS warnings FROM a FULL OUTER JOIN b USING (audit)")
def agg10_progress_counts(spark, sf_dir):
    return audit.progress_counts(_results(spark, sf_dir), _warnings(spark, sf_dir).withColumn("audit", F.col("event_id") % 60), "audit")


@query(f"WITH {_RESULTS}, {_EVENTS}, i AS (SELECT tier, 'claim ' || claim_id AS issue FROM r WHERE status = 'misaligned' UNION ALL SELECT tier, relative_path || ':' || line_start || ':' || pattern_type FROM w WHERE NOT suppressed) SELECT tier, array_to_string(list_sort(list(issue)), ',') AS issues FROM i GROUP BY tier")
def agg06_issues_by_tier(spark, sf_dir):
    return audit.issues_by_tier(_results(spark, sf_dir), _warnings(spark, sf_dir)).select("tier", F.array_join("issues", ",").alias("issues"))


@query(f"SELECT audit, 'Score ' || format('{{:.1f}}', score) || ' of 100. ' || aligned || ' of ' || total || ' claims agree with the code, ' || misaligned || ' contradict it. ' || warnings || ' warnings, ' || critical || ' critical.' AS summary FROM ({sql.overall_score()})")
def agg07_summary(spark, sf_dir):
    return audit.summary(catalog.agg01_agg05_score(spark, sf_dir)).select("audit", "summary")


@query("""WITH d AS (SELECT repeat(p_name || ' ', 6) AS text, p_brand AS claim_type, p_size % 3 AS m FROM part), a AS (SELECT left(text, 100) AS text, claim_type FROM d WHERE m <> 0), b AS (SELECT left(text, 100) AS text, claim_type FROM d WHERE m <> 1)
SELECT text, claim_type, 'new' AS change FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.text = b.text AND a.claim_type = b.claim_type) UNION ALL SELECT text, claim_type, 'resolved' FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.text = b.text AND a.claim_type = b.claim_type)""")
def set02_contradiction_changes(spark, sf_dir):
    d = read(spark, sf_dir, "part").select(F.repeat(F.concat("p_name", F.lit(" ")), F.lit(6)).alias("text"), F.col("p_brand").alias("claim_type"), (F.col("p_size") % 3).alias("m"))
    side = lambda m: d.withColumn("status", F.when(F.col("m") == m, "aligned").otherwise("misaligned"))
    return audit.contradiction_changes(side(0), side(1))


@query("""SELECT user_id, CASE WHEN d > 5 THEN 'Improvement: Score increased by ' || format('{:.1f}', d) || ' points.' WHEN d < -5 THEN 'Regression: Score decreased by ' || format('{:.1f}', -d) || ' points.' ELSE 'Minimal change: Score changed by ' || format('{:.1f}', d) || ' points.' END
|| CASE WHEN n > 0 THEN ' ' || n || ' new warning(s).' ELSE '' END || CASE WHEN r > 0 THEN ' ' || r || ' warning(s) resolved.' ELSE '' END AS said
FROM (SELECT user_id, CASE user_id % 3 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END * count(*)::DOUBLE AS d, user_id % 4 AS n, user_id % 2 AS r FROM events GROUP BY user_id)""")
def set03_score_change(spark, sf_dir):
    sign = F.when(F.col("user_id") % 3 == 0, 1).when(F.col("user_id") % 3 == 1, -1).otherwise(0)
    e = read(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n")).withColumn("d", sign * F.col("n"))
    return e.select("user_id", audit.score_change(F.lit(0), F.col("d"), F.col("user_id") % 4, F.col("user_id") % 2).alias("said"))


@query("SELECT DISTINCT scope, warning_type, file_path, line_start, codebase_hash FROM (SELECT 'codebase' AS scope, 'c.p' || user_id % 5 AS warning_type, 'f' || user_id AS file_path, (user_id % 7)::INTEGER AS line_start, 'cb' AS codebase_hash FROM events) WHERE file_path <> 'f3' UNION ALL SELECT 'global', 'c.old', 'f', 1, NULL")
def set08_records(spark, sf_dir):
    old = spark.createDataFrame([("global", "c.old", None, "f", 1, "r", None, 1), ("global", "c.gone", None, "f", 1, "r", None, 2)], "scope string, warning_type string, code_hash string, file_path string, line_start int, user_reason string, codebase_hash string, seq int")
    w = read(spark, sf_dir, "events").filter("user_id != 3").select(F.lit("c").alias("category"), F.concat(F.lit("p"), F.col("user_id") % 5).alias("pattern_type"), F.concat(F.lit("f"), "user_id").alias("relative_path"), (F.col("user_id") % 7).cast("int").alias("line_start"), F.lit("x").alias("code_snippet")).distinct()
    kept = audit.without_record(audit.with_record(audit.with_record(old, w, "codebase", "known", "cb"), w, "audit", "not kept"), 2)
    return kept.select("scope", "warning_type", "file_path", "line_start", "codebase_hash")


# Answers, caches, states


@query(f"""WITH h AS ({catalog._BM25}) SELECT query_id, doc_id, 0.7::DOUBLE AS relevance, 'same term' AS explanation FROM h WHERE query_id % 40 = 0 AND rank = 2
UNION ALL SELECT query_id, doc_id, greatest(0.0, least(1.0, score)), NULL FROM h WHERE (query_id % 40 <> 0 OR query_id NOT IN (SELECT query_id FROM h WHERE rank = 2)) AND rank <= 3""")
def ans01_ans06_references(spark, sf_dir):
    hits = catalog.lex02_lex03_bm25(spark, sf_dir).withColumnRenamed("score", "similarity")
    said = F.when(F.col("query_id") % 40 == 0, 'Here: {"references": [{"snippet_id": "snippet_1", "relevance": "0.7", "reason": "same term"}], "summary": "s"}').otherwise("no json")
    return answers.references(hits.select("query_id").distinct().withColumn("answer", said), hits, "doc_id")


@query(f"""WITH h AS ({catalog._BM25}), f AS (SELECT query_id, 'f' || doc_id % 30 AS relative_path, min(rank) AS first FROM h GROUP BY ALL), r AS (SELECT query_id, relative_path, row_number() OVER (PARTITION BY query_id ORDER BY first, relative_path) AS rank FROM f),
c AS (SELECT 'f' || doc_id AS relative_path, text FROM documents WHERE doc_id < 30) SELECT query_id, relative_path, rank, md5(left(text, 5000)) AS content FROM r JOIN c USING (relative_path) WHERE rank <= 5""")
def ans03_alignment_files(spark, sf_dir):
    hits = catalog.lex02_lex03_bm25(spark, sf_dir).select("query_id", F.concat(F.lit("f"), F.col("doc_id") % 30).alias("relative_path"), "rank")
    files = read(spark, sf_dir, "documents").filter("doc_id < 30").select(F.concat(F.lit("f"), "doc_id").alias("relative_path"), F.col("text").alias("content"))
    return answers.alignment_files(hits, files).withColumn("content", F.md5("content"))


@query(f"""WITH h AS (SELECT b.query_id, b.doc_id, b.score AS original_similarity, q.query, d.text FROM ({catalog._BM25}) b JOIN ({catalog._Q_DOCS}) q ON b.query_id = q.query_id JOIN documents d ON d.doc_id = b.doc_id WHERE b.rank <= 20),
s AS (SELECT query_id, doc_id, original_similarity, round(coalesce(len(list_intersect({catalog._TOK('query')}, {catalog._TOK('text')})) / nullif(len(list_distinct(list_concat({catalog._TOK('query')}, {catalog._TOK('text')}))), 0), 0), 6) AS similarity FROM h)
SELECT query_id, doc_id, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, doc_id) AS rank FROM s) WHERE rank <= 3""")
def rrk02_rerank_for_code(spark, sf_dir):
    q, d = catalog.asked(spark, sf_dir, "benchmark", "item_id", "text"), read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("document"))
    hits = catalog.lex02_lex03_bm25(spark, sf_dir).withColumnRenamed("score", "similarity").join(F.broadcast(q), "query_id").join(d, "doc_id")
    return retrieval.rerank_for_code(hits, 3, "doc_id").select("query_id", "doc_id", "similarity", "rank")


@query("SELECT lang, count(*) AS rows, true AS same FROM documents GROUP BY lang")
def cac01_embedded_once(spark, sf_dir):
    """Every row has its text's embedding, computed once for each distinct text."""
    d = read(spark, sf_dir, "documents").select("lang", F.left("text", F.lit(40)).alias("text"))
    own = plugins.hashed_embedding(F.col("text"))
    return plugins.embedded(d).groupBy("lang").agg(F.count("*").alias("rows"), F.every(F.col("embedding") == own).alias("same"))


_STORED = "SELECT doc_id, 'Paper: p' || chr(10) || 'Page 1' || chr(10) || 'Section: ' || (['Abstract', '2. Methods (page 3)', '1 Introduction', 'Results', '7. Future Work'])[doc_id % 5 + 1] || chr(10) || split_part(text, chr(10), 1) AS document FROM documents"


def _stored(spark, sf_dir):
    name = F.element_at(F.array(*map(F.lit, ("Abstract", "2. Methods (page 3)", "1 Introduction", "Results", "7. Future Work"))), (F.col("doc_id") % 5 + 1).cast("int"))
    return read(spark, sf_dir, "documents").select("doc_id", F.concat_ws("\n", F.lit("Paper: p"), F.lit("Page 1"), F.concat(F.lit("Section: "), name), F.substring_index("text", "\n", 1)).alias("document"))


@query(f"SELECT doc_id FROM ({_STORED}) WHERE doc_id % 5 IN (1, 3)")
def cac04_to_prepare(spark, sf_dir):
    return state.to_prepare(_stored(spark, sf_dir)).select("doc_id")


@query("SELECT doc_id, trim(split_part(text, chr(10), 1)) AS bare FROM documents")
def cac05_without_header(spark, sf_dir):
    d = _stored(spark, sf_dir).withColumn("document", F.replace(F.col("document"), F.lit("Page 1"), F.lit("Page: 1")))
    return d.select("doc_id", F.trim(answers.without_header("document")).alias("bare"))


@query("SELECT user_id, event_id, left(repeat(event_type, 60), 200) AS text FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 20")
def sta03_recent_queries(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("text", F.repeat("event_type", F.lit(60)))
    return state.recent_queries(e, "user_id").select("user_id", "event_id", "text")


@query("""WITH p AS (SELECT list_filter(string_split(split_part(regexp_replace(url, '^https?://', ''), '?', 1), '/'), lambda x: x <> '') AS p FROM pages), e AS (SELECT p, unnest(range(1, len(p) + 1)) AS d FROM p WHERE len(p) > 0),
t AS (SELECT parent, name, is_dir, count(*) AS files FROM (SELECT array_to_string(p[1:d - 1], '/') AS parent, p[d] AS name, d < len(p) AS is_dir FROM e) GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY parent ORDER BY is_dir DESC, lower(name), name) AS place FROM t""")
def srt03_sorted_tree(spark, sf_dir):
    return state.sorted_tree(catalog.src14_tree(spark, sf_dir))


@query("SELECT event_id FROM events WHERE event_id <> 7")
def srt05_without(spark, sf_dir):
    return state.without(read(spark, sf_dir, "events"), "event_id", 7).select("event_id")


@query(f"SELECT event_id, {sql.redacted('message')} AS message FROM (SELECT event_id, event_type || ' password=' || user_id || 'x token: ' || repeat('ab', 12) || ' ' || props AS message FROM events)")
def sec03_sanitised_records(spark, sf_dir):
    message = F.concat("event_type", F.lit(" password="), "user_id", F.lit("x token: "), F.repeat(F.lit("ab"), F.lit(12)), F.lit(" "), "props")
    return read(spark, sf_dir, "events").select("event_id", tx.redacted(message).alias("message"))


_HITS = ", ".join(f"CASE WHEN contains(lower(content), {sql.quoted(p.lower())}) THEN {sql.quoted(d)} END" for p, d in tx.IDIOMS)


@query(f"SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter([{_HITS}], lambda x: x IS NOT NULL))), '|') AS found FROM ({catalog._CODE})")
def c2q01_c2q02_operations(spark, sf_dir):
    return catalog._code(spark, sf_dir).select("doc_id", F.array_join(F.sort_array(tx.described_operations("content")), "|").alias("found"))


@query("SELECT doc_id, 'src/f' || doc_id || '.py:chunk_' || (b // 80) || ':' || (b + 1) AS chunk_id, 'Code from src/f' || doc_id || '.py (text) lines ' || (b + 1) || '-' || least(b + 100, len(x)) AS search_text FROM (SELECT doc_id, x, unnest(range(0, greatest(len(x) - 21, 0) + 1, 80)) AS b FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents))")
def chk02_fallback_chunks(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("src/f"), "doc_id", F.lit(".py")).alias("relative_path"), F.lit("text").alias("language"), F.col("text").alias("content"))
    return chunking.fallback_chunks(d).select(F.regexp_extract("relative_path", r"(\d+)", 1).cast("long").alias("doc_id"), "chunk_id", "search_text")
