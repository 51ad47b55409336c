"""The registry of queries over the standard tables, with the SQL that states the same result.

Each query is named by the operators that it exercises. A query runs over its whole tables; in searches the queries are the
rows whose id is divisible by QUERY_STEP.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verilume.functions import text as tx
from verilume.operators import answers, audit, chunking, retrieval, state, structure, symbols
from verilume.plans import sql

QUERY_STEP = 20
_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(fn):
        _queries[fn.__name__] = fn
        if oracle:
            _sql[fn.__name__] = oracle
        return fn

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; texts in fewer splits than there are cores are dealt out to all of them (a large table has more and stays as it is)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in ("documents", "pages") and df.rdd.getNumPartitions() < cores else df


def asked(spark: SparkSession, sf_dir: str, name: str, key: str, text: str) -> DataFrame:
    """The rows of a table that are queries."""
    return read(spark, sf_dir, name).filter(F.col(key) % QUERY_STEP == 0).select(F.col(key).alias("query_id"), F.col(text).alias("query" if text == "text" else text))


# Text functions


@query(f"SELECT doc_id, t AS term, count(*) AS tf FROM (SELECT doc_id, unnest({sql.lexical_tokens('text')}) AS t FROM documents) GROUP BY ALL")
def lex01_tokens(spark, sf_dir):
    return retrieval.postings(read(spark, sf_dir, "documents"))


@query(f"SELECT doc_id, {sql.redacted('text')} AS redacted FROM documents")
def sec01_redaction(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", tx.redacted("text").alias("redacted"))


@query("SELECT event_id, 'Operation failed: ' || CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in tx.SAFE_MESSAGES.items()) + " ELSE 'An unexpected error occurred' END AS message FROM events")
def sec02_safe_messages(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", tx.safe_message("event_type").alias("message"))


@query(r"SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS code_hash FROM documents")
def set06_code_hash(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", tx.code_hash("text").alias("code_hash"))


@query(r"SELECT doc_id, left(trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', '', 'g'), '\s+', ' ', 'g')), 100) AS claim_key FROM documents")
def clm05_claim_key(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", tx.claim_key("text").alias("claim_key"))


@query(r"SELECT doc_id, n_lines, tokens, sentences, lower(trim(regexp_replace(first_line, '\d+', '#', 'g'))) AS layout FROM (SELECT doc_id, length(text) - length(replace(text, chr(10), '')) + 1 AS n_lines, length(text) // 4 AS tokens, length(regexp_replace(text, '[.!?]\s+', chr(1), 'g')) - length(replace(regexp_replace(text, '[.!?]\s+', chr(1), 'g'), chr(1), '')) + 1 AS sentences, split_part(text, chr(10), 1) AS first_line FROM documents)")
def chk08_doc02_text_shape(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", tx.line_count("text").cast("long").alias("n_lines"), tx.token_estimate("text").cast("long").alias("tokens"), F.size(tx.sentences("text")).cast("long").alias("sentences"), tx.layout_key(F.substring_index("text", "\n", 1)).alias("layout"))


_PATH = "regexp_replace(url, '^https?://', '') || CASE page_id % 5 WHEN 0 THEN '/main.py' WHEN 1 THEN '/src/App.TSX' WHEN 2 THEN '/node_modules/x.js' WHEN 3 THEN '/README' ELSE '/lib/util.rs' END"


def _paths(spark, sf_dir):
    suffix = F.element_at(F.array(*[F.lit(x) for x in ("/main.py", "/src/App.TSX", "/node_modules/x.js", "/README", "/lib/util.rs")]), (F.col("page_id") % 5 + 1).cast("int"))
    return read(spark, sf_dir, "pages").select("page_id", F.concat(F.regexp_replace("url", "^https?://", ""), suffix).alias("path"))


@query(f"SELECT page_id, coalesce(map_extract_value(MAP {{{', '.join(f'{chr(39)}{k}{chr(39)}: {chr(39)}{v}{chr(39)}' for k, v in tx.LANGUAGES.items())}}}, ext), 'text') AS language, NOT list_has_any(string_split(path, '/'), [{', '.join(repr(d) for d in tx.SKIPPED_DIRS)}]) AND list_contains([{', '.join(repr(k) for k in tx.LANGUAGES)}], ext) AS included FROM (SELECT page_id, path, lower(regexp_extract(regexp_extract(path, '[^/]*$'), '^.+(\\.[^.]+)$', 1)) AS ext FROM (SELECT page_id, {_PATH} AS path FROM pages))")
def src02_src03_code_files(spark, sf_dir):
    return _paths(spark, sf_dir).select("page_id", tx.language("path").alias("language"), tx.is_code_file("path").alias("included"))


@query("""WITH p AS (SELECT list_filter(string_split(split_part(regexp_replace(url, '^https?://', ''), '?', 1), '/'), lambda x: x <> '') AS p FROM pages),
e AS (SELECT p, unnest(range(1, len(p) + 1)) AS d FROM p WHERE len(p) > 0)
SELECT parent, name, is_dir, count(*) AS files FROM (SELECT array_to_string(p[1:d - 1], '/') AS parent, p[d] AS name, d < len(p) AS is_dir FROM e) GROUP BY ALL""")
def src14_tree(spark, sf_dir):
    return state.tree(read(spark, sf_dir, "pages").select(F.substring_index(F.regexp_replace("url", "^https?://", ""), "?", 1).alias("path")))


@query("SELECT item_id, doc_id, array_to_string((string_split(text, chr(10)))[greatest(1, 3 - 1):3 + 1], chr(10)) AS context FROM (SELECT doc_id AS item_id, doc_id, text FROM documents)")
def src15_cat08_context(spark, sf_dir):
    d = read(spark, sf_dir, "documents").withColumn("line", F.lit(3))
    return d.select(F.col("doc_id").alias("item_id"), "doc_id", chunking.context_lines(d, "line", 1, "text").alias("context"))


# Structure and chunks


@query("SELECT doc_id, seq, paragraph, start_idx FROM (SELECT doc_id, seq - 1 AS seq, p AS paragraph, coalesce(sum(length(p) + 2) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_idx FROM (SELECT doc_id, unnest(string_split(replace(text, '. ', '.' || chr(10) || chr(10)), chr(10) || chr(10))) AS p, generate_subscripts(string_split(replace(text, '. ', '.' || chr(10) || chr(10)), chr(10) || chr(10)), 1) AS seq FROM documents)) WHERE trim(paragraph) <> ''")
def doc14_paragraphs(spark, sf_dir):
    return structure.text_paragraphs(read(spark, sf_dir, "documents").withColumn("text", F.replace(F.col("text"), F.lit(". "), F.lit(".\n\n"))))


_TURN_SECTIONS = """WITH t AS (SELECT conv_id AS paper_id, turn AS seq, text, role, sum(CASE WHEN role = 'user' OR turn = first THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS section, turn = first AND role <> 'user' AS body FROM (SELECT *, min(turn) OVER (PARTITION BY conv_id) AS first FROM conversations)),
s AS (SELECT paper_id, section, CASE WHEN bool_or(body) THEN 'Body' ELSE max(CASE WHEN role = 'user' THEN trim(text) END) END AS name, trim(string_agg(CASE WHEN role <> 'user' THEN text END, chr(10) ORDER BY seq)) AS content FROM t GROUP BY ALL)
SELECT paper_id, section::BIGINT AS section, name, content, coalesce(sum(length(content) + 1) OVER (PARTITION BY paper_id ORDER BY section ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_idx FROM s WHERE content <> ''"""


@query(_TURN_SECTIONS)
def doc11_doc12_sections(spark, sf_dir):
    t = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("paper_id"), F.col("turn").alias("seq"), F.lit(0).alias("page"), "text", F.when(F.col("role") == "user", "section_header").otherwise("body").alias("role"))
    return structure.with_offsets(structure.sections(t), "section", "content").select("paper_id", "section", "name", "content", "start_idx")


@query(f"SELECT doc_id, {sql.heading_role('first')} AS role, {sql.is_important('first')} AS important, {sql.section_tokens('first')} AS tokens FROM (SELECT doc_id, split_part(text, ' ', 1) || CASE doc_id % 6 WHEN 0 THEN ' Methods' WHEN 1 THEN ' Experimental results' WHEN 2 THEN ' references' WHEN 3 THEN ' Related work' WHEN 4 THEN '' ELSE ' 2.1 Training' END AS first FROM documents)")
def doc08_doc17_chk06_section_names(spark, sf_dir):
    more = F.element_at(F.array(*[F.lit(x) for x in (" Methods", " Experimental results", " references", " Related work", "", " 2.1 Training")]), (F.col("doc_id") % 6 + 1).cast("int"))
    d = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.substring_index("text", " ", 1), more).alias("first"))
    return d.select("doc_id", structure.heading_role("first").alias("role"), structure.is_important("first").alias("important"), chunking.section_tokens("first").alias("tokens"))


_WINDOWS = "WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents), s AS (SELECT doc_id, x, unnest(range(0, {last} + 1, {step})) AS b FROM l) SELECT doc_id, b // {step} AS chunk, b + 1 AS start_line, least(b + {size}, len(x)) AS end_line, array_to_string(x[b + 1:b + {size}], chr(10)) AS content FROM s"


@query(_WINDOWS.format(last="greatest(len(x) - 2 - 1, 0)", step=8, size=10))
def chk01_chk02_line_windows(spark, sf_dir):
    return chunking.line_windows(read(spark, sf_dir, "documents"), 10, 2).withColumns({c: F.col(c).cast("long") for c in ("chunk", "start_line", "end_line")})


@query(_WINDOWS.format(last="len(x) - 1", step=8, size=10))
def chk12_trailing_windows(spark, sf_dir):
    return chunking.line_windows(read(spark, sf_dir, "documents"), 10, 2, trailing=True).withColumns({c: F.col(c).cast("long") for c in ("chunk", "start_line", "end_line")})


_SNAP = "b + 500 - CASE WHEN contains(substr(text, b + 1, 500), '.') THEN strpos(reverse(substr(text, b + 1, 500)), '.') ELSE 9999 END"
_ENDS = f"(SELECT *, CASE WHEN b + 500 < length(text) AND {_SNAP} > b + 250 THEN {_SNAP} + 1 ELSE least(b + 500, length(text)) END AS e FROM w)"


@query(f"""WITH RECURSIVE w AS (SELECT doc_id, text, 0 AS chunk, 0::BIGINT AS b FROM documents WHERE text <> '' UNION ALL SELECT doc_id, text, chunk + 1, e - 100 FROM {_ENDS} WHERE e < length(text))
SELECT doc_id, chunk, b AS start_idx, e AS end_idx FROM {_ENDS} WHERE trim(substr(text, b + 1, e - b)) <> ''""")
def chk10_text_windows(spark, sf_dir):
    return chunking.text_windows(read(spark, sf_dir, "documents")).select("doc_id", "chunk", "start_idx", "end_idx")


# Retrieval

_Q_DOCS = f"SELECT item_id AS query_id, text AS query FROM benchmark WHERE item_id % {QUERY_STEP} = 0"
_BM25 = sql.bm25(_Q_DOCS, 40)
_VEC = sql.vector_search(f"SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id % {QUERY_STEP} = 0", 20)


@query(_BM25)
def lex02_lex03_bm25(spark, sf_dir):
    return retrieval.bm25(asked(spark, sf_dir, "benchmark", "item_id", "text"), read(spark, sf_dir, "documents"), 40)


@query(_VEC)
def vec03_vector_search(spark, sf_dir):
    return retrieval.vector_search(asked(spark, sf_dir, "embeddings", "vec_id", "embedding"), read(spark, sf_dir, "embeddings"), 20)


@query(sql.vector_search(f"SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id % {QUERY_STEP} = 0", 5, "label = 3"))
def vec04_filtered_search(spark, sf_dir):
    return retrieval.vector_search(asked(spark, sf_dir, "embeddings", "vec_id", "embedding"), read(spark, sf_dir, "embeddings"), 5, F.col("label") == 3)


@query()
def vec03_plane_index(spark, sf_dir):
    return retrieval.PlaneIndex(64).search(asked(spark, sf_dir, "embeddings", "vec_id", "embedding"), read(spark, sf_dir, "embeddings"), 20)


def _fusion_sql(w: tuple[float, float], k: int) -> str:
    return f"""WITH d AS ({_VEC}), x AS ({_BM25}), b AS (SELECT coalesce(d.query_id, x.query_id) AS query_id, coalesce(d.vec_id, x.doc_id) AS doc_id, d.rank AS dense_rank, x.rank AS lexical_rank FROM d FULL OUTER JOIN x ON d.query_id = x.query_id AND d.vec_id = x.doc_id),
s AS (SELECT *, round(coalesce({w[0]} / (60 + dense_rank), 0) + coalesce({w[1]} / (60 + lexical_rank), 0), 9) AS score FROM b)
SELECT query_id, doc_id, score, dense_rank, lexical_rank, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, dense_rank NULLS LAST, lexical_rank NULLS LAST, doc_id) AS rank FROM s) WHERE rank <= {k}"""


def _hybrid(spark, sf_dir, weights, k):
    dense = vec03_vector_search(spark, sf_dir).withColumnRenamed("vec_id", "doc_id")
    return retrieval.hybrid_search(dense, lex02_lex03_bm25(spark, sf_dir), k, "doc_id", weights)


@query(_fusion_sql((0.6, 0.4), 20))
def fus01_fus02_hybrid(spark, sf_dir):
    return _hybrid(spark, sf_dir, (0.6, 0.4), 20)


@query(_fusion_sql((0.45, 0.55), 10))
def fus03_paper_hybrid(spark, sf_dir):
    return _hybrid(spark, sf_dir, (0.45, 0.55), 10)


_FUS04 = f"WITH v AS ({_VEC}) SELECT query_id % 3 AS query_id, vec_id, round(least(1.0, max(similarity) * (1 + 0.1 * (count(*) - 1))), 6) AS similarity, count(*) AS hits FROM v GROUP BY query_id % 3, vec_id"


@query(_FUS04)
def fus04_multi_query(spark, sf_dir):
    hits = vec03_vector_search(spark, sf_dir).withColumn("query_id", F.col("query_id") % 3)
    return retrieval.multi_query_union(hits, "vec_id")


_PHRASES = f"SELECT item_id AS query_id, u AS phrase_no, lower((string_split(text, chr(10)))[u]) AS p FROM (SELECT item_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u FROM benchmark) WHERE length((string_split(text, chr(10)))[u]) >= 8"
_TXT01 = f"SELECT query_id, doc_id, min(phrase_no) AS phrase_no, 0.95::DOUBLE AS similarity FROM (SELECT query_id, phrase_no, doc_id, row_number() OVER (PARTITION BY query_id, phrase_no ORDER BY doc_id) AS n FROM documents, ({_PHRASES}) WHERE contains(lower(text), p)) WHERE n <= 3 GROUP BY query_id, doc_id"


@query(_TXT01)
def txt01_phrase_search(spark, sf_dir):
    q = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.posexplode(F.split("text", "\n")).alias("n", "phrase")).withColumn("phrase_no", (F.col("n") + 1).cast("long"))
    return retrieval.phrase_search(q, read(spark, sf_dir, "documents"))


@query(f"""WITH h AS (SELECT query_id, vec_id AS doc_id, similarity FROM ({_VEC})), d AS ({_TXT01}), b AS (SELECT coalesce(h.query_id, d.query_id) AS query_id, coalesce(h.doc_id, d.doc_id) AS doc_id, least(1.0, greatest(coalesce(h.similarity, d.similarity), coalesce(d.similarity, h.similarity))) AS similarity FROM h FULL OUTER JOIN d ON h.query_id = d.query_id AND h.doc_id = d.doc_id)
SELECT query_id, doc_id, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, doc_id) AS rank FROM b) WHERE rank <= 20""")
def fus05_merge_direct(spark, sf_dir):
    hits = vec03_vector_search(spark, sf_dir).withColumnRenamed("vec_id", "doc_id")
    return retrieval.merge_direct(hits, txt01_phrase_search(spark, sf_dir), 20, "doc_id")


_TOK = lambda c: f"list_distinct({sql.lexical_tokens(c)})"


@query(f"""WITH h AS (SELECT b.query_id, b.doc_id, b.score AS original_similarity, q.query, d.text FROM ({_BM25}) b JOIN ({_Q_DOCS}) q ON b.query_id = q.query_id JOIN documents d ON d.doc_id = b.doc_id WHERE b.rank <= 20),
s AS (SELECT query_id, doc_id, original_similarity, round(coalesce(len(list_intersect({_TOK('query')}, {_TOK('text')})) / nullif(len(list_distinct(list_concat({_TOK('query')}, {_TOK('text')}))), 0), 0), 6) AS similarity FROM h)
SELECT query_id, doc_id, original_similarity, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, doc_id) AS rank FROM s) WHERE rank <= 5""")
def rrk01_rerank(spark, sf_dir):
    q, d = asked(spark, sf_dir, "benchmark", "item_id", "text"), read(spark, sf_dir, "documents").select("doc_id", "text")
    hits = lex02_lex03_bm25(spark, sf_dir).withColumnRenamed("score", "similarity").join(F.broadcast(q), "query_id").join(d, "doc_id")
    return retrieval.rerank(hits, 5, "doc_id").select("query_id", "doc_id", "original_similarity", "similarity", "rank")


@query(f"SELECT * FROM ({_BM25}) WHERE score >= 20")
def flt01_threshold(spark, sf_dir):
    return retrieval.at_least(lex02_lex03_bm25(spark, sf_dir), 20)


def _spans(spark, sf_dir):
    line = read(spark, sf_dir, "lineitem")
    return line.select((F.col("l_orderkey") % 50).alias("passage_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("idx"), F.col("l_extendedprice").alias("top"), F.col("l_quantity").cast("long").alias("score"))


@query("""WITH s AS (SELECT DISTINCT l_orderkey % 50 AS passage_id, l_orderkey * 10 + l_linenumber AS idx, l_extendedprice AS top, l_quantity::BIGINT AS score FROM lineitem),
a AS (SELECT *, count(*) OVER (PARTITION BY passage_id) AS n, row_number() OVER (PARTITION BY passage_id ORDER BY top, idx, score) AS place, sum(score) OVER w AS total, max(top) OVER w AS bottom FROM s WINDOW w AS (PARTITION BY passage_id ORDER BY top, idx, score ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)),
b AS (SELECT passage_id, arg_max({'t': top, 'b': bottom}, {'v': round(total / (1 + (bottom - top) / 100), 9), 'p': -place}) AS w FROM a WHERE place + 9 <= n OR place = 1 GROUP BY passage_id)
SELECT a.passage_id, idx, top, score FROM a JOIN b USING (passage_id) WHERE n <= 3 OR top BETWEEN w.t - 30 AND w.b + 30""")
def loc02_best_cluster(spark, sf_dir):
    return retrieval.best_cluster(_spans(spark, sf_dir).distinct())


@query(r"""WITH stop AS (SELECT unnest(string_split('this that with from have been were they their which these those also such than then when where what will would could should into over more most only other some about between through using used each both', ' ')) AS w),
p AS (SELECT DISTINCT item_id AS passage_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS w FROM benchmark),
s AS (SELECT DISTINCT doc_id % 40 AS passage_id, doc_id AS idx, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS w FROM documents)
SELECT passage_id, idx, 0.0::DOUBLE AS top, count(*) AS score FROM s JOIN p USING (passage_id, w) WHERE length(w) >= 4 AND w NOT IN (SELECT w FROM stop) GROUP BY passage_id, idx""")
def loc01_span_scores(spark, sf_dir):
    spans = read(spark, sf_dir, "documents").select((F.col("doc_id") % 40).alias("passage_id"), F.col("doc_id").alias("idx"), F.lit(0.0).alias("top"), "text")
    return retrieval.span_scores(spans, read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("passage_id"), "text"))


@query("SELECT doc_id, regexp_replace(text, '(?i)(tion)', '<mark>\\1</mark>', 'g') AS marked FROM documents")
def loc03_highlight(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", retrieval.highlighted("text", "tion").alias("marked"))


# Audit

_SNIPPETS = [
    "model = nn.Sequential()\noptimizer = torch.optim.Adam(model.parameters(), lr=1e-3)\nbatch_size = 32\nepochs = 10",
    "scaler = StandardScaler()\nX = scaler.fit_transform(X)\nX_train, X_test = train_test_split(X, test_size=0.2)\naccuracy_score(y_train, p)",
    "We train for 20 epochs with a learning rate of 0.01, batch size 64 and dropout of 0.5.",
    "kf = KFold(n_splits=5)\nset_seed(42)\nmodel.eval()\npath = '/home/user/data.csv'",
    "Weight decay is set to 1e-4; we use 10-fold cross-validation.",
]


def _code(spark, sf_dir):
    """Documents with a snippet of code or prose behind each."""
    more = F.element_at(F.array(*[F.lit(s) for s in _SNIPPETS]), (F.col("doc_id") % len(_SNIPPETS) + 1).cast("int"))
    return read(spark, sf_dir, "documents").select("doc_id", F.concat(F.col("text"), F.lit("\n"), more).alias("content"))


_CODE = "SELECT doc_id, text || chr(10) || CASE doc_id % 5 " + " ".join("WHEN {} THEN '{}'".format(i, s.replace("'", "''")) for i, s in enumerate(_SNIPPETS)) + " END AS content FROM documents"


@query(sql.pattern_claims(_CODE))
def clm01_pattern_claims(spark, sf_dir):
    return audit.pattern_claims(_code(spark, sf_dir), text="content").select("doc_id", "seq", "claim_type", "text", F.array_join("keywords", "|").alias("keywords"), "expected_value")


@query(f"WITH c AS ({sql.pattern_claims(_CODE)}) SELECT doc_id, seq, claim_type, text, expected_value FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, claim_type, expected_value ORDER BY len(string_split(keywords, '|')) DESC, length(text) DESC, seq) AS n FROM c) WHERE n = 1")
def clm04_distinct_claims(spark, sf_dir):
    return audit.distinct_claims(audit.pattern_claims(_code(spark, sf_dir), text="content")).select("doc_id", "seq", "claim_type", "text", "expected_value")


@query(sql.code_values(_CODE))
def beh01_code_values(spark, sf_dir):
    return _code(spark, sf_dir).select("doc_id", F.explode(audit.code_values("content")).alias("key", "value"))


@query(sql.behaviour_type(_CODE))
def beh02_behaviour_type(spark, sf_dir):
    return _code(spark, sf_dir).select("doc_id", audit.behaviour_type("content").alias("behavior_type"))


def _behaviours(spark, sf_dir):
    """Of every window of lines of the whole documents."""
    name = F.concat(F.lit("c"), F.col("doc_id"), F.lit(":"), "start_line")
    path = F.concat(F.lit("src/run"), F.col("doc_id"), F.lit(".py"))
    chunks = chunking.line_windows(_code(spark, sf_dir), text="content").select("doc_id", name.alias("chunk_id"), path.alias("relative_path"), "content", F.struct("doc_id", "chunk").alias("seq"))
    return audit.behaviours(chunks)


@query(sql.lint_flags(_CODE))
def cat01_cat03_lint_flags(spark, sf_dir):
    return audit.lint_flags(_code(spark, sf_dir), names=sql.FLAT_RULES).select("doc_id", "pattern_type", "category", "tier")


def _claims(spark, sf_dir):
    c = audit.pattern_claims(_code(spark, sf_dir), text="content")
    return c.filter(f"doc_id % {QUERY_STEP} = 0").withColumn("claim_id", F.col("doc_id") * 100 + F.col("seq"))


_NUM = lambda c: f"try_cast(regexp_extract(lower({c}), '(\\d+\\.?\\d*(?:e[+-]?\\d+)?)', 1) AS DOUBLE)"


@query(f"SELECT id, CASE WHEN lower(trim(e)) = lower(trim(a)) THEN true WHEN x IS NOT NULL AND y IS NOT NULL THEN coalesce(x = y OR (x <> 0 AND abs(x - y) / abs(x) <= 0.01), false) ELSE false END AS ok FROM (SELECT *, {_NUM('e')} AS x, {_NUM('a')} AS y FROM (SELECT l_orderkey * 10 + l_linenumber AS id, l_quantity::BIGINT::VARCHAR || ' units' AS e, CASE WHEN l_linenumber % 2 = 0 THEN (l_quantity::BIGINT)::VARCHAR ELSE 'about ' || (l_quantity::BIGINT + 1)::VARCHAR END AS a FROM lineitem))")
def aln05_aln06_values_match(spark, sf_dir):
    q = F.col("l_quantity").cast("long")
    d = read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.concat(q.cast("string"), F.lit(" units")).alias("e"), F.when(F.col("l_linenumber") % 2 == 0, q.cast("string")).otherwise(F.concat(F.lit("about "), (q + 1).cast("string"))).alias("a"))
    return d.select("id", audit.values_match("e", "a").alias("ok"))


@query(sql.overall_score())
def agg01_agg05_score(spark, sf_dir):
    l = read(spark, sf_dir, "labels")
    r = l.select((F.col("doc_id") % 50).alias("audit"), F.when(F.col("quality") == 1, "aligned").when(F.col("doc_id") % 3 == 0, "unverified").otherwise("misaligned").alias("status"), (F.col("doc_id") % 3 + 2).cast("int").alias("tier"))
    w = l.filter("toxic = 1").select((F.col("doc_id") % 60).alias("audit"), (F.col("doc_id") % 4 + 1).cast("int").alias("tier"), F.when(F.col("doc_id") % 2 == 0, "data_leakage").otherwise("reproducibility").alias("category"))
    return audit.overall_score(r, w, "audit")


@query("SELECT CASE WHEN grouping(event_type) = 0 THEN event_type END AS category, CASE WHEN grouping(tier) = 0 THEN tier END AS tier, count(*) AS n FROM (SELECT event_type, (user_id % 4 + 1)::INTEGER AS tier FROM events) GROUP BY GROUPING SETS ((event_type), (tier))")
def agg02_counts(spark, sf_dir):
    return audit.warning_counts(read(spark, sf_dir, "events").select(F.col("event_type").alias("category"), (F.col("user_id") % 4 + 1).cast("int").alias("tier")))


def _audit_pair(spark, sf_dir):
    d = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("pattern_type"), F.col("l_partkey").cast("string").alias("relative_path"), F.col("l_linenumber").alias("line_start"), (F.col("l_suppkey") % 10 == 0).alias("suppressed"), "l_orderkey")
    return d.filter("l_orderkey % 3 < 2").drop("l_orderkey"), d.filter("l_orderkey % 3 > 0").drop("l_orderkey")


@query("""WITH d AS (SELECT l_returnflag AS pattern_type, l_partkey::VARCHAR AS relative_path, l_linenumber AS line_start, l_orderkey % 3 AS m FROM lineitem WHERE l_suppkey % 10 <> 0), a AS (SELECT * FROM d WHERE m < 2), b AS (SELECT * FROM d WHERE m > 0)
SELECT pattern_type, relative_path, line_start, 'new' AS change FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.pattern_type = b.pattern_type AND a.relative_path = b.relative_path AND a.line_start = b.line_start)
UNION ALL SELECT pattern_type, relative_path, line_start, 'resolved' FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.pattern_type = b.pattern_type AND a.relative_path = b.relative_path AND a.line_start = b.line_start)""")
def set01_warning_changes(spark, sf_dir):
    return audit.warning_changes(*_audit_pair(spark, sf_dir))


_WARN = "SELECT event_id, event_type AS category, 'p' || user_id % 7 AS pattern_type, 'f' || user_id % 20 AS relative_path, (event_id % 30)::INTEGER AS line_start, props AS code_snippet FROM events"
_RECORDS = [("global", "click.p1", None, None, None, "type", None, 1), ("codebase", None, "#", None, None, "hash", "cb", 2), ("codebase", "view.p2", None, "f3", 5, "place", "cb", 3), ("codebase", "view.p3", None, "f3", 5, "other", "no", 4)]


@query(f"""WITH w AS ({_WARN}), h AS (SELECT md5('{{"k": 1}}') AS h)
SELECT event_id, (category = 'click' AND pattern_type = 'p1') OR md5(trim(regexp_replace(code_snippet, '\\s+', ' ', 'g'))) = h OR (category = 'view' AND pattern_type = 'p2' AND relative_path = 'f3' AND line_start = 5) AS suppressed,
CASE WHEN category = 'click' AND pattern_type = 'p1' THEN 'type' WHEN md5(trim(regexp_replace(code_snippet, '\\s+', ' ', 'g'))) = h THEN 'hash' END AS suppression_reason FROM w, h""")
def set04_set05_suppression(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    w = e.select("event_id", F.col("event_type").alias("category"), F.concat(F.lit("p"), F.col("user_id") % 7).alias("pattern_type"), F.concat(F.lit("f"), F.col("user_id") % 20).alias("relative_path"), (F.col("event_id") % 30).cast("int").alias("line_start"), F.col("props").alias("code_snippet"))
    rec = spark.createDataFrame(_RECORDS, "scope string, warning_type string, code_hash string, file_path string, line_start int, user_reason string, codebase_hash string, seq int").withColumn("code_hash", F.when(F.col("code_hash") == "#", F.md5(F.lit('{"k": 1}'))))
    return audit.suppressed(w, rec, "cb").select("event_id", "suppressed", "suppression_reason")


@query("SELECT event_id, tier FROM (SELECT event_id, (user_id % 4 + 1)::INTEGER AS tier FROM events) WHERE tier <= 2")
def set07_min_tier(spark, sf_dir):
    return audit.at_most_tier(read(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 4 + 1).cast("int").alias("tier")), 2)


# State


@query("SELECT user_id, event_id, place FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events) WHERE place <= 20")
def srt02_srt04_latest(spark, sf_dir):
    return state.latest(read(spark, sf_dir, "events"), "user_id").select("user_id", "event_id", "place")


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events WHERE ts > TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 86400 SECONDS) WHERE place <= 500")
def cac02_live_entries(spark, sf_dir):
    return state.live(read(spark, sf_dir, "events"), F.lit("2024-01-15 12:00:00").cast("timestamp_ntz"), 86400, owner="user_id").select("user_id", "event_id")


_CACHE_Q = "SELECT item_id AS query_id, text AS query FROM benchmark"
_KEY = lambda c: f"md5(left(trim(regexp_replace(lower({c}), '\\s+', ' ', 'g')), 500))"


@query(f"""WITH q AS ({_CACHE_Q}), e AS (SELECT query_id, min(doc_id) AS seq FROM q JOIN documents ON {_KEY('query')} = {_KEY('text')} GROUP BY query_id)
SELECT * FROM e UNION ALL SELECT query_id, min(doc_id) FROM q, documents WHERE query_id NOT IN (SELECT query_id FROM e) AND length(query) >= 20 AND length(text) >= 20 AND (contains(lower(text), lower(query)) OR contains(lower(query), lower(text))) GROUP BY query_id""")
def cac03_cached_answers(spark, sf_dir):
    return state.cached_answer(read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), read(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), "text"))


@query("SELECT event_id, CASE WHEN user_id > 0 THEN (event_id % 100) * 100 // user_id ELSE 0 END::INTEGER AS percent FROM events")
def sta01_percent(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", state.percent(F.col("event_id") % 100, F.col("user_id")).alias("percent"))


@query("SELECT DISTINCT lang FROM documents")
def set11_languages(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("lang").distinct()


@query(r"SELECT event_id, regexp_extract(regexp_replace('Sure: ```json' || props || '``` done', '```(json)?', '', 'g'), '(?s)(\{.*\})', 1) AS part, try_cast(regexp_extract('snippet_' || user_id, '(\d+)$', 1) AS INTEGER) AS i FROM events")
def ans04_ans07_json_parts(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", answers.json_part(F.concat(F.lit("Sure: ```json"), "props", F.lit("``` done"))).alias("part"), answers.trailing_index(F.concat(F.lit("snippet_"), F.col("user_id").cast("string"))).alias("i"))


# Code


def _sources(spark, sf_dir):
    code = F.concat(F.lit("def load_row"), F.col("doc_id"), F.lit("(path, n: int) -> str:\n    \"\"\"Load a matrix row.\"\"\"\n    if n:\n        return db.query(path)\n    return path\n"))
    return read(spark, sf_dir, "documents").select(F.concat(F.lit("src/f"), F.col("doc_id"), F.lit(".py")).alias("relative_path"), F.lit("python").alias("language"), code.alias("content"))


@query("""SELECT 'src/f' || doc_id || '.py:load_row' || doc_id || ':1' AS chunk_id, 'function' AS symbol_type, 'path,n' AS parameters, 'str' AS return_type, 'conditional' AS return_behavior, 'simple' AS complexity_tier, true AS is_pure, 'db.query' AS calls,
'function load row ' || doc_id || ' in python file src/f' || doc_id || '.py. implements linear algebra. takes 2 parameters (path, n) and returns str. contains conditional logic, is a pure function. simple complexity. documentation: Load a matrix row.' AS search_text FROM documents""")
def chk03_ast_symbols(spark, sf_dir):
    d = symbols.described(symbols.symbols(_sources(spark, sf_dir)))
    return d.select("chunk_id", "symbol_type", F.array_join("parameters", ",").alias("parameters"), "return_type", "return_behavior", "complexity_tier", "is_pure", F.array_join("external_calls", ",").alias("calls"), "search_text")


@query()
def chk04_symbol_chunks(spark, sf_dir):
    return symbols.symbol_chunks(_sources(spark, sf_dir))


@query("SELECT doc_id, 'load row ' || doc_id AS names, 'Load a matrix row' AS said FROM documents")
def c2q05_c2q06_names(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("def load_row"), F.col("doc_id"), F.lit("(path):\n    \"\"\"Load a matrix row.\"\"\"\n")).alias("code"))
    return d.select("doc_id", F.array_join(tx.definition_names("code"), ";").alias("names"), tx.first_sentence(tx.doc_comments("code")).alias("said"))


@query()
def c2q01_c2q08_search_queries(spark, sf_dir):
    return _code(spark, sf_dir).select("doc_id", tx.search_query("content").alias("query"), F.array_join(tx.phrases("content"), "|").alias("phrases"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search: BM25 and cosine neighbours, fused by reciprocal rank."""
    return fus01_fus02_hybrid(spark, sf_dir)


from verilume.plans import catalog_audit, catalog_papers  # noqa: E402, F401  (they register their queries)
