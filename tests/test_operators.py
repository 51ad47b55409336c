"""Operators against row-by-row definitions on small fixtures."""

import re

import pytest
from pyspark.sql import functions as F

from verilume.functions import text as tx
from verilume.operators import answers, audit, chunking, retrieval, state, structure, symbols
from verilume.plans import plugins
from verilume.sources import files
from verilume.streaming import ingest

NAMES = {
    "getUserById": "get user by id", "HTTPResponse": "http response", "get_user_by_id": "get user by id", "MAX_RETRY_COUNT": "max retry count", "get_userById": "get user by id",
    "parseJSON": "parse json", "XMLHTTPRequest": "xmlhttp request", "IOError": "io error", "getUser2": "get user 2", "parse3DModel": "parse 3 d model", "_private": "private",
    "__dunder__": "dunder", "": "", "ID": "id",
}


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr.alias("y")).first().y


def test_identifier_words(spark):
    d = spark.createDataFrame(list(NAMES.items()), "n string, w string")
    assert d.filter(tx.readable(tx.identifier_words("n")) != F.col("w")).count() == 0


def test_lexical_tokens_repeat_snake_parts(spark):
    assert one(spark, "the window_partition getUser É_1", tx.lexical_tokens("x")) == ["window_partition", "window", "partition", "window", "partition", "getuser", "get", "user", "é_1", "é", "1", "é", "1"]


def test_redaction(spark):
    said = 'api_key = "abcdefghij0123456789" password: hunter2 Bearer a.b-c token=short'
    assert one(spark, said, tx.redacted("x")) == 'api_key = "***REDACTED*** password: ***REDACTED*** Bearer ***REDACTED*** token=short'


def test_bm25_cuts_before_it_drops(spark):
    docs = spark.createDataFrame([(1, "apple pear"), (2, "apple"), (3, "plum"), (4, "")], "doc_id long, text string")
    q = spark.createDataFrame([(7, "pear pear apple"), (8, "nothing")], "query_id long, query string")
    got = retrieval.bm25(q, docs, 1).collect()
    assert [(r.query_id, r.doc_id, r["rank"]) for r in got] == [(7, 1, 1)]


def test_fusion_prefers_the_dense_list_in_ties(spark):
    d = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query_id long, id string, rank int")
    x = spark.createDataFrame([(1, "c", 1), (1, "b", 2)], "query_id long, id string, rank int")
    got = retrieval.reciprocal_rank_fusion(d, x, 10, "id", (0.5, 0.5)).orderBy("rank").collect()
    assert [r.id for r in got] == ["b", "a", "c"]
    assert got[0].score == pytest.approx(1 / 62, abs=1e-9)
    assert [r.id for r in retrieval.hybrid_search(d, x.limit(0), 10, "id").orderBy("rank").collect()] == ["a", "b"]


def test_plane_index_recall(spark):
    import random

    rng = random.Random(1)
    v = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(16)]) for i in range(300)], "vec_id long, embedding array<double>")
    q = v.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    exact, near = retrieval.vector_search(q, v, 10), retrieval.PlaneIndex(16).search(q, v, 10)
    assert exact.join(near, ["query_id", "vec_id"], "left_semi").count() >= 0.9 * exact.count()


@pytest.mark.parametrize(("queries", "bucketed"), [(65_536, 8_192), (3, 16)])
def test_plane_index_equals_its_buckets(spark, monkeypatch, queries, bucketed):
    """Zero vectors, copies, repeated rows, ties, null keys and vectors; queries in one pass and in several. No pair of vectors is a row of a join."""
    import numpy as np

    monkeypatch.setattr(retrieval, "QUERIES", queries)
    monkeypatch.setattr(retrieval, "BUCKETED", bucketed)
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(120)]
    rows += [(200 + i, rows[7][1]) for i in range(15)] + [(300, [0.0] * 8), (301, None), (None, rows[8][1]), rows[20], rows[20], rows[20]]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)
    q = spark.createDataFrame([r for r in rows if r[0] is not None and r[0] % 10 in (0, 7)][:24], "query_id long, embedding array<double>").distinct()
    index = retrieval.PlaneIndex(8, tables=3, bits=4)
    assert index.index(v).count() == 3 * sum(e is not None for _, e in rows)
    codes = lambda e: (np.array(e) @ index.planes >= 0).reshape(3, 4)
    want = []
    for i, e in {r.query_id: r.embedding for r in q.collect()}.items():
        if e is None:
            continue
        near = set()
        for j, f in rows:
            if f is not None and ((codes(e) != codes(f)).sum(axis=1) <= 1).any():
                size = np.linalg.norm(e) * np.linalg.norm(f)
                near.add((j, round(float(np.dot(e, f) / size), 6) if size else None))
        order = sorted(near, key=lambda x: (x[1] is None, -(x[1] or 0), x[0] is not None, x[0] or 0))[:5]
        want += [(i, rank, *x) for rank, x in enumerate(order, 1)]
    found = index.search(q, v, 5)
    got = sorted((r.query_id, r.rank, r.vec_id, None if r.similarity is None else round(r.similarity, 6)) for r in found.collect())
    assert got == sorted(want, key=lambda x: x[:2])
    assert "Generate" not in found._jdf.queryExecution().toString()


def test_plans(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    phrases = spark.createDataFrame([(1, 1, "long phrase")], "query_id long, phrase_no long, phrase string")
    plan = retrieval.phrase_search(phrases, docs)._jdf.queryExecution().toString()
    assert "BroadcastNestedLoopJoin" in plan and "CartesianProduct" not in plan


def test_pack_section():
    text = "\n\n".join(f"Para {i}. " + "word " * 60 for i in range(12))
    got = list(chunking.pack_section(text, 200))
    assert len(got) > 1 and got[0][0] == 0
    assert all(b[0] == a[1] for a, b in zip(got, got[1:], strict=False))
    assert got[1][2].startswith(got[0][2].split("\n\n")[-1][: chunking.OVERLAP_CHARS].strip()[:50])
    assert list(chunking.pack_section("short", 10)) == [(0, 5, "short")] and not list(chunking.pack_section("", 10))


def test_snapped_windows_advance():
    text = "".join("word. " if i % 17 == 0 else "word " for i in range(900))
    got = list(chunking.snapped_windows(text, 500, 100, (".",)))
    assert got[0][0] == 0 and got[-1][1] == len(text)
    assert all(b[0] == a[1] - 100 for a, b in zip(got, got[1:], strict=False))
    assert list(chunking.snapped_windows("", 500, 100, (".",))) == []


def test_symbol_chunks(spark):
    big = "def big():\n" + "".join(f"    value_{i} = {i} + 1\n" for i in range(500))
    rows = [("a.py", "python", "class A:\n    def m(self, x):\n        return x\n"), ("b.py", "python", big), ("c.txt", "text", "x\n" * 50), ("d.py", "python", "def broken(:\n")]
    got = symbols.symbol_chunks(spark.createDataFrame(rows, "relative_path string, language string, content string")).collect()
    by = {p: [r for r in got if r.relative_path == p] for p, *_ in rows}
    assert {r.chunk_id for r in by["a.py"]} == {"a.py:A:1", "a.py:A.m:2"}
    parts = sorted(by["b.py"], key=lambda r: r.start_line)
    assert all(r.is_sub_chunk and r.parent_chunk_id == "b.py:big:1" and len(r.content) <= 6000 for r in parts) and len(parts) > 1
    assert parts[1].start_line == parts[0].end_line + 1 and parts[1].content.startswith("# Context: def big()")
    assert {r.symbol_type for r in by["c.txt"] + by["d.py"]} == {"unknown"}


@pytest.mark.parametrize(
    ("path", "language", "source", "want"),
    [
        ("x.js", "javascript", "function f(a) {\n return a }\nconst g = (b) => { return b }\nclass K { run() { this.x = 1 } }", {"f", "g", "K", "run"}),
        ("x.go", "go", "type S struct { a int }\nfunc (s *S) Get(k string) error { return nil }", {"S", "Get"}),
        ("x.rs", "rust", "struct P { x: i32 }\nimpl P { fn new() -> P { P{} } }\nfn main() { }", {"P", "new", "main"}),
        ("x.c", "c", "/* int no() {} */\nint add(int a) {\n return a; }", {"add"}),
        ("x.java", "java", "class F { int hi(int n) { return n; } }", {"F", "hi"}),
    ],
)
def test_braced_languages(path, language, source, want):
    assert {r[3] for r in symbols.braced_symbols(path, language, source)} == want


def test_values_match(spark):
    cases = [("0.01", "1e-2", True), ("5", "5.04", True), ("5", "6", False), ("Adam", "adam ", True), ("adam", "sgd", False), ("1e-4", "1e-3", False), (None, "1", True)]
    d = spark.createDataFrame(cases, "e string, a string, ok boolean")
    assert d.filter(audit.values_match("e", "a") != F.col("ok")).count() == 0
    assert one(spark, "1e-4", audit.number(F.col("x"), compat=True)) == 1.0


def test_lint_places_and_rules(spark):
    code = "x = 1\nscaler.fit_transform(X)\na, b = train_test_split(X)\n"
    got = audit.lint(spark.createDataFrame([("train.py", code), ("util.py", "import random.x")], "relative_path string, content string")).collect()
    found = {(r.relative_path, r.pattern_type): (r.line_start, r.line_end) for r in got}
    assert found[("train.py", "fit_transform_before_split")] == (2, 3)
    assert not any(p == "util.py" for p, _ in found)
    for rule in audit.rules.LINT:
        if rule.kind != "ctx":
            re.compile(rule.pattern)


def test_alignment(spark):
    b = spark.createDataFrame([("c1", "run.py", "lr = 0.1  # " + "x" * 60, 1), ("c2", "run.py", "batch_size = 32 " + "x" * 60, 2)], "chunk_id string, relative_path string, content string, seq int")
    c = spark.createDataFrame([(1, "Learning rate is 0.01", "hyperparameter", ["learning rate", "0.01"], "0.01"), (2, "Batch size is 32", "hyperparameter", ["batch size", "32"], "32"), (3, "We use dropout", "model_architecture", ["dropout"], "0.5")], "claim_id long, text string, claim_type string, keywords array<string>, expected_value string")
    got = {r.claim_id: (r.status, r.tier) for r in audit.aligned(c, audit.behaviours(b)).collect()}
    assert got == {1: ("misaligned", 2), 2: ("aligned", 4), 3: ("unverified", 3)}


@pytest.mark.parametrize("classes", [100_000, 7])
def test_matched_equals_all_pairs(spark, monkeypatch, classes):
    """Null and repeated fields, copies of claims, repeated words, ties, and claims that share an id; claims in one pass and in several."""
    import random

    monkeypatch.setattr(audit, "CLASSES", classes)
    rng = random.Random(3)
    pick = lambda *x: rng.choice(x)
    some = lambda n: " ".join(pick("Batch", "size", "batch", "lr", "Größe", "of", "dropout", "0.1", "the", "epochs", "32") for _ in range(n))
    c = [(i % 40, pick("a", "b", None), pick(some(4), some(2), "learning rate", "", None), pick([some(1), "Batch"], [], [None, "drop out"], None), pick("32", "0.1", "", None, "Batch size")) for i in range(45)]
    b = [(f"c{i}", i, pick("a", "b", None), pick(some(6), None), pick(some(30), "", None), pick({"batch_size": "32", "epochs": ""}, {"learning_rate": "0.1"}, {}, None)) for i in range(60)]
    claims = spark.createDataFrame(c * 2, "claim_id long, claim_type string, text string, keywords array<string>, expected_value string")
    behaviours = spark.createDataFrame(b, "chunk_id string, seq int, behavior_type string, description string, code_snippet string, extracted_values map<string,string>").repartition(3)
    key = {r.text: r.k for r in claims.select("text", audit.claim_value_key("text").alias("k")).collect()}
    want = {}
    for i, kind, text, words, value in c * 2:
        if text is None or words is None:
            continue
        words = [w.lower() for w in [*words, *re.split(r"\s+", text.lower())] if w is not None and len(w) >= 3]
        for chunk, seq, of, description, snippet, values in b:
            d, s = description or "", snippet or ""
            score = 10 * (of is not None and of == kind) + 20 * bool((values or {}).get(key[text])) + sum(2 * (w in d.lower()) + 3 * (w in s.lower()) for w in words)
            score += bool(value) * (5 * (str(value) in s) + 3 * (str(value) in d))
            if score > 0:
                want.setdefault(i, []).append((-score, seq, chunk))
    want = sorted((i, r, chunk, -minus) for i, found in want.items() for r, (minus, _, chunk) in enumerate(sorted(found)[:5], 1))
    assert sorted((r.claim_id, r.rank, r.chunk_id, r.score) for r in audit.matched(claims, behaviours).collect()) == want


def test_claims_are_scored_once_for_all_copies(spark):
    b = spark.createDataFrame([("c1", 1, "a", "lr", "lr = 0.1", {"lr": "0.1"})], "chunk_id string, seq int, behavior_type string, description string, code_snippet string, extracted_values map<string,string>")
    c = spark.range(50).selectExpr("id claim_id", "'a' claim_type", "'the lr' text", "array('lr') keywords", "'0.1' expected_value")
    plan = audit.matched(c, b)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert audit.matched(c, b).count() == 50


def test_behaviours_are_read_once(spark):
    """No pattern stands twice in the plan, none is without a literal that a text must have, and types are as without literals."""
    c = spark.createDataFrame([("c", "a.py", "lr = 0.1 " + "x" * 60), ("d", "a.py", "LR: 2 model.FIT( .fit( .fit (" + "x" * 60), ("e", "a.py", None)], "chunk_id string, relative_path string, content string")
    b = audit.behaviours(c)
    plan = b._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?iu)np") == 2  # its match, and whether that is empty
    assert all(audit.needles(p) for patterns in audit.rules.VALUES.values() for p in patterns)
    assert {"earning_rate", "lr"} in audit.needles(r"(?:learning_rate|lr)\s*=")
    assert sorted((r.chunk_id, r.extracted_values["learning_rate"], r.behavior_type) for r in b.collect()) == [("c", "0.1", "implementation_detail"), ("d", "2", "training_procedure")]


def test_behaviours_of_whole_documents(spark, tmp_path):
    from verilume.plans import catalog

    filler = "plain text of no meaning " * 20
    many = "\n".join([f"dropout = 0.9{i // 100}" if i % 100 == 50 else "plain line" for i in range(300)])
    rows = [(0, f"hidden_size = 77 {filler}", 2), (1, many, 2)]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t, _ in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = catalog.queries()["beh03_beh05_behaviours"](spark, str(tmp_path)).collect()
    said = lambda d: "".join(r.description for r in got if r.chunk_id.startswith(f"c{d}:"))
    assert "77" in said(0)
    assert len({r.chunk_id for r in got}) == len(got) and all(f"0.9{i}" in said(1) for i in range(3))


def test_sections_and_font_roles(spark):
    spans = lambda t, s, b=False: [(t, s, b)]
    rows = [("p", i, i // 4, 50.0, 100.0 + 20 * i, 300.0, 110.0 + 20 * i, t, spans(t, s, b)) for i, (t, s, b) in enumerate([("A Title", 16.0, True), ("Abstract", 12.0, True), ("We do it.", 10.0, False), ("1 Introduction", 12.0, True), ("Body text " * 20, 10.0, False), ("Methods", 12.0, True), ("More body " * 20, 10.0, False), ("References", 12.0, True), ("[1] X", 10.0, False)])]
    d = spark.createDataFrame(rows, "paper_id string, seq int, page int, x0 double, y0 double, x1 double, y1 double, text string, spans array<struct<text:string,size:double,bold:boolean>>")
    got = structure.parse_blocks(d).orderBy("section").collect()
    assert [r.name for r in got] == ["Abstract", "1 Introduction", "Methods"]
    assert got[0].content == "We do it." and got[1].start_idx == len("We do it.") + 1


def test_running_lines_go(spark):
    rows = [("p", 10 * p + i, p, 50.0, y, 300.0, y + 10, t) for p in range(4) for i, (t, y) in enumerate([(f"Journal {p}", 20.0), (f"text {p}", 300.0)])]
    d = spark.createDataFrame(rows, "paper_id string, seq int, page int, x0 double, y0 double, x1 double, y1 double, text string")
    assert {r.text for r in structure.without_running_lines(d).collect()} == {f"text {p}" for p in range(4)}


def test_answers(spark):
    hits = spark.createDataFrame([(1, "a", 0.9, 1), (1, "b", 1.5, 2), (2, "c", 0.4, 1)], "query_id long, id string, similarity double, rank int")
    said = spark.createDataFrame([(1, 'x ```json {"references": [{"id": "snippet_1", "reason": "r"}, {"index": "9"}]} ```'), (2, "none")], "query_id long, answer string")
    assert sorted((r.id, r.relevance, r.explanation) for r in answers.references(said, hits, "id").collect()) == [("b", 1.0, "r"), ("c", 0.4, None)]


def test_history_upsert(spark):
    h = spark.createDataFrame([("a", 1, "old"), ("b", 2, "x")], "id string, ts int, v string")
    n = spark.createDataFrame([("a", 9, "new"), ("c", 3, "y")], "id string, ts int, v string")
    assert [(r.id, r.ts, r.v) for r in state.upsert(h, n, "id", 2).collect()] == [("c", 3, "y"), ("b", 2, "x")]
    assert [(r.id, r.ts, r.v) for r in state.upsert(h, n, "id").collect()][-1] == ("a", 1, "new")


def test_files(spark, tmp_path):
    for name, content in {"src/a.py": b"x = 1\n\xff", "node_modules/b.js": b"no", "README": b"no", "c.RS": b"fn"}.items():
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(content)
    got = {r.relative_path: (r.language, r.line_count, r.content) for r in files.code_files(spark, str(tmp_path)).collect()}
    assert got == {"src/a.py": ("python", 2, "x = 1\n")}
    (tmp_path / "p.txt").write_bytes("é".encode("latin-1"))
    assert [r.content for r in files.paper_files(spark, str(tmp_path)).collect()] == ["é"]


def test_embedder_is_stable(spark):
    d = spark.createDataFrame([("a b",), ("a b",), ("",)], "text string")
    got = plugins.embedded(d).collect()
    norms = sorted(round(sum(x * x for x in r.embedding), 3) for r in got)
    assert norms == [0.0, 1.0, 1.0] and len({tuple(r.embedding) for r in got}) == 2
    assert plugins.completed(spark.createDataFrame([(1, "p")], "query_id long, prompt string")).first().answer is None


def test_stream_equals_batch(spark, tmp_path):
    d = spark.createDataFrame([(i, f"word{i} shared\nline") for i in range(6)], "doc_id long, text string")
    for i in range(2):
        d.filter(F.col("doc_id") % 2 == i).write.mode("append").parquet(str(tmp_path / "in"))
    q = ingest.start_indexing(ingest.document_stream(spark, str(tmp_path / "in"), "doc_id long, text string"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    index = retrieval.postings(d)
    for name, want in (("postings", index), ("lengths", retrieval.lengths(index))):
        got = spark.read.parquet(str(tmp_path / "out" / name)).select(want.columns)
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_parsed_answers(spark):
    said = spark.createDataFrame([(1, '```json [{"text": "t", "claim_type": "Nonsense", "expected_value": 3}, {"text": " "}] ```'), (2, None)], "query_id long, answer string")
    assert [tuple(r) for r in answers.parsed_claims(said).collect()] == [(1, 0, "t", "other", [], "3")]
    said = spark.createDataFrame([(1, '{"status": "Partial", "tier": "tier_2", "confidence": 3}'), (2, "no")], "query_id long, answer string")
    assert [tuple(r)[:4] for r in answers.parsed_verdicts(said).orderBy("query_id").collect()] == [(1, "misaligned", 2, 1.0), (2, "unverified", 4, 0.5)]


def test_fallback_and_records(spark):
    found = spark.createDataFrame([(1, "a", 10, 1)], "claim_id long, chunk_id string, score int, rank int")
    claims = spark.createDataFrame([(1,), (2,)], "claim_id long")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "query_id long, embedding array<double>")
    chunks = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.1, 1.0])], "chunk_id string, embedding array<double>")
    got = audit.with_fallback(found, claims, asked, chunks, 1).collect()
    assert sorted((r.claim_id, r.chunk_id) for r in got) == [(1, "a"), (2, "b")]
    w = spark.createDataFrame([("data_leakage", "r", "f.py", 3, "x  y")], "category string, pattern_type string, relative_path string, line_start int, code_snippet string")
    none = spark.createDataFrame([], "scope string, warning_type string, code_hash string, file_path string, line_start int, user_reason string, codebase_hash string, seq int")
    records = audit.with_record(none, w, "global", "fine")
    row = audit.suppressed(w, records).first()
    assert row.suppressed and row.suppression_reason == "fine"
    assert not audit.suppressed(w, audit.without_record(records, 1)).first().suppressed
    assert audit.with_record(none, w, "audit", "x").isEmpty()


def test_literals_of_patterns_are_needed():
    import random
    import re

    from verilume.operators import rules

    rng = random.Random(3)
    pieces = ["train_test_split(X, test_size=0.2)", ".fit(", "StandardScaler()", "KFold(n_splits=5)", "x = 1", "lr=0.1", "'lr': 3", "np.random.seed(4)", "\n", "LR = 2", "PCA()", "accuracy_score(y_train", "time", "softmax(x)", "CrossEntropyLoss", "epochs: 7", "'/home/me/x'"]
    patterns = [r.pattern for r in rules.LINT if r.kind != "ctx"] + [p for ps in rules.VALUES.values() for p in ps] + [p for *_, ps in rules.CLAIMS.values() for p in ps]
    hits = 0
    for _ in range(300):
        text = " ".join(rng.choices(pieces, k=6))
        for p in patterns:
            if re.search(p, text, re.I):
                hits += 1
                assert all(any(x in text.lower() for x in ways) for ways in audit.needles(p)), (p, text)
    assert hits > 500


def test_stored_index_answers_like_a_fresh_one(spark, tmp_path):
    d = spark.createDataFrame([(i, f"alpha word{i % 5} getUserName{i % 3} the beta") for i in range(40)] + [(None, "alpha")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "alpha word1"), (2, "user_name getUserName2"), (3, "nothing")], "query_id long, query string")
    index = retrieval.LexicalIndex(spark, str(tmp_path / "index"))
    assert not index.exists()
    index.write(d)
    want = {tuple(r) for r in retrieval.bm25(q, d, 5).collect()}
    assert index.exists() and {tuple(r) for r in index.search(q, 5).collect()} == want and want
    index.clear()
    assert not index.exists()


def test_plane_index_recall(spark):
    from verilume.plans import catalog

    exact = {(r.query_id, r.vec_id) for r in catalog.queries()["vec03_vector_search"](spark, "/root/testdata/sf0.01").collect()}
    found = {(r.query_id, r.vec_id) for r in catalog.queries()["vec03_plane_index"](spark, "/root/testdata/sf0.01").collect()}
    assert len(exact & found) >= 0.9 * len(exact)


def test_vector_search_with_ties_zeros_and_text_keys(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [2.0, 0.0]), ("c", [0.0, 0.0]), ("d", [0.0, 1.0]), ("e", None)], "vec_id string, embedding array<float>")
    q = spark.createDataFrame([(1, [3.0, 0.0]), (2, [0.0, 0.0])], "query_id long, embedding array<float>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.similarity) for r in retrieval.vector_search(q, v, 2).collect())
    assert got == [(1, 1, "a", 1.0), (1, 2, "b", 1.0), (2, 1, "a", None), (2, 2, "b", None)]


def test_contained_equals_nested_loop(spark):
    parts = ["is a Big", "x", "no, such", "one two three", "two", " a ", "e t"]
    texts = ["This is a big house", "one two three four", "onetwo three", "", "no, such luck", "abc"]
    p = spark.createDataFrame([(i, t.lower()) for i, t in enumerate(parts)], "i long, _p string")
    t = spark.createDataFrame([(i, t.lower()) for i, t in enumerate(texts)], "seq long, _t string")
    want = {(i, j) for i, a in enumerate(parts) for j, b in enumerate(texts) if a.lower() in b.lower()}
    assert {(r.i, r.seq) for r in retrieval.contained(p, t, "seq").collect()} == want
