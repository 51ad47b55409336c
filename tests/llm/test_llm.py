"""The ten operators and the pipeline's stages against brute force, round trips and held-out accuracy, and in odd cases: nulls in any
column, empty and long texts, ties, repeated rows, empty tables, extra columns with clashing names."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from verilume.llm import bpe, chat, common, decontaminate, html_text, language_model, minhash, quality_rules, sharding, textnum, toxicity
from verilume.llm.queries import tokenizer_path

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCABULARY = [f"{a}{b}" for a in ("ba", "ne", "ti", "lo", "ru", "sta", "mi") for b in ("ra", "lin", "so", "ket", "du", "vam", "pe", "go")]


def words(n, seed):
    rng = random.Random(seed)
    return [rng.choice(VOCABULARY) for _ in range(n)]


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOC)


@pytest.fixture(scope="module")
def odd(spark):
    """Rows that any operator must survive; one column clashes with names that operators use."""
    long = " ".join(words(60_000, 5))
    rows = [(None, "a b c", None, None, None), (1, None, "en", "s", 1), (1, None, "en", "s", 1), (2, "", "fr", None, 0), (3, " \n\t ", "en", "s", 4), (4, long, "en", "s", 9), (5, long, None, "s", 9), (6, "é" * 3000, "en", "s", 9), (6, "other text", "en", "s", 9), (None, None, None, None, None)]
    return spark.createDataFrame(rows, DOC).withColumns({"key": F.lit(1), "_id": F.lit("x"), "g": F.lit(2), "part": F.lit(3), "label": F.lit("l"), "id": F.lit(0)})


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


# 1


@pytest.mark.parametrize(("n", "shards"), [(0, 4), (1, 4), (37, 4), (1000, 16)])
def test_shards_are_exact(spark, n, shards):
    d = documents(spark, [f"text {i % 7}" for i in range(n)]).repartition(5)
    rows = sharding.shard(d, shards).collect()
    per = Counter(r.shard for r in rows)
    assert len(rows) == n and sorted(r.doc_id for r in rows) == list(range(n))
    assert max(per.values(), default=0) - min([per.get(s, 0) for s in range(shards)]) <= 1
    for s in per:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(per[s]))
    assert all(r.size == len(f"text {r.doc_id % 7}") + 1 and r.text_crc32 == zlib.crc32(f"text {r.doc_id % 7}".encode()) for r in rows)


def test_sub_groups_give_exact_shards(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CELL_ROWS", 20)
    monkeypatch.setattr(sharding, "MAX_CELLS", 8)
    rows = sharding.shard(documents(spark, [f"text {i % 7}" for i in range(1000)]).repartition(3), 4).collect()
    for s in range(4):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(250))
    assert len({r.doc_id for r in rows}) == 1000


def test_shuffle_is_uniform(spark):
    """Over many seeds, two rows of one input partition share a shard as often as a uniform permutation says, and slots are even."""
    d = documents(spark, [f"t{i}" for i in range(24)]).coalesce(2)
    together, slots = 0, Counter()
    for seed in range(60):
        at = {r.doc_id: (r.shard, r.slot) for r in sharding.shard(d, 4, seed).collect()}
        together += sum(at[i][0] == at[i + 1][0] for i in range(0, 24, 2))
        slots[at[3]] += 1
    assert abs(together / (60 * 12) - 5 / 23) < 0.06
    assert len(slots) > 15 and max(slots.values()) <= 10


def test_matrix_margins_and_law(monkeypatch):
    m = sharding.matrix([10, 0, 25, 5], [13, 13, 14], 1)
    assert m.sum(axis=1).tolist() == [10, 0, 25, 5] and m.sum(axis=0).tolist() == [13, 13, 14]
    rng = np.random.default_rng(3)
    own, numpy = ([f() for _ in range(4000)] for f in (lambda: sharding._draw(30, 50, 20, rng), lambda: int(rng.hypergeometric(30, 50, 20))))
    assert abs(np.mean(own) - np.mean(numpy)) < 0.15 and abs(np.var(own) - np.var(numpy)) < 0.35
    monkeypatch.setattr(sharding, "NUMPY_POPULATION", 1)
    assert sharding.matrix([10, 5], [7, 8], 1).sum(axis=0).tolist() == [7, 8]
    good, bad, sample = 3 * 10**12, 10**13, 4000
    big = np.array([sharding._draw(good, bad, sample, rng) for _ in range(1500)])
    share = good / (good + bad)
    assert abs(big.mean() - sample * share) < 4 * np.sqrt(sample * share * (1 - share) / 1500)
    assert 0.88 < big.var() / (sample * share * (1 - share)) < 1.13
    for n in (10, 300, 10**6):
        assert float(sharding._log_factorial(n)) == pytest.approx(float(np.sum(np.log(np.arange(1, n + 1)))), rel=1e-12)


def test_shards_in_odd_cases(spark, odd):
    rows = sharding.shard(odd, 3).collect()
    assert len(rows) == odd.count() and sum(r.size == 1 for r in rows) == 4


# 2

PAGE = (
    '<html><head><title>T</title><script>var p="<p>no</p>";</script></head><body><nav><ul><li><a href=/>Home</a></ul></nav><div class="ad">Buy this now please</div>'
    "<article><h1>A &amp; B</h1><p>One <b>two\n three.<br><p>x</article><div id=comments><p>first comment is long enough to be text</div><footer>&copy; me</footer></body>"
)


def test_main_text(spark):
    rows = [(1, "u", PAGE, 7), (2, None, None, 7), (3, "u", "", 7), (4, "u", "plain words only", 7), (None, "u", "<p>" + "long " * 30_000, 7)]
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()}
    assert got[1] == ("A & B\n\nOne two three.\n\nx", 24)
    assert got[2] == got[3] == ("", 0) and got[4][0] == "plain words only" and got[None][1] == 149_999


def test_tree_learns_its_table():
    tree = html_text.trained()
    for line in html_text.EXAMPLES.strip().splitlines():
        *features, answer = line.split()
        assert html_text.decide(tree, tuple(map(float, features))) == (answer == "yes")


# 3


def test_toxicity_learns_only_from_its_folds(spark, odd):
    rng = random.Random(2)
    texts = [" ".join([*words(rng.randint(20, 60), i), *(["moronic"] * (i % 4 == 0))]) for i in range(400)]
    d, known = documents(spark, [*texts, "", None]), labels(spark, [(i, 1, int(i % 4 == 0)) for i in range(400)])
    rows = toxicity.classify(d, known).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id < 400]
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in held) >= 0.95 * len(held)
    flipped = known.withColumn("toxic", F.when(toxicity.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {(r.doc_id, round(r.score, 9)) for r in toxicity.classify(d, flipped).collect()} == {(r.doc_id, round(r.score, 9)) for r in rows}
    assert toxicity.classify(odd, known).count() == odd.count()
    assert {r.predicted for r in toxicity.classify(d, known.limit(0)).collect()} == {0}
    assert toxicity.classify(d.limit(0), known).count() == 0
    twice = d.union(d.filter("doc_id < 50").withColumn("text", F.reverse("text")))
    assert len({tuple(sorted((r.doc_id, round(r.score, 9)) for r in toxicity.classify(twice.repartition(n), known).collect())) for n in (1, 4)}) == 1


def test_ratios_equal_brute_force(spark):
    texts = ["good day", "bad day", "a bad man", "good man", None, ""]
    buf, offs = textnum.text_bytes(pa.array(texts, pa.string()))
    got = toxicity.distinct(*toxicity.buckets(buf, offs))
    want = [len({w[i : i + k] for k in toxicity.GRAM_SIZES for w in [f" {t or ''} "] for i in range(len(w) - k + 1)}) for t in texts]
    assert np.bincount(got[1], minlength=len(texts)).tolist() == want
    weights = np.zeros(toxicity.FEATURES)
    weights[got[0][got[1] == 1]] = 0.25
    plain = [1 / (1 + np.exp(1 - 0.25 * len(set(got[0][got[1] == i]) & set(got[0][got[1] == 1])))) for i in range(len(texts))]
    assert toxicity.Model(-1.0, weights).scores(buf, offs) == pytest.approx(plain)


# 4


def test_templates_and_slots(spark, odd):
    item = "A train leaves Paris at 10 km per hour and Anna waits 10 minutes for the 3.5 kg parcel near Paris today"
    bench = spark.createDataFrame([(1, item), (2, "short one of five words"), (3, None), (4, ""), (5, "too few words")], "item_id long, text string")
    again = "x. A train leaves Rome at 20 km per hour and Anna waits 20 minutes for the 7 kg parcel near Rome today"
    other = again.replace("waits 20", "waits 21").replace("near Rome", "near Oslo")
    d = documents(spark, [f"before. {item}. after", again, other, "this is a short one of five words indeed", " ".join(words(500, 1)), None, ""])
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.matches(d, bench).collect()) == [(0, 1), (1, 1), (3, 2)]
    assert sorted(r.doc_id for r in decontaminate.clean(d, bench).collect()) == [2, 4, 5, 6]
    assert decontaminate.clean(odd, bench).columns == odd.columns and decontaminate.clean(odd, bench).count() == odd.count()
    assert decontaminate.matches(d.limit(0), bench).count() == decontaminate.matches(d, bench.limit(0)).count() == 0


def found(spark, item, *texts):
    """The places in `texts` that the item contaminates."""
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    return sorted(r.doc_id for r in decontaminate.matches(documents(spark, texts), bench).collect())


def test_only_contradicting_windows_are_dropped(spark):
    item = "the shop sells 3 red pens and 3 blue pens to every child who comes in before noon and pays with coins or paper notes"
    parted, edited = item.replace("3 red", "5 red").replace("3 blue", "8 blue"), item.replace("3 blue", "4 blue")
    merged = "it sells 4 red pens and 4 blue pens to every child who comes in before noon and pays with coins or paper notes"
    assert found(spark, item, item, parted, edited, " ".join(words(60, 3))) == [0, 1, 2]
    assert found(spark, merged.replace("4 blue", "6 blue"), merged) == [0]


def test_values_may_become_equal(spark):
    item = "Alice has 3 apples and Bob gives her 5 more of them after the long walk home from the old market in town"
    merged = item.replace("3 apples", "4 apples").replace("5 more", "4 more")
    train = "A train leaves at 10 km per hour and then another train leaves at 15 km per hour from the same small station"
    assert found(spark, item, merged, item.replace("3", "7").replace("5", "9")) == [0, 1]
    assert found(spark, train, train.replace("10", "20").replace("15", "20"), train.replace("10", "15").replace("then another train leaves at 15", "then another train leaves at 20")) == [0, 1]


def test_short_items_beside_long_ones(spark):
    bench = spark.createDataFrame([(1, "one two three four five"), (2, "a b c d e f g h i j"), (3, "six of the best words here"), (4, "a b c d e f g h i j")], "item_id long, text string")
    texts = ["x one two three four five y", "a b c d e f g h i j", "zero six of the best words here. done", "a b c d e z f g h i j", "one two three four"]
    got = sorted((r.doc_id, r.item_id, r.matched, r.windows) for r in decontaminate.matches(documents(spark, texts), bench).collect())
    assert got == [(0, 1, 1, 1), (1, 2, 3, 3), (1, 4, 3, 3), (2, 3, 1, 1)]


def plain_contaminations(item, text, size=8):
    """The share of the windows of an item without slots or capitals that a text has, word by word."""
    a, b = item.split(), text.split()
    size = min(size, len(a))
    windows = [tuple(a[i : i + size]) for i in range(len(a) - size + 1)]
    there = {tuple(b[i : i + size]) for i in range(len(b) - size + 1)}
    return sum(w in there for w in windows), len(windows)


def test_words_equal_brute_force(spark):
    rng = random.Random(12)
    items = [" ".join(words(n, 500 + n)) for n in (5, 7, 8, 12, 30)]
    texts = []
    for i in range(40):
        w = items[i % 5].split()
        for _ in range(i % 4):
            w[rng.randrange(len(w))] = rng.choice(VOCABULARY)
        texts.append(" ".join([*words(20, i), *w, *words(5, i + 99)]))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = set()
    for d, text in enumerate(texts):
        for i, item in enumerate(items):
            m, n = plain_contaminations(item, text)
            if 2 * m >= n and m:
                want.add((d, i, m, n))
    assert {(r.doc_id, r.item_id, r.matched, r.windows) for r in decontaminate.matches(documents(spark, texts), bench).collect()} == want and len(want) >= 15


def test_slots_stand_where_their_windows_do(spark):
    item = "the stall sells 2 kg and 3 kg and 7 kg of old flour to every baker in this town"
    before = ["we met Anna's friend and", "he asked Smith-jones here and", "mail to John.smith@site.org then"]
    assert found(spark, item, *[f"{b} {item}" for b in before], before[0] + " " + item.replace("7", "9")) == [0, 1, 2, 3]
    assert found(spark, f"{before[0]} {item}", item, f"{before[0]} {item}".replace("Anna", "Olga")) == [0, 1]


def test_names_may_begin_a_sentence(spark):
    item = "Alice has 9 apples in the big basket. Alice gives 4 of them to her brother.\n\"Why so few?\" Alice then says: The rest is mine"
    other = item.replace("Alice", "Robert").replace("9", "8")
    small = "Calculate the sum of all the odd numbers below the given bound"
    assert found(spark, item, item, "Once more. " + other, " ".join(words(60, 4))) == [0, 1]
    assert found(spark, "Find five odd numbers. Add them", "we find five odd numbers. add them") == [0]
    assert found(spark, small, "please " + small.lower(), "now. " + small, small.replace("Calculate", "Find")) == [0, 1, 2]


# 5


def chats(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    digest = lambda parts: hashlib.sha256("".join(parts).encode()).hexdigest()
    return {k: (len(v), digest(f"{a}\n{b}\n" for a, b in v), sum(len(b) for a, b in v if a == "assistant"), digest(b for a, b in v if a == "assistant")) for k, v in out.items()}


@pytest.mark.parametrize(("budget", "history"), [(60, 20), (1024, 256), (1, 0)])
def test_chat_round_trip(spark, budget, history):
    rng = random.Random(1)
    pool = [None, "", "\\n <| \\\\ <|im_end|>\n", "x" * 3000, "é" * 50, "<|im_end|><|im_start|>assistant ok", "<|im_start|>user\n"]
    rows = [(rng.choice([1, 2, None]), rng.choice([None, 1, 2, 3]), rng.choice(["user", "assistant", "system", None, "a\nb\\<|x"]), rng.choice(pool), "clash") for _ in range(200)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window string")
    windows = chat.format_chats(d, budget, history)
    assert {r[0]: tuple(r)[1:5] for r in chat.read_back(windows).collect()} == chats(rows)
    assert chat.format_chats(d.limit(0)).count() == 0


def test_chat_windows_keep_system_and_budget(spark):
    rows = [(1, 0, "system", "be kind")] + [(1, i, "user" if i % 2 else "assistant", "w " * 30) for i in range(1, 20)]
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), 100, 30).orderBy("window").collect()
    assert len(got) > 3 and all(r.text.startswith("<|im_start|>system\nbe kind") and r.n_tokens <= 100 for r in got)
    assert all(r.repeated >= 1 for r in got[1:]) and sum(len(r.loss) for r in got) == 9


def test_a_very_long_conversation_and_many_short_ones(spark):
    rows = [(1, i, ["system", "user", "assistant"][min(2, i and 1 + i % 2)], f"turn {i} " + "w " * (i % 50)) for i in range(30_000)]
    rows += [(10 + i, j, ["user", "assistant"][j], "x" * 2000) for i in range(1500) for j in (0, 1)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(1)
    windows = chat.format_chats(d)
    assert {r[0]: tuple(r)[1:5] for r in chat.read_back(windows).collect()} == chats([(*r, None) for r in rows])


@given(st.text(alphabet="\\<|n\nab"))
def test_escapes(text):
    assert chat.unescape(chat.escape(text)) == text == chat.unescape(chat.escape(text, True))
    assert "<|" not in chat.escape(text) and "\n" not in chat.escape(text, True)


# 6


def shingle_set(text, k=5):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def groups(sets, percent=85):
    parent = list(range(len(sets)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(sets)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * i >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return [find(a) for a in range(len(sets))]


def test_components_equal_brute_force(spark):
    rng = random.Random(4)
    texts = []
    for base in range(12):
        w = words(rng.choice([3, 6, 30, 120, 200]), 100 + base)
        for _ in range(9):
            v = list(w)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                v[rng.randrange(len(v))] = rng.choice(VOCABULARY)
            texts.append(" ".join(v))
    texts += [*texts[:4], texts[0].upper(), None, "", " \n"]
    want = groups([shingle_set(t) for t in texts])
    rows = minhash.near_duplicates(documents(spark, texts)).collect()
    assert {r.doc_id: (r.component_id, r.n_shingles, r.kept) for r in rows} == {i: (c, len(shingle_set(texts[i])), c == i) for i, c in enumerate(want)}
    kept = minhash.deduplicate(documents(spark, texts)).collect()
    assert sorted(r.doc_id for r in kept) == [i for i, c in enumerate(want) if i == c]


def test_few_links_take_few_stages_and_name_the_same(spark):
    rng = random.Random(11)
    keys = [bytes(rng.choice([0, 0, 1, 127, 128, 255]) if rng.random() < 0.5 else rng.randrange(256) for _ in range(16)) for _ in range(400)]
    for links in ([], [(keys[i], keys[i + 1]) for i in range(60)] + [(rng.choice(keys), rng.choice(keys)) for _ in range(150)]):
        edges = spark.createDataFrame(links, "a binary, b binary")
        scheduler = spark.sparkContext._jsc.sc().dagScheduler()
        before = scheduler.nextStageId()
        few = minhash.components(edges)
        assert scheduler.nextStageId() - before <= 6  # tasks that read next to nothing stay in the driver's memory, too
        found, joined = ([(bytes(r.node), bytes(r.label)) for r in labels.collect()] for labels in (few, minhash.components(edges, few=-1)))
        assert sorted(found) == sorted(joined)


def test_thresholds_of_stage_and_query(spark):
    import corpus_pipeline

    base = words(104, 70)
    near, apart = list(base), list(base)
    for i in (20, 60):
        near[i] = "changed"
    for i in (20, 60, 90):
        apart[i] = "other"
    sets = [shingle_set(" ".join(w)) for w in (base, near, apart)]
    assert [round(len(sets[0] & s) / len(sets[0] | s), 3) for s in sets] == [1, 0.818, 0.739]
    d = documents(spark, [" ".join(w) for w in (base, near, apart)])
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, d, "").collect()) == [0, 2]
    assert sorted(r.doc_id for r in minhash.near_duplicates(d).filter("kept").collect()) == [0, 1, 2]


def test_dedup_in_odd_cases(spark, odd):
    rows = minhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    assert {(r.doc_id, r.component_id, r.kept) for r in rows if r.n_shingles == 0} == {(1, 1, True), (2, 2, True), (3, 3, True), (None, None, False)}
    kept = minhash.deduplicate(odd)
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter({None: 2, 1: 2, 2: 1, 3: 1, 4: 1, 6: 2})
    assert minhash.near_duplicates(odd.limit(0)).count() == minhash.deduplicate(odd.limit(0)).count() == 0
    same = documents(spark, ["same words here in this text"] * 3).withColumn("doc_id", F.lit(7).cast("long"))
    assert minhash.deduplicate(same).count() == 1


# 7


def test_bpe_equals_the_library(spark, odd):
    from tokenizers import Tokenizer

    path = tokenizer_path()
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    rng = random.Random(9)
    shared = " ".join(words(800, 3))
    texts = [f"{i} {shared} {i}!" for i in range(4)] + ["".join(rng.choice("ab éÉ'\n<|>12́　中文sς_.,!\u0085") for _ in range(4000)) for _ in range(6)]
    texts += ["<|endoftext|>x <|startoftext|>", "x" * 20_000, "é" * 9000, "it's I'll DON'T", None, "", "\x1c a\x1fb İ"]
    got = {r.doc_id: r for r in bpe.round_trip(documents(spark, texts), path).collect()}
    for i, text in enumerate(texts):
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert bytes(got[i].ids) == np.array(ids, "<u4").tobytes(), i
        assert got[i].decoded == t.decode(ids, skip_special_tokens=False), i
    row = bpe.digests(documents(spark, ["ab cd"]), path).first()
    assert row.ids_sha256 == hashlib.sha256(np.array(t.encode("ab cd").ids, "<u4").tobytes()).hexdigest()
    assert bpe.decode(bpe.encode(odd, path), path).count() == odd.count() and bpe.encode(odd.limit(0), path).count() == 0


def test_workers_keep_one_operators_stores(spark):
    """A worker that encoded keeps its encoder for more of that, and gives it back when another operator's task begins."""
    docs = documents(spark, [" ".join(words(300, i)) for i in range(40)]).repartition(4)

    def run(batch):
        import gc

        yield pa.RecordBatch.from_arrays([pa.array([sum(type(x).__name__ == "Encoder" for x in gc.get_objects())] * batch.num_rows)], ["n"])

    for _ in range(2):
        bpe.encode(docs, tokenizer_path()).collect()
        assert {r.n for r in common.map_texts(docs, run, "n long").collect()} == {0}

    coder = bpe.worker(tokenizer_path())
    assert list(common.step(iter, "bpe")([])) == [] and bpe.worker(tokenizer_path()) is coder
    assert list(common.step(iter)([])) == [] and bpe.worker(tokenizer_path()) is not coder


def test_chunks_are_reused_and_repaired():
    coder = bpe.Encoder(tokenizer_path())
    shared = " ".join(words(4000, 3))
    coder.encode(*textnum.text_bytes(pa.array([shared])))
    before, made = coder.chunks.size, len(coder.chunks.young)
    assert made > 5
    out = coder.encode(*textnum.text_bytes(pa.array(["new start " + shared])))
    assert coder.chunks.size - before < 0.4 * before
    assert out == coder.ids([("new start " + shared).encode()])


# 9


def kneser_ney(texts, order=language_model.ORDER):
    """Interpolated modified Kneser-Ney over bytes, gram by gram."""
    counts = {order: Counter()}
    for t in texts:
        b = bytes(order - 1) + t.encode()
        counts[order].update(b[i : i + order] for i in range(len(b) - order + 1))
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    discounts, context = {}, {}
    for k, c in counts.items():
        n = [sum(v == i for v in c.values()) for i in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] + n[1] else 0
        discounts[k] = [min(i + 1, max(0, i + 1 - (i + 2) * y * n[i + 1] / n[i])) if n[0] and n[i] else 0.5 * (i + 1) for i in range(3)]
        context[k] = {}
        for g, v in c.items():
            t = context[k].setdefault(g[:-1], [0, 0.0])
            t[0], t[1] = t[0] + v, t[1] + min(v, discounts[k][min(v, 3) - 1])

    def p(g):
        if not g:
            return 1 / 256
        k = len(g)
        back = p(g[1:])
        if g[:-1] not in context[k]:
            return back
        total, left = context[k][g[:-1]]
        v = counts[k][g]
        return ((v - min(v, discounts[k][min(v, 3) - 1]) if v else 0) + left * back) / total

    return p


@pytest.mark.parametrize(("held", "size", "most"), [(1 << 20, 2 << 20, 10**6), (100, 300, 10**6), (1 << 20, 2 << 20, 0), (100, 300, 0)])
def test_perplexities_equal_brute_force(spark, held, size, most):
    texts = [" ".join(words(40, i)) for i in range(12)] + ["Ünïcode ##!! 99", "", None, " ".join(words(40, 1))]
    d, known = documents(spark, texts), labels(spark, [(i, 1, 0) for i in range(10)])
    marked = language_model.marked(d, known)
    trained = [r.text for r in marked.filter("trusted").collect()]
    p = kneser_ney(trained)
    assert language_model.parts(marked, held, size).filter("n is null").select("part").distinct().count() > (4 if held == 100 else 0)
    got = {r.doc_id: r.perplexity for r in language_model.perplexities(marked, held, size, most).collect()}
    for i, t in enumerate(texts):
        b = bytes(language_model.ORDER - 1) + (t or "").encode()
        grams = [b[j : j + language_model.ORDER] for j in range(len(b) - language_model.ORDER + 1)]
        assert got[i] is None if not grams else got[i] == pytest.approx(np.exp(-np.mean([np.log(p(g)) for g in grams])), rel=1e-4)


def test_a_small_model_takes_few_stages_and_says_the_same(spark):
    rows = [(lang, int.from_bytes(rng.choices(b"abcd", k=5), "big"), rng.choice([1, 1, 1, 2, 3, 9])) for lang, rng in ((lang, random.Random(lang)) for lang in (-3, 0, 7)) for _ in range(100 * abs(lang) + 1)]
    counts = spark.createDataFrame(rows, "lang_key long, gram long, n long").groupBy("lang_key", "gram").agg(F.sum("n").alias("n"))
    scheduler = spark.sparkContext._jsc.sc().dagScheduler()
    before = scheduler.nextStageId()
    got = language_model.model(counts).collect()
    assert scheduler.nextStageId() - before <= 6  # each order's tables and joins were some hundred
    asked = {(r.lang_key, r.gram): r.logp for r in language_model.probabilities(counts).collect()}
    assert {(r.lang_key, r.gram): r.value for r in got if r.kind == language_model.ORDER - 1} == pytest.approx(asked) and len(asked) > 500
    contexts = {(r.lang_key, r.gram) for r in got if r.kind == 2 * language_model.ORDER - 1}
    assert contexts == {(key, gram >> 8) for key, gram in asked}


def test_quality_classifier_rejects_noise(spark, odd):
    rng = random.Random(0)
    good = [" ".join(words(80, i)) for i in range(60)]
    noise = ["".join(rng.choice("#$%^&*QXZ019") for _ in range(300)) for _ in range(5)]
    d, known = documents(spark, good + noise), labels(spark, [(i, 1, 0) for i in range(40)])
    kept = language_model.reject(d, known)
    assert sorted(r.doc_id for r in kept.collect()) == list(range(60)) and kept.columns == d.columns
    assert language_model.verdicts(odd, known).count() == odd.count()
    assert language_model.reject(odd.limit(0), known).count() == 0
    assert language_model.reject(d, known.limit(0)).count() == 65


# 10


def counted(text):
    text = text or ""
    w = WORD.findall(text)
    c = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(covered)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab é#|\n\t ")), min_size=1, max_size=8))
def test_counts_equal_brute_force(texts):
    got = np.array(quality_rules.counts(*textnum.text_bytes(pa.array(texts, pa.string())))).T.tolist()
    assert got == [counted(t) for t in texts]


def test_outliers_go_and_clean_rows_stay(spark, odd):
    good = [" ".join(words(60 + 5 * (i % 20), i)) for i in range(120)]
    bad = [" | ".join(f"{w}{j}" for j, w in enumerate(words(100, 1000 + i))) for i in range(6)]
    d = documents(spark, [*good, *bad, "too short", "same three words " * 40, None, ""])
    rows = {r.doc_id: r for r in quality_rules.verdicts(d).collect()}
    assert [i for i, r in rows.items() if not r.kept and not r.base_failed] == list(range(120, 126))
    assert sorted(i for i, r in rows.items() if r.base_failed) == [126, 127, 128, 129]
    assert sorted(r.doc_id for r in quality_rules.reject(d).collect()) == list(range(120))
    assert quality_rules.verdicts(odd).count() == odd.count() and quality_rules.reject(odd).columns == odd.columns
    assert quality_rules.verdicts(odd.limit(0)).count() == 0


def test_repeats_alone_are_outliers(spark):
    rng = random.Random(8)
    fresh = lambda n: [rng.choice(VOCABULARY) + rng.choice(VOCABULARY) + rng.choice(VOCABULARY) for _ in range(n)]
    good = [" ".join(fresh(60 + 20 * (i % 20))) for i in range(120)]
    lines = "\n".join([" ".join(fresh(1100))] + [" ".join(fresh(12))] * 75)
    inline = " ".join(fresh(1060) + fresh(12) * 78)
    rows = {r.doc_id: r for r in quality_rules.verdicts(documents(spark, [*good, lines, inline])).collect()}
    assert not rows[120].base_failed and not rows[121].base_failed
    assert sorted(i for i, r in rows.items() if not r.kept) == [120, 121]


def test_chi_squared():
    assert quality_rules.chi2_quantile(0.95, 4) == pytest.approx(9.4877, abs=1e-3)
    assert quality_rules.gamma_share(1.0, 1.0) == pytest.approx(1 - np.exp(-1), abs=1e-9)


# Pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    good = [" ".join(words(120, i)) for i in range(80)]
    item = " ".join(words(30, 999))
    texts = [*good, good[3] + " end", "".join(random.Random(1).choice("#$%^&*QXZ019 ") for _ in range(900)), good[5] + " " + item, "short"]
    documents(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    labels(spark, [(i, 1, 0) for i in range(60)]).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in rows) == list(range(80)) and all(r.n_tokens > 0 for r in rows)


def test_pipeline_stages_in_odd_cases(spark, odd, tmp_path):
    import corpus_pipeline

    good = [" ".join(words(120, i)) for i in range(60)]
    d = odd.unionByName(documents(spark, good), allowMissingColumns=True)
    labels(spark, [(i, 1, 0) for i in range(10, 50)]).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, " ".join(words(30, 999))), (None, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, str(tmp_path))
        assert out.columns == d.columns and 40 <= out.count() <= d.count()
        assert stage(spark, d.limit(0), str(tmp_path)).count() == 0
    assert corpus_pipeline.tokens(spark, d, str(tmp_path)).count() == d.count()


def test_tables_are_dropped(spark, tmp_path):
    from verilume.llm import common

    one = common.materialize(spark.range(3), "kept")
    common.drop(common.materialize(spark.range(5), "gone"))
    names = os.listdir(common.shared_dir(spark).removeprefix("file://"))
    assert one.count() == 3 and not [n for n in names if n.startswith("gone")]
