"""Benchmark decontamination by templates.

Documents and benchmark items become sequences of tokens, in which numbers, units after a number and names (capitalised
words inside a sentence) are typed placeholders and all else is in small letters. Other capitalised words (which begin a text,
sentence, line or quotation) are words in one reading and names in another, on both sides; the windows of both are used. Windows of WINDOW template tokens (a shorter
item is one window) are hashed and joined. The matched windows of one document, item and alignment count only if their slots
are consistent: each value of the item stands for one value in the document (two values of the item may stand for the same one). Where
slots contradict each other, the values with the most matched windows hold and only the windows over the other slots are dropped; a slot with the
item's own value always counts. So a question with other numbers, names or units is caught, and a chance match of shapes
with contradicting values isn't.

A document is contaminated by an item if it has at least COVERAGE of the item's windows in consistent alignments. Everything
runs as DataFrame expressions; a document's windows are never shuffled, unless the benchmark has more than BROADCAST_ROWS
windows (16 bytes each, counted first): then the join is by hash on both sides.

Defined results: null, empty and blank texts on either side match nothing; an item with fewer than MIN_TOKENS tokens matches
nothing; repeated rows and ids give one row per (doc_id, item_id); `clean` also drops matching rows whose id is null; extra
columns are kept by `clean`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verilume.llm.common import materialize

WINDOW, MIN_TOKENS, COVERAGE = 8, 5, 0.5
BROADCAST_ROWS = 1_000_000

#: Words that are units after a number.
UNITS = (
    "mm cm m km in ft yd mi mg g kg t lb oz ml cl l gal s sec second seconds min minute minutes h hour hours day days week weeks "
    "month months year years meter meters metre metres kilometer kilometers kilometre kilometres mile miles foot feet inch inches "
    "gram grams kilogram kilograms pound pounds liter liters litre litres percent dollar dollars euro euros cent cents usd eur gbp"
).split()

# Inside the marked text: OPEN and a type begin a slot, VALUE begins its value, POINT joins the parts of a number, FIRST begins a
# capitalised word that isn't inside a sentence.
OPEN, VALUE, POINT, FIRST = "\u0002", "\u0003", "\u0004", "\u0005"


def _marked(text: str) -> Column:
    """The text in small letters with its slots marked; its tokens are what lies between other characters than letters, digits and marks.
    The steps for numbers run only on texts with a number."""
    text = F.coalesce(F.col(text).cast("string"), F.lit(""))
    has_marks = F.contains(text, F.lit(OPEN)) | F.contains(text, F.lit(VALUE)) | F.contains(text, F.lit(POINT)) | F.contains(text, F.lit(FIRST))
    out = F.when(has_marks, F.translate(text, OPEN + VALUE + POINT + FIRST, "    ")).otherwise(text)
    units = "|".join(sorted(UNITS, key=len, reverse=True))
    number = F.regexp_replace(out, r"[.,](?<=\p{N}[.,])(?=\p{N})", POINT)
    number = F.regexp_replace(number, r"(?<![\p{L}\p{N}])(\p{N}[\p{N}" + POINT + r"]*)(?=(?i:" + units + r")?(?![\p{L}\p{N}]))", f" {OPEN}num{VALUE}$1 ")
    number = F.regexp_replace(number, r"(?<=\p{N} )\s*(?i:(" + units + r"|[%$€£]))(?![\p{L}\p{N}])", f"{OPEN}unit{VALUE}$1 ")
    out = F.when(text.rlike(r"\p{N}"), number).otherwise(out)
    out = F.regexp_replace(out, r"(\p{Lu})(?<![\p{L}\p{N}%$€£" + VALUE + r"]\p{Lu})", f"{FIRST}$1")
    return F.lower(F.regexp_replace(out, FIRST + r"(?<=[\p{L}\p{N},;] " + FIRST + ")", f"{OPEN}name{VALUE}"))


def _tokens(marked: Column) -> Column:
    return F.array_remove(F.split(marked, r"[^\p{L}\p{N}%$€£" + OPEN + VALUE + POINT + FIRST + "]+"), "")


def _hashes(tokens: Column) -> Column:
    """A number for each template token; odd for the words of FIRST, even for all else."""
    first = lambda t: F.xxhash64(F.substr(t, F.lit(2))).bitwiseOR(F.lit(1).cast("long"))
    template = lambda t: F.when(t.startswith(OPEN), F.xxhash64(F.substring_index(t, VALUE, 1))).otherwise(F.xxhash64(t))
    even = F.lit(-2).cast("long")
    return F.transform(tokens, lambda t: F.when(t.startswith(FIRST), first(t)).otherwise(template(t).bitwiseAND(even)))


def _windows(df: DataFrame, sizes: list[int], *keys: str) -> DataFrame:
    """keys, at (its place) and window of every window of the column tokens, for all sizes: with the words of FIRST as words, and
    once more with them as names, where that differs. Places are exploded with their neighbours side by side, and hashed then."""
    most = max(sizes)
    near = df.select(*keys, _hashes(F.col("tokens")).alias("_h"))
    shifted = [F.slice("_h", i + 1, F.greatest(F.size("_h") - i, F.lit(0))).alias(f"h{i}") for i in range(most)]
    each = near.select(*keys, F.posexplode(F.arrays_zip(*shifted)).alias("at", "z"))
    marked, even = [F.col("z")[f"h{i}"] for i in range(most)], F.lit(-2).cast("long")
    word = [w.bitwiseAND(even) for w in marked]  # the same word inside a sentence is even
    name = F.xxhash64(F.lit(f"{OPEN}name")).bitwiseAND(even)
    either = [F.when(w.bitwiseAND(F.lit(1).cast("long")) == 1, name).otherwise(w) for w in marked]
    made = []
    for size in sizes:
        as_words, as_names = (F.xxhash64(F.lit(size), *side[:size]) for side in (word, either))
        whole = word[size - 1].isNotNull()
        made += [F.when(whole, as_words), F.when(whole & (as_words != as_names), as_names)]
    return each.select(*keys, "at", F.explode(F.array(*made)).alias("window")).filter("window is not null")


def _slots(df: DataFrame, *keys: str) -> DataFrame:
    """keys, token (its place), kind, value and first (if only one reading has it) of every slot of the column marked."""
    out = df.select(*keys, F.posexplode(_tokens(F.col("marked"))).alias("token", "t"), F.col("t").startswith(FIRST).alias("first")).filter(F.col("t").contains(VALUE) | F.col("first"))
    kind = F.when(F.col("first"), F.lit(f"{OPEN}name")).otherwise(F.substring_index("t", VALUE, 1))
    return out.select(*keys, "token", kind.alias("kind"), F.when(F.col("first"), F.substr("t", F.lit(2))).otherwise(F.substring_index("t", VALUE, -1)).alias("value"), "first")


def _contradicting(pairs: DataFrame) -> DataFrame:
    """_doc_id, _text_hash, _item, _shift and _item_token of the slots whose values don't fit the others of their alignment and kind.
    Pairs of values are taken by the matched windows on their slots, equal ones first among as many; a pair whose item value
    was taken with another value before contradicts, unless its values are equal."""
    keys = ("doc_id", "text_hash", "item", "shift")
    exact = F.col("item_value").eqNullSafe(F.col("value"))
    each = pairs.groupBy(*keys, "kind", "item_value", "value").agg((-F.sum("covered")).alias("covered"), F.min("item_token").alias("first"), F.collect_list("item_token").alias("slots"))
    pair = F.struct("covered", (~exact).alias("other"), "first", F.col("item_value").alias("a"), F.col("value").alias("b"), "slots")
    each = each.groupBy(*keys, "kind").agg(F.array_sort(F.collect_list(pair)).alias("pairs"))
    state = F.struct(F.array().cast("array<string>").alias("a"), F.array().cast("array<int>").alias("bad"))

    def step(was, p):
        free = p["b"].isNotNull() & ~F.array_contains(was["a"], p["a"])
        take = F.struct(F.array_append(was["a"], p["a"]).alias("a"), was["bad"].alias("bad"))
        drop = F.struct(was["a"].alias("a"), F.concat(was["bad"], p["slots"]).alias("bad"))
        return F.when(free, take).when(p["other"], drop).otherwise(was)

    return each.select(*[F.col(c).alias(f"_{c}") for c in keys], F.explode(F.aggregate("pairs", state, step)["bad"]).alias("_item_token"))


def _hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, text_hash, item_id, matched, windows: what is contaminated, before ids are merged."""
    items = benchmark.select(F.col("item_id").cast("long"), _marked("text").alias("marked"))
    items = items.withColumn("tokens", _tokens(F.col("marked"))).withColumn("size", F.least(F.lit(WINDOW), F.size("tokens"))).filter(F.col("size") >= MIN_TOKENS)
    items = materialize(items.withColumn("item", F.xxhash64("item_id", "marked")), "items")
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())  # WINDOW - MIN_TOKENS + 1 numbers at most
    keyed = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string"))
    if not sizes:
        return keyed.select("doc_id", "text_hash", F.lit(0).cast("long").alias("item_id"), F.lit(0).cast("long").alias("matched"), F.lit(0).alias("windows")).limit(0)
    grams = None
    for size in sizes:
        own = items.filter(F.col("size") == size).withColumn("windows", F.size("tokens") - size + 1)
        made = _windows(own, [size], "item", "item_id", "windows", "size").withColumnRenamed("at", "item_at")
        grams = made if grams is None else grams.union(made)
    grams = materialize(grams, "benchmark")
    side = F.broadcast(grams) if grams.count() <= BROADCAST_ROWS else grams
    rows = keyed.select("doc_id", "text_hash", _tokens(_marked("text")).alias("tokens"))
    out = _windows(rows, sizes, "doc_id", "text_hash").join(side, "window")
    out = out.select("doc_id", "text_hash", "item", "item_id", "at", "item_at", "windows", "size")
    found = materialize(out.withColumn("shift", F.col("at") - F.col("item_at")).distinct(), "windows")

    item_slots = materialize(_slots(items, "item"), "slots")
    if not item_slots.isEmpty():
        places = found.join(item_slots.select("item", F.col("token").alias("item_token"), "kind", F.col("value").alias("item_value"), F.col("first").alias("item_first")), "item")
        places = places.filter("item_token >= item_at and item_token < item_at + size").groupBy("doc_id", "text_hash", "item", "shift", "item_token", "kind", "item_value", "item_first").agg(F.count("*").alias("covered"))
        ids = materialize(places.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h")).distinct(), "slotted")
        texts = keyed.join(ids, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_h")), "left_semi").dropDuplicates(["doc_id", "text_hash"])
        theirs = _slots(texts.select("doc_id", "text_hash", _marked("text").alias("marked")), "doc_id", "text_hash").select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"), F.col("token").alias("_t"), F.col("kind").alias("_k"), "value", F.col("first").alias("_f"))
        same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_h")) & (F.col("item_token") + F.col("shift") == F.col("_t")) & (F.col("kind") == F.col("_k"))
        pairs = places.join(theirs, same, "left").filter("not (item_first and (value is null or _f and item_value = value))")  # those are words to both sides
        bad = materialize(_contradicting(pairs), "contradicting")
        same = [F.col("doc_id").eqNullSafe(F.col("_doc_id")), *[F.col(c) == F.col(f"_{c}") for c in ("text_hash", "item", "shift")]]
        found = found.join(bad, same[0] & same[1] & same[2] & same[3] & F.expr("_item_token >= item_at and _item_token < item_at + size"), "left_anti")
    each = found.groupBy("doc_id", "text_hash", "item", "item_id").agg(F.count_distinct("item_at").alias("matched"), F.first("windows").alias("windows"))
    return each.filter(F.col("matched") >= F.ceil(COVERAGE * F.col("windows"))).select("doc_id", "text_hash", "item_id", "matched", "windows")


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, matched and windows (counts): one row for each document with an id and each item that contaminates it."""
    found = _hits(docs, benchmark).filter("doc_id is not null")
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("matched") / F.col("windows")).alias("share"), "matched", "windows")).alias("m"))
    return best.select("doc_id", "item_id", F.col("m.matched").cast("long").alias("matched"), F.col("m.windows").cast("long").alias("windows"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` that no item contaminates, with all columns."""
    gone = materialize(_hits(docs, benchmark).select(F.col("doc_id").alias("_doc_id"), F.col("text_hash").alias("_text_hash")).distinct(), "contaminated")
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["_doc_id"]) & (F.xxhash64(docs["text"]) == gone["_text_hash"]), "left_anti")
