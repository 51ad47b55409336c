"""Quality by perplexity under an interpolated modified Kneser-Ney model of byte n-grams, one per language, trained on trusted text.

A gram is a number: its bytes, the oldest first, so that a context is gram >> 8 and the next lower order a mask. Trusted texts are counted
in parts, whose sums are the table (lang_key, gram, n). Each order's counts (raw at the top, distinct left extensions below), discounts,
context sums and probabilities come from joins that are sharded by language and gram; few counts become the model in one pass per language.

Scoring has two ways with the same results. The model itself is the probabilities of the grams seen in trusted texts and the weights
of their contexts for what was not seen; while that has at most MODEL_ROWS rows (counted first) it is broadcast, and one scan scores all
texts by it. Beyond, nothing is broadcast: a pass over all texts writes, in parts of about HELD_GRAMS distinct grams, the texts
(compressed) and their grams; a join by language and gram gives the probability of every gram that occurs anywhere; a part's
answers and its texts then meet in one task, which holds those of one part and one slice of texts, whatever the corpus has.

One in HOLD_OUT trusted documents stays out of the training. A document is rejected if its perplexity exceeds its language's
threshold: the QUANTILE of the perplexities of the documents held out, times MARGIN, since the quantile of few documents is about their
maximum, which as many clean documents exceed as were held out for each one judged. A language without documents held
out takes the threshold of all languages together.

Defined results: null and empty texts have no perplexity and are kept; a language without trusted text has no model and its
documents are kept; null languages are a language of their own; null ids are never trusted; repeated ids and rows are scored row by
row; extra columns are kept by `reject`; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verilume.llm import textnum
from verilume.llm.common import drop, materialize, step

ORDER, BYTE = 5, 256
QUANTILE, MARGIN, HOLD_OUT = 0.999, 1.2, 5
#: Ids of trusted documents, and languages, that are broadcast if they are so few (8 bytes an id, some 50 a language).
LOOKUP_ROWS, LANGUAGES = 500_000, 50_000
#: Rows of the model that are broadcast (20 bytes each; a worker's table of them has 24 to 48).
MODEL_ROWS = 2_000_000
#: Distinct grams, and bytes of text, after which a part ends; bytes of text that are handled at a time.
HELD_GRAMS, PART_BYTES, SLICE = 1 << 20, 64 << 20, 1 << 20


def grams(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """For each byte the number made of it and the ORDER - 1 bytes before it in its text (zeros before the start)."""
    out = buf.astype(np.uint64)
    at = np.arange(len(buf)) - np.repeat(offs[:-1], np.diff(offs))
    for back in range(1, ORDER):
        ok = np.flatnonzero(at >= back)
        out[ok] |= buf[ok - back].astype(np.uint64) << np.uint64(8 * back)
    return out


def _keyed(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Offsets, grams tagged with the number of their language above the gram's bytes, the languages' keys, bytes per row."""
    buf, offs = textnum.text_bytes(batch.column("text"))
    keys, number = np.unique(batch.column("lang_key").to_numpy(), return_inverse=True)
    size = np.diff(offs)
    return offs, grams(buf, offs) | (np.repeat(number, size).astype(np.uint64) << np.uint64(8 * ORDER)), keys, size


def _untag(tagged: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return keys[(tagged >> np.uint64(8 * ORDER)).astype(np.int64)], (tagged & np.uint64((1 << 8 * ORDER) - 1)).astype(np.int64)


def marked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, lang_key, text_hash, text, trusted and held_out of each row. The ids that `labels` gives quality 1 are either."""
    good = labels.filter("quality = 1").select(F.col("doc_id").alias("_id")).distinct()
    good = F.broadcast(good) if good.count() <= LOOKUP_ROWS else good
    picked = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.xxhash64(F.coalesce("lang", F.lit("\0"))).alias("lang_key"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string"))
    out = F.pmod(F.xxhash64("_id"), F.lit(HOLD_OUT)) == 0
    is_good = F.col("_id").isNotNull()
    return picked.join(good, F.col("doc_id") == F.col("_id"), "left").select(*picked.columns, (is_good & ~out).alias("trusted"), (is_good & out).alias("held_out"))


KEPT = ("doc_id", "lang", "text_hash", "held_out")


def _blob(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


class _Grams:
    """The distinct grams of some texts by language, with their numbers in trusted texts."""

    def __init__(self):
        self.held: dict[int, list] = {}
        self.bytes = 0

    def add(self, batch: pa.RecordBatch) -> None:
        _, tagged, keys, size = _keyed(batch)
        self.bytes += int(size.sum())
        good = np.repeat(batch.column("trusted").to_numpy(zero_copy_only=False), size)
        found = np.unique(tagged)
        trusted, m = np.unique(tagged[good], return_counts=True)
        n = np.zeros(len(found), np.int64)
        n[np.searchsorted(found, trusted)] = m
        of, gram = _untag(found, keys)
        for key in keys.tolist():
            g, c = gram[of == key], n[of == key]
            if key in self.held:
                g, inverse = np.unique(np.concatenate([self.held[key][0], g]), return_inverse=True)
                total = np.zeros(len(g), np.int64)
                np.add.at(total, inverse, np.concatenate([self.held[key][1], c]))
                c = total
            self.held[key] = [g, c]

    def full(self, most: int) -> bool:
        return self.bytes >= PART_BYTES or sum(len(g) for g, _ in self.held.values()) >= most


PARTS = "part long, lang_key long, gram long, n long, blob binary"


def parts(texts: DataFrame, held_grams: int = HELD_GRAMS, size: int = SLICE, with_texts: bool = True) -> DataFrame:
    """PARTS: a row with n for each distinct gram of each part of the texts, and, on demand, rows with a blob that hold the part's texts."""
    names = [c.split()[0] for c in PARTS.split(", ")]

    def run(batches):
        from pyspark import TaskContext

        first, seq, held = TaskContext.get().partitionId() << 32, 0, _Grams()

        def end():
            for key, (gram, n) in held.held.items():
                m = len(gram)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, first + seq)), pa.array(np.full(m, key, np.int64)), pa.array(gram), pa.array(n), pa.nulls(m, pa.binary())], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            _, offs = textnum.text_bytes(batch.column("text"))
            for i, j in textnum.slices(offs, size):
                piece = batch.slice(i, j - i)
                held.add(piece)
                none = pa.nulls(1, pa.int64())
                if with_texts:
                    yield pa.RecordBatch.from_arrays([pa.array([first + seq]), none, none, none, pa.array([_blob(piece)], pa.binary())], names)
                if held.full(held_grams):
                    yield from end()
                    seq, held = seq + 1, _Grams()
        yield from end()

    return texts.select(*KEPT, "lang_key", "trusted", "text").mapInArrow(step(run), PARTS)


def gram_counts(made: DataFrame) -> DataFrame:
    """lang_key, gram, n: every gram of every part, with its number in trusted texts."""
    return made.filter("n is not null").groupBy("lang_key", "gram").agg(F.sum("n").alias("n"))


def _lower(gram: str, order: int) -> Column:
    """The last `order` bytes of a gram."""
    return F.col(gram).bitwiseAND(F.lit(BYTE**order - 1).cast("long"))


LEAST = 1e-12


def probabilities(counts: DataFrame) -> DataFrame:
    """lang_key, gram, logp for every gram in `counts`; languages without trusted text are left out."""
    counted = {ORDER: counts.filter("n > 0").select("lang_key", "gram", F.col("n").alias("c"))}
    occurring = {ORDER: counts.select("lang_key", "gram")}
    for k in range(ORDER - 1, 0, -1):
        counted[k] = materialize(counted[k + 1].groupBy("lang_key", _lower("gram", k).alias("gram")).agg(F.count("*").alias("c")), f"order{k}")
        occurring[k] = occurring[k + 1].select("lang_key", _lower("gram", k).alias("gram")).distinct()
    per_language = F.broadcast if counted[1].select("lang_key").distinct().count() <= LANGUAGES else (lambda x: x)
    p = occurring[1].join(counted[1].select("lang_key").distinct(), "lang_key", "left_semi").select("lang_key", F.lit(0).cast("long").alias("gram"), F.lit(1.0 / BYTE).alias("p")).distinct()
    for k in range(1, ORDER + 1):
        n = [F.count_if(F.col("c") == i) for i in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        steps = [F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(float(i + 1)), (i + 1) - (i + 2) * y * n[i + 1] / n[i])), F.lit(0.5 * (i + 1))) for i in range(3)]
        guarded = [F.when((n[0] > 0) & (n[i] > 0) & (n[1] + n[0] > 0), steps[i]).otherwise(F.lit(0.5 * (i + 1))) for i in range(3)]
        discounts = counted[k].groupBy("lang_key").agg(*[g.alias(f"d{i + 1}") for i, g in enumerate(guarded)])
        d = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        cut = counted[k].join(per_language(discounts), "lang_key").select("lang_key", "gram", "c", F.least(d, F.col("c").cast("double")).alias("d"))
        contexts = cut.groupBy("lang_key", F.shiftright("gram", 8).alias("context")).agg(F.sum("c").alias("total"), F.sum("d").alias("left"))
        contexts = materialize(contexts, f"contexts{k}")
        own = occurring[k].join(cut, ["lang_key", "gram"], "left").withColumn("context", F.shiftright("gram", 8)).withColumn("shorter", _lower("gram", k - 1))
        own = own.join(contexts, ["lang_key", "context"], "left")
        own = own.join(p.select("lang_key", F.col("gram").alias("shorter"), F.col("p").alias("back")), ["lang_key", "shorter"])
        p = own.select("lang_key", "gram", F.coalesce((F.coalesce(F.col("c") - F.col("d"), F.lit(0.0)) + F.col("left") * F.col("back")) / F.col("total"), F.col("back")).alias("p"))
        p = materialize(p, f"p{k}")
    return p.select("lang_key", "gram", F.log(F.greatest("p", F.lit(LEAST))).alias("logp"))


MODEL = "lang_key long, kind int, gram long, value double"


def _discounts(c: np.ndarray) -> np.ndarray:
    """What is taken off each of the counts `c` of one order and language."""
    n = [np.count_nonzero(c == i) for i in (1, 2, 3, 4)]
    d = [0.5, 1.0, 1.5]
    for i in range(3):
        if n[0] and n[i]:
            d[i] = min(max(i + 1 - (i + 2) * n[0] / (n[0] + 2 * n[1]) * n[i + 1] / n[i], 0.0), i + 1.0)
    return np.minimum(np.array(d)[np.minimum(c, 3) - 1], c)


def _language(gram: np.ndarray, n: np.ndarray):
    """kind, grams, values of one language's model, order by order; probabilities as `probabilities` has them."""
    counted = {ORDER: (gram[order := np.argsort(gram)], n[order])}
    for k in range(ORDER - 1, 0, -1):
        counted[k] = np.unique(counted[k + 1][0] & (BYTE**k - 1), return_counts=True)
    shorter, back = np.zeros(1, np.int64), np.full(1, 1.0 / BYTE)
    for k in range(1, ORDER + 1):
        own, c = counted.pop(k)
        d = _discounts(c)
        contexts, at = np.unique(own >> 8, return_inverse=True)
        total, left = np.bincount(at, c), np.bincount(at, d)
        back = (c - d + left[at] * back[np.searchsorted(shorter, own & (BYTE ** (k - 1) - 1))]) / total[at]
        shorter = own
        yield k - 1, own, np.log(np.maximum(back, LEAST))
        yield ORDER + k - 1, contexts, np.log(np.maximum(left / total, LEAST))


def model(counts: DataFrame) -> DataFrame:
    """MODEL: log probabilities (kind: order - 1) and log weights of contexts (kind: ORDER + order - 1). One task has a language's rows, so
    `counts` must be few; a table and a join for each step of each order would be some fifty shuffles for them."""

    def run(batches):
        def end():
            for kind, grams, value in _language(*(np.concatenate(x) for x in held)):
                m = len(grams)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, key)), pa.array(np.full(m, kind, np.int32)), pa.array(grams), pa.array(value)], ["lang_key", "kind", "gram", "value"])

        key, held = None, ([], [])
        for batch in batches:
            keys, gram, n = (batch.column(c).to_numpy() for c in ("lang_key", "gram", "n"))
            edges = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                if i == j:
                    continue
                if keys[i] != key:
                    if held[0]:
                        yield from end()
                    key, held = keys[i], ([], [])
                held[0].append(gram[i:j].copy())
                held[1].append(n[i:j].copy())
        if held[0]:
            yield from end()

    rows = counts.filter("n > 0").select("lang_key", "gram", "n")
    return rows.repartition("lang_key").sortWithinPartitions("lang_key").mapInArrow(step(run), MODEL)


class Lookup:
    """An open-addressing table from gram numbers to log probabilities."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.zeros(1 << self.bits, np.float32)
        at, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = self.keys[at[todo]] == -1
            put = todo[free]
            self.keys[at[put]] = keys[put]
            self.values[at[put]] = values[put]
            todo = todo[self.keys[at[todo]] != keys[todo]]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The value of each key, 0 for those that aren't here, and which are."""
        at = self._slot(keys)
        found = self.keys[at]
        todo = np.flatnonzero((found != keys) & (found != -1))
        while len(todo):
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            found[todo] = self.keys[at[todo]]
            todo = todo[(found[todo] != keys[todo]) & (found[todo] != -1)]
        hit = found == keys
        return np.where(hit, self.values[at], 0), hit


class Model:
    """The broadcast model: numbers of its languages, and what `model` says, by kind, language and gram."""

    def __init__(self, key: np.ndarray, kind: np.ndarray, gram: np.ndarray, value: np.ndarray):
        langs = np.unique(key)
        self.numbers = {k: i for i, k in enumerate(langs.tolist())}
        self.lookup = Lookup(gram | (np.searchsorted(langs, key) << (8 * ORDER)) | (kind.astype(np.int64) << 58), value)

    def scores(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        offs, tagged, keys, size = _keyed(batch)
        there = np.array([self.numbers.get(k, -1) for k in keys.tolist()], np.int64)
        number = there[(tagged >> np.uint64(8 * ORDER)).astype(np.int64)]
        gram = (tagged & np.uint64((1 << 8 * ORDER) - 1)).astype(np.int64)
        logp, at = np.zeros(len(gram)), np.flatnonzero(number >= 0)
        lang = number << (8 * ORDER)
        for k in range(ORDER, 0, -1):
            own = gram[at] & (BYTE**k - 1)
            value, hit = self.lookup.get(own | lang[at] | (k - 1 << 58))
            logp[at] += value
            at, own = at[~hit], own[~hit]
            logp[at] += self.lookup.get((own >> 8) | lang[at] | (ORDER + k - 1 << 58))[0]
        logp[at] -= np.log(BYTE)
        return _summed(batch, offs, size, logp, number >= 0)


def _summed(batch: pa.RecordBatch, offs: np.ndarray, size: np.ndarray, logp: np.ndarray, hit: np.ndarray) -> pa.RecordBatch:
    sums, hits = (np.concatenate([[0], np.cumsum(x, dtype=np.float64)]) for x in (logp, hit))
    found = [pa.array(size), pa.array(sums[offs[1:]] - sums[offs[:-1]]), pa.array((hits[offs[1:]] - hits[offs[:-1]]).astype(np.int64))]
    return pa.RecordBatch.from_arrays([*[batch.column(c) for c in KEPT], *found], [*KEPT, "n_bytes", "logp", "hits"])


SCORES = "doc_id long, lang string, text_hash long, held_out boolean, n_bytes long, logp double, hits long"


def _by_broadcast(texts: DataFrame, made: DataFrame, size: int) -> DataFrame:
    got = made.select("lang_key", F.col("kind").cast("tinyint").alias("kind"), "gram", F.col("value").cast("float").alias("value")).toArrow()
    sent = texts.sparkSession.sparkContext.broadcast(tuple(got[c].to_numpy() for c in ("lang_key", "kind", "gram", "value")))
    del got

    def run(batches):
        table = None
        for batch in batches:
            if batch.num_rows:
                table = table or Model(*sent.value)
                _, offs = textnum.text_bytes(batch.column("text"))
                for i, j in textnum.slices(offs, size):
                    yield table.scores(batch.slice(i, j - i))

    out = materialize(texts.select(*KEPT, "lang_key", "text").mapInArrow(step(run), SCORES), "scores")
    sent.destroy()
    return out


def _by_joins(texts: DataFrame, held_grams: int, size: int) -> DataFrame:
    made = materialize(parts(texts, held_grams, size), "parts")
    counts = materialize(gram_counts(made), "grams")
    answers = _answers(made.filter("n is not null").select("part", "lang_key", "gram"), probabilities(counts))
    both = answers.withColumn("is_text", F.lit(False)).select("part", "is_text", "blob").union(made.filter("blob is not null").select("part", F.lit(True), "blob"))
    out = materialize(both.repartition("part").sortWithinPartitions("part", "is_text").mapInArrow(step(_scored), SCORES), "scores")
    drop(made, counts)
    return out


def _pack(key: np.ndarray, gram: np.ndarray, value: np.ndarray) -> bytes:
    """The three columns in few bytes: grams come in order, so their differences are small."""
    raw = key.tobytes() + np.diff(gram, prepend=0).tobytes() + value.astype(np.float32).tobytes()
    return len(gram).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = int.from_bytes(blob[:8], "little")
    raw = pa.decompress(blob[8:], decompressed_size=20 * n, codec="zstd", asbytes=True)
    return np.frombuffer(raw, np.int64, n), np.cumsum(np.frombuffer(raw, np.int64, n, 8 * n)), np.frombuffer(raw, np.float32, n, 16 * n)


def _answers(asked: DataFrame, logp: DataFrame) -> DataFrame:
    """part, blob (numbers of grams, languages and log probabilities) of the parts' grams, several rows for a part."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                part, key, gram, value = (batch.column(c).to_numpy() for c in ("part", "lang_key", "gram", "logp"))
                order = np.argsort(part, kind="stable")
                ids, starts = np.unique(part[order], return_index=True)
                blobs = [_pack(key[o], gram[o], value[o]) for o in np.split(order, starts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(blobs, pa.binary())], ["part", "blob"])

    joined = asked.join(logp, ["lang_key", "gram"]).select("part", "lang_key", "gram", "logp").sortWithinPartitions("part")
    return joined.mapInArrow(step(run), "part long, blob binary")


class _Table:
    """The answers of one part: log probabilities by language and gram."""

    def __init__(self, blobs: list[bytes]):
        cells = [_unpack(b) for b in blobs] or [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))]
        key, gram, value = (np.concatenate(c) for c in zip(*cells, strict=True))
        langs = np.unique(key)
        self.numbers = {k: i for i, k in enumerate(langs.tolist())}
        self.lookup = Lookup(gram | (np.searchsorted(langs, key) << (8 * ORDER)), value)

    def scores(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        offs, tagged, keys, size = _keyed(batch)
        there = np.array([self.numbers.get(k, -1) for k in keys.tolist()], np.int64)
        number = there[(tagged >> np.uint64(8 * ORDER)).astype(np.int64)]
        code = (tagged & np.uint64((1 << 8 * ORDER) - 1)).astype(np.int64) | (number << (8 * ORDER))
        code[number < 0] = -2
        return _summed(batch, offs, size, *self.lookup.get(code))


def _scored(batches):
    """The scores of the texts in rows (part, is_text, blob), which come ordered by part and is_text."""
    part, blobs, table = None, [], None
    for batch in batches:
        for p, is_text, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if p != part:
                part, blobs, table = p, [], None
            if not is_text:
                blobs.append(blob.as_py())
                continue
            if table is None:
                table, blobs = _Table(blobs), []
            with pa.ipc.open_stream(blob.as_buffer()) as texts:
                for piece in texts:
                    yield table.scores(piece)


def perplexities(texts: DataFrame, held_grams: int = HELD_GRAMS, size: int = SLICE, model_rows: int = MODEL_ROWS) -> DataFrame:
    """doc_id, lang, text_hash, held_out, n_bytes, perplexity (null without a model or text) of each row."""
    counts = materialize(gram_counts(parts(texts.filter("trusted"), held_grams, size, with_texts=False)), "grams")
    few = counts.count() <= model_rows and counts.select("lang_key").distinct().count() <= LANGUAGES
    made = materialize(model(counts), "model") if few else None
    if few and made.count() <= model_rows:
        out = _by_broadcast(texts, made, size)
    else:
        out = _by_joins(texts, held_grams, size)
    drop(counts, *([made] if few else []))
    scored = F.when((F.col("n_bytes") > 0) & (F.col("hits") == F.col("n_bytes")), F.exp(-F.col("logp") / F.col("n_bytes")))
    return out.select(*KEPT, "n_bytes", scored.alias("perplexity"))


def verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, text_hash, n_bytes, perplexity, threshold and kept for each row of `docs`."""
    scored = perplexities(marked(docs, labels))
    limit = (F.exp(F.percentile(F.round(F.log("perplexity"), 3), F.lit(QUANTILE))) * MARGIN).alias("limit")
    held_out = scored.filter("held_out and perplexity is not null")
    limits = held_out.groupBy("lang").agg(limit).withColumnRenamed("lang", "_lang")
    limits = F.broadcast(limits) if limits.count() <= LANGUAGES else limits
    out = scored.join(limits, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    pooled = F.lit(held_out.agg(limit).first()["limit"]).cast("double")
    out = out.withColumn("threshold", F.when(F.col("perplexity").isNotNull(), F.coalesce("limit", pooled)))
    return out.select("doc_id", "lang", "text_hash", "n_bytes", "perplexity", "threshold", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)).alias("kept"))


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that are kept, with all columns."""
    gone = verdicts(docs, labels).filter(~F.col("kept")).select(F.col("doc_id").alias("_doc_id"), F.col("lang").alias("_lang"), F.col("text_hash").alias("_text_hash")).distinct()
    gone = materialize(gone, "rejected")
    same = docs["doc_id"].cast("long").eqNullSafe(gone["_doc_id"]) & docs["lang"].cast("string").eqNullSafe(gone["_lang"]) & (F.xxhash64(docs["text"]) == gone["_text_hash"])
    return docs.join(gone, same, "left_anti")
