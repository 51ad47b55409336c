"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct runs of GRAM_SIZES bytes of a text in small ASCII letters, hashed to FEATURES buckets. The log-count
ratio of a bucket compares its document frequency in toxic and other training rows; it is counted over all labelled training
rows. Buckets that tell the classes apart (a ratio of MIN_RATIO and SIGNIFICANT standard errors, MIN_DOCS documents) form the model; a logistic
regression over their ratio-scaled presence is fitted on at most SAMPLE rows of each class, taken in the order of a hash of
the id: the driver holds one number (8 bytes) for each of their features that is in the model, FEATURES a row at most. A score is the sigmoid of the sum over a whole text; the bias is the score of an empty text.

Rows whose crc32 of the id in decimal is 0 modulo FOLDS are never learnt from. Labels, languages, sources and ids are no inputs.

Defined results: null and empty texts get the bias's score; rows with null ids are scored, and not held out (they have no
label either); repeated ids and rows are scored row by row; of the texts with one id in the
sample, the one with the smallest features is taken; without labelled rows of both classes every score is that of -30, about 1e-13; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verilume.llm import textnum
from verilume.llm.common import map_texts, materialize

GRAM_SIZES, FEATURES = (4, 6), 1 << 20
FOLDS, SAMPLE, MIN_DOCS, SIGNIFICANT, MIN_RATIO, SMOOTHING = 5, 2000, 5, 4.0, float(np.log(2)), 1.0
LOOKUP_ROWS = 500_000


def buckets(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The feature and the row of every n-gram; the result isn't distinct. A text is read with a space on each side."""
    n = len(offs) - 1
    size = np.diff(offs) + 2
    at = np.concatenate([[0], np.cumsum(size)])
    padded = np.full(int(at[-1]), 32, np.uint8)
    padded[np.arange(len(buf)) + np.repeat(2 * np.arange(n) + 1, np.diff(offs))] = textnum.lowered(buf)
    row = np.repeat(np.arange(n), size)
    out, rows = [], []
    for k in GRAM_SIZES:
        if len(padded) >= k:
            h = np.full(len(padded) - k + 1, k, np.uint64)
            for i in range(k):
                h = h * np.uint64(0x100000001B3) + padded[i : len(padded) - k + 1 + i]
            inside = row[: len(h)] == row[k - 1 :]
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            out.append((h >> np.uint64(64 - FEATURES.bit_length() + 1)).astype(np.int64)[inside])
            rows.append(row[: len(h)][inside])
    return (np.concatenate(out), np.concatenate(rows)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def distinct(feature: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(row * FEATURES + feature)
    return both % FEATURES, both // FEATURES


@dataclass
class Model:
    """weights: one for each bucket, 0 for those outside the model."""

    bias: float
    weights: np.ndarray

    def scores(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        feature, row = buckets(buf, offs)
        used = self.weights[feature] != 0
        feature, row = distinct(feature[used], row[used])
        z = self.bias + np.bincount(row, self.weights[feature], minlength=len(offs) - 1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(row: np.ndarray, col: np.ndarray, toxic: np.ndarray, scale: np.ndarray, prior: float, steps: int = 1500, penalty: float = 1e-5) -> tuple[float, np.ndarray]:
    """Bias and weights over presence times scale, by accelerated gradient descent; row and col say which text has which
    feature, prior is the share of toxic rows among all training rows, which the sample's rows are weighted to."""
    n = len(toxic)
    share = np.where(toxic == 1, prior / max(1, toxic.sum()), (1 - prior) / max(1, n - toxic.sum()))
    x = scale[col]
    norm = np.bincount(row, x * x, minlength=n).max(initial=0) + 1
    w, b = np.zeros(len(scale)), 0.0
    last_w, last_b = w, b
    for t in range(steps):
        v, c = w + (t / (t + 3)) * (w - last_w), b + (t / (t + 3)) * (b - last_b)
        z = c + np.bincount(row, x * v[col], minlength=n)
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - toxic) * share
        last_w, last_b = w, b
        w = v - 4 / norm * (np.bincount(col, x * g[row], minlength=len(scale)) + penalty * v)
        b = c - 4 / norm * g.sum()
    return b, w * scale


def held_out(doc_id: str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    spark = docs.sparkSession
    known = labels.filter("toxic is not null and doc_id is not null").filter(~held_out("doc_id")).groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").alias("toxic"))
    known = materialize(known.withColumn("order", F.xxhash64("id")), "labels")
    own = F.broadcast(known) if known.count() <= LOOKUP_ROWS else known
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string")).join(own, "id").select("id", "text", "toxic")

    def count(batches):
        found = np.zeros((2, FEATURES), np.int64)
        rows = np.zeros(2, np.int64)
        for batch in batches:
            if batch.num_rows:
                buf, offs = textnum.text_bytes(batch.column("text"))
                toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
                rows += np.bincount(toxic, minlength=2)[:2]
                for i, j in textnum.slices(offs, 1 << 20):
                    feature, row = distinct(*buckets(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]))
                    of = toxic[i:j][row]
                    for c in (0, 1):
                        found[c] += np.bincount(feature[of == c], minlength=FEATURES)
        used = np.flatnonzero(found.sum(axis=0))
        names = ["feature", "clean", "toxic"]
        yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array(rows[:1]), pa.array(rows[1:])], names)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(found[0, used]), pa.array(found[1, used])], names)

    table = texts.select("text", "toxic").mapInArrow(count, "feature long, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    table = materialize(table, "counts")
    total = table.filter("feature = -1").collect()
    n0, n1 = (total[0]["clean"], total[0]["toxic"]) if total else (0, 0)
    weights = np.zeros(FEATURES)
    if not (n0 and n1):
        return Model(-30.0, weights)
    got = table.filter(f"feature >= 0 and clean + toxic >= {MIN_DOCS}").toArrow()  # FEATURES rows at most
    feature, c0, c1 = (got[c].to_numpy() for c in ("feature", "clean", "toxic"))
    ratio = np.log((c1 + SMOOTHING) / (n1 + 2 * SMOOTHING)) - np.log((c0 + SMOOTHING) / (n0 + 2 * SMOOTHING))
    error = np.sqrt(1 / (c1 + SMOOTHING) + 1 / (c0 + SMOOTHING))
    kept = np.abs(ratio) >= np.maximum(SIGNIFICANT * error, MIN_RATIO)
    feature, ratio = feature[kept], ratio[kept]
    place = np.full(FEATURES, -1, np.int64)
    place[feature] = np.arange(len(feature))

    sample = known.filter("toxic = 0").orderBy("order", "id").limit(SAMPLE).union(known.filter("toxic = 1").orderBy("order", "id").limit(SAMPLE))
    picked = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string")).join(F.broadcast(sample), "id").select("id", "text", "toxic")
    sent = spark.sparkContext.broadcast(place)

    def features(batch: pa.RecordBatch):
        buf, offs = textnum.text_bytes(batch.column("text"))
        feature, row = buckets(buf, offs)
        at = sent.value[feature]
        both = np.unique(row[at >= 0] * FEATURES + at[at >= 0])
        lists = np.split(both % FEATURES, np.searchsorted(both // FEATURES, np.arange(1, batch.num_rows)))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("toxic").cast(pa.int32()), pa.array([x.tolist() for x in lists], pa.list_(pa.int64()))], ["id", "toxic", "at"])

    one = map_texts(picked, features, "id long, toxic int, at array<long>").groupBy("id").agg(F.min(F.struct("toxic", "at")).alias("m"))
    rows = one.select("id", "m.*").orderBy("id").toArrow()
    lists = rows["at"].combine_chunks()
    at = np.repeat(np.arange(len(lists), dtype=np.int32), np.diff(lists.offsets.to_numpy()))
    bias, w = logistic(at, lists.flatten().to_numpy().astype(np.int32), rows["toxic"].to_numpy().astype(np.int64), ratio, n1 / (n0 + n1))
    weights[feature] = w
    return Model(float(bias), weights)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of each row."""
    sent = docs.sparkSession.sparkContext.broadcast((model.bias, model.weights.astype(np.float32)))

    def run(batch: pa.RecordBatch):
        found = Model(*sent.value).scores(*textnum.text_bytes(batch.column("text")))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], ["doc_id", "score"])

    out = map_texts(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, score double", limit=2 << 20)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))
