"""Quality rules: hard limits, then robust multivariate outliers per language and source.

`statistics` counts words, symbols, repeated lines and repeated word windows over whole texts. Texts that break a hard limit
fail at once. For the others a vector of transformed statistics is compared with its group's minimum-covariance-determinant
(MCD) estimate: the mean and covariance of that COVERAGE share of the rows whose covariance has the smallest determinant. The search
has STARTS starts in each group, the coordinate-wise medians and quartiles and the rest subsets of one row more than there are dimensions,
drawn by a hash. From each, concentration steps take the rows with the smallest Mahalanobis distances until the determinant
falls by less than TOLERANCE; the start with the smallest determinant wins. A row whose distance exceeds the CUTOFF quantile of the
chi-squared law is rejected.

A step is one aggregation: sums and cross products by group, start and distance bin (partial sums are formed before the shuffle,
so a source with a third of all rows is no hot spot), from which each group takes the bins up to its coverage. Of the bin at
the border, BINS_PER_OCTAVE of which double a distance, each row counts with the share that is missing. Groups below
MIN_ROWS are pooled by language, then altogether; a pool that is still below it passes no verdict. FLOORS are part of every covariance
and its determinant and keep it from collapsing where most rows have the same value.

Defined results: a null or empty text has zero counts and fails (too few words); null languages and sources are groups like any
other; null and repeated ids and repeated rows are judged like any other row; extra columns are kept by `reject`; an empty table gives
no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verilume.llm import textnum
from verilume.llm.common import drop, map_texts, materialize

SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
DIMS = ("word_length", "symbols", "dup_lines", "repeats")
#: The standard deviation that each dimension is allowed besides the estimated one: a line or passage that returns is no fault yet,
#: but repeats just below MAX_REPEAT_PERCENT, or that many words in repeated lines of 12, must pass the CUTOFF alone.
FLOORS = (0.25, 0.02, 0.12, 0.12)
COVERAGE, CUTOFF, MIN_ROWS = 0.75, 0.9999, 50
STARTS, TOLERANCE, BINS_PER_OCTAVE = 5, 1e-4, 64
#: Groups whose models are broadcast (about 200 bytes for each start of one); more are joined by a shuffle.
LOOKUP_GROUPS = 50_000
#: Bytes of text at a time; counting takes some 40 times as much memory.
BATCH = 1 << 20


def counts(buf: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """The columns COUNTS of each text."""
    n = len(offs) - 1
    per_row = lambda mask: (lambda c: c[offs[1:]] - c[offs[:-1]])(np.concatenate([[0], np.cumsum(mask, dtype=np.int64)]))
    start, end, row = textnum.words(buf, offs)
    inside = ~textnum.is_space(buf)
    chars = per_row(inside & ((buf & 0xC0) != 0x80))
    symbols = per_row(np.isin(buf, np.frombuffer(SYMBOLS.encode(), np.uint8)))

    breaks = np.flatnonzero(buf == 10)
    first, last = np.sort(np.concatenate([offs[:-1], breaks + 1])), np.sort(np.concatenate([breaks, offs[1:]]))
    seen = np.concatenate([[0], np.cumsum(inside)])
    with_word = seen[last] > seen[first]
    first, last = first[with_word], last[with_word]
    line_row = np.searchsorted(offs, first, side="right") - 1
    _, kinds = textnum.distinct_by_row(textnum.span_hashes(buf, first, last), line_row, n)
    dup_lines = np.bincount(line_row, minlength=n) - np.diff(kinds)

    hashes = textnum.span_hashes(buf, start, end)
    covered = np.zeros(len(row), bool)
    if len(row) >= 3:
        head = np.flatnonzero(row[:-2] == row[2:])
        value, _ = textnum.shingles(hashes[np.concatenate([head, head + 1, head + 2]).reshape(3, -1).T.ravel()], np.repeat(np.arange(len(head)), 3), len(head), 3)
        order = np.lexsort((value, row[head]))
        same = (value[order][1:] == value[order][:-1]) & (row[head][order][1:] == row[head][order][:-1])
        again = np.zeros(len(head), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        for i in range(3):
            covered[head[again] + i] = True
    return [np.bincount(row, minlength=n), chars, symbols, dup_lines, np.bincount(row[covered], minlength=n)]


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, text_hash, the columns COUNTS and base_failed for each row."""

    def run(batch: pa.RecordBatch):
        made = counts(*textnum.text_bytes(batch.column("text")))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), batch.column(3), *[pa.array(c.astype(np.int64)) for c in made]], ["doc_id", "lang", "source", "text_hash", *COUNTS])

    picked = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("source").cast("string"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string"))
    made = map_texts(picked, run, "doc_id long, lang string, source string, text_hash long, " + ", ".join(f"{c} long" for c in COUNTS), limit=BATCH)
    return made.withColumn("base_failed", failed())


def failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def vector() -> list[Column]:
    """DIMS: mean word length; roots of the shares of symbols, of repeated lines per ten words, and of repeated words."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [
        F.col("word_chars") / n,
        F.sqrt(F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))),
        F.sqrt(10.0 * F.col("n_dup_lines") / n),
        F.sqrt(F.col("n_repeat_words") / n),
    ]


def gamma_share(a: float, x: float) -> float:
    """The regularised lower incomplete gamma function, by its series."""
    term = total = 1.0 / a
    k = a
    while term > total * 1e-15:
        k += 1
        term *= x / k
        total += term
    return min(1.0, total * math.exp(-x + a * math.log(x) - math.lgamma(a))) if x > 0 else 0.0


def chi2_quantile(share: float, d: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if gamma_share(d / 2, mid / 2) < share else (lo, mid)
    return hi


MODEL = "g string, start int, mean array<double>, inv array<double>, logdet double, still boolean"


def _model(group, start: int, mean: np.ndarray, cov: np.ndarray, was: float) -> dict:
    whole = cov + np.diag(np.square(FLOORS))
    logdet = float(np.linalg.slogdet(whole)[1])
    return {"g": group, "start": start, "mean": mean.tolist(), "inv": np.linalg.inv(whole).ravel().tolist(), "logdet": logdet, "still": not logdet < was - TOLERANCE}


def consistency(share: float) -> float:
    """What the covariance of the nearest `share` of normal rows is multiplied by to be that of all."""
    d = len(DIMS)
    return max(1.0, share / gamma_share(d / 2 + 1, chi2_quantile(share, d) / 2)) if share < 1 else 1.0


def _concentrated(bins: pd.DataFrame) -> pd.DataFrame:
    """The next model of one group and start from its distance bins: the mean and covariance of the nearest COVERAGE share."""
    d = len(DIMS)
    bins = bins.sort_values("bin")
    n = bins["n"].to_numpy()
    total, h = n.sum(), math.ceil(COVERAGE * n.sum())
    weight = np.clip((h - (n.cumsum() - n)) / n, 0.0, 1.0)
    s = np.array([weight @ bins[f"s{i}"].to_numpy() for i in range(d)]) / h
    cov = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            cov[i, j] = cov[j, i] = weight @ bins[f"c{i}_{j}"].to_numpy() / h - s[i] * s[j]
    return pd.DataFrame([_model(bins["g"].iloc[0], int(bins["start"].iloc[0]), s, consistency(h / total) * cov, bins["logdet"].iloc[0])])


def _first(groups: pd.DataFrame) -> pd.DataFrame:
    """The models that the search starts from."""
    rows = []
    for g, q, picked in zip(groups["g"], groups["q"], groups["picked"], strict=True):
        q = np.array([list(x) for x in q])
        rows.append(_model(g, 0, q[:, 1], np.diag(np.square((q[:, 2] - q[:, 0]) / 1.349)), math.inf))
        picked = np.array([list(x) for x in picked]).reshape(STARTS - 1, -1, len(DIMS))
        rows += [_model(g, i + 1, x.mean(axis=0), np.cov(x.T, bias=True), math.inf) for i, x in enumerate(picked)]
    out = pd.DataFrame(rows, columns=["g", "start", "mean", "inv", "logdet", "still"])
    return out.assign(logdet=math.inf, still=False)


def models(fit: DataFrame) -> DataFrame:
    """g, mean and inv (of the covariance) of each group with MIN_ROWS rows in `fit` (g, row: a number of the row, x0, x1, ...)."""
    d = len(DIMS)
    quartiles = F.array(*[F.percentile(F.round(f"x{i}", 3), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))) for i in range(d)])
    vectors = F.array(*[F.col(f"x{i}") for i in range(d)])
    picked = F.array(*[F.min_by(vectors, F.xxhash64("row", F.lit(i))) for i in range((STARTS - 1) * (d + 1))])
    groups = fit.groupBy("g").agg(F.count("*").alias("n"), quartiles.alias("q"), picked.alias("picked")).filter(F.col("n") >= MIN_ROWS)
    now = materialize(groups.select("g", "q", "picked").mapInPandas(lambda it: map(_first, it), MODEL), "models")
    near = F.broadcast if now.count() <= STARTS * LOOKUP_GROUPS else (lambda x: x)
    sums = [F.count("*").alias("n"), F.first("logdet").alias("logdet"), *[F.sum(f"x{i}").alias(f"s{i}") for i in range(d)]]
    sums += [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"c{i}_{j}") for i in range(d) for j in range(i, d)]
    steps = [now]
    while not now.filter("not still").isEmpty():
        at = fit.join(near(now.filter("not still")), "g").withColumn("bin", F.floor(BINS_PER_OCTAVE * F.log2(distance() + 1e-6)))
        now = materialize(at.groupBy("g", "start", "bin").agg(*sums).groupBy("g", "start").applyInPandas(_concentrated, MODEL), "models")
        steps.append(now)
    ended = steps[0].filter("still")
    for step in steps[1:]:
        ended = ended.union(step.filter("still"))
    best = ended.groupBy("g").agg(F.min(F.struct("logdet", "start", "mean", "inv")).alias("b"))
    out = materialize(best.select("g", "b.mean", "b.inv"), "models")
    drop(*steps)
    return out


def distance() -> Column:
    """The squared Mahalanobis distance of x0.. from mean under inv."""
    d = len(DIMS)
    off = [F.col(f"x{i}") - F.col("mean")[i] for i in range(d)]
    terms = [off[i] * off[j] * F.col("inv")[i * d + j] * (1 if i == j else 2) for i in range(d) for j in range(i, d)]
    return sum(terms[1:], terms[0])


def verdicts(docs: DataFrame) -> DataFrame:
    """The columns of `statistics`, distance (null without a verdict) and kept, for each row."""
    d = len(DIMS)
    stats = materialize(statistics(docs), "statistics")
    key = F.to_json(F.struct(F.coalesce("lang", F.lit("\0")).alias("l"), F.coalesce("source", F.lit("\0")).alias("s")))
    pool = F.to_json(F.struct(F.coalesce("lang", F.lit("\0")).alias("l")))
    good = stats.filter(~F.col("base_failed"))
    sizes = good.groupBy(key.alias("g"), pool.alias("p")).agg(F.count("*").alias("n"))
    pools = sizes.filter(F.col("n") < MIN_ROWS).groupBy("p").agg(F.sum("n").alias("pn"))
    names = sizes.join(pools, "p", "left").select("g", F.when(F.col("n") >= MIN_ROWS, F.col("g")).when(F.col("pn") >= MIN_ROWS, F.col("p")).otherwise(F.lit("*")).alias("to"))
    names = materialize(names, "groups")
    named = stats.withColumn("g", key).join(names, "g", "left").drop("g").withColumnRenamed("to", "g")
    for i, x in enumerate(vector()):
        named = named.withColumn(f"x{i}", x)
    named = materialize(named, "vectors")
    drop(stats, names)
    fit = named.filter(~F.col("base_failed")).select("g", F.xxhash64("doc_id", "text_hash").alias("row"), *[f"x{i}" for i in range(d)])
    found = models(fit)
    found = F.broadcast(found) if found.count() <= LOOKUP_GROUPS else found
    out = named.join(found, "g", "left").withColumn("distance", distance())
    inside = F.coalesce(F.col("distance") <= chi2_quantile(CUTOFF, d), F.lit(True))
    return out.select("doc_id", "lang", "source", "text_hash", *COUNTS, "base_failed", "distance", (~F.col("base_failed") & inside).alias("kept"))


def reject(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that are kept, with all columns. Rows are matched by id, language, source and text, so that equal
    ids with different texts keep verdicts of their own."""
    gone = verdicts(docs).filter(~F.col("kept")).select(*[F.col(c).alias(f"_{c}") for c in ("doc_id", "lang", "source", "text_hash")]).distinct()
    gone = materialize(gone, "rejected")
    own = (docs["doc_id"].cast("long"), docs["lang"].cast("string"), docs["source"].cast("string"), F.xxhash64(docs["text"]))
    same = [a.eqNullSafe(gone[f"_{c}"]) for a, c in zip(own, ("doc_id", "lang", "source", "text_hash"), strict=True)]
    return docs.join(gone, same[0] & same[1] & same[2] & same[3], "left_anti")
