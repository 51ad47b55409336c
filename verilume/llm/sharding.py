"""A uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

Every input partition learns from one row of the matrix how many of its rows go to which cell of which shard. The matrix is
drawn at once, row by row, from the multivariate hypergeometric distribution of what a uniform permutation of all rows would
do, so its column sums are the exact cell sizes. Rows are permuted inside their partition (a rank by a keyed hash), dealt
out by their rank, and permuted again inside their cell; the cells of a shard lie one after the other, which gives gapless
slots without another count.

Only the digest of each row (id, size, checksum, partition) is shuffled, never its text. The matrix has at most
MAX_PARTITIONS x MAX_CELLS numbers whatever the input's size: that bounds what the driver draws and what is broadcast. More
input partitions than that share a row of the matrix; cells grow with the rows until there are MAX_CELLS. Partitions and cells of more than
CELL_ROWS rows are ordered in sub-groups of about that size, so that no task orders more, however many rows there are.

Defined results: a null text has size 1 and the checksum of the empty text; null and repeated ids and repeated rows are
rows like any other; an empty table gives no rows; extra columns are ignored. Equal texts are dealt out uniformly, each
like any other row, so a large group of copies is spread over all shards.
"""

from __future__ import annotations

import math
from decimal import Decimal, localcontext

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verilume.llm.common import materialize

MAX_PARTITIONS, MAX_CELLS, CELL_ROWS = 1024, 1024, 1_000_000
#: numpy draws hypergeometric numbers below this population; `_draw` takes over beyond it.
NUMPY_POPULATION = 10**9
PI = Decimal("3.14159265358979323846264338327950288419716939937510")


def _log_factorial(n: int) -> Decimal:
    """log n! to some 35 digits: the sum of logs for small n, Stirling's series beyond."""
    if n < 256:
        return Decimal(math.factorial(n)).ln()
    x = Decimal(n)
    series = 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7) + 1 / (1188 * x**9) - Decimal(691) / (360360 * x**11)
    return x * x.ln() - x + (2 * PI * x).ln() / 2 + series


def _draw(good: int, bad: int, sample: int, rng: np.random.Generator) -> int:
    """One hypergeometric number for any population, by inversion from the mode outwards in expected O(sd) steps. The mode's probability comes
    from logs with 40 digits, so populations of any size lose nothing; if rounding leaves no value for a number, another is drawn."""
    lo, hi = max(0, sample - bad), min(good, sample)
    if lo == hi:
        return lo
    mode = min(hi, max(lo, (sample + 1) * (good + 1) // (good + bad + 2)))
    with localcontext() as context:
        context.prec = 40
        log_choose = lambda n, k: _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k)
        p = float((log_choose(good, mode) + log_choose(bad, sample - mode) - log_choose(good + bad, sample)).exp())
    while True:
        u = rng.random() - p
        if u < 0:
            return mode
        up, down, p_up, p_down = mode, mode, p, p
        while (up < hi and p_up > 0) or (down > lo and p_down > 0):
            if up < hi:
                p_up *= (good - up) * (sample - up) / ((up + 1) * (bad - sample + up + 1))
                up += 1
                u -= p_up
                if u < 0:
                    return up
            if down > lo:
                p_down *= down * (bad - sample + down) / ((good - down + 1) * (sample - down + 1))
                down -= 1
                u -= p_down
                if u < 0:
                    return down


def matrix(partition_rows: list[int], cell_rows: list[int], seed: int) -> np.ndarray:
    """Rows: partitions, columns: cells; the margins are the arguments."""
    rng, left = np.random.default_rng(seed), np.array(cell_rows, np.int64)
    out = np.zeros((len(partition_rows), len(cell_rows)), np.int64)
    for i, n in enumerate(partition_rows):
        total = int(left.sum())
        if total < NUMPY_POPULATION:
            out[i] = rng.multivariate_hypergeometric(left, n, method="marginals") if total else 0
        else:
            for j, c in enumerate(left.tolist()):
                out[i, j] = _draw(c, total - c, n, rng) if total > c else n
                n, total = n - int(out[i, j]), total - c
        left -= out[i]
    return out


def split_evenly(total: int, parts: int) -> list[int]:
    """Sizes that sum to `total` and are at most one apart."""
    return [total // parts + (i < total % parts) for i in range(parts)]


def _placed(rows: DataFrame, group: list[str], seed: int, largest: int, name: str) -> DataFrame:
    """`rows` with their place from 1 in a random order (of a keyed hash) of their group. Groups above CELL_ROWS rows are split by the hash's
    first bits into sub-groups that are ordered apart; their counts give each sub-group's first place."""
    key = F.xxhash64(F.lit(seed), "doc_id", "text_crc32", "size")
    order = (key, "doc_id", "text_crc32", "size")
    bits = max(0, math.ceil(math.log2(largest / CELL_ROWS))) if largest > 0 else 0
    if not bits:
        return rows.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    cut = rows.withColumn("_sub", F.shiftrightunsigned(key, 64 - bits))
    before = Window.partitionBy(*group).orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut.groupBy(*group, "_sub").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    own = F.row_number().over(Window.partitionBy(*group, "_sub").orderBy(*order))
    return cut.withColumn("_own", own).join(counts.drop("_n"), [*group, "_sub"]).withColumn(name, F.col("_before") + F.col("_own")).drop("_sub", "_own", "_before")


def shard(docs: DataFrame, shards: int = 16, seed: int = 20240601) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for each row of `docs`; shard sizes are at most one row apart."""
    spark = docs.sparkSession
    text = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    digest = docs.select(F.col("doc_id").cast("long"), (F.length(text) + 1).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"))
    digest = materialize(digest.withColumn("part", F.spark_partition_id() % MAX_PARTITIONS), "rows")
    parts = [(r["part"], r["n"]) for r in digest.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect()]
    total = sum(n for _, n in parts)
    sizes = split_evenly(total, shards)
    per_shard = max(1, min(MAX_CELLS // shards, math.ceil(total / shards / CELL_ROWS)))
    cells = [split_evenly(n, per_shard) for n in sizes]
    drawn = matrix([n for _, n in parts], [n for c in cells for n in c], seed).reshape(len(parts), shards, per_shard)

    rows = []
    for (part, _), counts in zip(parts, drawn, strict=True):
        by_shard = np.cumsum(counts.sum(axis=1))
        by_cell = (by_shard - counts.sum(axis=1))[:, None] + np.cumsum(counts, axis=1)
        rows.append((part, by_shard.tolist(), by_cell.tolist()))
    plan = spark.createDataFrame(rows, "part int, upto array<long>, cell_upto array<array<long>>")

    ranked = _placed(digest, ["part"], seed + 1, max((n for _, n in parts), default=0), "rank").join(F.broadcast(plan), "part")
    ranked = ranked.withColumn("shard", F.size(F.filter("upto", lambda x: x < F.col("rank"))))
    ranked = ranked.withColumn("cell", F.size(F.filter(F.element_at("cell_upto", F.col("shard") + 1), lambda x: x < F.col("rank"))))
    extra = [n % per_shard for n in sizes]
    start = F.col("cell") * F.element_at(F.array(*[F.lit(n // per_shard).cast("long") for n in sizes]), F.col("shard") + 1)
    start = start + F.least(F.col("cell"), F.element_at(F.array(*[F.lit(n) for n in extra]), F.col("shard") + 1))
    placed = _placed(ranked.drop("rank"), ["shard", "cell"], seed + 2, math.ceil(max(sizes) / per_shard), "place")
    return placed.select("doc_id", "size", "text_crc32", "shard", (start + F.col("place") - 1).cast("long").alias("slot"))
