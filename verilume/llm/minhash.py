"""Near-duplicate detection by one-permutation MinHash.

A document's set holds its distinct k-word shingles. One hash function splits the hash range into bins and keeps
each bin's minimum; empty bins borrow from non-empty ones by optimal densification (a fixed sequence of
pseudo-random bins per empty bin). Bands of bins are the bucket keys. Documents with equal sets form one class
first, so exact copies never meet in a bucket. Within a bucket only star-shaped edges are emitted, from one
pivot to every other member, and each edge is confirmed on the full sets.

A star can miss a link between two members that are both too far from its pivot. After two rounds of stars (the
member with the smallest id, then a pseudo-random member per bucket) the buckets that still hold several components are settled
exactly: a shingle that no other component has cannot count towards a link, so a class whose remaining shingles
are too few to reach the threshold has no open link and goes; pairs are then formed among the few that are left, where
the remaining shingles of both sides suffice. That last step deals the members of a bucket into blocks, and every two blocks
meet in a place of their own: a hot bucket is many small tasks.

Defined results: null, empty and blank texts have an empty set and link with nothing; null ids take part in links but
never name a component unless every id in it is null (then the component's id is null and kept is false); repeated
rows keep one output row each; extra columns are ignored by `near_duplicates` and returned by `deduplicate`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from verilume.llm import textnum
from verilume.llm.common import drop, map_texts, materialize

BINS, ROWS, BANDS = 128, 5, 25
#: Ids to look up in a scan go by broadcast up to this many rows (8 bytes each), beyond it by a shuffle.
LOOKUP_ROWS = 500_000
#: Members of a bucket that are compared with each other in one place.
BLOCK = 128
#: Links whose components are found on the driver (some 40 bytes each there, and as much for a node); more are labelled by joins.
DRIVER_EDGES = 200_000


def _sets(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    buf, offs = textnum.text_bytes(batch.column("text"))
    buf = textnum.lowered(buf)
    start, end, row = textnum.words(buf, offs)
    values, rows = textnum.shingles(textnum.span_hashes(buf, start, end), row, batch.num_rows, k)
    return textnum.distinct_by_row(values, rows, batch.num_rows)


def densify(mins: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """Empty bins take the value of the first non-empty bin in their own fixed pseudo-random sequence of bins."""
    mins, bins = mins.copy(), mins.shape[1]
    doc, at = np.nonzero(~filled & filled.any(axis=1, keepdims=True))
    attempt = 0
    while len(doc):
        attempt += 1
        to = (textnum.mix((at + attempt * bins).astype(np.uint64)) % np.uint64(bins)).astype(np.int64)
        ok = filled[doc, to]
        mins[doc[ok], at[ok]] = mins[doc[ok], to[ok]]
        doc, at = doc[~ok], at[~ok]
    return mins


def band_hashes(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of BANDS bucket keys for each set."""
    n = len(offs) - 1
    row = np.repeat(np.arange(n), np.diff(offs))
    cell = row * BINS + (values >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.ones(len(cell), bool)
    first[1:] = cell[1:] != cell[:-1]
    mins, filled = np.zeros(n * BINS, np.uint64), np.zeros(n * BINS, bool)
    mins[cell[first]], filled[cell[first]] = values[first], True
    mins = densify(mins.reshape(n, BINS), filled.reshape(n, BINS))[:, : BANDS * ROWS].reshape(n, BANDS, ROWS)
    out = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D), (n, BANDS)).copy()
    for i in range(ROWS):
        out = textnum.mix(out ^ mins[:, :, i]) + np.uint64(i)
    return out


def _set_keys(values: np.ndarray, offs: np.ndarray) -> list[bytes | None]:
    """16 bytes that name a set; None for the empty set."""
    full = np.flatnonzero(np.diff(offs) > 0)
    out: list[bytes | None] = [None] * (len(offs) - 1)
    if len(full):
        pair = np.stack([np.add.reduceat(textnum.mix(values ^ np.uint64(c)), offs[full]) for c in (0x1D8E4E27C47D124F, 0xEB44ACCAB455D165)], axis=1)
        raw = textnum.mix(pair).tobytes()
        for i, k in enumerate(full):
            out[k] = raw[16 * i : 16 * i + 16]
    return out


def signatures(docs: DataFrame, k: int = 5) -> DataFrame:
    """doc_id, n_shingles, key (of the set, null if empty), bands."""

    def sign(batch: pa.RecordBatch):
        values, offs = _sets(batch, k)
        bands = band_hashes(values, offs).view(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (batch.num_rows + 1) * BANDS, BANDS, dtype=np.int32)), pa.array(bands.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(np.diff(offs)), pa.array(_set_keys(values, offs), pa.binary()), lists], ["doc_id", "n_shingles", "key", "bands"])

    return map_texts(docs.select("doc_id", "text"), sign, "doc_id long, n_shingles long, key binary, bands array<long>")


def shingle_sets(docs: DataFrame, k: int = 5) -> DataFrame:
    """key and the sorted set itself, for rows whose set isn't empty."""

    def build(batch: pa.RecordBatch):
        values, offs = _sets(batch, k)
        lists = pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(values.view(np.int64)))
        out = pa.RecordBatch.from_arrays([pa.array(_set_keys(values, offs), pa.binary()), lists], ["key", "shingles"])
        yield out.filter(pa.compute.is_valid(out.column(0)))

    return map_texts(docs.select("text"), build, "key binary, shingles array<long>")


def _least(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the smallest of its component under the edges (a, b)."""
    label = np.arange(n)
    while len(open_ := np.flatnonzero(label[a] != label[b])):
        a, b = label[a[open_]], label[b[open_]]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while ((jumped := label[label]) != label).any():
            label = jumped
    return label


def _few_components(edges: DataFrame) -> DataFrame:
    """`components` of edges that the driver holds."""
    found, n = edges.select("a", "b").toArrow().combine_chunks(), edges.schema["a"].dataType
    nodes = pa.compute.unique(pa.chunked_array([*found["a"].chunks, *found["b"].chunks], found.schema.field("a").type))
    nodes = nodes.take(pa.compute.sort_indices(nodes))
    a, b = (pa.compute.index_in(found[c], nodes).to_numpy() for c in "ab")
    out = pa.table({"node": nodes, "label": nodes.take(pa.array(_least(a, b, len(nodes))))})
    return materialize(edges.sparkSession.createDataFrame(out, StructType().add("node", n).add("label", n)), "labels")


def components(edges: DataFrame, few: int = DRIVER_EDGES) -> DataFrame:
    """node, label (its component's smallest node) for the undirected edges (a, b). Up to `few` of them go to the driver: by joins each round
    is nine stages of as many tasks as a shuffle has partitions, however little they read. Beyond: minima of neighbours and pointer jumping."""
    if edges.count() <= few:
        return _few_components(edges)
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        stepped = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jumped = stepped.join(labels.select(F.col("node").alias("label"), F.col("label").alias("far")), "label")
        out = materialize(jumped.select("node", "old", F.least("label", "far").alias("label")), "labels")
        drop(labels)
        labels = out
        if out.filter("old != label").isEmpty():
            drop(both)
            return labels


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union; one pair at a time is in memory."""
    sides = [sets.select(F.col("key").alias(c), F.col("shingles").alias(f"set_{c}")) for c in "ab"]
    joined = pairs.select("a", "b").join(sides[0], "a").join(sides[1], "b")
    both = joined.select("a", "b", (F.size("set_a") + F.size("set_b")).alias("n"), F.size(F.array_intersect("set_a", "set_b")).alias("both"))
    return both.filter(f"100 * both >= {percent} * (n - both)").select("a", "b")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def in_blocks(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two sides of `members` (bucket, key, others) that meet on (bucket, i, j): members are dealt into blocks of about
    BLOCK by their key, and each pair of blocks i <= j meets at a place of its own, so that no bucket is one task's work."""
    blocks = members.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = members.join(blocks, "bucket").withColumn("own", F.pmod(F.xxhash64("key", F.lit(1)), F.col("blocks")).cast("int"))
    first = dealt.withColumn("i", F.col("own")).withColumn("j", F.explode(F.sequence("own", F.col("blocks") - 1)))
    second = dealt.withColumn("j", F.col("own")).withColumn("i", F.explode(F.sequence(F.lit(0), "own")))
    return first.drop("own", "blocks"), second.drop("own", "blocks")


def _open_members(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """`rest` (bucket, key, n, label) without the classes whose shingles that another component has, too, are too few for a link;
    with their number in the column able."""
    members = rest.select("key", "label").distinct()
    parts = members.join(sets, "key").select("key", "label", F.explode("shingles").alias("s"))
    across = parts.groupBy("s").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo != hi").select("s")
    able = parts.join(across, "s", "left_semi").groupBy("key").agg(F.count("*").alias("able"))
    return rest.drop("able").join(able, "key").filter(f"100 * able >= {percent} * n")


def links(docs: DataFrame, signed: DataFrame, percent: int = 85, k: int = 5) -> DataFrame:
    """key, label of every class of `signed` that has a link."""
    classes = signed.filter("key is not null").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    member = materialize(classes.select("key", "doc_id", "n", F.explode("bands").alias("bucket")), "members")
    oldest = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key", "n")  # of a family the source has the smallest id, as a rule
    pivots = member.groupBy("bucket").agg(F.count("*").alias("c"), F.min(oldest).alias("p")).filter("c > 1")
    shared = materialize(member.join(pivots, "bucket").select("bucket", "key", "n", "doc_id", F.col("p.key").alias("pivot"), F.col("p.n").alias("pivot_n")), "buckets")
    drop(member)

    wanted = shared.select("key", "doc_id").distinct()
    ids = wanted.select("doc_id").distinct()
    ids = F.broadcast(ids) if wanted.count() <= LOOKUP_ROWS else ids
    rows = docs.select("doc_id", "text").join(ids.withColumnRenamed("doc_id", "want"), F.col("doc_id").eqNullSafe(F.col("want")), "left_semi")
    found = shingle_sets(rows, k).join(wanted.select("key").distinct(), "key", "left_semi")
    sets = materialize(found.groupBy("key").agg(F.first("shingles").alias("shingles")), "sets")

    fits = F.expr(f"100 * least(n, pivot_n) >= {percent} * greatest(n, pivot_n)")
    first = materialize(_ordered(shared.filter("key != pivot").filter(fits).select(F.col("pivot").alias("a"), F.col("key").alias("b"))), "star")
    edges = materialize(_confirmed(first, sets, percent), "linked")
    labels = components(edges)

    def mixed(labels: DataFrame) -> DataFrame:
        """The members of buckets that hold more than one component."""
        at = shared.select("bucket", "key", "n").join(labels.select(F.col("node").alias("key"), "label"), "key", "left").withColumn("label", F.coalesce("label", "key"))
        many = at.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min_by(F.struct("key", "n", "label"), F.xxhash64("key", "bucket")).alias("p")).filter("lo != hi")
        return at.join(many.select("bucket", "p"), "bucket")

    again = mixed(labels).filter("label != p.label").select("key", "n", F.col("p.key").alias("pivot"), F.col("p.n").alias("pivot_n")).filter(fits)
    second = materialize(_ordered(again.select(F.col("pivot").alias("a"), F.col("key").alias("b"))).join(first, ["a", "b"], "left_anti"), "star")
    more = materialize(_confirmed(second, sets, percent), "linked")
    if not more.isEmpty():
        drop(labels)
        labels = components(edges.union(more))

    rest = materialize(mixed(labels).select("bucket", "key", "n", "label"), "mixed")
    for _ in range(2):
        fewer = materialize(_open_members(rest, sets, percent), "open")
        drop(rest)
        rest = fewer
    left, right = in_blocks(rest.join(rest.groupBy("key").agg(F.collect_set("bucket").alias("at")), "key"))  # at most BANDS buckets each
    other = right.select("bucket", "i", "j", F.col("key").alias("pivot"), F.col("n").alias("pivot_n"), F.col("label").alias("pivot_label"), F.col("able").alias("pivot_able"), F.col("at").alias("pivot_at"))
    enough = F.expr(f"{100 + percent} * least(able, pivot_able) >= {percent} * (n + pivot_n)")
    once = F.expr("bucket = array_min(array_intersect(at, pivot_at))")
    met = left.join(other, ["bucket", "i", "j"]).filter(F.expr("label != pivot_label and (i < j or key < pivot)") & fits & enough & once)
    pairs = _ordered(met.select(F.col("pivot").alias("a"), F.col("key").alias("b")))
    pairs = materialize(pairs.join(first.union(second), ["a", "b"], "left_anti"), "rest")
    last = materialize(_confirmed(pairs, sets, percent), "linked")
    if not last.isEmpty():
        drop(labels)
        labels = components(edges.union(more).union(last))
    drop(shared, sets, first, second, edges, more, rest, pairs, last)
    return labels.select(F.col("node").alias("key"), "label")


def near_duplicates(docs: DataFrame, percent: int = 85, k: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, key, label: one row for each row of `docs`."""
    signed = materialize(signatures(docs, k), "signatures")
    return _named(signed, links(docs, signed, percent, k)).select("doc_id", "n_shingles", "component_id", "kept")


def _named(signed: DataFrame, labels: DataFrame) -> DataFrame:
    classes = signed.filter("key is not null").groupBy("key").agg(F.min("doc_id").alias("least"))
    named = classes.join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    heads = named.groupBy("label").agg(F.min("least").alias("component_id"))
    where = named.join(heads, "label").select("key", "label", "component_id")
    out = signed.select("doc_id", "n_shingles", "key").join(where, "key", "left")
    own = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.withColumn("component_id", own).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def deduplicate(docs: DataFrame, percent: int = 85, k: int = 5) -> DataFrame:
    """The rows of `docs` without all but one of each group: the row with the smallest id stays (a null id only if the group
    has no other; of repeated rows one). Rows without words stay, also repeated ones. All columns are returned."""
    signed = materialize(signatures(docs, k), "signatures")
    place = _named(signed, links(docs, signed, percent, k)).filter("key is not null")
    best = place.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("b")).select(F.col("b.doc_id").alias("id"), F.col("b.key").alias("set"))
    keep = materialize(best, "keep")
    if signed.groupBy("doc_id").count().filter("count > 1").isEmpty():
        ids = keep.select("id").union(signed.filter("key is null").select("doc_id"))
        return docs.join(ids, docs["doc_id"].eqNullSafe(ids["id"]), "left_semi")
    mark = next(c for c in (f"_set{i}" for i in range(len(docs.columns) + 1)) if c not in docs.columns)
    keyed = _with_keys(docs, mark, k)
    kept = keyed.join(keep, keyed["doc_id"].eqNullSafe(keep["id"]) & (keyed[mark] == keep["set"]), "left_semi")
    return kept.dropDuplicates(["doc_id", mark]).unionByName(keyed.filter(F.col(mark).isNull())).drop(mark)


def _with_keys(docs: DataFrame, name: str, k: int) -> DataFrame:
    """`docs` with the key of each row's set in the column `name`."""

    def run(batch: pa.RecordBatch):
        values, offs = _sets(batch, k)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_set_keys(values, offs), pa.binary())], [*batch.schema.names, name])

    return map_texts(docs, run, docs.select("*").schema.add(name, "binary"))
