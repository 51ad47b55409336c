"""State: history, caches, trees and progress, as tables.

Upserts and evictions are aggregations by key; rankings are partitioned by the owner of the entries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest(entries: DataFrame, owner: str, k: int = 20, at: str = "ts", tie: str = "event_id") -> DataFrame:
    """The k latest entries of each owner, newest first."""
    order = Window.partitionBy(owner).orderBy(F.desc(at), F.desc(tie))
    return entries.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def upsert(history: DataFrame, new: DataFrame, key: str, k: int = 20) -> DataFrame:
    """History (key, ts, ...) with new entries: a known key keeps its place and takes the new values; the k latest stay."""
    first = history.select(key, F.col("ts").alias("_ts"))
    changed = new.join(first, key, "left").withColumn("ts", F.coalesce("_ts", "ts")).drop("_ts")
    every = history.join(new.select(key), key, "left_anti").unionByName(changed)
    return every.orderBy(F.desc("ts"), key).limit(k)


def without(history: DataFrame, key: str, value: object) -> DataFrame:
    return history.filter(~F.col(key).eqNullSafe(F.lit(value)))


def live(cache: DataFrame, now: Column, seconds: int = 300, entries: int = 500, owner: str = "cache", at: str = "ts", tie: str = "event_id") -> DataFrame:
    """Entries that are younger than `seconds`; of these the newest `entries` of each cache."""
    young = cache.filter(F.col(at) > now - F.expr(f"INTERVAL {seconds} SECONDS"))
    return latest(young, owner, entries, at, tie)


def cache_key(text: Column | str) -> Column:
    """MD5 of the first 500 characters in small letters with single spaces."""
    text = F.col(text) if isinstance(text, str) else text
    return F.md5(F.left(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")), F.lit(500)))


def cached_answer(queries: DataFrame, cache: DataFrame, min_chars: int = 20) -> DataFrame:
    """(query_id, seq): the entry of each query: by key, else the first that contains it or that it contains, if both have
    `min_chars`. Both ways find their candidates by a word that they must share."""
    from verilume.operators.retrieval import contained

    exact = queries.withColumn("_k", cache_key("query")).join(cache.withColumn("_k", cache_key("text")), "_k").groupBy("query_id").agg(F.min("seq").alias("seq"))
    rest = queries.join(exact, "query_id", "left_anti").filter(F.length("query") >= min_chars).select("query_id", F.lower("query").alias("q"))
    entries = cache.filter(F.length("text") >= min_chars).select("seq", F.lower("text").alias("t"))
    inside = contained(rest.withColumnRenamed("q", "_p"), entries.withColumnRenamed("t", "_t"), "seq").select("query_id", "seq")
    longest = F.broadcast(rest.agg(F.max(F.length("q")).alias("_most")))
    short = entries.join(longest, F.length("t") <= F.col("_most")).select("seq", F.col("t").alias("_p"))
    around = contained(short, rest.withColumnRenamed("q", "_t"), "query_id").select("query_id", "seq")
    return exact.unionByName(inside.unionByName(around).groupBy("query_id").agg(F.min("seq").alias("seq")))


def tree(paths: DataFrame, path: str = "path") -> DataFrame:
    """(parent, name, is_dir, files): every directory entry; directories first when sorted by is_dir descending and name."""
    parts = paths.select(F.filter(F.split(path, "/"), lambda p: p != "").alias("_p")).filter(F.size("_p") > 0)
    at = parts.select("_p", F.explode(F.sequence(F.lit(1), F.size("_p"))).alias("_d"))
    entry = at.select(F.array_join(F.slice("_p", F.lit(1), F.col("_d") - 1), "/").alias("parent"), F.element_at("_p", F.col("_d")).alias("name"), (F.col("_d") < F.size("_p")).alias("is_dir"))
    return entry.groupBy("parent", "name", "is_dir").agg(F.count("*").alias("files"))


def sorted_tree(entries: DataFrame) -> DataFrame:
    """Entries of `tree` with their place in their directory: directories first, then by name in any case."""
    order = Window.partitionBy("parent").orderBy(F.desc("is_dir"), F.lower("name"), "name")
    return entries.withColumn("place", F.row_number().over(order))


def recent_queries(queries: DataFrame, owner: str, k: int = 20, chars: int = 200, text: str = "text", at: str = "ts", tie: str = "event_id") -> DataFrame:
    """The k latest queries of each owner, cut to `chars` characters."""
    return latest(queries, owner, k, at, tie).withColumn(text, F.left(text, F.lit(chars)))


def to_prepare(chunks: DataFrame, text: str = "document") -> DataFrame:
    """Stored chunks whose answers are worth preparing: all but those that begin with the name of a section that says nothing of code."""
    from verilume.operators.rules import UNPREPARED

    name = F.regexp_extract(text, r"(?m)^Section:\s*(.+?)(?:\s*\(.*\))?\s*$", 1)
    bare = F.trim(F.regexp_replace(F.trim(F.lower(name)), r"^\d+\.?\s*", ""))
    return chunks.filter(~bare.isin(*UNPREPARED))


def percent(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.floor(done * 100 / total)).otherwise(0).cast("int")
