"""Answer assembly: what a completer returns becomes rows again, and falls back to the hits when it returns nothing useful."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANSWER = "struct<references:array<map<string,string>>,summary:string>"


def json_part(answer: Column | str) -> Column:
    """From the first brace to the last, without code fences."""
    answer = F.col(answer) if isinstance(answer, str) else answer
    bare = F.regexp_replace(answer, r"```(?:json)?", "")
    return F.nullif(F.regexp_extract(bare, r"(?s)(\{.*\})", 1), F.lit(""))


def trailing_index(value: Column | str) -> Column:
    """2 of "2" and of "snippet_2"; null without digits at the end."""
    return F.regexp_extract(value, r"(\d+)$", 1).try_cast("int")


def first_of(entry: Column, *keys: str) -> Column:
    return F.coalesce(*[F.try_element_at(entry, F.lit(k)) for k in keys])


def unit(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def references(answers: DataFrame, hits: DataFrame, key: str, fallback: int = 3) -> DataFrame:
    """(query_id, key, relevance, explanation): the hits (query_id, key, similarity, rank) that the answer (query_id, answer) names by
    0-based index; the first hits where it names none."""
    entries = answers.select("query_id", F.explode_outer(F.from_json(json_part("answer"), ANSWER)["references"]).alias("e"))
    named = entries.select(F.col("query_id").alias("_q"), trailing_index(first_of(F.col("e"), "index", "snippet_id", "id")).alias("_i"), first_of(F.col("e"), "explanation", "reason", "description").alias("explanation"), first_of(F.col("e"), "relevance_score", "relevance", "score").try_cast("double").alias("_r"))
    found = hits.join(named, (F.col("query_id") == F.col("_q")) & (F.col("rank") == F.col("_i") + 1)).select("query_id", key, unit(F.coalesce("_r", "similarity")).alias("relevance"), "explanation")
    rest = hits.filter(F.col("rank") <= fallback).join(found.select(F.col("query_id").alias("_q")).distinct(), F.col("query_id") == F.col("_q"), "left_anti").select("query_id", key, unit(F.col("similarity")).alias("relevance"), F.lit(None).cast("string").alias("explanation"))
    return found.unionByName(rest)


def alignment_files(hits: DataFrame, files: DataFrame, k: int = 5, chars: int = 5000) -> DataFrame:
    """The first k distinct files of each query's hits (query_id, relative_path, rank), cut to `chars` characters."""
    from verilume.operators.retrieval import top

    best = top(hits.groupBy("query_id", "relative_path").agg(F.min("rank").alias("first")), k, F.asc("first"), F.asc("relative_path"))
    return best.join(files, "relative_path").select("query_id", "relative_path", "rank", F.left("content", F.lit(chars)).alias("content"))


def without_header(document: Column | str) -> Column:
    """A stored document without its leading "Paper:", "Page:" and "Section:" lines."""
    return F.regexp_replace(document, r"\A(?:(?:Paper|Page|Section|File|Symbol):[^\n]*\n+)+", "")


#: Claim types and alignment statuses that answers may name.
CLAIM_TYPES = "data_split model_architecture training_procedure evaluation_metrics data_preprocessing hyperparameter implementation_detail other".split()
STATUSES = {"aligned": "aligned", "misaligned": "misaligned", "partial": "misaligned"}


def parsed_claims(answers: DataFrame) -> DataFrame:
    """(query_id, seq, text, claim_type, keywords, expected_value) of answers that hold a JSON list of claims, in fences or not; unknown
    types are other, values become text, entries without a text go."""
    bare = F.regexp_replace("answer", r"```(?:json)?", "")
    entries = F.from_json(F.regexp_extract(bare, r"(?s)(\[.*\])", 1), "array<struct<text:string,claim_type:string,keywords:array<string>,expected_value:string>>")
    at = answers.select("query_id", F.posexplode(entries).alias("seq", "c")).filter(F.coalesce(F.trim("c.text"), F.lit("")) != "")
    kind = F.lower(F.trim("c.claim_type"))
    return at.select("query_id", "seq", "c.text", F.when(kind.isin(*CLAIM_TYPES), kind).otherwise("other").alias("claim_type"), F.coalesce("c.keywords", F.array().cast("array<string>")).alias("keywords"), "c.expected_value")


def parsed_verdicts(answers: DataFrame) -> DataFrame:
    """(query_id, status, tier, confidence, explanation) of answers about one claim: partial agreement is a contradiction, anything unknown
    is unverified, a missing tier is 4."""
    v = F.from_json(json_part("answer"), "struct<status:string,tier:string,confidence:string,explanation:string>")
    known = F.create_map(*[F.lit(x) for kv in STATUSES.items() for x in kv])
    status = F.coalesce(F.try_element_at(known, F.lower(F.trim(v["status"]))), F.lit("unverified"))
    tier = F.coalesce(trailing_index(v["tier"]), F.lit(4))
    return answers.select("query_id", status.alias("status"), F.greatest(F.lit(1), F.least(F.lit(4), tier)).alias("tier"), unit(F.coalesce(v["confidence"].try_cast("double"), F.lit(0.5))).alias("confidence"), v["explanation"].alias("explanation"))
