"""Plug-ins for models, with deterministic built-ins. The built-ins stand in for models; they aren't equivalent to them."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verilume.functions.text import lexical_tokens

DIM = 64


class Embedder(Protocol):
    def __call__(self, text: Column) -> Column: ...


class Completer(Protocol):
    def __call__(self, prompts: list[str]) -> list[str | None]: ...


def hashed_embedding(text: Column, dim: int = DIM) -> Column:
    """Signed feature hashing of lexical tokens, of length 1 (all zeros without tokens)."""
    once = lambda x, then: F.get(F.transform(F.array(x), then), F.lit(0))  # noqa: E731  (a lambda's argument is computed once)
    at = lambda h: F.pmod(h, F.lit(dim))
    sign = lambda h: F.when(F.pmod(F.shiftright(h, 32), F.lit(2)) == 0, 1.0).otherwise(-1.0)

    def counted(codes: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.aggregate(codes, F.lit(0.0), lambda s, h: s + F.when(at(h) == i, sign(h)).otherwise(0.0)))

    def unit(raw: Column) -> Column:
        norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda s, x: s + x * x))
        return once(norm, lambda n: F.transform(raw, lambda x: (x / F.when(n == 0, 1.0).otherwise(n)).cast("float")))

    return once(once(F.transform(lexical_tokens(text), lambda t: F.xxhash64(t)), counted), unit)


def embedded(texts: DataFrame, embedder: Embedder = hashed_embedding, text: str = "text") -> DataFrame:
    """`texts` with embedding; every distinct text is embedded once."""
    once = texts.select(text).distinct().withColumn("embedding", embedder(F.col(text)))
    return texts.join(once, text, "left")


def completed(prompts: DataFrame, completer: Completer | None = None) -> DataFrame:
    """`prompts` (query_id, prompt) with answer, in Arrow batches; without a completer every answer is null."""
    if completer is None:
        return prompts.withColumn("answer", F.lit(None).cast("string"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(answer=completer(frame["prompt"].tolist()))

    return prompts.mapInPandas(run, prompts.withColumn("answer", F.lit("")).schema)
