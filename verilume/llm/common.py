"""Shared helpers: table access and intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from verilume.llm import textnum

#: Bytes of text that one Python step handles at a time; a longer text is handled alone.
BATCH_BYTES = 4 << 20

_own: dict[str, str] = {}
_kept: dict[str, object] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; only where it is unset (tests), a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found or _own.setdefault("dir", tempfile.mkdtemp(prefix="verilume-"))


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write `df` as a table in the shared folder and read it back: lineage ends there and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete what `materialize` wrote for these frames; nothing may read them after. Spark deletes the shuffle files of ended queries when the
    driver's JVM collects their plans, which a mostly idle driver may not do for long; so it is asked to."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if tables:
        tables[0].sparkSession._jvm.System.gc()


def kept(owner: str, make: Callable[[], object]):
    """What this worker keeps from task to task for the operator `owner`; `make()` at first. Only the last operator's is kept."""
    if owner not in _kept:
        _kept.clear()
        _kept[owner] = make()
    return _kept[owner]


def begin(owner: str) -> None:
    """A task of `owner` begins in this worker: what it kept for other operators goes."""
    if _kept and owner not in _kept:
        _kept.clear()
        trim()


def trim() -> None:
    """Give freed memory, which Arrow and the C library hold for later, back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def step(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], owner: str = "") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run` for mapInArrow. Workers live on from stage to stage, so it begins without what other operators than `owner` kept, and ends with
    free memory given back."""

    def stepped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin(owner)
        try:
            yield from run(batches)
        finally:
            trim()

    return stepped


def map_texts(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: StructType | str, text: str = "text", limit: int = BATCH_BYTES, owner: str = "") -> DataFrame:
    """mapInArrow over sub-batches of at most `limit` bytes of the column `text`. owner: the operator, if it keeps anything in workers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                _, offs = textnum.text_bytes(batch.column(text))
                for i, j in textnum.slices(offs, limit):
                    yield from fn(batch.slice(i, j - i))

    return df.mapInArrow(step(run, owner), schema)


def text_digest(text: Column | str) -> Column:
    """128 bits that name a text exactly enough to join on; null and empty differ."""
    return F.md5(F.coalesce(F.concat(F.lit("t"), text), F.lit("n")))
