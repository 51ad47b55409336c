"""Sources and sinks: directories of code and papers, raw texts, and replaceable tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verilume.functions.text import LANGUAGES, is_code_file, language, line_count

PAPER_EXTENSIONS = ("pdf", "txt", "md", "tex")
MAX_BYTES = 50 * 1024 * 1024


def code_files(spark: SparkSession, root: str, codebase_id: str = "") -> DataFrame:
    """(codebase_id, path, relative_path, content, language, line_count) of the code files under `root`. The file filter runs on paths
    before any content is read; bytes that aren't UTF-8 are dropped."""
    globs = "*{" + ",".join(LANGUAGES) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", globs).load(root)
    base = root.rstrip("/").split("://")[-1]
    files = files.withColumn("relative_path", F.substring_index("path", base + "/", -1)).filter(is_code_file("relative_path"))
    content = F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("�"), F.lit(""))
    at = files.select(F.lit(codebase_id).alias("codebase_id"), "path", "relative_path", content.alias("content"))
    return at.withColumn("language", language("relative_path")).withColumn("line_count", line_count("content"))


def paper_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, name, source_type, content, bytes) of papers up to MAX_BYTES; the size is checked without reading contents. PDF contents stay
    bytes for a parser plug-in; texts are UTF-8, or Latin-1 if that fails."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    kind = F.lower(F.substring_index("path", ".", -1))
    at = files.filter(kind.isin(*PAPER_EXTENSIONS) & (F.col("length") <= MAX_BYTES)).withColumn("source_type", F.when(kind == "pdf", "pdf").otherwise("text"))
    text = F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.decode(F.col("content"), "iso-8859-1"))
    return at.select("path", F.substring_index("path", "/", -1).alias("name"), "source_type", F.when(F.col("source_type") != "pdf", text).alias("content"), F.when(F.col("source_type") == "pdf", F.col("content")).alias("bytes"))


def texts(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    """Submitted texts (name, content)."""
    return spark.createDataFrame(rows, "name string, content string").withColumn("source_type", F.lit("text"))


def is_github_url(url):
    """Whether a codebase address names a repository on github.com."""
    return (F.parse_url(url, F.lit("HOST")) == "github.com") & F.parse_url(url, F.lit("PATH")).rlike(r"^/[\w.-]+/[\w.-]+/?$")


def replace_table(df: DataFrame, path: str, *partitions: str) -> None:
    """Replace a table as a whole."""
    df.write.mode("overwrite").partitionBy(*partitions).parquet(path)


def append_table(df: DataFrame, path: str, *partitions: str) -> None:
    df.write.mode("append").partitionBy(*partitions).parquet(path)


def json_store(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A store of JSON documents, one for each line."""
    return spark.read.schema(schema).json(path)
