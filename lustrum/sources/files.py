"""Tables of files: any store that Spark reads, whole files with their paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_files(spark: SparkSession, path: str, pattern: str | None = None, recursive: bool = True) -> DataFrame:
    """path, content (binary) of the files under ``path`` that match ``pattern``."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).where(~F.col("path").contains("/node_modules/")).select("path", "content")


def read_texts(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """path, text of the same files, decoded as UTF-8; malformed bytes become U+FFFD."""
    return read_files(spark, path, pattern).select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def write_texts(texts: DataFrame, path: str) -> None:
    """Cleaned texts to a new location, as a table of (path, text)."""
    texts.select("path", "text").write.parquet(path)
