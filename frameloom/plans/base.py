"""Registration of queries with their SQL, and the stand-in tables they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register the function under its name; ``sql`` must give the same rows."""

    def register(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Extensions dealt to documents by id, to stand in for file names.
EXTENSIONS = (".mp4", ".AVI", ".mkv", ".mov", ".txt", "")
FILES_SQL = """files AS (SELECT doc_id, lang, source, n_chars,
  concat('/', lang, '/', source, '/', CASE WHEN doc_id % 11 = 0 THEN '.' ELSE '' END, doc_id, list_extract(['.mp4', '.AVI', '.mkv', '.mov', '.txt', ''], CAST(doc_id % 6 + 1 AS INTEGER))) AS path FROM documents)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as a file listing: doc_id, lang, source, n_chars, path."""
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("doc_id") % 6 + 1).cast("int"))
    hidden = F.when(F.col("doc_id") % 11 == 0, ".").otherwise("")
    path = F.concat(F.lit("/"), "lang", F.lit("/"), "source", F.lit("/"), hidden, F.col("doc_id").cast("string"), ext)
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", path.alias("path"))
