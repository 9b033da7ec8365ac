"""Shared pieces of the corpus operators: scratch tables, table reading, ASCII lower case."""

from __future__ import annotations

import ctypes
import string
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.sources.scratch import scratch_path, shared_dir, written

__all__ = ["lower_ascii", "materialize", "scratch_path", "settled", "shared_dir", "slices", "small_batches", "small_side", "table"]

#: Bytes that may be broadcast, as ``small_side`` measures them.
BROADCAST_BYTES = 48 * 1024 * 1024
#: Most rows and bytes of a batch for a Python worker.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1024", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@contextmanager
def small_batches(spark: SparkSession):
    """Within, what goes to Python workers goes in batches of ``BATCH``, which bounds the buffers on both sides."""
    before = {k: spark.conf.get(k) for k in BATCH}
    try:
        for k, v in BATCH.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: one computation, no lineage."""
    with small_batches(df.sparkSession):
        return written(df, label)


def lower_ascii(col: Column) -> Column:
    """A-Z to a-z; every other character, accented capitals too, stays. Text of ASCII alone takes the faster function."""
    return F.when(F.octet_length(col) == F.length(col), F.lower(col)).otherwise(F.translate(col, string.ascii_uppercase, string.ascii_lowercase))


def settled(rows: DataFrame, kept: list[str], **computed: Column) -> DataFrame:
    """``kept`` and the computed columns, which pass through a generator of one row: the optimizer doesn't take them into lambdas or below filters."""
    return rows.select(*kept, F.inline_outer(F.array(F.struct(*[c.alias(k) for k, c in computed.items()]))))


def measured(df: DataFrame) -> int:
    """Bytes that the rows of ``df`` take in a hash table, about: 32 a row, 16 a column or field, and what strings and binaries hold."""
    loose = [c for c, kind in df.dtypes if kind in ("string", "binary")]
    nested = [kind for _, kind in df.dtypes if "<" in kind]
    if any(word in kind for kind in nested for word in ("array", "map", "string", "binary")):
        raise TypeError("only flat rows are measured")
    rows, *texts = df.agg(F.count("*"), *[F.sum(F.octet_length(F.col(f"`{c}`"))) for c in loose]).first()
    fields = len(df.columns) + sum(kind.count(":") for kind in nested)
    return rows * (32 + 16 * fields) + sum(t or 0 for t in texts)


def small_side(df: DataFrame) -> DataFrame:
    """Broadcast a table, read again cheaply, if its measured bytes are within the bound; else Spark joins it by a shuffle."""
    return F.broadcast(df) if measured(df) <= BROADCAST_BYTES else df.hint("shuffle_merge")


def give_back() -> None:
    """Return freed memory to the system: Python workers live on between tasks and stages, and would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def slices(batches, rows: int = 512):
    """Arrow batches in parts of at most ``rows`` rows, so that what Python holds at a time is bounded; what is freed is given back."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        give_back()
