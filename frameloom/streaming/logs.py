"""Structured log records, their levels and the sinks that take them; for batches and streams alike."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.sources.scratch import scratch_path

ORDER = ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL")
#: Sink to the lowest level it takes.
SINKS = {"console": "INFO", "text": "DEBUG", "json": "DEBUG", "errors": "ERROR"}
#: Bytes that a sink's files may take together: files of 100 MB with 10 older ones, 100 MB with 5, 50 MB with 10.
LIMITS = {"text": 11 * 100 * 1024**2, "json": 6 * 100 * 1024**2, "errors": 11 * 50 * 1024**2}


def level_of(kind: Column) -> Column:
    return F.when(kind == "error", "ERROR").when(kind == "purchase", "WARNING").when(kind == "view", "DEBUG").otherwise("INFO")


def record(ts: Column, level: Column, logger: Column, message: Column, exception: Column) -> Column:
    """Null fields are left out when it is written as JSON."""
    return F.struct(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), level.alias("level"), logger.alias("logger"), message.alias("message"), exception.alias("exception"))


def takes(sink: str, level: Column) -> Column:
    return level.isin(*ORDER[ORDER.index(SINKS[sink]) :])


def fan_out(records: DataFrame) -> DataFrame:
    """One row for each record and sink that takes its level."""
    return records.withColumn("sink", F.explode(F.filter(F.array(*[F.when(takes(s, F.col("level")), F.lit(s)) for s in SINKS]), lambda s: s.isNotNull())))


def as_text(records: DataFrame) -> DataFrame:
    """One line a record: time, level, logger and message, and the exception behind it."""
    known = [c if c in records.columns else F.lit(None).cast("string").alias(c) for c in ("timestamp", "level", "logger", "message", "exception")]
    return records.select(*known).select(F.concat_ws(" | ", "timestamp", F.rpad("level", 8, " "), "logger", "message", "exception").alias("value"))


#: Records of a sink's file; those of a batch beyond them go to a further one.
FILE_RECORDS = 500_000


def expired(batches: list[tuple[str, int]], limit: int) -> list[str]:
    """Of batches (folder, bytes), newest first: those beyond the first ``limit`` bytes; the newest is kept."""
    total, out = 0, []
    for i, (path, size) in enumerate(batches):
        total += size
        if i and total > limit:
            out.append(path)
    return out


def rotate(spark: SparkSession, folder: str, limit: int) -> None:
    """Delete a sink's oldest batches so that ``limit`` bytes stay; a sink has few."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return
    found = {int(f.getPath().getName().partition("=")[2]): f.getPath() for f in fs.listStatus(path) if f.isDirectory() and f.getPath().getName().startswith("batch=")}
    newest = [(str(n), fs.getContentSummary(found[n]).getLength()) for n in sorted(found, reverse=True)]
    for name in expired(newest, limit):
        fs.delete(found[int(name)], True)


def write_batch(batch: DataFrame, number: int, folder: str, limits: dict[str, int] = LIMITS) -> None:
    """Give a micro-batch to every sink that takes its records: JSON lines, or text.

    A sink has one folder a batch, whose files are named by their task; Spark commits them together. A batch that is
    repeated after a failure replaces its own folder, so each record is there once, and one that rotation took stays away.
    """
    batch.persist()
    spark = batch.sparkSession
    for sink in SINKS:
        taken = batch.where(takes(sink, F.col("level")))
        lines = taken.select(F.to_json(F.struct("*")).alias("value")) if sink == "json" else as_text(taken)
        lines.write.mode("overwrite").option("maxRecordsPerFile", FILE_RECORDS).text(f"{folder}/{sink}/batch={number}")
        if sink in limits:
            rotate(spark, f"{folder}/{sink}", limits[sink])
    batch.unpersist()


def write_sinks(records: DataFrame, folder: str, checkpoint: str, limits: dict[str, int] = LIMITS):
    """Start one streaming query that gives each micro-batch to every sink, once whatever fails, and keeps each sink within its limit."""

    def each(batch: DataFrame, number: int) -> None:
        write_batch(batch, number, folder, limits)

    return records.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def written_sinks(spark: SparkSession, events: DataFrame) -> DataFrame:
    """sink, lines of a stream of records that went through ``write_sinks``."""
    folder = scratch_path(spark, "logs")
    events.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{folder}/in")
    write_sinks(stream, f"{folder}/out", f"{folder}/state").awaitTermination()
    counts = [spark.read.schema("value string, batch long").text(f"{folder}/out/{s}").agg(F.count("*").alias("lines")).select(F.lit(s).alias("sink"), "lines") for s in SINKS]
    return reduce(DataFrame.unionByName, counts)
