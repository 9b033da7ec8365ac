"""File listings, and the JSON documents in which a catalogue keeps its state.

A document is one JSON value in one file, small by nature (settings, a project, a list
of ignored pairs); large state belongs in ``save_cache``, which writes Parquet. Readers
go by Spark's own file readers, so any store that Spark reaches will do. A missing or
broken document gives its default, unless a function says otherwise.
"""

from __future__ import annotations

import os
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.functions import scalars as X
from frameloom.sources.scratch import written

HASHES = "map<string, map<string, struct<hash: array<array<array<boolean>>>, duration: double, last_modified: double, frame_indices: array<int>>>>"
PAIRS = "array<array<string>>"
STATS = "input_size long, output_size long, duration double, attempt_count int, params_used map<string, string>, success boolean, date string"
PATTERNS = "array<struct<pattern: string, replace_with: string, enabled: boolean>>"
SEGMENTS = "struct<segments: array<struct<start_frame: int, end_frame: int, name: string, color: string>>>"
ANALYSED = "struct<analyzed_files: map<string, array<array<array<boolean>>>>, ignored_pairs: array<array<string>>>"
COPY = "struct<source_path: string, dest_path: string>"
PROJECT = (
    "struct<video_path: string, last_modified: string, segments: array<struct<start: double, `end`: double, name: string, created_at: string>>, "
    "scenes: array<struct<start_frame: int, end_frame: int, created_at: string>>, markers: array<struct<time: double, name: string, color: string, created_at: string>>, "
    "history: array<struct<action: string, details: string, timestamp: string>>, metadata: map<string, string>>"
)


def list_files(spark: SparkSession, folder: str, extensions: tuple[str, ...] = X.VIDEO_EXTENSIONS, ignore_case: bool = True, hidden: bool = True) -> DataFrame:
    """path, relative, size, modified of all files below ``folder`` with one of the extensions; contents are not read.

    Folders are listed level by level, each level by all executors' tasks through the folder's own file system; Spark's listing would
    leave out names that start with a dot or underscore. Those that start with a dot, and all below such folders, are ``hidden``.
    """
    root = folder.rstrip("/") if "://" in folder or folder.startswith("file:") else f"file://{os.path.abspath(folder)}"
    base = fs.FileSystem.from_uri(root)[1].rstrip("/")
    prefix = root[: len(root) - len(base)] if root.endswith(base) else "file://"

    def level(batches):
        for batch in batches:
            for place in batch.column(0).to_pylist():
                system, path = fs.FileSystem.from_uri(place)
                found = system.get_file_info(fs.FileSelector(path, recursive=False))
                if found:
                    rows = [(prefix + f.path, f.path, f.type == fs.FileType.Directory, f.size, f.mtime) for f in found]
                    kinds = [pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.timestamp("us", "UTC")]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["uri", "path", "folder", "size", "modified"])

    at, out = spark.createDataFrame([(root,)], "uri string"), None
    while True:
        found = written(at.mapInArrow(level, "uri string, path string, folder boolean, size long, modified timestamp"), "listing")
        if not hidden:
            found = found.where(~X.basename(F.col("path")).startswith("."))
        files = found.where(~F.col("folder"))
        out = files if out is None else out.unionByName(files)
        at = found.where("folder").select("uri")
        if at.isEmpty():
            break
        at = at.repartition(max(1, min(at.count(), 4 * spark.sparkContext.defaultParallelism)))
    path = F.col("path")
    ending = F.lower(X.extension(path)) if ignore_case else X.extension(path)
    return out.where(ending.isin(*extensions)).select(F.col("uri").alias("path"), F.substr(path, F.lit(len(base) + 2)).alias("relative"), "size", "modified")


def _text(spark: SparkSession, path: str) -> DataFrame:
    """One row: the file's text, null if it is missing."""
    try:
        return spark.read.text(path, wholetext=True).agg(F.first("value").alias("value"))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([(None,)], "value string")


def document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row with column ``value``; null if the file is missing or isn't ``schema``."""
    return _text(spark, path).select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("value"))


def document_or_backup(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """As ``document``, else what ``path``.bak holds; null if both are missing.

    A file that is there but broken, with no backup that can be read, is an error.
    """
    both = _text(spark, path).select(F.col("value").alias("text")).crossJoin(_text(spark, f"{path}.bak").select(F.col("value").alias("old")))  # one row each
    sound = [F.when(F.try_parse_json(c).isNotNull(), F.from_json(c, schema)) for c in ("text", "old")]  # a struct of nulls isn't a broken text
    read = both.select("text", F.coalesce(*sound).alias("value"), "old")
    broken = F.col("value").isNull() & F.coalesce("text", "old").isNotNull()
    return read.select(F.when(broken, F.raise_error(F.lit(f"{path} and its backup can't be read"))).otherwise(F.col("value")).alias("value"))


def hash_cache(spark: SparkSession, path: str) -> DataFrame:
    """method, path, frame_pos, bits (64 of 0 and 1), frame_index, duration, last_modified of a cache document."""
    items = document(spark, path, HASHES).select(F.explode("value").alias("method", "items")).select("method", F.explode("items").alias("path", "c"))
    frames = items.select("method", "path", "c", F.posexplode("c.hash").alias("frame_pos", "block"))
    bits = F.transform(F.flatten("block"), lambda b: b.cast("int"))
    return frames.select("method", "path", "frame_pos", bits.alias("bits"), F.get("c.frame_indices", "frame_pos").alias("frame_index"), "c.duration", "c.last_modified")


def ignored_pairs(spark: SparkSession, path: str) -> DataFrame:
    """a, b with a < b, each pair once; entries that aren't two different names are left out."""
    pair = document(spark, path, PAIRS).select(F.explode("value").alias("p")).where("size(p) = 2 and p[0] <> p[1]")
    return pair.select(F.array_min("p").alias("a"), F.array_max("p").alias("b")).distinct()


def stats(spark: SparkSession, path: str) -> DataFrame:
    """Conversion statistics, all or none: a row of another shape fails the read."""
    return spark.read.schema(STATS).option("multiLine", "true").option("mode", "FAILFAST").json(path)


def patterns(spark: SparkSession, path: str) -> DataFrame:
    """place, pattern, replace_with of the enabled rename patterns, in their order."""
    rows = document(spark, path, PATTERNS).select(F.posexplode("value").alias("place", "p"))
    return rows.where("p.enabled").select("place", "p.pattern", "p.replace_with")


def frame_segments(spark: SparkSession, path: str) -> DataFrame:
    """start_frame, end_frame (null while open), name, color; none for a missing or broken document."""
    return document(spark, path, SEGMENTS).select(F.inline("value.segments"))


def project(spark: SparkSession, path: str, video_path: str) -> DataFrame:
    """One row: the project document with its fields' defaults; of ``video_path`` and empty, if it can't be read."""
    v = document(spark, path, PROJECT).select("value.*")
    lists = {c: F.coalesce(c, F.array().cast(v.schema[c].dataType)) for c in ("segments", "scenes", "markers", "history")}
    return v.select(F.coalesce("video_path", F.lit(video_path)).alias("video_path"), "last_modified", *[e.alias(c) for c, e in lists.items()], F.coalesce("metadata", F.create_map().cast("map<string,string>")).alias("metadata"))


def project_or_new(spark: SparkSession, path: str, video_path: str) -> DataFrame:
    """As ``project``; a missing or broken document is first saved with the defaults."""
    if _text(spark, path).where(F.try_parse_json("value").isNotNull()).isEmpty():
        save_document(project(spark, path, video_path), path, backup=False)
    return project(spark, path, video_path)


def analysed_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(path, frame_pos, bits) of the analysed files and (a, b) of the ignored pairs, as they were stored; both empty without a document.

    ``path`` is a document, or a folder of them as ``save_documents`` writes it: one a line, each with some of the files and pairs.
    """
    try:
        doc = spark.read.text(path).select(F.from_json("value", ANALYSED).alias("value"))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        doc = spark.createDataFrame([], f"value {ANALYSED}")
    frames = doc.select(F.explode("value.analyzed_files").alias("path", "hash")).select("path", F.posexplode("hash").alias("frame_pos", "block"))
    pairs = doc.select(F.explode("value.ignored_pairs").alias("p")).select(F.get("p", F.lit(0)).alias("a"), F.get("p", F.lit(1)).alias("b")).distinct()
    return frames.select("path", "frame_pos", F.transform(F.flatten("block"), lambda b: b.cast("int")).alias("bits")), pairs


def save_documents(rows: DataFrame, folder: str) -> None:
    """Write every row as a document, one a line, by the tasks that hold the rows; nothing goes through the driver."""
    rows.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(folder)


def copy_settings(spark: SparkSession, path: str) -> DataFrame:
    """One row: source_path, dest_path; null what the document lacks."""
    return document(spark, path, COPY).select("value.source_path", "value.dest_path")


def settings_documents(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Documents of ``save_documents``, a row each; fields that one lacks are null, and so are all of a broken one."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(folder)


def with_defaults(rows: DataFrame, defaults: dict) -> DataFrame:
    """Every field that is null or missing gets its default."""
    return rows.withColumns({c: F.coalesce(c, F.lit(x)) if c in rows.columns else F.lit(x) for c, x in defaults.items()})


def save_document(rows: DataFrame, path: str, backup: bool = True, column: str | None = None) -> None:
    """Write the only row of ``rows``, or its ``column`` alone, as a JSON document; see ``save_text``."""
    text = rows.select(F.to_json(F.struct("*") if column is None else F.col(column))).limit(2).collect()
    if len(text) != 1:
        raise ValueError("a document is one row")
    save_text(rows.sparkSession, text[0][0], path, backup)


def save_text(spark: SparkSession, text: str, path: str, backup: bool = True) -> None:
    """Write a document so that a reader sees the old or the new one whole.

    The text goes to a file beside ``path``, the old document is copied to ``path``.bak, then the new one takes its name.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs, temp = target.getFileSystem(conf), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    try:
        out = fs.create(temp, True)
        out.write(bytearray(text.encode()))
        out.close()
        if backup and fs.exists(target):
            jvm.org.apache.hadoop.fs.FileUtil.copy(fs, target, fs, jvm.org.apache.hadoop.fs.Path(f"{path}.bak"), False, True, conf)
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        how = spark.sparkContext._gateway.new_array(kind, 1)
        how[0] = kind.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(temp), fs.makeQualified(target), how)
    finally:
        fs.delete(temp, False)


def save_cache(rows: DataFrame, path: str) -> None:
    """Replace a cache by ``rows``, once a batch; ``rows`` must not be read from ``path`` itself."""
    rows.write.mode("overwrite").parquet(path)


def clear_cache(spark: SparkSession, path: str) -> None:
    """Leave an empty cache of the same columns."""
    save_cache(spark.createDataFrame([], spark.read.parquet(path).schema), path)
