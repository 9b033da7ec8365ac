"""Documents of many items, saved and read back by tasks: projects, segments, statistics, ignored pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from frameloom.plans.base import query, table
from frameloom.sources import stores
from frameloom.sources.scratch import scratch_path

#: Items of one document at most, where a key may have any number of them.
PAGE = 100


def page(number):
    """The document of a numbered item: its key and a page of ``PAGE`` numbers, so that a document stays small however many items a key has."""
    return F.concat_ws("/", F.col("l_orderkey").cast("string"), F.floor(F.col(number) / PAGE).cast("string"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 35 = 0 THEN 'broken' WHEN p_partkey % 5 = 0 THEN 'backup' ELSE 'current' END AS origin,
CASE WHEN p_partkey % 35 = 0 THEN concat('/new/', p_partkey) ELSE concat('/', p_brand) END AS video_path,
CAST(CASE WHEN p_partkey % 35 = 0 THEN 0 WHEN p_partkey % 5 = 0 THEN p_size % 5 ELSE p_size % 5 + 1 END AS BIGINT) AS segments FROM part""")
def project_store(spark, d):
    """A project an item, saved twice; what the second save left broken is read from the first, and what both did gets the defaults."""
    k, root = F.col("p_partkey"), scratch_path(spark, "projects")
    parts = table(spark, d, "part")

    def saved(segments, torn):
        cut = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.struct(i.cast("double").alias("start"), (i + 1.0).alias("end")))
        said = F.to_json(F.struct(F.concat(F.lit("/"), "p_brand").alias("video_path"), F.slice(cut, 1, segments.cast("int")).alias("segments")))
        stores.save_texts(parts.select(k.alias("key"), F.when(torn, '{"video_path": ').otherwise(said).alias("text")), root)

    saved(F.col("p_size") % 5, k % 35 == 0)
    saved(F.col("p_size") % 5 + 1, k % 5 == 0)
    read = stores.load(spark, root, "struct<video_path: string, segments: array<struct<start: double, `end`: double>>>")
    path = F.coalesce("value.video_path", F.concat(F.lit("/new/"), "key"))
    return read.select(F.col("key").cast("long").alias("p_partkey"), "origin", path.alias("video_path"), F.coalesce(F.size("value.segments"), F.lit(0)).cast("long").alias("segments"))


@query("""SELECT concat(l_orderkey, '/', l_linenumber // 100) AS document, CAST(l_linenumber * 10 AS BIGINT) AS start_frame,
CASE WHEN l_returnflag <> 'N' THEN CAST(l_linenumber * 10 + 5 AS BIGINT) END AS end_frame, CASE WHEN l_returnflag <> 'N' THEN 5 ELSE 0 END AS frames FROM lineitem""")
def frame_segments_store(spark, d):
    """The segments of all items, in documents; an open one has no end, and no length."""
    n, root = F.col("l_linenumber").cast("long"), scratch_path(spark, "segments")
    cut = F.struct((n * 10).alias("start_frame"), F.when(F.col("l_returnflag") != "N", n * 10 + 5).alias("end_frame"))
    documents = table(spark, d, "lineitem").groupBy(page("l_linenumber").alias("document")).agg(F.array_sort(F.collect_list(cut)).alias("segments"))
    stores.save(documents, root, "document")
    read = stores.load(spark, root, "struct<segments: array<struct<start_frame: long, end_frame: long>>>")
    length = F.when(F.col("end_frame").isNotNull(), F.col("end_frame") - F.col("start_frame")).otherwise(0)
    return read.select(F.col("key").alias("document"), F.inline("value.segments")).withColumn("frames", length.cast("int"))


@query("""WITH l AS (SELECT *, concat(l_orderkey, '/', l_linenumber // 100) AS document FROM lineitem), bad AS (SELECT DISTINCT document FROM l WHERE l_orderkey % 3 = 0 AND l_linenumber = 3)
SELECT document, count(*) AS conversions, CAST(sum(l_partkey * 1000 - l_suppkey) AS BIGINT) AS saved, CAST(max(l_linenumber) AS INTEGER) AS attempts FROM l WHERE document NOT IN (SELECT document FROM bad) GROUP BY document""")
def conversion_stats_store(spark, d):
    """Statistics in documents that are read whole or not at all: one with an entry of another type gives none of its entries."""
    n, root = F.col("l_linenumber"), scratch_path(spark, "stats")
    size = F.when((F.col("l_orderkey") % 3 == 0) & (n == 3), "many").otherwise((F.col("l_partkey").cast("long") * 1000).cast("string"))
    entry = F.struct(size.alias("input_size"), F.col("l_suppkey").alias("output_size"), n.alias("attempt_count"))
    documents = table(spark, d, "lineitem").groupBy(page("l_linenumber").alias("document")).agg(F.collect_list(entry).alias("stats"))
    stores.save(documents, root, "document", column="stats")
    read = stores.load(spark, root, "array<struct<input_size: string, output_size: string, attempt_count: string>>")
    typed = stores.all_typed(F.col("value"), {"input_size": "long", "output_size": "long", "attempt_count": "int"})
    rows = read.select(F.col("key").alias("document"), F.inline(typed))
    saved = F.sum(F.col("input_size") - F.col("output_size")).alias("saved")
    return rows.groupBy("document").agg(F.count("*").alias("conversions"), saved, F.max("attempt_count").alias("attempts"))


@query("""SELECT DISTINCT least(CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR)) AS a, greatest(CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR)) AS b FROM lineitem WHERE l_partkey <> l_suppkey""")
def ignored_pairs_store(spark, d):
    """Ignored pairs in documents of about ``PAGE`` entries, noted in either order and with entries that aren't pairs; each pair is read once."""
    root = scratch_path(spark, "ignored")
    x, y = F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")
    noted = F.explode(F.array(F.when(F.col("l_linenumber") % 2 == 0, F.array(x, y)).otherwise(F.array(y, x)), F.array(x))).alias("p")
    entries = table(spark, d, "lineitem").select(noted).distinct()
    dealt = F.pmod(F.xxhash64("p"), F.lit(entries.count() // PAGE + 1))
    stores.save(entries.groupBy(dealt.alias("part")).agg(F.collect_list("p").alias("pairs")), root, "part", column="pairs")
    pair = stores.load(spark, root, "array<array<string>>").select(F.explode("value").alias("p")).where("size(p) = 2 and p[0] <> p[1]")
    return pair.select(F.array_min("p").alias("a"), F.array_max("p").alias("b")).distinct()
