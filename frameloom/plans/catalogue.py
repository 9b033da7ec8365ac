"""Scans, work lists, merge and copy plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from frameloom.functions import scalars as X
from frameloom.operators import catalog as K
from frameloom.plans.base import FILES_SQL, files, query, table

EXT_SQL = r"regexp_extract(string_split(path, '/')[-1], '^\.*[^.].*(\.[^.]*)$', 1)"
VIDEO_SQL = "('.mp4', '.avi', '.mkv', '.mov')"


def videos(spark, d):
    return files(spark, d).where(F.lower(X.extension(F.col("path"))).isin(*X.VIDEO_EXTENSIONS))


@query(f"WITH {FILES_SQL} SELECT path FROM files WHERE lower({EXT_SQL}) IN {VIDEO_SQL}")
def scan_filter_extension(spark, d):
    return videos(spark, d).select("path")


@query(f"WITH {FILES_SQL} SELECT path FROM files WHERE lower({EXT_SQL}) IN {VIDEO_SQL} ORDER BY path")
def scan_sorted_by_path(spark, d):
    return videos(spark, d).select("path").orderBy("path")


@query(f"WITH {FILES_SQL} SELECT path, CAST(list_position(['.mp4', '.avi', '.mkv', '.mov'], {EXT_SQL}) AS INTEGER) AS priority FROM files WHERE {EXT_SQL} IN {VIDEO_SQL} ORDER BY priority, path")
def scan_extension_priority(spark, d):
    ext = X.extension(F.col("path"))
    place = F.array_position(F.array(*map(F.lit, X.VIDEO_EXTENSIONS)), ext).cast("int")
    return files(spark, d).where(ext.isin(*X.VIDEO_EXTENSIONS)).select("path", place.alias("priority")).orderBy("priority", "path")


@query(f"WITH {FILES_SQL} SELECT path FROM files WHERE len(list_filter(string_split(path, '/'), lambda x: starts_with(x, '.'))) = 0")
def scan_hidden_filter(spark, d):
    return files(spark, d).where(~F.exists(F.split("path", "/"), lambda x: x.startswith("."))).select("path")


@query("SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text")
def add_files_dedup(spark, d):
    return K.first_of_each(table(spark, d, "documents").select("doc_id", "text"), "text", "doc_id").select("text", "doc_id")


@query("SELECT doc_id FROM documents SEMI JOIN labels USING (doc_id)")
def semi_join_existing(spark, d):
    return K.cached(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")


@query("SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def anti_join_unhashed(spark, d):
    return K.uncached(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")


@query("SELECT doc_id, CASE WHEN quality IS NULL THEN 'waiting' ELSE 'analysed' END AS status FROM documents LEFT JOIN labels USING (doc_id)")
def status_case(spark, d):
    marked = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return marked.select("doc_id", F.when(F.col("quality").isNull(), "waiting").otherwise("analysed").alias("status"))


@query("SELECT doc_id, n_chars AS modified FROM documents JOIN labels USING (doc_id) WHERE n_chars > 1000 + doc_id")
def stale_cache_rows(spark, d):
    cache = table(spark, d, "labels").select("doc_id", (F.col("doc_id") + 1000).alias("last_modified"))
    return table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("modified")).join(cache, "doc_id").where("modified > last_modified").select("doc_id", "modified")


@query("SELECT 1 AS part, c_custkey AS k, c_name AS name FROM customer UNION ALL SELECT 2, s_suppkey, s_name FROM supplier ORDER BY part, k")
def ordered_concat(spark, d):
    c = table(spark, d, "customer").select(F.lit(1).alias("part"), F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    s = table(spark, d, "supplier").select(F.lit(2).alias("part"), F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    return c.unionByName(s).orderBy("part", "k")


@query("SELECT c_mktsegment, c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) <> 3")
def remove_by_ordinal(spark, d):
    rows = table(spark, d, "customer").select("c_mktsegment", "c_custkey")
    return K.numbered(rows, ["c_mktsegment"], "c_custkey").where("n <> 3").select("c_mktsegment", "c_custkey")


@query("SELECT c_mktsegment, c_custkey, CAST(CASE n WHEN 2 THEN 3 WHEN 3 THEN 2 ELSE n END AS INTEGER) AS n FROM (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS n FROM customer)")
def swap_ordinals(spark, d):
    rows = K.numbered(table(spark, d, "customer").select("c_mktsegment", "c_custkey"), ["c_mktsegment"], "c_custkey")
    return rows.withColumn("n", F.when(F.col("n") == 2, 3).when(F.col("n") == 3, 2).otherwise(F.col("n")))


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 'eye' WHEN 'click' THEN 'hand' WHEN 'purchase' THEN 'cart' ELSE 'default' END AS icon FROM events")
def map_lookup_default(spark, d):
    icons = F.create_map(*[F.lit(x) for x in ("view", "eye", "click", "hand", "purchase", "cart")])
    return table(spark, d, "events").select("event_id", F.coalesce(F.try_element_at(icons, F.col("event_type")), F.lit("default")).alias("icon"))


@query("SELECT concat('v', vec_id) AS path, CAST(p AS INTEGER) AS frame_pos, array_to_string(list_transform(embedding[p * 8 + 1 : p * 8 + 8], lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '') AS bits FROM embeddings, (SELECT unnest(range(0, 8)) AS p)")
def hash_cache_explode(spark, d):
    """A cache document per item, {path: {hash: [[bit]], duration}}, as one row a frame of eight bits."""
    e = table(spark, d, "embeddings")
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda p: F.transform(F.slice("embedding", p * 8 + 1, 8), lambda x: x > 0))
    made = e.select(F.to_json(F.create_map(F.concat(F.lit("v"), F.col("vec_id").cast("string")), F.struct(rows.alias("hash"), F.lit(1.5).alias("duration")))).alias("cache"))
    read = made.select(F.explode(F.from_json("cache", "map<string, struct<hash: array<array<boolean>>, duration: double>>")).alias("path", "c"))
    frames = read.select("path", F.posexplode("c.hash").alias("frame_pos", "bits"))
    return frames.select("path", "frame_pos", F.array_join(F.transform("bits", lambda b: b.cast("int").cast("string")), "").alias("bits"))


PROBE_SQL = """probe AS (SELECT p_partkey, p_name, p_brand, CASE WHEN p_partkey % 31 = 0 THEN '{"streams": []}' WHEN p_partkey % 37 = 0 THEN 'failed' ELSE
  concat('{"streams": [{"codec_name": "', p_type, '"', CASE WHEN p_partkey % 3 = 0 THEN '' ELSE concat(', "width": ', length(p_name) * 16) END, ', "height": ', length(p_brand) * 9, ', "r_frame_rate": "25/1"}, {"codec_name": "other"}]}') END AS said FROM part),
  stream AS (SELECT *, CASE WHEN json_valid(said) THEN json_extract(said, '$.streams[0]') END AS s FROM probe)"""


def streams(spark, d):
    """Parts as probed files: what a probe would print, and codec, width, height and rate of the first stream."""
    n = F.col("p_partkey")
    width = F.when(n % 3 == 0, "").otherwise(F.concat(F.lit(', "width": '), (F.length("p_name") * 16).cast("string")))
    good = F.concat(F.lit('{"streams": [{"codec_name": "'), "p_type", F.lit('"'), width, F.lit(', "height": '), (F.length("p_brand") * 9).cast("string"), F.lit(', "r_frame_rate": "25/1"}, {"codec_name": "other"}]}'))
    said = F.when(n % 31 == 0, '{"streams": []}').when(n % 37 == 0, "failed").otherwise(good)
    return table(spark, d, "part").select("p_partkey", "p_name", "p_brand", K.first_stream(said).alias("s")).select("p_partkey", "p_name", "p_brand", "s.*", F.col("s").isNotNull().alias("probed"))


@query(f"""WITH {PROBE_SQL} SELECT p_partkey, json_extract_string(s, '$.codec_name') AS codec_name, CAST(json_extract_string(s, '$.width') AS INTEGER) AS width, CAST(json_extract_string(s, '$.height') AS INTEGER) AS height,
  json_extract_string(s, '$.r_frame_rate') AS r_frame_rate, s IS NOT NULL AS probed FROM stream""")
def stream_info_probe(spark, d):
    return streams(spark, d).drop("p_name", "p_brand")


@query(f"""WITH {PROBE_SQL}, f AS (SELECT p_name, p_brand, s, row_number() OVER w AS i, first_value(s) OVER w AS base, list(s) OVER (PARTITION BY p_name, p_brand) AS l FROM stream WINDOW w AS (PARTITION BY p_name, p_brand ORDER BY p_partkey))
SELECT p_name, p_brand, count(*) AS n, count(*) >= 2 AND bool_and(s IS NOT NULL AND coalesce(CAST(s AS VARCHAR) = CAST(base AS VARCHAR), false)) AS compatible FROM f GROUP BY ALL""")
def compat_all_equal(spark, d):
    """Files of a group are joined without encoding if every probe succeeded and codec, width, height and rate are all those of the first."""
    return K.all_like_first(streams(spark, d), ["p_name", "p_brand"], "codec_name", "width", "height", "r_frame_rate", probed="probed")


@query("""WITH f AS (SELECT p_name, p_partkey, p_retailprice, first_value(p_retailprice) OVER (PARTITION BY p_name ORDER BY p_partkey) AS r FROM part)
SELECT p_name, count(*) AS n, bool_and(abs(p_retailprice - r) <= 100.05) AS compatible FROM f GROUP BY p_name""")
def compat_fps_tolerance(spark, d):
    """All rates within a tolerance of the first one's."""
    p = table(spark, d, "part")
    first = p.groupBy("p_name").agg(F.min_by("p_retailprice", "p_partkey").alias("r"))
    return p.join(first, "p_name").groupBy("p_name").agg(F.count("*").alias("n"), F.bool_and(F.abs(F.col("p_retailprice") - F.col("r")) <= 100.05).alias("compatible"))


@query("""WITH g AS (SELECT left(p_name, 2) AS k, min(p_name) AS a, max(p_name) AS b FROM part GROUP BY 1)
SELECT k, left(a, CAST(list_max(list_filter(range(0, least(length(a), length(b)) + 1), lambda i: left(a, CAST(i AS INTEGER)) = left(b, CAST(i AS INTEGER)))) AS INTEGER)) AS prefix FROM g""")
def common_prefix_agg(spark, d):
    g = table(spark, d, "part").groupBy(F.substring("p_name", 1, 2).alias("k")).agg(F.min("p_name").alias("a"), F.max("p_name").alias("b"))
    return g.select("k", K.common_prefix(F.col("a"), F.col("b")).alias("prefix"))


@query("SELECT user_id, round(sum(CASE WHEN event_id % 5 = 0 THEN 0 ELSE value END), 6) AS duration FROM events GROUP BY user_id")
def total_duration(spark, d):
    said = F.when(F.col("event_id") % 5 == 0, "n/a").otherwise(F.col("value").cast("string"))
    return table(spark, d, "events").groupBy("user_id").agg(F.round(F.sum(F.coalesce(said.try_cast("double"), F.lit(0.0))), 6).alias("duration"))


@query("""WITH t AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'n/a' ELSE concat(' ', value, ' ') END AS said FROM events) SELECT event_id, coalesce(TRY_CAST(trim(said) AS DOUBLE), 0) AS duration FROM t""")
def try_parse_duration(spark, d):
    said = F.when(F.col("event_id") % 5 == 0, "n/a").otherwise(F.concat(F.lit(" "), F.col("value").cast("string"), F.lit(" ")))
    return table(spark, d, "events").select("event_id", F.coalesce(F.trim(said).try_cast("double"), F.lit(0.0)).alias("duration"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE o_totalprice / (o_orderkey % 4) END AS duration FROM orders")
def duration_safe_divide(spark, d):
    fps = F.col("o_orderkey") % 4
    return table(spark, d, "orders").select("o_orderkey", F.when(fps > 0, F.try_divide(F.col("o_totalprice"), fps)).otherwise(F.lit(0.0)).alias("duration"))


@query(rf"""WITH {FILES_SQL}, p AS (SELECT path, string_split(path, '/')[-1] AS name, {EXT_SQL} AS ext FROM files)
SELECT path, concat(left(name, length(name) - length(ext)), '_conv', ext) AS converted, concat(left(name, length(name) - length(ext)), '_temp_2', ext) AS temporary, concat(left(name, length(name) - length(ext)), '_merged', ext) AS merged FROM p""")
def derived_output_name(spark, d):
    p = F.col("path")
    return files(spark, d).select("path", *[F.concat(X.stem(p), F.lit(s), X.extension(p)).alias(n) for n, s in (("converted", "_conv"), ("temporary", "_temp_2"), ("merged", "_merged"))])


@query("SELECT user_id, bool_and(value > 5) AS all_large, bool_or(event_type = 'error') AS any_error, CAST(count(*) FILTER (WHERE event_type = 'view') AS BIGINT) AS views FROM events GROUP BY user_id")
def bool_aggregates(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.bool_and(F.col("value") > 5).alias("all_large"), F.bool_or(F.col("event_type") == "error").alias("any_error"), F.count_if(F.col("event_type") == "view").alias("views"))


TAKEN_SQL = f"""{FILES_SQL}, w AS (SELECT doc_id, path, concat('/dst/', source) AS target, {EXT_SQL} AS ext FROM files),
r AS (SELECT *, row_number() OVER (PARTITION BY target, ext ORDER BY doc_id) AS r FROM w),
held AS (SELECT DISTINCT target, ext, CAST(doc_id // 6 % 4 AS BIGINT) AS k FROM w WHERE doc_id % 5 = 0),
free AS (SELECT target, ext, k, row_number() OVER (PARTITION BY target, ext ORDER BY k) AS r FROM (SELECT target, ext, unnest(range(0, count(*) + 4)) AS k FROM w GROUP BY target, ext) ANTI JOIN held USING (target, ext, k))"""


@query(f"WITH {TAKEN_SQL} SELECT doc_id, concat(target, CASE WHEN k = 0 THEN '' ELSE concat(' (', k, ')') END, ext) AS name FROM r JOIN free USING (target, ext, r)")
def unique_name_on_conflict(spark, d):
    """Where every folder's files get its name: plain or with the smallest number free, given some numbers taken before."""
    p = F.col("path")
    wanted = files(spark, d).select("doc_id", F.concat(F.lit("/dst/"), "source").alias("target"), X.extension(p).alias("ext"))
    k = F.expr("doc_id div 6") % 4
    existing = wanted.where("doc_id % 5 = 0").select(K.with_number(F.col("target"), F.lit(""), k).alias("target"), "ext").distinct()
    return K.unique_names(wanted, "doc_id", existing).select("doc_id", "name")


@query(f"""WITH {FILES_SQL}, f AS (SELECT doc_id, path, n_chars, {EXT_SQL} AS ext FROM files WHERE len(list_filter(string_split(path, '/'), lambda x: starts_with(x, '.'))) = 0)
SELECT path AS source, concat('/dst', left(path, length(path) - length(ext)), CASE WHEN doc_id % 9 = 0 THEN ' (2)' WHEN doc_id % 3 = 0 THEN ' (1)' ELSE '' END, ext) AS destination, n_chars AS size, doc_id % 2 = 0 AS to_trash FROM f""")
def copy_plan(spark, d):
    """Shown files under another root, renamed where that name, or that and its first number, exist; moved ones go to the trash after."""
    shown = files(spark, d).where(~F.exists(F.split("path", "/"), lambda x: x.startswith(".")))
    p = F.col("path")
    bare = F.concat(F.lit("/dst"), F.substr(p, F.lit(1), F.length(p) - F.length(X.extension(p))))
    wanted = shown.select("doc_id", p.alias("source"), bare.alias("target"), X.extension(p).alias("ext"), F.col("n_chars").alias("size"))
    there = wanted.where("doc_id % 3 = 0").select("target", "ext")
    again = wanted.where("doc_id % 9 = 0").select(F.concat("target", F.lit(" (1)")).alias("target"), "ext")
    return K.unique_names(wanted, "doc_id", there.unionByName(again)).select("source", F.col("name").alias("destination"), "size", (F.col("doc_id") % 2 == 0).alias("to_trash"))


@query("SELECT lang, CAST(sum(n_chars) AS BIGINT) AS size FROM documents GROUP BY lang")
def tree_total_size(spark, d):
    return files(spark, d).groupBy("lang").agg(F.sum("n_chars").alias("size"))


@query("SELECT lang, greatest(count(*) + count(DISTINCT source), 1) AS items FROM documents GROUP BY lang")
def tree_item_count(spark, d):
    """Files and the folders they are in."""
    return files(spark, d).groupBy("lang", "source").agg(F.count("*").alias("n")).groupBy("lang").agg(F.greatest(F.sum("n") + F.count("*"), F.lit(1)).alias("items"))


@query(f"WITH {FILES_SQL} SELECT path, path[length(concat('/', lang)) + 2:] AS relative FROM files")
def relative_path(spark, d):
    return files(spark, d).select("path", F.substr("path", F.length(F.concat(F.lit("/"), "lang")) + 2).alias("relative"))


@query(rf"WITH {FILES_SQL}, p AS (SELECT path, string_split(path, '/')[-1] AS name, {EXT_SQL} AS extension FROM files) SELECT path, regexp_replace(path, '/[^/]*$', '') AS folder, name, left(name, length(name) - length(extension)) AS stem, extension FROM p")
def path_parts(spark, d):
    p = F.col("path")
    return files(spark, d).select("path", X.dirname(p).alias("folder"), X.basename(p).alias("name"), X.stem(p).alias("stem"), X.extension(p).alias("extension"))
