"""Scalar functions, validation, JSON, logs and the streaming twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from frameloom.functions import scalars as X
from frameloom.operators import validation as V
from frameloom.plans.base import FILES_SQL, files, query, table
from frameloom.plans.catalogue import EXT_SQL
from frameloom.streaming import logs, progress

ONE = "printf('%.1f', {0})"


def _size_sql(*units: str) -> str:
    cases = " ".join(f"WHEN s < {1024.0 ** (i + 1):.0f} THEN concat({ONE.format(f's / {1024.0 ** i:.0f}')}, ' {u}')" for i, u in enumerate(units[:-1]))
    return f"CASE {cases} ELSE concat({ONE.format(f's / {1024.0 ** (len(units) - 1):.0f}')}, ' {units[-1]}') END"


UNITS = ("B", "KB", "MB", "GB", "TB")


@query(f"SELECT o_orderkey, {_size_sql(*UNITS)} AS label, {_size_sql(*UNITS, 'PB')} AS copied FROM (SELECT o_orderkey, o_totalprice * power(o_orderkey % 7 + 1, 14) AS s FROM orders)")
def format_size(spark, d):
    """Sizes as text, with terabytes or petabytes as the last unit."""
    s = F.col("o_totalprice") * F.pow(F.col("o_orderkey") % 7 + 1, F.lit(14))
    return table(spark, d, "orders").select("o_orderkey", X.format_size(s).alias("label"), X.format_size(s, (*UNITS, "PB")).alias("copied"))


@query(f"SELECT doc_id, n_chars / 1048576.0::DOUBLE AS mib, concat({ONE.format('n_chars * 997 / 1048576.0::DOUBLE')}, ' Mo') AS label FROM documents")
def size_mib(spark, d):
    return table(spark, d, "documents").select("doc_id", (F.col("n_chars") / 1048576.0).alias("mib"), X.format_mib(F.col("n_chars") * 997).alias("label"))


@query("SELECT o_orderkey, printf('%02d:%02d', CAST(floor(o_totalprice / 60) AS BIGINT), CAST(floor(o_totalprice - 60 * floor(o_totalprice / 60)) AS BIGINT)) AS label FROM orders")
def format_mmss(spark, d):
    return table(spark, d, "orders").select("o_orderkey", X.format_mmss(F.col("o_totalprice")).alias("label"))


@query("""SELECT o_orderkey, CASE WHEN s > 3600 THEN printf('%dh %02dm %02ds', s // 3600, s % 3600 // 60, s % 60) ELSE printf('%02dm %02ds', s // 60, s % 60) END AS label FROM (SELECT o_orderkey, o_orderkey * 7 % 9001 AS s FROM orders)""")
def format_eta(spark, d):
    return table(spark, d, "orders").select("o_orderkey", X.format_eta(F.col("o_orderkey") * 7 % 9001).alias("label"))


LINES_SQL = r"""l AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'frame= 10 q=2' WHEN 1 THEN printf('size=1 time=%02d:%02d:%02d.50 bitrate=1', event_id % 30, event_id % 60, event_id % 59)
  WHEN 2 THEN printf('time=%d:%d:%d.125', event_id % 120, event_id % 60, event_id % 59) WHEN 3 THEN printf('x time=N/A q=%d', event_id) ELSE printf('time=%d:%d speed', event_id % 60, event_id % 59) END AS line FROM events)"""


def lines(spark, d):
    n = F.col("event_id")
    line = (
        F.when(n % 5 == 0, "frame= 10 q=2").when(n % 5 == 1, F.format_string("size=1 time=%02d:%02d:%02d.50 bitrate=1", n % 30, n % 60, n % 59))
        .when(n % 5 == 2, F.format_string("time=%d:%d:%d.125", n % 120, n % 60, n % 59)).when(n % 5 == 3, F.format_string("x time=N/A q=%d", n)).otherwise(F.format_string("time=%d:%d speed", n % 60, n % 59))
    )
    return table(spark, d, "events").select("event_id", line.alias("line"))


@query(rf"""WITH {LINES_SQL}, m AS (SELECT event_id, line, regexp_extract(line, 'time=(\d{{2}}):(\d{{2}}):(\d{{2}})\.\d{{2}}', ['h', 'm', 's']) AS a, regexp_extract(line, 'time=(\d+):(\d+):(\d+\.\d+)', ['h', 'm', 's']) AS b,
  string_split(string_split(string_split(line, 'time=')[2], ' ')[1], ':') AS c FROM l)
SELECT event_id, TRY_CAST(a.h AS BIGINT) * 3600 + TRY_CAST(a.m AS BIGINT) * 60 + TRY_CAST(a.s AS BIGINT) AS seconds, TRY_CAST(b.h AS DOUBLE) * 3600 + TRY_CAST(b.m AS DOUBLE) * 60 + TRY_CAST(b.s AS DOUBLE) AS exact,
  CASE WHEN len(c) = 3 THEN TRY_CAST(c[1] AS DOUBLE) * 3600 + TRY_CAST(c[2] AS DOUBLE) * 60 + TRY_CAST(c[3] AS DOUBLE) END AS split FROM m""")
def parse_ffmpeg_time(spark, d):
    """Progress lines in the three readings: strict whole seconds, fractional seconds, and split at separators."""
    line = F.col("line")
    return lines(spark, d).select("event_id", X.progress_seconds(line).alias("seconds"), X.progress_fraction_seconds(line).alias("exact"), X.progress_split_seconds(line).alias("split"))


@query("SELECT p_partkey, lower(p_name) AS low, ends_with(p_name, 'e') AS ends, starts_with(p_name, 'a') AS starts, trim(concat(' ', p_brand, ' ')) AS bare, len(string_split(p_name, ' ')) AS words FROM part")
def string_basics(spark, d):
    n = F.col("p_name")
    return table(spark, d, "part").select("p_partkey", F.lower(n).alias("low"), n.endswith("e").alias("ends"), n.startswith("a").alias("starts"), F.trim(F.concat(F.lit(" "), "p_brand", F.lit(" "))).alias("bare"), F.size(F.split(n, " ")).cast("long").alias("words"))


@query(f"SELECT p_partkey, concat(p_size * 16, 'x', p_size * 9) AS resolution, concat({ONE.format('p_retailprice / 7')}, 's') AS duration FROM part")
def resolution_label(spark, d):
    size = F.format_string("%dx%d", F.col("p_size") * 16, F.col("p_size") * 9)
    return table(spark, d, "part").select("p_partkey", size.alias("resolution"), X.format_seconds(F.col("p_retailprice") / 7).alias("duration"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, date_trunc('second', ts) AS back FROM events")
def iso_timestamp_roundtrip(spark, d):
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    return table(spark, d, "events").select("event_id", iso.alias("iso"), F.to_timestamp_ntz(iso, F.lit("yyyy-MM-dd'T'HH:mm:ss")).alias("back"))


@query("SELECT event_id, concat('log_', strftime(ts, '%Y%m%d')) AS name FROM events")
def date_suffix(spark, d):
    return table(spark, d, "events").select("event_id", F.concat(F.lit("log_"), F.date_format("ts", "yyyyMMdd")).alias("name"))


ENDINGS = (".mp4", ".AVI", ".mkv", ".mov", ".wmv", ".flv", ".webm", ".m4v", ".3gp", ".OGV", ".ts", ".m2ts", ".mts", ".mpg", ".mpeg", ".txt", ".mp3", "", ".jpeg")
NAMED_SQL = f"named AS (SELECT doc_id, n_chars, lower({list(ENDINGS)}[doc_id % {len(ENDINGS)} + 1]) AS e FROM documents)"


def named(spark, d):
    """documents with an ending each, known ones and others."""
    return table(spark, d, "documents").select("doc_id", "n_chars", F.element_at(F.array(*map(F.lit, ENDINGS)), (F.col("doc_id") % len(ENDINGS) + 1).cast("int")).alias("ext"))


@query(f"""WITH {NAMED_SQL} SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN 'missing' WHEN doc_id % 13 = 0 THEN 'not a file'
  WHEN NOT regexp_full_match(e, '\\.(mp4|avi|mkv|mov|wmv|flv|webm|m4v|3gp|ogv|ts|m2ts|mts)') THEN 'unsupported format' WHEN n_chars % 50 = 0 THEN 'empty' WHEN n_chars * 10000000 > 53687091200 THEN 'too large' ELSE 'valid' END AS verdict FROM named""")
def validate_file_case(spark, d):
    size = F.when(F.col("n_chars") % 50 == 0, 0).otherwise(F.col("n_chars") * 10_000_000)
    return named(spark, d).select("doc_id", V.file_check(F.col("doc_id") % 17 != 0, F.col("doc_id") % 13 != 0, F.col("ext"), size, V.mime_of(F.col("ext"))).alias("verdict"))


@query("""SELECT user_id, event_id, CASE WHEN event_id % 5 = 0 AND user_id % 2 = 0 THEN 'missing' WHEN event_id % 5 <> 0 AND event_type = 'view' THEN 'not a directory' WHEN event_id % 5 <> 0 AND value < 5 AND user_id % 3 = 0 THEN 'not writable' ELSE 'valid' END AS verdict
  FROM events""")
def validate_directory(spark, d):
    """Folders by what a listing says of them, with the two options dealt by user."""
    exists, folder, writable = F.col("event_id") % 5 != 0, F.col("event_type") != "view", F.col("value") >= 5
    checks = {(must, write): V.directory_check(exists, folder, writable, must, write) for must in (True, False) for write in (True, False)}
    must, write = F.col("user_id") % 2 == 0, F.col("user_id") % 3 == 0
    verdict = F.when(must & write, checks[True, True]).when(must, checks[True, False]).when(write, checks[False, True]).otherwise(checks[False, False])
    return table(spark, d, "events").select("user_id", "event_id", verdict.alias("verdict"))


@query("SELECT event_id, CASE WHEN value < 10 THEN 'too small' WHEN value > 400 THEN 'too large' ELSE 'valid' END AS verdict FROM events")
def validate_range(spark, d):
    return table(spark, d, "events").select("event_id", V.range_check(F.col("value"), 10, 400).alias("verdict"))


@query("SELECT c_custkey, regexp_matches(c_name, '^(?:Customer#0+[1-4])') AS ok FROM customer")
def validate_pattern(spark, d):
    return table(spark, d, "customer").select("c_custkey", V.starts_with_pattern(F.col("c_name"), "Customer#0+[1-4]").alias("ok"))


@query(r"""WITH u AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN concat('gopher:', url) WHEN page_id % 7 = 0 THEN 'http:///nowhere' WHEN page_id % 11 = 0 THEN replace(replace(url, 'https', 'http'), 'http', 'RTSP') ELSE url END AS u FROM pages)
SELECT page_id, regexp_matches(u, '^(?i:http|https|ftp|rtsp|rtmp)://[^/?#]+') AS ok FROM u""")
def validate_url(spark, d):
    n, url = F.col("page_id"), F.col("url")
    loud = F.replace(F.replace(url, F.lit("https"), F.lit("http")), F.lit("http"), F.lit("RTSP"))
    made = F.when(n % 5 == 0, F.concat(F.lit("gopher:"), url)).when(n % 7 == 0, F.lit("http:///nowhere")).when(n % 11 == 0, loud).otherwise(url)
    return table(spark, d, "pages").select("page_id", V.valid_url(made).alias("ok"))


CODECS = ("libx264", "libx265", "libvpx-vp9", "mpeg4", "copy", "h264"), ("aac", "mp3", "libvorbis", "flac", "opus", "copy")


@query(f"""WITH p AS (SELECT *, CAST(l_quantity + 6 AS INTEGER) AS crf, {list(CODECS[0])}[l_partkey % 6 + 1] AS v, {list(CODECS[1])}[l_suppkey % 6 + 1] AS a, CASE WHEN l_linenumber <> 3 THEN l_partkey % 9000 END AS w, l_suppkey * 31 % 9000 AS h FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, list_filter([CASE WHEN crf > 51 THEN 'crf' END, CASE WHEN NOT regexp_full_match(v, 'libx26[45]|libvpx-vp9|mpeg4') THEN 'video codec' END, CASE WHEN NOT regexp_full_match(a, 'aac|mp3|libvorbis|flac') THEN 'audio codec' END,
  CASE WHEN w < 1 OR w > 7680 THEN 'width' END, CASE WHEN w IS NOT NULL AND (h < 1 OR h > 7680) THEN 'height' END], lambda e: e IS NOT NULL) AS errors FROM p""")
def validate_collect_errors(spark, d):
    """All errors of a set of parameters; sizes are looked at only where both are given."""
    video, audio = [F.element_at(F.array(*map(F.lit, names)), (F.col(c) % len(names) + 1).cast("int")) for names, c in zip(CODECS, ("l_partkey", "l_suppkey"), strict=True)]
    width, height = F.when(F.col("l_linenumber") != 3, F.col("l_partkey") % 9000), F.col("l_suppkey") * 31 % 9000
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", V.parameter_errors(F.col("l_quantity") + 6, video, audio, width, height).alias("errors"))


BATCH_SQL = f"""{FILES_SQL}, f AS (SELECT source, string_split(path, '/')[-1] AS name, lower({EXT_SQL}) IN ('.mp4', '.avi', '.mkv', '.mov') AS ok FROM files)"""


def batches(spark, d):
    p = F.col("path")
    return files(spark, d).select("source", X.basename(p).alias("name"), F.lower(X.extension(p)).isin(*V.FORMATS).alias("ok"))


@query(f"""WITH {BATCH_SQL}, b AS (SELECT DISTINCT source FROM f UNION SELECT r_name FROM region), c AS (SELECT b.source, count(f.source) AS n, CAST(count(*) FILTER (WHERE ok) AS BIGINT) AS valid FROM b LEFT JOIN f USING (source) GROUP BY 1)
SELECT source, n, valid, array_to_string(list_filter([CASE WHEN n = 0 THEN 'no file' END, CASE WHEN n > 40 THEN concat('too many files (', n, ' > 40)') END, CASE WHEN n > 0 AND valid = 0 THEN 'no valid file' END], lambda e: e IS NOT NULL), ',') AS errors,
  n BETWEEN 1 AND 40 AND valid = n AS accepted FROM c""")
def validate_batch(spark, d):
    """Sources as batches of at most 40 files, and regions as batches of none: the batch's own errors; accepted if there are none, of files neither."""
    found = batches(spark, d).groupBy("source").agg(F.count("*").alias("n"), F.count_if("ok").alias("valid"))
    none = table(spark, d, "region").select(F.col("r_name").alias("source"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("valid"))
    g = found.unionByName(none).groupBy("source").agg(F.sum("n").alias("n"), F.sum("valid").alias("valid"))
    errors = V.batch_check(F.col("n"), F.col("valid"), most=40)
    return g.select("source", "n", "valid", F.array_join(errors, ",").alias("errors"), ((F.size(errors) == 0) & (F.col("valid") == F.col("n"))).alias("accepted"))


@query(f"WITH {BATCH_SQL} SELECT source, concat(name, ': unsupported format') AS error FROM f WHERE NOT ok")
def validate_batch_files(spark, d):
    """The errors of a batch's files, one row each."""
    return batches(spark, d).where(~F.col("ok")).select("source", F.concat("name", F.lit(": unsupported format")).alias("error"))


PROBLEMS = ("moov atom not found", "Vidéo corrompue: x", "format non supporté", "Invalid data found", "no codec", "Vidéo corrompue ou format non supporté: y", "Unsupported")


@query(f"""WITH m AS (SELECT event_id, concat(event_type, ' ', {list(PROBLEMS)}[event_id % {len(PROBLEMS)} + 1]) AS m FROM events)
SELECT event_id, CASE WHEN regexp_matches(m, 'moov atom not found|corrompue') THEN 'corrupted' WHEN regexp_matches(m, 'format non supporté') THEN 'unsupported' ELSE 'other' END AS route FROM m""")
def error_routing(spark, d):
    problem = F.element_at(F.array(*map(F.lit, PROBLEMS)), (F.col("event_id") % len(PROBLEMS) + 1).cast("int"))
    return table(spark, d, "events").select("event_id", V.error_route(F.concat("event_type", F.lit(" "), problem)).alias("route"))


@query("""WITH t AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '{"k": ' ELSE props END AS main, CASE WHEN event_id % 8 = 0 THEN '' ELSE concat('{"k": ', event_id % 100, '}') END AS backup FROM events)
SELECT event_id, coalesce(CASE WHEN json_valid(main) THEN CAST(json_extract_string(main, '$.k') AS BIGINT) END, CASE WHEN json_valid(backup) THEN CAST(json_extract_string(backup, '$.k') AS BIGINT) END, -1) AS k FROM t""")
def json_parse_fallback(spark, d):
    """The document, or its backup where it is corrupt, or the default."""
    n = F.col("event_id")
    main = F.when(n % 4 == 0, '{"k": ').otherwise(F.col("props"))
    backup = F.when(n % 8 == 0, "").otherwise(F.concat(F.lit('{"k": '), (n % 100).cast("string"), F.lit("}")))
    read = [F.from_json(c, "k long")["k"] for c in (main, backup)]
    return table(spark, d, "events").select("event_id", F.coalesce(*read, F.lit(-1).cast("long")).alias("k"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS original_size, CASE WHEN event_id % 3 = 0 THEN 0.0::DOUBLE ELSE 12.5 END AS ratio FROM events")
def json_nested_extract(spark, d):
    """A JSON text inside a container's tag; records without it are zero."""
    inner = F.to_json(F.struct(F.get_json_object("props", "$.k").cast("long").alias("original_size"), F.lit(12.5).alias("ratio")))
    tags = F.create_map(F.when(F.col("event_id") % 3 == 0, "other").otherwise("conversion"), inner)
    outer = F.to_json(F.struct(F.struct(tags.alias("tags")).alias("format")))
    read = table(spark, d, "events").select("event_id", outer.alias("j")).select("event_id", F.from_json(F.get_json_object("j", "$.format.tags.conversion"), "original_size long, ratio double").alias("r"))
    return read.select("event_id", F.coalesce("r.original_size", F.lit(0)).alias("original_size"), F.coalesce("r.ratio", F.lit(0.0)).alias("ratio"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, concat('{"input_size":', l_partkey, ',"attempt_count":', l_linenumber, ',"success":', CASE WHEN l_returnflag <> 'R' THEN 'true' ELSE 'false' END, '}') AS record FROM lineitem""")
def to_json_record(spark, d):
    record = F.to_json(F.struct(F.col("l_partkey").alias("input_size"), F.col("l_linenumber").alias("attempt_count"), (F.col("l_returnflag") != "R").alias("success")))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", record.alias("record"))


LEVEL_SQL = "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARNING' WHEN 'view' THEN 'DEBUG' ELSE 'INFO' END"


@query(f"""SELECT event_id, concat('{{"timestamp":"', strftime(ts, '%Y-%m-%dT%H:%M:%S'), '","level":"', {LEVEL_SQL}, '","logger":"user{{}}","message":"', event_type, '"', CASE WHEN event_type = 'error' THEN ',"exception":"failed"' ELSE '' END, '}}') AS line FROM events""")
def log_record_to_json(spark, d):
    e = table(spark, d, "events")
    records = e.select("event_id", logs.record(F.col("ts"), logs.level_of(F.col("event_type")), F.lit("user{}"), F.col("event_type"), F.when(F.col("event_type") == "error", "failed")).alias("r"))
    return records.select("event_id", F.to_json("r").alias("line"))


@query(f"SELECT sink, level, count(*) AS n FROM (SELECT {LEVEL_SQL} AS level, unnest(CASE {LEVEL_SQL} WHEN 'ERROR' THEN ['console', 'text', 'json', 'errors'] WHEN 'DEBUG' THEN ['text', 'json'] ELSE ['console', 'text', 'json'] END) AS sink FROM events) GROUP BY ALL")
def log_level_fanout(spark, d):
    levels = table(spark, d, "events").select(logs.level_of(F.col("event_type")).alias("level"))
    return logs.fan_out(levels).groupBy("sink", "level").agg(F.count("*").alias("n"))


@query(f"""WITH s AS (SELECT unnest(CASE {LEVEL_SQL} WHEN 'ERROR' THEN ['console', 'text', 'json', 'errors'] WHEN 'DEBUG' THEN ['text', 'json'] ELSE ['console', 'text', 'json'] END) AS sink FROM events) SELECT sink, count(*) AS lines FROM s GROUP BY sink""")
def log_sinks_stream(spark, d):
    """Log records as a stream, written to every sink that takes their level: JSON lines, and text."""
    e = table(spark, d, "events")
    record = logs.record(F.col("ts"), logs.level_of(F.col("event_type")), F.lit("app"), F.col("event_type"), F.when(F.col("event_type") == "error", "failed"))
    return logs.written_sinks(spark, e.select(record.alias("r")).select("r.*"))


@query("""WITH l AS (SELECT event_id, user_id, (event_id % 30) * 60 + event_id % 59 AS s FROM events WHERE event_id % 5 <> 0)
SELECT user_id, max(least(CAST(trunc(s * 100.0::DOUBLE / 1800) AS INTEGER), 100)) AS percent, count(*) AS lines FROM l GROUP BY user_id""")
def stream_parse_progress(spark, d):
    """Progress lines through Structured Streaming: a file stream, parsed and kept as the best percentage of each user."""
    return progress.parsed_progress(spark, f"{d.rstrip('/')}/events.parquet")
