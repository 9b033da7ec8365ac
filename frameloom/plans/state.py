"""What a catalogue keeps between runs: documents written and read back, caches, states, histories; and functions mapped over items."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from frameloom.functions import scalars as X
from frameloom.operators import batches as B
from frameloom.operators import catalog as K
from frameloom.operators import similarity as S
from frameloom.plans.base import FILES_SQL, files, query, table
from frameloom.plans.media import BITS_SQL, FRAMES_SQL, frames
from frameloom.sources import documents as D
from frameloom.sources.scratch import scratch_path


def place(spark, label: str) -> str:
    return f"{scratch_path(spark, label)}.json"


def listed(rows, *columns):
    """One row, one column: an array of the rows of a small table."""
    return rows.agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("value"))


@query("SELECT DISTINCT least(x.n_name, y.n_name) AS a, greatest(x.n_name, y.n_name) AS b FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey AND x.n_name <> y.n_name")
def ignored_pairs_document(spark, d):
    """Pairs of a bounded list, saved in both orders with entries that aren't pairs, and read back."""
    n = table(spark, d, "nation")
    pairs = n.select("n_regionkey", F.col("n_name").alias("x")).join(n.select("n_regionkey", F.col("n_name").alias("y")), "n_regionkey")
    path = place(spark, "ignored")
    rows = pairs.select(F.array("x", "y").alias("p")).unionByName(n.select(F.array("n_name").alias("p")))
    D.save_document(rows.agg(F.collect_list("p").alias("value")), path, column="value")
    return D.ignored_pairs(spark, path)


@query("""SELECT n_nationkey * 1000 AS input_size, n_nationkey * 900 AS output_size, n_regionkey + 0.5::DOUBLE AS duration, CAST(n_nationkey % 3 + 1 AS INTEGER) AS attempt_count, n_nationkey % 4 <> 0 AS success, concat('2024-01-', lpad(CAST(n_nationkey + 1 AS VARCHAR), 2, '0'), 'T00:00:00') AS date, n_name AS preset FROM nation""")
def conversion_stats_document(spark, d):
    k = F.col("n_nationkey").cast("long")
    day = F.concat(F.lit("2024-01-"), F.lpad((k + 1).cast("string"), 2, "0"), F.lit("T00:00:00"))
    rows = table(spark, d, "nation").select(
        (k * 1000).alias("input_size"), (k * 900).alias("output_size"), (F.col("n_regionkey") + 0.5).alias("duration"), (k % 3 + 1).cast("int").alias("attempt_count"),
        F.create_map(F.lit("preset"), F.col("n_name")).alias("params_used"), (k % 4 != 0).alias("success"), day.alias("date"),
    )
    path = place(spark, "stats")
    D.save_document(rows.agg(F.collect_list(F.struct(*rows.columns)).alias("value")), path, column="value")
    return D.stats(spark, path).withColumn("preset", F.col("params_used")["preset"]).drop("params_used")


@query("SELECT 'new' AS document, 0 AS segments, '/v.mkv' AS video_path UNION ALL SELECT 'broken', 0, '/v.mkv' UNION ALL SELECT 'kept', count(*), '/own.mkv' FROM nation")
def project_document(spark, d):
    """Projects opened from no document, from a broken one and from a whole one; the first two are saved with defaults first."""
    new, broken, kept = (place(spark, f"project-{n}") for n in ("new", "broken", "kept"))
    D.save_text(spark, '{"video_path": ', broken)
    segments = listed(table(spark, d, "nation"), F.col("n_nationkey").cast("double").alias("start"), (F.col("n_nationkey") + 1.0).alias("end"), F.col("n_name").alias("name"))
    D.save_document(segments.select(F.lit("/own.mkv").alias("video_path"), F.col("value").alias("segments")), kept)
    out = None
    for name, path in (("new", new), ("broken", broken), ("kept", kept)):
        D.project_or_new(spark, path, "/v.mkv")
        row = D.project(spark, path, "?").select(F.lit(name).alias("document"), F.size("segments").cast("long").alias("segments"), "video_path")
        out = row if out is None else out.unionByName(row)
    return out


@query("SELECT n_nationkey * 10 AS start_frame, CASE WHEN n_nationkey % 3 <> 0 THEN n_nationkey * 10 + 5 END AS end_frame, n_name AS name, CASE WHEN n_nationkey % 3 <> 0 THEN 5 ELSE 0 END AS frames FROM nation")
def frame_segments_document(spark, d):
    """Segments saved and read back; an open one has no end, and no length."""
    k = F.col("n_nationkey").cast("int")
    path = place(spark, "segments")
    rows = listed(table(spark, d, "nation"), (k * 10).alias("start_frame"), F.when(k % 3 != 0, k * 10 + 5).alias("end_frame"), F.col("n_name").alias("name"), F.lit("red").alias("color"))
    D.save_document(rows.select(F.col("value").alias("segments")), path)
    read = D.frame_segments(spark, path)
    length = F.when(F.col("end_frame").isNotNull(), F.col("end_frame") - F.col("start_frame")).otherwise(0)
    return read.select(F.col("start_frame").cast("long").alias("start_frame"), F.col("end_frame").cast("long").alias("end_frame"), "name", length.cast("int").alias("frames"))


PATTERNS = (("ti", "TI", True), ("[aeiou]+$", "", True), ("x", "y", False), ("r(.)", "$1r", True))


@query(r"SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(p_name, 'ti', 'TI', 'g'), '[aeiou]+$', '', 'g'), 'r(.)', '\1r', 'g') AS name FROM part")
def regex_rename_document(spark, d):
    """Beyond the inventory's code: the enabled patterns of a document applied in order."""
    path = place(spark, "patterns")
    said = [{"pattern": p, "replace_with": r, "enabled": e} for p, r, e in PATTERNS]
    rows = spark.range(1).select(F.from_json(F.lit(json.dumps(said)), D.PATTERNS).alias("value"))
    D.save_document(rows, path, column="value")
    name = F.col("p_name")
    for p in D.patterns(spark, path).orderBy("place").collect():  # a user's list
        name = F.regexp_replace(name, p["pattern"], p["replace_with"])
    return table(spark, d, "part").select("p_partkey", name.alias("name"))


@query("SELECT n_name AS name, CASE WHEN n_nationkey % 3 <> 1 THEN concat('/in/', n_name) END AS source_path, CASE WHEN n_nationkey % 3 <> 2 THEN concat('/out/', n_nationkey) END AS dest_path FROM nation")
def copy_settings_document(spark, d):
    """Settings of many users, a document each, of which some lack a field; what is missing is null."""
    k, name = F.col("n_nationkey"), F.col("n_name")
    said = F.struct(name.alias("name"), F.when(k % 3 != 1, F.concat(F.lit("/in/"), name)).alias("source_path"), F.when(k % 3 != 2, F.concat(F.lit("/out/"), k.cast("string"))).alias("dest_path"), F.lit(1).alias("other"))
    folder = scratch_path(spark, "copy")
    D.save_documents(table(spark, d, "nation").select(said.alias("s")).select("s.*"), folder)
    return D.settings_documents(spark, folder, "name string, source_path string, dest_path string")


@query(f"WITH {FRAMES_SQL} SELECT 'frame' AS kind, concat('/v', video_id) AS a, CAST(pos AS VARCHAR) AS b, array_to_string(bits, '') AS bits FROM frames UNION ALL SELECT 'pair', n_name, concat(n_name, ' ', n_regionkey), '' FROM nation")
def analysed_files_document(spark, d):
    """The store of analysed files, as documents of about a hundred items each: all items with their frames' bits, and pairs as they were noted."""
    bit = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.substr(F.col("s"), i + 1, F.lit(1)) == "1")
    block = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.slice("b", r * 8 + 1, 8))
    own = frames(spark, d).select("video_id", "pos", F.lpad(F.bin("h"), 64, "0").alias("s"))
    own = S.settled(own, ["video_id", "pos"], b=bit).select("video_id", F.struct("pos", block.alias("block")).alias("f"))
    items = own.groupBy("video_id").agg(F.transform(F.array_sort(F.collect_list("f")), lambda f: f["block"]).alias("hash"))
    entry = F.struct(F.concat(F.lit("/v"), F.col("video_id").cast("string")), F.col("hash"))
    stored = items.groupBy(F.expr("video_id div 100").alias("_part")).agg(F.map_from_entries(F.collect_list(entry)).alias("analyzed_files")).drop("_part")
    pairs = table(spark, d, "nation").groupBy("n_regionkey").agg(F.collect_list(F.array("n_name", F.concat_ws(" ", "n_name", F.col("n_regionkey").cast("string")))).alias("ignored_pairs")).select("ignored_pairs")
    path = scratch_path(spark, "analysed")
    D.save_documents(stored.unionByName(pairs, allowMissingColumns=True), path)
    found, ignored = D.analysed_files(spark, path)
    return found.select(F.lit("frame").alias("kind"), F.col("path").alias("a"), F.col("frame_pos").cast("string").alias("b"), F.array_join("bits", "").alias("bits")).unionByName(
        ignored.select(F.lit("pair").alias("kind"), "a", "b", F.lit("").alias("bits")))


@query(f"WITH {BITS_SQL} SELECT vec_id, array_to_string(bits, '') AS bits, vec_id % 7 * 60.0::DOUBLE AS last_modified, 0 AS left_after_clearing FROM bits")
def hash_cache_roundtrip(spark, d):
    """The cache of all hashes, written once as a table, read back, and cleared."""
    path = scratch_path(spark, "hash-cache")
    rows = S.frame_hashes(table(spark, d, "embeddings")).select("vec_id", "h", (F.col("vec_id") % 7 * 60.0).alias("last_modified"))
    D.save_cache(rows, path)
    copy = scratch_path(spark, "hash-cache")
    D.save_cache(rows.limit(100), copy)
    D.clear_cache(spark, copy)
    left = spark.read.parquet(copy).count()
    return spark.read.parquet(path).select("vec_id", F.lpad(F.bin("h"), 64, "0").alias("bits"), "last_modified", F.lit(left).cast("int").alias("left_after_clearing"))


def steps_of_states(spark, d):
    """The events as user_id, event_id, ts, op and state."""
    op = F.when(F.col("event_type") == "view", "push").when(F.col("event_type").isin("click", "purchase"), "set").when(F.col("event_type") == "error", "pop")
    state = F.concat("event_type", (F.col("event_id") % 10).cast("string"))
    return table(spark, d, "events").select("user_id", "event_id", "ts", op.alias("op"), state.alias("state")).where("op is not null")


OP_SQL = "CASE event_type WHEN 'view' THEN 'push' WHEN 'click' THEN 'set' WHEN 'purchase' THEN 'set' WHEN 'error' THEN 'pop' END"


@query(f"""WITH RECURSIVE e AS (SELECT user_id, event_id, {OP_SQL} AS op, concat(event_type, event_id % 10) AS state, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE event_type IN ('view', 'click', 'purchase', 'error')),
r AS (SELECT user_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS event_id, 'idle' AS state, CAST([] AS VARCHAR[]) AS stack FROM (SELECT DISTINCT user_id FROM e)
  UNION ALL SELECT e.user_id, e.i, e.event_id, CASE WHEN op <> 'pop' THEN e.state WHEN len(r.stack) > 0 THEN r.stack[-1] ELSE r.state END,
    CASE WHEN op = 'push' THEN list_append(r.stack, r.state) WHEN op = 'pop' AND len(r.stack) > 0 THEN r.stack[:-2] ELSE r.stack END FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
SELECT user_id, event_id, state, CAST(len(stack) AS BIGINT) AS depth FROM r WHERE i > 0""")
def state_stack(spark, d):
    """States set, pushed and popped; a pop of nothing changes nothing.

    Depth is a running sum kept at 0 or more; the state after a step is the last one set at its depth.
    """
    return K.stacked(steps_of_states(spark, d), "user_id", ["ts", "event_id"], "idle").select("user_id", "event_id", "state", "depth")


@query("""WITH i AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) % 7 AS k FROM events) SELECT event_id, k <> 0 AS ok, CASE WHEN k <> 0 THEN CAST(100 // k AS VARCHAR) END AS value, CASE WHEN k = 0 THEN 'ZeroDivisionError' END AS error FROM i""")
def batch_map_errors(spark, d):
    """A Python function over all items; what it raises is the item's error."""

    def work(text: str) -> int:
        return 100 // (json.loads(text)["k"] % 7)

    done = B.mapped(table(spark, d, "events"), "event_id", "props", work)
    return done.withColumn("error", F.substring_index("error", ":", 1))


STEPS = B.Transforms()


@STEPS.register("only_large", "values above 10")
def _only_large(rows):
    return rows.where("value > 10")


@STEPS.register("in_cents", "values as whole cents")
def _in_cents(rows):
    return rows.withColumn("cents", F.round(F.col("value") * 100).cast("long"))


@query("SELECT event_id, CAST(round(value * 100) AS BIGINT) AS cents FROM events WHERE value > 10")
def transform_chain(spark, d):
    """Registered steps found by name and applied in order."""
    return STEPS.chain(table(spark, d, "events"), ["only_large", "in_cents"]).select("event_id", "cents")


@query(f"WITH {FILES_SQL}, n AS (SELECT doc_id, path, concat(string_split(path, '/')[2], '-', doc_id % 50) AS name FROM files) SELECT name, min_by(path, doc_id) AS path, count(*) AS candidates FROM n GROUP BY name")
def update_by_name(spark, d):
    """Updates that know a bare name go to the first file of that name; files of one name in other folders are told by the count."""
    named = files(spark, d).select("doc_id", "path", F.concat_ws("-", F.get(F.split("path", "/"), F.lit(1)), (F.col("doc_id") % 50).cast("string")).alias("name"))
    return named.groupBy("name").agg(F.min_by("path", "doc_id").alias("path"), F.count("*").alias("candidates"))


@query("SELECT o_orderkey, frame, CAST(row_number() OVER (PARTITION BY o_orderkey ORDER BY frame) AS INTEGER) AS place FROM (SELECT o_orderkey, unnest(range(0, o_orderkey % 600 + 1, 60)) AS frame FROM orders)")
def thumbnail_order(spark, d):
    """Thumbnails in order of their frame, whatever order they arrive in."""
    arrived = table(spark, d, "orders").select("o_orderkey", F.explode(F.reverse(F.sequence(F.lit(0).cast("long"), F.col("o_orderkey") % 600, F.lit(60).cast("long")))).alias("frame"))
    shown = arrived.groupBy("o_orderkey").agg(F.array_sort(F.collect_list("frame")).alias("f"))  # few an item
    return shown.select("o_orderkey", F.posexplode("f").alias("at", "frame")).select("o_orderkey", "frame", (F.col("at") + 1).alias("place"))


@query("SELECT p_partkey, p_name, p_size FROM part ORDER BY p_size DESC, p_name, p_partkey")
def table_sort(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_name", "p_size").orderBy(F.desc("p_size"), "p_name", "p_partkey")


@query("""WITH f AS (SELECT p_partkey, concat(CASE WHEN p_partkey % 6 = 0 THEN '_' ELSE '' END, p_brand) AS name, p_partkey % 4 <> 0 AS folder, p_partkey % 5 <> 0 AS entry, p_partkey % 7 <> 0 AS package FROM part)
SELECT p_partkey, name FROM f WHERE folder AND name NOT LIKE '\\_%' ESCAPE '\\' AND entry AND package""")
def plugin_folders(spark, d):
    """Folders that hold an extension: not hidden by an underscore, with both files it needs."""
    k = F.col("p_partkey")
    listing = table(spark, d, "part").select("p_partkey", F.concat(F.when(k % 6 == 0, "_").otherwise(""), "p_brand").alias("name"), (k % 4 != 0).alias("folder"), F.array_compact(F.array(F.when(k % 5 != 0, "plugin.py"), F.when(k % 7 != 0, "__init__.py"))).alias("holds"))
    return listing.where(F.col("folder") & ~F.col("name").startswith("_") & F.array_contains("holds", "plugin.py") & F.array_contains("holds", "__init__.py")).select("p_partkey", "name")


@query("SELECT p_name, p_brand, count(*) AS files, count(*) >= 2 AS enough FROM part GROUP BY ALL")
def enough_files(spark, d):
    """Comparing and merging need two files."""
    return table(spark, d, "part").groupBy("p_name", "p_brand").agg(F.count("*").alias("files")).withColumn("enough", F.col("files") >= 2)


@query("SELECT p_partkey, CAST(greatest(p_size * 5 - 50, 0) AS INTEGER) AS lightness FROM part")
def darker_colour(spark, d):
    return table(spark, d, "part").select("p_partkey", X.darker(F.col("p_size") * 5).cast("int").alias("lightness"))


@query("SELECT vec_id, CAST(i * 10 // 64 AS INTEGER) AS bucket, max(abs(CAST(embedding[i + 1] AS DOUBLE))) AS peak FROM embeddings, (SELECT unnest(range(0, 64)) AS i) GROUP BY 1, 2")
def waveform_peaks(spark, d):
    """Beyond the inventory's code: the loudest sample of each of ten stretches."""
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x"))
    return e.groupBy("vec_id", F.expr("cast(i * 10 div 64 as int)").alias("bucket")).agg(F.max(F.abs(F.col("x").cast("double"))).alias("peak"))


@query("""WITH t AS (SELECT o_orderkey, o_orderkey % 8000 + 2000 AS t, unnest([1, 2, 3]) AS level FROM orders), k AS (SELECT *, least(5 * level, t // (1500 // level)) AS k FROM t)
SELECT o_orderkey, level, array_to_string(CASE WHEN k >= 3 THEN list_transform(range(0, k), lambda i: CAST(i * t // k AS BIGINT)) ELSE list_sort(list_distinct(list_concat(list_transform(range(0, k), lambda i: CAST(i * t // k AS BIGINT)), range(0, 5)))) END, ',') AS indices FROM k""")
def sampling_precision(spark, d):
    """Beyond the inventory's code: the sampling rule at three levels, 5 frames a level at most, one in 1500 / level."""
    t = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 8000 + 2000).alias("t"))
    out = None
    for level in (1, 2, 3):
        found = t.select("o_orderkey", F.lit(level).alias("level"), F.array_join(S.sampled_frames(F.col("t"), stride=1500 // level, most=5 * level).cast("array<string>"), ",").alias("indices"))
        out = found if out is None else out.unionByName(found)
    return out


@query("SELECT user_id, max_by(event_type, (ts, event_id)) AS action, max_by(event_id, (ts, event_id)) AS event_id FROM events WHERE event_id % 10 < 8 AND event_id < user_id * 60 + 2000 GROUP BY user_id")
def history_restore(spark, d):
    """Beyond the inventory's code: the last entry before a version, for every key."""
    kept = table(spark, d, "events").where("event_id % 10 < 8 and event_id < user_id * 60 + 2000")
    last = F.max_by(F.struct("event_type", "event_id"), F.struct("ts", "event_id"))
    return kept.groupBy("user_id").agg(last.alias("r")).select("user_id", F.col("r.event_type").alias("action"), F.col("r.event_id").alias("event_id"))


@query("""SELECT event_id, concat('{"attempts":', CASE WHEN event_id % 3 = 0 THEN 1 ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) + 1 END, '}') AS metadata FROM events""")
def attempt_counter(spark, d):
    """Beyond the inventory's code: the attempts that a file's metadata count, and one more."""
    said = F.when(F.col("event_id") % 3 == 0, "{}").otherwise(F.col("props"))
    count = F.coalesce(F.from_json(said, "k long")["k"], F.lit(0).cast("long")) + 1
    return table(spark, d, "events").select("event_id", F.to_json(F.struct(count.alias("attempts"))).alias("metadata"))
