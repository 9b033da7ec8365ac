"""Segments, running progress and change detection over ordered events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from frameloom.functions import scalars as X
from frameloom.operators import catalog as K
from frameloom.operators import intervals as I
from frameloom.plans.base import query, table

COMMANDS_SQL = "cmd AS (SELECT user_id, event_id, ts, CASE event_type WHEN 'view' THEN 'start' WHEN 'click' THEN 'end' ELSE 'cancel' END AS command FROM events WHERE event_type IN ('view', 'click', 'error'))"
SEGMENTS_SQL = f"""{COMMANDS_SQL}, prev AS (SELECT *, lag(command) OVER w AS c, lag(event_id) OVER w AS p FROM cmd WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
seg AS (SELECT user_id, p AS begin, event_id AS finish FROM prev WHERE command = 'end' AND c = 'start' AND event_id > p)"""
RUN_SQL = "run AS (SELECT user_id, event_id, ts, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS done, count(*) OVER (PARTITION BY user_id) AS total FROM events)"


def commands(spark, d):
    kind = F.when(F.col("event_type") == "view", "start").when(F.col("event_type") == "click", "end").otherwise("cancel")
    return table(spark, d, "events").where(F.col("event_type").isin("view", "click", "error")).select("user_id", "event_id", "ts", kind.alias("command"))


def segments(spark, d):
    return K.segments(commands(spark, d), "user_id", ["ts", "event_id"], "event_id")


def run(spark, d):
    return K.running(table(spark, d, "events").select("user_id", "event_id", "ts", "event_type"), "user_id", ["ts", "event_id"])


@query(f"WITH {SEGMENTS_SQL} SELECT user_id, begin, finish FROM seg")
def segment_state_machine(spark, d):
    return segments(spark, d)


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id % 50 END AS duration FROM events")
def segment_duration(spark, d):
    end = F.when(F.col("event_id") % 3 != 0, F.col("event_id") + F.col("event_id") % 50)
    return table(spark, d, "events").select("event_id", F.coalesce(end - F.col("event_id"), F.lit(0)).cast("long").alias("duration"))


@query(f"WITH {SEGMENTS_SQL} SELECT user_id, begin, CASE WHEN begin % 2 = 0 THEN 'intro' ELSE concat('Segment ', row_number() OVER (PARTITION BY user_id ORDER BY begin)) END AS name FROM seg")
def segment_auto_name(spark, d):
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("begin"))
    said = F.when(F.col("begin") % 2 == 0, "intro").otherwise("")
    return segments(spark, d).select("user_id", "begin", F.coalesce(F.nullif(said, F.lit("")), F.concat(F.lit("Segment "), n.cast("string"))).alias("name"))


@query(f"WITH {SEGMENTS_SQL} SELECT user_id, concat('user', user_id, '_', row_number() OVER (PARTITION BY user_id ORDER BY begin), '.mp4') AS file, begin / 25.0::DOUBLE AS start, (finish - begin) / 25.0::DOUBLE AS duration FROM seg")
def segment_export_plan(spark, d):
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("begin"))
    name = F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit("_"), n.cast("string"), F.lit(".mp4"))
    return segments(spark, d).select("user_id", name.alias("file"), (F.col("begin") / 25.0).alias("start"), ((F.col("finish") - F.col("begin")) / 25.0).alias("duration"))


@query(f"""WITH {SEGMENTS_SQL} SELECT e.user_id, e.event_id, min(begin) AS begin FROM events e JOIN seg ON seg.user_id = e.user_id AND e.event_id BETWEEN begin AND finish GROUP BY e.user_id, e.event_id""")
def point_in_segment(spark, d):
    """The first segment, in order of their begin, that holds the event, both ends included."""
    points = table(spark, d, "events").select("user_id", F.col("event_id").alias("at"))
    found = I.first_covering(points, segments(spark, d).withColumn("place", F.col("begin")), "user_id", "at", "begin", "finish", "place")
    return found.select("user_id", F.col("at").alias("event_id"), "begin")


OVERLAPS_SQL = "o AS (SELECT user_id, event_id AS place, event_id - event_id % 37 AS begin, event_id - event_id % 37 + CASE WHEN event_id % 50 = 0 THEN 4000 ELSE event_id % 700 END AS finish FROM events WHERE event_type IN ('view', 'signup'))"


@query(f"WITH {OVERLAPS_SQL} SELECT e.user_id, e.event_id, min_by(o.begin, o.place) AS begin, min(o.place) AS place FROM events e JOIN o ON o.user_id = e.user_id AND e.event_id BETWEEN o.begin AND o.finish GROUP BY e.user_id, e.event_id")
def point_in_overlapping_segments(spark, d):
    """Segments that nest and overlap, as users may draw them: the first in list order that holds the event."""
    e = table(spark, d, "events")
    begin, n = F.col("event_id") - F.col("event_id") % 37, F.col("event_id")
    drawn = e.where(F.col("event_type").isin("view", "signup")).select("user_id", n.alias("place"), begin.alias("begin"), (begin + F.when(n % 50 == 0, 4000).otherwise(n % 700)).alias("finish"))
    found = I.first_covering(e.select("user_id", "event_id"), drawn, "user_id", "event_id", "begin", "finish", "place")
    return found.select("user_id", "event_id", "begin", "place")


@query("SELECT a.event_id, b.event_type AS key_type FROM events a JOIN events b ON b.event_id = a.event_id - a.event_id % 60 AND a.event_id <> 0")
def bucket_lookup_join(spark, d):
    e = table(spark, d, "events")
    keys = e.where("event_id % 60 = 0").select(F.col("event_id").alias("k"), F.col("event_type").alias("key_type"))
    return e.where("event_id <> 0").select("event_id", (F.col("event_id") - F.col("event_id") % 60).alias("k")).join(keys, "k").select("event_id", "key_type")


@query(f"WITH {SEGMENTS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY begin) - 1 AS i FROM seg) SELECT user_id, begin, ['red', 'green', 'blue', 'yellow', 'purple'][CAST(i % 5 + 1 AS INTEGER)] AS colour, CAST(i // 2 AS BIGINT) AS line, CAST(i % 2 AS BIGINT) AS place FROM n")
def round_robin_assign(spark, d):
    i = (F.row_number().over(Window.partitionBy("user_id").orderBy("begin")) - 1).cast("long")
    colours = F.array(*map(F.lit, ("red", "green", "blue", "yellow", "purple")))
    rows = segments(spark, d).withColumn("i", i)
    return rows.select("user_id", "begin", F.element_at(colours, (F.col("i") % 5 + 1).cast("int")).alias("colour"), F.expr("i div 2").alias("line"), (F.col("i") % 2).alias("place"))


@query(f"WITH {SEGMENTS_SQL} SELECT user_id, begin AS at, 'segment' AS action FROM seg UNION ALL SELECT user_id, event_id, event_type FROM events WHERE event_type IN ('signup', 'purchase')")
def append_history(spark, d):
    made = segments(spark, d).select("user_id", F.col("begin").alias("at"), F.lit("segment").alias("action"))
    old = table(spark, d, "events").where(F.col("event_type").isin("signup", "purchase")).select("user_id", F.col("event_id").alias("at"), F.col("event_type").alias("action"))
    return made.unionByName(old)


@query(f"WITH {RUN_SQL} SELECT user_id, event_id, CAST(trunc(done * 100 / CAST(total AS DOUBLE)) AS INTEGER) AS percent FROM run")
def running_progress(spark, d):
    return run(spark, d).select("user_id", "event_id", X.percent(F.col("done"), F.col("total")).alias("percent"))


@query(f"""WITH {RUN_SQL}, f AS (SELECT *, epoch(ts) - epoch(min(ts) OVER (PARTITION BY user_id)) AS elapsed FROM run)
SELECT user_id, event_id, round(elapsed / done * (total - done), 6) AS eta, CASE WHEN elapsed > 0 THEN round(60 * done / elapsed, 9) END AS rate FROM f""")
def eta_linear(spark, d):
    w = Window.partitionBy("user_id")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    rows = run(spark, d).withColumn("elapsed", seconds - F.min(seconds).over(w))
    eta = F.col("elapsed") / F.col("done") * (F.col("total") - F.col("done"))
    return rows.select("user_id", "event_id", F.round(eta, 6).alias("eta"), F.when(F.col("elapsed") > 0, F.round(60 * F.col("done") / F.col("elapsed"), 9)).alias("rate"))


@query(f"WITH {RUN_SQL} SELECT user_id, event_id FROM run WHERE done % greatest(1, total // 20) = 0")
def progress_every_5pct(spark, d):
    return run(spark, d).where("done % greatest(1, total div 20) = 0").select("user_id", "event_id")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p IS NULL OR p <> event_type")
def change_only_lag(spark, d):
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = table(spark, d, "events").withColumn("p", before)
    return rows.where("p is null or p <> event_type").select("user_id", "event_id", "event_type")


@query(f"WITH {RUN_SQL} SELECT user_id, event_id, CAST(done AS INTEGER) AS n FROM run")
def row_order(spark, d):
    return run(spark, d).select("user_id", "event_id", F.col("done").cast("int").alias("n"))


@query("SELECT event_id, least(CAST(trunc(value) AS INTEGER), 100) AS percent, greatest(0.0::DOUBLE, least(1.0::DOUBLE, value / 300)) AS position FROM events")
def clamp_percent(spark, d):
    v = F.col("value")
    return table(spark, d, "events").select("event_id", F.least(v.cast("int"), F.lit(100)).alias("percent"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), v / 300)).alias("position"))


@query("SELECT user_id, event_id FROM (SELECT *, coalesce(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS e FROM events) WHERE e < 5")
def error_cap_running(spark, d):
    """Items that are tried before the fifth error stops the user's run."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    errors = F.coalesce(F.sum(F.when(F.col("event_type") == "error", 1).otherwise(0)).over(w), F.lit(0))
    return table(spark, d, "events").withColumn("e", errors).where("e < 5").select("user_id", "event_id")


@query("SELECT event_id % 20 AS batch, CAST(count(*) FILTER (WHERE event_type <> 'error') AS BIGINT) AS done, CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS failed FROM events GROUP BY 1")
def batch_result_split(spark, d):
    failed = F.col("event_type") == "error"
    return table(spark, d, "events").groupBy((F.col("event_id") % 20).alias("batch")).agg(F.count_if(~failed).alias("done"), F.count_if(failed).alias("failed"))


@query("""WITH j AS (SELECT user_id, event_id, ts, coalesce(abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)), 0) > 200 AS cut FROM events),
s AS (SELECT *, sum(CASE WHEN cut THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS scene FROM j)
SELECT user_id, CAST(scene AS BIGINT) AS scene, min(event_id) AS first, max(event_id) AS last, count(*) AS frames FROM s GROUP BY user_id, scene HAVING count(*) >= 3""")
def scene_split(spark, d):
    """Beyond the inventory's code: a jump above the threshold begins a scene, short scenes go."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    cut = F.coalesce(F.abs(F.col("value") - F.lag("value").over(w)), F.lit(0.0)) > 200
    scene = F.sum(F.when(F.col("cut"), 1).otherwise(0)).over(w)
    rows = table(spark, d, "events").withColumn("cut", cut).withColumn("scene", scene)
    return rows.groupBy("user_id", "scene").agg(F.min("event_id").alias("first"), F.max("event_id").alias("last"), F.count("*").alias("frames")).where("frames >= 3")
