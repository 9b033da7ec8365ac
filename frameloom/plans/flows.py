"""Work that runs beside its plan: deadlines, handlers, work lists, extensions, metrics, and streams with timers."""

from __future__ import annotations

import json
import time
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.operators import batches as B
from frameloom.operators import metrics as M
from frameloom.operators import work as W
from frameloom.plans import extensions
from frameloom.plans.base import ORACLES, query, table
from frameloom.plans.state import steps_of_states
from frameloom.sources.scratch import scratch_path
from frameloom.streaming import stacks


@query("SELECT doc_id, doc_id % 250 <> 7 AS ok, CASE WHEN doc_id % 250 <> 7 THEN CAST(doc_id * 2 AS VARCHAR) END AS value, CASE WHEN doc_id % 250 = 7 THEN 'TimeoutError: over 1 s' END AS error FROM documents")
def item_deadline(spark, d):
    """A function that hangs for some items: each costs its limit and is an error, the others finish."""

    def work(text: str) -> int:
        if int(text) % 250 == 7:
            time.sleep(3600)
        return int(text) * 2

    return B.mapped_within(table(spark, d, "documents").select("doc_id", F.col("doc_id").alias("n")), "doc_id", "n", work, seconds=1.0)


@query("""WITH i AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_id, k % 7 <> 0 AND k % 5 <> 1 AS ok, CASE WHEN k % 7 = 0 THEN 'none' WHEN k % 5 <> 1 THEN CAST(100 // (k % 7) AS VARCHAR) END AS value, CASE WHEN k % 7 = 0 THEN 'ZeroDivisionError' WHEN k % 5 = 1 THEN 'ValueError' END AS error FROM i""")
def batch_error_handlers(spark, d):
    """Errors by type: a handler of arithmetic errors gives a value in their stead, others have no handler."""

    def work(text: str) -> int:
        k = json.loads(text)["k"]
        found = 100 // (k % 7)
        if k % 5 == 1:
            raise ValueError("no such value")
        return found

    done = B.mapped(table(spark, d, "events"), "event_id", "props", work, handlers={ArithmeticError: lambda x, e: "none"})
    return done.withColumn("error", F.substring_index("error", ":", 1))


@query("SELECT doc_id, n_chars * 2 AS value FROM documents")
def resumed_work_list(spark, d):
    """A work list that stops after three of eight slices and is taken up again; each item is done once."""
    items = table(spark, d, "documents").select("doc_id", "n_chars")
    todo = W.WorkList(spark, scratch_path(spark, "work"), "doc_id", lambda rows: rows.select("doc_id", (F.col("n_chars") * 2).alias("value")))
    if not todo.run(items, most=3):
        todo.run(items)
    return todo.results("doc_id long, value long").select("doc_id", "value")


@query("""SELECT 'costly' AS name, count(*) AS events FROM events WHERE value > 100 UNION ALL SELECT 'purchases', count(*) FROM events WHERE event_type = 'purchase'
UNION ALL SELECT 'late_minutes', count(*) FROM events WHERE minute(ts) >= 30""")
def discovered_extensions(spark, d):
    """Steps of all modules of a package, each applied to the events."""
    found = B.Transforms()
    found.discover_package(extensions)
    rows = table(spark, d, "events")
    counts = [found.chain(rows, [name]).agg(F.count("*").alias("events")).select(F.lit(name).alias("name"), "events") for name in sorted(found.known)]
    return reduce(DataFrame.unionByName, counts)


@query("""SELECT 'events' AS name, count(*) AS n_rows, CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS errors, count(*) FILTER (WHERE event_type = 'error') / count(*) AS error_rate FROM events
UNION ALL SELECT 'large', count(*), CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT), count(*) FILTER (WHERE event_type = 'error') / count(*) FROM events WHERE value > 10""")
def plan_metrics(spark, d):
    """Rows, errors and their rate, counted while steps are written."""
    e, failed = table(spark, d, "events"), F.col("event_type") == "error"
    folder = scratch_path(spark, "metrics")
    return M.observed([("events", e, failed), ("large", e.where("value > 10"), failed)], lambda name, rows: rows.write.parquet(f"{folder}/{name}"))


@query("SELECT CAST(0 AS BIGINT) AS batch, count(*) AS input_rows, count(*) AS n_rows, CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS errors FROM events")
def stream_metrics(spark, d):
    """The same of a stream's micro-batches, by a listener."""
    folder = scratch_path(spark, "stream-metrics")
    events = f"{d.rstrip('/')}/events.parquet"
    top, _, name = events.rpartition("/")
    stream = spark.readStream.schema(spark.read.parquet(events).schema).option("pathGlobFilter", "*.parquet").parquet(f"{top}/{name}*")

    def start(rows):
        return rows.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out")

    return M.observed_stream(stream.select("event_id", "event_type"), "stream_metrics", F.col("event_type") == "error", start).drop("rows_per_second")


@query(ORACLES["state_stack"])
def state_stack_stream(spark, d):
    """State stacks as a stream that stops and goes on: list state, with a timer for idle keys."""
    steps = steps_of_states(spark, d).select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("position"), "op", "state")
    middle = steps.select(F.percentile_approx(F.unix_micros(F.col("ts").cast("timestamp")), 0.5)).first()[0]
    early = F.unix_micros(F.col("ts").cast("timestamp")) < F.lit(middle if middle is not None else 0)
    found = stacks.stacked_batches(spark, [steps.where(early), steps.where(~early)], "idle")
    return found.where("position is not null").select(F.col("key").alias("user_id"), F.col("position").alias("event_id"), "state", "depth")
