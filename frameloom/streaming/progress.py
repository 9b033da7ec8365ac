"""Progress over streams: parsed lines, and segments as a keyed state machine."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from frameloom.functions import scalars as X
from frameloom.sources.scratch import scratch_path


def best_progress(lines: DataFrame, total: float) -> DataFrame:
    """lines (user_id, line): the highest percentage and the number of parsed lines of each user; batch or stream."""
    parsed = lines.withColumn("s", X.progress_seconds(F.col("line"))).where("s is not null")
    return parsed.groupBy("user_id").agg(F.max(X.percent(F.col("s"), F.lit(total))).alias("percent"), F.count("*").alias("lines"))


def parsed_progress(spark: SparkSession, events: str) -> DataFrame:
    """Read the events as a file stream, write progress lines of them, and keep each user's best."""
    schema = spark.read.parquet(events).schema
    folder, _, name = events.rpartition("/")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{name}*")
    n = F.col("event_id")
    line = F.when(n % 5 == 0, "frame= 10 q=2").otherwise(F.format_string("frame= 1 time=00:%02d:%02d.50 x", n % 30, n % 59))
    folder = scratch_path(spark, "progress")

    def keep(best: DataFrame, batch: int) -> None:
        best.write.mode("overwrite").parquet(f"{folder}/best-{batch}")

    best = best_progress(stream.select("user_id", line.alias("line")), 1800.0)
    query = best.writeStream.foreachBatch(keep).outputMode("complete").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    if query.lastProgress is None:
        return spark.createDataFrame([], best.schema)
    return spark.read.schema(best.schema).parquet(f"{folder}/best-{query.lastProgress['batchId']}")


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    opened = state.get[0] if state.exists else None
    rows = pd.concat(list(batches)).sort_values(["ts", "position"])
    out = []
    for command, at in zip(rows["command"], rows["position"], strict=True):
        if command == "start":
            opened = int(at)
        elif command == "cancel":
            opened = None
        elif opened is not None and at > opened:
            out.append((key[0], opened, int(at)))
            opened = None
    if opened is None:
        if state.exists:
            state.remove()
    else:
        state.update((opened,))
    yield pd.DataFrame(out, columns=["user_id", "begin", "finish"])


def stream_segments(commands: DataFrame) -> DataFrame:
    """commands (user_id, ts, position, command) as a stream: closed segments; an open one is the key's state."""
    return commands.groupBy("user_id").applyInPandasWithState(_step, "user_id long, begin long, finish long", "opened long", "append", GroupStateTimeout.NoTimeout)
