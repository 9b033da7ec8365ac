"""State stacks of keys as a stream: list state, and a timer that lets idle keys go."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from frameloom.sources.scratch import scratch_path

OUT = "key long, position long, state string, depth long"
#: Only this store holds list state and timers; files are not preallocated, as stores are many and small.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: A query that ends when its input does must not take empty batches to look for timers: there would always be a next one.
ENDING = {"spark.sql.streaming.noDataMicroBatches.enabled": "false"}


@contextmanager
def stateful(spark: SparkSession, ending: bool = False):
    """Within, streaming queries start on the store that keeps list state and timers; ``ending``: timers then go off with the next rows only."""
    wanted = STORE | (ENDING if ending else {})
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Stack(StatefulProcessor):
    """Of one key: the state that is shown and those below it; a key without rows for ``idle_seconds`` is forgotten, and says so.

    Every call of a state is a message to the JVM, and most keys have few rows in a batch: rows
    come as such, not as frames, and the time the key's timer is set to is kept beside what is shown.
    """

    def __init__(self, first: str, idle_seconds: float) -> None:
        self.first, self.idle = first, int(idle_seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.shown = handle.getValueState("shown", "state string, due long, depth long")
        self.below = handle.getListState("below", "state string")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = sorted(rows, key=lambda r: (r["ts"], r["position"]))
        if not new:
            return
        shown, due, held = self.shown.get() or (self.first, None, 0)
        below = [s for (s,) in self.below.get()] if held else []
        before = list(below)
        for row in new:
            if row["op"] == "push":
                below.append(shown)
                shown = row["state"]
            elif row["op"] == "set":
                shown = row["state"]
            elif below:
                shown = below.pop()
            yield Row(key=key[0], position=row["position"], state=shown, depth=len(below))
        if below and below != before:
            self.below.put([(s,) for s in below])
        elif before and not below:
            self.below.clear()
        if due is not None:
            self.handle.deleteTimer(due)
        due = timerValues.getCurrentProcessingTimeInMs() + self.idle
        self.handle.registerTimer(due)
        self.shown.update((shown, due, len(below)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.shown.clear()
        self.below.clear()
        yield Row(key=key[0], position=None, state="expired", depth=0)


def stream_stacks(steps: DataFrame, first: str, idle_seconds: float = 3600.0) -> DataFrame:
    """steps (key, ts, position, op set/push/pop, state) as a stream: key, position, state and depth after each; (key, null, expired, 0) when a key goes."""
    return steps.groupBy("key").transformWithState(Stack(first, idle_seconds), OUT, "Append", "ProcessingTime")


def stacked_batches(spark: SparkSession, batches: list[DataFrame], first: str, idle_seconds: float = 3600.0) -> DataFrame:
    """What ``stream_stacks`` gives for batches fed one after the other, the query started anew for each on one checkpoint."""
    folder = scratch_path(spark, "stacks")
    with stateful(spark, ending=True):
        for batch in batches:
            batch.write.mode("append").parquet(f"{folder}/in")
            out = stream_stacks(spark.readStream.schema(batch.schema).parquet(f"{folder}/in"), first, idle_seconds)
            out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    return spark.read.schema(OUT).parquet(f"{folder}/out")
