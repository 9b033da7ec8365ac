"""What plans say about themselves while they run, as tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

SCHEMA = "name string, n_rows long, errors long, error_rate double"


def counted(failed: Column) -> list[Column]:
    """The metrics of a step: rows, and rows that ``failed`` holds for."""
    return [F.count(F.lit(1)).alias("n_rows"), F.count_if(failed).alias("errors")]


def observed(steps: list[tuple[str, DataFrame, Column]], act: Callable[[str, DataFrame], None]) -> DataFrame:
    """Run ``act`` (which writes, once) on each step's rows; gives name, n_rows, errors, error_rate (null without rows) of each.

    The counts are taken as the rows go by, not by a job of their own. steps: name, rows, and which rows are errors.
    """
    out, spark = [], None
    for name, rows, failed in steps:
        spark = rows.sparkSession
        seen = Observation(name)
        act(name, rows.observe(seen, *counted(failed)))
        found = seen.get
        n, errors = found["n_rows"], found["errors"]
        out.append((name, n, errors, errors / n if n else None))
    return (spark or SparkSession.active()).createDataFrame(out, SCHEMA)


class Progress(StreamingQueryListener):
    """Collects batch, input rows, rows a second and the observed counts of every micro-batch of streaming queries that observe ``name``."""

    def __init__(self, name: str) -> None:
        self.name, self.rows = name, []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        found = event.progress.observedMetrics.get(self.name)
        if found is not None:
            self.rows.append((event.progress.batchId, event.progress.numInputRows, event.progress.processedRowsPerSecond, found["n_rows"], found["errors"]))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def observed_stream(rows: DataFrame, name: str, failed: Column, start: Callable[[DataFrame], object]) -> DataFrame:
    """Run a streaming query that ends by itself (``start`` gives it, begun): batch, input_rows, rows_per_second, n_rows, errors of its micro-batches."""
    spark, listener = rows.sparkSession, Progress(name)
    spark.streams.addListener(listener)
    try:
        start(rows.observe(name, *counted(failed))).awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(listener)
    return spark.createDataFrame(listener.rows, "batch long, input_rows long, rows_per_second double, n_rows long, errors long")
