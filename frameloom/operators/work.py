"""Work lists that can be stopped and taken up again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.sources.scratch import written


class WorkList:
    """Items that a function of a DataFrame works off in slices; finished slices stay, whatever happens to the rest.

    ``folder`` keeps a list's results. A slice is one job, written whole or not at all into a folder of its own, so an
    item is done once. ``cancel`` may be called from any thread: jobs that run under the list's tag are interrupted, and no
    further slice begins; ``run`` on the same folder does what is left.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str, work: Callable[[DataFrame], DataFrame], slices: int = 8) -> None:
        self.spark, self.folder, self.key, self.work, self.slices = spark, folder.rstrip("/"), key, work, slices
        self.tag = f"work-{self.folder.rpartition('/')[2]}"
        self.stopped = False

    def cancel(self) -> None:
        self.stopped = True
        self.spark.interruptTag(self.tag)

    def finished(self) -> list[int]:
        """Slices that are written whole."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        parts = [f.getPath() for f in fs.listStatus(path) if f.getPath().getName().startswith("slice=")]
        return sorted(int(p.getName().partition("=")[2]) for p in parts if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def run(self, items: DataFrame, most: int | None = None) -> bool:
        """Work off what isn't finished, ``most`` slices of it if given; false if the list was cancelled or slices are left.

        The list of items must be the same in every run: their slice is a hash of the key.
        """
        self.stopped = False
        mine = F.pmod(F.xxhash64(self.key), F.lit(self.slices))
        left = [i for i in range(self.slices) if i not in self.finished()]
        for i in left[:most]:
            if self.stopped:
                return False
            self.spark.addTag(self.tag)
            try:
                self.work(items.where(mine == i)).write.mode("overwrite").parquet(f"{self.folder}/slice={i}")
            except Exception:
                if self.stopped:  # the job was interrupted
                    return False
                raise
            finally:
                self.spark.removeTag(self.tag)
        return len(left[:most]) == len(left)

    def results(self, schema: str) -> DataFrame:
        """Results of the finished slices, with the slice."""
        done = self.finished()
        if not done:
            return self.spark.createDataFrame([], f"{schema}, slice int")
        return self.spark.read.schema(f"{schema}, slice int").option("basePath", self.folder).parquet(*[f"{self.folder}/slice={i}" for i in done])


def left_over(items: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Items without a result."""
    return written(items.join(results.select(key), key, "left_anti"), "left-over")
