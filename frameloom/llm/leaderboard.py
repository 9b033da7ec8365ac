"""Change feed of per-group leaderboards by a revenue-band ladder kept as streaming state.

``feed`` takes scored lines (group, item, day of arrival, event day, cents) in batches,
puts one after the other into the folder that a Structured Streaming query reads, and
starts that query anew for each batch on one checkpoint.

1. Tasks sum the cents of equal (group, item, arrival day) before the shuffle, so a hot
   item costs one row a task and day.
2. A start drops the lines that lie more than ``late_days`` behind the largest event day
   of all earlier batches, ignored lines included. That day comes of the batches as they
   were written, so it is the same whenever a start is repeated; a watermark of the
   stream would drop late lines one micro-batch after it rose, and take an empty one.
3. State is kept by (group, part); part is a hash of the item, and there are so many
   parts that one holds about ``ITEMS_PER_KEY`` items, whatever a group's share of the
   rows. A key's MapState is its ladder: band (number of binary digits of the revenue, 0
   if it isn't positive) to the band's items and, beside them, their revenues. After
   every arrival day the highest occupied bands are scanned until ten items are
   collected; a part's board is written where it changed, with the items that left it.
4. A group's board is the ten highest of its parts' boards. Boards of parts hold until
   their next row; a window with a limit in every task before the shuffle merges them by
   (group, day). No task gets all rows of a group, nothing but the list of arrival days
   (a calendar, not the rows) goes to the driver, and nothing is broadcast by hint.

Defined results: null event days can't occur in ``cut``, which deals them by a hash; null
prices and amounts count as 0, and so do values that aren't finite; repeated lines count
each; repeated ids among vendors or items count once, by their smallest non-null value;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import logging
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from frameloom.llm.common import materialize, scratch_path

#: Fixed values of the cut: first day (2024-01-01 in days since 1970), its days, batches, days that lines without a date are dealt to, days of delay.
FIRST_DAY, DAYS, BATCHES, UNDATED, DELAY, LONG_DELAY, LONG_EVERY = 19_723, 180, 10, 150, 7, 20, 5
LATE_DAYS, TOP = 3, 10
#: Times that a start which fails is made, from its checkpoint, before its error counts.
ATTEMPTS = 3
ITEMS_PER_KEY = 4096
#: Sums that a task holds before it passes them on.
HELD = 200_000
LINES = "group_id int, item_id long, arrival_day long, event_day long, cents long"
SUMS = "group_id int, item_id long, arrival_day long, cents long"
BOARDS = "group_id int, part int, arrival_day long, item_id long, revenue long, shown boolean"
FEED = "group_id int, arrival_day long, item_id long, batch int, change string, old_rank int, new_rank int, revenue long"
CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # stores are many and small
    "spark.sql.streaming.minBatchesToRetain": "2",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",  # else every start leaves its stores open in the executors, until a maintenance task passes
}


def cents(value: F.Column) -> F.Column:
    """Hundredths of a double, rounded half up; 0 for what isn't finite, null for null."""
    whole = F.floor(100 * value + 0.5)
    return F.when(F.abs(value) < 9e16, whole).when(value.isNotNull(), F.lit(0).cast("long"))


def cut(lines: DataFrame, vendors: DataFrame, items: DataFrame) -> DataFrame:
    """sale_lines as scored lines with their batch: group_id (the vendor's nation) and item_id are null where a line is ignored."""
    # Written, so that both sides of the joins are plain shuffles, whose hot keys adaptive execution splits.
    places = materialize(vendors.groupBy("vendor_id").agg(F.min("nation_id").cast("int").alias("nation_id")), "places").hint("shuffle_hash")
    prices = materialize(items.where("item_id is not null").groupBy("item_id").agg(F.min("price").alias("price"), F.lit(True).alias("known")), "prices").hint("shuffle_hash")
    text = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("sale_id", "item_id", "vendor_id", "line_no")])
    own = lines.select("item_id", "vendor_id", "quantity", "amount", "flag", F.unix_date(F.col("shipped_at").cast("date")).cast("long").alias("shipped"), F.crc32(text).alias("h"))
    s = F.coalesce("shipped", FIRST_DAY + F.col("h") % UNDATED)
    a = F.col("event_day") + F.col("h") % DELAY + F.when(F.col("h") % LONG_EVERY == 0, LONG_DELAY).otherwise(0)
    dated = own.withColumn("event_day", s).withColumn("arrival_day", a)
    joined = dated.join(places, "vendor_id", "left").join(prices, "item_id", "left")
    worth = F.coalesce(cents(F.col("amount")), F.col("quantity").cast("long") * cents(F.col("price")), F.lit(0).cast("long"))
    counts = F.col("known") & F.col("nation_id").isNotNull()
    return joined.select(
        F.when(counts, F.col("nation_id")).alias("group_id"), F.when(counts, F.col("item_id")).alias("item_id"), "arrival_day", "event_day",
        F.when(F.col("flag") == "swapped", -worth).otherwise(worth).alias("cents"), batch_of(F.col("arrival_day")).alias("batch"),
    )


def batch_of(day: F.Column) -> F.Column:
    return F.least(F.lit(BATCHES), 1 + F.floor((day - FIRST_DAY) * BATCHES / DAYS)).cast("int")


def _summed(batches):
    """Sums of equal lines, as far as a task holds them."""
    keys = ["group_id", "item_id", "arrival_day"]

    def sums(parts: list) -> pa.Table:
        return pa.Table.from_batches(parts).select([*keys, "cents"]).group_by(keys).aggregate([("cents", "sum")]).rename_columns([*keys, "cents"])

    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= HELD:
            held = sums(held).to_batches()
            rows = sum(b.num_rows for b in held)
            if rows >= HELD // 2:  # little is equal here
                yield from held
                held, rows = [], 0
    if held:
        yield from sums(held).to_batches(max_chunksize=10_000)


class Ladder(StatefulProcessor):
    """Of one part of a group: bands of revenue, and the part's board after each day that changes it."""

    def __init__(self, top: int = TOP) -> None:
        self.top = top

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bands = handle.getMapState("bands", "band int", "items binary, revenues binary")

    def close(self) -> None:
        pass

    def _board(self, ladder: dict[int, dict[int, int]]) -> list[tuple[int, int]]:
        """(-revenue, item) of the highest: whole bands from the top until there are enough."""
        found: list[tuple[int, int]] = []
        for band in sorted((b for b in ladder if b > 0 and ladder[b]), reverse=True):
            found += [(-revenue, item) for item, revenue in ladder[band].items()]
            if len(found) >= self.top:
                break
        return heapq.nsmallest(self.top, found)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))[["arrival_day", "item_id", "cents"]]
        if not len(new):
            return
        ladder: dict[int, dict[int, int]] = {}
        for (band,), (items, revenues) in self.bands.iterator():
            ladder[band] = dict(zip(np.frombuffer(items, np.int64).tolist(), np.frombuffer(revenues, np.int64).tolist(), strict=True))
        place = {item: band for band, of in ladder.items() for item in of}
        before, touched, out = self._board(ladder), set(), []
        sums = new.groupby(["arrival_day", "item_id"], sort=True)["cents"].sum()
        days, ids, values = sums.index.get_level_values(0).to_numpy(), sums.index.get_level_values(1).to_numpy(), sums.to_numpy()
        edges = np.flatnonzero(np.diff(days, prepend=days[0] - 1, append=days[-1] + 1))
        for start, stop in zip(edges[:-1], edges[1:], strict=True):
            shown = {item for _, item in before}
            worst = -before[-1][0] if len(before) == self.top else 0
            scan = False
            for item, add in zip(ids[start:stop].tolist(), values[start:stop].tolist(), strict=True):
                old = place.get(item)
                revenue = add if old is None else ladder[old].pop(item) + add
                band = max(0, revenue).bit_length()
                ladder.setdefault(band, {})[item] = revenue
                place[item] = band
                touched.update((band,) if old is None else (band, old))
                scan = scan or item in shown or (revenue >= worst and revenue > 0)
            if scan:
                after = self._board(ladder)
                if after != before:
                    day, now = int(days[start]), {item for _, item in after}
                    out += [(*key, day, item, -revenue, True) for revenue, item in after]
                    out += [(*key, day, item, ladder[place[item]][item], False) for item in shown - now]
                before = after
        for band in touched:
            of = ladder[band]
            if of:
                self.bands.updateValue((band,), (np.fromiter(of.keys(), np.int64, len(of)).tobytes(), np.fromiter(of.values(), np.int64, len(of)).tobytes()))
            elif self.bands.containsKey((band,)):
                self.bands.removeKey((band,))
        if out:
            yield pd.DataFrame(out, columns=["group_id", "part", "arrival_day", "item_id", "revenue", "shown"])


@contextmanager
def _stateful(spark: SparkSession):
    before = {k: spark.conf.get(k, None) for k in CONF}
    try:
        for k, v in CONF.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _move(spark: SparkSession, source: str, target: str) -> None:
    """Rename a folder of the shared file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(source).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path(target).getParent())
    if not fs.rename(path(source), path(target)):
        raise OSError(f"{source} can't be moved")


def _run(boards: DataFrame, home: str) -> None:
    """Take all new files. What a failed start left is its checkpoint's to settle: state and boards of a batch count once it is committed, so it is done again as it was."""
    for attempt in range(1, ATTEMPTS + 1):
        try:
            boards.writeStream.format("parquet").option("checkpointLocation", f"{home}/state").outputMode("append").trigger(availableNow=True).start(f"{home}/boards").awaitTermination()
            return
        except StreamingQueryException as failed:
            if attempt == ATTEMPTS:
                raise
            logging.getLogger(__name__).warning("start %d of a batch failed and is repeated: %s", attempt, failed)


def part_boards(spark: SparkSession, lines: DataFrame, parts: int, late_days: int = LATE_DAYS, top: int = TOP) -> tuple[DataFrame, list[int]]:
    """Boards of parts (``BOARDS``) after each day that changed them, and all arrival days, of lines (``LINES``, batch)."""
    home = scratch_path(spark, "ladder")
    lines.select(*[c.split()[0] for c in LINES.split(", ")], "batch").write.partitionBy("batch").parquet(f"{home}/cut")
    found = spark.read.schema(f"{LINES}, batch int").parquet(f"{home}/cut").groupBy("batch").agg(F.max("event_day").alias("latest"), F.collect_set("arrival_day").alias("days"))
    calendar = sorted(found.collect(), key=lambda r: r["batch"])  # a row a batch
    stream = spark.readStream.schema(LINES).parquet(f"{home}/feed/*")
    seen = None
    with _stateful(spark):
        for r in calendar:
            _move(spark, f"{home}/cut/batch={r['batch']}", f"{home}/feed/{r['batch']}")
            counted = stream.where("item_id is not null" if seen is None else f"item_id is not null and event_day + {late_days} >= {seen}")
            placed = counted.mapInArrow(_summed, SUMS).withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(parts)).cast("int"))
            boards = placed.groupBy("group_id", "part").transformWithStateInPandas(Ladder(top), BOARDS, "Append", "None")
            _run(boards, home)
            seen = max(r["latest"], r["latest"] if seen is None else seen)
    if not calendar:
        return spark.createDataFrame([], BOARDS), []
    return spark.read.schema(BOARDS).parquet(f"{home}/boards"), sorted({d for r in calendar for d in r["days"]})


def merged(boards: DataFrame, days: list[int], top: int = TOP) -> DataFrame:
    """Rank changes (``FEED``) of groups, of the boards of their parts."""
    spark = boards.sparkSession
    item = F.struct("item_id", "revenue", "shown")
    states = boards.groupBy("group_id", "part", "arrival_day").agg(F.collect_list(item).alias("rows"))
    until = F.lead("arrival_day").over(Window.partitionBy("group_id", "part").orderBy("arrival_day"))
    states = materialize(states.withColumn("until", until), "boards")
    calendar = F.array(*[F.lit(d) for d in days]).cast("array<long>")
    held = F.filter(calendar, lambda d: (d >= F.col("arrival_day")) & (F.col("until").isNull() | (d < F.col("until"))))
    each = states.withColumn("shown", F.filter("rows", lambda r: r["shown"])).where("size(shown) > 0").select("group_id", F.explode(held).alias("day"), "shown").select("group_id", "day", F.inline("shown"))
    rank = F.row_number().over(Window.partitionBy("group_id", "day").orderBy(F.desc("revenue"), "item_id"))
    ranked = each.select("group_id", "day", "item_id", "revenue", rank.alias("rank")).where(F.col("rank") <= top)
    numbers = spark.createDataFrame(list(enumerate(days)), "no long, day long")
    board = ranked.join(numbers, "day")
    along = Window.partitionBy("group_id", "item_id").orderBy("no")
    board = board.withColumns({"last_no": F.lag("no").over(along), "last_rank": F.lag("rank").over(along), "next_no": F.lead("no").over(along)})
    board = materialize(board, "board")
    old = F.when(F.col("last_no") == F.col("no") - 1, F.col("last_rank"))
    stays = board.select("group_id", "day", "item_id", old.alias("old_rank"), F.col("rank").alias("new_rank"), "revenue").where("old_rank is null or old_rank <> new_rank")
    left = board.where(f"no < {len(days) - 1} and (next_no is null or next_no > no + 1)").select("group_id", (F.col("no") + 1).alias("no"), "item_id", F.col("rank").alias("old_rank")).join(numbers, "no")
    spans = states.select("group_id", "arrival_day", "until", F.inline("rows")).select("group_id", "item_id", "arrival_day", "until", "revenue")
    gone = left.join(spans, ["group_id", "item_id"]).where("day >= arrival_day and (until is null or day < until)").select("group_id", "day", "item_id", "old_rank", F.lit(None).cast("int").alias("new_rank"), "revenue")
    change = F.when(F.col("old_rank").isNull(), "enter").when(F.col("new_rank").isNull(), "exit").otherwise("move")
    return stays.unionByName(gone).select("group_id", F.col("day").alias("arrival_day"), "item_id", batch_of(F.col("day")).alias("batch"), change.alias("change"), "old_rank", "new_rank", "revenue")


def change_feed(spark: SparkSession, lines: DataFrame, vendors: DataFrame, items: DataFrame, items_per_key: int = ITEMS_PER_KEY) -> DataFrame:
    """group_id, arrival_day, item_id, batch, change, old_rank, new_rank, revenue of the sale lines' leaderboards by nation."""
    parts = max(1, -(-items.count() // items_per_key))
    boards, days = part_boards(spark, cut(lines, vendors, items), parts)
    return merged(boards, days) if days else spark.createDataFrame([], FEED)
