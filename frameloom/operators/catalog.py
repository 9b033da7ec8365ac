"""Work lists: order-preserving distinct, cached and uncached entries, names without conflicts, segments and progress."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Values of the order column that are numbered in one task.
SPAN = 65_536


def first_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of every key; keys meet by a 128-bit digest, so that long ones are not shuffled for comparison."""
    digest = F.md5(F.col(key).cast("string"))
    return rows.groupBy(digest.alias("_key")).agg(F.min_by(F.struct(*rows.columns), order).alias("r")).select("r.*")


def cached(work: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    return work.join(cache.select(key), key, "left_semi")


def uncached(work: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    return work.join(cache.select(key), key, "left_anti")


def numbered(rows: DataFrame, key: list[str], order: str, span: int = SPAN) -> DataFrame:
    """Add ``n``: 1, 2, ... of each key by ``order``, a long.

    Rows are numbered within spans of ``order`` and the spans' counts are summed up, so that a key with many rows is no single task.
    """
    cut = rows.withColumn("_span", F.floor(F.col(order) / span))
    counts = cut.groupBy(*key, "_span").agg(F.count("*").alias("_many"))
    before = F.sum("_many").over(Window.partitionBy(*key).orderBy("_span")) - F.col("_many")
    based = counts.select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(key)], F.col("_span").alias("_s"), before.alias("_before"))
    within = F.row_number().over(Window.partitionBy(*key, "_span").orderBy(order))
    same = [F.col(k).eqNullSafe(F.col(f"_{i}")) for i, k in enumerate(key)]
    joined = cut.withColumn("_row", within).join(based, reduce(and_, [*same, F.col("_span").eqNullSafe(F.col("_s"))]))
    return joined.select(*rows.columns, (F.col("_row") + F.coalesce("_before", F.lit(0))).cast("int").alias("n"))


def with_number(target: Column, ext: Column, k: Column) -> Column:
    """``target.ext``, ``target (1).ext``, ..."""
    return F.concat(target, F.when(k == 0, "").otherwise(F.concat(F.lit(" ("), k.cast("string"), F.lit(")"))), ext)


def _take_names(batches):
    """Rows in order of root and time, taken names first: each request gets its target's smallest free number.

    A target's numbers only rise, so a pointer a target and the names asked for plainly are all that is kept of a root.
    """
    pattern, root, pointer, plain = re.compile(r"(.*) \(([1-9][0-9]*)\)", re.DOTALL), None, {}, set()

    def taken(target: str) -> bool:
        found = pattern.fullmatch(target)
        return target in plain or pointer.get(target, 0) > 0 or (found is not None and pointer.get(found[1], 0) > int(found[2]))

    for batch in batches:
        out = []
        for key, target, time in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
            if key != root:
                root, pointer, plain = key, {}, set()
            if time is None:
                plain.add(target)
                out.append(None)
                continue
            k = pointer.get(target, 0)
            while k == 0 and taken(target) or k and taken(f"{target} ({k})"):
                k += 1
            pointer[target] = k + 1
            out.append(k)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], names=[*batch.schema.names, "_k"])


def unique_names(wanted: DataFrame, order: str, existing: DataFrame | None = None) -> DataFrame:
    """wanted (target, ext, a long ``order``, ...): add name, what one request after the other would get.

    existing (target, ext) are names taken from the start. A request gets the plain name or the smallest free `` (k)``.
    Where no name is taken and no other target looks like a numbered one of the same root, that is the request's number, counted in spans.
    Roots are dealt by a hash of their own: by the root itself, the joins before would seem to have dealt them, and a join that becomes a broadcast at run time undoes that.
    """
    root = F.regexp_replace("target", r"( \([1-9][0-9]*\))+$", "")
    keyed = wanted.withColumn("_root", F.concat(root, F.lit("\n"), "ext"))
    taken = (wanted.limit(0) if existing is None else existing).select("target", "ext").withColumn("_root", F.concat(root, F.lit("\n"), "ext"))
    names = keyed.select("_root", "target").unionByName(taken.select("_root", F.concat("target", F.lit("\n")).alias("target")))
    mixed = names.groupBy("_root").agg(F.min("target").alias("a"), F.max("target").alias("b")).where("a <> b or endswith(a, '\n')").select("_root")
    simple = numbered(keyed.join(mixed, "_root", "left_anti").drop("_root"), ["target", "ext"], order)
    simple = simple.withColumn("name", with_number(F.col("target"), F.col("ext"), F.col("n") - 1)).select(*wanted.columns, "name")
    rest = [F.col(c) for c in wanted.columns if c not in ("target", order)]
    asked = keyed.join(mixed, "_root", "left_semi").select("_root", "target", order, *rest)
    held = taken.join(mixed, "_root", "left_semi").distinct().select("_root", "target", *[(F.col("ext") if f.name == "ext" else F.lit(None)).cast(f.dataType).alias(f.name) for f in asked.schema.fields[2:]])
    rows = asked.unionByName(held).repartition(F.xxhash64("_root")).sortWithinPartitions("_root", F.col(order).asc_nulls_first())
    numbers = rows.mapInArrow(_take_names, T.StructType([*rows.schema.fields, T.StructField("_k", T.LongType())]))
    crowded = numbers.where(F.col("_k").isNotNull()).withColumn("name", with_number(F.col("target"), F.col("ext"), F.col("_k")))
    return simple.unionByName(crowded.select(*wanted.columns, "name"))


def all_like_first(rows: DataFrame, group: list[str], *columns: str, probed: str | None = None) -> DataFrame:
    """Groups with the number of members and whether at least two, all of them probed, agree on all columns; nulls are like nulls only."""
    member = F.struct(*columns)
    found = F.bool_and(F.coalesce(F.col(probed), F.lit(False))) if probed else F.lit(True)
    return rows.groupBy(*group).agg(F.count("*").alias("n"), ((F.count("*") >= 2) & found & F.min(member).eqNullSafe(F.max(member))).alias("compatible"))


STREAM = "codec_name string, width int, height int, r_frame_rate string"


def first_stream(said: Column) -> Column:
    """Struct of the first stream that a probe printed as JSON; null if it failed or found none."""
    return F.get(F.from_json(said, f"struct<streams: array<struct<{STREAM}>>>")["streams"], F.lit(0))


def common_prefix(low: Column, high: Column) -> Column:
    """Longest common prefix of the smallest and the largest name, which is that of all."""
    n = F.least(F.length(low), F.length(high))
    sizes = F.filter(F.sequence(F.lit(0), n), lambda i: F.substr(low, F.lit(1), i) == F.substr(high, F.lit(1), i))
    return F.substr(low, F.lit(1), F.array_max(sizes))


def segments(commands: DataFrame, key: str, order: list[str], position: str) -> DataFrame:
    """commands (key, command start/end/cancel, position): key, begin, finish of closed segments.

    Positions increase, so an end closes a segment exactly if the command before it is a start.
    """
    w = Window.partitionBy(key).orderBy(*order)
    before = commands.withColumns({"_c": F.lag("command").over(w), "_p": F.lag(position).over(w)})
    return before.where((F.col("command") == "end") & (F.col("_c") == "start") & (F.col(position) > F.col("_p"))).select(key, F.col("_p").alias("begin"), F.col(position).alias("finish"))


def stacked(steps: DataFrame, key: str, order: list[str], first: str) -> DataFrame:
    """steps (key, op set/push/pop, state): add the state and the depth after each; below depth 0 nothing is popped, and the state is ``first`` before any."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    move = F.when(F.col("op") == "push", 1).when(F.col("op") == "pop", -1).otherwise(0)
    summed = steps.withColumn("_sum", F.sum(move).over(w))
    deep = summed.withColumn("depth", F.col("_sum") - F.least(F.min("_sum").over(w), F.lit(0)))
    level = Window.partitionBy(key, "depth").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    shown = F.last(F.when(F.col("op") != "pop", F.col("state")), ignorenulls=True).over(level)
    return deep.withColumn("state", F.coalesce(shown, F.lit(first))).drop("_sum")


def running(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Add done (1, 2, ...) and total of each key."""
    w = Window.partitionBy(key)
    return events.withColumns({"done": F.row_number().over(w.orderBy(*order)), "total": F.count("*").over(w)})
