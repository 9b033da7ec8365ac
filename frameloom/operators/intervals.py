"""Points and the closed intervals that hold them, by a dyadic index.

An interval of length n goes into the one or two cells of width 2**k that it touches, k being
the smallest multiple of ``STEP`` with n < 2**k. A point lies in one cell of every width. So
interval and point meet on (key, width, cell) by equality: each interval is copied twice at
most, each point as often as there are widths, 22 at most, and long intervals that nest or
overlap cost no more than short ones. Points are what is shuffled most; with a larger step
they are copied less, but meet more intervals that don't hold them, in the task only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Widths are powers of two whose exponents are multiples of this, up to 63.
STEP = 3


def _level(begin: Column, finish: Column) -> Column:
    """Number of binary digits of the length, up to the next width."""
    digits = F.coalesce(F.length(F.bin(F.try_subtract(finish, begin))), F.lit(64))  # null: longer than a long can say
    return F.when(finish > begin, F.least(F.ceil(digits / STEP) * STEP, F.lit(63)).cast("int")).otherwise(0)


def covering(points: DataFrame, intervals: DataFrame, key: str, at: str, begin: str, finish: str) -> DataFrame:
    """Every pair of a point (key, ``at``, a long) and an interval (``begin`` to ``finish``, longs, both included) of its key.

    Columns are those of points and intervals, whose names must differ but for the key. Intervals that end before they begin, and null
    bounds, hold nothing; null keys meet nothing; repeated rows count each.
    """
    low, high = F.col(begin).cast("long"), F.col(finish).cast("long")
    sound = intervals.where(low <= high).withColumn("_level", _level(low, high))
    cells = F.expr(f"array_distinct(array(shiftright(cast(`{begin}` as bigint), _level), shiftright(cast(`{finish}` as bigint), _level)))")
    indexed = sound.withColumn("_cell", F.explode(cells)).withColumnRenamed(key, "_of")
    levels = sorted(r[0] for r in sound.select("_level").distinct().collect())  # 22 at most
    probes = F.explode(F.array(*[F.struct(F.lit(k).alias("_l"), F.shiftright(F.col(at).cast("long"), k).alias("_c")) for k in levels]) if levels else F.array().cast("array<struct<_l:int,_c:bigint>>"))
    asked = points.withColumn("_probe", probes)
    met = asked.join(indexed, (F.col(key) == F.col("_of")) & (F.col("_probe._l") == F.col("_level")) & (F.col("_probe._c") == F.col("_cell")))
    held = met.where(F.col(at).cast("long").between(low, high))
    return held.drop("_probe", "_level", "_cell", "_of")


def first_covering(points: DataFrame, intervals: DataFrame, key: str, at: str, begin: str, finish: str, place: str) -> DataFrame:
    """Distinct points that an interval holds, with the columns of the first such interval in order of ``place``."""
    asked = points.select(key, at).distinct()
    held = covering(asked, intervals, key, at, begin, finish)
    columns = [c for c in intervals.columns if c != key]
    first = held.groupBy(key, at).agg(F.min_by(F.struct(*columns), F.struct(place, begin, finish)).alias("_first"))
    return first.select(key, at, "_first.*")
