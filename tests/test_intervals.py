import random

from pyspark.sql import functions as F

from frameloom.operators import intervals as I
from frameloom.plans import registry

FAR = 2**63 - 1


def test_points_are_copied_to_few_widths(spark):
    """Widths that intervals of all lengths need: a point is copied, and shuffled, once for each."""
    lengths = spark.createDataFrame([(2**k + j,) for k in range(62) for j in (-1, 0, 1)], "n long")
    found = {r[0] for r in lengths.select(I._level(F.lit(0), F.col("n"))).collect()}
    assert len(found) <= 22
    assert max(found) <= 63


def test_covering_equals_all_pairs(spark):
    """Short, long, nested, empty and backward intervals, below zero too, and one as long as longs allow."""
    rng = random.Random(5)
    drawn = [(k % 3, b, b + rng.choice([0, 1, 2, 7, 8, 9, 63, 64, 900, -3])) for k, b in ((k, rng.randint(-500, 500)) for k in range(200))] + [(1, -FAR, FAR), (2, None, 4)]
    points = [(k, p) for k in range(3) for p in [*rng.sample(range(-600, 1500), 60), FAR, -FAR]] + [(None, 1), (0, None)]
    got = I.covering(spark.createDataFrame(points, "k int, at long"), spark.createDataFrame(drawn, "k int, b long, f long"), "k", "at", "b", "f")
    want = sorted((k, p, b, f) for k, p in points for of, b, f in drawn if k == of and None not in (p, b) and b <= p <= f)
    assert sorted(map(tuple, got.collect())) == want


def test_points_in_segments_equal_sql(same_as_sql):
    for name in ("point_in_segment", "point_in_overlapping_segments"):
        same_as_sql(registry.QUERIES[name], registry.ORACLES[name])
