"""The list of ignored pairs, whole."""

from pyspark.sql import functions as F

from frameloom.operators import similarity
from frameloom.plans import media

FOLDER = "/root/testdata/sf0.01"


def test_all_pairs_of_the_rule_are_listed(spark):
    ids = range(100)
    ignored = {(a, b) for a in ids for b in ids if a < b and (a + b) % 7 == 0}
    got = [tuple(sorted((r.a, r.b))) for r in media.all_ignored(spark, FOLDER).collect()]
    assert len(got) == len(ignored) and set(got) == ignored
    united = {(r.a, r.b) for r in media.pair_set_union(spark, FOLDER).collect()}
    assert united == ignored | {(a, a + 1) for a in ids}


def test_no_ignored_pair_is_shown(spark):
    found = media.near_dup_video_pairs(spark, FOLDER).collect()
    assert len(found) == 61 and all((r.a + r.b) % 7 for r in found)


def test_pairs_of_ids_are_dealt(spark, monkeypatch):
    """All pairs once, whatever the ids, and no task makes more than those of some blocks."""
    monkeypatch.setattr(similarity, "BLOCK", 10)
    ids = [i * i - 50 for i in range(101)]
    known = spark.createDataFrame([(i,) for i in [*ids, *ids[:9], None]], "video_id long")
    got = similarity.id_pairs(known).withColumn("task", F.spark_partition_id()).collect()
    pairs = [(r.a, r.b) for r in got]
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(a, b) for a in ids for b in ids if a < b}
    made = {t: sum(r.task == t for r in got) for t in {r.task for r in got}}
    assert len(made) > 10 and max(made.values()) < len(pairs) / 5
    assert similarity.id_pairs(known.where("video_id is null")).count() == 0


def test_all_pairs_compute_no_hash(spark):
    plan = media.all_pairs_theta_join(spark, FOLDER)._jdf.queryExecution().toString()
    assert "embedding" not in plan and media.all_pairs_theta_join(spark, FOLDER).count() == 4950
