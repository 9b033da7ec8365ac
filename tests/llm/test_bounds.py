"""What goes to the driver or to all tasks is bounded, whatever the rows hold."""

import random

import pytest
from pyspark.sql import functions as F

from frameloom.llm import common, decontaminate, license_scan, pivot_search, quality_rules
from tests.llm.test_llm import prose


def test_learned_rows_are_bounded_after_the_join(spark, monkeypatch):
    """Two ids of many rows each: no more rows than the sample reach the driver."""
    docs = spark.range(400).select((F.col("id") % 2 + 2).alias("doc_id"), F.concat(F.lit("some words "), F.col("id").cast("string")).alias("text"))
    labels = spark.createDataFrame([(2, 0), (3, 1)], "doc_id long, quality int")
    taken = []
    monkeypatch.setattr(quality_rules, "held_out", lambda c: F.lit(False))
    monkeypatch.setattr(quality_rules, "fit_rules", lambda x, y: taken.append((x.shape[0], sorted(set(y)))))
    quality_rules.train(docs, labels, sample_rows=150)
    quality_rules.train(docs, labels, sample_rows=10_000)
    assert taken == [(150, [0.0, 1.0]), (400, [0.0, 1.0])] or (taken[0][0], taken[1][0]) == (150, 400)


def test_broadcasts_are_measured_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_BYTES", 10_000)
    short = spark.createDataFrame([(i, "w") for i in range(20)], "k long, text string")
    long = spark.createDataFrame([(i, "w" * 5000) for i in range(20)], "k long, text string")
    assert common.measured(short) == 20 * (64 + 1)
    assert common.measured(long) == 20 * (64 + 5000)
    rows = spark.range(100).withColumnRenamed("id", "k")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans = [rows.join(common.small_side(x), "k")._jdf.queryExecution().executedPlan().toString() for x in (short, long)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plans[0]
    assert "BroadcastHashJoin" not in plans[1]
    with pytest.raises(TypeError):
        common.measured(rows.select(F.array("k").alias("a")))


def test_items_of_long_words_are_not_broadcast(spark, monkeypatch):
    """Ten words of a megabyte in all exceed the bound; the result is the same."""
    items = spark.createDataFrame([("i", " ".join(chr(97 + k) * 3000 for k in range(12)))], "item_id string, text string")
    docs = spark.createDataFrame([(1, "x " + " ".join(chr(97 + k) * 3000 for k in range(10))), (2, "clean text")], "doc_id long, text string")
    want = sorted(map(tuple, decontaminate.report(docs, items).collect()))
    monkeypatch.setattr(common, "BROADCAST_BYTES", 20_000)
    assert sorted(map(tuple, decontaminate.report(docs, items).collect())) == want
    assert [r[2] for r in want] == [10, 0]


def test_empty_vectors_take_part(spark):
    rows = [(0, [1.0, 0.0]), (1, [-1.0, 0.0]), (2, []), (3, None), (4, [float("nan"), 1.0])]
    got = pivot_search.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") == 0)
    assert [tuple(r) for r in got.orderBy("rank").collect()] == [(0, 1, 2, 0), (0, 2, 1, -1024 * 1024)]
    alone = spark.createDataFrame([(0, []), (1, [])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in pivot_search.search(alone, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 0)]


def test_tasks_start_from_the_samples_scores(spark):
    """Tasks return no more than what may be among the best of all."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        vectors = spark.range(4000).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: (F.xxhash64(i, "id") % 1000 / 1000.0).cast("float")).alias("embedding")).repartition(20)
        found = pivot_search.answers(vectors, F.col("vec_id") % 100 == 0)
        tasks = found.select("seen").count()
        assert tasks < 40 * 10 * 3
        got = pivot_search.search(vectors, F.col("vec_id") % 100 == 0)
        assert got.count() == 400
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_hurt_notices_are_found_when_enough_is_left(spark):
    """Every template with words put in, left out and changed, among other words, as a plain count of shingles says."""
    rng, rows, want = random.Random(9), [], set()
    grams = {k: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for k, w in ((k, license_scan.template_words(t)) for k, t in license_scan.TEMPLATES.items())}
    for text in license_scan.TEMPLATES.values():
        for edits in range(6):
            w = license_scan.template_words(text)
            for _ in range(edits):
                at = rng.randrange(len(w))
                w[at : at + rng.choice([0, 1, 1])] = rng.choice([[], ["xx"]])
            rows.append((len(rows), " ".join([prose(rng, 20), *w, prose(rng, 20)])))
            own = license_scan.template_words(rows[-1][1])
            have = {tuple(own[i : i + 5]) for i in range(len(own) - 4)}
            want |= {(rows[-1][0], k, len(g & have), len(g)) for k, g in grams.items() if 100 * len(g & have) >= 80 * len(g)}
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {tuple(r) for r in got} == want
    assert len(got) == len(want) > 60


def test_templates_are_not_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "some text of five words")], "doc_id long, text string")
    shingles, banded, windows = license_scan.template_tables(spark, license_scan.TEMPLATES, license_scan.BANDS)
    plan = license_scan.retrieved(docs, common.materialize(shingles, "s"), common.materialize(banded, "b"), windows)._jdf.queryExecution().optimizedPlan().toString()
    assert " IN (" not in plan and "INSET" not in plan
    assert windows == [1, 2, 8] or max(windows) == 8
