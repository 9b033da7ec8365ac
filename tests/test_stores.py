import pytest
from pyspark.sql import functions as F

from frameloom.sources import stores

VALUE = "struct<a: int, text: string>"


def docs(spark, *rows):
    return spark.createDataFrame(list(rows), "key string, text string")


def read(spark, root, schema=VALUE):
    return sorted(((r.key, r.value and r.value.a, r.origin) for r in stores.load(spark, root, schema).collect()), key=repr)


def test_versions_and_backup(spark, tmp_path):
    root = str(tmp_path / "s")
    assert read(spark, root) == [] and stores.versions(spark, root) == []
    assert stores.save_texts(docs(spark, ("x", '{"a": 1}'), ("y", '{"a": 2}'), ("z", "{no"), (None, '{"a": 9}')), root) == 1
    assert read(spark, root) == sorted([("x", 1, "current"), ("y", 2, "current"), ("z", None, "broken"), (None, 9, "current")], key=repr)
    stores.save_texts(docs(spark, ("x", '{"a": 5}'), ("y", '{"a": '), ("z", None), (None, "")), root)
    assert read(spark, root) == sorted([("x", 5, "current"), ("y", 2, "backup"), ("z", None, "broken"), (None, 9, "backup")], key=repr)
    stores.save_texts(docs(spark, ("x", '{"a": 6}')), root)
    assert stores.versions(spark, root) == [2, 3]
    assert read(spark, root) == [("x", 6, "current")]  # keys that were left out are gone
    assert stores.restore(spark, root) == 4
    assert ("x", 5, "current") in read(spark, root)


def test_cut_off_save(spark, tmp_path):
    """A save that was not committed isn't read, and the next one takes its place."""
    root = str(tmp_path / "s")
    stores.save_texts(docs(spark, ("x", '{"a": 1}')), root)
    failing = docs(spark, ("x", '{"a": 2}')).withColumn("text", F.when(F.col("key") == "x", F.raise_error(F.lit("lost"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="lost"):
        stores.save_texts(failing, root)
    assert stores.versions(spark, root) == [1] and read(spark, root) == [("x", 1, "current")]
    stores.save_texts(docs(spark, ("x", '{"a": 3}')), root)
    assert stores.versions(spark, root) == [1, 2] and read(spark, root) == [("x", 3, "current")]


def test_taken_over_and_repeated_keys(spark, tmp_path):
    root = str(tmp_path / "s")
    stores.save_texts(docs(spark, ("x", '{"a": 1}'), ("y", '{"a": 2}'), (None, '{"a": 3}')), root)
    stores.save_texts(docs(spark, ("y", '{"a": 7}'), ("y", '{"a": 8}'), (None, '{"a": 4}')), root, replace=False)
    assert read(spark, root) == sorted([("x", 1, "current"), ("y", 8, "current"), (None, 4, "current")], key=repr)
    with pytest.raises(ValueError, match="go back"):
        stores.restore(spark, str(tmp_path / "none"))


def test_clashing_columns_and_empty(spark, tmp_path):
    root = str(tmp_path / "s")
    rows = spark.createDataFrame([(1, "é" * 70000, 5), (2, None, None)], "id int, text string, a int")
    stores.save(rows, root, "id")
    got = {r.key: r.value for r in stores.load(spark, root, VALUE).collect()}
    assert got["1"].text == "é" * 70000 and got["1"].a == 5 and got["2"].a is None
    stores.save(rows.limit(0), root, "id")
    assert read(spark, root) == []


def test_all_or_none(spark, tmp_path):
    root = str(tmp_path / "s")
    stores.save_texts(docs(spark, ("good", '[{"n": 1, "s": 2.5}, {"n": "3", "s": 1}]'), ("bad", '[{"n": 1, "s": 1}, {"n": "many", "s": 1}]'), ("lacks", '[{"n": 1}]'), ("none", "[]")), root)
    typed = stores.all_typed(F.col("value"), {"n": "long", "s": "double"})
    got = {r.key: r.v for r in stores.load(spark, root, "array<struct<n: string, s: string>>").select("key", typed.alias("v")).collect()}
    assert [tuple(r) for r in got["good"]] == [(1, 2.5), (3, 1.0)]
    assert got["bad"] is None and got["lacks"] is None and got["none"] == []
