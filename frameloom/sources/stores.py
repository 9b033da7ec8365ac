"""Stores of many JSON documents, one a key: saved as whole versions, read with the version before as backup.

``documents`` keeps one document in one file; a store keeps any number of them, and neither its saving nor its reading
passes the driver. A store is a folder of versions, each a Parquet table of key and text. A version counts once its job is
committed, so readers see the old documents or the new ones; a save that is cut off leaves nothing that is read, and the
next one overwrites it. The last two versions stay. One writer at a time.

Keys are texts; null is a key like any other. Of documents given for one key the greatest text is kept, as rows have no order.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.sources.scratch import written

COLUMNS = "key string, text string"
KEPT = 2


def _folder(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the versions that were saved whole, oldest first."""
    fs, place = _folder(spark, root)
    if not fs.exists(place):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(place)]
    numbers = sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())
    return [n for n in numbers if fs.exists(_folder(spark, f"{root}/v{n}/_SUCCESS")[1])]


def texts(spark: SparkSession, root: str, version: int) -> DataFrame:
    """key, text of one version."""
    return spark.read.schema(COLUMNS).parquet(f"{root}/v{version}")


def save_texts(rows: DataFrame, root: str, replace: bool = True) -> int:
    """Save key, text as the newest version; its number. Without ``replace``, documents of other keys are taken over from the version before."""
    spark, done = rows.sparkSession, versions(rows.sparkSession, root)
    given = rows.groupBy(F.col("key").cast("string").alias("key")).agg(F.max("text").alias("text"))
    if done and not replace:
        old, own = texts(spark, root, done[-1]), given.select(F.col("key").alias("_own"))
        given = given.unionByName(old.join(own, old["key"].eqNullSafe(own["_own"]), "left_anti"))
    number = done[-1] + 1 if done else 1
    given.write.mode("overwrite").parquet(f"{root}/v{number}")
    for n in [*done, number][:-KEPT]:
        fs, place = _folder(spark, f"{root}/v{n}")
        fs.delete(place, True)
    return number


def save(rows: DataFrame, root: str, key: str, column: str | None = None, replace: bool = True) -> int:
    """Save every row as the document of its ``key``: ``column`` alone, or an object of all other columns; see ``save_texts``."""
    value = F.col(column) if column else F.struct(*[c for c in rows.columns if c != key])
    return save_texts(rows.select(F.col(key).alias("key"), F.to_json(value).alias("text")), root, replace)


def load(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """key, value (of type ``schema``), origin of all documents of the newest version.

    origin is current; backup, if the text isn't JSON but the version before has one of that key that is; or broken, with a null value.
    The keys of broken documents are written first, so that Spark knows their size: while they are few, they are broadcast and neither version is shuffled.
    """
    done = versions(spark, root)
    if not done:
        return spark.createDataFrame([], f"key string, value {schema}, origin string")
    sound, value = F.try_parse_json("text").isNotNull(), F.from_json("text", schema)
    newest = texts(spark, root, done[-1])
    whole = newest.where(sound).select("key", value.alias("value"), F.lit("current").alias("origin"))
    torn = written(newest.where(~sound).select("key"), "torn")
    if torn.isEmpty():
        return whole
    if len(done) == 1:
        return whole.unionByName(torn.select("key", F.lit(None).cast(schema).alias("value"), F.lit("broken").alias("origin")))
    old, sought = texts(spark, root, done[-2]).where(sound), torn.select(F.col("key").alias("_torn"))
    found = old.join(sought, old["key"].eqNullSafe(sought["_torn"]), "left_semi").select(F.col("key").alias("_key"), value.alias("value"), F.lit("backup").alias("origin"))
    mended = torn.join(found, torn["key"].eqNullSafe(found["_key"]), "left")
    return whole.unionByName(mended.select("key", "value", F.coalesce("origin", F.lit("broken")).alias("origin")))


def restore(spark: SparkSession, root: str) -> int:
    """Save the version before the newest one again, as the newest; its number."""
    done = versions(spark, root)
    if len(done) < 2:
        raise ValueError("there is no version to go back to")
    return save_texts(texts(spark, root, done[-2]), root)


def all_typed(items: Column, fields: dict[str, str]) -> Column:
    """``items``, an array of structs of texts, with the fields' types; null if any field of any item is missing or isn't of its type."""
    good = F.forall(items, lambda r: reduce(and_, [r[f].try_cast(t).isNotNull() for f, t in fields.items()]))
    return F.when(good, F.transform(items, lambda r: F.struct(*[r[f].try_cast(t).alias(f) for f, t in fields.items()])))
