"""A cache of computed values beside the items they were computed of."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.sources.scratch import written


def cached_or_computed(listing: DataFrame, cache: DataFrame, key: str, compute: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Every item of ``listing`` (key, modified) with its cached values, or with computed ones; and the cache with these taken in.

    cache: key, last_modified and values. An entry counts unless its item was modified after ``last_modified``. ``compute`` gets the
    keys of all others, and them alone, and gives (key, values); it runs once. An item that it gives nothing for has null values and
    stays out of the cache. Entries of items that aren't listed stay. Adds ``computed`` (boolean) to the result.
    """
    values = [c for c in cache.columns if c not in (key, "last_modified")]
    entry = cache.select(F.col(key).alias("_key"), F.struct("last_modified", *values).alias("_entry"))
    met = listing.select(key, "modified").join(entry, F.col(key) == F.col("_key"), "left")
    fresh = F.col("_entry").isNotNull() & (F.col("modified") <= F.col("_entry.last_modified"))
    judged = written(met.select(key, "modified", F.when(fresh, F.col("_entry")).alias("_entry")), "looked-up")
    hits = judged.where("_entry is not null").select(key, "_entry.*", F.lit(False).alias("computed"))
    missed = judged.where("_entry is null").select(key, "modified")
    done = written(compute(missed.select(key)).select(key, *values), "computed")
    fresh_rows = missed.join(done, key, "left").select(key, F.col("modified").alias("last_modified"), *values, F.lit(True).alias("computed"))
    result = hits.select(key, "last_modified", *values, "computed").unionByName(fresh_rows)
    new = missed.join(done, key).select(key, F.col("modified").alias("last_modified"), *values)
    merged = new.unionByName(cache.select(key, "last_modified", *values).join(new.select(key), key, "left_anti"))
    return result, merged
