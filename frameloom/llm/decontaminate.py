"""Removal of benchmark passages: n-gram windows of test items found in documents.

Texts are lower-cased (A-Z) and cut into words of letters, digits and non-ASCII
characters. A window is ``size`` consecutive words of an item; a shorter item is
one window. Every document window of the same lengths is hashed from its words' hashes
and looked up in the broadcast set of test hashes; every hit is verified word by word.
Only DataFrame expressions are used.

The set is broadcast ``PER_PASS`` hashes at a time, whatever their number: more of them
take more passes over the documents, each without a shuffle. Only hits are written.

Defined results: null or empty text has no words and no hits; items without words
never hit; items of null id hit words but are not listed; repeated documents are
all returned, each judged alike; repeated items count once; other columns are
ignored, whatever their names; empty tables give no hits or no rows.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.llm.common import lower_ascii, materialize, settled, small_side

WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SIZE = 10
#: Test hashes that are broadcast together: some 50 MB as a hash table.
PER_PASS = 2_000_000


def words(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), WORD_BREAK), lambda w: w != "")


def _hashes(tokens: Column) -> Column:
    return F.transform(tokens, lambda w: F.xxhash64(w))


def item_windows(items: DataFrame, size: int = SIZE) -> DataFrame:
    """item_id, len, h, gram (its words, space between) of every distinct window."""
    split = settled(items.select("item_id", "text"), ["item_id"], w=words(F.col("text")))
    split = split.where(F.size("w") > 0).select("item_id", "w", _hashes(F.col("w")).alias("wh"), F.least(F.size("w"), F.lit(size)).alias("len"))
    each = split.select("item_id", "w", "wh", "len", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1)).alias("pos"))
    part = [F.slice(c, F.col("pos"), F.col("len")) for c in ("wh", "w")]
    return each.select("item_id", "len", F.xxhash64(part[0]).alias("h"), F.array_join(part[1], " ").alias("gram")).distinct()


def covered(spans: Column) -> Column:
    """Number of words under sorted structs (pos, len)."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def step(acc, s):
        end = F.greatest(acc["end"], s["pos"] + s["len"] - 1)
        return F.struct(end.alias("end"), (acc["n"] + end - F.greatest(acc["end"], F.least(s["pos"] - 1, end))).alias("n"))

    return F.aggregate(spans, start, step, lambda acc: acc["n"])


def _candidates(docs: DataFrame, known: DataFrame, keys: list[str], lengths: list[int], heads: bool) -> DataFrame:
    """Of each document, the windows whose hash is in ``known`` (h, hit) and, with ``heads``, one row without: keys, row, n_words, pos, len, h, gram."""
    base = settled(docs, keys, row=F.xxhash64("text"), w=words(F.col("text")))
    each = base.select(*keys, "row", "w", F.size("w").alias("n"), _hashes(F.col("w")).alias("wh"))
    each = each.select(*keys, "row", "w", "n", "wh", F.posexplode_outer("wh").alias("at", "_first"))
    first = F.coalesce("at", F.lit(0)) == 0

    def window(length: int) -> Column:
        return F.when(F.col("at") + length <= F.col("n"), F.xxhash64(F.slice("wh", F.col("at") + 1, F.lit(length))))

    if len(lengths) == 1:
        each = each.select(*keys, "row", "w", "n", "at", F.lit(lengths[0]).alias("len"), window(lengths[0]).alias("h"))
    else:
        several = F.array(*[F.struct(F.lit(k).alias("len"), window(k).alias("h")) for k in lengths])
        each = each.select(*keys, "row", "w", "n", "at", F.inline(several))
    found = each.join(F.broadcast(known), "h", "left")
    kept = found.where(F.col("hit").isNotNull() | (first & (F.col("len") == lengths[0]))) if heads else found.where("hit")
    gram = F.when(F.col("hit"), F.array_join(F.slice("w", F.col("at") + 1, F.col("len")), " "))
    return kept.select(*keys, "row", F.col("n").cast("long").alias("n_words"), (F.col("at") + 1).alias("pos"), "len", "h", gram.alias("gram"), (first & (F.col("len") == lengths[0]) & F.lit(heads)).alias("head"))


def scan(docs: DataFrame, items: DataFrame, size: int = SIZE, per_pass: int = PER_PASS) -> DataFrame:
    """One row per document: doc_id, row (a hash of the text), n_words, spans (verified (pos, len), from 1), items (sorted texts of the ids)."""
    docs, keys = docs.select("doc_id", "text"), ["doc_id"]
    tests = materialize(item_windows(items, size), "test-windows")
    hashes = materialize(tests.select("h").distinct().withColumn("hit", F.lit(True)), "test-hashes")
    count = hashes.count()
    none = [F.array().cast("array<struct<pos:int,len:int>>"), F.array().cast("array<string>")]
    if not count:
        return docs.select(*keys, F.xxhash64("text").alias("row"), F.size(words(F.col("text"))).cast("long").alias("n_words"), none[0].alias("spans"), none[1].alias("items"))
    lengths = sorted(r["len"] for r in tests.select("len").distinct().collect())  # 1 to size
    passes = -(-count // per_pass)
    parts = [_candidates(docs, hashes.where(F.pmod("h", F.lit(passes)) == p), keys, lengths, p == 0) for p in range(passes)]
    found = materialize(reduce(DataFrame.unionByName, parts), "window-hits")
    hits = found.where("gram is not null").select(*keys, "row", "pos", "len", "h", "gram")
    verified = hits.join(small_side(tests), ["len", "h", "gram"])
    spans = F.array_sort(F.collect_set(F.struct("pos", "len")))
    judged = verified.groupBy(*keys, "row").agg(spans.alias("spans"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    judged = materialize(judged, "judged")
    heads = found.where("head").select(*keys, "row", "n_words").alias("k")
    same = reduce(and_, [F.col(f"k.{c}").eqNullSafe(F.col(f"j.{c}")) for c in keys]) & (F.col("k.row") == F.col("j.row"))
    return heads.join(judged.alias("j"), same, "left").select(*[f"k.{c}" for c in keys], "k.row", "n_words", F.coalesce("spans", none[0]).alias("spans"), F.coalesce("items", none[1]).alias("items"))


def report(docs: DataFrame, items: DataFrame, size: int = SIZE, per_pass: int = PER_PASS) -> DataFrame:
    """The scan as counts: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return scan(docs, items, size, per_pass).select(
        "doc_id", "n_words", covered(F.col("spans")).cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, size: int = SIZE) -> DataFrame:
    """``docs`` without the documents that hold a test window; columns and other rows, told apart by id and a hash of the text, stay."""
    bad = scan(docs, items, size).where(F.size("spans") > 0).select("doc_id", "row").distinct()
    bad = materialize(bad.toDF("id", "digest"), "contaminated")
    same = docs["doc_id"].eqNullSafe(bad["id"]) & (F.xxhash64(docs["text"]) == bad["digest"])
    return docs.join(small_side(bad), same, "left_anti")
