"""Prefix trie of conversations, with aggregates of every node's subtree.

1. Turns get their place in their conversation, conversations are rebuilt (``rebuilt``),
   and every turn gets the key of the prefix that ends with it: 128 bits, the exclusive
   or of hashes of place and turn. Numbers and keys run along a conversation in segments
   of ``SEGMENT`` turns, which are then put together, so no task gets all turns of one.
2. Equal conversations are one, with their number as its weight. What ends in a node is
   one such conversation; the digest of its ids is taken while they stream by in order.
3. Subtries are hash-partitioned by the digest of their first turn; a task gets buckets
   of about ``BUCKET`` turns, builds pointer tries of dictionaries, and sums their
   subtrees in postorder, without recursion.
4. A subtrie of more than ``LARGEST`` turns is not built: the turns that all its
   conversations share become a chain of nodes by grouped sums, and what follows is
   partitioned again by the next turn, until every subtrie is small enough. Chains then
   get the sums of the subtries below them, last ones first.

Defined results: rows without a conv_id take no part; a null turn comes first, equal
turns are ordered by role and text; repeated rows are turns of their own; null roles and
texts are empty; a conversation without turns counts in the root alone; extra columns
are ignored; an empty table gives no rows. One task takes the ids that end in one node
(a digest can't be taken in parts), held one batch at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameloom.llm.common import materialize

#: Fixed values of rebuilding: conversations of a family, and the modulus of the shared turns.
FAMILY, SHARED = 5, 9
SEGMENT = 10_000
BUCKET, LARGEST = 20_000, 2_000
NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
ABOVE = "up1 long, up2 long"


def _segments(rows: DataFrame, key: str, at: Column, f: Callable, put: Callable, **values: Column) -> DataFrame:
    """Add running aggregates ``f`` of values along ``at`` (places that count up from 1, or down from -1) within a key, segment by segment; ``put`` joins two of them."""
    rows = rows.withColumns({"_at": at, "_segment": F.floor(at / SEGMENT), **{f"_{n}": v for n, v in values.items()}})
    inside = Window.partitionBy(key, "_segment").orderBy("_at")
    rows = rows.withColumns({n: f(f"_{n}").over(inside) for n in values})
    totals = rows.groupBy(F.col(key).alias("_key"), F.col("_segment").alias("_of")).agg(*[f(f"_{n}").alias(f"_t{n}") for n in values])
    before = Window.partitionBy("_key").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    earlier = totals.select("_key", "_of", *[f(f"_t{n}").over(before).alias(f"_b{n}") for n in values]).where(" or ".join(f"_b{n} is not null" for n in values))
    joined = rows.join(earlier, (F.col(key) == F.col("_key")) & (F.col("_segment") == F.col("_of")), "left")
    joined = joined.withColumns({n: put(F.col(n), F.coalesce(f"_b{n}", F.lit(0).cast("long"))) for n in values})
    return joined.drop("_at", "_segment", "_key", "_of", *[f"{p}{n}" for n in values for p in ("_", "_b")])


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, p (place, from 1), x1, x2 (128 bits that name role and text), bytes of the text."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    rows = rows.withColumn("part", F.floor(F.col("turn") / SEGMENT))
    first = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("part")).rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("conv_id", "part").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(first)).where("before is not null")
    parts = parts.select(F.col("conv_id").alias("of"), F.col("part").alias("of_part"), "before")
    place = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(F.asc_nulls_first("turn"), "role", "text"))
    rows = rows.select("conv_id", "part", place.alias("place"), F.xxhash64("role", "text").alias("x1"), F.xxhash64(F.lit("turn"), "text", "role").alias("x2"), F.octet_length("text").cast("long").alias("bytes"))
    joined = rows.join(parts, (F.col("conv_id") == F.col("of")) & F.col("part").eqNullSafe(F.col("of_part")), "left")
    return joined.select("conv_id", (F.coalesce("before", F.lit(0)) + F.col("place")).cast("long").alias("p"), "x1", "x2", "bytes")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id), and their turns (conv_id, d, x1, x2, bytes) after the first of their family lent them its first turns."""
    counts = materialize(turns.groupBy("conv_id").agg(F.count("*").alias("n")), "conversations")
    own = counts.select("conv_id", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"), (F.crc32(F.col("conv_id").cast("string")) % SHARED).alias("h"))
    base = counts.select(F.col("conv_id").alias("base"), "n")
    own = own.join(base, "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("n", F.lit(0).cast("long"))).alias("lent"))
    heads = turns.where(F.col("p") < SHARED).select(F.col("conv_id").alias("base"), "p", "x1", "x2", "bytes")
    heads = own.join(heads, "base").where("p <= h").select("conv_id", F.col("p").alias("d"), "x1", "x2", "bytes")
    tails = turns.join(own, "conv_id").where("p > h").select("conv_id", (F.col("lent") + F.col("p") - F.col("h")).alias("d"), "x1", "x2", "bytes")
    return counts.select("conv_id"), heads.unionByName(tails)


def _digests(batches):
    """Of (k1, k2, conv_id) in order: k1, k2, smallest id, number and digest of the ids of a key."""
    out: list[tuple] = []
    key = first = state = None
    n = 0

    def close() -> None:
        if key is not None:
            out.append((*key, first, n, state.hexdigest()))

    def flush() -> pa.RecordBatch:
        kinds = [pa.int64()] * 4 + [pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["e1", "e2", "rep", "weight", "sha"])

    for batch in batches:
        for k1, k2, conv in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if (k1, k2) != key:
                close()
                key, first, n, state = (k1, k2), conv, 1, hashlib.sha256(str(conv).encode())
            else:
                n += 1
                state.update(f",{conv}".encode())
        if len(out) > 10_000:
            yield flush()
            out = []
    close()
    if out:
        yield flush()


def distinct_conversations(conversations: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """reps (rep, weight, sha, n turns) of equal conversations, and the turns of reps: rep, weight, sha, n, d, k1, k2 (key of the prefix), bytes."""
    hashed = turns.select("conv_id", "d", "bytes", F.xxhash64("d", "x1", "x2").alias("y1"), F.xxhash64("x2", "d", "x1").alias("y2"))
    keyed = materialize(_segments(hashed, "conv_id", F.col("d"), F.bit_xor, lambda a, b: a.bitwiseXOR(b), k1=F.col("y1"), k2=F.col("y2")).select("conv_id", "d", "k1", "k2", "bytes"), "prefixes")
    last = keyed.groupBy("conv_id").agg(F.max_by(F.struct("d", "k1", "k2"), "d").alias("last"))
    whole = conversations.join(last, "conv_id", "left")
    zero = F.lit(0).cast("long")
    whole = materialize(whole.select("conv_id", *[F.coalesce(F.col(f"last.{c}"), zero).alias(c) for c in ("k1", "k2", "d")]), "whole")
    ids = whole.select("k1", "k2", "conv_id").repartition("k1", "k2").sortWithinPartitions("k1", "k2", "conv_id")
    ends = ids.mapInArrow(_digests, "e1 long, e2 long, rep long, weight long, sha string")
    reps = materialize(ends.join(whole.select(F.col("conv_id").alias("rep"), F.col("d").alias("n")), "rep").select("rep", "weight", "sha", "n"), "distinct")
    rows = keyed.withColumnRenamed("conv_id", "rep").join(reps, "rep")
    return reps, rows.select("rep", "weight", "sha", "n", "d", "k1", "k2", "bytes")


def _tries(pdf: pd.DataFrame) -> pd.DataFrame:
    """Nodes of the subtries of a bucket: rows rep, weight, sha, n, top, up (the parent's conversation), up1, up2, d, k1, k2, bytes."""
    pdf = pdf.sort_values(["rep", "d"])
    tops: dict[tuple, int] = {}
    kids: list[dict] = []
    parent, depth, conv, members, size, ends, above = [], [], [], [], [], [], []
    at, of = -1, None
    columns = [pdf[c].tolist() for c in ("rep", "weight", "sha", "n", "top", "up", "up1", "up2", "d", "k1", "k2", "bytes")]
    for rep, weight, sha, n, top, up, up1, up2, d, k1, k2, length in zip(*columns, strict=True):
        if rep != of or d == top:
            of, at = rep, -1
        table = tops if at < 0 else kids[at]
        node = table.get((k1, k2))
        if node is None:
            node = table[k1, k2] = len(kids)
            kids.append({})
            parent.append(at)
            depth.append(d)
            conv.append(rep)  # conversations come in ascending order
            members.append(0)
            size.append(length)
            ends.append(None)
            above.append((up, up1, up2) if at < 0 else (conv[at], None, None))
        members[node] += weight
        if d == n:
            ends[node] = sha
        at = node
    leaves, saved = [0] * len(kids), [(m - 1) * b for m, b in zip(members, size, strict=True)]
    for node in reversed(range(len(kids))):  # children are younger than their parents: a postorder
        leaves[node] = leaves[node] or 1
        if parent[node] >= 0:
            leaves[parent[node]] += leaves[node]
            saved[parent[node]] += saved[node]
    none = hashlib.sha256(b"").hexdigest()
    columns = [conv, depth, [a[0] for a in above], members, [len(k) for k in kids], leaves, saved, [e or none for e in ends]]
    out = pd.DataFrame(dict(zip([c.split()[0] for c in NODES.split(", ")], columns, strict=True)))
    return out.assign(up1=pd.array([a[1] for a in above], "Int64"), up2=pd.array([a[2] for a in above], "Int64"))


NONE = hashlib.sha256(b"").hexdigest()


def _chains(large: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of groups (t1, t2) too large to build: the nodes that all members share (depth, conv_id, n_convs, own, sha of the last, bottom), and the turns below, in groups of the next turn."""
    group = ["t1", "t2", "top", "up", "up1", "up2"]
    level = large.groupBy(*group, "d").agg(
        F.count("*").alias("reps"), F.min("rep").alias("conv_id"), F.sum("weight").alias("n_convs"), F.max("bytes").alias("bytes"),
        F.min("k1").alias("k1"), F.min("k2").alias("k2"), (F.min("k1") == F.max("k1")).alias("one1"), (F.min("k2") == F.max("k2")).alias("one2"), F.max(F.when(F.col("n") == F.col("d"), F.col("sha"))).alias("sha"),
    )
    level = materialize(level, "levels")
    whole = level.where("d = top").select("t1", "t2", F.col("reps").alias("all"))
    chain = level.join(whole, ["t1", "t2"]).where("reps = all and one1 and one2")
    bottom = chain.groupBy("t1", "t2").agg(F.max("d").alias("bottom"), F.max_by(F.struct("k1", "k2"), "d").alias("b"))
    bottom = materialize(bottom.select("t1", "t2", "bottom", F.col("b.k1").alias("b1"), F.col("b.k2").alias("b2")), "bottoms")
    nodes = materialize(chain.join(bottom, ["t1", "t2"]).select(*group, "d", "conv_id", "n_convs", ((F.col("n_convs") - 1) * F.col("bytes")).alias("own"), "sha", "bottom", "b1", "b2"), "chains")
    ends = nodes.where("d = bottom").select("t1", "t2", "bottom", "b1", "b2", F.col("conv_id").alias("low"))
    below = large.drop("top", "up", "up1", "up2").join(ends, ["t1", "t2"]).where("d > bottom").drop("t1", "t2")
    heads = below.where("d = bottom + 1").select("rep", F.col("k1").alias("t1"), F.col("k2").alias("t2"))
    rows = below.join(heads, "rep").select("rep", "weight", "sha", "n", "d", "k1", "k2", "bytes", "t1", "t2", (F.col("bottom") + 1).alias("top"), F.col("low").alias("up"), F.col("b1").alias("up1"), F.col("b2").alias("up2"))
    return nodes, rows


def _summed(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """Nodes of chains with the sums of what hangs on their lowest ones; ``found``: nodes already done, of which those with up1 and up2 are tops."""
    kids = found.where("up1 is not null").groupBy(F.col("up1").alias("b1"), F.col("up2").alias("b2")).agg(F.count("*").alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    rows = nodes.withColumn("name", F.struct("t1", "t2"))
    rows = _segments(rows, "name", -F.col("d"), F.sum, lambda a, b: a + b, chain=F.col("own"))
    last, top = F.col("d") == F.col("bottom"), F.col("d") == F.col("top")
    rows = rows.join(kids, ["b1", "b2"], "left")
    conv = F.when(top, F.col("up")).otherwise(F.col("conv_id"))  # all nodes of a chain have the same members
    return rows.select(
        "conv_id", F.col("d").alias("depth"), conv.alias("parent_conv_id"), "n_convs", F.when(last, F.coalesce("kids", F.lit(0))).otherwise(1).cast("long").alias("n_children"),
        F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"), (F.col("chain") + F.coalesce("saved", F.lit(0))).cast("long").alias("saved_tokens"),
        F.coalesce("sha", F.lit(NONE)).alias("ends_sha256"), F.when(top, F.col("up1")).alias("up1"), F.when(top, F.col("up2")).alias("up2"),
    )


def trie(conversations: DataFrame, turns: DataFrame, bucket: int = BUCKET, largest: int = LARGEST) -> DataFrame:
    """The nodes (``NODES``) of conversations (conv_id) and their turns (conv_id, d from 1, x1, x2, bytes)."""
    spark = turns.sparkSession
    reps, rows = distinct_conversations(conversations, turns)
    root = reps.agg(F.min("rep").alias("conv_id"), F.sum("weight").alias("n_convs"), F.max(F.when(F.col("n") == 0, F.col("sha"))).alias("sha")).first()
    if root["conv_id"] is None:
        return spark.createDataFrame([], NODES)
    heads = rows.where("d = 1").select("rep", F.col("k1").alias("t1"), F.col("k2").alias("t2"))
    zero = F.lit(0).cast("long")
    live = rows.join(heads, "rep").withColumns({"top": F.lit(1).cast("long"), "up": F.lit(root["conv_id"]).cast("long"), "up1": zero, "up2": zero})
    ready, chains = [], []
    while True:
        live = materialize(live, "subtries")
        over = materialize(live.groupBy("t1", "t2").agg(F.count("*").alias("turns")).where(F.col("turns") > largest), "large")
        if over.isEmpty():
            ready.append(live)
            break
        over = over.select("t1", "t2")
        ready.append(live.join(over, ["t1", "t2"], "left_anti"))
        nodes, live = _chains(live.join(over, ["t1", "t2"]))
        chains.append(nodes)
    small = reduce(DataFrame.unionByName, ready)
    buckets = max(1, -(-small.count() // bucket))
    small = small.withColumn("bucket", F.pmod(F.xxhash64("t1", "t2"), F.lit(buckets)))
    found = materialize(small.groupBy("bucket").applyInPandas(_tries, f"{NODES}, {ABOVE}"), "tries")
    for nodes in reversed(chains):
        found = materialize(found.unionByName(_summed(nodes, found)), "tries")
    tops = found.where("depth = 1").agg(F.count("*").alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    top = tops.select(
        F.lit(root["conv_id"]).cast("long").alias("conv_id"), zero.alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(root["n_convs"]).cast("long").alias("n_convs"), F.col("kids").alias("n_children"),
        F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"), F.coalesce("saved", zero).alias("saved_tokens"), F.lit(root["sha"] or NONE).alias("ends_sha256"),
    )
    return found.drop("up1", "up2").unionByName(top)


def conversation_trie(conversations: DataFrame, bucket: int = BUCKET, largest: int = LARGEST) -> DataFrame:
    """Trie of all rebuilt conversations of a table (conv_id, turn, role, text)."""
    ids, turns = rebuilt(materialize(numbered(conversations), "turns"))
    return trie(ids, turns, bucket, largest)
