"""Perceptual hashes of frames and the similarity of items made of frames.

A frame is a block of 64 coefficients; its hash has bit i set when coefficient i is
above the block's median, packed into one long, first bit highest. An item is its
frames in order. Two items compare by their interior frames: the first and the last are
left out, the longer one is cut to the shorter, outliers go by the modified z-score, and
the rest must be at least three, similar on average and even.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.sources.scratch import written

BITS = 64
MIN_SIMILARITY, MAX_DEVIATION, MIN_FRAMES, MAX_Z = 0.9, 0.1, 3, 3.5


def median_of(values: Column) -> Column:
    """Mean of the middle one or two of an array of doubles; null when empty."""
    s, n = F.array_sort(values), F.size(values)
    return (F.get(s, F.expr("0") + F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2


def frame_bits(block: Column) -> Column:
    """Array of 0/1: coefficient above the block's median; nulls aren't, and don't count for it."""
    wide = F.transform(block, lambda x: x.cast("double"))
    return F.transform(wide, lambda x: F.coalesce(x > median_of(F.array_compact(wide)), F.lit(False)).cast("int"))


def packed(bits: Column) -> Column:
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: F.shiftleft(a, 1).bitwiseOR(b.cast("long")))


def settled(rows: DataFrame, kept: list[str], **computed: Column) -> DataFrame:
    """``kept`` and the computed columns, which pass through a generator of one row.

    The optimizer would take an expression used in a lambda into it, and compute it for every element; it doesn't move expressions through a generator.
    """
    return rows.select(*kept, F.inline_outer(F.array(F.struct(*[c.alias(k) for k, c in computed.items()]))))


def frame_hashes(vectors: DataFrame) -> DataFrame:
    """vec_id, h; the median is computed once a row, before the comparison. A null component's bit is 0, a null vector's hash is null."""
    wide = settled(vectors, ["vec_id"], x=F.transform("embedding", lambda x: x.cast("double")))
    middle = settled(wide, ["vec_id", "x"], m=median_of(F.array_compact("x")))
    return middle.select("vec_id", packed(F.transform("x", lambda v: F.coalesce(v > F.col("m"), F.lit(False)).cast("int"))).alias("h"))


def hamming_similarity(a: Column, b: Column) -> Column:
    return F.lit(1.0) - F.bit_count(a.bitwiseXOR(b)) / float(BITS)


def collect_frames(frames: DataFrame) -> DataFrame:
    """frames (video_id, pos, h) to video_id and its hashes in order; an item's frames are few."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "h")))
    return frames.groupBy("video_id").agg(F.transform(ordered, lambda f: f["h"]).alias("hashes"))


def frame_similarities(a: Column, b: Column) -> Column:
    """Of interior positions: all but the first and last of the shorter item."""
    n = F.least(F.size(a), F.size(b))
    inner = F.greatest(n - 2, F.lit(0))
    return F.zip_with(F.slice(a, 2, inner), F.slice(b, 2, inner), hamming_similarity)


def without_outliers(rows: DataFrame, sims: str, out: str) -> DataFrame:
    """Add ``out``: the ``sims`` with |0.6745 (x - median) / MAD| < 3.5; all, when the MAD is 0.

    Median and MAD are columns of their own, so that no lambda computes them again.
    """
    x = F.col(sims)
    middle = settled(settled(rows, [c for c in rows.columns if c != sims], **{sims: x}), rows.columns, _m=median_of(x))
    spread = settled(middle, middle.columns, _mad=median_of(F.transform(x, lambda v: F.abs(v - F.col("_m")))))
    near = F.filter(x, lambda v: F.abs(0.6745 * (v - F.col("_m")) / F.col("_mad")) < MAX_Z)
    return spread.withColumn(out, F.when(F.col("_mad") == 0, x).otherwise(near)).drop("_m", "_mad")


def mean_of(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)


def score_pairs(pairs: DataFrame, similarity: float = MIN_SIMILARITY, deviation: float = MAX_DEVIATION) -> DataFrame:
    """pairs (a, b, hashes_a, hashes_b) that are alike: a, b, similarity (0 to 100), spread."""
    sims = pairs.select("a", "b", frame_similarities(F.col("hashes_a"), F.col("hashes_b")).alias("sims"))
    kept = without_outliers(sims, "sims", "kept").select("a", "b", "kept", F.size("kept").alias("n"))
    scored = kept.select("a", "b", "kept", "n", (F.aggregate("kept", F.lit(0.0), lambda acc, x: acc + x) / F.nullif(F.col("n"), F.lit(0))).alias("m"))
    squares = F.aggregate("kept", F.lit(0.0), lambda acc, x: acc + (x - F.col("m")) * (x - F.col("m")))
    # A generator of one row: filters on its output stay above it, or they would take the whole computation into their lambdas.
    row = F.struct("n", "m", F.sqrt(squares / F.nullif(F.col("n"), F.lit(0))).alias("s"))  # population deviation
    spread = scored.select("a", "b", F.inline_outer(F.array(row)))
    good = (F.col("n") >= MIN_FRAMES) & (F.col("m") >= similarity) & (F.col("s") <= deviation)
    return spread.where(good).select("a", "b", F.round(F.col("m") * 100, 7).alias("similarity"), F.round("s", 9).alias("spread"))


def all_pairs(items: DataFrame) -> DataFrame:
    """Every unordered pair of items (video_id, hashes) once: a < b."""
    left = items.select(F.col("video_id").alias("a"), F.col("hashes").alias("hashes_a"))
    right = items.select(F.col("video_id").alias("b"), F.col("hashes").alias("hashes_b"))
    return left.join(right, F.col("a") < F.col("b"))


#: Ids of a block, about, and pairs of blocks that a task makes where there are many.
BLOCK, BLOCKS_A_TASK = 1024, 16


def id_pairs(ids: DataFrame) -> DataFrame:
    """a, b (a < b): every unordered pair of ids (video_id) once; half the square of their number by nature.

    Ids are dealt by range to blocks, and two blocks meet under a key of their own, once, so a task holds one block at a time beside the ids
    that stream by, and only a block beside itself makes pairs that don't count. Null ids are in no pair.
    """
    known = written(ids.select("video_id").where("video_id is not null").distinct(), "ids")
    placed = written(known.repartitionByRange(max(1, -(-known.count() // BLOCK)), "video_id").withColumn("block", F.spark_partition_id()), "blocks")
    n = (placed.agg(F.max("block")).first()[0] or 0) + 1
    met = n * (n + 1) // 2
    tasks = max(1, min(met, 4 * ids.sparkSession.sparkContext.defaultParallelism), met // BLOCKS_A_TASK)
    low = placed.select(F.col("video_id").alias("a"), "block", F.explode(F.sequence(F.col("block"), F.lit(n - 1))).alias("other"))
    high = placed.select(F.col("video_id").alias("b"), "block", F.explode(F.sequence(F.lit(0), F.col("block"))).alias("other"))
    left = low.select("a", (F.col("block").cast("long") * n + F.col("other")).alias("key")).repartition(tasks, "key")
    right = high.select("b", (F.col("other").cast("long") * n + F.col("block")).alias("key")).repartition(tasks, "key")
    return left.join(right.hint("merge"), "key").where("a < b").select("a", "b")


def canonical(pairs: DataFrame) -> DataFrame:
    """Unordered pairs once each, smaller end first."""
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def without_pairs(pairs: DataFrame, ignored: DataFrame) -> DataFrame:
    return pairs.join(canonical(ignored), ["a", "b"], "left_anti")


def alike(items: DataFrame) -> DataFrame:
    """items (video_id, hashes): rep, the smallest id with the same hashes, beside every item."""
    digest = F.xxhash64("hashes")
    first = items.groupBy(digest.alias("_d"), "hashes").agg(F.min("video_id").alias("rep"))
    return items.withColumn("_d", digest).join(first, ["_d", "hashes"]).select("video_id", "rep", "hashes")


#: Bits in which frames differ at most that pairs can be found for by bands; of more, nearly all frames are near each other.
WIDEST = 25


def masks(width: int, most: int) -> list[int]:
    """All values of ``width`` bits with at most ``most`` of them set."""
    return [sum(1 << i for i in bits) for k in range(most + 1) for bits in combinations(range(width), k)]


def flips(x: Column, width: int, most: int) -> Column:
    """Array of all values that differ from ``x`` in at most ``most`` of the low ``width`` bits."""
    listed = F.split(F.lit(",".join(map(str, masks(width, most)))), ",").cast("array<long>")
    return F.transform(listed, lambda m: x.bitwiseXOR(m))


def band_plan(most: int) -> tuple[int, int, int]:
    """Bands, and flipped bits on either side, with which frames meet that differ in at most ``most`` bits.

    Of ``bands`` bands one differs in at most most / bands bits, as many as both sides flip together. Dealing the flips to both sides keeps
    their number near the square root of what one side would need. A band flips two bits at most: with fewer and longer bands hardly fewer
    frames meet at a wide radius, but each has thousands of keys.
    """
    bands = max(4, most // 3 + 1)
    reach = most // bands
    return bands, reach // 2, reach - reach // 2


#: Keys that a task sorts at most, on average, about 150 bytes each.
KEYS_A_TASK = 400_000


def close_pairs(items: DataFrame, most: int) -> DataFrame:
    """a, b (a < b) of all items with an interior frame at the same position that differs in at most ``most`` (up to ``WIDEST``) bits; equal to comparing all, by multi-index hashing.

    Spark takes the keys for as small as the frames they are made of, so the join is told to shuffle them: neither side is broadcast. Keys pack
    well, and adaptive execution would join partitions by their packed size, so they are dealt to as many tasks as their number asks for.
    ``items`` are read twice, for their number too.
    """
    if not 0 <= most <= WIDEST:
        raise ValueError(f"frames are found within 0 to {WIDEST} bits")
    bands, near, far = band_plan(most)
    cuts = [BITS * i // bands for i in range(bands + 1)]
    frames = items.select("video_id", F.size("hashes").alias("n"), F.posexplode("hashes").alias("pos", "h")).where("pos > 0 and pos < n - 1")
    each = sum(len(masks(cuts[i + 1] - cuts[i], reach)) for i in range(bands) for reach in (near, far))
    n_frames = items.agg(F.sum(F.greatest(F.size("hashes") - 2, F.lit(0)))).first()[0] or 0
    parts_of_keys = max(items.sparkSession.sparkContext.defaultParallelism, -(-n_frames * each // KEYS_A_TASK))

    def keys(reach: int, name: str) -> DataFrame:
        parts = []
        for i in range(bands):
            width = cuts[i + 1] - cuts[i]
            bits = F.shiftrightunsigned("h", BITS - cuts[i + 1]).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
            place = F.shiftleft(F.col("pos").cast("long") * bands + i, BITS // bands + 1)  # frame and band, above the band's bits
            parts.append(flips(place.bitwiseOR(bits), width, reach))
        return frames.select(F.col("video_id").alias(name), F.col("h").alias(f"h{name}"), F.explode(F.concat(*parts)).alias("key")).repartition(parts_of_keys, "key")

    met = keys(far, "x").join(keys(near, "y").hint("merge"), "key").where((F.col("x") != F.col("y")) & (F.bit_count(F.col("hx").bitwiseXOR(F.col("hy"))) <= most))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def with_hashes(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """pairs (a, b) with hashes_a and hashes_b."""
    left = items.select(F.col("video_id").alias("a"), F.col("hashes").alias("hashes_a"))
    right = items.select(F.col("video_id").alias("b"), F.col("hashes").alias("hashes_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "hashes_a", "hashes_b")


def blocked_pairs(items: DataFrame, similarity: float = MIN_SIMILARITY) -> DataFrame:
    """Pairs that can reach ``similarity``, with their hashes, without comparing all.

    Some kept frame is at least as similar as the mean, so it differs in at most
    floor(64 (1 - t)) bits; pairs without such a frame can't be alike.
    """
    return with_hashes(close_pairs(items, int(BITS * (1 - similarity) + 1e-9)), items)


def near_links(items: DataFrame, similarity: float = MIN_SIMILARITY, deviation: float = MAX_DEVIATION) -> tuple[DataFrame, DataFrame]:
    """Every item with its rep, and the scored pairs (a, b, similarity, spread) of different reps; equal items are compared once."""
    members = written(alike(items), "items")
    reps = members.where("video_id = rep").select("video_id", "hashes")
    pairs = blocked_pairs(reps, similarity)
    return members, score_pairs(pairs, similarity, deviation)


def near_duplicates(items: DataFrame, ignored: DataFrame | None = None, similarity: float = MIN_SIMILARITY, deviation: float = MAX_DEVIATION) -> DataFrame:
    """All pairs that are alike: found between different items by bands, at any similarity from 0.61 on, then given to equal items; ignored pairs go."""
    members, links = near_links(items, similarity, deviation)
    a, b = members.select(F.col("rep").alias("ra"), F.col("video_id").alias("x")), members.select(F.col("rep").alias("rb"), F.col("video_id").alias("y"), F.size("hashes").alias("n"))
    across = links.join(a, links["a"] == F.col("ra")).join(b, links["b"] == F.col("rb"))
    within = a.join(b, F.col("ra") == F.col("rb")).where((F.col("x") < F.col("y")) & (F.col("n") >= MIN_FRAMES + 2))
    pairs = across.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity", "spread").unionByName(
        within.select(F.col("x").alias("a"), F.col("y").alias("b"), F.lit(100.0).alias("similarity"), F.lit(0.0).alias("spread")))
    return pairs if ignored is None else without_pairs(pairs, ignored)


def near_groups(items: DataFrame, similarity: float = MIN_SIMILARITY, deviation: float = MAX_DEVIATION) -> DataFrame:
    """node, label of all items that are alike with another, directly or through others; equal items hang on one of them, their pairs are not made."""
    members, links = near_links(items, similarity, deviation)
    same = members.where((F.col("video_id") != F.col("rep")) & (F.size("hashes") >= MIN_FRAMES + 2)).select(F.col("rep").alias("a"), F.col("video_id").alias("b"))
    return component_labels(links.select("a", "b").unionByName(same))


def compared(pairs: DataFrame, items: DataFrame, minutes: float = 0, similarity: float = MIN_SIMILARITY, deviation: float = MAX_DEVIATION) -> DataFrame:
    """Given pairs (a, b) with the similarity (0 to 100) that a comparison gives: 0 if an item lacks hashes, if the pair isn't alike, or, with ``minutes``, if durations differ by more.

    items: video_id, hashes (null where hashing failed), duration in seconds. Pairs are given once.
    """
    left = items.select(F.col("video_id").alias("a"), F.col("hashes").alias("hashes_a"), F.col("duration").alias("da"))
    right = items.select(F.col("video_id").alias("b"), F.col("hashes").alias("hashes_b"), F.col("duration").alias("db"))
    met = pairs.select("a", "b").join(left, "a").join(right, "b").where("hashes_a is not null and hashes_b is not null")
    if minutes > 0:
        met = met.where(F.abs(F.col("da") - F.col("db")) <= minutes * 60)
    found = score_pairs(met.select("a", "b", "hashes_a", "hashes_b"), similarity, deviation)
    return pairs.select("a", "b").join(found, ["a", "b"], "left").select("a", "b", F.coalesce("similarity", F.lit(0.0)).alias("similarity"))


def sampled_frames(total: Column, short: int = 1000, stride: int = 500, most: int = 10) -> Column:
    """Indices of the frames to hash, ascending: tenths of short items, one a ``stride`` of others, the first five if under three."""
    tenths = F.array(*[(total * F.lit(s)).cast("int") for s in (0.1, 0.3, 0.5, 0.7, 0.9)])
    k = F.least(F.lit(most), F.floor(total / stride).cast("int"))
    spaced = F.transform(F.sequence(F.lit(0), F.greatest(k - 1, F.lit(0))), lambda i: F.floor(i * total / k).cast("int"))
    raw = F.when(total < short, tenths).otherwise(spaced)
    clamped = F.array_sort(F.array_distinct(F.transform(raw, lambda i: F.greatest(F.lit(0), F.least(i, (total - 1).cast("int"))))))
    first = F.sequence(F.lit(0), F.greatest(F.least(F.lit(5), total.cast("int")) - 1, F.lit(0)))
    return F.when(F.size(clamped) < 3, F.array_sort(F.array_union(clamped, first))).otherwise(clamped)


def _star_round(edges: DataFrame) -> DataFrame:
    """A large-star and a small-star step on distinct edges (a > b): every end moves to the smallest node near it."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = both.join(lowest, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    apart = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return apart.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def component_labels(edges: DataFrame) -> DataFrame:
    """node, label: smallest node that links reach. Stars contract until no edge changes, however long the chains; each round is written to the shared folder."""
    edges = written(edges.select("a", "b"), "edges")
    nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    stars = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
    while True:
        fresh = written(_star_round(stars), "stars")
        if fresh.count() == stars.count() and fresh.join(stars, ["a", "b"], "left_anti").isEmpty():
            break
        stars = fresh
    return nodes.join(stars.select(F.col("a").alias("node"), F.col("b").alias("label")), "node", "left").select("node", F.coalesce("label", "node").alias("label"))
