"""Frame hashing, pair similarity and sampling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.operators import similarity as S
from frameloom.plans.base import query, table
from frameloom.sources import frames as pixels
from frameloom.sources.scratch import written

BITS_SQL = "bits AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN CAST(x AS DOUBLE) > list_median(list_transform(embedding, lambda y: CAST(y AS DOUBLE))) THEN 1 ELSE 0 END) AS bits FROM embeddings)"
BITS_SQL = BITS_SQL.replace("list_median(", "list_aggregate(").replace("lambda y: CAST(y AS DOUBLE)))", "lambda y: CAST(y AS DOUBLE)), 'median')")
FRAMES_SQL = f"{BITS_SQL}, frames AS (SELECT vec_id // 5 AS video_id, CAST(vec_id % 5 AS INTEGER) AS pos, bits FROM bits)"
SAME = "list_sum(list_transform(list_zip({0}, {1}), lambda z: CASE WHEN z[1] = z[2] THEN 1 ELSE 0 END))"
SIMS_SQL = f"""{FRAMES_SQL}, n AS (SELECT video_id, count(*) AS n FROM frames GROUP BY video_id),
sims AS (SELECT x.video_id AS a, y.video_id AS b, x.pos, {SAME.format('x.bits', 'y.bits')} / 64.0::DOUBLE AS sim
  FROM frames x JOIN frames y ON x.pos = y.pos AND x.video_id < y.video_id JOIN n nx ON nx.video_id = x.video_id JOIN n ny ON ny.video_id = y.video_id
  WHERE x.pos >= 1 AND x.pos < least(nx.n, ny.n) - 1)"""
KEPT_SQL = f"""{SIMS_SQL}, med AS (SELECT a, b, median(sim) AS m FROM sims GROUP BY a, b),
mad AS (SELECT a, b, any_value(m) AS m, median(abs(sim - m)) AS mad FROM sims JOIN med USING (a, b) GROUP BY a, b),
kept AS (SELECT a, b, pos, sim FROM sims JOIN mad USING (a, b) WHERE mad = 0 OR abs(0.6745::DOUBLE * (sim - m) / mad) < 3.5)"""
#: A bounded list, one pair for every tenth item: with one of its copies, or with none that exists.
IGNORED_SQL = "ignored AS (SELECT DISTINCT video_id AS a, video_id + 1000000 * (1 + video_id % 3) AS b FROM n WHERE video_id < 1000000 AND video_id % 10 = 0)"
#: The whole list: all pairs of items whose ids add up to a multiple of seven.
ALL_IGNORED_SQL = "ignored AS (SELECT DISTINCT x.video_id AS a, y.video_id AS b FROM n x JOIN n y ON x.video_id < y.video_id WHERE (x.video_id + y.video_id) % 7 = 0)"
#: Every item, and copies of it: equal ones (1000000 on), and ones with two bits of every frame turned (2000000 on), the more the later the frame (3000000 on).
PLANTED_SQL = f"""{FRAMES_SQL}, planted AS (SELECT video_id, pos, bits FROM frames UNION ALL SELECT video_id + 1000000, pos, bits FROM frames WHERE video_id % 3 = 0
  UNION ALL SELECT video_id + 2000000, pos, list_transform(bits, lambda b, i: CASE WHEN i IN (video_id % 60 + 1, video_id % 60 + 3) THEN 1 - b ELSE b END) FROM frames WHERE video_id % 4 = 0
  UNION ALL SELECT video_id + 3000000, pos, list_transform(bits, lambda b, i: CASE WHEN i <= 4 * pos THEN 1 - b ELSE b END) FROM frames WHERE video_id % 5 = 0)"""
PLANTED_PAIRS_SQL = KEPT_SQL.replace(FRAMES_SQL, PLANTED_SQL).replace("FROM frames x JOIN frames y", "FROM planted x JOIN planted y").replace("count(*) AS n FROM frames GROUP", "count(*) AS n FROM planted GROUP")
#: All pairs of which an interior frame at one position differs in at most 7 bits.
CLOSE_SQL = PLANTED_PAIRS_SQL.split(", med AS")[0] + ", near AS (SELECT DISTINCT a, b FROM sims WHERE sim >= 57 / 64.0::DOUBLE)"
SCORED_SQL = "scored AS (SELECT a, b, avg(sim) AS m, stddev_pop(sim) AS s FROM kept GROUP BY a, b HAVING count(*) >= 3)"
NEAR_SQL = f"WITH {PLANTED_PAIRS_SQL}, {ALL_IGNORED_SQL}, {SCORED_SQL} SELECT a, b, round(m * 100, 7) AS similarity, round(s, 9) AS spread FROM scored ANTI JOIN ignored USING (a, b) WHERE m >= 0.9::DOUBLE AND s <= 0.1::DOUBLE"


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashes = S.frame_hashes(table(spark, sf_dir, "embeddings"))
    return hashes.select(F.expr("vec_id div 5").alias("video_id"), F.expr("cast(vec_id % 5 as int)").alias("pos"), "h")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.collect_frames(frames(spark, sf_dir))


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """items with equal and near copies of some."""
    own = items(spark, sf_dir)
    base, v = own.withColumnRenamed("video_id", "of"), F.col("of")  # a lambda would see a column of the new name first

    def left(x: int, by: Column) -> Column:
        return F.call_function("shiftleft", F.lit(x).cast("long"), by.cast("int"))

    two = left(1, 63 - v % 60).bitwiseOR(left(1, 61 - v % 60))
    rising = F.transform("hashes", lambda h, i: F.when(i > 0, h.bitwiseXOR(left(-1, 64 - 4 * i))).otherwise(h))
    copies = [
        base.where(v % 3 == 0).select((v + 1_000_000).alias("video_id"), "hashes"),
        base.where(v % 4 == 0).select((v + 2_000_000).alias("video_id"), F.transform("hashes", lambda h: h.bitwiseXOR(two)).alias("hashes")),
        base.where(v % 5 == 0).select((v + 3_000_000).alias("video_id"), rising.alias("hashes")),
    ]
    return reduce(DataFrame.unionByName, copies, own)


def close(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Planted items, and their pairs with a frame within 7 bits, with hashes."""
    own = written(planted(spark, sf_dir), "planted")
    return own, S.with_hashes(S.close_pairs(own, 7), own)


def ignored(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    """Of every tenth item, a pair with one of its copies, in either order."""
    v = (frames(spark, sf_dir) if of is None else of).select("video_id").distinct().where("video_id < 1000000 and video_id % 10 = 0")
    a, b, odd = F.col("video_id"), F.col("video_id") + 1_000_000 * (1 + F.col("video_id") % 3), F.col("video_id") % 20 == 0
    return v.select(F.when(odd, b).otherwise(a).alias("a"), F.when(odd, a).otherwise(b).alias("b"))


def in_any_order(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) as a list that was not kept in order: the larger end first, where ``a`` is odd."""
    odd = F.col("a") % 2 == 1
    return pairs.select(F.when(odd, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(odd, F.col("a")).otherwise(F.col("b")).alias("b"))


#: Parts that the items of one remainder are dealt to.
DEALT = 64


def all_ignored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of items whose ids add up to a multiple of seven, in either order; N x N / 14 rows by nature. Items of one remainder meet in ``DEALT`` parts, so no task pairs a seventh of all."""
    v = written(frames(spark, sf_dir).select("video_id").distinct(), "ids")
    keyed = v.select(F.col("video_id").alias("a"), (F.col("video_id") % 7).alias("r"), (F.expr("video_id div 7") % DEALT).alias("part"))
    other = v.select(F.col("video_id").alias("b"), ((7 - F.col("video_id") % 7) % 7).alias("r"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(DEALT - 1).cast("long"))).alias("part"))
    return in_any_order(keyed.join(other.hint("merge"), ["r", "part"]).where("a < b").select("a", "b"))


@query(f"WITH {BITS_SQL} SELECT vec_id, array_to_string(bits, '') AS bits FROM bits")
def frame_hash_bits(spark, d):
    h = S.frame_hashes(table(spark, d, "embeddings"))
    return h.select("vec_id", F.lpad(F.bin("h"), 64, "0").alias("bits"))


@query(f"WITH {BITS_SQL} SELECT x.vec_id, 1 - (64 - {SAME.format('x.bits', 'y.bits')}) / 64.0::DOUBLE AS similarity FROM bits x JOIN bits y ON y.vec_id = x.vec_id + 1")
def hamming_similarity(spark, d):
    h = S.frame_hashes(table(spark, d, "embeddings"))
    after = h.select((F.col("vec_id") - 1).alias("vec_id"), F.col("h").alias("h2"))
    return h.join(after, "vec_id").select("vec_id", S.hamming_similarity(F.col("h"), F.col("h2")).alias("similarity"))


@query(f"WITH {BITS_SQL} SELECT x.vec_id, CAST({SAME.format('x.bits', 'y.bits')} AS DOUBLE) * 100 / 64 AS percentage FROM bits x JOIN bits y ON y.vec_id = x.vec_id + 2")
def match_percentage(spark, d):
    h = S.frame_hashes(table(spark, d, "embeddings"))
    after = h.select((F.col("vec_id") - 2).alias("vec_id"), F.col("h").alias("h2"))
    return h.join(after, "vec_id").select("vec_id", ((64 - F.bit_count(F.col("h").bitwiseXOR(F.col("h2")))) * 100.0 / 64).alias("percentage"))


@query(f"WITH {FRAMES_SQL}, v AS (SELECT DISTINCT video_id FROM frames) SELECT x.video_id AS a, y.video_id AS b FROM v x JOIN v y ON x.video_id < y.video_id")
def all_pairs_theta_join(spark, d):
    """Pairs need no hashes, so none are computed."""
    return S.id_pairs(table(spark, d, "embeddings").select(F.expr("vec_id div 5").alias("video_id")))


@query(f"WITH {CLOSE_SQL}, {IGNORED_SQL} SELECT a, b FROM near ANTI JOIN ignored USING (a, b)")
def anti_join_ignored_pairs(spark, d):
    """All close pairs of items, without those that are ignored."""
    own, pairs = close(spark, d)
    return S.without_pairs(pairs.select("a", "b"), ignored(spark, d, own))


@query(f"WITH {CLOSE_SQL} SELECT a, b, pos, sim FROM sims JOIN near USING (a, b)")
def frame_zip_similarity(spark, d):
    _, pairs = close(spark, d)
    return pairs.select("a", "b", F.posexplode(S.frame_similarities(F.col("hashes_a"), F.col("hashes_b"))).alias("pos", "sim")).withColumn("pos", F.col("pos") + 1)


@query(f"WITH {PLANTED_PAIRS_SQL}, near AS (SELECT DISTINCT a, b FROM sims WHERE sim >= 57 / 64.0::DOUBLE) SELECT a, b, CAST(count(*) AS BIGINT) AS frames, round(avg(sim), 9) AS mean FROM kept JOIN near USING (a, b) GROUP BY a, b")
def mad_outlier_filter(spark, d):
    _, pairs = close(spark, d)
    kept = S.without_outliers(pairs.select("a", "b", S.frame_similarities(F.col("hashes_a"), F.col("hashes_b")).alias("s")), "s", "k")
    return kept.select("a", "b", F.size("k").cast("long").alias("frames"), F.round(S.mean_of(F.col("k")), 9).alias("mean"))


@query(f"""WITH {CLOSE_SQL} SELECT x.video_id AS a, y.video_id AS b, avg({SAME.format('x.bits', 'y.bits')} * 100 / 64.0::DOUBLE) >= 95 AS similar
  FROM near JOIN planted x ON x.video_id = a JOIN planted y ON y.video_id = b AND y.pos = x.pos GROUP BY 1, 2""")
def are_similar_strict(spark, d):
    """All frames, equal numbers of frames, mean percentage of equal bits of at least 95."""
    _, pairs = close(spark, d)
    percent = F.zip_with("hashes_a", "hashes_b", lambda x, y: S.hamming_similarity(x, y) * 100)
    same = F.size("hashes_a") == F.size("hashes_b")
    return pairs.select("a", "b", F.when(same, S.mean_of(percent) >= 95).otherwise(F.lit(False)).alias("similar"))


@query(f"WITH {PLANTED_PAIRS_SQL}, {SCORED_SQL} SELECT a, b, round(m * 100, 7) AS similarity, round(s, 9) AS spread FROM scored WHERE m >= 0.75::DOUBLE AND s <= 0.1::DOUBLE")
def radius_search(spark, d):
    """Items alike at a low threshold, 0.75: frames within 16 bits of each other meet in bands whose bits are flipped on both sides."""
    return S.near_duplicates(written(planted(spark, d), "planted"), similarity=0.75)


@query(NEAR_SQL)
def near_dup_video_pairs(spark, d):
    """Items that are alike at the default threshold, found by bands, without the ignored pairs.

    All pairs whose ids add up to a multiple of seven are ignored. Only those that were found can go, so the list is made of these: as a whole it is the square of the items.
    """
    found = written(S.near_duplicates(written(planted(spark, d), "planted")), "near")
    return S.without_pairs(found, in_any_order(found.where("(a + b) % 7 = 0").select("a", "b"))).orderBy(F.desc("similarity"), "a", "b")


@query(f"{NEAR_SQL} ORDER BY similarity DESC, a, b LIMIT 10")
def top_duplicates(spark, d):
    return near_dup_video_pairs(spark, d).orderBy(F.desc("similarity"), "a", "b").limit(10)


@query(f"""WITH {PLANTED_PAIRS_SQL}, {SCORED_SQL}, v AS (SELECT DISTINCT video_id AS v FROM planted), p AS (SELECT x.v AS a, y.v AS b FROM v x JOIN v y ON y.v - x.v = 1000000 OR y.v - x.v = 2000000 OR y.v - x.v = 3000000)
SELECT p.a, p.b, CASE WHEN p.a % 9 = 0 OR abs(p.a * 13 % 900 - p.b * 13 % 900) > 300 OR m IS NULL OR m < 0.9::DOUBLE OR s > 0.1::DOUBLE THEN 0 ELSE round(m * 100, 7) END AS similarity FROM p LEFT JOIN scored USING (a, b)""")
def compare_given_pairs(spark, d):
    """Items against their copies: 0 where hashing failed for one, durations are over five minutes apart, or they aren't alike."""
    v = F.col("video_id")
    own = planted(spark, d).select(v, F.when((v >= 1_000_000) | (v % 9 != 0), F.col("hashes")).alias("hashes"), (v * 13 % 900).alias("duration"))
    ends = own.select(v.alias("a"), F.explode(F.array(*[v + 1_000_000 * k for k in (1, 2, 3)])).alias("b"))
    pairs = ends.join(own.select(v.alias("b")), "b", "left_semi").select("a", "b")
    return S.compared(pairs, own, minutes=5)


@query(f"""WITH {FRAMES_SQL}, e AS (SELECT video_id, pos, bits FROM frames UNION ALL SELECT video_id + 1000000, pos, bits FROM frames), n AS (SELECT video_id, string_agg(array_to_string(bits, ''), ',' ORDER BY pos) AS h, count(*) AS n FROM e GROUP BY video_id)
  SELECT x.video_id AS a, y.video_id AS b, CAST(100 AS DOUBLE) AS similarity, CAST(0 AS DOUBLE) AS spread FROM n x JOIN n y ON x.h = y.h AND x.video_id < y.video_id WHERE x.n >= 5""")
def near_dup_blocked(spark, d):
    """Every item against a copy of the catalogue at the default threshold, met in bands only."""
    own = items(spark, d)
    copies = own.select((F.col("video_id") + 1_000_000).alias("video_id"), "hashes")
    return S.near_duplicates(own.unionByName(copies))


@query(f"WITH {FRAMES_SQL} SELECT video_id, string_agg(array_to_string(bits, ''), ',' ORDER BY pos) AS hashes FROM frames GROUP BY video_id")
def collect_ordered_frames(spark, d):
    return items(spark, d).select("video_id", F.array_join(F.transform("hashes", lambda h: F.lpad(F.bin(h), 64, "0")), ",").alias("hashes"))


@query(f"WITH {FRAMES_SQL}, v AS (SELECT DISTINCT video_id, video_id * 13 % 900 AS s FROM frames) SELECT x.video_id AS a, y.video_id AS b FROM v x JOIN v y ON x.video_id < y.video_id WHERE abs(x.s - y.s) <= 300")
def pair_duration_prefilter(spark, d):
    """Pairs at most five minutes apart: durations meet in buckets of that width and their neighbours."""
    v = frames(spark, d).select("video_id").distinct().withColumn("s", F.col("video_id") * 13 % 900).withColumn("k", F.expr("s div 300"))
    left = v.select(F.col("video_id").alias("a"), F.col("s").alias("s1"), F.explode(F.array(F.col("k") - 1, F.col("k"), F.col("k") + 1)).alias("k"))
    return left.join(v.select(F.col("video_id").alias("b"), F.col("s").alias("s2"), "k"), "k").where("a < b and abs(s1 - s2) <= 300").select("a", "b")


@query(f"WITH {FRAMES_SQL}, n AS (SELECT DISTINCT video_id FROM frames), {ALL_IGNORED_SQL} SELECT a, b FROM ignored UNION SELECT video_id, video_id + 1 FROM n")
def pair_set_union(spark, d):
    new = frames(spark, d).select((F.col("video_id") + 1).alias("a"), F.col("video_id").alias("b"))
    return S.canonical(all_ignored(spark, d).unionByName(new))


@query(f"""WITH RECURSIVE near AS ({NEAR_SQL.replace(' ANTI JOIN ignored USING (a, b)', '')}), e AS (SELECT a, b FROM near UNION SELECT b, a FROM near),
  r AS (SELECT a AS node, a AS seen FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen) SELECT node, min(seen) AS label FROM r GROUP BY node""")
def group_components(spark, d):
    """Beyond pairs: groups of near-duplicates that pairs link."""
    return S.near_groups(planted(spark, d))


@query("""WITH t AS (SELECT o_orderkey, o_orderkey % 8000 + 1 AS t FROM orders),
k AS (SELECT o_orderkey, t, least(10, t // 500) AS k FROM t),
raw AS (SELECT o_orderkey, t, CASE WHEN t < 1000 THEN [CAST(trunc(t * 0.1::DOUBLE) AS BIGINT), CAST(trunc(t * 0.3::DOUBLE) AS BIGINT), CAST(trunc(t * 0.5::DOUBLE) AS BIGINT), CAST(trunc(t * 0.7::DOUBLE) AS BIGINT), CAST(trunc(t * 0.9::DOUBLE) AS BIGINT)]
  ELSE list_transform(range(0, k), lambda i: CAST(i * t // k AS BIGINT)) END AS r FROM k),
c AS (SELECT o_orderkey, t, list_sort(list_distinct(list_transform(r, lambda i: greatest(0, least(i, t - 1))))) AS c FROM raw)
SELECT o_orderkey, t AS total, array_to_string(CASE WHEN len(c) < 3 THEN list_sort(list_distinct(list_concat(c, range(0, least(5, t))))) ELSE c END, ',') AS indices FROM c""")
def frame_index_sampling(spark, d):
    t = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 8000 + 1).alias("total"))
    return t.select("o_orderkey", "total", F.array_join(S.sampled_frames(F.col("total")).cast("array<string>"), ",").alias("indices"))


@query("SELECT o_orderkey, unnest(range(0, o_orderkey % 600 + 1, 60)) AS frame FROM orders")
def sample_every_nth(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.explode(F.sequence(F.lit(0).cast("long"), F.col("o_orderkey") % 600, F.lit(60).cast("long"))).alias("frame"))


@query("SELECT vec_id, x AS column_no, CAST(embedding[CAST(trunc(x * 64 / 10.0::DOUBLE) AS INTEGER) + 1] AS DOUBLE) AS level FROM embeddings, (SELECT CAST(unnest(range(0, 10)) AS INTEGER) AS x)")
def downsample_stride(spark, d):
    e = table(spark, d, "embeddings")
    at = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda x: F.get("embedding", (x * F.size("embedding") / 10.0).cast("int")).cast("double"))
    return e.select("vec_id", F.posexplode(at).alias("column_no", "level"))


@query("""SELECT o_orderkey, CAST(trunc(o_orderkey % 641 / 640.0::DOUBLE * t) AS BIGINT) AS frame, CASE WHEN t = 0 THEN 0 ELSE CAST(trunc(f / CAST(t AS DOUBLE) * 640) AS BIGINT) END AS pixel
  FROM (SELECT o_orderkey, o_orderkey % 5 * 700 AS t, o_orderkey % 311 AS f FROM orders)""")
def linear_rescale(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 5 * 700).alias("t"), (F.col("o_orderkey") % 311).alias("f"))
    frame = ((F.col("o_orderkey") % 641) / F.lit(640.0) * F.col("t")).cast("long")
    pixel = F.when(F.col("t") == 0, F.lit(0).cast("long")).otherwise((F.try_divide(F.col("f").cast("double"), F.col("t").cast("double")) * 640).cast("long"))
    return o.select("o_orderkey", frame.alias("frame"), pixel.alias("pixel"))


@query("""WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN -1 ELSE o_orderkey % 9000 END AS said, o_orderkey % 250 AS readable, o_orderkey % 61 AS fps FROM orders)
SELECT o_orderkey, CASE WHEN said > 0 THEN said WHEN readable > 0 THEN least(readable, 100) END AS total, CASE WHEN said > 0 OR readable > 0 THEN CASE WHEN said > 0 THEN said ELSE least(readable, 100) END / CAST(CASE WHEN fps = 0 THEN 30 ELSE fps END AS DOUBLE) END AS duration FROM t""")
def frame_count_estimate(spark, d):
    """Frames by the header, or as many of the first hundred as can be read; null if none can."""
    n = F.col("o_orderkey")
    said, readable, fps = F.when(n % 5 == 0, -1).otherwise(n % 9000), n % 250, n % 61
    total = pixels.frame_count(said, readable)
    return table(spark, d, "orders").select("o_orderkey", total.alias("total"), pixels.duration(total, fps).alias("duration"))


PIXELS_SQL = """px AS (SELECT vec_id, r, c, greatest(0, least(255, CAST(floor(128 + 40 * CAST(embedding[(r // 4) * 8 + c // 4 + 1] AS DOUBLE)) AS INTEGER))) AS v FROM embeddings, (SELECT unnest(range(0, 32)) AS r) a, (SELECT unnest(range(0, 32)) AS c) b)"""


@query(f"""WITH {PIXELS_SQL}, k AS (SELECT i, j, w FROM (VALUES (0, -1, 0.25::DOUBLE), (0, 0, 0.5::DOUBLE), (0, 1, 0.25::DOUBLE)) AS t(i, j, w)),
across AS (SELECT vec_id, r, c, sum(w * v) AS v FROM (SELECT p.vec_id, p.r, abs(CASE WHEN p.c + k.j = 32 THEN 30 ELSE p.c + k.j END) AS s, p.c, k.w, q.v FROM px p, k JOIN px q ON q.vec_id = p.vec_id AND q.r = p.r AND q.c = abs(CASE WHEN p.c + k.j = 32 THEN 30 ELSE p.c + k.j END)) GROUP BY vec_id, r, c),
smooth AS (SELECT p.vec_id, p.r, p.c, round_even(sum(k.w * q.v), 0) AS v FROM across p, k JOIN across q ON q.vec_id = p.vec_id AND q.c = p.c AND q.r = abs(CASE WHEN p.r + k.j = 32 THEN 30 ELSE p.r + k.j END) GROUP BY p.vec_id, p.r, p.c),
f AS (SELECT unnest(range(0, 8)) AS f), cs AS (SELECT f, x, cos(pi() * f * (2 * x + 1) / 64) * sqrt(2 / 32.0::DOUBLE) / CASE WHEN f = 0 THEN sqrt(2::DOUBLE) ELSE 1 END AS w FROM f, (SELECT unnest(range(0, 32)) AS x)),
rows_ AS (SELECT vec_id, f, c, sum(cs.w * v) AS v FROM smooth JOIN cs ON cs.x = r GROUP BY vec_id, f, c),
dct AS (SELECT vec_id, rows_.f AS f, cs.f AS g, sum(cs.w * v) AS v FROM rows_ JOIN cs ON cs.x = c GROUP BY vec_id, rows_.f, cs.f),
m AS (SELECT vec_id, median(v) AS m FROM dct GROUP BY vec_id)
SELECT vec_id, string_agg(CASE WHEN v > m THEN '1' ELSE '0' END, '' ORDER BY f, g) AS bits FROM dct JOIN m USING (vec_id) GROUP BY vec_id""")
def pixel_frame_hash(spark, d):
    """Hashes of decoded gray frames, 32 pixels square, whose shades are the embeddings' components in blocks of four by four."""
    e = table(spark, d, "embeddings")
    shade = F.transform("embedding", lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(128 + 40 * x.cast("double")).cast("int"))))
    line = F.transform(F.sequence(F.lit(0), F.lit(1023)), lambda i: F.lpad(F.hex(F.get(F.col("s"), (F.floor(i / 128) * 8 + F.floor(i % 32 / 4)).cast("int"))), 2, "0"))
    drawn = S.settled(e, ["vec_id"], s=shade).select("vec_id", F.unhex(F.array_join(line, "")).alias("data"))
    frames = drawn.select(F.col("vec_id").cast("string").alias("path"), F.lit(0).alias("pos"), F.lit(32).alias("height"), F.lit(32).alias("width"), "data")
    blocks = pixels.frame_blocks(frames).select(F.col("path").cast("long").alias("vec_id"), "embedding")
    return S.frame_hashes(blocks).select("vec_id", F.lpad(F.bin("h"), 64, "0").alias("bits"))
