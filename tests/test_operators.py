import random

import pytest
from pyspark.sql import functions as F

from frameloom.functions import scalars as X
from frameloom.operators import batches, catalog, conversion, similarity, validation
from frameloom.sources.scratch import written


@pytest.mark.parametrize(("size", "text"), [(1023, "1023.0 B"), (1024, "1.0 KB"), (1536, "1.5 KB"), (1024**4, "1.0 TB"), (1280, "1.2 KB"), (1024**6, "1048576.0 TB")])
def test_format_size(spark, size, text):
    assert spark.range(1).select(X.format_size(F.lit(size))).first()[0] == text


@pytest.mark.parametrize(("seconds", "text"), [(59.9, "00:59"), (60.0, "01:00"), (3725.0, "62:05")])
def test_format_mmss(spark, seconds, text):
    assert spark.range(1).select(X.format_mmss(F.lit(seconds))).first()[0] == text


@pytest.mark.parametrize(("path", "stem", "ext"), [(".hidden", ".hidden", ""), ("a.tar.gz", "a.tar", ".gz"), ("/x.y/name", "name", ""), ("..a.b", "..a", ".b")])
def test_splitext(spark, path, stem, ext):
    assert tuple(spark.range(1).select(X.stem(F.lit(path)), X.extension(F.lit(path))).first()) == (stem, ext)


@pytest.mark.parametrize(("total", "indices"), [(1000, [0, 1, 2, 3, 4, 500]), (1500, [0, 500, 1000]), (4, [0, 1, 2, 3]), (90, [9, 27, 45, 62, 81])])
def test_sampled_frames(spark, total, indices):
    assert spark.range(1).select(similarity.sampled_frames(F.lit(total))).first()[0] == indices


def hashed(similarities, flips=64):
    """Two items whose interior frames have these similarities, in 64ths."""
    a = [0] * (len(similarities) + 2)
    b = [0] + [(1 << (flips - s)) - 1 if s < 64 else 0 for s in similarities] + [-1]
    return a, [x - (1 << 64) if x >= 1 << 63 else x for x in b]


@pytest.mark.parametrize(
    ("sims", "expected"),
    [([64, 60, 58], True), ([64, 63, 32], False), ([64, 64, 32], False), ([64, 64], False), ([64, 64, 64], True)],
)
def test_pair_rules(spark, sims, expected):
    """Accepted; an outlier leaves two; a MAD of 0 keeps it and the mean is low; too few frames; copies."""
    a, b = hashed(sims)
    pairs = spark.createDataFrame([(1, 2, a, b)], "a long, b long, hashes_a array<long>, hashes_b array<long>")
    assert similarity.score_pairs(pairs).count() == int(expected)


def test_blocked_pairs_lose_none(spark):
    import random

    rng = random.Random(5)
    items = []
    for i in range(60):
        base = [rng.getrandbits(64) - (1 << 63) for _ in range(6)] if i % 3 == 0 else [h ^ (1 << rng.randrange(62)) ^ (1 << rng.randrange(62)) for h in items[-1][1]]
        items.append((i, base))
    df = spark.createDataFrame(items, "video_id long, hashes array<long>")
    whole = similarity.score_pairs(similarity.all_pairs(df)).collect()
    assert whole
    assert sorted(whole) == sorted(similarity.score_pairs(similarity.blocked_pairs(df)).collect())


def test_statistics_of_nothing(spark):
    none = spark.createDataFrame([], "before double, after double, attempts int, success boolean")
    assert tuple(conversion.statistics(none).first()) == (0.0, 0.0, 0.0, 0.0)


def test_urls_and_patterns(spark):
    rows = spark.createDataFrame([("http://a/b",), ("gopher:x",), ("http:///x",), ("text",)], "u string")
    assert [r[0] for r in rows.select(F.coalesce(validation.valid_url(F.col("u")), F.lit(False))).collect()] == [True, False, False, False]


def test_stream_segments_equal_batch(spark, tmp_path):
    from frameloom.plans import progress as P
    from frameloom.streaming.progress import stream_segments

    sf = "/root/testdata/sf0.001"
    P.commands(spark, sf).select("user_id", "ts", F.col("event_id").alias("position"), "command").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user_id long, ts timestamp_ntz, position long, command string").parquet(str(tmp_path / "in"))
    query = stream_segments(stream).writeStream.format("memory").queryName("segments_test").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(tuple, spark.table("segments_test").collect())) == sorted(map(tuple, P.segments(spark, sf).collect()))


def test_log_sinks(spark, tmp_path):
    from frameloom.streaming import logs

    spark.createDataFrame([("DEBUG",), ("ERROR",), ("INFO",)], "level string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("level string").parquet(str(tmp_path / "in"))
    logs.write_sinks(stream, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    assert {s: spark.read.text(str(tmp_path / "out" / s)).count() for s in logs.SINKS} == {"console": 2, "text": 3, "json": 3, "errors": 1}


def test_component_labels_of_long_chains(spark):
    ids = list(range(1, 401))
    random.Random(6).shuffle(ids)
    edges = [*zip(ids, ids[1:], strict=False), (1002, 1001), (1001, 1002), (1003, 1003)]
    got = similarity.component_labels(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted((r["node"], r["label"]) for r in got) == [*((i, 1) for i in sorted(ids)), (1001, 1001), (1002, 1001), (1003, 1003)]
    assert not similarity.component_labels(spark.createDataFrame([], "a long, b long")).count()


def names_one_by_one(existing, wanted):
    taken, out = set(existing), []
    for target, ext in wanted:
        name, k = target + ext, 0
        while name in taken:
            k += 1
            name = f"{target} ({k}){ext}"
        taken.add(name)
        out.append(name)
    return out


def test_names_are_unique(spark):
    rng = random.Random(8)
    cases = [([], ["a", "a", "a (1)"]), ([], ["a (1)", "a", "a", "a (1)"]), (["a", "a (2)"], ["a"] * 4), ([], ["b"] * 5), (["c (1)"], ["c (1)", "c", "c"])]
    for _ in range(25):
        pool = ["t", "t (1)", "t (2)", "t (1) (1)", "u", "u (0)", "v"]
        cases.append((rng.sample(pool, rng.randint(0, 3)), [rng.choice(pool) for _ in range(rng.randint(1, 12))]))
    wanted, existing, expected = [], [], {}
    for i, (held, asked) in enumerate(cases):
        names = names_one_by_one([f"/{i}/{h}.x" for h in held], [(f"/{i}/{t}", ".x") for t in asked])
        existing += [(f"/{i}/{h}", ".x") for h in held]
        for t, name in zip(asked, names, strict=True):
            expected[len(wanted)] = name
            wanted.append((len(wanted), f"/{i}/{t}", ".x"))
    got = catalog.unique_names(spark.createDataFrame(wanted, "k long, target string, ext string"), "k", spark.createDataFrame(existing, "target string, ext string"))
    assert {r["k"]: r["name"] for r in got.collect()} == expected


def test_names_where_a_join_becomes_a_broadcast(spark):
    """Only at run time the joins by root turn out small; requests of a root must meet its taken names all the same."""
    rows = spark.range(0, 4000, 1, 8).select(F.col("id").alias("k"), F.concat(F.lit("/dst/"), (F.col("id") % 5).cast("string")).alias("target"), F.lit(".x").alias("ext"))
    asked = written(rows, "asked")
    held = asked.where("k < 10").select(F.concat("target", F.when(F.col("k") < 5, "").otherwise(" (2)")).alias("target"), "ext").distinct()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "8KB")
    try:
        got = {r["k"]: r["name"] for r in catalog.unique_names(asked, "k", held).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    numbers = [n for n in range(900) if n not in (0, 2)]
    assert got == {k: f"/dst/{k % 5} ({numbers[k // 5]}).x" for k in range(4000)}


def test_numbers_across_spans(spark):
    rows = spark.createDataFrame([(k % 3 if k % 3 else None, k * 7) for k in range(200)], "g int, k long")
    got = catalog.numbered(rows, ["g"], "k", span=50).collect()
    for g in (None, 1, 2):
        assert [r["n"] for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["k"])] == list(range(1, len([r for r in got if r["g"] == g]) + 1))


@pytest.mark.parametrize(("rows", "ok"), [(["h264", None, "h264"], False), (["h264", "h264"], True), (["h264"], False), (["h264", "vp9"], False), ([None, None], True)])
def test_compatible_like_first(spark, rows, ok):
    df = spark.createDataFrame([("g", c) for c in rows], "g string, codec string")
    assert catalog.all_like_first(df, ["g"], "codec").first()["compatible"] is ok
    probed = df.withColumn("probed", F.col("codec").isNotNull())
    assert catalog.all_like_first(probed, ["g"], "codec", probed="probed").first()["compatible"] is (ok and None not in rows)


@pytest.mark.parametrize(("ending", "ok"), [(e, True) for e in (".mp4", ".avi", ".mkv", ".mov", ".wmv", ".flv", ".webm", ".m4v", ".3gp", ".ogv", ".ts", ".m2ts", ".MTS")] + [(e, False) for e in (".mpg", ".mpeg", ".txt", "")])
def test_file_formats(spark, ending, ok):
    verdict = validation.file_check(F.lit(True), F.lit(True), F.lit(ending), F.lit(5), validation.mime_of(F.lit(ending)))
    assert spark.range(1).select(verdict).first()[0] == ("valid" if ok else "unsupported format")


@pytest.mark.parametrize(("video", "audio", "errors"), [("mpeg4", "flac", []), ("libx265", "libvorbis", []), ("copy", "opus", ["video codec", "audio codec"]), ("libvpx-vp9", "aac", []), ("h264", "mp3", ["video codec"])])
def test_codecs(spark, video, audio, errors):
    found = validation.parameter_errors(F.lit(51), F.lit(video), F.lit(audio), F.lit(None).cast("int"), F.lit(9999))
    assert spark.range(1).select(found).first()[0] == errors


def test_settings_of_broken_texts(spark):
    rows = spark.createDataFrame([("{",), (None,), ('{"crf": null}',), ('{"attempts": [{"crf": 1}]}',)], "t string").select(conversion.settings_of(F.col("t")).alias("s")).collect()
    usual = [(28, "medium"), (30, "slow"), (32, "veryslow")]
    assert [[tuple(a) for a in r.s.attempts] for r in rows] == [usual, usual, usual, [(1, "medium")]]
    assert all((r.s.crf, r.s.size_threshold, r.s.multiple_attempts) == (28, 104857600, True) for r in rows)


def test_mapped_cancels_late_items(spark):
    items = spark.createDataFrame([(1, "2"), (2, "x"), (3, None)], "k long, t string")
    got = {r.k: (r.ok, r.value) for r in batches.mapped(items, "k", "t", lambda x: int(x) * 2).collect()}
    assert got == {1: (True, "4"), 2: (False, None), 3: (False, None)}
    assert all(r.ok is None for r in batches.mapped(items, "k", "t", int, limit_seconds=-1).collect())


def test_groups_and_pairs_of_equal_items(spark):
    """Equal items, near copies of them, short ones and a chain, against all pairs."""
    rng, items = random.Random(9), []
    for i in range(40):
        base = [rng.getrandbits(64) - (1 << 63) for _ in range(6)] if i % 5 == 0 else list(items[-1][1])
        if i % 5 in (2, 4):
            base = [h ^ (1 << rng.randrange(62)) ^ (1 << rng.randrange(62)) ^ (1 << rng.randrange(62)) for h in base]
        items.append((i, base))
    items += [(100, [1, 2, 3]), (101, [1, 2, 3])]
    df = spark.createDataFrame(items, "video_id long, hashes array<long>")
    whole = sorted(map(tuple, similarity.score_pairs(similarity.all_pairs(df)).collect()))
    assert whole == sorted(map(tuple, similarity.near_duplicates(df).collect()))
    up = {i: i for i, _ in items}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b, *_ in whole:
        up[max(find(a), find(b))] = min(find(a), find(b))
    linked = {x for a, b, *_ in whole for x in (a, b)}
    assert {r.node: r.label for r in similarity.near_groups(df).collect()} == {x: find(x) for x in linked}


def test_sinks_expire_oldest_first():
    from frameloom.streaming import logs

    assert logs.expired([("c", 5), ("b", 5), ("a", 5)], 10) == ["a"]
    assert logs.expired([("c", 50)], 10) == []
