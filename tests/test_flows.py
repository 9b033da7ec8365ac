"""Films, caches, intervals, sinks, work lists, deadlines, metrics and streams with state."""

import json
import random
import threading
import time
from itertools import pairwise

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.operators import batches, caches, intervals, metrics, similarity, validation, work
from frameloom.sources import frames
from frameloom.streaming import logs, scenes, stacks


def y4m(shades, chroma="C420", line=b"FRAME\n", head=b"YUV4MPEG2 W8 H4 F25:1 "):
    planes = {"C420": 16, "Cmono": 0}[chroma]
    return head + chroma.encode() + b"\n" + b"".join(line + bytes([s % 256]) * 32 + bytes(planes) for s in shades)


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    for name, data in {
        "a": y4m(range(50)), "sub/mono": y4m(range(3), "Cmono"), "cut": y4m(range(2))[:-20], "none": b"x", "empty": y4m([]), "long": y4m(range(1200), "Cmono"), "odd": y4m(range(20), line=b"FRAME Ip\n"),
    }.items():
        (tmp_path / f"{name}.y4m").write_bytes(data)
    return tmp_path


def test_films_are_read_by_seeking(spark, folder):
    got = frames.films(spark, str(folder)).collect()
    by = {}
    for r in got:
        by.setdefault(r.path.rpartition("/")[2], []).append(r)
    assert {k: [r.frame for r in sorted(v, key=lambda r: r.pos)] for k, v in by.items()} == {
        "a.y4m": [5, 15, 25, 35, 45], "mono.y4m": [0, 1, 2], "cut.y4m": [0], "long.y4m": [0, 1, 2, 3, 4, 600], "odd.y4m": [2, 6, 10, 14, 18],
    }
    assert all(r.data == bytes([r.frame % 256]) * 32 and (r.height, r.width) == (4, 8) for r in got)
    assert {r.duration for r in by["a.y4m"]} == {2.0}
    size = (folder / "long.y4m").stat().st_size
    assert max(r.bytes_read for r in by["long.y4m"]) < 600 < size / 50  # six frames and the header


def test_films_in_ranges(spark, folder):
    """All frames once, whatever the bytes of a partition; files that are cut into ranges are read by several tasks."""
    for split in (200, 3000, 10**9):
        read = frames.films(spark, str(folder), frames="all", split=split)
        got = read.collect()
        assert sorted((r.path.rpartition("/")[2], r.frame) for r in got) == sorted(
            [("a.y4m", i) for i in range(50)] + [("mono.y4m", i) for i in range(3)] + [("cut.y4m", 0)] + [("long.y4m", i) for i in range(1200)] + [("odd.y4m", i) for i in range(20)])
        assert all(r.data[0] == r.frame % 256 for r in got)
    assert frames.films(spark, str(folder), frames="all", split=3000).rdd.getNumPartitions() > 10


def test_many_films_are_few_partitions(tmp_path):
    """Bytes of a partition that suit one film don't make a task or two of each of many."""
    for i in range(400):
        (tmp_path / f"{i}.y4m").write_bytes(b"YUV4MPEG2 W2 H2 F25:1 Cmono\n" + b"FRAME\n1234" * 20)
    parts = frames.FilmReader({"path": str(tmp_path), "frames": "all", "split": "150", "opencost": "0"}).partitions()
    assert len(parts) < 20 and sum(len(p.places) for p in parts) == 400


def test_films_with_pictures_that_stay(spark, tmp_path):
    rows = [(f"{tmp_path}/x.y4m", 0, 1, 2, b"ab", 3), (f"{tmp_path}/x.y4m", 3, 1, 2, b"cd", 2)]
    made = frames.write_films(spark.createDataFrame(rows, "path string, frame int, height int, width int, data binary, times int")).first()
    got = sorted((r.frame, bytes(r.data)) for r in frames.films(spark, str(tmp_path), frames="all").collect())
    assert made["frames"] == 5 and got == [(0, b"ab"), (1, b"ab"), (2, b"ab"), (3, b"cd"), (4, b"cd")]


def test_packed_films(spark, tmp_path):
    """Films packed take little of the disk, give the same frames, and go into few partitions."""
    pictures = {p: [bytes((p * j + k) % 251 for k in range(64 * 64)) for j in range(3)] for p in range(40)}
    rows = [(f"{tmp_path}/x/{p}.y4m.zst", 20 * j, 64, 64, data, 20) for p, of in pictures.items() for j, data in enumerate(of)]
    made = frames.write_films(spark.createDataFrame(rows, "path string, frame int, height int, width int, data binary, times int")).collect()
    on_disk = {p.name: p.stat().st_size for p in (tmp_path / "x").iterdir()}
    assert len(on_disk) == 40 and {r.path.rpartition("/")[2]: r.bytes for r in made} == on_disk
    assert {r.frames for r in made} == {60} and max(on_disk.values()) < 60 * 64 * 64 / 10
    read = frames.films(spark, str(tmp_path / "x"), frames="all", split=65_536)
    got = sorted((int(r.path.rpartition("/")[2].split(".")[0]), r.frame, r.duration, bytes(r.data)) for r in read.collect())
    assert got == [(p, i, 2.4, pictures[p][i // 20]) for p in range(40) for i in range(60)]
    assert read.rdd.getNumPartitions() <= 20
    assert sorted(r.frame for r in frames.films(spark, str(tmp_path / "x")).where("path like '%/7.y4m.zst'").collect()) == [6, 18, 30, 42, 54]


def test_films_written_and_read(spark, tmp_path):
    rows = [(f"{tmp_path}/x/{p}.y4m", i, 2, 3, bytes([p * 10 + i] * 6)) for p in range(4) for i in range(7)]
    random.Random(1).shuffle(rows)
    made = frames.write_films(spark.createDataFrame(rows, "path string, frame int, height int, width int, data binary"))
    assert sorted((r.path, r.frames) for r in made.collect()) == [(f"{tmp_path}/x/{p}.y4m", 7) for p in range(4)]
    got = frames.films(spark, str(tmp_path / "x"), frames="all").collect()
    assert sorted((int(r.path[-5]), r.frame, r.data) for r in got) == sorted((int(r[0][-5]), r[1], r[4]) for r in rows)
    assert [p.name for p in (tmp_path / "x").iterdir() if p.suffix == ".part"] == []


def test_only_misses_are_decoded(spark, folder):
    seen = spark.sparkContext.accumulator(0)

    def compute(missed):
        def count(rows):
            for batch in rows:
                seen.add(batch.num_rows)
                yield batch

        found = frames.decoded_frames(missed.mapInArrow(count, "path string"))
        return found.groupBy("path").agg(F.count("*").alias("found"))

    a, mono, cut, none = (str(folder / f"{n}.y4m") for n in ("a", "sub/mono", "cut", "none"))
    listing = spark.createDataFrame([(a, 10.0), (mono, 10.0), (cut, 10.0), (none, 10.0)], "path string, modified double")
    cache = spark.createDataFrame([(a, 10.0, 77), (mono, 9.0, 88), ("gone", 1.0, 99)], "path string, last_modified double, found long")
    result, merged = caches.cached_or_computed(listing, cache, "path", compute)
    assert {r.path: (r.found, r.computed) for r in result.collect()} == {a: (77, False), mono: (3, True), cut: (1, True), none: (None, True)}
    assert seen.value == 3
    assert {r.path: (r.found, r.last_modified) for r in merged.collect()} == {a: (77, 10.0), mono: (3, 10.0), cut: (1, 10.0), "gone": (99, 1.0)}
    again, _ = caches.cached_or_computed(listing, merged, "path", compute)
    assert again.where("computed").count() == 1  # the one that can't be decoded
    assert seen.value == 4


def loop_cuts(pictures, threshold, shortest):
    out, begin = [], 0
    for i, (a, b) in enumerate(pairwise(pictures), 1):
        if frames.change(a, b) >= threshold and i - begin >= shortest:
            out.append(i)
            begin = i
    return out


def test_scenes_equal_a_loop(spark, tmp_path):
    """Whole films, and films whose frames come in three batches, cut within a scene."""
    rng = np.random.default_rng(3)
    films = {}
    for p in range(6):
        shots = [np.full((6, 8), rng.integers(0, 256), np.uint8) for _ in range(9)]
        films[f"f{p}"] = [s.tobytes() for s in shots for _ in range(rng.integers(3, 30))]
    rows = [(p, i, 6, 8, d) for p, shown in films.items() for i, d in enumerate(shown)]
    pictures = frames.small_pictures(spark.createDataFrame(rows, "path string, frame long, height int, width int, data binary"))
    small = {p: [r.picture for r in pictures.where(F.col("path") == p).orderBy("frame").collect()] for p in films}
    want = {p: loop_cuts(s, 30.0, 15) for p, s in small.items()}
    assert sum(map(len, want.values())) > 10
    found = frames.scenes(frames.scene_changes(pictures)).collect()
    assert {p: sorted(r["first"] for r in found if r.path == p)[1:] for p in films} == want
    assert {p: max(r["last"] for r in found if r.path == p) for p in films} == {p: len(s) - 1 for p, s in films.items()}
    for k, where in enumerate(("frame < 37", "frame >= 37 and frame < 80", "frame >= 70")):  # some come twice
        pictures.where(where).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = scenes.stream_cuts(spark.readStream.schema(pictures.schema).parquet(f"{tmp_path}/in"))
        stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
        assert k < 3
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert {p: sorted(r.frame for r in got if r.path == p) for p in films} == want


def test_intervals_equal_brute_force(spark):
    rng = random.Random(4)
    spans = [(k, i, b := rng.randint(-500, 500), b + rng.choice([-1, 0, 1, 7, 100, 900])) for i, k in enumerate(rng.choices([1, 2, None], [5, 1, 1], k=120))] + [(1, 120, None, 5), (1, 121, -(2**40), 2**40)]
    points = [(rng.choice([1, 2, 3, None]), rng.randint(-600, 1000)) for _ in range(300)]
    want = {}
    for key, at in set(points):
        holds = [s for s in spans if key is not None and s[0] == key and s[2] is not None and s[2] <= at <= s[3]]
        if holds:
            want[key, at] = min(holds, key=lambda s: s[1])[1:]
    got = intervals.first_covering(spark.createDataFrame(points, "k long, at long"), spark.createDataFrame(spans, "k long, place long, begin long, finish long"), "k", "at", "begin", "finish", "place").collect()
    assert {(r.k, r.at): (r.place, r.begin, r.finish) for r in got} == want
    nothing = intervals.first_covering(spark.createDataFrame([], "k long, at long"), spark.createDataFrame([], "k long, place long, begin long, finish long"), "k", "at", "begin", "finish", "place")
    assert nothing.collect() == []


def test_keys_of_frames_are_not_broadcast(spark):
    """Keys are many times the frames that Spark knows the size of; at no radius has a frame thousands of them."""
    df = spark.createDataFrame([(i, [i] * 5) for i in range(20)], "video_id long, hashes array<long>")
    for most in (6, 7, 16, 25):
        bands, near, far = similarity.band_plan(most)
        assert (most // bands) == near + far and bands * sum(len(similarity.masks(64 // bands + 1, k)) for k in (near, far)) < 200
        plan = similarity.close_pairs(df, most)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_close_pairs_equal_brute_force(spark):
    rng = random.Random(7)
    base = [[rng.getrandbits(64) for _ in range(6)] for _ in range(25)]
    items = dict(enumerate(base))
    for i in range(60):
        turned = [h ^ sum(1 << b for b in rng.sample(range(64), rng.choice([0, 3, 7, 12, 16, 17, 25]))) for h in rng.choice(base)]
        items[100 + i] = turned[: rng.choice([6, 5, 3])]
    df = spark.createDataFrame([(k, [h - (1 << 64) if h >> 63 else h for h in v]) for k, v in items.items()], "video_id long, hashes array<long>")
    for most in (0, 3, 7, 9, 16):
        want = {(a, b) for a in items for b in items if a < b and any((items[a][p] ^ items[b][p]).bit_count() <= most for p in range(1, min(len(items[a]), len(items[b])) - 1))}
        assert {tuple(r) for r in similarity.close_pairs(df, most).collect()} == want
    at_three_quarters = similarity.near_duplicates(df, similarity=0.75)
    every = similarity.score_pairs(similarity.all_pairs(df), 0.75)
    key = lambda r: (r.a, r.b, r.similarity)
    assert sorted(map(key, at_three_quarters.collect())) == sorted(map(key, every.collect()))
    assert "NestedLoop" not in at_three_quarters._jdf.queryExecution().executedPlan().toString()


def test_repeated_batches_are_written_once(spark, tmp_path):
    record = spark.createDataFrame([("2024-01-01T00:00:00", "ERROR", "app", "broken", None)], "timestamp string, level string, logger string, message string, exception string")
    for number in (0, 1, 1, 0):
        logs.write_batch(record, number, str(tmp_path))
    assert {s: spark.read.text(str(tmp_path / s)).count() for s in logs.SINKS} == dict.fromkeys(logs.SINKS, 2)
    assert json.loads(spark.read.text(str(tmp_path / "json")).first()[0]) == {"timestamp": "2024-01-01T00:00:00", "level": "ERROR", "logger": "app", "message": "broken"}
    for number in range(2, 6):
        logs.write_batch(record, number, str(tmp_path), limits={"text": 100})
    kept = sorted(p.name for p in (tmp_path / "text").iterdir())
    assert kept[-1] == "batch=5" and "batch=0" not in kept


def test_empty_batch_has_one_error(spark):
    row = spark.createDataFrame([(0, 0), (3, 0), (1001, 5)], "files long, valid long")
    got = [r[0] for r in row.select(validation.batch_check(F.col("files"), F.col("valid"))).collect()]
    assert got == [["no file"], ["no valid file"], ["too many files (1001 > 1000)"]]


def test_hanging_items_cost_their_limit(spark):
    import os

    def f(text):
        if text == "3":
            time.sleep(600)
        if text == "5":
            os._exit(1)
        if text == "6":
            raise KeyError("six")
        return int(text) * 2

    items = spark.range(8).select(F.col("id").alias("k"), F.col("id").cast("string").alias("t")).coalesce(1)
    began = time.time()
    got = {r.k: (r.ok, r.value, r.error) for r in batches.mapped_within(items, "k", "t", f, seconds=1.0).collect()}
    assert time.time() - began < 60
    assert got[3] == (False, None, "TimeoutError: over 1 s")
    assert got[5][:2] == (False, None) and got[5][2].startswith(("ChildProcessError", "TimeoutError"))
    assert got[6] == (False, None, "KeyError: 'six'")
    assert [got[k] for k in (0, 1, 2, 4, 7)] == [(True, str(2 * k), None) for k in (0, 1, 2, 4, 7)]


def test_limits_pass_side_by_side(spark):
    """Many items that hang cost a task few limits, and one that is done late is an error all the same."""

    def f(x):
        time.sleep(3600 if int(x) % 2 else 1.3 if x == "0" else 0)
        return x

    items = spark.range(60).select(F.col("id").alias("k"), F.col("id").cast("string").alias("t")).coalesce(1)
    began = time.time()
    got = {r.k: (r.ok, r.value, r.error) for r in batches.mapped_within(items, "k", "t", f, seconds=1.0).collect()}
    assert time.time() - began < 15
    late = (False, None, "TimeoutError: over 1 s")
    assert got == {k: late if k % 2 or k == 0 else (True, str(k), None) for k in range(60)}


def test_handlers_by_type(spark):
    items = spark.createDataFrame([(1, "1"), (2, "0"), (3, "x"), (4, None)], "k long, t string")
    handlers = {ZeroDivisionError: lambda x, e: f"zero of {x}", ArithmeticError: lambda x, e: "unused", TypeError: lambda x, e: 1 // 0}
    got = {r.k: (r.ok, r.value, (r.error or "").partition(":")[0]) for r in batches.mapped(items, "k", "t", lambda x: 1 // int(x), handlers=handlers).collect()}
    assert got == {1: (True, "1", ""), 2: (False, "zero of 0", "ZeroDivisionError"), 3: (False, None, "ValueError"), 4: (False, None, "TypeError")}


def test_work_list_is_cancelled_and_taken_up(spark, tmp_path):
    def slow(rows):
        def run(batches):
            for batch in batches:
                time.sleep(0.3)
                yield batch

        return rows.mapInArrow(run, "k long")

    items = spark.range(40).withColumnRenamed("id", "k")
    todo = work.WorkList(spark, f"{tmp_path}/work", "k", slow, slices=6)
    threading.Timer(2.0, todo.cancel).start()
    whole = todo.run(items)
    done = todo.finished()
    if not whole:
        assert len(done) < 6
        left = work.left_over(items, todo.results("k long"), "k").count()
        assert left == 40 - todo.results("k long").count()
    assert todo.run(items)
    got = todo.results("k long")
    assert sorted(r.k for r in got.collect()) == list(range(40))
    assert set(done) <= set(todo.finished()) == set(range(6))
    stopped = work.WorkList(spark, f"{tmp_path}/other", "k", lambda r: r, slices=4)
    assert not stopped.run(items, most=1)
    assert stopped.finished() == [0]
    assert work.WorkList(spark, f"{tmp_path}/none", "k", lambda r: r).results("k long").columns == ["k", "slice"]


def test_extensions_that_fail_stop_no_others():
    from frameloom.plans import extensions

    found = batches.Transforms()
    assert found.discover_package(extensions) == {"plain": "no transforms"}
    assert sorted(found.known) == ["costly", "late_minutes", "purchases"]


def test_metrics_equal_the_result(spark, tmp_path):
    rows = spark.range(100).select("id", (F.col("id") % 7 == 0).alias("bad"))
    got = metrics.observed([("all", rows, F.col("bad")), ("none", rows.where("id < 0"), F.col("bad"))], lambda name, df: df.write.parquet(f"{tmp_path}/{name}")).collect()
    assert [tuple(r) for r in got] == [("all", 100, 15, 0.15), ("none", 0, 0, None)]
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    table = metrics.observed_stream(stream, "seen", F.col("bad"), lambda df: df.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()).collect()
    assert sum(r.n_rows for r in table) == sum(r.input_rows for r in table) == 100
    assert sum(r.errors for r in table) == 15


def test_idle_keys_are_forgotten(spark):
    schema = "key long, ts long, position long, op string, state string"
    first = spark.createDataFrame([(1, 1, 1, "set", "a"), (1, 2, 2, "push", "b"), (2, 1, 3, "push", "c")], schema)
    later = spark.createDataFrame([(2, 2, 4, "pop", None)], schema)
    last = spark.createDataFrame([(1, 3, 5, "pop", None)], schema)
    got = stacks.stacked_batches(spark, [first, later], "idle").orderBy("position").collect()
    assert [tuple(r) for r in got] == [(1, 1, "a", 0), (1, 2, "b", 1), (2, 3, "c", 1), (2, 4, "idle", 0)]
    got = [tuple(r) for r in stacks.stacked_batches(spark, [first, later, last], "idle", idle_seconds=0.001).collect()]
    assert (1, None, "expired", 0) in got
    assert (1, 5, "idle", 0) in got  # it begins anew


def test_a_known_key_costs_few_messages_of_state():
    """Each is a round trip to the JVM: a get, an update, and two of the timer, for a key with nothing below."""
    from pyspark.sql import Row

    calls, held = [], {}

    class State:
        def __init__(self, name):
            self.name = name

        def __getattr__(self, call):
            def said(*value):
                calls.append(call)
                if call in ("update", "put"):
                    held[self.name] = value[0]
                return held.get(self.name)

            return said

    class Handle(State):
        def getValueState(self, name, schema):
            return State(name)

        getListState = getValueState

    class Times:
        def getCurrentProcessingTimeInMs(self):
            return 1000

    stack = stacks.Stack("idle", 60.0)
    stack.init(Handle("handle"))
    rows = [Row(key=1, ts=2, position=2, op="set", state="b"), Row(key=1, ts=1, position=1, op="pop", state=None)]
    assert [tuple(r) for r in stack.handleInputRows((1,), iter(rows), Times())] == [(1, 1, "idle", 0), (1, 2, "b", 0)]
    calls.clear()
    assert [tuple(r) for r in stack.handleInputRows((1,), iter([Row(key=1, ts=3, position=3, op="pop", state=None)]), Times())] == [(1, 3, "b", 0)]
    assert sorted(calls) == ["deleteTimer", "get", "registerTimer", "update"]
