import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.operators import similarity
from frameloom.sources import documents as D
from frameloom.sources import frames


def put(path, value):
    path.write_text(value if isinstance(value, str) else json.dumps(value))
    return str(path)


def test_list_files(spark, tmp_path):
    for name in ("a.mp4", "sub/B.AVI", "sub/deep/c.mkv", "d.txt", ".e.mp4", ".hid/f.mp4"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("xy")
    found = D.list_files(spark, str(tmp_path))
    assert sorted((r.relative, r["size"]) for r in found.collect()) == [(".e.mp4", 2), (".hid/f.mp4", 2), ("a.mp4", 2), ("sub/B.AVI", 2), ("sub/deep/c.mkv", 2)]
    assert sorted(r.relative for r in D.list_files(spark, str(tmp_path), ignore_case=False, hidden=False).collect()) == ["a.mp4", "sub/deep/c.mkv"]
    assert D.list_files(spark, str(tmp_path), extensions=(".none",)).count() == 0
    assert "content" not in found.columns


@pytest.mark.parametrize(("main", "backup", "value"), [('{"a": 1}', '{"a": 2}', 1), ("{broken", '{"a": 2}', 2), (None, '{"a": 2}', 2), (None, None, None), ('{"a": 1}', "{broken", 1)])
def test_backup(spark, tmp_path, main, backup, value):
    for name, text in (("x.json", main), ("x.json.bak", backup)):
        if text is not None:
            put(tmp_path / name, text)
    got = D.document_or_backup(spark, str(tmp_path / "x.json"), "a int").first().value
    assert (got and got.a) == value


def test_both_broken(spark, tmp_path):
    path = put(tmp_path / "x.json", "{no")
    with pytest.raises(Exception, match="can't be read"):
        D.document_or_backup(spark, path, "struct<a: array<int>>").collect()


def test_hash_cache(spark, tmp_path):
    block = [[bool((r + c) % 2) for c in range(8)] for r in range(8)]
    path = put(tmp_path / "h.json", {"pHash": {"/v": {"hash": [block, block], "duration": 2.5, "last_modified": 7.0, "frame_indices": [0, 30]}}})
    rows = D.hash_cache(spark, path).orderBy("frame_pos").collect()
    assert [(r.method, r.path, r.frame_pos, r.frame_index, r.duration) for r in rows] == [("pHash", "/v", 0, 0, 2.5), ("pHash", "/v", 1, 30, 2.5)]
    assert rows[0].bits == [int(b) for r in block for b in r]
    assert D.hash_cache(spark, put(tmp_path / "bad.json", "{")).count() == D.hash_cache(spark, str(tmp_path / "none.json")).count() == 0


def test_small_documents(spark, tmp_path):
    pairs = D.ignored_pairs(spark, put(tmp_path / "p.json", [["b", "a"], ["a", "b"], ["c"], ["d", "d"]]))
    assert [tuple(r) for r in pairs.collect()] == [("a", "b")]
    named = D.patterns(spark, put(tmp_path / "r.json", [{"pattern": "x", "replace_with": "y", "enabled": True}, {"pattern": "z", "replace_with": "", "enabled": False}]))
    assert [tuple(r) for r in named.collect()] == [(0, "x", "y")]
    cut = D.frame_segments(spark, put(tmp_path / "s.json", {"segments": [{"start_frame": 3, "name": "n", "color": "red"}]}))
    assert [tuple(r) for r in cut.collect()] == [(3, None, "n", "red")]
    assert D.frame_segments(spark, str(tmp_path / "none.json")).count() == 0
    empty = D.project(spark, str(tmp_path / "none.json"), "/v.mp4").first()
    assert (empty.video_path, empty.segments, empty.metadata) == ("/v.mp4", [], {})
    assert D.project(spark, put(tmp_path / "q.json", {"video_path": "/w", "markers": [{"time": 1.5, "name": "m"}]}), "/v").first().markers[0].time == 1.5
    rows = D.with_defaults(spark.createDataFrame([(None,), (5,)], "crf int"), {"crf": 23, "preset": "medium"})
    assert sorted(map(tuple, rows.collect())) == [(5, "medium"), (23, "medium")]


def test_stats_are_all_or_none(spark, tmp_path):
    good = {"input_size": 10, "output_size": 4, "duration": 1.0, "attempt_count": 1, "params_used": {"crf": "28"}, "success": True, "date": "2024-01-01T00:00:00"}
    assert D.stats(spark, put(tmp_path / "a.json", [good, good])).agg(F.sum("output_size")).first()[0] == 8
    with pytest.raises(Exception, match=r"(?i)malformed|parse"):
        D.stats(spark, put(tmp_path / "b.json", [good, good | {"input_size": "many"}])).collect()


def test_save_document(spark, tmp_path):
    path = str(tmp_path / "x.json")
    for n in (1, 2):
        D.save_document(spark.range(1).select(F.lit(n).alias("a"), F.array(F.lit("é")).alias("b")), path)
    assert json.loads((tmp_path / "x.json").read_text()) == {"a": 2, "b": ["é"]}
    assert json.loads((tmp_path / "x.json.bak").read_text())["a"] == 1
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["x.json", "x.json.bak"]
    with pytest.raises(ValueError, match="one row"):
        D.save_document(spark.range(2), path)


def test_cache(spark, tmp_path):
    D.save_cache(spark.range(3), str(tmp_path / "c"))
    D.clear_cache(spark, str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).count() == 0


def test_frame_matrices():
    """Area means by hand, constants kept, and the transform against its definition."""
    assert np.allclose(frames.area_matrix(64) @ np.arange(64.0), np.arange(32) * 2 + 0.5)
    for n in (7, 32, 33, 720):
        assert np.allclose(frames.area_matrix(n).sum(axis=1), 1)
    assert np.allclose(frames.smooth_matrix() @ np.ones(32), 1)
    x = np.random.default_rng(1).integers(0, 256, (32, 32)).astype(float)
    k, l = 3, 5
    i, j = np.arange(32)[:, None], np.arange(32)
    slow = 2 / 32 * (x * np.cos(np.pi * k * (2 * i + 1) / 64) * np.cos(np.pi * l * (2 * j + 1) / 64)).sum()
    assert np.isclose((frames.cosine_matrix() @ x @ frames.cosine_matrix().T)[k, l], slow)


def test_decoded_frames(spark, tmp_path):
    def film(frames, chroma="C420", head=b"YUV4MPEG2 W8 H4 F25:1 "):
        planes = {"C420": 16, "Cmono": 0}[chroma]
        return head + chroma.encode() + b"\n" + b"".join(b"FRAME\n" + bytes([i]) * 32 + bytes(planes) for i in range(frames))

    rows = {"a": film(50), "mono": film(3, "Cmono"), "cut": film(2)[:-20], "none": b"x", "empty": film(0)}
    for name, data in rows.items():
        (tmp_path / name).write_bytes(data)
    places = [(str(tmp_path / n),) for n in [*rows, "missing"]] + [(None,)]
    got = frames.decoded_frames(spark.createDataFrame(places, "path string")).withColumn("path", F.substring_index("path", "/", -1)).collect()
    assert {r.path for r in got} == {"a", "mono", "cut"}
    assert [(r.pos, r.frame, r.height, r.width, r.data[0], r.duration) for r in got if r.path == "a"] == [(p, f, 4, 8, f, 2.0) for p, f in enumerate([5, 15, 25, 35, 45])]
    assert [r.frame for r in got if r.path == "mono"] == [0, 1, 2]
    assert [r.frame for r in got if r.path == "cut"] == [0]
    for total in (1, 4, 90, 999, 1000, 1500, 7000):
        assert spark.range(1).select(similarity.sampled_frames(F.lit(total))).first()[0] == frames.sampled_indices(total)


def test_frame_blocks(spark):
    rng = np.random.default_rng(2)
    smooth = np.add.outer(np.arange(48) * 3, np.arange(80) * 1.0).astype(np.uint8)
    noisy = np.clip(smooth.astype(int) + rng.integers(-2, 3, smooth.shape), 0, 255).astype(np.uint8)
    other = rng.integers(0, 256, (48, 80)).astype(np.uint8)
    color = np.repeat(smooth[:, :, None], 3, axis=2)
    rows = [("s", 0, 48, 80, smooth.tobytes()), ("n", 0, 48, 80, noisy.tobytes()), ("o", 0, 48, 80, other.tobytes()), ("c", 0, 48, 80, color.tobytes())]
    rows += [("null", 0, 48, 80, None), ("short", 0, 48, 80, b"12"), ("empty", 0, 0, 0, b"")]
    made = frames.frame_blocks(spark.createDataFrame(rows, "path string, pos long, height int, width int, data binary").withColumn("extra", F.lit(1)))
    assert {r.path for r in made.where("embedding is null").collect()} == {"null", "short", "empty"}
    bits = {r.path: np.array(r.b) for r in made.where("embedding is not null").select("path", similarity.frame_bits(F.col("embedding")).alias("b")).collect()}
    assert bits["s"].sum() <= 32 and (bits["s"] == bits["c"]).all()
    assert (bits["s"] == bits["o"]).mean() < 0.8
    assert frames.frame_blocks(spark.createDataFrame([], "path string, pos long, height int, width int, data binary")).count() == 0


def test_frame_blocks_keep_columns(spark):
    """What a query says of a frame beside its hash comes with it; films need not be read again."""
    rows = [("f", 0, 32, 32, bytes(1024), 7, 2.5), ("f", 1, 0, 0, None, 8, 2.5)]
    made = frames.frame_blocks(spark.createDataFrame(rows, "path string, pos long, height int, width int, data binary, frame long, duration double"), "frame", "duration")
    assert [(r.pos, r.frame, r.duration, r.embedding is None) for r in made.collect()] == [(0, 7, 2.5, False), (1, 8, 2.5, True)]
