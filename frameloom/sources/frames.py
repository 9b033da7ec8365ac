"""Films as a data source, perceptual hashes of their frames, and their scenes.

A decoder reads single frames of a file by seeking; that of uncompressed YUV4MPEG2 is
here, others are the caller's. A frame comes as rows of 8-bit pixels, gray or blue, green, red. Reducing to 32 x 32 by area, smoothing and the cosine transform are linear,
so each is a matrix applied from both sides; a batch of frames of one size shares them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from frameloom.sources.scratch import written

SIDE, CORNER = 32, 8
#: Bytes of pixels that are reduced together, about.
STACK = 4 * 1024 * 1024
#: Frames that are read where a header doesn't say how many there are.
PROBED = 100
USUAL_RATE = 30


@lru_cache(maxsize=64)
def area_matrix(n: int) -> np.ndarray:
    """SIDE x n: the share that each of n pixels has in each of SIDE equal stretches."""
    edges, pixels = np.arange(SIDE + 1) * n / SIDE, np.arange(n)
    low, high = np.maximum(edges[:-1, None], pixels), np.minimum(edges[1:, None], pixels + 1)
    return np.clip(high - low, 0, None) * SIDE / n


@lru_cache(maxsize=1)
def smooth_matrix() -> np.ndarray:
    """Quarter, half, quarter; beyond an edge the picture is mirrored, the edge pixel not repeated."""
    m = np.zeros((SIDE, SIDE))
    for i in range(SIDE):
        for j, w in ((i - 1, 0.25), (i, 0.5), (i + 1, 0.25)):
            m[i, SIDE - 2 if j == SIDE else abs(j)] += w
    return m


@lru_cache(maxsize=1)
def cosine_matrix() -> np.ndarray:
    """CORNER x SIDE: the lowest frequencies of the orthonormal cosine transform."""
    k, x = np.arange(CORNER)[:, None], np.arange(SIDE)
    m = np.cos(np.pi * k * (2 * x + 1) / (2 * SIDE)) * np.sqrt(2 / SIDE)
    m[0] /= np.sqrt(2)
    return m


def _stacked(raw: list[np.ndarray]) -> list[list[float]]:
    """Coefficients of frames of one size and number of colours, by one product of matrices a step."""
    pixels = np.stack(raw)
    gray = np.rint(pixels @ np.array([0.114, 0.587, 0.299])) if pixels.ndim == 4 else pixels.astype(float)
    small = np.rint(area_matrix(gray.shape[1]) @ gray @ area_matrix(gray.shape[2]).T)
    even = np.rint(smooth_matrix() @ small @ smooth_matrix().T)
    return (cosine_matrix() @ even @ cosine_matrix().T).reshape(len(raw), -1).tolist()


def _blocks(batches):
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            taken, held = 0, 0
            while at + taken < batch.num_rows and (taken == 0 or held < STACK):  # some frames' pixels at a time
                held += len(batch.column(4)[at + taken].as_buffer() or b"") if batch.column(4)[at + taken].is_valid else 0
                taken += 1
            part = batch.slice(at, taken)
            at += taken
            found: list = [None] * taken
            alike: dict[tuple, list] = {}
            for i, (height, width, data) in enumerate(zip(*[part.column(c).to_pylist() for c in (2, 3, 4)], strict=True)):
                area = (height or 0) * (width or 0)
                if data is not None and height and width and height > 0 and width > 0 and len(data) in (area, 3 * area):
                    shape = (height, width) if len(data) == area else (height, width, 3)
                    alike.setdefault(shape, []).append((i, np.frombuffer(data, np.uint8).reshape(shape)))
            for frames in alike.values():
                for (i, _), values in zip(frames, _stacked([raw for _, raw in frames]), strict=True):
                    found[i] = values
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.list_(pa.float64())), *part.columns[5:]], names=["path", "pos", "embedding", *part.schema.names[5:]])


def frame_blocks(frames: DataFrame, *kept: str) -> DataFrame:
    """frames (path, pos, height, width, data) to path, pos, embedding: the 64 coefficients that ``similarity`` hashes, as doubles: as floats, the middle two can become one.

    A frame that is null, empty or whose pixels don't fit its size has a null embedding. Extra columns are ignored but for ``kept``.
    """
    columns = [F.col("path").cast("string"), F.col("pos").cast("long"), F.col("height").cast("int"), F.col("width").cast("int"), F.col("data").cast("binary")]
    extra = "".join(f", {c} {frames.schema[c].dataType.simpleString()}" for c in kept)
    return frames.select(*columns, *kept).mapInArrow(_blocks, f"path string, pos long, embedding array<double>{extra}")


def frame_count(said: Column, readable: Column) -> Column:
    """The header's count, or as many of the first ``PROBED`` frames as can be read; null if there are none."""
    return F.when(said > 0, said).when(readable > 0, F.least(readable, F.lit(PROBED).cast("long")))


def duration(total: Column, fps: Column) -> Column:
    """Seconds; a rate of 0 stands for the usual one."""
    return total / F.when(fps == 0, F.lit(USUAL_RATE)).otherwise(fps).cast("double")


class Y4M:
    """Decoder of an uncompressed YUV4MPEG2 file that can seek, by its luma plane; a class of other formats may take its place.

    Header: the word YUV4MPEG2, fields W (width), H (height), F (rate as n:d), C (chroma, 420 if absent), a line feed; then frames, each a FRAME line and its planes.
    Frames lie at equal distances unless a FRAME line has parameters; then their lines are read one after the other, the planes between them are not.
    """

    PLANES = {"mono": 1.0, "420": 1.5, "422": 2.0, "444": 3.0}
    LINE = b"FRAME\n"

    def __init__(self, file: BinaryIO, size: int) -> None:
        self.file, self.bytes_read = file, 0
        head, found, _ = self._take(0, 256).partition(b"\n")
        words = head.decode("ascii", "replace").split(" ")
        if words[0] != "YUV4MPEG2" or not found:
            raise ValueError("not a YUV4MPEG2 file")
        said = {w[0]: w[1:] for w in words[1:] if w}
        self.width, self.height = int(said["W"]), int(said["H"])
        n, _, d = said.get("F", "30:1").partition(":")
        self.fps = int(n) // max(1, int(d or 1))
        chroma = next((k for k in self.PLANES if said.get("C", "420").startswith(k)), "420")
        self.area, self.first, self.size = self.width * self.height, len(head) + 1, size
        self.planes = int(self.area * self.PLANES[chroma])
        self.step = len(self.LINE) + self.planes
        self.places: list[int] | None = None
        whole = max(0, size - self.first)
        if whole % self.step or whole and self._take(size - self.step, len(self.LINE)) != self.LINE:
            self.places = self._walked()

    def _take(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        out = self.file.read(n)
        self.bytes_read += len(out)
        return out

    def _walked(self) -> list[int]:
        """Where the pictures of frames begin, as far as their luma is whole."""
        out, at = [], self.first
        while (line := self._take(at, 80)).startswith(b"FRAME") and (end := line.find(b"\n")) >= 0 and at + end + 1 + self.area <= self.size:
            out.append(at + end + 1)
            at += end + 1 + self.planes
        return out

    def total(self) -> int:
        return (self.size - self.first) // self.step if self.places is None else len(self.places)

    def read(self, i: int) -> bytes | None:
        """The luma of frame ``i``; null if it can't be read."""
        if not 0 <= i < self.total():
            return None
        if self.places is not None:
            return self._take(self.places[i], self.area)
        found = self._take(self.first + i * self.step, len(self.LINE) + self.area)
        return found[len(self.LINE) :] if found.startswith(self.LINE) and len(found) == len(self.LINE) + self.area else None


def sampled_indices(total: int, short: int = 1000, stride: int = 500, most: int = 10) -> list[int]:
    """What ``similarity.sampled_frames`` says, for one file in a worker."""
    raw = [int(total * s) for s in (0.1, 0.3, 0.5, 0.7, 0.9)] if total < short else [i * total // k for k in [min(most, total // stride)] for i in range(k)]
    found = {max(0, min(i, total - 1)) for i in raw}
    return sorted(found if len(found) >= 3 else found | set(range(min(5, total))))


FRAMES = "path string, pos long, frame long, height int, width int, data binary, duration double, bytes_read long"
#: Bytes of a partition, about, and as many partitions of the films' bytes as there are before a smaller number that was asked for gives way.
USUAL_SPLIT, ENOUGH = 64 * 1024 * 1024, 16
#: Rows that a worker hands on together.
TOGETHER = 64


def located(place: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(place if place.startswith("/") or "://" in place else place.replace("file:", "file://", 1))


#: Bytes that are read over at a time.
SKIPPED = 1024 * 1024


class Unpacked:
    """A file packed by zstandard, read as if it weren't: what lies before a place is read over, and a place further back is read to from the start."""

    def __init__(self, system: fs.FileSystem, path: str) -> None:
        self.system, self.path = system, path
        self._begin()

    def _begin(self) -> None:
        self.file, self.at = self.system.open_input_stream(self.path, compression="zstd"), 0

    def __enter__(self) -> Unpacked:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()

    def read(self, n: int) -> bytes:
        out = self.file.read(n)
        self.at += len(out)
        return out

    def seek(self, to: int) -> None:
        if to < self.at:
            self.file.close()
            self._begin()
        while self.at < to and self.read(min(SKIPPED, to - self.at)):
            pass

    def size(self) -> int:
        while self.read(SKIPPED):
            pass
        return self.at


def opened(place: str) -> pa.NativeFile | Unpacked:
    """A film's file; one whose name ends with .zst is packed."""
    system, path = located(place)
    return Unpacked(system, path) if path.endswith(".zst") else system.open_input_file(path)


def _film_rows(place: str, chosen: Callable[[int], Iterable[int]], decoder: type, most_errors: int) -> Iterator[tuple]:
    """Rows (``FRAMES``) of the frames that ``chosen`` picks of their number; none of a file that can't be opened."""
    try:
        with opened(place) as file:
            film = decoder(file, file.size())
            total, errors, pos = film.total(), 0, 0
            for i in chosen(total) if total else ():
                data = film.read(i)
                if data is None:
                    errors += 1
                    if errors >= most_errors:
                        return
                else:
                    yield place, pos, i, film.height, film.width, data, total / (film.fps or USUAL_RATE), film.bytes_read
                    pos += 1
    except (OSError, ValueError, KeyError):
        return


def _handed_on(rows: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.float64(), pa.int64()]
    names = [c.split()[0] for c in FRAMES.split(", ")]
    rows = iter(rows)
    while part := list(islice(rows, TOGETHER)):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part, strict=True), kinds, strict=True)], names=names)


def decoded_frames(files: DataFrame, decoder: type = Y4M, most_errors: int = 5) -> DataFrame:
    """files (path) to their sampled frames (``FRAMES``), read by seeking; by a decoder class of a file and its size, with width, height, fps, bytes_read, total() and read(i).

    A file that can't be opened or has no frame that can be read gives none; after ``most_errors`` failed frames the rest of a file is left.
    """

    def run(batches):
        for batch in batches:
            for place in batch.column(0).to_pylist():
                if place is not None:
                    yield from _handed_on(_film_rows(place, sampled_indices, decoder, most_errors))

    return files.select(F.col("path").cast("string")).mapInArrow(run, FRAMES)


@dataclass
class FilmPart(InputPartition):
    """Some whole files, or the frames of one file that begin in a range of its bytes."""

    places: list[str]
    begin: int = 0
    end: int | None = None


class FilmReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder, self.sampled = options["path"], options.get("frames", "sampled") == "sampled"
        self.split = int(options.get("split", USUAL_SPLIT))
        #: Bytes that opening a file and seeking in it count for, beside those that are read.
        self.open_cost = int(options.get("opencost", 1024 * 1024))

    def partitions(self) -> list[FilmPart]:
        system, path = located(self.folder)
        prefix = self.folder[: len(self.folder) - len(path)] if self.folder.endswith(path) else "file://"
        found = sorted((f.path, f.size) for f in system.get_file_info(fs.FileSelector(path, recursive=True)) if f.type == fs.FileType.File and f.path.endswith((".y4m", ".y4m.zst")))
        out, held, bytes_held = [], [], 0
        split, whole = [self.split if self.sampled else max(self.split, min(USUAL_SPLIT, n // ENOUGH)) for n in (sum(size for _, size in found), sum(self.open_cost + size for _, size in found))]
        for name, size in found:
            if not self.sampled and size > split and not name.endswith(".zst"):
                out += [FilmPart([prefix + name], at, min(size, at + split)) for at in range(0, size, split)]
                continue
            cost = self.open_cost + (0 if self.sampled else size)
            if held and bytes_held + cost > whole:
                out.append(FilmPart(held))
                held, bytes_held = [], 0
            held.append(prefix + name)
            bytes_held += cost
        return [*out, FilmPart(held)] if held else out

    def read(self, part: FilmPart) -> Iterator[pa.RecordBatch]:
        for place in part.places:
            yield from _handed_on(_film_rows(place, sampled_indices, Y4M, 5) if self.sampled else self._range(place, part))

    def _range(self, place: str, part: FilmPart) -> Iterator[tuple]:
        """All frames that begin in a range; their ``pos`` is their number."""
        try:
            with opened(place) as file:
                film = Y4M(file, file.size())
                for i in range(film.total()):
                    at = film.first + i * film.step if film.places is None else film.places[i]
                    if part.begin <= at < (part.end if part.end is not None else at + 1) and (data := film.read(i)) is not None:
                        yield place, i, i, film.height, film.width, data, film.total() / (film.fps or USUAL_RATE), film.bytes_read
        except (OSError, ValueError, KeyError):
            return


class Films(DataSource):
    """Data source "films": frames of all .y4m files, and .y4m.zst files (packed), below ``path``; option frames is "sampled" or "all", split the bytes of a partition.

    Small splits are for few films: a sixteenth (``ENOUGH``) of all bytes, ``USUAL_SPLIT`` at most, goes into a partition if that is more; films that
    aren't cut into ranges go together by a sixteenth of bytes and costs of opening. A packed film is never cut, one task reads it from the start.
    """

    @classmethod
    def name(cls) -> str:
        return "films"

    def schema(self) -> str:
        return FRAMES

    def reader(self, schema) -> FilmReader:
        return FilmReader(self.options)


def films(spark: SparkSession, folder: str, frames: str = "sampled", split: int | None = None) -> DataFrame:
    """Frames (``FRAMES``) of the films below ``folder``."""
    spark.dataSource.register(Films)
    reader = spark.read.format("films").option("frames", frames)
    return (reader if split is None else reader.option("split", split)).load(folder)


def write_films(frames: DataFrame, fps: int = 25) -> DataFrame:
    """Write frames (path, frame, height, width, data: luma) as films, one file a path, by the tasks; gives path, frames, bytes.

    A film whose path ends with .zst is packed by zstandard: equal frames take next to nothing, but none is found by seeking.
    With a column ``times``, a row stands for so many equal frames, the first of which is ``frame``, so that a picture which stays is shuffled once.
    A film's frames stream by in order. A file takes its name when it is whole, so a task that is repeated replaces what it wrote.
    """

    def run(batches):
        out: list[tuple] = []
        place = file = None
        system = path = None
        n = 0

        def close() -> None:
            if file is not None:
                file.close()
                system.move(f"{path}.part", path)
                out.append((place, n, system.get_file_info(path).size))

        for batch in batches:
            for name, height, width, data, times in zip(*[batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5)], strict=True):
                if name != place:
                    close()
                    place, n = name, 0
                    system, path = located(name)
                    system.create_dir(path.rpartition("/")[0], recursive=True)
                    file = system.open_output_stream(f"{path}.part", compression="zstd" if path.endswith(".zst") else None)
                    file.write(f"YUV4MPEG2 W{width} H{height} F{fps}:1 Cmono\n".encode())
                file.write((Y4M.LINE + data) * times)
                n += times
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["path", "frames", "bytes"])

    times = F.col("times") if "times" in frames.columns else F.lit(1)
    # Dealt by a hash of the path: by the path itself, joins of the caller by it would seem to have dealt them.
    ordered = frames.select("path", "frame", "height", "width", "data", times.alias("times")).repartition(F.xxhash64("path")).sortWithinPartitions("path", "frame")
    return written(ordered.mapInArrow(run, "path string, frames long, bytes long"), "films")


#: Side of the picture that scenes are told apart by, and the fixed values of the detector: change of a shade on average, and frames of a scene.
THRESHOLD, SHORTEST = 30.0, 15


def small_pictures(frames: DataFrame) -> DataFrame:
    """frames (path, frame, height, width, data: luma) reduced to path, frame, picture: SIDE x SIDE shades."""

    def run(batches):
        for batch in batches:
            out = []
            for height, width, data in zip(*[batch.column(i).to_pylist() for i in (2, 3, 4)], strict=True):
                if height == width == SIDE:  # reduced already
                    out.append(data)
                    continue
                shades = np.frombuffer(data, np.uint8).reshape(height, width).astype(float)
                out.append(np.rint(area_matrix(height) @ shades @ area_matrix(width).T).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["path", "frame", "picture"])

    return frames.select("path", F.col("frame").cast("long"), F.col("height").cast("int"), F.col("width").cast("int"), "data").mapInArrow(run, "path string, frame long, picture binary")


def change(a: bytes, b: bytes) -> float:
    """Mean absolute difference of two pictures' shades."""
    return float(np.abs(np.frombuffer(a, np.uint8).astype(int) - np.frombuffer(b, np.uint8)).mean())


def scene_changes(pictures: DataFrame) -> DataFrame:
    """path, frame, score: how much each picture differs from the one before, 0 for the first."""
    before = F.lag("picture").over(Window.partitionBy("path").orderBy("frame"))

    def run(batches):
        for batch in batches:
            scores = [0.0 if b is None else change(a, b) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], names=["path", "frame", "score"])

    return pictures.select("path", "frame", "picture", before.alias("before")).mapInArrow(run, "path string, frame long, score double")


def scenes(changes: DataFrame, threshold: float = THRESHOLD, shortest: int = SHORTEST) -> DataFrame:
    """path, first, last of the scenes: a frame begins one if its score reaches ``threshold`` and the scene before has ``shortest`` frames.

    Only the frames that reach the threshold are gathered, those of one film.
    """
    ends = changes.groupBy("path").agg(F.min("frame").alias("low"), F.max("frame").alias("high"), F.array_sort(F.collect_list(F.when(F.col("score") >= threshold, F.col("frame")))).alias("may"))

    def taken(acc: Column, frame: Column) -> Column:
        return F.when(frame - F.element_at(acc, -1) >= shortest, F.concat(acc, F.array(frame))).otherwise(acc)

    first = F.aggregate("may", F.array("low"), taken)
    each = ends.select("path", "high", first.alias("begins")).select("path", "high", "begins", F.posexplode("begins").alias("at", "first"))
    return each.select("path", "first", F.coalesce(F.get("begins", F.col("at") + 1) - 1, F.col("high")).alias("last"))
