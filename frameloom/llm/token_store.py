"""Binary store of token ids with a shared zstandard dictionary.

Files, in ascending order of id:

    shard      "FLTOKEN1" | header length u32 | header JSON | frames | index | footer
    header     dictionary (its SHA-256), id_bytes (2 or 4), end_id
    frame      zstandard frame of one document's ids, little-endian, id_bytes each
    index      one entry a document: id known u8, id i64, frame offset u64, frame bytes u64, ids u64
    footer     index offset u64, documents u64, "FLTOKEN1"
    dictionary dictionary-<SHA-256>.zdict

Every document has its own frame, so a short document is read with one seek, one
small read and the shared dictionary. The dictionary is trained on serialized id
arrays of a bounded sample: some ``TRAIN_DOCUMENTS`` documents chosen by a hash of the
id, the first ``TRAIN_CHARACTERS`` of each; it affects the size of files only.

Tasks write to a name of their own and rename, so a repeated task leaves one file.
Files go through ``pyarrow.fs`` to the folder given, which all executors share.

Defined results: a null or empty text is the end id alone; a null id comes first;
rows of one id are ordered by text, repeated rows are kept; extra columns are ignored;
an empty table gives no shards and no rows.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frameloom.llm.common import scratch_path, slices
from frameloom.llm.tokens import encoder

MAGIC = b"FLTOKEN1"
ENTRY = np.dtype([("known", "u1"), ("doc_id", "<i8"), ("offset", "<u8"), ("bytes", "<u8"), ("ids", "<u8")])
END_ID = 0
TRAIN_DOCUMENTS, TRAIN_CHARACTERS, DICTIONARY_BYTES = 1_000, 8_192, 64 * 1024
#: A shard is closed when its frames exceed this.
SHARD_BYTES = 64 * 1024 * 1024


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def _put(uri: str, parts) -> None:
    """Write under a passing name, then rename."""
    system, path = _open(uri)
    passing = f"{path}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(passing, compression=None) as f:
        for part in parts:
            f.write(part)
    system.move(passing, path)


def _get(uri: str) -> bytes:
    system, path = _open(uri)
    with system.open_input_file(path) as f:
        return f.read()


def train_dictionary(docs: DataFrame, path: str) -> bytes:
    share = max(1, docs.count() // TRAIN_DOCUMENTS)
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0).select(F.substring("text", 1, TRAIN_CHARACTERS).alias("t")).limit(2 * TRAIN_DOCUMENTS)
    arrays = sorted(_narrow(ids, 2) for ids in encoder(path).encode([r["t"] for r in sample.collect()]))
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, arrays).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few samples
        return b"".join(arrays)[-DICTIONARY_BYTES:]


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if len(raw) >= 8 else None


def _narrow(ids: bytes, id_bytes: int) -> bytes:
    return np.frombuffer(ids, "<u4").astype("<u2").tobytes() if id_bytes == 2 else ids


def _wide(ids: bytes, id_bytes: int) -> bytes:
    return np.frombuffer(ids, "<u2").astype("<u4").tobytes() if id_bytes == 2 else ids


def write(docs: DataFrame, folder: str, path: str, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write ``docs`` (doc_id, text) to ``folder``; gives the manifest: part, shard, file, documents, ids, bytes."""
    spark = docs.sparkSession
    raw = train_dictionary(docs, path)
    name = hashlib.sha256(raw).hexdigest()
    id_bytes = 2 if encoder(path).tokenizer.get_vocab_size() <= 65_536 and end_id < 65_536 else 4
    system, place = _open(folder)
    system.create_dir(place, recursive=True)
    _put(f"{folder}/dictionary-{name}.zdict", [raw])
    header = json.dumps({"dictionary": name, "id_bytes": id_bytes, "end_id": end_id}).encode()

    def shard(part: int, k: int, frames: list[bytes], entries: list[tuple]) -> pa.RecordBatch:
        index, at = np.zeros(len(entries), ENTRY), len(MAGIC) + 4 + len(header)
        for i, (doc_id, frame, ids) in enumerate(zip([e[0] for e in entries], frames, [e[1] for e in entries], strict=True)):
            index[i] = (doc_id is not None, doc_id or 0, at, len(frame), ids)
            at += len(frame)
        file = f"{folder}/shard-{part:06d}-{k:04d}.ids"
        _put(file, [MAGIC, struct.pack("<I", len(header)), header, *frames, index.tobytes(), struct.pack("<QQ", at, len(entries)), MAGIC])
        row = (part, k, file, len(entries), int(index["ids"].sum()), at)
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["part", "shard", "file", "documents", "ids", "bytes"])

    def run(batches):
        encode, end = encoder(path).encode, np.array([end_id], "<u4").tobytes()
        press = zstandard.ZstdCompressor(level=3, dict_data=_dictionary(raw), write_checksum=False)
        part, k, frames, entries, size = TaskContext.get().partitionId(), 0, [], [], 0
        for batch in slices(batches):
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1)), strict=True):
                frames.append(press.compress(_narrow(ids + end, id_bytes)))
                entries.append((doc_id, len(ids) // 4 + 1))
                size += len(frames[-1])
                if size >= shard_bytes:
                    yield shard(part, k, frames, entries)
                    k, frames, entries, size = k + 1, [], [], 0
        if entries:
            yield shard(part, k, frames, entries)

    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    manifest = f"{folder}/manifest"
    ordered.mapInArrow(run, "part long, shard long, file string, documents long, ids long, bytes long").write.parquet(manifest)
    return spark.read.parquet(manifest)


class Shard:
    """Random access to the documents of one file."""

    def __init__(self, uri: str, dictionaries: dict | None = None) -> None:
        system, path = _open(uri)
        self.file = system.open_input_file(path)
        size = self.file.size()
        at, count, magic = struct.unpack("<QQ8s", self.file.read_at(24, size - 24))
        self.file.seek(0)
        first, length = struct.unpack("<8sI", self.file.read(12))
        if first != MAGIC or magic != MAGIC:
            raise ValueError(f"{uri} isn't a token shard")
        self.header = json.loads(self.file.read(length))
        self.index = np.frombuffer(self.file.read_at(count * ENTRY.itemsize, at), ENTRY)
        name, known = self.header["dictionary"], {} if dictionaries is None else dictionaries
        if name not in known:
            raw = _get(f"{uri.rpartition('/')[0]}/dictionary-{name}.zdict")
            if hashlib.sha256(raw).hexdigest() != name:
                raise ValueError(f"the dictionary of {uri} is damaged")
            known[name] = zstandard.ZstdDecompressor(dict_data=_dictionary(raw))
        self.open = known[name]

    def ids(self, i: int) -> bytes:
        """Of the i-th document, as unsigned 32-bit integers."""
        e = self.index[i]
        frame = self.file.read_at(int(e["bytes"]), int(e["offset"]))
        return _wide(self.open.decompress(frame, max_output_size=max(1, int(e["ids"])) * self.header["id_bytes"]), self.header["id_bytes"])

    def find(self, doc_id: int) -> list[bytes]:
        """The ids of every document of that id, by binary search in the index."""
        known = self.index[self.index["known"] == 1]["doc_id"]
        skip = len(self.index) - len(known)
        low, high = np.searchsorted(known, doc_id, "left"), np.searchsorted(known, doc_id, "right")
        return [self.ids(skip + i) for i in range(low, high)]


def read(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids before it), n_tokens, ids_crc32 and, if asked for, ids, from the files."""
    columns = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    order = Window.orderBy("part", "shard")  # of shards, not of documents
    based = manifest.select("part", "shard", "file", (F.sum("ids").over(order) - F.col("ids")).alias("base"))
    spark = manifest.sparkSession
    tasks = max(1, min(manifest.count(), 4 * spark.sparkContext.defaultParallelism))

    def run(batches):
        dictionaries: dict = {}
        for batch in batches:
            for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = Shard(uri, dictionaries)
                for a in range(0, len(shard.index), 1000):
                    out: list[list] = [[] for _ in columns.split(",")]
                    for i in range(a, min(a + 1000, len(shard.index))):
                        ids, e = shard.ids(i), shard.index[i]
                        for column, value in zip(out, (int(e["doc_id"]) if e["known"] else None, start, len(ids) // 4, zlib.crc32(ids), ids), strict=False):
                            column.append(value)
                        start += len(ids) // 4
                    kinds = [pa.int64()] * 4 + [pa.binary()] * with_ids
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=[c.split()[0] for c in columns.split(", ")])

    return based.repartition(tasks, "part", "shard").select("file", "base").mapInArrow(run, columns)


def round_trip(spark: SparkSession, docs: DataFrame, path: str) -> DataFrame:
    """Write ``docs`` to a folder of their own and read the files back."""
    return read(write(docs, scratch_path(spark, "token-store"), path))
