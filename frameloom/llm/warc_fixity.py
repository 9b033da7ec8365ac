"""Fixity audit of WARC replicas with Merkle trees.

Pages become WARC/1.1 records, ``PER_FILE`` ids to a file; files are .warc.gz in the
shared folder, every record a gzip member, with an index of the members' byte ranges
and digests. A replica's tree has as leaves the SHA-256 of every record as it is read
back from its range. A record's place in the tree goes by its id, so that one that is
lost or of another length does not move the others: a node hashes, in order, its up to
``FANOUT`` children with their offset ranges, taken from the node's first offset; first
the copies of an id, then the ids within a file, then files. The audit compares the roots
and descends from level to level, reading only the children of nodes that differ, down to
the records.

Work per node is bounded by the fan-out; only counts and level numbers reach the
driver. Defined results: null urls, texts and ids are written as empty; null ids come
first in the first file; repeated ids follow each other, ordered by content; a record
that one replica lacks is reported as missing there; one that has another order among
the records of its node as moved; extra columns are ignored; two empty replicas agree. Of
a damaged file: where bytes were lost or put in at one place, records behind it are found
by the file's change of length; a member that differs from its digest has the hash of its
stored bytes, one whose bytes are what the file lost or that lies wholly beyond the end is
missing, and bytes after the last member are a record of their own. ``start`` and ``end``
are offsets in the uncompressed file.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from functools import reduce
from operator import and_

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameloom.llm.common import materialize, scratch_path, slices

FANOUT, PER_FILE = 16, 4096
#: Levels that a file's ids take.
SLOT_LEVELS = 3
#: Places of records without an id, and of bytes after the last member; they have a branch of their own within a file.
NO_ID, BEHIND = -1, -2
#: Bytes after the last member that are read at a time.
CHUNK = 1024 * 1024
LEVEL = 2
LONG = pa.int64()
LEAF = pa.schema([("page_id", LONG), ("file", LONG), ("slot", LONG), ("copy", LONG), ("record", LONG), ("start", LONG), ("end", LONG), ("hash", pa.string())])
INDEX = pa.schema([*list(LEAF)[:-1], ("at", LONG), ("size", LONG), ("digest", pa.binary()), ("uri", pa.string())])
MEMBER = pa.schema([("page_id", LONG), ("file", LONG), ("long", LONG), ("member", pa.binary()), ("order", pa.binary())])


def warc_record(page_id: Column, url: Column, content: Column) -> Column:
    """The bytes of one resource record, as text."""
    blank = F.lit("")
    body = F.coalesce(content, blank)
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), blank), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, blank),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def _columns(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    return ", ".join(f"`{f.name}` {kinds[f.type]}" for f in schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _press(batches):
    """Records to gzip members, with the digest of the record's bytes; before they are shuffled, which takes less room."""
    for batch in slices(batches):
        rows = []
        for page_id, file, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            press = zlib.compressobj(LEVEL, wbits=31)
            rows.append((page_id, file, len(text), press.compress(text) + press.flush(), hashlib.sha256(text).digest()))
        yield _batch(rows, MEMBER)


def write_files(pages: DataFrame, content: Column | None = None) -> DataFrame:
    """Write the records of ``pages`` (page_id, url, html) as .warc.gz files; gives their index, with the columns of ``INDEX``."""
    folder = scratch_path(pages.sparkSession, "warc")
    system, place = fs.FileSystem.from_uri(folder)
    system.create_dir(place, recursive=True)

    def run(batches):
        system, place = fs.FileSystem.from_uri(folder)
        file = out = passing = page = None
        record = start = at = copy = 0

        def close() -> None:
            if out is not None:
                out.close()
                system.move(passing, f"{place}/{file}.warc.gz")

        for batch in slices(batches):
            rows = []
            for page_id, here, long, member in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                if here != file:
                    close()
                    file, record, start, at, page, copy = here, 0, 0, 0, page_id, -1
                    passing = f"{place}/{here}.{uuid.uuid4().hex}.part"
                    out = system.open_output_stream(passing, compression=None)
                page, copy = page_id, copy + 1 if page_id == page else 0
                out.write(member)
                slot = NO_ID if page_id is None else page_id % PER_FILE
                rows.append((page_id, here, slot, copy, record, start, start + long, at, len(member), hashlib.sha256(member).digest(), f"{folder}/{here}.warc.gz"))
                record, start, at = record + 1, start + long, at + len(member)
            yield _batch(rows, INDEX)
        close()

    text = warc_record(F.col("page_id"), F.col("url"), F.col("html") if content is None else content).cast("binary")
    file = F.coalesce(F.floor(F.col("page_id") / PER_FILE), F.lit(0)).cast("long")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), file.alias("file"), text.alias("text")).mapInArrow(_press, _columns(MEMBER))
    ordered = rows.repartition("file").sortWithinPartitions("file", F.col("page_id").asc_nulls_first(), "order")
    return materialize(ordered.mapInArrow(run, _columns(INDEX)), "warc-index")


def read_files(index: DataFrame) -> DataFrame:
    """The columns of ``LEAF`` of every record that the files of ``index`` hold, from their bytes."""

    def found_at(stored, at: int, size: int, digest: bytes) -> tuple[bytes, bool]:
        member = stored.read_at(size, at) if 0 <= at < stored.size() else b""
        return member, hashlib.sha256(member).digest() == digest

    def after(stored, last: tuple | None) -> list[tuple]:
        """A record of the bytes behind the last member, if any."""
        if stored is None:
            return []
        file, record, end, at = last
        if (more := stored.size() - at) <= 0:
            return []
        found = hashlib.sha256()
        stored.seek(at)
        while part := stored.read(CHUNK):
            found.update(part)
        return [(None, file, BEHIND, 0, record + 1, end, end + more, found.hexdigest())]

    def run(batches):
        uri = stored = last = None
        shift = change = 0
        for batch in slices(batches):
            rows = []
            for page_id, file, slot, copy, record, start, end, at, size, digest, here, total in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if here != uri:
                    rows += after(stored, last)
                    uri = here
                    system, path = fs.FileSystem.from_uri(here)
                    stored = system.open_input_file(path) if system.get_file_info(path).type == fs.FileType.File else None
                    shift, change = 0, stored.size() - total if stored is not None else 0
                member, same = found_at(stored, at + shift, size, digest) if stored is not None else (b"", False)
                if not same and change and shift == 0 and stored is not None:
                    moved, there = found_at(stored, at + change, size, digest)
                    if there:
                        member, same, shift = moved, True, change
                    elif change == -size:  # the bytes that the file lost
                        member, shift = b"", change
                if member:
                    rows.append((page_id, file, slot, copy, record, start, end, hashlib.sha256(zlib.decompress(member, wbits=31) if same else member).hexdigest()))
                last = (file, record, end, at + size + shift)
            yield _batch(rows, LEAF)
        yield _batch(after(stored, last), LEAF)

    sizes = index.groupBy("file").agg(F.max(F.col("at") + F.col("size")).alias("total"))
    ordered = index.select(*[F.col(f"`{c}`") for c in INDEX.names]).join(sizes, "file").select(*[F.col(f"`{c}`") for c in INDEX.names], "total")
    ordered = ordered.repartition("file").sortWithinPartitions("file", "record")
    return materialize(ordered.mapInArrow(run, _columns(LEAF)), "replica")


def replica(pages: DataFrame, content: Column | None = None) -> DataFrame:
    """The columns of ``LEAF`` of every record of ``pages`` (page_id, url, html), written to files and read back."""
    return read_files(write_files(pages, content))


KEY = ["file", "slot", "copy"]


def _parent(kind: str) -> list[Column]:
    """The place of a node's parent, where levels of this kind are joined; over files, their two branches are joined too."""
    up = [F.floor(F.col(c) / FANOUT).cast("long") if c == kind else F.lit(0).cast("long") if kind == "file" else F.col(c) for c in KEY]
    return [c.alias(f"up_{k}") for c, k in zip(up, KEY, strict=True)]


def _parents(level: DataFrame, kind: str) -> DataFrame:
    child = F.struct(*KEY, "start", "end", "hash")
    nodes = level.select(*_parent(kind), child.alias("child")).groupBy("up_file", "up_slot", "up_copy").agg(F.array_sort(F.collect_list("child")).alias("children"), F.min("child.start").alias("start"), F.max("child.end").alias("end"))
    said = F.transform("children", lambda c: F.concat_ws(":", c["file"], c["slot"], c["copy"], c["start"] - F.col("start"), c["end"] - c["start"], c["hash"]))
    return nodes.select(F.col("up_file").alias("file"), F.col("up_slot").alias("slot"), F.col("up_copy").alias("copy"), "start", "end", F.sha2(F.array_join(said, "\n").cast("binary"), 256).alias("hash"))


def shape(*replicas: DataFrame) -> list[str]:
    """Kinds of the levels above the records, over copies, ids and files, for trees that can be compared."""
    most, low, high = reduce(lambda a, b: a.unionByName(b), [r.select("copy", "file") for r in replicas]).agg(F.max("copy"), F.min("file"), F.max("file")).first()
    if most is None:
        return []
    copies = outer = 0
    while most // FANOUT**copies:
        copies += 1
    while low // FANOUT**outer != high // FANOUT**outer and not (low < 0 <= high and low // FANOUT**outer == -1 and high // FANOUT**outer == 0):
        outer += 1
    return ["copy"] * copies + ["slot"] * SLOT_LEVELS + ["file"] * outer


def merkle_levels(leaves: DataFrame, kinds: list[str]) -> list[DataFrame]:
    """Level 0 (records) to the root: file, slot, copy, start, end, hash; each written once."""
    levels = [leaves.select(*KEY, "start", "end", "hash")]
    for kind in kinds:
        levels.append(materialize(_parents(levels[-1], kind), "merkle"))
    return levels


def _both(a: DataFrame, b: DataFrame) -> DataFrame:
    """Nodes of either tree at one place: file, slot, copy, and each one's hash, start and length."""
    left, right = a.alias("a"), b.alias("b")
    joined = left.join(right, reduce(and_, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in KEY]), "full")
    said = [x for t in ("a", "b") for x in (F.col(f"{t}.hash").alias(f"hash_{t}"), F.col(f"{t}.start").alias(f"start_{t}"), (F.col(f"{t}.end") - F.col(f"{t}.start")).alias(f"long_{t}"))]
    return joined.select(*[F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in KEY], *said)


def _compared(nodes: DataFrame, kind: str) -> DataFrame:
    """Of ``_both`` and the flag whether all above moved: the nodes that differ, or have another rank among their parent's children, with the flag."""
    siblings = Window.partitionBy(*_parent(kind))  # up to FANOUT
    common = F.when(F.col("hash_a").isNotNull() & F.col("hash_b").isNotNull(), 1).otherwise(0)
    ranked = nodes.withColumns({"rank_a": F.sum(common).over(siblings.orderBy("start_a")), "rank_b": F.sum(common).over(siblings.orderBy("start_b"))})
    same = F.col("hash_a").eqNullSafe(F.col("hash_b")) & F.col("long_a").eqNullSafe(F.col("long_b"))
    return ranked.withColumn("moved", F.col("moved") | ((common == 1) & (F.col("rank_a") != F.col("rank_b")))).where(F.col("moved") | ~same).select(*KEY, "hash_a", "hash_b", "moved")


def audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """file, slot, copy, hash_a, hash_b of the records that differ between two replicas; equal hashes are of records that moved."""
    kinds = shape(a, b)
    if not kinds:
        return _both(a.select(*KEY, "start", "end", "hash"), b.select(*KEY, "start", "end", "hash")).select(*KEY, "hash_a", "hash_b")
    first, second = merkle_levels(a, kinds), merkle_levels(b, kinds)
    found = _both(first[-1], second[-1]).where("not (hash_a <=> hash_b)").withColumn("moved", F.lit(False))
    for depth in range(len(kinds) - 1, -1, -1):
        found = materialize(found.select(*[F.col(c).alias(f"up_{c}") for c in KEY], "moved"), "differing")

        def below(level: DataFrame, found=found, kind=kinds[depth]) -> DataFrame:
            return level.select("*", *_parent(kind)).join(found, [f"up_{c}" for c in KEY], "left_semi").select(*level.columns)

        nodes = _both(below(first[depth]), below(second[depth])).select("*", *_parent(kinds[depth])).join(found, [f"up_{c}" for c in KEY]).drop(*[f"up_{c}" for c in KEY])
        found = _compared(nodes, kinds[depth])
    return found.select(*KEY, "hash_a", "hash_b")


def audit_report(a: DataFrame, b: DataFrame) -> DataFrame:
    """Every record of ``a`` with its status in ``b``: intact, altered, moved or missing; and those that ``a`` lacks, as ``b`` has them."""
    bad = materialize(audit(a, b), "audit").alias("d")

    def at(one: str, other: str) -> Column:
        return reduce(and_, [F.col(f"{one}.{c}") == F.col(f"{other}.{c}") for c in KEY])

    joined = a.alias("a").join(bad, at("a", "d"), "left")
    status = F.when(F.col("d.file").isNull(), "intact").when(F.col("hash_b").isNull(), "missing in b").when(F.col("hash_a") == F.col("hash_b"), "moved").otherwise("altered")
    own = joined.select("a.page_id", "a.file", "a.record", "a.start", F.col("a.end").alias("stop"), F.col("a.hash").alias("sha256"), F.col("hash_b").alias("replica_sha256"), status.alias("status"))
    more = b.alias("b").join(bad.where("hash_a is null"), at("b", "d"))
    return own.unionByName(more.select("b.page_id", "b.file", "b.record", "b.start", F.col("b.end").alias("stop"), F.lit(None).cast("string").alias("sha256"), F.col("b.hash").alias("replica_sha256"), F.lit("missing in a").alias("status")))
