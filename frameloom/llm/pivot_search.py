"""Exact top-k inner products by pivot-table elimination.

Vectors become integers, floor(``scale`` * x). Pivots are chosen far apart from a bounded
sample (``SAMPLE`` vectors in order of a hash). A vector's distances to the pivots and its
length fix its products with them, hence the part of it in the pivots' span and the length
of the rest; that is how the table keeps them. Two vectors q, x with given distances differ
at least by the distance of their parts and of their rests' lengths, the largest lower
bound that the distances allow, at least as good as every triangle inequality; with
    q.x = (|q|^2 + |x|^2 - |q - x|^2) / 2
it is an upper bound of the score: the product of the parts plus that of the rests' lengths.
A task evaluates its candidates in order of that bound and stops a query when the next bound
is below the k-th score so far; ties are evaluated.

Queries are a table, cut into blocks of about ``QUERIES``; blocks are broadcast, searched and
written one after the other, so one block at a time is held. A query's k-th score in the
sample is a floor that all tasks start from, so a task returns only what may be among the k
best, and these rows are merged.

Every vector stays. Scores are computed in 64-bit floating point only where the product of
lengths is below 2**52, so that every partial sum is exact; other vectors, of length 2**26
or more, are compared by Python integers with all, beside the table.

Defined results: vectors that are null or hold null, NaN or infinite components take no
part; components that a shorter vector lacks count as 0, so an empty vector scores 0; scores beyond 64 bits count as
the largest or smallest long; a query skips the rows of its own id; repeated candidate rows
rank each; repeated rows ask once, rows of one id with different vectors ask each; null ids
take no part; extra columns are ignored; too few candidates give fewer rows, an empty table
none.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frameloom.llm.common import materialize, scratch_path, small_batches

SCALE, PIVOTS, SAMPLE, QUERIES, CHUNK = 1024, 48, 2048, 8000, 20_000
#: Vectors shorter than this have exact products in floating point.
LENGTH = 2.0**26
#: Relative error of bounds, from coordinates kept in 32 bits; bounds are raised by it.
SLACK = 1e-5
LONG = 2**63 - 1
#: Queries whose bounds are held at a time.
TOGETHER = 64


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id and x, the vector, of the rows that take part."""
    x = F.col("embedding")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & finite).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows of doubles, short ones filled up with 0."""
    out = np.zeros((len(column), width))
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    row = np.repeat(np.arange(len(column)), ends)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(ends) - ends, ends)
    out[row, at] = flat
    return out


def whole_numbers(x: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """floor(scale * x) as doubles, and which rows are short enough for exact products."""
    with np.errstate(over="ignore", invalid="ignore"):
        v = np.floor(x * scale)
        return v, (v * v).sum(1) < LENGTH**2  # infinity and NaN are not


def exact(row: np.ndarray, scale: int) -> list[int]:
    """floor(scale * x) of any finite doubles."""
    return [math.floor(e * scale) if abs(e) < 2.0**53 else int(e) * scale for e in row.tolist()]


def choose_pivots(sample: np.ndarray, many: int) -> np.ndarray:
    """Farthest-first: each pivot is the sample vector farthest from those before."""
    if not len(sample):
        return sample
    picked, far = [0], ((sample - sample[0]) ** 2).sum(1)
    while len(picked) < min(many, len(sample)) and far.max() > 0:
        picked.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[picked[-1]]) ** 2).sum(1))
    return sample[picked]


def directions(pivots: np.ndarray) -> np.ndarray:
    """Orthonormal rows that span the pivots."""
    out: list[np.ndarray] = []
    for p in pivots:
        rest = p.astype(float)
        for _ in range(2):
            for d in out:
                rest = rest - (rest @ d) * d
        length = np.sqrt(rest @ rest)
        if length > 1e-6 * max(1.0, np.sqrt(p @ p)):
            out.append(rest / length)
    return np.array(out).reshape(len(out), pivots.shape[1])


def table_rows(v: np.ndarray, way: np.ndarray) -> np.ndarray:
    """Of each vector, its coordinates in the pivots' span, the length of the rest, and its length."""
    part = np.einsum("ij,kj->ik", v, way)
    square = (v * v).sum(1)
    rest = np.sqrt(np.maximum(square - (part * part).sum(1), 0))
    return np.column_stack([part, rest, np.sqrt(square)])


def build_index(vectors: DataFrame, scale: int = SCALE, many: int = PIVOTS) -> tuple[DataFrame, int, tuple[np.ndarray, np.ndarray]]:
    """(vec_id, x, far: the pivot table's row, empty for long vectors), written once, the vectors' width, and the short vectors of the sample: ids and integers."""
    whole = valid(vectors)
    width = whole.agg(F.max(F.size("x"))).first()[0] or 0
    way, sample = np.zeros((0, width)), (np.zeros(0, np.int64), np.zeros((0, width)))
    if width:
        rows = whole.orderBy(F.xxhash64("vec_id"), "vec_id", "x").limit(SAMPLE).toArrow()
        v, short = whole_numbers(_matrix(rows["x"].combine_chunks(), width), scale)
        sample = rows["vec_id"].to_numpy()[short], v[short]
        way = directions(choose_pivots(v[short], many))

    def run(batches):
        for batch in batches:
            if len(batch):
                v, short = whole_numbers(_matrix(batch.column(1), width), scale)
                found = table_rows(np.where(short[:, None], v, 0), way).astype(np.float32)
                ends = np.concatenate([[0], np.cumsum(np.where(short, found.shape[1], 0))]).astype(np.int32)
                far = pa.ListArray.from_arrays(pa.array(ends), pa.array(found[short].ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), far], names=["vec_id", "x", "far"])

    kind = whole.schema["x"].dataType.simpleString()
    return materialize(whole.mapInArrow(run, f"vec_id long, x {kind}, far array<float>"), "pivot-index"), width, sample


def eliminate(ids: np.ndarray, v: np.ndarray, top: np.ndarray, query_id: int, q: np.ndarray, k: int, best: list[tuple[int, int]], floor: float = -math.inf, step: int = 64) -> tuple[list[tuple[int, int]], int]:
    """``best`` (sorted (-score, id), at most k) with the candidates ``v``, of bounds ``top``, taken in; and how many were evaluated. Scores under ``floor`` aren't among the k best."""
    least = max(floor, -best[-1][0]) if len(best) == k else floor
    may = np.flatnonzero(top >= least)
    order = may[np.argsort(-top[may], kind="stable")]
    at = 0
    while at < len(order) and top[order[at]] >= least:
        part = order[at : at + step]
        score = np.einsum("ij,j->i", v[part], q)
        keep = (ids[part] != query_id) & (score >= least)
        if keep.any():
            best = sorted(best + [(-int(s), int(i)) for s, i in zip(score[keep], ids[part][keep], strict=True)])[:k]
            least = max(floor, -best[-1][0]) if len(best) == k else floor
        at += step
    return best, min(at, len(order))


class _Block:
    """Queries of a block: those short enough for the table, and the others as integers."""

    def __init__(self, rows: pa.Table, width: int, scale: int, sample: tuple[np.ndarray, np.ndarray], k: int) -> None:
        x = _matrix(rows["x"].combine_chunks(), width) if len(rows) else np.zeros((0, width))
        names, far = rows["vec_id"].to_numpy(), rows["far"].to_pylist()
        self.v, short = whole_numbers(x, scale)
        self.names = names
        self.plain = np.flatnonzero(short)
        self.far = np.array([far[i] for i in self.plain], float) if len(self.plain) else np.zeros((0, 1))
        self.long = {int(i): exact(x[i], scale) for i in np.flatnonzero(~short)}
        self.x, self.scale = x, scale
        self.floor = np.full(len(names), -math.inf)
        if len(sample[0]) > k:
            for a in range(0, len(self.plain), TOGETHER):
                mine = self.plain[a : a + TOGETHER]
                score = np.where(sample[0][None, :] == names[mine][:, None], -math.inf, np.einsum("ij,kj->ik", self.v[mine], sample[1]))
                self.floor[mine] = np.partition(score, -k, axis=1)[:, -k]

    def whole(self, i: int) -> list[int]:
        return self.long.get(i) or exact(self.x[i], self.scale)


def _search(block: _Block, width: int, k: int):
    def clamp(score: int) -> int:
        return max(-LONG - 1, min(LONG, score))

    def run(batches):
        best: list[list[tuple[int, int]]] = [[] for _ in block.names]
        seen = evaluated = 0
        for batch in batches:
            for a in range(0, len(batch), CHUNK):
                piece = batch.slice(a, CHUNK)
                ids, x = piece.column(0).to_numpy(), _matrix(piece.column(1), width)
                v, short = whole_numbers(x, block.scale)
                plain = np.flatnonzero(short)
                far = np.array(piece.column(2).flatten(), float).reshape(len(plain), -1) if len(plain) else np.zeros((0, 1))
                for b in range(0, len(block.plain) if len(plain) else 0, TOGETHER):
                    mine = block.plain[b : b + TOGETHER]
                    f = block.far[b : b + TOGETHER]
                    length = np.outer(f[:, -1], far[:, -1])
                    top = np.floor(f[:, :-1] @ far[:, :-1].T + SLACK * length + 1.0)
                    for j, i in enumerate(mine):
                        best[i], n = eliminate(ids[plain], v[plain], top[j], int(block.names[i]), block.v[i], k, best[i], block.floor[i])
                        seen, evaluated = seen + len(plain), evaluated + n
                others = {int(c): exact(x[c], block.scale) for c in np.flatnonzero(~short)}
                for i in range(len(block.names)):
                    rows = others if i not in block.long else {c: others.get(c) or exact(x[c], block.scale) for c in range(len(ids))}
                    if rows:
                        q = block.whole(i)
                        found = [(-clamp(sum(s * t for s, t in zip(q, w, strict=True))), int(ids[c])) for c, w in rows.items() if ids[c] != block.names[i]]
                        best[i] = sorted(best[i] + found)[:k]
        rows = [(i, int(block.names[i]), v, -s, seen, evaluated) for i, found in enumerate(best) for s, v in found]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["asker", "query_id", "vec_id", "score", "seen", "evaluated"])

    return run


def answers(vectors: DataFrame, is_query, k: int = 10, scale: int = SCALE, many: int = PIVOTS, block: int = QUERIES) -> DataFrame:
    """The tasks' best: part (block), asker, query_id, vec_id, score, and the task's candidates seen and evaluated."""
    index, width, sample = build_index(vectors, scale, many)
    spark = vectors.sparkSession
    asked = materialize(index.where(is_query).dropDuplicates(["vec_id", "x"]), "queries")
    blocks = max(1, -(-asked.count() // block))
    schema = "asker long, query_id long, vec_id long, score long, seen long, evaluated long"
    folder = scratch_path(spark, "answers")
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).orderBy("vec_id", "x").toArrow()
        sent = spark.sparkContext.broadcast(_Block(rows, width, scale, sample, k))

        def run(batches, sent=sent):
            yield from _search(sent.value, width, k)(batches)

        with small_batches(spark):
            index.mapInArrow(run, schema).write.parquet(f"{folder}/part={b}")
        sent.destroy()
    return spark.read.schema(f"{schema}, part int").option("basePath", folder).parquet(folder)


def search(vectors: DataFrame, is_query, k: int = 10, scale: int = SCALE, many: int = PIVOTS, block: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other rows for each row where the column ``is_query`` holds."""
    order = Window.partitionBy("part", "asker").orderBy(F.desc("score"), "vec_id")
    found = answers(vectors, is_query, k, scale, many, block)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def evaluated_share(vectors: DataFrame, is_query, k: int = 10, many: int = PIVOTS) -> float:
    """Of all (query, candidate) pairs, the share that elimination left to be evaluated; in blocks of one task each it is that of the tasks that answered."""
    tasks = answers(vectors, is_query, k, many=many).select("part", "seen", "evaluated").distinct()
    total = tasks.agg(F.sum("evaluated"), F.sum("seen")).first()
    return (total[0] or 0) / (total[1] or 1)
