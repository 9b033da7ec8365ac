"""Packing of documents into training sequences as a cutting-stock problem.

1. Documents become ids with an end id and are cut only where they exceed a sequence:
   full pieces and one remainder.
2. Lengths are rounded up to ``width`` and counted; the histogram has at most
   ``size / width`` rows, whatever the corpus.
3. Column generation on the driver: the linear program over patterns (how many pieces
   of each length class share a sequence) is solved by the revised simplex method; an
   unbounded-knapsack dynamic program prices new patterns against the dual values.
4. The patterns' counts are rounded down; what is left, less than one use of each
   pattern, is packed largest first into further patterns.
5. Pieces are ranked within their class, in salted buckets so that a common length
   stays parallel, and the ranks are dealt to the patterns' slots. Offsets are sums of
   real lengths, so sequences have no gaps.

Only the histogram reaches the driver and only the pattern table is broadcast; both
are bounded by the number of classes.

Defined results: a null or empty text is the end id alone; repeated rows are packed
each; null ids are kept; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frameloom.llm.common import materialize, slices
from frameloom.llm.tokens import encoder

SIZE, WIDTH, END_ID = 2048, 8, 1
#: Pieces that share one value of the salt, about; a bucket holds those of one class.
RANKED = 20_000


def pieces(docs: DataFrame, path: str, size: int = SIZE, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens and, if asked for, ids (binary) of every piece."""
    columns = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids

    def run(batches):
        encode, end = encoder(path).encode, np.array([end_id], "<u4").tobytes()
        for batch in slices(batches, 1024):
            out: list[list] = [[] for _ in columns.split(",")]
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1)), strict=True):
                ids += end
                for at in range(0, len(ids), 4 * size):
                    part = ids[at : at + 4 * size]
                    row = (doc_id, at // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4, part)
                    for column, value in zip(out, row, strict=False):
                        column.append(value)
            kinds = [pa.int64()] * 5 + [pa.binary()] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=[c.split()[0] for c in columns.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, columns)


def best_pattern(values: np.ndarray, weights: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming: the largest total value within ``room`` and its counts."""
    best, last = np.zeros(room + 1), np.full(room + 1, -1)
    order = np.argsort(weights)
    w, v = weights[order], values[order]
    for r in range(1, room + 1):
        fits = np.searchsorted(w, r, "right")
        best[r], last[r] = best[r - 1], -1
        if fits:
            with_one = best[r - w[:fits]] + v[:fits]
            k = int(with_one.argmax())
            if with_one[k] > best[r] + 1e-12:
                best[r], last[r] = with_one[k], order[k]
    counts, r = np.zeros(len(values), np.int64), room
    while r > 0:
        if last[r] < 0:
            r -= 1
        else:
            counts[last[r]] += 1
            r -= int(weights[last[r]])
    return float(best[room]), counts


def inverted(a: np.ndarray) -> np.ndarray:
    """Inverse by elimination with row pivots, in elementwise steps: no thread pools of a linear-algebra library."""
    m = len(a)
    both = np.hstack([a.astype(float), np.eye(m)])
    for i in range(m):
        pivot = i + int(np.abs(both[i:, i]).argmax())
        both[[i, pivot]] = both[[pivot, i]]
        both[i] /= both[i, i]
        factor = both[:, i].copy()
        factor[i] = 0
        both -= factor[:, None] * both[i]
    return both[:, m:]


def column_generation(weights: np.ndarray, demand: np.ndarray, room: int, gap: float = 2e-4, steps: int = 6000, smooth: float = 0.8) -> list[tuple[np.ndarray, float]]:
    """(pattern, uses) of a basic solution of the relaxed cutting-stock problem.

    Patterns are priced at dual values smoothed towards those of the best lower bound
    so far, which starts at the total length; where that finds nothing, at the dual
    values themselves. The search ends within half a sequence or ``gap`` of the bound.
    """
    m = len(weights)
    demand = demand + 1e-6 * np.arange(1, m + 1)  # against cycling
    basis = np.diag(room // weights).astype(float)
    inverse, x = np.diag(1.0 / np.diag(basis)), demand / np.diag(basis)
    center = weights / room
    bound = float(center @ demand)

    def price(dual: np.ndarray) -> np.ndarray:
        nonlocal bound, center
        value, pattern = best_pattern(dual, weights, room)
        if value > 0 and np.maximum(dual, 0) @ demand / value > bound:
            center = np.maximum(dual, 0) / value
            bound = float(center @ demand)
        return pattern

    for step in range(steps):
        if step % 100 == 99:
            inverse = inverted(basis)
            x = np.maximum((inverse * demand).sum(1), 0)
        dual = inverse.sum(0)
        pattern = price(smooth * center + (1 - smooth) * dual)
        if pattern @ dual <= 1 + 1e-9:
            pattern = price(dual)
        if x.sum() - bound <= max(0.5, gap * x.sum()) or pattern @ dual <= 1 + 1e-9:
            break
        way = (inverse * pattern).sum(1)
        ratio = np.where(way > 1e-9, x / np.where(way > 1e-9, way, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        x = np.maximum(x - ratio[out] * way, 0)
        x[out] = ratio[out]
        basis[:, out] = pattern
        row = inverse[out] / way[out]
        inverse -= np.outer(way, row)
        inverse[out] = row
    return [(basis[:, p].astype(np.int64), float(x[p])) for p in range(m)]


def plan(histogram: dict[int, int], room: int) -> list[tuple[dict[int, int], int]]:
    """(pieces of each class, uses): patterns that take every piece exactly once."""
    classes = np.array(sorted(c for c, n in histogram.items() if n), np.int64)
    if not len(classes):
        return []
    left = np.array([histogram[int(c)] for c in classes], np.int64)
    out = []

    def use(pattern: np.ndarray, times: int) -> None:
        nonlocal left
        left = left - pattern * times
        out.append(({int(classes[i]): int(pattern[i]) for i in np.flatnonzero(pattern)}, times))

    for pattern, x in sorted(column_generation(classes, left.astype(float), room), key=lambda p: (-p[1], p[0].tolist())):
        times = int(np.floor(x + 1e-6))
        taken = pattern > 0
        if times and taken.any():
            times = min(times, int((left[taken] // pattern[taken]).min()))
            if times:
                use(pattern, times)
    while left.any():
        pattern, free = np.zeros(len(classes), np.int64), room
        for i in range(len(classes) - 1, -1, -1):
            pattern[i] = min(left[i], free // classes[i])
            free -= int(pattern[i] * classes[i])
        taken = pattern > 0
        use(pattern, int((left[taken] // pattern[taken]).min()))
    return out


def pack(cut: DataFrame, size: int = SIZE, width: int = WIDTH, ranked: int = RANKED) -> DataFrame:
    """``cut`` (doc_id, start, length, ids_crc32, ... of pieces up to ``size`` long) with sequence_id and offset."""
    spark, room = cut.sparkSession, size // width
    classed = cut.withColumn("_class", F.ceil(F.col("length") / width).cast("int"))
    counts = {r["_class"]: r["n"] for r in classed.groupBy("_class").agg(F.count("*").alias("n")).collect()}  # at most size / width rows
    slots, taken, first = [], dict.fromkeys(counts, 0), 0
    for pattern, times in plan(counts, room):
        for c, a in pattern.items():
            slots.append((c, taken[c], taken[c] + a * times, a, first))
            taken[c] += a * times
        first += times
    table = spark.createDataFrame(slots, "_class int, _from long, _to long, _each long, _first long")
    salt = max(1, -(-sum(counts.values()) // ranked))
    salted = classed.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salt)))
    before = salted.groupBy("_class", "_salt").agg(F.count("*").alias("_n"))
    before = before.select("_class", "_salt", (F.sum("_n").over(Window.partitionBy("_class").orderBy("_salt")) - F.col("_n")).alias("_before"))
    within = Window.partitionBy("_class", "_salt").orderBy("doc_id", "start", "ids_crc32")
    rank = salted.withColumn("_row", F.row_number().over(within)).join(F.broadcast(before) if salt <= 100 else before, ["_class", "_salt"])
    rank = rank.withColumn("_rank", F.col("_row") + F.col("_before") - 1).alias("r")
    at = (F.col("r._class") == F.col("t._class")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    dealt = rank.join(F.broadcast(table).alias("t"), at).withColumn("sequence_id", F.expr("_first + (_rank - _from) div _each"))
    order = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "_rank")
    return dealt.withColumn("offset", F.sum("length").over(order) - F.col("length")).select(*[F.col(f"r.{c}") for c in cut.columns], "sequence_id", "offset")


def pack_documents(docs: DataFrame, path: str, size: int = SIZE, width: int = WIDTH, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its place; ``with_ids`` adds the ids themselves."""
    return pack(materialize(pieces(docs, path, size, end_id, with_ids), "pieces"), size, width)


def padded(packed: DataFrame, size: int = SIZE) -> DataFrame:
    """sequence_id, used, padding: a sequence is filled up to ``size`` unless its length is a power of two."""
    used = packed.groupBy("sequence_id").agg(F.sum("length").alias("used"))
    power = F.expr("(used & (used - 1)) = 0")
    return used.withColumn("padding", F.when(power, F.lit(0)).otherwise(size - F.col("used")).cast("long"))
