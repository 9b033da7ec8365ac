"""Near-duplicate documents by MinHash with tensored banding.

1. Every whole text becomes its set of shingle hashes; equal sets are one node.
2. Two collections of ``TABLES`` short bands, of ``BAND`` minhashes each, are computed for
   a node: 2 x 16 x 3 = 96 minhashes. A table's key is one band of the first collection
   with one of the second, so the 96 minhashes serve 256 tables of six; computed apart,
   those would take 1,536. Two sets of Jaccard similarity J share a key with probability
   (1 - (1 - J**BAND)**TABLES)**2: all but 5e-7 of pairs at 0.85, all but 2e-9 at 0.9, one
   of eight at 0.3, one of 4,000 at 0.1.
3. A task packs the keys of some nodes, by their leading bits into buckets and 48 more. Of the nodes that share a key there, all are tied
   to the smallest, and only that one goes on to the other packs' nodes: a key that a
   third of all documents has costs a row a pack. Ties make coarse groups.
4. Candidates are verified on their full sets by ``jaccard_join.links``, which neither
   gathers a large group nor makes all its pairs.

Defined results are those of ``jaccard_join``: texts without words link with nothing,
repeated rows are returned each, extra columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.llm import jaccard_join
from frameloom.llm.common import give_back, materialize, slices
from frameloom.llm.components import connected_components
from frameloom.llm.jaccard_join import from_six_bytes, narrow, six_bytes
from frameloom.llm.shingles import mix, shingles
from frameloom.llm.tokens import forget

WORDS, PERCENT = 5, 85
BAND, TABLES = 3, 16
#: Nodes whose keys are packed together, and keys that one bucket holds, about.
PACK, BUCKET = 2_000, 1_000_000
_random = np.random.default_rng(20_260_301)
_SEEDS = _random.integers(0, 2**63, 2 * TABLES * BAND, dtype=np.uint64)
_ODD = _random.integers(0, 2**62, 2 * TABLES * BAND, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _random.integers(0, 2**63, TABLES * TABLES, dtype=np.uint64)
PACKED = "bucket long, low binary, owner binary, nodes binary"


def minhashes(found: np.ndarray) -> np.ndarray:
    """2 x TABLES x BAND minhashes of a set that isn't empty."""
    least = np.full(len(_SEEDS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 4096):
        part = (found[at : at + 4096, None] ^ _SEEDS) * _ODD
        np.minimum(least, part.min(axis=0), out=least)
    return least.reshape(2, TABLES, BAND)


def table_keys(found: np.ndarray) -> np.ndarray:
    """The keys of TABLES x TABLES tables: every band of the first collection with every one of the second."""
    least, bands = minhashes(found), np.zeros((2, TABLES), np.uint64)
    for i in range(BAND):
        bands = mix(bands * np.uint64(31) + least[:, :, i])
    return mix((bands[0][:, None] + (bands[1] * np.uint64(0x9E37_79B9_7F4A_7C15))[None, :]).reshape(-1) ^ _PLACE)


def _ties(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of entries: distinct pairs of a key's smallest node with its others, and the places of the entries that are smallest."""
    order = np.lexsort((nodes, keys))
    k, n = keys[order], nodes[order]
    first = np.ones(len(k), bool)
    first[1:] = k[1:] != k[:-1]
    low = n[first][np.cumsum(first) - 1]
    apart = low != n
    pairs = np.unique(np.stack([n[apart], low[apart]], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1], order[first]


def _pack(words: int, bits: int):
    """Of texts: packs of keys by bucket, and, in bucket -1, ties within a pack."""

    def flush(keys: list, nodes: list) -> pa.RecordBatch:
        key, node = np.concatenate(keys), np.repeat(np.array(nodes, np.int64), TABLES * TABLES)
        a, b, stay = _ties(key, node)
        key, node = key[stay], node[stay]
        out = [(-1, b"", a.tobytes(), b.tobytes())] if len(a) else []
        place = (key >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(key), np.int64)
        order = np.argsort(place, kind="stable")
        key, node, place = key[order], node[order], place[order]
        for bucket in np.unique(place):
            at = slice(np.searchsorted(place, bucket, "left"), np.searchsorted(place, bucket, "right"))
            names, local = np.unique(node[at], return_inverse=True)
            out.append((int(bucket), six_bytes(key[at]), narrow(local, len(names)), names.tobytes()))
        kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["bucket", "low", "owner", "nodes"])

    def run(batches):
        forget()
        seen, keys, nodes = set(), [], []
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                found = shingles(text, words)
                if not len(found) or (node := jaccard_join.node_name(found)) in seen:
                    continue
                seen.add(node)
                keys.append(table_keys(found))
                nodes.append(node)
                if len(nodes) >= PACK:
                    yield flush(keys, nodes)
                    seen, keys, nodes = set(), [], []
        if nodes:
            yield flush(keys, nodes)

    return run


def _tie_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
    give_back()
    nodes = []
    for owner, names in zip(pdf["owner"], pdf["nodes"], strict=True):
        names = np.frombuffer(names, np.int64)
        nodes.append(names[np.frombuffer(owner, np.uint32 if len(names) > 65_536 else np.uint16)])
    a, b, _ = _ties(np.concatenate([from_six_bytes(x) for x in pdf["low"]]), np.concatenate(nodes))
    return pd.DataFrame({"a": a, "b": b})


def _unpacked(batches):
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(a, np.int64)), pa.array(np.frombuffer(b, np.int64))], names=["a", "b"])


def tensored_groups(docs: DataFrame, nodes: DataFrame, words: int, percent: int) -> DataFrame:
    """node, label: groups of nodes that keys of the tensored tables tie together."""
    total = nodes.count() * TABLES * TABLES
    bits = max(0, (max(1, total // BUCKET) - 1).bit_length())
    packs = materialize(docs.select("text").mapInArrow(_pack(words, bits), PACKED), "bands")
    inside = packs.where("bucket < 0").select("owner", "nodes").mapInArrow(_unpacked, "a long, b long")
    across = packs.where("bucket >= 0").groupBy("bucket").applyInPandas(_tie_bucket, "a long, b long")
    return connected_components(inside.unionByName(across).distinct())


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (it is its component's smallest id) of every row of ``docs`` (doc_id, text)."""
    found = jaccard_join.components(docs, words, percent, grouping=tensored_groups)
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
