"""N-gram Jaccard self-join of documents by prefix filters and a prefix tree.

A document is the set of its distinct word shingles. Two documents link when the
Jaccard similarity of their sets reaches ``percent`` / 100; the result names the
component that links form.

1. Every whole text becomes a set of 64-bit shingle hashes. Equal sets are one node,
   so copies cost no pairs.
2. Prefix filter, twice. In hash order a set of n shingles and any partner share at
   least k shingles among their first n - ceil(t n) + k; with k = n - ceil(t n) + 1
   these are the first 2k - 1. They meet in hash buckets as packed arrays; those that
   no other node has drop out, and a node with fewer than k left has no partner. Of
   the c left, in global order of rarity, the first c - k + 1 must hold one that is
   shared with any partner. Nodes that share one of them form coarse groups.
3. Prefix tree. The whole sets of a coarse group are put in one global order, most
   frequent first, and stored in a trie with compressed paths. Each set is walked
   against the trie; overlaps of shared prefixes are counted once, and a subtree is
   left when the overlap so far plus what remains on either side can't reach the
   threshold, or when all its sets already are in the walker's component. Links are
   decided on whole sets.
4. Coarse groups above ``block`` nodes are not gathered. They get the prefix filter once
   more, on whole sets and in their group's own order of rarity; two linked nodes share
   one of the keys that it leaves them. Up to ``block`` nodes that keys tie together are one
   trie. Where more are tied, the nodes of a key that at most ``block`` have are one trie,
   and keys of the same nodes are one; so texts that have a passage in common with all
   others, and little else, only meet those that share the rest. Nodes with a
   key of more nodes are alike in nearly all they have: they are split into blocks, every
   block meets the first one, which joins what is alike, then the nodes outside the
   largest component meet each other and those inside; links inside that component
   change nothing. Only that last step can grow with the square of a group, if most of
   its nodes consist of shingles that more than ``block`` nodes have and still aren't
   alike. Nothing is capped.

Defined results: a null or empty text, or one without words, has no shingles and links
with nothing; fewer words than the shingle size make one shingle; repeated rows are
returned each, in one component; a null id never names a component unless all its
members have null ids; extra columns are ignored; an empty table gives no rows. Sets
are compared by 64-bit hashes, nodes are named by 64 bits of a digest.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.llm.common import give_back, materialize, slices, small_side
from frameloom.llm.components import Forest, connected_components
from frameloom.llm.shingles import digest, mix, shingles
from frameloom.llm.tokens import forget

WORDS, PERCENT = 4, 85
#: Nodes of a coarse group that one task takes.
BLOCK = 300
#: Prefix shingles that one bucket holds, about.
BUCKET = 400_000
#: Prefix shingles that are packed together before they are dealt out.
PACK = 500_000
#: Place of common shingles in the order of rarity.
COMMON = 2**40
#: Rows of a component from which on it is joined by broadcast.
HOT = 1000


def prefix_share(n, percent: int):
    """k: shingles that a set of n may lack of any partner, and one."""
    return n - -(-percent * n // 100) + 1


def node_name(found: np.ndarray) -> int:
    return int.from_bytes(digest(found)[:8], "little", signed=True)


def node_table(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, n (shingles), node (name of the set), kept (length of its extended prefix), key (a hash of the text)."""
    names = ["doc_id", "n", "node", "kept", "key"]

    def run(batches):
        forget()
        for batch in slices(batches):
            sets = [shingles(t, words) for t in batch.column(1).to_pylist()]
            n = [len(s) for s in sets]
            kept = [min(k, 2 * prefix_share(k, percent) - 1) if k else 0 for k in n]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array([node_name(s) for s in sets], pa.int64()), pa.array(kept, pa.int64()), *batch.columns[2:]], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("key")).mapInArrow(run, ", ".join(f"{c} long" for c in names))


PACKED = "bucket long, pack long, low binary, owner binary, nodes binary, sizes binary, common binary"


def six_bytes(h: np.ndarray) -> bytes:
    """The low six bytes of each hash; the bucket says the rest, or more."""
    return np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def from_six_bytes(raw: bytes) -> np.ndarray:
    part = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    wide = np.zeros((len(part), 8), np.uint8)
    wide[:, :6] = part
    return wide.reshape(-1).view(np.uint64)


def narrow(local: np.ndarray, many: int) -> bytes:
    return local.astype(np.uint32 if many > 65_536 else np.uint16).tobytes()


def _of_texts(words: int, percent: int):
    """Of texts: node, size and the extended prefix of each."""

    def entries(batch):
        for text in batch.column(0).to_pylist():
            found = shingles(text, words)
            if len(found):
                yield node_name(found), len(found), found[: 2 * prefix_share(len(found), percent) - 1]

    return entries


def _of_sets(batch):
    """Of (node, label, grams): node, size and the whole set, hashed with the label, so that only sets of one group meet."""
    for node, label, grams in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
        found = np.frombuffer(grams, np.uint64)
        yield node, len(found), mix(found ^ mix(np.array([label], np.int64).view(np.uint64)))


def _pack(entries, bits: int, often: int):
    """Deal hashes to 2**bits buckets by their leading bits.

    Shingles of ``often`` nodes or more of a pack go to a bucket of their own, -1, with the whole hash, and are named as common in theirs.
    """

    def flush(pack: int, hashes, nodes, sizes):
        h, count = np.concatenate(hashes), np.array([len(x) for x in hashes])
        owner = np.repeat(np.arange(len(count), dtype=np.uint32), count)
        names, lengths = np.array(nodes, np.int64), np.array(sizes, np.uint32)
        distinct, back, many = np.unique(h, return_inverse=True, return_counts=True)
        hot = many >= often
        common, on = distinct[hot], hot[back]
        out: dict[str, list] = {c.split()[0]: [] for c in PACKED.split(", ")}

        def add(bucket: int, number: int, low: bytes, owner: np.ndarray, shared: bytes) -> None:
            used, local = np.unique(owner, return_inverse=True)
            for column, value in zip(out.values(), (bucket, number, low, narrow(local, len(used)), names[used].tobytes(), lengths[used].tobytes(), shared), strict=True):
                column.append(value)

        if len(common):
            add(-1, pack, h[on].tobytes(), owner[on], b"")
        h, owner = h[~on], owner[~on]

        def home(x: np.ndarray) -> np.ndarray:
            return (x >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(x), np.int64)

        place, shared = home(h), home(common)
        order = np.argsort(place, kind="stable")
        h, owner, place = h[order], owner[order], place[order]
        for bucket in np.union1d(place, shared):
            a, b = np.searchsorted(place, bucket, "left"), np.searchsorted(place, bucket, "right")
            add(int(bucket), 0, six_bytes(h[a:b]), owner[a:b], six_bytes(common[shared == bucket]))
        kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 5]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))

    def run(batches):
        forget()
        task = TaskContext.get().partitionId()
        seen, hashes, nodes, sizes, total, packs = set(), [], [], [], 0, 0
        for batch in slices(batches):
            for node, size, found in entries(batch):
                if node in seen:  # copies within a pack count once
                    continue
                seen.add(node)
                hashes.append(found)
                nodes.append(node)
                sizes.append(size)
                total += len(found)
                if total >= PACK:
                    yield flush(task << 32 | packs, hashes, nodes, sizes)
                    seen, hashes, nodes, sizes, total, packs = set(), [], [], [], 0, packs + 1
        if hashes:
            yield flush(task << 32 | packs, hashes, nodes, sizes)

    return run


def _shared(bits: int):
    """Of one bucket: the prefix shingles that at least two nodes have, with the number of those nodes, or ``COMMON``."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        give_back()
        apart = int(key[0]) < 0
        hs, nodes, sizes = [], [], []
        for low, owner, names, lengths in zip(pdf["low"], pdf["owner"], pdf["nodes"], pdf["sizes"], strict=True):
            names, lengths = np.frombuffer(names, np.int64), np.frombuffer(lengths, np.uint32)
            local = np.frombuffer(owner, np.uint32 if len(names) > 65_536 else np.uint16)
            hs.append(np.frombuffer(low, np.uint64) if apart else from_six_bytes(low))
            nodes.append(names[local])
            sizes.append(lengths[local])
        h, node, n = np.concatenate(hs), np.concatenate(nodes), np.concatenate(sizes)
        if apart:
            return pd.DataFrame({"node": node, "n": n.astype(np.int64), "h": h.view(np.int64), "df": np.full(len(h), COMMON)})
        common = np.unique(np.concatenate([from_six_bytes(c) for c in pdf["common"]]))
        order = np.argsort(h)
        h, node, n = h[order], node[order], n[order]
        same = np.concatenate([[False], h[1:] == h[:-1], [False]])
        often = (same[1:] | same[:-1]) | np.isin(h, common)
        h, node, n = h[often], node[often], n[often]
        order = np.lexsort((node, h))
        h, node, n = h[order], node[order], n[order]
        first = np.ones(len(h), bool)
        first[1:] = (h[1:] != h[:-1]) | (node[1:] != node[:-1])
        h, node, n = h[first], node[first], n[first]
        _, back, count = np.unique(h, return_inverse=True, return_counts=True)
        df = np.where(np.isin(h, common), COMMON, count[back])
        on = df > 1
        whole = (np.uint64(int(key[0])) << np.uint64(64 - bits) if bits else np.uint64(0)) | h[on]
        return pd.DataFrame({"node": node[on], "n": n[on].astype(np.int64), "h": whole.view(np.int64), "df": df[on].astype(np.int64)})

    return run


class _Branch:
    __slots__ = ("all_of", "ends", "kids", "least", "path", "rest")

    def __init__(self, path, rest: int, least: int, one: int | None) -> None:
        self.path, self.kids, self.ends = path, {}, []
        self.rest = rest  # most shingles below this path
        self.least = least  # size of the smallest set at or below
        self.all_of = one  # a member, if all members at or below are in one component


def trie_links(names: np.ndarray, sets: list[np.ndarray], percent: int, labels=None) -> list[tuple[int, int]]:
    """Links, as index pairs, that join what the threshold joins among ``sets``.

    Sets of one label count as joined from the start.
    """
    if len(sets) < 2:
        return []
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 10 * len(sets) + 1000))
    whole = np.concatenate(sets)
    _, back, count = np.unique(whole, return_inverse=True, return_counts=True)
    rank = np.empty(len(count), np.int64)
    rank[np.lexsort((np.arange(len(count)), -count))] = np.arange(len(count))
    common, forest, links = int((count > 1).sum()), Forest(), []
    cuts = np.cumsum([len(s) for s in sets])[:-1]
    ordered = [np.sort(r[r < common]) for r in np.split(rank[back], cuts)]
    if labels is not None:
        first: dict = {}
        for i, x in enumerate(labels):
            forest.union(first.setdefault(x, i), i)
    root, member, find = _Branch(np.zeros(0, np.int64), 0, 1 << 60, None), np.zeros(common + 1, bool), forest.find

    def walk(b: _Branch, i: int, n: int, x: np.ndarray, overlap: int) -> None:
        if b.all_of is not None and find(b.all_of) == find(i):
            return
        if len(b.path):
            overlap += int(member[b.path].sum())
            left = len(x) - int(np.searchsorted(x, b.path[-1], "right"))
        else:
            left = len(x)
        if (100 + percent) * (overlap + min(left, b.rest)) < percent * (n + b.least):
            return
        for j in b.ends:
            if (100 + percent) * overlap >= percent * (n + len(sets[j])) and find(i) != find(j):
                links.append((j, i))
                forest.union(i, j)
        for kid in b.kids.values():
            walk(kid, i, n, x, overlap)
        settle(b)

    def settle(b: _Branch) -> None:
        seen = {find(j) for j in b.ends}
        for kid in b.kids.values():
            if kid.all_of is None:
                b.all_of = None
                return
            seen.add(find(kid.all_of))
        b.all_of = seen.pop() if len(seen) == 1 else None

    def insert(i: int, n: int, x: np.ndarray) -> None:
        b, at, trail = root, 0, [root]
        while at < len(x):
            kid = b.kids.get(x[at])
            if kid is None:
                kid = _Branch(x[at:], 0, n, i)
                b.kids[x[at]] = kid
                trail.append(kid)
                b, at = kid, len(x)
                break
            part = x[at : at + len(kid.path)]
            differ = np.flatnonzero(part != kid.path[: len(part)])
            same = int(differ[0]) if len(differ) else len(part)
            if same < len(kid.path):
                upper = _Branch(kid.path[:same], kid.rest + len(kid.path) - same, kid.least, kid.all_of)
                kid.path = kid.path[same:]
                upper.kids[kid.path[0]] = kid
                b.kids[upper.path[0]] = upper
                kid = upper
            at += same
            b = kid
            trail.append(b)
        b.ends.append(i)
        done = 0
        for t in trail:
            done += len(t.path)
            t.least, t.rest = min(t.least, n), max(t.rest, len(x) - done)
        for t in reversed(trail):
            settle(t)

    for i in np.lexsort((names, [len(s) for s in sets])):
        i, x = int(i), ordered[int(i)]
        member[x] = True
        walk(root, i, len(sets[i]), x, 0)
        insert(i, len(sets[i]), x)
        member[x] = False
    return links


def _join_group(percent: int, labelled: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("node").sort_values("node")
        sets, names = [np.frombuffer(x, np.uint64) for x in pdf["grams"]], pdf["node"].to_numpy()
        links = trie_links(names, sets, percent, pdf["label"].tolist() if labelled else None)
        return pd.DataFrame({"a": [names[i] for i, _ in links], "b": [names[j] for _, j in links]}, dtype="int64")

    return run


def _keys(rows: DataFrame, entries, total: int, need: Column, often: int | None = None) -> DataFrame:
    """node, keys of the nodes that share at least ``need`` of their hashes: in order of rarity, as many as leave ``need`` - 1.

    A hash is common where a pack has it ``often``: so often that rarer ones can't fill a bucket from all packs.
    """
    bits = max(4, (max(1, total // BUCKET) - 1).bit_length())
    often = often or max(2, BUCKET // max(1, total // PACK))
    packs = rows.mapInArrow(_pack(entries, bits, often), PACKED)
    shared = packs.groupBy("bucket", "pack").applyInPandas(_shared(bits), "node long, n long, h long, df long")
    found = shared.groupBy("node", "n").agg(F.array_sort(F.collect_set(F.struct("df", "h"))).alias("have")).withColumn("need", need.cast("int"))
    return found.where("size(have) >= need").select("node", F.expr("transform(slice(have, 1, greatest(size(have) - need + 1, 0)), x -> x.h)").alias("keys"))


def candidates(docs: DataFrame, nodes: DataFrame, words: int, percent: int, often: int | None = None) -> DataFrame:
    """node, keys: the nodes that may have partners, each with shingles of which any partner has one."""
    total = nodes.agg(F.sum(F.col("kept") * F.col("members"))).first()[0] or 0
    least = F.expr(f"({percent}L * n + 99) div 100")  # the smallest partner
    need = least - F.expr(f"({percent}L * (({percent}L * n + 99) div 100) + 99) div 100") + 1
    return _keys(docs.select("text"), _of_texts(words, percent), total, need, often)


def _grams(words: int):
    def run(batches):
        forget()
        seen: set[int] = set()  # repeated rows of one id and text give their set once a task
        for batch in slices(batches):
            sets = [shingles(t, words) for t in batch.column(0).to_pylist()]
            mine = []
            for i, (s, node) in enumerate(zip(sets, batch.column(1).to_pylist(), strict=True)):
                if node not in seen and node_name(s) == node:
                    seen.add(node)
                    mine.append(i)
            take = pa.array(mine, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(1).take(take), batch.column(2).take(take), batch.column(3).take(take), pa.array([sets[i].tobytes() for i in mine], pa.binary())], names=["node", "label", "size", "grams"])

    return run


def listed(sets: DataFrame, percent: int, block: int) -> tuple[DataFrame, DataFrame]:
    """Of large coarse groups (node, label, grams): tries (trie, node) of at most ``block`` nodes, and groups (node, label) of nodes that share keys of more.

    Nodes that keys tie together are one trie, if they aren't too many; of others, those that share a key. Two linked nodes are together in
    a trie or a group. Nodes without partners drop out.
    """
    total = sets.agg(F.sum(F.octet_length("grams") / 8).cast("long")).first()[0] or 0
    keys = _keys(sets.select("node", "label", "grams"), _of_sets, total, F.expr(f"({percent}L * n + 99) div 100"))
    keyed = materialize(keys.select("node", F.explode("keys").alias("h")), "list-keys")
    parts = connected_components(keyed.select(F.col("node").alias("a"), F.col("h").alias("b")))  # nodes and keys are one graph
    mine = parts.join(keyed.select(F.col("node")).distinct(), "node")
    size = mine.groupBy("label").agg(F.count("*").alias("size"))
    sized = materialize(mine.join(size.where("size > 1"), "label"), "parts")
    small = sized.where(F.col("size") <= block).select(F.col("label").alias("trie"), "node")
    wide = materialize(keyed.join(sized.where(F.col("size") > block).select("node"), "node"), "wide-keys")
    counted = materialize(wide.groupBy("h").agg(F.count("*").alias("members"), F.min("node").alias("first")).where("members > 1"), "lists")
    few = wide.join(counted.where(F.col("members") <= block).select("h"), "h").groupBy("h").agg(F.array_sort(F.collect_set("node")).alias("nodes"))
    tries = few.select("nodes").distinct().select(F.xxhash64("nodes").alias("trie"), F.explode("nodes").alias("node")).distinct()
    often = _spread(wide, "h", counted.where(F.col("members") > block)).where("node <> first")
    return small.unionByName(tries), connected_components(often.select(F.col("node").alias("a"), F.col("first").alias("b")).distinct())


def coarse_groups(docs: DataFrame, nodes: DataFrame, words: int, percent: int) -> DataFrame:
    """node, label: groups of nodes that share a key of the prefix filter; two linked nodes are in one."""
    may = materialize(candidates(docs, nodes, words, percent), "candidates")
    keyed = materialize(may.select("node", F.explode("keys").alias("h")), "keys")
    meet = keyed.groupBy("h").agg(F.min("node").alias("b"), F.count("*").alias("members")).where("members > 1")
    return connected_components(_spread(keyed, "h", materialize(meet, "meet")).where("node <> b").select(F.col("node").alias("a"), "b").distinct())


def links(docs: DataFrame, nodes: DataFrame, words: int, percent: int, block: int = BLOCK, grouping=coarse_groups) -> DataFrame:
    """(a, b): nodes that the threshold links, enough of them to join every component. nodes: node, one (id and text hash of a document that has the set), members.

    ``grouping`` gives groups that no link crosses.
    """
    coarse = grouping(docs, nodes, words, percent)
    coarse = coarse.join(coarse.groupBy("label").agg(F.count("*").alias("size")), "label")
    one = materialize(nodes.join(coarse, "node").select("node", "label", "size", F.col("one.doc_id").alias("id"), F.col("one.key").alias("key")), "coarse")
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("digest"))
    texts = given.join(small_side(one), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("key")))
    sets = materialize(texts.select("text", "node", "label", "size").mapInArrow(_grams(words), "node long, label long, size long, grams binary"), "sets")
    coarse = sets.where(F.col("size") > block).dropDuplicates(["node"])
    found = materialize(sets.where(F.col("size") <= block).groupBy("label").applyInPandas(_join_group(percent, False), "a long, b long"), "links")
    if coarse.isEmpty():
        return found
    coarse = materialize(coarse.select("node", "label", "grams"), "large-groups")
    tries, hot = listed(coarse, percent, block)
    met = coarse.select("node", "grams").join(tries, "node").groupBy("trie").applyInPandas(_join_group(percent, False), "a long, b long")
    found = materialize(found.unionByName(met), "links")
    size = hot.groupBy("label").agg(F.count("*").alias("size"))
    alike = coarse.select("node", "grams").join(hot.join(size, "label"), "node")
    return found.unionByName(_by_blocks(materialize(alike, "alike"), percent, block))


def _by_blocks(sets: DataFrame, percent: int, block: int) -> DataFrame:
    """Links (a, b) that join every component within groups (node, label, size, grams), without gathering one."""
    blocks = F.ceil(F.col("size") / block)
    mine = F.pmod(F.xxhash64("node"), blocks)
    part = F.explode(F.when(blocks < 2, F.array(F.lit(0).cast("long"))).when(mine > 0, F.array(mine)).otherwise(F.sequence(F.lit(1).cast("long"), blocks - 1)))
    found = materialize(sets.withColumn("part", part).groupBy("label", "part").applyInPandas(_join_group(percent, False), "a long, b long"), "block-links")
    parts = connected_components(found)
    label = sets.select("node", F.col("label").alias("group"), mine.alias("mine"), blocks.alias("blocks")).distinct().join(parts, "node", "left").withColumn("label", F.coalesce("label", "node"))
    label = materialize(label, "labels")
    top = label.groupBy("group", "label").agg(F.count("*").alias("c")).groupBy("group").agg(F.max_by("label", F.struct("c", "label")).alias("top"))
    apart = label.join(top, "group").withColumn("outside", F.col("label") != F.col("top"))
    count = apart.groupBy("group").agg(F.ceil(F.count_if("outside") / block).alias("chunks"), F.ceil(F.count_if(~F.col("outside")) / block).alias("inner")).where("chunks > 0")
    at = F.when(F.col("outside"), F.pmod(F.xxhash64("node"), F.col("chunks"))).otherwise(F.col("chunks") + F.pmod(F.xxhash64("node"), F.col("inner")))
    placed = materialize(apart.join(count, "group").select("node", "group", "label", "chunks", (F.col("chunks") + F.col("inner")).alias("parts"), at.alias("at")), "placed")
    if placed.isEmpty():
        return found
    # Parts of nodes outside come first; each meets itself with every later part.
    first = F.sequence(F.lit(0).cast("long"), F.least("at", F.col("chunks") - 1))
    as_second = F.transform(F.filter(first, lambda i: i < F.col("at")), lambda i: F.struct(i.alias("i"), F.col("at").alias("j")))
    as_first = F.transform(F.when((F.col("at") < F.col("chunks")) & (F.col("at") + 1 < F.col("parts")), F.sequence(F.col("at") + 1, F.col("parts") - 1)).otherwise(F.array().cast("array<long>")), lambda j: F.struct(F.col("at").alias("i"), j.alias("j")))
    alone = F.when(F.col("parts") == 1, F.array(F.struct(F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"))))
    tasks = placed.select("node", "group", "label", F.inline(F.coalesce(alone, F.concat(as_second, as_first))))
    again = sets.select("node", "grams").join(tasks, "node")
    return found.unionByName(again.groupBy("group", "i", "j").applyInPandas(_join_group(percent, True), "a long, b long"))


def _spread(rows: DataFrame, key: str, each: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``each`` (key, members: rows of the key, ...). Keys of ``HOT`` rows or more, of which there are few, are joined by broadcast; no task gets all rows of one."""
    names = [c for c in each.columns if c not in (key, "members")]
    hot = each.where(F.col("members") >= HOT).drop("members")
    marked = rows.join(small_side(hot.withColumn("hot", F.lit(True))), key, "left")
    rest = marked.where("hot is null").drop("hot", *names).join(each.where(F.col("members") < HOT).drop("members"), key)
    return marked.where("hot").select(*rest.columns).unionByName(rest)


def _named(docs: DataFrame, words: int, percent: int, block: int, grouping=coarse_groups) -> DataFrame:
    """doc_id, n, c (name of the component) and key (a hash of the text) of every row of ``docs``."""
    if not 50 <= percent <= 100:
        raise ValueError("percent must be from 50 to 100")
    docs = docs.select("doc_id", "text")
    rows = materialize(node_table(docs, words, percent), "rows")
    nodes = materialize(rows.groupBy("node").agg(F.min(F.struct("doc_id", "key")).alias("one"), F.count("*").alias("members"), F.max("kept").alias("kept")), "nodes")
    label = connected_components(links(docs, nodes, words, percent, block, grouping))
    each = nodes.join(label.select("node", "label"), "node", "left").select("node", "members", F.coalesce("label", "node").alias("c"))
    return materialize(_spread(rows, "node", materialize(each, "labels")).select("doc_id", "n", "c", "key"), "named")


def _grouped(rows: DataFrame, *found: Column) -> DataFrame:
    """``rows`` with aggregates of their component ``c``."""
    return _spread(rows, "c", materialize(rows.groupBy("c").agg(*found, F.count("*").alias("members")), "components"))


def components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, block: int = BLOCK, grouping=coarse_groups) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text)."""
    named = _named(docs, words, percent, block, grouping)
    empty = named.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    full = _grouped(named.where("n > 0"), F.min("doc_id").alias("component_id"))
    return full.select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(empty)


def one_per_component(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: one row of each component stays, of smallest id, null ids last.

    Rows are told apart by their id and a 64-bit hash of their text, never by the id alone.
    Rows without shingles stay; rows equal in id and text stay once. Columns keep their names, whatever they are.
    """
    seen = _named(docs, words, percent, BLOCK)
    row = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")
    full = seen.where("n > 0").select("c", row.alias("row"))
    gone = _grouped(full, F.min("row").alias("stays")).where("row <> stays").select("row.doc_id", "row.key").distinct()
    out = materialize(gone.toDF("id", "digest"), "dropped")

    def same(rows: DataFrame) -> Column:
        return docs["doc_id"].eqNullSafe(rows["id"]) & (F.xxhash64(docs["text"]) == rows["digest"])

    left = docs.join(small_side(out), same(out), "left_anti")
    twice = materialize(seen.groupBy("doc_id", "key").agg(F.count("*").alias("many")).where("many > 1").select("doc_id", "key").toDF("id", "digest"), "twice")
    if twice.isEmpty():
        return left
    single = left.join(small_side(twice), same(twice), "left_anti")
    return single.unionByName(left.join(small_side(twice), same(twice), "left_semi").dropDuplicates(["doc_id", "text"]))
