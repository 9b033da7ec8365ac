import collections
import datetime
import hashlib
import heapq
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.llm import jaccard_join, leaderboard, minhash_dedup, prefix_trie, shingles
from tests.llm.test_llm import brute_components, edge, none, prose  # noqa: F401  (fixtures)


def test_minhash_edges(edge):  # noqa: F811
    rows = [(r["doc_id"], r["text"]) for r in edge.collect()]
    got = minhash_dedup.near_duplicates(edge)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    got = got.collect()
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components(rows, 5, 85)
    assert all(r["kept"] == (r["doc_id"] is not None and r["doc_id"] == r["component_id"]) for r in got)


def test_minhash_copies_near_the_threshold(spark, monkeypatch):
    """Copies with few and many changes, over small packs and buckets."""
    monkeypatch.setattr(minhash_dedup, "PACK", 40)
    monkeypatch.setattr(minhash_dedup, "BUCKET", 5_000)
    rng, rows = random.Random(12), []
    for i in range(240):
        w = prose(rng, rng.choice([5, 60, 250])).split() if i % 6 == 0 else list(rows[-1][1].split())
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = prose(rng, 1)
        rows.append((i, " ".join(w)))
    rows += [(300 + i, rows[0][1]) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = minhash_dedup.near_duplicates(df).drop("kept")
    assert collections.Counter(map(tuple, got.collect())) == brute_components(rows, 5, 85)


def test_minhash_of_nothing(none):  # noqa: F811
    assert minhash_dedup.near_duplicates(none).collect() == []


def test_tables_come_of_few_minhashes():
    found = shingles.shingles(prose(random.Random(1), 9000), 5)
    assert minhash_dedup.minhashes(found).size == 96
    keys = minhash_dedup.table_keys(found)
    assert len(set(keys.tolist())) == 256
    other = np.setdiff1d(found, found[:: len(found) // 400])
    shared = np.count_nonzero(keys == minhash_dedup.table_keys(other))
    assert 0 < shared < 256


def common_passage(rng, n):
    """Texts of one common passage and eight of a pool of n, no two alike."""
    common, pool = prose(rng, 400), [prose(rng, 25) for _ in range(n)]
    return [(i, " ".join([common, *rng.sample(pool, 8)])) for i in range(n)]


@pytest.mark.parametrize("grouping", [jaccard_join.coarse_groups, minhash_dedup.tensored_groups])
def test_common_passage_grows_in_proportion(spark, monkeypatch, grouping):
    """Sets that tries take, of texts that share a passage: as many for each text, however many texts there are."""
    taken = {}
    for n in (150, 600):
        rows = common_passage(random.Random(n), n)
        seen = []

        def counted(sets, percent, block, real=jaccard_join.listed, seen=seen):
            tries, hot = real(sets, percent, block)
            seen.append(tries.count() + hot.count())
            return tries, hot

        monkeypatch.setattr(jaccard_join, "listed", counted)
        got = jaccard_join.components(spark.createDataFrame(rows, "doc_id long, text string"), block=40, grouping=grouping).collect()
        monkeypatch.undo()
        assert collections.Counter(map(tuple, got)) == brute_components(rows, 4, 85)
        taken[n] = sum(seen)
    assert taken[600] <= 4 * 1.5 * max(taken[150], 150 * 4)


def test_large_families_and_strangers(spark):
    """One family above the block size, texts that share its passage without being alike, and small families."""
    rng = random.Random(8)
    base = prose(rng, 200).split()
    rows = []
    for i in range(60):
        w = list(base)
        w[rng.randrange(200)] = prose(rng, 1)
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(base[:120] + prose(rng, 80).split())) for i in range(40)]
    rows += [(200 + i, rows[60 + i % 7][1] + " end") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (7, 30):
        assert collections.Counter(map(tuple, jaccard_join.components(df, block=block).collect())) == brute_components(rows, 4, 85)


def brute_feed(lines, vendors, items):
    """The contract, line by line."""
    price, place = {x[0]: x[1] for x in items}, dict(vendors)
    by = collections.defaultdict(list)
    for sale, no, item, vendor, quantity, amount, flag, shipped in lines:
        h = zlib.crc32(",".join("" if x is None else str(x) for x in (sale, item, vendor, no)).encode())
        s = (shipped.date() - datetime.date(1970, 1, 1)).days if shipped else 19723 + h % 150
        a = s + h % 7 + (20 if h % 5 == 0 else 0)
        b = min(10, 1 + (a - 19723) * 10 // 180)
        if item not in price or place.get(vendor) is None:
            by[b].append((a, s, None, None, 0))
            continue
        worth = math.floor(100 * amount + 0.5) if amount is not None else quantity * math.floor(100 * price[item] + 0.5) if quantity is not None and price[item] is not None else 0
        by[b].append((a, s, place[vendor], item, -worth if flag == "swapped" else worth))
    largest, revenue, boards, out = None, collections.defaultdict(dict), collections.defaultdict(list), set()
    for b in sorted(by):
        kept = collections.defaultdict(list)
        for x in by[b]:
            if x[2] is not None and (largest is None or x[1] + 3 >= largest):
                kept[x[0]].append(x)
        largest = max([x[1] for x in by[b]] + ([] if largest is None else [largest]))
        for a in sorted(kept):
            for _, _, n, i, c in kept[a]:
                revenue[n][i] = revenue[n].get(i, 0) + c
            for n in {x[2] for x in kept[a]}:
                new = [i for _, i in heapq.nsmallest(10, [(-r, i) for i, r in revenue[n].items() if r > 0])]
                for i in set(new) | set(boards[n]):
                    old_rank, new_rank = [v.index(i) + 1 if i in v else None for v in (boards[n], new)]
                    if old_rank != new_rank:
                        out.add((n, a, i, b, "enter" if old_rank is None else "exit" if new_rank is None else "move", old_rank, new_rank, revenue[n][i]))
                boards[n] = new
    return out


LINES = "sale_id long, line_no int, item_id long, vendor_id long, quantity int, amount double, flag string, shipped_at timestamp_ntz"


def test_ladder_equals_line_by_line(spark):
    """Ties, repeats, nulls, unknown items, late and undated lines, negative revenues; clashing extra columns; few and many parts."""
    rng = random.Random(6)
    items = [(i, None if i == 3 else 1.5 * (i % 9)) for i in range(60)] + [(None, 5.0)]
    vendors = [(v, None if v == 4 else v % 2) for v in range(6)]
    lines = []
    for k in range(700):
        shipped = None if k % 19 == 0 else datetime.datetime(2024, 1, 1) + datetime.timedelta(days=rng.randint(0, 145), hours=rng.randint(0, 23))
        item = None if k % 23 == 0 else 1 if k % 3 == 0 else rng.randint(0, 65)
        lines.append((k // 3, k % 4, item, rng.randint(0, 6), rng.choice([None, 1, 2]), rng.choice([None, 1.0, 2.0, 2.005, 30.0]), rng.choice(["kept", "swapped", None]), shipped))
    lines += lines[:40]
    extra = {c: F.lit("z") for c in ("batch", "cents", "part", "at", "group_id", "h")}
    frames = spark.createDataFrame(lines, LINES).withColumns(extra), spark.createDataFrame(vendors, "vendor_id long, nation_id int"), spark.createDataFrame(items, "item_id long, price double")
    want = brute_feed(lines, vendors, items)
    for per_key in (4096, 9):
        got = [tuple(r) for r in leaderboard.change_feed(spark, *frames, items_per_key=per_key).collect()]
        assert len(got) == len(set(got)) > 100
        assert set(got) == want


def test_ladder_of_nothing(spark):
    frames = spark.createDataFrame([], LINES), spark.createDataFrame([], "vendor_id long, nation_id int"), spark.createDataFrame([], "item_id long, price double")
    assert leaderboard.change_feed(spark, *frames).collect() == []


def brute_trie(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = tuple(own.get(c - c % 5, [])[:h] + own[c][h:])
    members = collections.defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
    kids, leaves, saved = collections.defaultdict(list), {}, {}
    for n in members:
        if n:
            kids[n[:-1]].append(n)
    for n in sorted(members, key=len, reverse=True):
        leaves[n] = sum(leaves[k] for k in kids[n]) or 1
        saved[n] = sum(saved[k] for k in kids[n]) + ((len(members[n]) - 1) * len(n[-1][1].encode()) if n else 0)
    ends = {n: ",".join(str(c) for c in m if len(whole[c]) == len(n)) for n, m in members.items()}
    return {(m[0], len(n), members[n[:-1]][0] if n else None, len(m), len(kids[n]), leaves[n], saved[n], hashlib.sha256(ends[n].encode()).hexdigest()) for n, m in members.items()}


@pytest.mark.parametrize(("largest", "bucket", "segment"), [(2000, 20_000, 10_000), (20, 50, 3), (1, 1, 2)])
def test_trie_equals_brute_force(spark, monkeypatch, largest, bucket, segment):
    """Hot first turns, copies, long conversations, null and repeated turns; small limits make subtries part again and again."""
    monkeypatch.setattr(prefix_trie, "SEGMENT", segment)
    rng = random.Random(1)
    rows = [(c, t, rng.choice("ab"), rng.choice("xyz") * rng.randint(0, 2)) for c in range(60) for t in range(rng.choice([0, 1, 3, 9, 14]))]
    rows += [(100 + k, t, "u", "same") for k in range(20) for t in range(12)] + [(200, t, "u", None) for t in range(30)]
    rows += [(300, None, None, "é"), (300, 4, "q", "z"), (300, 4, "q", "z"), (None, 1, "a", "b"), (404, 0, "u", "only"), (404, 1, None, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("z") for c in ("p", "d", "k1", "top", "rep", "n", "part")})
    got = [tuple(r) for r in prefix_trie.conversation_trie(df, bucket, largest).collect()]
    want = brute_trie(rows)
    assert len(got) == len(want)
    assert set(got) == want


def test_trie_of_nothing(spark):
    assert prefix_trie.conversation_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
