import collections
import gzip
import math
import pathlib
import random
import re
import zlib

import numpy as np
import pytest
import tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from frameloom.llm import beta, components, decontaminate, jaccard_join, license_scan, packing, pivot_search, quality_rules, queries, shingles, token_store, tokens, unigram_counts, url_reputation, warc_fixity

SF = "/root/testdata/sf0.001"
PATH = tokens.public_path()


def prose(rng, n):
    return " ".join("".join(rng.choice(["th", "er", "on", "an", "re", "é"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def edge(spark):
    """Null and empty texts, null and repeated ids, a very long text, near copies, and clashing extra columns."""
    rng = random.Random(3)
    base = prose(rng, 400)
    rows = [(1, ""), (2, None), (3, "Hello World"), (3, "Hello World"), (None, "some words without an id"), (4, prose(rng, 30_000)), (5, base), (6, base + " x"), (7, base.upper()), (8, "   \n\t "), (9, "one")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    clashing = ("n_words", "component_id", "score", "node", "label", "n", "h", "w", "length", "start", "license", "row", "size", "id", "digest", "key", "y", "hit", "at", "met", "s0", "gram", "head", "_id", "_y", "_out", "_twice", "_bad_id", "_c_n_words", "s_n_words", "_s_n_words", "_key", "_doc", "_class")
    extra = {c: F.lit("z") for c in clashing}
    return df.withColumns(extra)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(name, same_as_sql):
    same_as_sql(queries.QUERIES[name], queries.ORACLES[name])


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_components(rows, k, percent):
    sets = []
    for _, text in rows:
        w = words_of(text)
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    low = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            low[find(i)] = min(doc_id, low.get(find(i), doc_id))
    return collections.Counter((d, len(sets[i]), low.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("block", [1000, 3])
def test_jaccard_edges(edge, block):
    rows = [(r["doc_id"], r["text"]) for r in edge.collect()]
    got = collections.Counter(map(tuple, jaccard_join.components(edge, block=block).collect()))
    assert got == brute_components(rows, 4, 85)


def test_jaccard_random_copies(spark):
    rng, rows = random.Random(11), []
    for i in range(150):
        w = prose(rng, rng.choice([6, 60, 200])).split() if i % 5 == 0 else list(rows[-1][1].split())
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = prose(rng, 1)
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (1000, 2):
        assert collections.Counter(map(tuple, jaccard_join.components(df, block=block).collect())) == brute_components(rows, 4, 85)


def test_frequent_shingles_lose_no_link(spark, monkeypatch):
    """A line that all texts share, common in some packs and not in others, small packs and small components joined by broadcast."""
    monkeypatch.setattr(jaccard_join, "PACK", 300)
    monkeypatch.setattr(jaccard_join, "BUCKET", 64)
    monkeypatch.setattr(jaccard_join, "HOT", 3)
    rng, rows = random.Random(5), []
    line = prose(rng, 30)
    for i in range(160):
        own = prose(rng, rng.choice([10, 40])).split() if i % 4 == 0 else list(rows[-1][2])
        if i % 4 and rng.random() < 0.7:
            own[rng.randrange(len(own))] = prose(rng, 1)
        rows.append((i, " ".join([*own, line] if i % 3 else own), own))
    rows = [(i, t) for i, t, _ in rows] + [(200 + i, rows[0][1]) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    nodes = jaccard_join.node_table(df, 4, 85).withColumn("members", F.lit(1))
    assert jaccard_join.candidates(df, nodes, 4, 85, often=2).count() >= jaccard_join.candidates(df, nodes, 4, 85, often=10**9).count() > 0
    for block in (1000, 5):
        assert collections.Counter(map(tuple, jaccard_join.components(df, block=block).collect())) == brute_components(rows, 4, 85)


def test_trie_finds_every_component():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 40, 20).astype(np.uint64)) for _ in range(80)]
    up = components.Forest()
    for i in range(80):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 50 * (len(sets[i]) + len(sets[j]) - both):
                up.union(i, j)
    got = components.Forest()
    for i, j in jaccard_join.trie_links(np.arange(80), sets, 50):
        got.union(i, j)
    assert [up.find(i) for i in range(80)] == [got.find(i) for i in range(80)]


def test_components_in_many_partitions(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    forest = components.Forest()
    for a, b in edges:
        if a != b:
            forest.union(a, b)
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long"), edges_per_task=30).collect()
    assert {r["node"]: r["label"] for r in got} == {x: forest.find(x) for x in list(forest.up)}


def test_shingles_are_of_words():
    a, b = shingles.shingles("The  cat\tsat ON the mat", 4), shingles.shingles("the cat sat on the mat", 4)
    assert a.tolist() == b.tolist()
    assert len(a) == 3
    assert len(shingles.shingles("one two", 4)) == 1


def ids_of(text, end):
    return [*tokenizers.Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, end]


def test_packing_round_trip(edge):
    rows = packing.pack_documents(edge, PATH, with_ids=True).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append(r)
        assert zlib.crc32(r["ids"]) == r["ids_crc32"]
    assert sorted(by) == list(range(len(by)))
    for v in by.values():
        at = 0
        for r in sorted(v, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    joined = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: r["start"]):
        joined[r["doc_id"]].append(r["ids"])
    long_text = next(r["text"] for r in edge.collect() if r["doc_id"] == 4)
    assert np.frombuffer(b"".join(joined[4]), "<u4").tolist() == ids_of(long_text, 1)
    assert sum(r["length"] for r in rows) == sum(len(ids_of(r["text"], 1)) for r in edge.collect())


def test_plan_takes_each_piece_once():
    rng = random.Random(4)
    histogram = {rng.randint(1, 64): rng.randint(1, 500) for _ in range(40)}
    taken = collections.Counter()
    uses = packing.plan(histogram, 64)
    for pattern, times in uses:
        assert sum(c * n for c, n in pattern.items()) <= 64
        for c, n in pattern.items():
            taken[c] += n * times
    assert taken == collections.Counter(histogram)


def test_token_store_round_trip(spark, edge, tmp_path):
    manifest = token_store.write(edge, f"file://{tmp_path}/store", PATH, shard_bytes=4000)
    rows = sorted(token_store.read(manifest, with_ids=True).collect(), key=lambda r: r["start"])
    docs = sorted(((r["doc_id"], r["text"]) for r in edge.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at = 0
    for r, (doc_id, text) in zip(rows, docs, strict=True):
        want = ids_of(text, 0)
        assert (r["doc_id"], r["start"], r["n_tokens"]) == (doc_id, at, len(want))
        assert np.frombuffer(r["ids"], "<u4").tolist() == want
        at += len(want)
    assert sum(len(token_store.Shard(m["file"]).find(3)) for m in manifest.collect()) == 2


def test_encoder_equals_whole_texts():
    """As the library encodes them that nothing was set on, tokens added to the vocabulary too."""
    texts = ["<|endoftext|>", "x <|endoftext|> hi<|endoftext|>", "a b  c", "x\x1cy \x85z", "日本語 ２３ ½²³", "don't we'll\n\n\n x", "<|endoftext|> hi", "é̀ ſ ž ƀ\r\n\t", None, " "]
    plain = tokenizers.Tokenizer.from_file(PATH)
    got = [np.frombuffer(b, "<u4").tolist() for b in tokens.encoder(PATH).encode(texts)]
    assert got == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert got[0] == [50256]


def test_unigram_counts_equal_viterbi(edge):
    scores = unigram_counts.load_scores(tokens.public_path("piece_bpe_32k.model"))
    longest = max(map(len, scores))

    def viterbi(w):
        best = [(0.0, 0)]
        for i in range(1, len(w) + 1):
            k = len(w[i - 1].encode())
            options = [(best[i - 1][0] + unigram_counts.BYTE_SCORE * k, -(best[i - 1][1] - 0) - k)]
            options += [(best[j][0] + scores[w[j:i]], -best[j][1] - 1) for j in range(max(0, i - longest), i) if w[j:i] in scores]
            top = max(options)
            best.append((top[0], -top[1]))
        return best[-1][1]

    got = {(r["doc_id"], r["n_pretokens"]): r["n_tokens"] for r in unigram_counts.token_counts(edge, tokens.public_path("piece_bpe_32k.model")).collect()}
    for r in edge.collect():
        if r["doc_id"] != 4:
            w = (r["text"] or "").split()
            assert got[r["doc_id"], len(w)] == sum(viterbi(unigram_counts.MARK + x) for x in w)


def test_quality_held_out(spark):
    rng, docs, labels = random.Random(9), [], []
    for i in range(1200):
        bad = i % 6 == 0
        text = prose(rng, rng.randint(20, 200))
        docs.append((i, text.upper().replace(" ", "!! ") if bad else text))
        labels.append((i, 0 if bad else 1))
    d, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality_rules.train(d, y)
    held = quality_rules.scored(d, model).where("held_out").collect()
    assert held
    assert np.mean([(r["doc_id"] % 6 != 0) == bool(r["predicted"]) for r in held]) > 0.98
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in quality_rules.scored(d, model).collect())


def test_quality_edges(spark, edge, none):
    labels = spark.createDataFrame([(5, 1), (6, None), (None, 0)], "doc_id long, quality int")
    model = quality_rules.train(edge, labels)
    scored = quality_rules.scored(edge, model).collect()
    assert len(scored) == edge.count()
    assert all(0 <= r["score"] <= 1 for r in scored)
    assert quality_rules.keep_quality(edge, model).columns == edge.columns
    assert quality_rules.scored(none, quality_rules.train(none, labels)).count() == 0


def test_compiled_rules_score_as_the_model(spark, edge):
    """The column against the model's own scores of the statistics, and these against counts by hand."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality_rules.train(docs, labels)
    assert model.rules
    for rows in (docs, edge):
        stats = quality_rules.with_statistics(rows, "text").toPandas()
        x = stats[[f"s_{n}" for n in quality_rules.NAMES]].to_numpy(float)
        want = sorted(round(float(v), 12) for v in model.score(x))
        assert want == sorted(round(r["score"], 12) for r in quality_rules.scored(rows, model).collect())
        for text, row in zip(stats["text"], stats.to_dict("records"), strict=True):
            text = text or ""
            words, lines = text.split(), text.split("\n")
            assert (row["s_n_chars"], row["s_n_words"]) == (len(text), len([w for w in re.split(r"[ \t\n\x0B\f\r]+", text) if w]))
            assert row["s_distinct_lines"] == (len(set(lines)) / len(lines) if text else 0)
            assert row["s_bangs"] == (text.count("!") / row["s_n_words"] if words and row["s_n_words"] else 0)
            assert row["s_digits"] == (len(re.findall("[0-9]", text)) / len(text) if text else 0)
    assert not [v for r in quality_rules.with_statistics(edge.where("coalesce(text, '') = ''"), "doc_id").collect() for k, v in r.asDict().items() if k != "doc_id" and v]


def test_many_test_windows_in_passes(spark):
    """Over 50,000 windows, and more hashes than one pass takes, give what plain search gives."""
    rng = random.Random(12)
    items = [(i, prose(rng, 110)) for i in range(560)]
    docs = [(i, prose(rng, 30) + " " + " ".join(items[i][1].split()[10 : 10 + 5 * (i % 4)]) + " " + prose(rng, 10)) for i in range(40)] + [(None, None), (7, items[5][1])]
    d, t = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*items, (900, "a b c")], "item_id long, text string")
    assert decontaminate.item_windows(t).count() > 50_000
    windows = collections.defaultdict(set)
    for i, text in [*items, (900, "a b c")]:
        w = decontaminate_words(text)
        for p in range(max(1, len(w) - 9)):
            windows[tuple(w[p : p + 10])].add(i)
    want = collections.Counter()
    for i, text in docs:
        w, hit, found = decontaminate_words(text or ""), set(), set()
        for size in (3, 10):
            for p in range(len(w) - size + 1):
                if (items_of := windows.get(tuple(w[p : p + size]))) and (size == 10 or len(w[p : p + size]) == 3):
                    hit |= set(range(p, p + size))
                    found |= items_of
        want[i, len(w), len(hit), len(found), len(hit) > 0] += 1
    for per_pass in (2_000_000, 20_000):
        got = decontaminate.report(d, t, per_pass=per_pass).collect()
        assert collections.Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in got) == want


def test_decontamination_edges(spark, edge, none):
    long_text = next(r["text"] for r in edge.collect() if r["doc_id"] == 4).split()
    items = spark.createDataFrame([(1, " ".join(long_text[100:112])), (2, "HELLO, world"), (3, None), (4, ""), (2, "hello world"), (None, "one")], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.report(edge, items).collect()}
    assert decontaminate.report(edge, items).count() == edge.count()
    assert (got[4]["contaminated"], got[4]["n_words"]) == (True, len(decontaminate_words(" ".join(long_text))))
    assert (got[3]["n_hit"], got[3]["n_items"]) == (2, 1)
    assert (got[9]["n_hit"], got[9]["n_items"]) == (1, 0)
    assert (got[2]["n_words"], got[2]["contaminated"]) == (0, False)
    kept = decontaminate.drop_contaminated(edge, items)
    assert kept.columns == edge.columns
    assert {r["doc_id"] for r in kept.collect()} == {1, 2, None, 5, 6, 7, 8} - ({5, 6, 7} & {k for k, r in got.items() if r["contaminated"]})
    assert decontaminate.report(none, items).count() == 0
    assert not decontaminate.report(edge, items.limit(0)).where("contaminated").count()


def decontaminate_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def test_rows_of_one_id_are_decided_one_by_one(spark):
    rng = random.Random(21)
    base, lone, own, other, again, copy, twin = (prose(rng, 60) for _ in range(7))
    rows = [
        (1, base), (None, base + " x"), (None, lone), (None, None), (2, own), (2, base + " y"), (2, other),
        (None, again), (None, again + " z"), (None, copy), (None, copy), (3, twin), (3, twin + " q"), (3, ""),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_key", F.lit("z"))
    kept = jaccard_join.one_per_component(df)
    assert kept.columns == df.columns
    left = collections.Counter((r["doc_id"], r["text"]) for r in kept.collect())
    for pair in [(None, again), (None, again + " z")], [(3, twin), (3, twin + " q")]:
        assert sum(left.pop(x, 0) for x in pair) == 1
    assert left == collections.Counter([(1, base), (None, lone), (None, None), (2, own), (2, other), (None, copy), (3, "")])
    items = spark.createDataFrame([(1, " ".join(lone.split()[5:20])), (2, " ".join(own.split()[5:20]))], "item_id long, text string")
    clean = collections.Counter((r["doc_id"], r["text"]) for r in decontaminate.drop_contaminated(df, items).collect())
    assert clean == collections.Counter(rows) - collections.Counter([(None, lone), (2, own)])


def test_license_edges(spark, edge, none):
    notices = spark.createDataFrame([(1, "x " * 7 + "Released under the MIT license! y"), (2, "Released under the"), (3, None), (4, "licensed under CC BY-NC 4.0"), (4, "licensed under CC BY-NC 4.0")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["license"]) for r in license_scan.scan(notices).collect()) == [(1, "mit"), (4, "cc-by-nc-4.0")]
    assert license_scan.scan(edge).count() == 0
    assert license_scan.scan(none).count() == 0
    with pytest.raises(ValueError, match="five|5"):
        license_scan.template_words("too short")


def test_search_equals_brute_force(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 16)).astype(np.float32)
    x[50:60] = x[0]
    x[7, 3], x[8, 2], x[200, 5], x[9, 1] = 2.0**17, -(2.0**40), 2.0**30, 2.0**16
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(400, None), (500, [float("nan")] * 16), (600, [None] * 16), (700, []), (800, [float("inf")]), (None, x[1].tolist()), (100, x[100].tolist()), (201, [3.0e38, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit("z") for c in ("x", "far", "query_id", "score", "part")})
    whole = {i: [math.floor(1024 * e) for e in v.tolist()] for i, v in enumerate(x.astype(float))}
    whole[201] = [int(float(np.float32(3.0e38))) * 1024, 1024, *[0] * 14]
    got = collections.defaultdict(list)
    for r in sorted(pivot_search.search(df, F.col("vec_id") % 100 == 0, many=12, block=2).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    ids = [*range(300), 100, 201]
    whole[700] = [0] * 16
    seen = [(i, whole[i]) for i in range(300)] + [(100, whole[100])] + [(201, whole[201])]
    seen = [(i, [math.floor(1024 * e) for e in x[201].astype(float).tolist()]) if n == 201 else (i, w) for n, (i, w) in enumerate(seen)]
    assert len(seen) == len(ids)
    seen.append((700, whole[700]))
    for q in (0, 100, 200, 700):
        best = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(w, whole[q], strict=True)))), i) for i, w in seen if i != q)[:10]
        assert got[q] == [(i, -s) for s, i in best]
    assert set(got) == {0, 100, 200, 700}
    assert pivot_search.search(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_rows_of_one_query_id_ask_each(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [0.0, 1.0]), (1, [5.0, 1.0]), (2, [1.0, 5.0])]
    got = pivot_search.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got) == [(1, 1, 5 * 2**20), (1, 2, 5 * 2**20), (2, 1, 2**20), (2, 2, 2**20)]


def test_pivots_eliminate(spark):
    """Of random directions, the hardest case, most candidates go before they are evaluated once the pivots are three quarters of the width."""
    share = pivot_search.evaluated_share(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").coalesce(1), F.col("vec_id") % 100 == 0)
    assert share < 0.4


def test_fixity_finds_damage(spark):
    rows = [(i, f"http://h/{i}", f"<p>{i}</p>") for i in range(700)] + [(None, None, None), (5, "http://h/again", "x"), (9000, "u", "v")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    hurt = F.when(F.col("page_id") == 17, "<p>1x</p>").otherwise(F.col("html"))
    a = warc_fixity.replica(pages)
    assert warc_fixity.audit(a, warc_fixity.replica(pages)).count() == 0
    report = warc_fixity.audit_report(a, warc_fixity.replica(pages, hurt)).where("status <> 'intact'").collect()
    assert [(r["page_id"], r["status"]) for r in report] == [(17, "altered")]
    lost = warc_fixity.audit_report(a, warc_fixity.replica(pages.where("page_id is null or page_id not in (9000, 18)"))).where("status <> 'intact'").collect()
    assert sorted((r["page_id"], r["status"]) for r in lost) == [(18, "missing in b"), (9000, "missing in b")]
    more = warc_fixity.audit_report(warc_fixity.replica(pages.where("page_id is null or page_id <> 300")), a).where("status <> 'intact'").collect()
    assert [(r["page_id"], r["status"]) for r in more] == [(300, "missing in a")]
    longer = warc_fixity.audit_report(a, warc_fixity.replica(pages, F.when(F.col("page_id") == 40, F.repeat("html", 50)).otherwise(F.col("html")))).where("status <> 'intact'").collect()
    assert [(r["page_id"], r["status"]) for r in longer] == [(40, "altered")]
    swap = F.when(F.col("record") == 30, a.where("record = 31").first()["start"]).when(F.col("record") == 31, a.where("record = 30").first()["start"]).otherwise(F.col("start"))
    turned = a.where("file = 0").withColumn("length", F.col("end") - F.col("start")).withColumn("start", swap).withColumn("end", F.col("start") + F.col("length"))
    assert {r["status"] for r in warc_fixity.audit_report(a.where("file = 0"), turned).where("status <> 'intact'").collect()} == {"moved"}
    assert warc_fixity.audit(warc_fixity.replica(pages.limit(0)), warc_fixity.replica(pages.limit(0))).count() == 0


def test_fixity_of_many_copies(spark):
    pages = spark.range(5000).select((F.col("id") % 3).alias("page_id"), F.lit("u").alias("url"), F.col("id").cast("string").alias("html"))
    a = warc_fixity.replica(pages)
    hurt = warc_fixity.replica(pages, F.when(F.col("html") == "77", "?").otherwise(F.col("html")))
    report = warc_fixity.audit_report(a, hurt).collect()
    assert len(report) == 5000
    assert {r["page_id"] for r in report if r["status"] != "intact"} == {77 % 3}


def test_fixity_finds_damage_of_files(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i} é</p>") for i in range(0, 7 * 4096, 512)] + [(None, None, None)], "page_id long, url string, html string")
    index = warc_fixity.write_files(pages)
    a, hurt = warc_fixity.read_files(index), warc_fixity.write_files(pages)
    at = {r["page_id"]: r for r in hurt.collect()}
    paths = [at[k * 4096]["uri"].removeprefix("file://") for k in range(7)]
    texts = [gzip.decompress(pathlib.Path(p).read_bytes()) for p in paths]
    for r in at.values():
        assert texts[r["file"]][r["start"] : r["end"]].startswith(b"WARC/1.1\r\n")
    assert warc_fixity.audit(a, warc_fixity.read_files(hurt)).count() == 0

    def rewrite(k, change):
        old = pathlib.Path(paths[k]).read_bytes()
        pathlib.Path(paths[k]).write_bytes(change(old))

    second = at[2 * 4096 + 512]["at"]
    rewrite(1, lambda b: b[:4] + b"\x01" + b[5:])  # the time in the first member's header
    rewrite(2, lambda b: b[:second] + b"?" + b[second:])  # offsets shifted
    cut = at[3 * 4096 + 6 * 512]
    rewrite(3, lambda b: b[: cut["at"] + cut["size"] - 3])  # tail lost, the last record wholly
    rewrite(4, lambda b: b + b"more")
    pathlib.Path(paths[5]).unlink()
    gone = at[6 * 4096 + 3 * 512]
    rewrite(6, lambda b: b[: gone["at"]] + b[gone["at"] + gone["size"] :])  # one record lost
    bad = warc_fixity.audit_report(a, warc_fixity.read_files(hurt)).where("status <> 'intact'").collect()
    got = collections.Counter((r["file"], r["record"], r["status"]) for r in bad)
    assert got == collections.Counter([(1, 0, "altered"), (3, 6, "altered"), (3, 7, "missing in b"), (4, 8, "missing in a"), *((5, k, "missing in b") for k in range(8)), (6, 3, "missing in b")])


def test_url_rules_and_reputation(spark):
    pages = [(1, "https://A.Example.ORG/es/1?x"), (2, "http://example.org"), (3, None), (4, "no scheme"), (5, "http://x.com/de/#a"), (6, "http://x.com/fr/"), (7, "ftp://y.net/p")] + [(100 + i, "http://bad.spam.net/") for i in range(60)] + [(200 + i, f"http://h{i % 9}.fine.net/") for i in range(60)]
    outcomes = [(100 + i, 1) for i in range(60)] + [(200 + i, 0) for i in range(60)] + [(None, 1), (1, None)]
    got = {r["page_id"]: r for r in url_reputation.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(outcomes, "page_id long, bad int")).collect()}
    assert [got[i]["verdict"] for i in (1, 2, 3, 4, 5, 6, 7, 100, 200)] == ["block", "allow", "allow", "allow", "block", "allow", "allow", "block", "allow"]
    assert [got[i]["rule"] for i in (1, 2, 5, 100)] == ["example.org/es/", None, "com/de/", None]
    assert (got[1]["host"], got[1]["path"], got[4]["host"]) == ("a.example.org", "/es/1", "")


def beta_below(x, a, b, steps=4000):
    """Distribution function by summing the density in logits."""
    z = np.linspace(-60, 60, 40 * steps + 1)
    log_p = a * -np.log1p(np.exp(-z)) + b * -np.log1p(np.exp(z))
    weight = np.exp(log_p - log_p.max())
    return weight[z <= np.log(x / (1 - x))].sum() / weight.sum()


@pytest.mark.parametrize(("a", "b"), [(0.3, 1.2), (1.0, 1.0), (2.5, 7.0), (40.0, 3.0), (300.0, 900.0), (9000.0, 100.0)])
def test_beta_quantiles(spark, a, b):
    row = spark.range(1).select(F.lit(a).alias("a"), F.lit(b).alias("b"))
    x = row.select(beta.quantile(0.05, F.col("a"), F.col("b"), beta.log_beta(F.col("a"), F.col("b")))).first()[0]
    assert abs(beta_below(x, a, b) - 0.05) < 2e-3
    assert math.isclose(row.select(beta.log_gamma(F.col("a"))).first()[0], math.lgamma(a), rel_tol=1e-9, abs_tol=1e-9)


def test_reputation_by_hand(spark):
    """The shrinkage recomputed in plain Python, and the labels that pages get from their paths."""
    rng = random.Random(17)
    pages, bad = [], {}
    for i in range(600):
        host = f"h{i % 7}.d{i % 3}.{'co.uk' if i % 2 else 'net'}"
        pages.append((i, f"http://{host}/en/{1000 + i}{rng.choice(['', '.html', '/', '?x=1'])}"))
        if i % 5:
            bad[1000 + i] = int(rng.random() < (0.9 if i % 7 == 0 else 0.1))
    pages += [(900, "http://only.org/about"), (901, None), (902, "http://h0.d0.net/en/1000x")]
    labels = [(d, 1 - b, None) for d, b in bad.items()] + [(5000, None, None), (None, 0, 1)]
    p, y = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    outcomes = {r["page_id"]: r["bad"] for r in url_reputation.outcomes_from_labels(p, y).collect()}
    assert outcomes == {d - 1000: b for d, b in bad.items()}
    hosts = collections.defaultdict(lambda: [0, 0])
    for i, url in pages:
        if url:
            h = hosts[url.split("/")[2]]
            if i in outcomes:
                h[0] += 1
                h[1] += outcomes[i]

    def suffix(h):
        return "co.uk" if h.endswith("co.uk") else h.split(".")[-1]

    def domain(h):
        return h if h == suffix(h) else ".".join(h.split(".")[-len(suffix(h).split(".")) - 1 :])

    def level(groups, prior):
        over = sum(n * (k / n - prior[g][0]) ** 2 / (prior[g][0] * (1 - prior[g][0])) - 1 for g, (n, k) in groups.items() if n > 1)
        pairs, many = sum(n - 1 for n, _ in groups.values() if n > 1), sum(n > 1 for n, _ in groups.values())
        rho = min(max(over / pairs if many > 1 else 0.5, 1e-3), 0.5)
        out = {}
        for g, (n, k) in groups.items():
            m, known = prior[g]
            kappa = min((1 - rho) / rho, known)
            out[g] = (kappa * m + k, kappa * (1 - m) + n - k)
        return out

    def up(name):
        out = collections.defaultdict(lambda: [0, 0])
        for h, (n, k) in hosts.items():
            out[name(h)][0] += n
            out[name(h)][1] += k
        return out

    total, all_bad = sum(n for n, _ in hosts.values()), sum(k for _, k in hosts.values())
    first = ((all_bad + 1) / (total + 2), total + 2)
    suffixes = level(up(suffix), {suffix(h): first for h in hosts})
    mean = {g: (a / (a + b), a + b) for g, (a, b) in suffixes.items()}
    domains = level(up(domain), {domain(h): mean[suffix(h)] for h in hosts})
    mean = {g: (a / (a + b), a + b) for g, (a, b) in domains.items()}
    want = level(hosts, {h: mean[domain(h)] for h in hosts})
    found = {r["host"]: r for r in url_reputation.judge_urls(p, url_reputation.outcomes_from_labels(p, y), max_bad=0.3).where("host <> ''").collect()}
    assert set(found) == set(hosts)
    for h, (a, b) in want.items():
        assert math.isclose(found[h]["bad_mean"], a / (a + b), rel_tol=1e-9)
        assert abs(beta_below(found[h]["bad_bound"], a, b) - 0.05) < 3e-3
        assert found[h]["verdict"] == ("block" if found[h]["bad_bound"] > 0.3 else "allow")
    assert {found[h]["verdict"] for h in hosts if h.startswith("h0.")} == {"block"}
    assert {found[h]["verdict"] for h in hosts if not h.startswith("h0.")} == {"allow"}


def test_pipeline(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "sequence_id", "offset"} <= set(rows.columns)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name
    kept = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert jaccard_join.components(kept, 5, 80).where("doc_id <> component_id").count() == 0


def test_pipeline_of_odd_tables(spark, edge, none, tmp_path):
    """Nulls, repeats, long texts, clashing columns and an empty table go through all stages; a stage's rows keep their columns."""
    spark.createDataFrame([(5, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "nothing of this"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for stage, f in corpus_pipeline.STAGES[:-1]:
        assert f(spark, edge, str(tmp_path)).columns == edge.columns, stage
    edge.write.parquet(f"{tmp_path}/documents.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {r["doc_id"] for r in rows}
    assert {2, 3, None, 4, 5, 8, 9} <= kept
    assert 6 not in kept
    none.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_empty_tables(spark, none, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert token_store.round_trip(spark, none, PATH).count() == 0
    assert warc_fixity.audit_report(warc_fixity.replica(pages), warc_fixity.replica(pages)).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert url_reputation.judge_urls(pages, url_reputation.outcomes_from_labels(pages, labels)).count() == 0


def test_empty_documents(none):
    assert jaccard_join.components(none).count() == 0
    assert packing.pack_documents(none, PATH).count() == 0
    assert unigram_counts.token_counts(none, tokens.public_path("piece_bpe_32k.model")).count() == 0
