"""The pipeline and the packing against plain computations over whole tables."""

import collections
import re
import zlib

import numpy as np
import pytest
import tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from frameloom.llm import quality_rules, tokens, url_reputation, warc_fixity
from frameloom.llm.queries import QUERIES
from tests.llm.test_llm import SF, brute_components

PATH = tokens.public_path()


@pytest.fixture(scope="module")
def ids():
    """The ids of a text as the library gives them, and the end."""
    plain = tokenizers.Tokenizer.from_file(PATH)
    return lambda text: np.array([*plain.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def test_packing_of_all_documents(spark, ids):
    """Every piece's start, length, checksum and document length; sequences without gaps; little padding."""
    docs = {r["doc_id"]: ids(r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op1_cutting_stock_packing"](spark, SF).collect()
    pieces, held = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        held[r["sequence_id"]].append(r)
    assert set(pieces) == set(docs)
    for doc_id, found in pieces.items():
        at = 0
        for r in sorted(found, key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(docs[doc_id]))
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(docs[doc_id][r["start"] : at].tobytes())
        assert at == len(docs[doc_id])
    padding = 0
    for found in held.values():
        at = 0
        for r in sorted(found, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding <= 0.05 * sum(map(len, docs.values())) + 2048


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_pipeline_equals_plain_stages(spark, ids):
    """Each stage recomputed on what the one before keeps: scores by the fitted model, components and windows by brute force, ids by the library."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    model = quality_rules.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    left = {r["doc_id"] for r in quality_rules.scored(docs, model).where("predicted = 1").collect()}
    assert 0 < len(left) < len(texts)
    groups = {d: c for (d, _, c), n in brute_components([(d, texts[d]) for d in sorted(left)], 5, 80).items() if n}
    left = {d for d in left if groups[d] == d}
    grams = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = item_words(r["text"])
        grams |= {tuple(w[i : i + min(10, len(w))]) for i in range(len(w) - min(10, len(w)) + 1)} if w else set()
    sizes = {len(g) for g in grams}

    def clean(text):
        w = item_words(text)
        return not any(tuple(w[i : i + k]) in grams for k in sizes for i in range(len(w) - k + 1))

    left = {d for d in left if clean(texts[d])}
    got = corpus_pipeline.run(spark, SF).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("whole")).collect()
    assert {r["doc_id"]: (r["n"], r["whole"]) for r in got} == {d: (len(ids(texts[d])),) * 2 for d in left}


def test_clashing_columns_of_pages(spark):
    """Fixity and reputation give the same with extra columns of any name."""
    rows = [(i, f"http://h{i % 3}.example.org/en/{i}.html", f"<p>{i}</p>") for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    extra = pages.withColumns({c: F.lit("z") for c in ("file", "record", "start", "end", "sha256", "status", "node", "level", "host", "path", "rule", "verdict", "bound", "domain", "suffix", "good", "bad", "n", "key")})
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    judged = [url_reputation.judge_urls(p, url_reputation.outcomes_from_labels(p, labels)) for p in (pages, extra)]
    assert sorted(map(tuple, judged[0].collect())) == sorted(map(tuple, judged[1].collect()))
    audits = [warc_fixity.audit_report(warc_fixity.replica(p), warc_fixity.replica(p)) for p in (pages, extra)]
    assert sorted(map(tuple, audits[0].collect()), key=repr) == sorted(map(tuple, audits[1].collect()), key=repr)
