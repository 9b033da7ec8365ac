"""The operators applied to whole tables, with SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.llm import decontaminate, jaccard_join, leaderboard, license_scan, minhash_dedup, oracles, packing, pivot_search, prefix_trie, quality_rules, token_store, unigram_counts, url_reputation, warc_fixity
from frameloom.llm.common import table
from frameloom.llm.tokens import public_path


def op1_cutting_stock_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), public_path())
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(table(spark, sf_dir, "documents"), words=4, percent=85)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def _op3_sql() -> str:
    split = "regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    rows = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in license_scan.TEMPLATES.items())
    return f"""
WITH t AS (SELECT license, {split.format("text")} AS w FROM (VALUES {rows}) AS v(license, text)),
ts AS (SELECT DISTINCT license, array_to_string(list_slice(w, p, p + 4), ' ') AS s FROM (SELECT license, w, unnest(range(1, len(w) - 3)) AS p FROM t)),
n AS (SELECT license, count(*) AS n_template FROM ts GROUP BY license),
d AS (SELECT doc_id, {split.format("text")} AS w FROM documents),
ds AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, p, p + 4), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS p FROM d))
SELECT doc_id, license, CAST(count(*) AS BIGINT) AS n_shared, CAST(any_value(n_template) AS BIGINT) AS n_template
FROM ds JOIN ts USING (s) JOIN n USING (license) GROUP BY doc_id, license HAVING count(*) * 100 >= any_value(n_template) * 80
"""


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality_rules.scored(docs, quality_rules.train(docs, labels))


def op5_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_search.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP5_SQL = """
WITH v AS (SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, coalesce(CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT), 0) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM p) WHERE r <= 10
"""


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.round_trip(spark, table(spark, sf_dir, "documents"), public_path())


def op7_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of two replicas of all pages; in the second, the last character of every page whose id leaves 5 modulo 97 is altered."""
    pages = table(spark, sf_dir, "pages")
    hurt = F.when(F.col("page_id") % 97 == 5, F.expr("concat(substr(html, 1, length(html) - 1), '~')")).otherwise(F.col("html"))
    return warc_fixity.audit_report(warc_fixity.replica(pages), warc_fixity.replica(pages, hurt))


OP7_SQL = r"""
WITH h AS (SELECT page_id, url, html, CASE WHEN page_id % 97 = 5 THEN concat(substr(html, 1, length(html) - 1), '~') ELSE html END AS html_b FROM pages),
r AS (SELECT page_id, CAST(floor(page_id / 4096.0) AS BIGINT) AS file,
  concat('WARC/1.1', chr(13), chr(10), 'WARC-Type: resource', chr(13), chr(10), 'WARC-Record-ID: <urn:page:', page_id, '>', chr(13), chr(10), 'WARC-Target-URI: ', url, chr(13), chr(10),
         'Content-Type: text/html', chr(13), chr(10), 'Content-Length: ', strlen(html), chr(13), chr(10), chr(13), chr(10), html, chr(13), chr(10), chr(13), chr(10)) AS a,
  concat('WARC/1.1', chr(13), chr(10), 'WARC-Type: resource', chr(13), chr(10), 'WARC-Record-ID: <urn:page:', page_id, '>', chr(13), chr(10), 'WARC-Target-URI: ', url, chr(13), chr(10),
         'Content-Type: text/html', chr(13), chr(10), 'Content-Length: ', strlen(html_b), chr(13), chr(10), chr(13), chr(10), html_b, chr(13), chr(10), chr(13), chr(10)) AS b FROM h)
SELECT page_id, file, CAST(row_number() OVER (PARTITION BY file ORDER BY page_id) - 1 AS BIGINT) AS record,
  CAST(sum(strlen(a)) OVER (PARTITION BY file ORDER BY page_id) - strlen(a) AS BIGINT) AS start, CAST(sum(strlen(a)) OVER (PARTITION BY file ORDER BY page_id) AS BIGINT) AS stop,
  sha256(a) AS sha256, CASE WHEN a <> b THEN sha256(b) END AS replica_sha256, CASE WHEN a <> b THEN 'altered' ELSE 'intact' END AS status
FROM r
"""


def op8_unigram_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram_counts.token_counts(table(spark, sf_dir, "documents"), public_path("piece_bpe_32k.model"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), g AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, p, p + least(len(w), 10) - 1), ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM b WHERE len(w) > 0)
), lens AS (SELECT DISTINCT n FROM g),
win AS (
  SELECT doc_id, n, p, array_to_string(list_slice(w, p, p + n - 1), ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, lens)
), hit AS (
  SELECT win.doc_id, win.n, win.p, g.item_id FROM win JOIN g ON win.n = g.n AND win.gram = g.gram
), cov AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS k FROM hit) GROUP BY doc_id
), it AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(i, ',' ORDER BY i)) AS s
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(cov.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(it.n_items, 0) AS BIGINT) AS n_items,
       coalesce(it.s, sha256('')) AS items_sha256, coalesce(cov.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov ON d.doc_id = cov.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
"""


def op10_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_reputation.judge_urls(pages, url_reputation.outcomes_from_labels(pages, table(spark, sf_dir, "labels")))


def op11_revenue_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, vendors, items = (table(spark, sf_dir, n) for n in ("sale_lines", "vendors", "items"))
    return leaderboard.change_feed(spark, lines, vendors, items).withColumnRenamed("group_id", "nation_id")


def op12_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_cutting_stock_packing, op2_ngram_jaccard_join, op3_license_scan, op4_quality_rules, op5_pivot_search,
        op6_token_store, op7_warc_fixity, op8_unigram_token_counts, op9_benchmark_decontamination, op10_url_reputation, op11_revenue_ladder, op12_tensored_minhash, op13_conversation_trie,
    )
}
ORACLES = {
    "op2_ngram_jaccard_join": oracles.near_components(4, 85, kept=False), "op3_license_scan": _op3_sql(), "op5_pivot_search": OP5_SQL, "op7_warc_fixity": OP7_SQL, "op9_benchmark_decontamination": OP9_SQL,
    "op11_revenue_ladder": oracles.LEADERBOARD, "op12_tensored_minhash": oracles.near_components(5, 85, kept=True), "op13_conversation_trie": oracles.TRIE,
}
