"""SQL for the operators that SQL can express, beside those whose SQL stands with their query."""

from __future__ import annotations

#: The table of the reflected polynomial 0xEDB88320, and the crc32 of a text of ASCII characters by it.
CRC_TABLE = "crc_table AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM (SELECT unnest(range(0, 256)) AS i)))"


def crc32(text: str) -> str:
    """Needs a row of crc_table, t, beside."""
    codes = f"list_transform(string_split({text}, ''), lambda c: CAST(ord(c) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295)"


def near_components(words: int, percent: int, kept: bool) -> str:
    """Documents linked by the Jaccard similarity of their shingles, with the smallest id that links reach."""
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
k AS (SELECT doc_id, w, least(len(w), {words}) AS k FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, p, p + k - 1), ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM k)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM i JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= {percent} * (nx.n + ny.n - c)),
b AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
r AS (SELECT doc_id AS node, doc_id AS seen FROM d UNION SELECT r.node, b.y FROM r JOIN b ON b.x = r.seen),
c AS (SELECT node AS doc_id, min(seen) AS component_id FROM r GROUP BY node)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id{", doc_id = component_id AS kept" if kept else ""} FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""


LEADERBOARD = f"""
WITH {CRC_TABLE},
x AS (SELECT *, concat(coalesce(CAST(sale_id AS VARCHAR), ''), ',', coalesce(CAST(item_id AS VARCHAR), ''), ',', coalesce(CAST(vendor_id AS VARCHAR), ''), ',', coalesce(CAST(line_no AS VARCHAR), '')) AS id FROM sale_lines),
h AS (SELECT x.*, {crc32("id")} AS h FROM x, crc_table),
s AS (SELECT *, coalesce(CAST(CAST(shipped_at AS DATE) - DATE '1970-01-01' AS BIGINT), 19723 + h % 150) AS s FROM h),
a AS (SELECT *, s + h % 7 + CASE WHEN h % 5 = 0 THEN 20 ELSE 0 END AS a FROM s),
l AS (SELECT a, s, least(10, 1 + CAST(floor((a - 19723) * 10 / 180.0::DOUBLE) AS BIGINT)) AS batch, nation_id, items.item_id,
  CASE WHEN flag = 'swapped' THEN -1 ELSE 1 END * coalesce(CAST(floor(100 * amount + 0.5::DOUBLE) AS BIGINT), quantity * CAST(floor(100 * price + 0.5::DOUBLE) AS BIGINT), 0) AS cents
  FROM a LEFT JOIN vendors USING (vendor_id) LEFT JOIN items ON items.item_id = a.item_id),
m AS (SELECT batch, max(max(s)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM l GROUP BY batch),
ev AS (SELECT nation_id, item_id, a, sum(cents) AS cents FROM l JOIN m USING (batch) WHERE nation_id IS NOT NULL AND item_id IS NOT NULL AND (seen IS NULL OR s + 3 >= seen) GROUP BY ALL),
spans AS (SELECT nation_id, item_id, a, CAST(sum(cents) OVER w AS BIGINT) AS revenue, lead(a) OVER w AS until FROM ev WINDOW w AS (PARTITION BY nation_id, item_id ORDER BY a)),
days AS (SELECT nation_id, a AS day, row_number() OVER (PARTITION BY nation_id ORDER BY a) AS i FROM (SELECT DISTINCT nation_id, a FROM ev)),
board AS (SELECT nation_id, day, i, item_id, revenue, row_number() OVER (PARTITION BY nation_id, day ORDER BY revenue DESC, item_id) AS rank
  FROM days JOIN spans USING (nation_id) WHERE a <= day AND (until IS NULL OR day < until) AND revenue > 0 QUALIFY rank <= 10),
ch AS (SELECT n.nation_id, n.day, n.item_id, o.rank AS old_rank, n.rank AS new_rank, n.revenue FROM board n LEFT JOIN board o ON o.nation_id = n.nation_id AND o.item_id = n.item_id AND o.i = n.i - 1 WHERE o.rank IS NULL OR o.rank <> n.rank
  UNION ALL SELECT o.nation_id, d.day, o.item_id, o.rank, NULL, s.revenue FROM board o JOIN days d ON d.nation_id = o.nation_id AND d.i = o.i + 1
    JOIN spans s ON s.nation_id = o.nation_id AND s.item_id = o.item_id AND s.a <= d.day AND (s.until IS NULL OR d.day < s.until)
    ANTI JOIN board n ON n.nation_id = o.nation_id AND n.item_id = o.item_id AND n.i = o.i + 1)
SELECT CAST(nation_id AS INTEGER) AS nation_id, CAST(day AS BIGINT) AS arrival_day, item_id, CAST(least(10, 1 + floor((day - 19723) * 10 / 180.0::DOUBLE)) AS INTEGER) AS batch,
  CASE WHEN old_rank IS NULL THEN 'enter' WHEN new_rank IS NULL THEN 'exit' ELSE 'move' END AS change, CAST(old_rank AS INTEGER) AS old_rank, CAST(new_rank AS INTEGER) AS new_rank, revenue FROM ch
"""

TRIE = f"""
WITH {CRC_TABLE},
c AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT conv_id, CAST(conv_id AS VARCHAR) AS name, count(*) AS n FROM c GROUP BY conv_id),
h AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {crc32("name")} % 9 AS h FROM n, crc_table),
turns AS (SELECT h.conv_id, c.p AS d, role, text FROM h JOIN c ON c.conv_id = h.base WHERE c.p <= h.h
  UNION ALL SELECT c.conv_id, least(h.h, coalesce(n.n, 0)) + c.p - h.h, role, text FROM c JOIN h ON h.conv_id = c.conv_id LEFT JOIN n ON n.conv_id = h.base WHERE c.p > h.h),
said AS (SELECT conv_id, d, strlen(text) AS bytes, list(md5(concat(len(role), ':', role, text))) OVER (PARTITION BY conv_id ORDER BY d) AS l FROM turns),
p AS (SELECT conv_id, d, md5(array_to_string(l, ',')) AS k, bytes FROM said UNION ALL SELECT conv_id, 0, '', 0 FROM h),
node AS (SELECT d, k, min(conv_id) AS conv_id, count(*) AS n, (count(*) - 1) * any_value(bytes) AS own FROM p GROUP BY d, k),
up AS (SELECT DISTINCT a.d, a.k, b.k AS up FROM p a JOIN p b ON b.conv_id = a.conv_id AND b.d = a.d - 1),
kids AS (SELECT d - 1 AS d, up AS k, count(*) AS kids FROM up GROUP BY 1, 2),
ends AS (SELECT d, k, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS s FROM p JOIN (SELECT conv_id, max(d) AS d FROM p GROUP BY conv_id) USING (conv_id, d) GROUP BY d, k),
sub AS (SELECT a.d, a.k, sum(u.own) AS saved, count(*) FILTER (WHERE kids IS NULL) AS leaves FROM node u JOIN p a ON a.conv_id = u.conv_id AND a.d <= u.d LEFT JOIN kids ON kids.d = u.d AND kids.k = u.k GROUP BY a.d, a.k)
SELECT node.conv_id, CAST(node.d AS BIGINT) AS depth, top.conv_id AS parent_conv_id, CAST(node.n AS BIGINT) AS n_convs, CAST(coalesce(kids, 0) AS BIGINT) AS n_children, CAST(leaves AS BIGINT) AS n_leaves,
  CAST(saved AS BIGINT) AS saved_tokens, coalesce(s, sha256('')) AS ends_sha256
FROM node JOIN sub USING (d, k) LEFT JOIN kids USING (d, k) LEFT JOIN ends USING (d, k) LEFT JOIN up USING (d, k) LEFT JOIN node top ON top.d = node.d - 1 AND top.k = up.up
"""
