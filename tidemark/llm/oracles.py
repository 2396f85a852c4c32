"""DuckDB SQL for the rows of those queries that SQL can express."""

from __future__ import annotations

#: UTF-8 bytes of each whole text as hexadecimal digits, two a byte.
_HEX = "d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents)"

SUFFIX_ARRAY = f"""
WITH {_HEX}, n AS (SELECT doc_id, x, length(x) // 2 AS n FROM d),
w AS (SELECT doc_id, i, x[2 * i + 1 : 2 * i + 100] AS w FROM (SELECT doc_id, x, unnest(range(n - 49)) AS i FROM n WHERE n >= 50)),
low AS (SELECT w, min(doc_id) AS low FROM w GROUP BY 1 HAVING count(*) > 1),
hit AS (SELECT w.doc_id, w.i FROM w JOIN low ON w.w = low.w WHERE low.low < w.doc_id),
run AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM hit),
seg AS (SELECT doc_id, i, sum(CASE WHEN p IS NULL OR i > p + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM run),
span AS (SELECT doc_id, g, min(i) AS a, max(i) + 50 AS b FROM seg GROUP BY 1, 2),
cut AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS from_ FROM span),
kept AS (SELECT c.doc_id, string_agg(n.x[2 * c.from_ + 1 : 2 * c.a], '' ORDER BY c.a) || any_value(n.x[2 * m.b + 1 :]) AS x, CAST(sum(c.b - c.a) AS BIGINT) AS removed, count(*) AS spans
  FROM cut c JOIN n ON n.doc_id = c.doc_id JOIN (SELECT doc_id, max(b) AS b FROM span GROUP BY 1) m ON m.doc_id = c.doc_id GROUP BY 1)
SELECT n.doc_id, n.n AS n_bytes, coalesce(k.removed, 0) AS n_removed, coalesce(k.spans, 0) AS n_spans, sha256(unhex(coalesce(k.x, n.x))) AS kept_sha256 FROM n LEFT JOIN kept k ON n.doc_id = k.doc_id
"""

#: Words as runs of anything but ASCII white space.
_WORDS = "d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents)"

SUPERKMER = f"""
WITH {_WORDS}, w AS (SELECT doc_id, i, array_to_string(ws[i + 1 : i + 13], ' ') AS w FROM (SELECT doc_id, ws, unnest(range(len(ws) - 12)) AS i FROM d WHERE len(ws) >= 13)),
low AS (SELECT w, min(doc_id) AS low FROM w GROUP BY 1 HAVING count(*) > 1),
hit AS (SELECT w.doc_id, w.i FROM w JOIN low ON w.w = low.w WHERE low.low < w.doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM hit),
kept AS (SELECT p.doc_id, string_agg(p.w, ' ' ORDER BY p.i) AS t, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM d) p ANTI JOIN gone g ON p.doc_id = g.doc_id AND p.i = g.i GROUP BY 1)
SELECT d.doc_id, len(ws) AS n_words, len(ws) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256 FROM d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""

#: The checksum's table by its rule, then a fold over the bytes.
SHARDING = """
WITH tbl AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
b AS (SELECT doc_id, length(x) // 2 + 8 AS size, list_transform(regexp_extract_all(x, '..'), lambda h: CAST(('0x' || h) AS BIGINT)) AS b FROM d),
c AS (SELECT doc_id, size, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1]))) AS crc FROM b, tbl),
o AS (SELECT *, sum(size) OVER (ORDER BY doc_id, crc, size ROWS UNBOUNDED PRECEDING) - size AS before, sum(size) OVER () AS total FROM c),
s AS (SELECT *, least(23, before * 24 // total) AS shard FROM o)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id, crc, size) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s
"""

NGRAM_JOIN = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, array_to_string(ws[i + 1 : i + 5], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(len(ws) - 4)) AS i FROM d WHERE len(ws) >= 5) UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM d WHERE len(ws) BETWEEN 1 AND 4)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), shared AS (SELECT g FROM s GROUP BY 1 HAVING count(*) > 1), f AS (SELECT s.doc_id, s.g FROM s JOIN shared USING (g)),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM f a JOIN f b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS doc_id, b AS seen FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.seen = e.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, least(d.doc_id, min(r.seen)) AS component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id
"""

#: Every item-sized window of each document that shares a shingle with the item (items of five words or more).
_LOWER = "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_LOWER} AS ws FROM documents), i AS (SELECT item_id, {_LOWER} AS ws FROM benchmark),
ds AS (SELECT doc_id, i AS at, array_to_string(ws[i + 1 : i + 5], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(len(ws) - 4)) AS i FROM d WHERE len(ws) >= 5)),
it AS (SELECT item_id, array_to_string(ws[i + 1 : i + 5], ' ') AS g, count(*) AS c FROM (SELECT item_id, ws, unnest(range(len(ws) - 4)) AS i FROM i WHERE len(ws) >= 5) GROUP BY 1, 2),
p AS (SELECT DISTINCT doc_id, item_id FROM ds JOIN it ON ds.g = it.g),
m AS (SELECT p.doc_id, p.item_id, len(i.ws) AS n, len(d.ws) AS l, least(len(i.ws), len(d.ws)) AS m FROM p JOIN d ON d.doc_id = p.doc_id JOIN i ON i.item_id = p.item_id),
w AS (SELECT doc_id, item_id, n, m, unnest(range(l - m + 1)) AS k FROM m),
c AS (SELECT w.doc_id, w.item_id, w.n, w.m, w.k, ds.g, count(*) AS c FROM w JOIN ds ON ds.doc_id = w.doc_id AND ds.at >= w.k AND ds.at <= w.k + w.m - 5 GROUP BY ALL),
b AS (SELECT c.doc_id, c.item_id, c.n, c.m, c.k, CAST(sum(least(c.c, it.c)) AS BIGINT) AS b FROM c JOIN it ON it.item_id = c.item_id AND it.g = c.g GROUP BY ALL),
s AS (SELECT doc_id, item_id, m, k, b / CAST(n - 4 + m - 4 - b AS DOUBLE) AS s FROM b)
SELECT doc_id, item_id, max(s) AS similarity, arg_min(k, (-s, k)) AS first_word, any_value(m) AS n_words FROM s WHERE s >= 0.75 GROUP BY 1, 2
"""

ORACLES = {"op1_suffix_array_dedup": SUFFIX_ARRAY, "op2_byte_sharding": SHARDING, "op4_ngram_jaccard_join": NGRAM_JOIN, "op7_superkmer_dedup": SUPERKMER, "op8_simhash_decontamination": DECONTAMINATION}
