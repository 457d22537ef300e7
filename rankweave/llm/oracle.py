"""DuckDB SQL for the queries that it can state over whole tables."""

from __future__ import annotations

import string

_WORDS = r"list_filter(string_split_regex(coalesce({text}, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_FOLDED = f"translate({{text}}, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"

NEAR_DEDUP = rf"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(text=_FOLDED.format(text="text"))} w FROM documents),
 s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
   ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END s FROM d),
 e AS (SELECT doc_id, unnest(s) x FROM s),
 n AS (SELECT doc_id, len(s) n FROM s),
 c AS (SELECT a.doc_id a, b.doc_id b, count(*) k FROM e a JOIN e b USING (x) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
 l AS (SELECT c.a, c.b FROM c JOIN n p ON c.a = p.doc_id JOIN n q ON c.b = q.doc_id WHERE 100 * k >= 85 * (p.n + q.n - k)),
 both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
 r AS (SELECT doc_id, doc_id AS seen FROM n UNION SELECT r.doc_id, t.b FROM r JOIN both_ways t ON r.seen = t.a)
SELECT doc_id, CAST(any_value(n.n) AS BIGINT) n_shingles, min(seen) component_id, doc_id = min(seen) kept FROM r JOIN n USING (doc_id) GROUP BY doc_id"""

SUBSTRING_DEDUP = rf"""WITH d AS (SELECT doc_id, {_WORDS.format(text="text")} w FROM documents),
 h AS (SELECT doc_id, list_transform(range(1, len(w) - 33), lambda i: md5(array_to_string(w[i:i + 34], ' '))) h FROM d WHERE len(w) >= 35),
 win AS (SELECT doc_id, unnest(h) h, unnest(range(1, len(h) + 1)) i FROM h),
 dup AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY h) > 1),
 cov AS (SELECT DISTINCT doc_id, i + k AS p FROM dup, range(0, 35) t(k)),
 word AS (SELECT doc_id, unnest(w) word, unnest(range(1, len(w) + 1)) p FROM d),
 left_over AS (SELECT word.doc_id, count(cov.p) n_removed, string_agg(word, ' ' ORDER BY word.p) FILTER (cov.p IS NULL) kept
   FROM word LEFT JOIN cov ON word.doc_id = cov.doc_id AND word.p = cov.p GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) n_words, CAST(coalesce(n_removed, 0) AS BIGINT) n_removed, sha256(coalesce(kept, '')) kept_sha256 FROM d LEFT JOIN left_over o ON d.doc_id = o.doc_id"""

_ITEM_WORDS = r"list_filter(string_split_regex({text}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')".format(text="coalesce(" + _FOLDED.format(text="text") + ", '')")

DECONTAMINATION = rf"""WITH d AS (SELECT doc_id, {_ITEM_WORDS} w FROM documents),
 b AS (SELECT item_id, {_ITEM_WORDS} w FROM benchmark),
 bw AS (SELECT DISTINCT item_id, least(10, len(w)) k, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2), lambda i: array_to_string(w[i:i + least(10, len(w)) - 1], ' '))) x FROM b WHERE len(w) > 0),
 ks AS (SELECT DISTINCT k FROM bw),
 dl AS (SELECT doc_id, k, list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' ')) x FROM d, ks WHERE len(w) >= k),
 dw AS (SELECT doc_id, k, unnest(x) x, unnest(range(1, len(x) + 1)) i FROM dl),
 hit AS (SELECT doc_id, item_id, dw.k, i FROM dw JOIN bw ON dw.k = bw.k AND dw.x = bw.x),
 cov AS (SELECT doc_id, count(DISTINCT i + j) n FROM hit, range(0, 10) t(j) WHERE j < k GROUP BY 1),
 ids AS (SELECT doc_id, count(*) n, string_agg(id, ',' ORDER BY id) ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) id FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) n_words, coalesce(cov.n, 0) n_hit, coalesce(ids.n, 0) n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(cov.n, 0) > 0 contaminated
 FROM d LEFT JOIN cov ON d.doc_id = cov.doc_id LEFT JOIN ids ON d.doc_id = ids.doc_id"""

#: DuckDB has no crc32: the table of its 256 steps, and the sum over a text's bytes in hexadecimal.
_CRC_TABLE = "crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)) t)"
_CRC = "xor(list_reduce(list_transform(range(1, length({hex}), 2), lambda i: CAST('0x' || substr({hex}, i, 2) AS BIGINT)), lambda a, v: xor(a // 256, t[1 + (xor(a, v) & 255)]), 4294967295), 4294967295)"

SPELLING_VARIANTS = rf"""WITH RECURSIVE {_CRC_TABLE},
 r AS (SELECT doc_id, unnest(regexp_extract_all({_FOLDED.format(text="text")}, '[A-Za-zÀ-ÿ]+')) run FROM documents),
 g AS (SELECT run, count(*) n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) x FROM r GROUP BY doc_id, run),
 h AS (SELECT run, n, {_CRC.format(hex="x")} h FROM g, crc_table),
 v AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END word, CAST(sum(n) AS BIGINT) n FROM h GROUP BY 1 HAVING length(word) >= 5 AND sum(n) >= 3),
 d AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) part FROM v, unnest(range(1, length(word) + 1)) p(i)),
 near AS (SELECT a.word, b.word o, b.n FROM d a JOIN d b ON a.part = b.part AND a.i = b.i AND a.word <> b.word
  UNION SELECT d.word, v.word, v.n FROM d JOIN v ON d.part = v.word UNION SELECT v.word, d.word, d.n FROM d JOIN v ON d.part = v.word),
 best AS (SELECT word, count(*) n_near, first(o ORDER BY n DESC, o) o, max(n) m FROM near GROUP BY 1),
 f AS (SELECT v.word, v.n, coalesce(n_near, 0) n_near, CASE WHEN m >= 2 * v.n THEN o END form, CASE WHEN m >= 2 * v.n THEN m END form_n FROM v LEFT JOIN best ON v.word = best.word),
 c AS (SELECT word, word AS reached, 0 k FROM f UNION ALL SELECT c.word, f.form, k + 1 FROM c JOIN f ON c.reached = f.word WHERE f.form IS NOT NULL),
 roots AS (SELECT word, arg_max(reached, k) root FROM c GROUP BY 1)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN roots ON f.word = roots.word"""

CONVERSATION_TRIE = rf"""WITH {_CRC_TABLE},
 o AS (SELECT conv_id, list({{'k': md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 'w': len({_WORDS.format(text="text")})}} ORDER BY turn NULLS FIRST) s FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
 x AS (SELECT conv_id, s, hex(encode(CAST(conv_id AS VARCHAR))) x FROM o),
 h AS (SELECT conv_id, s, {_CRC.format(hex="x")} % 4 h FROM x, crc_table),
 c AS (SELECT a.conv_id, list_concat(CASE WHEN b.s IS NULL OR a.h = 0 THEN [] ELSE b.s[1:a.h] END, a.s[a.h + 1:]) s FROM h a LEFT JOIN o b ON b.conv_id = a.conv_id - a.conv_id % 20),
 p AS (SELECT conv_id, d, len(s) n, CASE WHEN d > 0 THEN s[d].w ELSE 0 END w, array_to_string(list_transform(s[1:d], lambda t: t.k), '') k FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) d FROM c)),
 n AS (SELECT k, d, min(conv_id) conv_id, count(*) n_convs, any_value(w) w, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (d = n), '')) ends_sha256 FROM p GROUP BY 1, 2),
 kids AS (SELECT left(k, (d - 1) * 32) k, count(*) n_children FROM n WHERE d > 0 GROUP BY 1),
 m AS (SELECT n.*, coalesce(n_children, 0) n_children FROM n LEFT JOIN kids ON n.k = kids.k),
 up AS (SELECT left(k, e * 32) k, count(*) FILTER (n_children = 0) n_leaves, CAST(sum((n_convs - 1) * w) AS BIGINT) saved_tokens FROM (SELECT k, n_children, n_convs, w, unnest(range(0, d + 1)) e FROM m) GROUP BY 1)
SELECT m.conv_id, m.d AS depth, q.conv_id parent_conv_id, m.n_convs, m.n_children, n_leaves, saved_tokens, m.ends_sha256 FROM m JOIN up ON m.k = up.k LEFT JOIN n q ON q.d = m.d - 1 AND q.k = left(m.k, (m.d - 1) * 32)"""

SQL = {"op1_minhash_near_dedup": NEAR_DEDUP, "op5_substring_dedup": SUBSTRING_DEDUP, "op6_decontamination": DECONTAMINATION, "op12_spelling_variants": SPELLING_VARIANTS, "op13_conversation_trie": CONVERSATION_TRIE}
