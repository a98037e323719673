"""SQL twins of the queries that SQL can express, over whole tables and texts."""

from __future__ import annotations

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP3 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(LOWER, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (SELECT item_id, regexp_extract_all(LOWER, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i + 1:i + n], ' ') AS win FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(len(w) - least(10, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM bw
), dw AS (SELECT doc_id, n, i, array_to_string(w[i + 1:i + n], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)
), hits AS (SELECT doc_id, n, i, win FROM dw WHERE (n, win) IN (SELECT (n, win) FROM bw)
), counted AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
), items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits JOIN bw USING (n, win)) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN counted USING (doc_id) LEFT JOIN items USING (doc_id)
""".replace("LOWER", LOWER)
OP6 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), w AS (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 200)) AS k FROM (SELECT doc_id, h, unnest(range(len(h) // 2 - 99)) AS i FROM d)
), f AS (SELECT k, min(struct_pack(doc_id := doc_id, i := i)) AS first FROM w GROUP BY k
), r AS (SELECT doc_id, i FROM w JOIN f USING (k) WHERE struct_pack(doc_id := doc_id, i := i) > first
), s AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS island
    FROM (SELECT *, (i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -1000) + 100)::INT AS new FROM r)) GROUP BY doc_id, island
), cut AS (SELECT doc_id, h, b AS from_byte, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS to_byte FROM (SELECT doc_id, 0 AS b, -1 AS a FROM d UNION ALL SELECT doc_id, b, a FROM s) JOIN d USING (doc_id)
), kept AS (SELECT doc_id, coalesce(string_agg(CASE WHEN to_byte IS NULL THEN substr(h, 2 * from_byte + 1) ELSE substr(h, 2 * from_byte + 1, 2 * (to_byte - from_byte)) END, '' ORDER BY from_byte), '') AS k FROM cut GROUP BY doc_id
), t AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM s GROUP BY doc_id)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(k)) AS kept_sha256 FROM d JOIN kept USING (doc_id) LEFT JOIN t USING (doc_id)
"""
OP8 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(LOWER, '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL
), l AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)
), reach AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON l.a = r.b
), m AS (SELECT a AS doc_id, min(b) AS least_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(least_id, d.doc_id)) AS component_id, least(d.doc_id, coalesce(least_id, d.doc_id)) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
""".replace("LOWER", LOWER)
OP7 = r"""
WITH parts AS (
    SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
    SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw_host, rest FROM parts
), urls AS (
    SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') AS path
    FROM split
), rules(verdict, rule_host, rule_path) AS (
    VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), fits AS (
    SELECT u.page_id, r.rule_host || r.rule_path AS rule, r.verdict,
           row_number() OVER (PARTITION BY u.page_id ORDER BY length(rule_host) DESC, length(rule_path) DESC) AS place
    FROM urls u JOIN rules r ON (u.host = r.rule_host OR ends_with(u.host, '.' || r.rule_host)) AND starts_with(u.path, r.rule_path)
)
SELECT u.page_id, u.host, u.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM urls u LEFT JOIN fits f ON f.page_id = u.page_id AND f.place = 1
"""
OP9 = """
WITH whole AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
), usable AS (
    SELECT * FROM whole WHERE len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), ranked AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score,
           row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.v, c.v) DESC, c.vec_id) AS rank
    FROM usable q JOIN usable c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""
OP11 = r"""
WITH dt AS (SELECT rid, doc_id, unnest(regexp_extract_all(LOWER, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT row_number() OVER () AS rid, * FROM documents)
), d AS (SELECT rid, any_value(doc_id) AS doc_id, count(*) AS n FROM dt GROUP BY rid
), c AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM d
), tf AS (SELECT rid, term, count(*) AS tf FROM dt GROUP BY ALL
), w AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, c GROUP BY term, big_n
), m AS (SELECT rid, doc_id, 10 + (90 * n * big_n) // big_l AS m FROM d, c
), it AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(LOWER, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), s AS (SELECT item_id, rid, any_value(m.doc_id) AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM it JOIN tf USING (term) JOIN w USING (term) JOIN m USING (rid) GROUP BY item_id, rid
), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 10
""".replace("LOWER", LOWER)
FIELDS = ["doc_id", "source", "lang", "n_chars"]
SMALL = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _leaf(*fields: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen({f}::VARCHAR)::VARCHAR || ':' || {f}::VARCHAR, '-')" for f in fields) + ")"


#: The checksum of a doc_id's decimal text, bit by bit (3988292384 is its reversed polynomial, a fixed value).
CRC32 = """xor(4294967295::BIGINT, list_reduce(list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda c: CASE WHEN c = '' THEN -1 ELSE ascii(c) END::BIGINT),
    lambda crc, byte: CASE WHEN byte < 0 THEN crc ELSE list_reduce(range(8), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END, xor(crc, byte)) END, 4294967295::BIGINT))"""
OP12 = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, source, {_leaf(*FIELDS, "text")} AS leaf, CASE WHEN {CRC32} % 5 = 0 THEN {_leaf(*FIELDS, SMALL)} ELSE {_leaf(*FIELDS, "text")} END AS claim FROM documents
), p AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS grp, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY source) AS n FROM d
), low AS (SELECT grp, 0 AS lvl, place, n, leaf AS node FROM p
    UNION ALL SELECT grp, lvl + 1, place // 16, (n + 15) // 16, sha256(string_agg(node, '' ORDER BY place)) FROM low WHERE n > 1 GROUP BY grp, lvl, place // 16, n
), subs AS (SELECT grp, node, (SELECT count(DISTINCT grp) FROM p) AS n FROM low WHERE n = 1
), high AS (SELECT 0 AS lvl, grp AS place, n, node FROM subs
    UNION ALL SELECT lvl + 1, place // 16, (n + 15) // 16, sha256(string_agg(node, '' ORDER BY place)) FROM high WHERE n > 1 GROUP BY lvl, place // 16, n
), tree AS (SELECT grp, lvl, place, n, node FROM low UNION ALL SELECT -1, lvl, place, n, node FROM high
), seg AS (SELECT a.grp, a.lvl, a.place, coalesce(string_agg(b.node, '' ORDER BY b.place) FILTER (b.place < a.place), '') AS lhs, coalesce(string_agg(b.node, '' ORDER BY b.place) FILTER (b.place > a.place), '') AS rhs
    FROM tree a JOIN tree b ON a.grp = b.grp AND a.lvl = b.lvl AND a.place // 16 = b.place // 16 WHERE a.n > 1 GROUP BY a.grp, a.lvl, a.place
), up1 AS (SELECT rid, grp, lvl, place, n, claim AS node, '' AS proof FROM (SELECT *, 0 AS lvl FROM p)
    UNION ALL SELECT rid, u.grp, u.lvl + 1, u.place // 16, (n + 15) // 16, sha256(lhs || node || rhs), proof || lhs || rhs FROM up1 u JOIN seg s ON u.grp = s.grp AND u.lvl = s.lvl AND u.place = s.place WHERE u.n > 1
), up2 AS (SELECT rid, 0 AS lvl, u.grp AS place, s.n, u.node, proof FROM up1 u JOIN subs s ON u.grp = s.grp WHERE u.n = 1
    UNION ALL SELECT rid, u.lvl + 1, u.place // 16, (n + 15) // 16, sha256(lhs || node || rhs), proof || lhs || rhs FROM up2 u JOIN seg s ON s.grp = -1 AND u.lvl = s.lvl AND u.place = s.place WHERE u.n > 1
), top AS (SELECT node AS root FROM high WHERE n = 1)
SELECT doc_id, leaf, subs.node AS subroot, root, sha256(proof) AS proof_sha256, up2.node AS folded_root, up2.node = root AS verified
FROM p JOIN subs USING (grp) JOIN up2 USING (rid) CROSS JOIN top WHERE up2.n = 1
"""
OP13 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(LOWER, '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL
), l AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)
), reach AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON l.a = r.b
), m AS (SELECT a AS doc_id, min(b) AS least_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(least_id, d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
""".replace("LOWER", LOWER)
ORACLE: dict[str, str] = {
    "op3_decontaminate": OP3,
    "op6_suffix_dedup": OP6,
    "op7_url_filter": OP7,
    "op8_minhash": OP8,
    "op9_topk": OP9,
    "op11_lexical": OP11,
    "op12_manifest": OP12,
    "op13_ngram_join": OP13,
}
