"""SQL checks of the queries that SQL can express."""

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"'[^\x20\x09-\x0D]+'"

NEAR_DEDUP = f"""
WITH RECURSIVE tok AS (SELECT doc_id, regexp_extract_all({_LOW}, {_WORD}) AS w FROM documents),
spot AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM tok WHERE len(w) > 0),
shingle AS (SELECT DISTINCT doc_id, w[i:i + 3] AS s FROM spot),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM both_ JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT a, b FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a),
least_ AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT t.doc_id, coalesce(s.n, 0) AS n_shingles, least(t.doc_id, coalesce(m, t.doc_id)) AS component_id,
    t.doc_id = least(t.doc_id, coalesce(m, t.doc_id)) AS kept
FROM tok t LEFT JOIN size s USING (doc_id) LEFT JOIN least_ l ON l.a = t.doc_id
"""

DECONTAMINATION = rf"""
WITH tok AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (SELECT item_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
spot AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM item WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id::VARCHAR AS item_id, w[i:i + 12] AS g FROM spot),
size AS (SELECT DISTINCT len(g) AS n FROM win),
place AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM tok, size WHERE len(w) >= n),
hit AS (SELECT doc_id, i, n, item_id FROM (SELECT doc_id, i, n, w[i:i + n - 1] AS g FROM place) JOIN win USING (g)),
word AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
ids AS (SELECT doc_id, list_sort(list(DISTINCT item_id)) AS l FROM hit GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(l), 0) AS n_items,
    sha256(coalesce(array_to_string(l, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM tok LEFT JOIN word USING (doc_id) LEFT JOIN ids USING (doc_id)
"""

# Base32 of a digest: five hexadecimal digits make four letters.
WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS holder FROM pages),
d AS (SELECT *, sha1(h) AS x FROM p)
SELECT page_id, octet_length(encode(h)) AS payload_bytes,
    array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + ((('0x' || substr(x, 1 + 5 * (k // 4), 5))::INT >> (15 - 5 * (k % 4))::INT) & 31), 1)), '') AS payload_digest,
    CASE WHEN page_id = holder THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> holder THEN holder END AS refers_to
FROM d
"""

# The shortest runs of at least six words from each line forward and to each line backward cover all longer ones.
LINE_DEDUP = f"""
WITH l AS (SELECT doc_id, ls, list_transform(ls, lambda x: len(regexp_extract_all(x, {_WORD}))) AS n
    FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)),
spot AS (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM l),
run AS (SELECT doc_id, ls, i AS a, list_filter(range(i, len(ls) + 1), lambda b: list_sum(n[i:b]) >= 6)[1] AS b FROM spot
    UNION SELECT doc_id, ls, list_filter(range(i, 0, -1), lambda a: list_sum(n[a:i]) >= 6)[1] AS a, i AS b FROM spot),
keyed AS (SELECT doc_id, a, b, min((doc_id, a)) OVER (PARTITION BY ls[a:b]) AS first_ FROM run WHERE a IS NOT NULL AND b IS NOT NULL),
gone AS (SELECT doc_id, list(DISTINCT p) AS g FROM (SELECT doc_id, unnest(range(a, b + 1)) AS p FROM keyed WHERE (doc_id, a) > first_) GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN g IS NULL THEN text ELSE array_to_string(list_filter(ls, lambda x, i: NOT list_contains(g, i)), chr(10)) END AS text,
    coalesce(len(ls), 0) AS n_lines, coalesce(len(g), 0) AS n_removed
FROM documents d LEFT JOIN l USING (doc_id) LEFT JOIN gone USING (doc_id)
"""

# CRC-32 of a document's number, bit by bit; runs are islands of equal words p apart.
PERIODIC_RUNS = f"""
WITH tab AS (SELECT list_transform(range(256), lambda b: list_reduce([b::UBIGINT, 1, 1, 1, 1, 1, 1, 1, 1],
        lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)) AS t),
tok AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(text, {_WORD}), []) AS w FROM documents),
crc AS (SELECT rid, doc_id, w, len(w) AS n, xor(4294967295::UBIGINT, list_reduce(list_concat([4294967295::UBIGINT],
        list_transform(range(1, len(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i::INT, 1))::UBIGINT)),
        lambda c, x: xor(c >> 8, t[(xor(c, x) & 255)::INT + 1])))::BIGINT AS h FROM tok, tab),
cut AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n ELSE n END AS a FROM crc),
plant AS (SELECT rid, doc_id, n, list_transform(range(n), lambda i: w[1 + CASE WHEN i >= a THEN a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) ELSE i END]) AS w FROM cut),
word AS (SELECT rid, n, unnest(w) AS x, unnest(range(n)) AS i FROM plant),
same AS (SELECT a.rid, b.i - a.i AS p, a.i FROM word a JOIN word b ON a.rid = b.rid AND a.x = b.x AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
isle AS (SELECT rid, p, min(i) AS s, count(*) + p AS l FROM (SELECT *, i - row_number() OVER (PARTITION BY rid, p ORDER BY i) AS g FROM same) GROUP BY rid, p, g),
run AS (SELECT rid, s, l, min(p) AS p FROM isle WHERE l >= greatest(6, 4 * p) GROUP BY rid, s, l),
best AS (SELECT * FROM run QUALIFY row_number() OVER (PARTITION BY rid ORDER BY l::DOUBLE / p DESC, s, p) = 1),
every AS (SELECT rid, count(*) AS n_runs, string_agg(s || ',' || l || ',' || p || chr(10), '' ORDER BY s, p) AS e FROM run GROUP BY rid),
gone AS (SELECT rid, list(DISTINCT d) AS d FROM (SELECT rid, unnest(range(s + p, s + l)) AS d FROM run) GROUP BY rid)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, l AS length, b.p AS period, 1000 * l // b.p AS exponent_milli, sha256(coalesce(e, '')) AS runs_sha256,
    sha256(array_to_string(CASE WHEN d IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(d, i - 1)) END, ' ')) AS collapsed_sha256
FROM plant LEFT JOIN best b USING (rid) LEFT JOIN every USING (rid) LEFT JOIN gone USING (rid)
"""

_F = "((({p}) - ({q})) * (({p}) - ({q})) // (({p}) + ({q})))"
DIVERGENCE = rf"""
WITH doc AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all({_LOW}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
tok AS (SELECT rid, lang, source, unnest(w) AS term FROM doc),
kept AS (SELECT lang, term, count(*)::HUGEINT AS c FROM tok GROUP BY ALL HAVING count(DISTINCT rid) >= 10),
grp AS (SELECT DISTINCT lang, source FROM doc),
occurs AS (SELECT lang, source, term, count(*)::HUGEINT AS c FROM tok SEMI JOIN kept USING (lang, term) GROUP BY ALL),
size AS (SELECT lang, count(*)::HUGEINT AS v, sum(c) AS n FROM kept GROUP BY lang),
own AS (SELECT lang, source, sum(c) AS n FROM occurs GROUP BY ALL),
share AS (SELECT g.lang, g.source, k.term, coalesce(o.c, 0) AS c, 1 + 1000000000::HUGEINT * (coalesce(o.c, 0) + 2) // (coalesce(w.n, 0) + 2 * s.v) AS p,
        1 + 1000000000::HUGEINT * (k.c + 2) // (s.n + 2 * s.v) AS q
    FROM grp g JOIN kept k USING (lang) JOIN size s USING (lang) LEFT JOIN own w ON w.lang = g.lang AND w.source = g.source
    LEFT JOIN occurs o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum({_F.format(p="a.p", q="b.p")}) AS value
    FROM share a JOIN share b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
    FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
word AS (SELECT lang, source, 'term' AS part, term AS item, {_F.format(p="p", q="q")} AS value FROM share WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (FROM pair UNION ALL FROM word))
WHERE part = 'pair' OR rank <= 10
"""
