"""DuckDB SQL of the operators that SQL can express."""

AZ = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP5 = rf"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all({AZ}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({AZ}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
iw AS (SELECT DISTINCT item, n, array_to_string(w[k:k + n - 1], ' ') AS s FROM (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
hit AS (SELECT doc_id, k, dw.n, item FROM dw JOIN iw ON dw.n = iw.n AND dw.s = iw.s),
places AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(k, k + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)"""

OP6 = """
WITH d AS (SELECT doc_id, coalesce(hex(encode(text)), '') AS x FROM documents),
p AS (SELECT doc_id, k, md5(substr(x, 2 * k + 1, 200)) AS h FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 99)) AS k FROM d WHERE length(x) >= 200)),
later AS (SELECT doc_id, k FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY h ORDER BY doc_id, k) AS n FROM p) WHERE n > 1),
runs AS (SELECT doc_id, min(k) AS a, max(k) + 100 AS b FROM (SELECT doc_id, k, sum(new) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM (
    SELECT doc_id, k, CASE WHEN k <= lag(k) OVER (PARTITION BY doc_id ORDER BY k) + 100 THEN 0 ELSE 1 END AS new FROM later)) GROUP BY doc_id, run),
kept AS (SELECT doc_id, string_agg(substr(x, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS s FROM (
    SELECT d.doc_id, x, coalesce(lag(r.b) OVER (PARTITION BY r.doc_id ORDER BY r.a), 0) AS a, r.a AS b FROM d JOIN runs r USING (doc_id)
    UNION ALL SELECT d.doc_id, x, m.b, length(x) // 2 FROM d JOIN (SELECT doc_id, max(b) AS b FROM runs GROUP BY doc_id) m USING (doc_id)) GROUP BY doc_id)
SELECT d.doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(g.removed, 0) AS BIGINT) AS n_removed, coalesce(g.n, 0) AS n_spans, sha256(unhex(CASE WHEN g.n IS NULL THEN x ELSE coalesce(s, '') END)) AS kept_sha256
FROM d LEFT JOIN (SELECT doc_id, sum(b - a) AS removed, count(*) AS n FROM runs GROUP BY doc_id) g USING (doc_id) LEFT JOIN kept USING (doc_id)"""

OP8 = rf"""
WITH t AS (SELECT doc_id, regexp_extract_all(text, '[^.!?\n]*[.!?\n]+|[^.!?\n]+') AS x FROM documents WHERE text <> ''),
u AS (SELECT doc_id, unnest(x) AS text, generate_subscripts(x, 1) - 1 AS place FROM t),
n AS (SELECT *, trim(regexp_replace({AZ}, '[\x20\x09-\x0D]+', ' ', 'g')) AS norm, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w, coalesce(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM u),
l AS (SELECT *, w > 0 AND row_number() OVER (PARTITION BY norm ORDER BY doc_id, place) > 1 AS later FROM n),
s AS (SELECT *, place - row_number() OVER (PARTITION BY doc_id, later ORDER BY place) AS stretch FROM l),
r AS (SELECT *, later AND sum(w) OVER (PARTITION BY doc_id, later, stretch) >= 25 AS gone FROM s),
g AS (SELECT doc_id, count(*) AS n_units, count(*) FILTER (gone) AS n_removed, coalesce(sum(length(text)) FILTER (gone), 0) AS chars, coalesce(string_agg(CAST(a AS BIGINT) || '-' || CAST(a + length(text) AS BIGINT), ',' ORDER BY place) FILTER (gone), '') AS spans,
    coalesce(string_agg(text, '' ORDER BY place) FILTER (NOT gone), '') AS kept FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n_units, 0) AS n_units, coalesce(n_removed, 0) AS n_removed, CAST(coalesce(chars, 0) AS BIGINT) AS chars_removed, coalesce(spans, '') AS removed_spans, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN g USING (doc_id)"""

OP9 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all({AZ}, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + n - 1], ' ') AS g FROM (SELECT doc_id, w, least(5, len(w)) AS n, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS k FROM d WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE 100 * shared.n >= 75 * (p.n + q.n - shared.n)),
reach AS (SELECT doc_id AS d, doc_id AS r FROM d UNION SELECT reach.d, links.b FROM reach JOIN links ON links.a = reach.r)
SELECT d.doc_id, coalesce(size.n, 0) AS n_shingles, c AS component_id FROM d LEFT JOIN size USING (doc_id) JOIN (SELECT d AS doc_id, min(r) AS c FROM reach GROUP BY 1) USING (doc_id)"""

#: Unsigned crc32 of a string of ASCII characters, bit by bit.
CRC32 = "xor(list_reduce(list_transform(string_split({0}, ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda a, c: list_reduce(range(8), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)), xor(a, c)), CAST(4294967295 AS BIGINT)), 4294967295)"

OP12 = rf"""
WITH t AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w, {CRC32.format("CAST(doc_id AS VARCHAR)")} AS h FROM documents),
s AS (SELECT *, len(w) AS n, h // 10 AS g, h % 10 = 0 AND len(w) > 0 AS planted FROM t),
f AS (SELECT *, CASE WHEN planted THEN g % n END AS a FROM s),
p AS (SELECT *, CASE WHEN planted THEN 1 + (n - a) // (3 + g % 8) END AS p FROM f),
u AS (SELECT doc_id, n, w, planted, a, p, unnest(range(n)) AS i FROM p),
x AS (SELECT doc_id, n, i, w[1 + CASE WHEN planted AND i >= a THEN a + (i - a) % p ELSE i END] AS word FROM u),
eq AS (SELECT l.doc_id, r.i - l.i AS q, l.i FROM x l JOIN x r ON l.doc_id = r.doc_id AND l.word = r.word AND r.i > l.i AND 3 * (r.i - l.i) <= l.n),
st AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS len FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS isle FROM eq) GROUP BY doc_id, q, isle),
r AS (SELECT doc_id, s, len, min(q) AS q FROM st WHERE len >= 24 AND len >= 3 * q GROUP BY doc_id, s, len),
b AS (SELECT doc_id, s AS start, len AS length, q AS period, 1000 * len // q AS exponent_milli FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY len / q DESC, s, q) = 1),
a AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM r GROUP BY doc_id),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM x WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = x.doc_id AND x.i >= r.s + r.q AND x.i < r.s + r.len) GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM t LEFT JOIN a USING (doc_id) LEFT JOIN b USING (doc_id) LEFT JOIN k USING (doc_id)"""


def _field(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


_HEAD = " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars")))

OP13 = f"""
WITH RECURSIVE leaves AS (
    SELECT doc_id, coalesce('=' || lang, '-') AS tree, sha256({_HEAD} || {_field("text")}) AS leaf,
        CASE WHEN {CRC32.format("CAST(doc_id AS VARCHAR)")} % 3 = 0 THEN sha256({_HEAD} || {_field("low")}) END AS tampered
    FROM (SELECT *, {AZ} AS low FROM documents)),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
grown AS (
    SELECT tree, 0 AS level, place, leaf AS digest, n FROM placed
    UNION ALL
    SELECT tree, level + 1, place // 8, sha256(string_agg(digest, '' ORDER BY place)), (n + 7) // 8 FROM grown WHERE n > 1 GROUP BY tree, level, place // 8, n),
sub AS (SELECT tree, level AS depth, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS rank, count(*) OVER () AS n FROM grown WHERE n = 1),
peak AS (
    SELECT '' AS tree, 0 AS level, rank AS place, subroot AS digest, n FROM sub
    UNION ALL
    SELECT tree, level + 1, place // 8, sha256(string_agg(digest, '' ORDER BY place)), (n + 7) // 8 FROM peak WHERE n > 1 GROUP BY tree, level, place // 8, n),
top AS (SELECT level AS height, digest AS root FROM peak WHERE n = 1),
nodes AS (SELECT * FROM grown UNION ALL SELECT * FROM peak),
steps AS (
    SELECT tree AS t, place AS p, unnest(range(depth)) AS k, tree AS node_tree, place AS spot, 0 AS base FROM placed JOIN sub USING (tree)
    UNION ALL
    SELECT tree, place, depth + unnest(range(height)), '', rank, depth FROM placed JOIN sub USING (tree), top),
sides AS (
    SELECT t, p, k, coalesce(string_agg(digest, '' ORDER BY place) FILTER (place < own), '') AS l, coalesce(string_agg(digest, '' ORDER BY place) FILTER (place > own), '') AS r
    FROM (SELECT *, spot // CAST(pow(8, k - base) AS BIGINT) AS own FROM steps) JOIN nodes ON node_tree = tree AND k - base = level AND place // 8 = own // 8 GROUP BY t, p, k),
fold AS (
    SELECT tree AS t, place AS p, CAST(0 AS BIGINT) AS k, coalesce(tampered, leaf) AS digest FROM placed
    UNION ALL
    SELECT t, p, k + 1, sha256(l || digest || r) FROM fold JOIN sides USING (t, p, k)),
proofs AS (SELECT t, p, sha256(string_agg(l || r, '' ORDER BY k)) AS proof FROM sides GROUP BY t, p),
ends AS (SELECT t, p, arg_max(digest, k) AS folded FROM fold GROUP BY t, p)
SELECT doc_id, leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM placed JOIN sub USING (tree) JOIN ends ON t = tree AND ends.p = place LEFT JOIN proofs ON proofs.t = tree AND proofs.p = place, top"""

ORACLE_SQL = {"op5_benchmark_decontamination": OP5, "op6_suffix_array_dedup": OP6, "op8_substring_dedup": OP8, "op9_ngram_jaccard_join": OP9, "op12_periodic_runs": OP12, "op13_merkle_manifest": OP13}
