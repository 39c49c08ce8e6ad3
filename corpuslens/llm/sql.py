"""The same results in DuckDB SQL, where SQL can express them on whole tables."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP9 = rf"""
WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
win AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i+49], ' ')) AS s
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w)
),
least AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN least USING (s) WHERE doc_id > m
),
word AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (
  SELECT word.doc_id, string_agg(x, ' ' ORDER BY word.p) AS t, count(*) AS n
  FROM word ANTI JOIN gone ON word.doc_id = gone.doc_id AND word.p = gone.p GROUP BY word.doc_id
)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

# Bytes as pairs of hexadecimal digits: byte i is at 2 i + 1.
OP8 = """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (
  SELECT doc_id, i, md5(substring(h, 2 * i + 1, 800)) AS s
  FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 399)) AS i FROM b)
),
twice AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
hit AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS step FROM win SEMI JOIN twice USING (s)),
island AS (
  SELECT doc_id, i, sum(CASE WHEN step <= 400 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM hit
),
span AS (SELECT doc_id, r, min(i) AS a, max(i) + 400 AS z FROM island GROUP BY doc_id, r),
part AS (
  SELECT doc_id, a, substring(h, 2 * before + 1, 2 * (a - before)) AS x
  FROM (SELECT doc_id, a, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM span) JOIN b USING (doc_id)
  UNION ALL
  SELECT doc_id, length(h), substring(h, 2 * coalesce(z, 0) + 1)
  FROM b LEFT JOIN (SELECT doc_id, max(z) AS z FROM span GROUP BY doc_id) USING (doc_id)
),
kept AS (SELECT doc_id, string_agg(x, '' ORDER BY a) AS x FROM part GROUP BY doc_id),
cut AS (SELECT doc_id, sum(z - a) AS n, count(*) AS k FROM span GROUP BY doc_id)
SELECT b.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
       coalesce(k, 0) AS n_spans, sha256(unhex(x)) AS kept_sha256
FROM b JOIN kept USING (doc_id) LEFT JOIN cut USING (doc_id)
"""

OP1 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, {WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws
  FROM documents
),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))
                                      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS x FROM w
),
sized AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT a.doc_id AS p, b.doc_id AS q, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (
  SELECT p, q, c = np.n AND c = nq.n AS same FROM pair JOIN sized np ON np.doc_id = p JOIN sized nq ON nq.doc_id = q
  WHERE 100 * c >= 80 * (np.n + nq.n - c)
),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT a, q FROM reach JOIN link ON b = p),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a),
copies AS (SELECT p AS doc_id, count(*) AS n_copies FROM link WHERE same GROUP BY p)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, coalesce(n_copies, 0) AS n_copies
FROM least LEFT JOIN sized USING (doc_id) LEFT JOIN copies USING (doc_id)
"""


def _field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR) END"


def _leaf(n_chars: str) -> str:
    return f"sha256({' || '.join(_field(v) for v in ('doc_id', 'source', 'lang', n_chars, 'text'))})"


# CRC-32 bit by bit: each character, then eight shifts (-1).
_CRC32 = """xor(list_reduce([4294967295] || flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
    lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295)"""

# Levels of a tree of h by g and pos; the steps of a row's path, 'L' or 'R' with the sibling, '-' where there is none.
OP11 = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce('=' || lang, '') AS g, {_leaf("n_chars")} AS leaf,
         CASE WHEN {_CRC32} % 7 = 0 THEN {_leaf("(n_chars + 1)")} ELSE {_leaf("n_chars")} END AS folded,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n
  FROM documents
),
node AS (
  SELECT g, 0 AS lvl, pos, n, leaf AS h FROM d
  UNION ALL
  SELECT g, lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM node WHERE n > 1 GROUP BY g, lvl, pos // 2, n
),
top AS (
  SELECT g, 0 AS lvl, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n, h FROM node WHERE n = 1
  UNION ALL
  SELECT '', lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY lvl, pos // 2, n
),
step AS (
  SELECT r, l.lvl AS k, d.pos >> l.lvl AS place, s.h
  FROM d JOIN (SELECT DISTINCT g, lvl FROM node WHERE n > 1) l USING (g)
  LEFT JOIN node s ON s.g = d.g AND s.lvl = l.lvl AND s.pos = xor(d.pos >> l.lvl, 1)
  UNION ALL
  SELECT r, 1000 + l.lvl, t.pos >> l.lvl, s.h
  FROM d JOIN top t ON t.g = d.g AND t.lvl = 0, (SELECT DISTINCT lvl FROM top WHERE n > 1) l
  LEFT JOIN top s ON s.lvl = l.lvl AND s.pos = xor(t.pos >> l.lvl, 1)
),
path AS (
  SELECT r, list(CASE WHEN h IS NULL THEN '-' WHEN place % 2 = 1 THEN 'L' || h ELSE 'R' || h END ORDER BY k) AS p,
         sha256(coalesce(string_agg(h, '' ORDER BY k), '')) AS proof_sha256
  FROM step GROUP BY r
),
done AS (
  SELECT doc_id, leaf, t.h AS subroot, (SELECT h FROM top WHERE n = 1) AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256,
         list_reduce([folded] || coalesce(p, []), lambda a, x: CASE WHEN x = '-' THEN sha256(a)
           WHEN x[1] = 'L' THEN sha256(x[2:] || a) ELSE sha256(a || x[2:]) END) AS folded_root
  FROM d JOIN top t ON t.g = d.g AND t.lvl = 0 LEFT JOIN path USING (r)
)
SELECT *, folded_root = root AS verified FROM done
"""
