"""The registered queries in SQL, written on their own: windows and joins where Spark uses arrays."""

from __future__ import annotations

from workload.adapter import CODEFILES, DOCFILES
from workload.queries import BAD, CONTEXT, DIM, IGNORE, LATE, MODELS, SIZE, SLOW


def files(view: str) -> str:
    return f"""
    base AS ({view}),
    files AS (
        SELECT *, regexp_extract(rel_path, '[^/]*$') AS filename,
               regexp_extract(regexp_extract(rel_path, '[^/]*$'), '^\\.*[^.].*?(\\.[^.]*)$', 1) AS extension,
               '/' || corpus_id || '/' || rel_path AS file_path,
               octet_length(encode(content)) AS size_bytes
        FROM base)"""


DOC, CODE = files(DOCFILES), files(CODEFILES)

# Folder names, extensions and context lengths that must match.
FOLDERS = (
    "['obj','debug','release','properties','bin','node_modules','.git','__pycache__','venv','.venv','env','.env',"
    "'dist','build']"
)
IN_FOLDER = f"len(list_intersect(string_split(lower(rel_path), '/')[:-2], {FOLDERS})) > 0"
KNOWN_EXTENSION = "lower(extension) IN ('.cs','.py','.js','.ts','.html','.css')"

LINES = """
    split AS (
        SELECT *, string_split(regexp_replace(content, '\\r\\n?', chr(10), 'g'), chr(10)) AS parts FROM files),
    rows_ AS (
        SELECT * EXCLUDE (parts, ls), len(ls) AS n, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS line_no
        FROM (SELECT *, CASE WHEN parts[-1] = '' THEN parts[:-2] ELSE parts END AS ls FROM split)),
    marked AS (
        SELECT *, NOT regexp_full_match(line, '\\s*')
                  AND NOT (lower(extension) = '.cs' AND regexp_matches(line, '^\\s*//')) AS is_sig
        FROM rows_),
    lines AS (
        SELECT *, CAST(sum(is_sig::INT) OVER (PARTITION BY corpus_id, rel_path ORDER BY line_no
                       ROWS UNBOUNDED PRECEDING) AS BIGINT) AS r
        FROM marked)"""


def chunks(size: int, overlap: int = 1) -> str:
    """Chunk rows by the line-to-chunk rule: a line belongs to one chunk, a shared line to two."""
    if overlap:
        c = size - 1
        belongs = f"""CASE WHEN is_sig AND r > 1 AND (r - 1) % {c} = 0
            THEN CASE WHEN line_no = n THEN [(r - 1) // {c} - 1] ELSE [(r - 1) // {c} - 1, (r - 1) // {c}] END
            ELSE [greatest(0, CAST(floor((r - 1) / {c}) AS BIGINT))] END"""
    else:
        belongs = f"CASE WHEN is_sig THEN [(r - 1) // {size}] ELSE [r // {size}] END"
    return f"""
    placed AS (SELECT *, unnest({belongs}) AS chunk_no FROM lines),
    cut AS (
        SELECT corpus_id, rel_path, any_value(doc_id) AS doc_id, any_value(filename) AS filename,
               any_value(extension) AS extension, any_value(size_bytes) AS size_bytes, any_value(n)::INT AS total_lines,
               chunk_no::INT AS chunk_no, min(line_no)::INT AS start_line, max(line_no)::INT AS end_line,
               (max(line_no) - {overlap})::INT AS reported_end_line, (count(*) FILTER (is_sig))::INT AS n_sig,
               max(line_no) = any_value(n) AS eof,
               string_agg(line || CASE WHEN line_no < n OR content[-1] = chr(10) THEN chr(10) ELSE '' END, ''
                          ORDER BY line_no) AS content
        FROM placed GROUP BY corpus_id, rel_path, placed.chunk_no)"""


def query(*ctes: str, select: str) -> str:
    return f"WITH {','.join(ctes)} {select}"


CHUNK = "corpus_id, rel_path, chunk_no, start_line, end_line, eof"

FIXED = """
    cut AS (
        SELECT corpus_id, rel_path, ((line_no - 1) // 50)::INT AS chunk_no, min(line_no)::INT AS start_line,
               max(line_no)::INT AS end_line, max(line_no) = any_value(n) AS eof,
               string_agg(line || CASE WHEN line_no < n OR content[-1] = chr(10) THEN chr(10) ELSE '' END, ''
                          ORDER BY line_no) AS content
        FROM lines GROUP BY ALL)"""


def prompts(wanted: list[str], keys: list[str]) -> str:
    asked = "\n".join(f"{i}. {w}" for i, w in enumerate(wanted, 1))
    return f"""
    prompted AS (
        SELECT *, size_bytes // 4 > {int(CONTEXT * 0.8)} AND chunk_no >= 2 AS structural_only,
        'Study this part of a source file.' || chr(10) || 'File: ' || filename || ', lines ' || start_line || '-'
        || reported_end_line || ' of ' || total_lines || chr(10) || '```' || extension || chr(10) || content
        || chr(10) || '```' || chr(10)
        || CASE WHEN structural_only THEN 'The file is large: name its classes, functions and imports, and describe in one sentence.' || chr(10) ELSE '' END
        || 'Tell:
{asked}
Answer with one JSON object with these keys:
' || '{chr(10).join(keys)}' || chr(10) || 'Every array holds plain strings, never key and value pairs.' || chr(10) AS prompt
        FROM cut)"""


WANTED = [
    "what this part of the file does, in a few words", "the classes it defines",
    "the functions and methods it defines", "the imports and dependencies it uses",
]
KEYS = [
    "description: string", "classes: array of strings", "functions: array of strings", "dependencies: array of strings",
]
PROMPT_COLUMNS = (
    "SELECT corpus_id, rel_path, chunk_no, structural_only, CAST(length(prompt) AS INT) AS letters, "
    "sha256(prompt) AS prompt_hash FROM prompted"
)

_FOUND = "regexp_extract_all(content, '(?:^|[^\\p{{L}}\\p{{N}}_])(?:{words}) +([\\p{{L}}\\p{{N}}_]+)', 1)"


def first_seen(items: str) -> str:
    """Distinct items in order of appearance."""
    return f"list_filter({items}, lambda x, i: list_position({items}, x) = i)"


ENTITIES = f"""
    found AS (
        SELECT *, 'Lines ' || start_line || ' to ' || end_line AS description,
        {_FOUND.format(words='class|interface|struct|enum')} AS cs,
        list_transform({_FOUND.format(words='def|function|func')}, lambda f: f || '()') AS fs,
        regexp_extract_all(content, '(?:^|\\n)[ \\t]*((?:import|from|using|#include)[ \\t][^\\n]*)', 1) AS ds
        FROM cut)"""

ROLLED = """
    rolled AS (
        SELECT files.*, coalesce(t.total_lines, 0)::BIGINT AS total_lines, coalesce(t.chunks, 0) AS chunks,
               coalesce(t.cs, []) AS classes, coalesce(t.fs, []) AS functions, coalesce(t.ds, []) AS dependencies,
               size_bytes // 4 > {limit} AS oversized_file
        FROM files LEFT JOIN (
            SELECT corpus_id, rel_path, any_value(total_lines) AS total_lines, count(*) AS chunks,
                   list_sort(list_distinct(flatten(list(cs)))) AS cs,
                   list_sort(list_distinct(flatten(list(fs)))) AS fs,
                   list_sort(list_distinct(flatten(list(ds)))) AS ds
            FROM found GROUP BY ALL) t USING (corpus_id, rel_path)),
    analysed AS (
        SELECT *, CASE WHEN chunks > 0 THEN '# ' || filename || ':' || chr(10) || chr(10) || total_lines || ' lines, '
               || len(classes) || ' classes, ' || len(functions) || ' functions, ' || len(dependencies) || ' imports.'
               ELSE 'No analysis available for this file.' END AS summary
        FROM rolled)""".format(limit=int(CONTEXT * 0.8))

ANALYSED = [CODE, LINES, chunks(SIZE), ENTITIES, ROLLED]


def records(source: str, name: str = "records") -> str:
    """Summary and entity rows of one analysed table."""
    entity = lambda coll, kind, rule: f"""
        SELECT '{coll}' AS collection, corpus_id, rel_path,
               translate(file_path, '/\\. ', '____') || '_{kind}_' || (i - 1) AS id, item AS document,
               {rule} AS name, '{kind}' AS type, NULL AS extension, NULL AS total_lines, NULL AS has_error,
               NULL AS oversized_file
        FROM (SELECT *, unnest({coll}) AS item, unnest(range(1, len({coll}) + 1)) AS i FROM {source})"""
    return f"""
    {name} AS (
        SELECT 'file_summaries' AS collection, corpus_id, rel_path,
               translate(file_path, '/\\. ', '____') AS id, summary AS document, NULL AS name, NULL AS type,
               extension, CAST(total_lines AS BIGINT) AS total_lines, false AS has_error, oversized_file
        FROM {source}
        UNION ALL {entity('classes', 'class', "trim(split_part(item, ':', 1))")}
        UNION ALL {entity('functions', 'function', "trim(split_part(item, '(', 1))")}
        UNION ALL {entity('dependencies', 'dependency',
                          "CASE WHEN contains(item, ' ') THEN split_part(item, ' ', 2) ELSE item END")})"""


RECORD_COLUMNS = (
    "SELECT collection, corpus_id, rel_path, id, document, name, type, extension, total_lines, has_error, "
    "oversized_file FROM "
)

AGAIN = """
    newer AS (
        SELECT * REPLACE ([]::VARCHAR[] AS classes, 'again: ' || summary AS summary)
        FROM analysed WHERE doc_id IN (SELECT doc_id FROM labels)),
    older AS (SELECT * FROM analysed WHERE doc_id NOT IN (SELECT doc_id FROM labels))"""

UPSERTED = query(
    *ANALYSED, AGAIN, records("older", "kept"), records("newer", "replaced"),
    select=f"{RECORD_COLUMNS} kept UNION ALL {RECORD_COLUMNS} replaced",
)

VECTORS = """
    held AS (SELECT 'l' || label AS collection, 'c0' AS corpus_id, 'v' || vec_id AS rel_path,
                    lpad(vec_id::VARCHAR, 9, '0') AS id, embedding::DOUBLE[] AS v FROM embeddings),
    asked AS (
        SELECT query_id, list(x ORDER BY pos) AS q FROM (
            SELECT collection AS query_id, pos, round(avg(x), 6)::FLOAT::DOUBLE AS x
            FROM (SELECT collection, unnest(v) AS x, unnest(range(len(v))) AS pos FROM held) GROUP BY ALL)
        GROUP BY query_id)"""


def embedded(source: str, text: str) -> str:
    """Words counted in hash buckets, unit length, single precision."""
    return f"""(SELECT * EXCLUDE (counts), list_transform(counts, lambda c:
            CASE WHEN list_sum(list_transform(counts, lambda d: d * d)) = 0 THEN 0.0
            ELSE (c / sqrt(list_sum(list_transform(counts, lambda d: d * d))))::FLOAT::DOUBLE END) AS v
        FROM (SELECT * EXCLUDE (buckets), list_transform(range({DIM}), lambda i:
                  len(list_filter(buckets, lambda b: b = i))::DOUBLE) AS counts
              FROM (SELECT *, list_transform(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]+'),
                        lambda w: ('0x' || left(md5(w), 6))::BIGINT % {DIM}) AS buckets FROM {source})))"""


SNIPPETS = f"""
    asked AS (SELECT item_id AS query_id, v AS q FROM {embedded('benchmark', 'text')})"""

OWN_SNIPPETS = f"""
    asked AS (SELECT item_id AS query_id, v AS q, 'c' || CASE item_id % 10 WHEN 9 THEN 9 ELSE item_id % 10 % 3 END AS own
              FROM {embedded('benchmark', 'text')})"""

DOCUMENTS = f"""
    held AS (SELECT 'file_summaries' AS collection, corpus_id, rel_path, extension, doc_id,
                    translate(file_path, '/\\. ', '____') AS id, v FROM {embedded('files', 'content')})"""

RECORDS = f"""
    held AS (SELECT * FROM {embedded('records', 'document')})"""


def nearest(per_collection: int, total: int | None, columns: str, condition: str = "true") -> str:
    total_cut = (
        f"""SELECT * FROM (SELECT * REPLACE (row_number() OVER (PARTITION BY query_id
            ORDER BY d, collection, corpus_id, rel_path, id) AS rank) FROM best) WHERE rank <= {total}"""
        if total
        else "SELECT * FROM best"
    )
    return f"""
    pairs AS (
        SELECT asked.query_id, held.* EXCLUDE (v),
               round(list_sum(list_transform(list_zip(q, v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 9) AS d
        FROM asked CROSS JOIN held WHERE {condition}),
    best AS (
        SELECT *, row_number() OVER (PARTITION BY query_id, collection ORDER BY d, corpus_id, rel_path, id) AS rank
        FROM pairs QUALIFY rank <= {per_collection}),
    final AS ({total_cut})
    SELECT {columns} FROM final"""


HITS = "query_id, collection, id, CAST(rank AS INT) AS rank, round(1 - d / 2, 6) + 0.0 AS score"


def search_query(*ctes: str, tail: str) -> str:
    return f"WITH {','.join(ctes)},{tail}"


PLAIN = """
    plain AS (
        SELECT *, 'about ' || rel_path AS summary, 1 AS total_lines, false AS oversized_file,
               ['K' || doc_id || ': of ' || filename] AS classes, []::VARCHAR[] AS functions,
               []::VARCHAR[] AS dependencies FROM files)"""

DETAILS = """SELECT r.corpus_id, r.rel_path,
    CASE WHEN collection = 'file_summaries' THEN 'summary' ELSE collection END AS section,
    id, document AS content, name FROM records r JOIN files f USING (corpus_id, rel_path) WHERE """

EDGES = """
    imports AS (
        SELECT DISTINCT corpus_id, rel_path AS src_rel_path, unnest(list_concat(
            regexp_extract_all(content, 'import\\s+([\\p{L}\\p{N}_]+)', 1),
            regexp_extract_all(content, 'from\\s+([\\p{L}\\p{N}_]+)\\s+import', 1))) || '.py' AS target
        FROM files),
    exact AS (
        SELECT i.corpus_id, src_rel_path, f.rel_path AS dst_rel_path, 'exact' AS match_kind
        FROM imports i JOIN files f ON i.corpus_id = f.corpus_id AND i.target = f.rel_path),
    by_name AS (
        SELECT i.corpus_id, src_rel_path, u.rel_path AS dst_rel_path, 'basename' AS match_kind
        FROM imports i JOIN (SELECT corpus_id, filename, min(rel_path) AS rel_path FROM files
                             GROUP BY ALL HAVING count(*) = 1) u
             ON i.corpus_id = u.corpus_id AND i.target = u.filename
        WHERE NOT EXISTS (SELECT 1 FROM files f WHERE f.corpus_id = i.corpus_id AND f.rel_path = i.target)),
    edges AS (SELECT DISTINCT * FROM (SELECT * FROM exact UNION ALL SELECT * FROM by_name))"""

ENTRY = """
    listed AS (
        SELECT * REPLACE (CASE WHEN filename = 'doc_40.py' AND corpus_id <> 'c1'
                          THEN regexp_replace(rel_path, '[^/]*$', 'cli.py') ELSE rel_path END AS rel_path)
        FROM files_),
    files AS (
        SELECT * REPLACE (regexp_extract(rel_path, '[^/]*$') AS filename,
                          '/' || corpus_id || '/' || rel_path AS file_path) FROM listed),
    nodes AS (
        SELECT corpus_id, rel_path, no, 'f_' || no AS node_id, label,
               filename = 'cli.py' AND turn = 1 AS is_entry
        FROM (SELECT *, row_number() OVER (PARTITION BY corpus_id ORDER BY file_path) - 1 AS no,
                     CASE WHEN count(*) OVER (PARTITION BY corpus_id, filename) > 1 THEN rel_path ELSE filename END AS label,
                     row_number() OVER (PARTITION BY corpus_id
                         ORDER BY filename <> 'cli.py', rel_path <> 'cli.py', file_path) AS turn
              FROM files))"""

DOC_AS_BASE = DOC.replace("files AS (", "files_ AS (", 1)

GRAPH_LINES = """
    SELECT corpus_id, 0 AS part, NULL AS src_no, NULL AS dst_no, 'graph TD' AS line FROM nodes GROUP BY corpus_id
    UNION ALL
    SELECT corpus_id, 1, NULL, NULL, '  classDef entryPoint fill:#f96,stroke:#333,stroke-width:2px;'
    FROM nodes WHERE is_entry
    UNION ALL
    SELECT corpus_id, 2, no, NULL,
           '  ' || node_id || '["' || label || '"]' || CASE WHEN is_entry THEN ':::entryPoint' ELSE '' END FROM nodes
    UNION ALL
    SELECT e.corpus_id, 3, s.no, d.no, '  f_' || s.no || ' --> f_' || d.no
    FROM edges e JOIN nodes s ON e.corpus_id = s.corpus_id AND e.src_rel_path = s.rel_path
         JOIN nodes d ON e.corpus_id = d.corpus_id AND e.dst_rel_path = d.rel_path"""


def bullets(items: str, title: str) -> str:
    return f"""CASE WHEN len({items}) > 0 THEN chr(10) || '### ' || filename || ' - **{title}**' || chr(10) || chr(10)
        || array_to_string(list_transform({items}, lambda x: '- ' || x || chr(10)), '') || chr(10) ELSE '' END"""


def good_report(*sections: str) -> str:
    return f"""'## 📄 ' || rel_path || chr(10) || chr(10)
        || CASE WHEN chunks > 0 THEN '#' || regexp_replace(summary, '^([^\\n]*):', '\\1') ELSE summary END || chr(10)
        || {' || '.join(sections)} || chr(10) || '---'"""


CLASSES = bullets("classes", "Classes")
FUNCTIONS = bullets("functions", "Functions/Methods")
DEPENDENCIES = bullets("dependencies", "Dependencies/Imports")

REMAINING = "doc_id NOT IN (SELECT doc_id FROM labels)"

REPLY = """
    said AS (SELECT *, regexp_replace(text, '[^\\p{L}\\p{N} ]', ' ', 'g') AS said FROM conversations),
    replies AS (SELECT conv_id, turn, CASE WHEN role = 'system' THEN NULL
        WHEN turn % 4 = 0 THEN 'Here it is: {"description": "' || said || '", "classes": ["K' || conv_id || ': holds"], "dependencies": []} That is all.'
        WHEN turn % 4 = 1 THEN 'Sure.' || chr(10) || '```json' || chr(10) || '{"classes": ["**A' || conv_id || '**"], "description": "says: ' || said || '", "functions": ["f' || turn || '()": "does", "g() -> int": "gives"], "dependencies": ["k": "v", "os"]}' || chr(10) || '```' || chr(10) || 'Done.'
        WHEN turn % 4 = 2 THEN '{"description": "' || said || '", "classes": [}'
        ELSE said END AS response FROM said),
    tried AS (
        SELECT *, list_filter(regexp_extract_all(response, '(?s)(\\{.*?"description".*?"classes".*?\\})', 1),
                              lambda x: json_valid(x))[1] AS direct,
               nullif(regexp_extract(response, '(?s)```(?:json)?\\s*\\n(\\{\\s*".*?"\\s*:.*?\\})\\s*\\n```', 1), '') AS fenced,
               nullif(regexp_extract(response, '(?s)\\{.*\\}'), '') AS braces FROM replies),
    mended AS (
        SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(fenced, braces),
            '"\\*\\*(.*?)\\*\\*"', '"\\1"', 'g'),
            '"([^"]+\\(\\)[^"]*?)\\s*->\\s*[^"]+"\\s*:\\s*"([^"]+)"', '"\\1: \\2"', 'g'),
            '"([^"]+\\(\\))\\s*"\\s*:\\s*"([^"]+)"', '"\\1: \\2"', 'g'),
            '("dependencies": \\[)"([^"]+)": "([^"]+)"', '\\1"\\2: \\3"') AS m FROM tried),
    fixed AS (SELECT *, regexp_replace(m, '("description": "[^":]*):', '\\1') AS fix FROM mended),
    routed AS (SELECT *, CASE WHEN response IS NULL THEN 'error' WHEN direct IS NOT NULL THEN 'direct'
        WHEN json_valid(fix) THEN 'repaired' ELSE 'fallback' END AS parse_route FROM fixed),
    picked AS (SELECT *, CASE parse_route WHEN 'direct' THEN direct::JSON WHEN 'repaired' THEN fix::JSON END AS j FROM routed)
    SELECT conv_id, turn, CASE parse_route WHEN 'error' THEN 'Error during analysis: Test error'
               WHEN 'fallback' THEN 'Could not analyze chunk' ELSE j->>'description' END AS description,
           CASE WHEN j IS NULL THEN '' ELSE array_to_string((j->'classes')::VARCHAR[], '|') END AS classes,
           CASE WHEN j IS NULL THEN '' ELSE array_to_string((j->'functions')::VARCHAR[], '|') END AS functions,
           CASE WHEN j IS NULL THEN '' ELSE array_to_string((j->'dependencies')::VARCHAR[], '|') END AS dependencies,
           parse_route FROM picked"""

INFER = f"""
    SELECT corpus_id, rel_path, chunk_no,
           CASE WHEN l % {BAD} = 0 THEN 'Error during analysis: bad prompt'
                WHEN l % {LATE} = 0 THEN 'Error during analysis: late (3 attempts)'
                ELSE l || ' letters' END AS description,
           CASE WHEN l % {BAD} = 0 OR l % {LATE} = 0 THEN 'error' ELSE 'direct' END AS parse_route,
           CASE WHEN l % {BAD} = 0 THEN 'bad prompt' WHEN l % {LATE} = 0 THEN 'late (3 attempts)' END AS error,
           CASE WHEN l % {BAD} = 0 THEN 1 WHEN l % {LATE} = 0 THEN 3 WHEN l % {SLOW} = 0 THEN 2 ELSE 1 END AS attempts
    FROM (SELECT *, length(prompt) AS l FROM prompted)"""

PATTERNS = """
    SELECT corpus_id, rel_path, filename, extension, size_bytes FROM files
    WHERE NOT {folder}
      AND (NOT contains(rel_path, '/') AND filename LIKE 'doc\\_%' ESCAPE '\\'
           OR NOT regexp_matches(rel_path, '^(?:.+/)?doc_1[^/]*\\.md$')
              AND (filename LIKE '%.md' OR regexp_matches(rel_path, '^src1[^/]*/(?:.+/)?[^/]*\\.js$')))
      AND NOT (regexp_matches(filename, '^doc_2.\\.md$') OR contains('/' || rel_path, '/fr/')
               OR regexp_matches(rel_path, '^b[1-3]/(?:.+/)?doc_[^/]*[05]\\.js$'))""".format(folder=IN_FOLDER)

NOT_EXCLUDED = f"NOT {IN_FOLDER}"

IGNORED = """
    SELECT corpus_id, rel_path FROM files WHERE NOT CASE corpus_id
        WHEN 'c0' THEN contains('/' || rel_path, '/de/')
                       OR filename LIKE '%.md' AND NOT regexp_matches(filename, '^doc_1.*\\.md$')
        WHEN 'c1' THEN rel_path LIKE 'src1%/%' OR filename LIKE '%.txt' OR contains('/' || rel_path, '/node_modules/')
        ELSE NOT contains(rel_path, '/')
             OR regexp_matches(rel_path, '^src[^/]/(?:.+/)?doc_[1-4]') AND filename NOT LIKE '%.py' END"""

assert set(IGNORE) == {"c0", "c1", "c2"}

MODEL_LIST = "[" + ",".join(f"'{m}'" for m in MODELS) + "]"
LENGTHS = """(VALUES (1,'llama3',8192),(2,'llama2',4096),(3,'mistral',8192),(4,'mixtral',32768),(5,'qwen',32768),
    (6,'phi3',4096),(7,'gemma',8192),(8,'qwen2',32768),(9,'qwen2.5-coder',32768),(10,'codellama',16384),
    (11,'vicuna',4096),(12,'wizardcoder',16384)) t(ord, prefix, length)"""

ORACLE = {
    "chunks_per_file": query(
        DOC.replace("files AS (", "every AS (", 1),
        f"files AS (SELECT * FROM every WHERE {KNOWN_EXTENSION} AND NOT {IN_FOLDER})", LINES, chunks(SIZE, 0),
        select="""SELECT corpus_id, rel_path, count(*) AS chunks, CAST(sum(n_sig) AS BIGINT) AS significant_lines,
                  CAST(max(total_lines) AS INT) AS total_lines FROM cut GROUP BY corpus_id, rel_path"""),
    "discover_files": query(DOC, select=f"""SELECT corpus_id, rel_path, filename, extension, size_bytes FROM files
        WHERE {KNOWN_EXTENSION} AND NOT {IN_FOLDER}"""),
    "discover_root": query(DOC, select=f"""SELECT corpus_id, rel_path, filename, extension, size_bytes FROM files
        WHERE {KNOWN_EXTENSION} AND NOT contains(rel_path, '/')"""),
    "discover_patterns": query(DOC, select=PATTERNS),
    "gitignore_filter": query(DOC, select=IGNORED),
    "files_from_pages": """
        WITH a AS (SELECT page_id, html, split_part(regexp_replace(url, '[?#].*', ''), '://', 2) AS address FROM pages),
        p AS (SELECT *, '/' || address || '/' || page_id || '.html' AS file_path, split_part(address, '/', 1) AS corpus_id FROM a)
        SELECT corpus_id, file_path[length(corpus_id) + 3:] AS rel_path, page_id || '.html' AS filename,
               '.html' AS extension, octet_length(encode(html)) AS size_bytes,
               translate(file_path, '/\\. ', '____') AS id FROM p""",
    "decoded_text": """
        WITH s AS (SELECT doc_id, regexp_replace(regexp_replace(text, '[^\\x{00}-\\x{FF}]', '?', 'g'),
                                                 '[\\x{80}-\\x{FF}]', chr(65533) || '.', 'g') AS t FROM documents)
        SELECT doc_id, md5(t) AS text_md5, CAST(length(t) AS INT) AS letters FROM s""",
    "line_counts": query(DOC, LINES, select="""
        SELECT corpus_id, rel_path, CAST(count(*) AS INT) AS total_lines,
               CAST(count(*) FILTER (is_sig) AS INT) AS significant_lines,
               CAST(CASE WHEN any_value(lower(extension)) = '.cs' THEN count(*) FILTER (is_sig) ELSE count(*) END AS INT)
                   AS progress_lines FROM lines GROUP BY corpus_id, rel_path"""),
    "running_significant": query(DOC, LINES, select="""
        SELECT corpus_id, rel_path, CAST(line_no AS INT) AS line_no, is_sig, CAST(r AS INT) AS sig_so_far,
               md5(line) AS line_md5 FROM lines"""),
    "chunk_fixed": query(DOC, LINES, FIXED, select=f"SELECT {CHUNK}, md5(content) AS content_md5 FROM cut"),
    "chunk_significant": query(DOC, LINES, chunks(8), select=f"""
        SELECT {CHUNK}, reported_end_line, n_sig, total_lines, md5(content) AS content_md5 FROM cut"""),
    "chunk_disjoint": query(DOC, LINES, chunks(8, 0), select=f"""
        SELECT {CHUNK}, reported_end_line, n_sig, total_lines, md5(content) AS content_md5 FROM cut"""),
    "oversized_files": query(DOC, select=f"""SELECT corpus_id, rel_path, size_bytes // 4 AS estimated_tokens,
        size_bytes // 4 > {int(CONTEXT * 0.8)} AS oversized_file FROM files"""),
    "context_length_lookup": f"""
        WITH used AS (SELECT {MODEL_LIST}[doc_id % {len(MODELS)} + 1] AS model FROM documents)
        SELECT model, coalesce((SELECT arg_min(length, ord) FROM {LENGTHS}
                                WHERE starts_with(lower(split_part(model, ':', 1)), prefix)), 8192) AS context_length,
               count(*) AS files FROM used GROUP BY model""",
    "chunk_prompts": query(DOC, LINES, chunks(SIZE), prompts(WANTED, KEYS), select=PROMPT_COLUMNS),
    "chunk_prompts_classes_only": query(DOC, LINES, chunks(SIZE), prompts(WANTED[:2], KEYS[:2]), select=PROMPT_COLUMNS),
    "chunk_entities": query(CODE, LINES, chunks(SIZE), ENTITIES, select=f"""
        SELECT corpus_id, rel_path, chunk_no, description, array_to_string({first_seen('cs')}, '|') AS classes,
               array_to_string({first_seen('fs')}, '|') AS functions,
               array_to_string({first_seen('ds')}, '|') AS dependencies, 'direct' AS parse_route FROM found"""),
    "file_rollup": query(*ANALYSED, select="""
        SELECT corpus_id, rel_path, total_lines, chunks AS chunks_analyzed, false AS has_errors, oversized_file,
               array_to_string(classes, '|') AS classes, array_to_string(functions, '|') AS functions,
               array_to_string(dependencies, '|') AS dependencies, summary FROM analysed"""),
    "file_sections": query(*ANALYSED, select="""
        SELECT corpus_id, rel_path, array_to_string(classes, '|') AS classes, len(classes) > 0 AS has_classes,
               true AS dependencies_off FROM analysed"""),
    "summary_prompts": query(*ANALYSED, """
        prompted AS (SELECT corpus_id, rel_path, CASE WHEN chunks > 0 THEN
            CASE WHEN oversized_file THEN 'Summarise the beginning of the large file `' ELSE 'Summarise the file `' END
            || filename || '` from what it defines.'
            || chr(10) || 'Classes:' || CASE WHEN len(classes) = 0 THEN 'None' ELSE array_to_string(list_transform(classes, lambda x: chr(10) || '  - ' || x), '') END
            || chr(10) || 'Functions:' || CASE WHEN len(functions) = 0 THEN 'None' ELSE array_to_string(list_transform(functions, lambda x: chr(10) || '  - ' || x), '') END
            || chr(10) || 'Dependencies:' || CASE WHEN len(dependencies) = 0 THEN 'None' ELSE array_to_string(list_transform(dependencies, lambda x: chr(10) || '  - ' || x), '') END
            || chr(10) || 'Use plain Markdown.' || chr(10) END AS prompt FROM analysed)""",
        select="""SELECT corpus_id, rel_path, CAST(length(prompt) AS INT) AS letters, sha256(prompt) AS prompt_hash
                  FROM prompted"""),
    "infer_responses": query(DOC, LINES, chunks(SIZE), prompts(WANTED, KEYS), select=INFER),
    "reply_normalize": f"WITH {REPLY}",
    "reply_text": """SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN text WHEN 1 THEN upper(role)
        ELSE '{null, null, ' || role || '}' END AS answer FROM conversations""",
    "retry_after_failure": query(DOC, LINES, chunks(SIZE), prompts(WANTED, KEYS), select=f"""
        SELECT corpus_id, rel_path, chunk_no, CASE WHEN l % {BAD} = 0 OR l % {LATE} = 0 THEN 'again ' ELSE '' END
               || l || ' letters' AS description, CAST(NULL AS VARCHAR) AS error
        FROM (SELECT *, length(prompt) AS l FROM prompted)"""),
    "model_run": query(DOC, LINES, chunks(SIZE), prompts(WANTED, KEYS), f"""
        asked AS (SELECT corpus_id, rel_path, count(*) AS chunks, bool_or(length(prompt) % {BAD} = 0) AS bad,
                         list_sort(list_distinct(list('K' || length(prompt)) FILTER (length(prompt) % {BAD} <> 0))) AS ks
                  FROM prompted GROUP BY ALL),
        run AS (SELECT files.*, doc_id % 9 = 0 AS unread, coalesce(chunks, 0) AS chunks, coalesce(bad, false) AS bad,
                       coalesce(ks, []) AS ks FROM files LEFT JOIN asked USING (corpus_id, rel_path)),
        summed AS (SELECT *, length(CASE WHEN size_bytes // 4 > {int(CONTEXT * 0.8)} THEN 'Summarise the beginning of the large file `'
                ELSE 'Summarise the file `' END || filename || '` from what it defines.' || chr(10) || 'Classes:'
                || CASE WHEN len(ks) = 0 THEN 'None' ELSE array_to_string(list_transform(ks, lambda x: chr(10) || '  - ' || x), '') END
                || chr(10) || 'Functions:None' || chr(10) || 'Dependencies:None' || chr(10) || 'Use plain Markdown.' || chr(10)) AS l
            FROM run),
        shown AS (
            SELECT 'file_summaries' AS collection, corpus_id, rel_path, CASE WHEN unread THEN 'Error analyzing file: content could not be read'
                       WHEN chunks = 0 THEN 'No analysis available for this file.'
                       WHEN l % {BAD} = 0 THEN 'Error generating summary: bad prompt' ELSE 'Sum ' || l END AS document,
                   unread OR bad AS has_error, CASE WHEN unread THEN 'content could not be read' END AS error_message,
                   unread OR bad AS found_by_filter FROM summed
            UNION ALL
            SELECT 'classes', corpus_id, rel_path, unnest(ks), NULL, NULL, false FROM summed WHERE NOT unread)""",
        select="SELECT *, CAST(length(document) AS INT) AS letters FROM shown"),
    "walk_tree": query(DOC, f"ignored AS ({IGNORED})", select=f"""
        SELECT corpus_id, rel_path, md5(content) AS content_md5 FROM files SEMI JOIN ignored USING (corpus_id, rel_path)
        WHERE {KNOWN_EXTENSION} AND NOT {IN_FOLDER}
        UNION ALL SELECT unnest(['c0', 'c1', 'c2']), 'pkg/__init__.py', md5('import os' || chr(10))"""),
    "search_uncapped": search_query(DOC, SNIPPETS, DOCUMENTS, tail=nearest(30, 30, HITS)),
    "search_per_corpus": search_query(DOC, OWN_SNIPPETS, DOCUMENTS, tail=nearest(
        12, 12, f"unnest(['broadcast', 'blocks']) AS way, corpus_id, {HITS}", "own = corpus_id")),
    "stream_finish": query(*ANALYSED, records("analysed"), select="""
        SELECT 'corpus' AS kind, corpus_id AS name, count(*) AS n, true AS completed, true AS dated FROM files GROUP BY corpus_id
        UNION ALL SELECT 'collection', collection, count(*), NULL, NULL FROM records GROUP BY collection"""),
    "rejected_records": query(*ANALYSED, records("analysed"), select=f"""
        {RECORD_COLUMNS.replace('FROM', ', NULL AS reason FROM')} records SEMI JOIN
            (SELECT corpus_id, rel_path FROM files WHERE doc_id % 7 <> 0) USING (corpus_id, rel_path)
        UNION ALL
        SELECT 'rejected', corpus_id, rel_path, NULL, summary, NULL, NULL, extension, NULL, NULL, NULL, 'file_path is blank'
        FROM analysed WHERE doc_id % 7 = 0"""),
    "project_info_lookup": query(DOC, select="""SELECT corpus_id, '/' || corpus_id AS source_dir, count(*) AS file_count,
        corpus_id = 'c1' AS completed FROM files WHERE corpus_id IN ('c1', 'c2') GROUP BY corpus_id"""),
    "own_analyzer": query(DOC, LINES, chunks(SIZE), select=f"""
        SELECT DISTINCT 'classes' AS collection, corpus_id, rel_path, 'Size' || length(content) AS document,
               'Size' || length(content) AS name, 'class' AS type FROM cut
        UNION ALL SELECT 'dependencies', corpus_id, rel_path, 'import own', 'own', 'dependency' FROM files"""),
    "report_sink_rows": query(*ANALYSED, select=f"""
        SELECT corpus_id, rel_path, {good_report(CLASSES, FUNCTIONS, DEPENDENCIES)} AS report FROM analysed"""),
    "label_after_compact": UPSERTED,
    "changed_files_redone": query(*ANALYSED, records("analysed"), select=f"{RECORD_COLUMNS} records WHERE {NOT_EXCLUDED}"),
    "two_streams_one_store": query(*ANALYSED, records("analysed"), select=f"{RECORD_COLUMNS} records"),
    "late_old_version": query(*ANALYSED, records("analysed"), select=f"{RECORD_COLUMNS} records"),
    "clean_summaries": """
        SELECT conv_id, turn, CASE turn % 4
            WHEN 0 THEN '## Title' || chr(10) || text || chr(10) || 'end:'
            WHEN 1 THEN '## A' || conv_id || chr(10) || trim(text, ' ' || chr(10)) || chr(10) || chr(10) || 'after'
            WHEN 2 THEN trim(text, ' ' || chr(10))
            ELSE '```' || role END AS summary FROM conversations""",
    "entity_records": query(*ANALYSED, records("analysed"), select=f"{RECORD_COLUMNS} records"),
    "file_list_pages": query(DOC, select=f"""
        SELECT corpus_id, CAST(no // 50 AS INT) AS chunk, 'files_chunk_' || (no // 50) AS id,
               md5(string_agg(file_path, chr(10) ORDER BY file_path)) AS document_md5, CAST(count(*) AS INT) AS count
        FROM (SELECT *, row_number() OVER (PARTITION BY corpus_id ORDER BY file_path) - 1 AS no FROM files
              WHERE {KNOWN_EXTENSION} AND NOT {IN_FOLDER}) GROUP BY corpus_id, no // 50"""),
    "project_info": query(DOC, select="""SELECT corpus_id, '/' || corpus_id AS source_dir, count(*) AS file_count,
        corpus_id < 'c2' AS completed FROM files GROUP BY corpus_id"""),
    "upsert_records": UPSERTED,
    "stored_upsert": UPSERTED,
    "collection_stats": query(*ANALYSED, records("analysed"),
                              select="SELECT collection, count(*) AS records FROM records GROUP BY collection"),
    "remaining_files": query(DOC, select=f"SELECT corpus_id, rel_path FROM files WHERE {REMAINING}"),
    "resume_split": query(DOC, select="""SELECT corpus_id, CASE WHEN doc_id % 3 = 0 THEN rel_path || '.old' ELSE rel_path END AS rel_path,
        doc_id % 3 <> 0 AS exists FROM files"""),
    "run_counts": query(DOC, select=f"""SELECT corpus_id, count(*) AS discovered,
        count(*) FILTER (NOT ({REMAINING})) AS analyzed FROM files GROUP BY corpus_id"""),
    "knn_search": search_query(VECTORS, tail=nearest(10, None, HITS)),
    "knn_cells": search_query(VECTORS, tail=nearest(10, None, HITS)),
    "neighbour_distances": query(VECTORS, select="""
        SELECT id, collection, round(list_sum(list_transform(list_zip(q, v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6)
            AS distance FROM held JOIN asked ON query_id = collection"""),
    "similar_topn": search_query(DOC, SNIPPETS, DOCUMENTS, tail=nearest(25, 25, HITS)),
    "similar_many_snippets": search_query(DOC, SNIPPETS, DOCUMENTS, tail=nearest(25, None, HITS)),
    "similar_many_by_cells": search_query(DOC, SNIPPETS, DOCUMENTS, tail=nearest(25, None, HITS)),
    "search_filtered": search_query(DOC, SNIPPETS, DOCUMENTS, tail=nearest(
        20, 30, HITS, "extension = '.py' AND doc_id % 5 <> 0")),
    "search_text": search_query(*ANALYSED, records("analysed"), SNIPPETS, RECORDS, tail=nearest(
        20, 30, f"corpus_id, rel_path, {HITS}, document, name")),
    "search_indexed": search_query(*ANALYSED, records("analysed"), SNIPPETS, RECORDS, tail=nearest(
        20, 30, f"corpus_id, rel_path, {HITS}, document, name")),
    "search_by_type": search_query(*ANALYSED, records("analysed"), SNIPPETS, RECORDS, tail=nearest(
        10, 10, HITS, "collection = 'classes'")),
    "file_summary": query(DOC, select="""
        SELECT corpus_id, CASE doc_id % 4 WHEN 0 THEN file_path WHEN 1 THEN '/elsewhere/' || filename
                               WHEN 2 THEN translate(file_path, '/', '.') ELSE rel_path END AS path,
               CASE doc_id % 4 WHEN 1 THEN 2 WHEN 3 THEN 2 ELSE 1 END AS found_by,
               CASE doc_id % 4 WHEN 1 THEN filename ELSE rel_path END AS rel_path,
               'about ' || CASE doc_id % 4 WHEN 1 THEN filename ELSE rel_path END AS summary
        FROM files f WHERE doc_id % 2 = 0
           OR doc_id % 4 = 3 AND NOT contains(rel_path, '/')
           OR doc_id % 4 = 1 AND EXISTS (SELECT 1 FROM files g WHERE g.corpus_id = f.corpus_id AND g.rel_path = f.filename)
        """),
    "file_details": query(DOC, PLAIN, records("plain"),
                          select=DETAILS + "doc_id % 2 = 0 OR NOT contains(r.rel_path, '/')"),
    "file_details_by_name": query(DOC, PLAIN, records("plain"), select=DETAILS + """
        (r.corpus_id, f.filename) IN (SELECT (corpus_id, filename) FROM files WHERE doc_id % 2 = 0)"""),
    "list_files": query(DOC, select="""SELECT corpus_id, translate(file_path, '/\\. ', '____') AS id, file_path,
        rel_path, filename, CAST(1 AS BIGINT) AS total_lines, false AS has_error FROM files"""),
    "basename_counts": query(DOC, select="""SELECT corpus_id, filename, count(*) AS files, min(rel_path) AS first_path
        FROM files GROUP BY corpus_id, filename"""),
    "import_edges": query(DOC, EDGES, select="SELECT corpus_id, src_rel_path, dst_rel_path, match_kind FROM edges"),
    "graph_nodes": query(DOC_AS_BASE, ENTRY, select="SELECT corpus_id, rel_path, node_id, label, is_entry FROM nodes"),
    "graph_lines": query(DOC_AS_BASE, ENTRY, EDGES, select=GRAPH_LINES),
    "file_report": query(*ANALYSED, select=f"""
        SELECT corpus_id, rel_path, {good_report(CLASSES, FUNCTIONS, DEPENDENCIES)} AS report FROM analysed"""),
    "file_report_errors": query(*ANALYSED, select=f"""
        SELECT corpus_id, rel_path, CASE WHEN doc_id % 9 = 0 THEN chr(10) || '## 📄 ' || rel_path || chr(10) || chr(10)
            || '**Error**: content could not be read' || chr(10) || chr(10) || '---' || chr(10)
            ELSE regexp_replace({good_report(CLASSES, DEPENDENCIES)}, ' [0-9]+ functions', ' 0 functions') END AS report
        FROM analysed"""),
    "report_index": query(DOC, select=f"""
        SELECT DISTINCT corpus_id, 0 AS part, '' AS rel_path, '## Files Remaining to Study' AS line FROM files WHERE {REMAINING}
        UNION ALL SELECT corpus_id, 1, rel_path, '- `' || rel_path || '`' FROM files WHERE {REMAINING}"""),
    "stream_equals_batch": query(*ANALYSED, records("analysed"), select=f"{RECORD_COLUMNS} records"),
}
