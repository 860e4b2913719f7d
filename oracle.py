"""SQL that must give the same rows as each registered query."""

from __future__ import annotations

from seamline.fixed_values import DOCUMENT_PREFIX, LANGUAGES, MAX_TOKENS, QUERY_PREFIX

NL = "chr(10)"
OLD_PATH = "source || '/f' || doc_id || '.py'"
ENDED = f"CASE WHEN lang = 'en' THEN text || {NL} ELSE text END"
LINES = (
    f"CASE WHEN text = '' THEN []::VARCHAR[] WHEN ends_with(text, {NL}) "
    f"THEN string_split(left(text, length(text) - 1), {NL}) ELSE string_split(text, {NL}) END"
)
NAMED = """
named AS (SELECT *, CASE lang WHEN 'fr' THEN 'build/' WHEN 'de' THEN 'Build/' ELSE 'pkg/' END
    || source || '/f' || doc_id || (['.py', '.PY', '.md', '', '.d.ts', '.json'])[doc_id % 6 + 1] AS path
    FROM documents)"""
STORED = f"stored AS (SELECT doc_id, lang, {OLD_PATH} AS path, doc_id::DOUBLE AS mtime, {ENDED} AS text FROM documents)"
CURRENT = f"""current AS (SELECT lang, n_chars,
    CASE WHEN lang = 'es' THEN 'moved/' ELSE '' END || {OLD_PATH} AS path,
    doc_id::DOUBLE + CASE WHEN n_chars < 20 OR lang = 'fr' THEN 1.0::DOUBLE
        WHEN lang = 'de' THEN 0.0005::DOUBLE ELSE 0.0::DOUBLE END AS mtime,
    CASE WHEN n_chars < 20 THEN '' ELSE {ENDED} END AS text FROM documents)"""
FILES = (
    f"files AS (SELECT {OLD_PATH} AS path, CASE WHEN lang = 'fr' THEN 2 ELSE 1 END::BIGINT AS file_version, "
    "'python' AS language FROM documents WHERE lang <> 'es')"
)


def chunks(source: str, keep: str, size: int, overlap: int) -> str:
    """Chunks of the rows of `source` (with text), keeping the columns `keep`."""
    stride = size - overlap
    starts = "[0]" if stride <= 0 else f"generate_series(0, len(lines) - 1, {stride})"
    return f"""SELECT {keep}, (s // {max(stride, 1)})::INT AS chunk_no, (s + 1)::INT AS start_line,
        least(s + {size}, n)::INT AS end_line,
        array_to_string(lines[s + 1 : s + {size}], {NL})
            || CASE WHEN s + {size} < n OR closed THEN {NL} ELSE '' END AS text
        FROM (SELECT *, len(lines) AS n, unnest({starts}) AS s
            FROM (SELECT *, {LINES} AS lines, ends_with(text, {NL}) AS closed FROM {source})
            WHERE len(lines) > 0)"""


def doc_chunks(size: int, overlap: int) -> str:
    return chunks(f"(SELECT doc_id, {ENDED} AS text FROM documents)", "doc_id", size, overlap)


def identified(source: str, name: str, first: str = "0") -> str:
    return f"""{name} AS (SELECT *, {first} + row_number() OVER (
        ORDER BY string_split(path, '/'), chunk_no) - 1 AS vector_id
        FROM ({chunks(source, "path", 8, 2)}))"""


def hashed(name: str, source: str, key: str, prefix: str, dim: int, limit: int | None = None) -> str:
    """CTEs ending in `name`: key, b, c with the components that are not zero."""
    words = f"regexp_extract_all(lower('{prefix}' || text), '[a-z0-9_]+')"
    if limit:
        words = f"({words})[1:{limit}]"
    return f"""
    {name}_words AS (SELECT {key}, unnest({words}) AS w FROM {source}),
    {name}_hash AS (SELECT {key}, ('0x' || substr(md5(w), 1, 8))::BIGINT AS h FROM {name}_words),
    {name}_sums AS (SELECT {key}, h % {dim} AS b,
        sum(CASE WHEN (h // {dim}) % 2 = 0 THEN 1 ELSE -1 END)::BIGINT AS v
        FROM {name}_hash GROUP BY ALL HAVING v <> 0),
    {name}_norms AS (SELECT {key}, sqrt(sum(v * v)::DOUBLE) AS norm FROM {name}_sums GROUP BY ALL),
    {name} AS (SELECT s.*, (v / norm)::FLOAT::DOUBLE AS c
        FROM {name}_sums s JOIN {name}_norms USING ({key}))"""


def hashed_rows(size: int, overlap: int, limit: int | None = None) -> str:
    return f"""WITH ch AS ({doc_chunks(size, overlap)}),
    {hashed("e", "ch", "doc_id, chunk_no", DOCUMENT_PREFIX, 256, limit)},
    packed AS (SELECT doc_id, chunk_no,
        string_agg(b || ':' || round(c * 1e6)::BIGINT, ',' ORDER BY b) AS vector FROM e GROUP BY ALL)
    SELECT doc_id, chunk_no, coalesce(vector, '') AS vector FROM ch LEFT JOIN packed USING (doc_id, chunk_no)"""


def ranked(scores: str, k: int = 10) -> str:
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id
        ORDER BY round(score, 6) DESC, vector_id)::INT AS rank FROM ({scores})) WHERE rank <= {k}"""


def text_hits(chunk_table: str, dim: int) -> str:
    """CTE `hits`: top 10 of `chunk_table` (vector_id, text) for the benchmark texts."""
    scores = """SELECT query_id, vector_id, coalesce(dot, 0)::DOUBLE AS score
        FROM (SELECT query_id FROM asked) CROSS JOIN (SELECT vector_id FROM %s)
        LEFT JOIN (SELECT query_id, vector_id, sum(q.c * d.c) AS dot
            FROM q JOIN d USING (b) GROUP BY ALL) USING (query_id, vector_id)""" % chunk_table
    return f"""asked AS (SELECT item_id AS query_id, text FROM benchmark),
    {hashed("q", "asked", "query_id", QUERY_PREFIX, dim)},
    {hashed("d", chunk_table, "vector_id", DOCUMENT_PREFIX, dim)},
    hits AS ({ranked(scores)})"""


def vectors(dim: int) -> str:
    return f"""raw AS (SELECT vec_id AS vector_id, label, embedding[1:{dim}]::DOUBLE[] AS v FROM embeddings),
    vectors AS (SELECT vector_id, label, list_transform(v, lambda x:
        x / CASE WHEN n = 0 THEN 1 ELSE n END)::FLOAT[]::DOUBLE[] AS embedding
        FROM (SELECT *, sqrt(list_inner_product(v, v)) AS n FROM raw))"""


def pairs(where: str = "TRUE") -> str:
    return f"""SELECT a.vector_id AS query_id, b.vector_id, list_inner_product(a.embedding, b.embedding) AS score
        FROM vectors a, vectors b WHERE {where}"""


MILLIONTHS = "array_to_string(list_transform(embedding, lambda x: round(x * 1e6)::BIGINT::VARCHAR), ',')"
LIVE = "(SELECT doc_id FROM documents WHERE lang = 'en')"
SCORED = "SELECT query_id, rank, vector_id, round(score, 4) + 0.0 AS score"

VECTOR_HITS = f"""{vectors(32)}, hits AS ({ranked(pairs())}), {STORED},
    {identified("stored", "ch")}, {FILES},
    found AS (SELECT query_id, rank, path, start_line, end_line, score, language, text
        FROM hits JOIN ch USING (vector_id) JOIN files USING (path) WHERE file_version = 1)"""

PLAN = f"""{STORED}, {CURRENT},
    counted AS (SELECT path, mtime AS now, ceil(len({LINES}) / 48)::INT AS n FROM current),
    both_sides AS (SELECT path, mtime AS was, now, n,
        now IS NOT NULL AND (mtime IS NULL OR abs(mtime - now) >= 0.001) AS touched
        FROM stored FULL JOIN counted USING (path)),
    plan AS (SELECT path,
        CASE WHEN now IS NULL THEN 'delete' WHEN NOT touched OR n = 0 THEN 'skip'
            WHEN was IS NULL THEN 'new' ELSE 'updated' END AS action,
        CASE WHEN touched THEN n ELSE 0 END::INT AS n_chunks,
        now IS NULL OR (touched AND was IS NOT NULL) AS drop_old
        FROM both_sides)"""

VERSIONED = f"""versioned AS ({chunks(
    f"(SELECT {OLD_PATH} AS path, {ENDED} AS text, "
    "unnest(CASE WHEN lang = 'fr' THEN [1, 2] ELSE [1] END)::BIGINT AS file_version FROM documents)",
    "path, file_version", 8, 2)}), {FILES}"""

TWO_RUNS = f"""{STORED}, {CURRENT},
    {identified("stored", "run1")},
    {identified("(SELECT * FROM current WHERE lang IN ('fr', 'es'))", "run2", "(SELECT count(*) FROM run1)")},
    live AS (SELECT run1.*, 1::BIGINT AS file_version FROM run1 JOIN current USING (path)
            WHERE lang IN ('en', 'de') AND n_chars >= 20
        UNION ALL SELECT *, 2::BIGINT FROM run2)"""


def statements() -> dict[str, str]:
    pairs_of_languages = ", ".join(f"'{k}': '{v}'" for k, v in LANGUAGES.items())
    ext = r"lower(regexp_extract(path, '[^/](\.[^./]+)$', 1))"
    toxic = "SELECT doc_id FROM labels WHERE toxic = 1"
    return {
        "source_filter": f"""WITH {NAMED} SELECT doc_id, path FROM named
            WHERE {ext} IN ('.py', '.ts', '.json')
            AND NOT list_has_any(string_split(path, '/')[:-2], ['build', 'dist'])""",
        "language_map": f"""WITH {NAMED} SELECT path, {ext} AS extension,
            map_extract_value(MAP {{{pairs_of_languages}}}, {ext}) AS language FROM named""",
        "decode_lines": f"""SELECT doc_id, i::INT AS line_no, lines[i] AS line FROM (
            SELECT *, unnest(generate_series(1, len(lines))) AS i FROM (
                SELECT doc_id, {LINES} AS lines FROM documents))""",
        "chunk_documents": doc_chunks(8, 2),
        "chunk_default": doc_chunks(64, 16),
        "chunk_bad_stride": doc_chunks(8, 8),
        "line_range": f"""WITH {STORED}, ranges AS ({chunks("stored", "path, lang", 8, 2)}),
            now AS (SELECT path, lines, closed FROM (SELECT path, {LINES} AS lines, ends_with(text, {NL}) AS closed
                FROM (SELECT {OLD_PATH} AS path, CASE WHEN lang = 'fr'
                    THEN replace(text, {NL}, ' ') ELSE {ENDED} END AS text
                    FROM documents WHERE lang <> 'es')))
            SELECT path, chunk_no, start_line, end_line, CASE
                WHEN lines IS NULL THEN '[Error reading file: cannot read ' || path || ']'
                WHEN start_line > len(lines) THEN ''
                ELSE array_to_string(lines[start_line : end_line], {NL})
                    || CASE WHEN end_line < len(lines) OR closed THEN {NL} ELSE '' END END AS content
            FROM ranges LEFT JOIN now USING (path)""",
        "embed_hash": hashed_rows(8, 2),
        "embed_token_limit": hashed_rows(1 << 20, 16, MAX_TOKENS),
        "mrl_normalise": f"WITH {vectors(32)} SELECT vector_id, {MILLIONTHS} AS vector FROM vectors",
        "add_vectors": f"""WITH {vectors(64)}, added AS (SELECT vector_id + 1000000 AS vector_id,
                list_transform(v, lambda x: x / CASE WHEN n = 0 THEN 1 ELSE n END)::FLOAT[]::DOUBLE[] AS embedding
                FROM (SELECT *, sqrt(list_inner_product(v, v)) AS n FROM (
                    SELECT vector_id, list_transform(embedding, lambda x: x * 2) AS v FROM vectors)))
            SELECT vector_id, {MILLIONTHS} AS vector FROM (
                SELECT vector_id, embedding FROM vectors UNION ALL SELECT * FROM added)""",
        "topk_single": f"""WITH {vectors(64)},
            mean AS (SELECT list(m ORDER BY i) AS v FROM (SELECT i, avg(embedding[i]) AS m
                FROM vectors, generate_series(1, 64) t(i) GROUP BY i)),
            asked AS (SELECT list_transform(v, lambda x: x / n)::FLOAT[]::DOUBLE[] AS q
                FROM (SELECT v, sqrt(list_inner_product(v, v)) AS n FROM mean))
            SELECT rank, vector_id, round(score, 4) + 0.0 AS score FROM ({ranked(
                "SELECT 0 AS query_id, vector_id, list_inner_product(embedding, q) AS score FROM vectors, asked")})""",
        "topk_batch": f"WITH {vectors(64)} {SCORED} FROM ({ranked(pairs())})",
        "topk_blocks": f"WITH {vectors(64)} {SCORED} FROM ({ranked(pairs())})",
        "topk_dead": f"WITH {vectors(32)} {SCORED} FROM ({ranked(pairs(f'b.vector_id IN {LIVE}'))})",
        "topk_live": f"WITH {vectors(32)} {SCORED} FROM ({ranked(pairs(f'b.vector_id IN {LIVE}'))})",
        "topk_all_slots": f"WITH {vectors(32)} {SCORED} FROM ({ranked(pairs())}) WHERE vector_id IN {LIVE}",
        "topk_probe": f"""WITH {vectors(32)},
            means AS (SELECT label, list(m ORDER BY i) AS v FROM (SELECT label, i, avg(embedding[i]) AS m
                FROM vectors, generate_series(1, 32) t(i) GROUP BY ALL) GROUP BY ALL),
            centroids AS (SELECT label AS list_id, list_transform(v, lambda x: x / n)::FLOAT[]::DOUBLE[] AS center
                FROM (SELECT *, sqrt(list_inner_product(v, v)) AS n FROM means)),
            near AS (SELECT vector_id, list_id, row_number() OVER (PARTITION BY vector_id
                ORDER BY round(list_inner_product(embedding, center), 6) DESC, list_id) AS place
                FROM vectors, centroids),
            scores AS (SELECT a.vector_id AS query_id, b.vector_id,
                list_inner_product(a.embedding, b.embedding) AS score
                FROM vectors a JOIN near p ON a.vector_id = p.vector_id AND p.place <= 3
                JOIN near l ON l.list_id = p.list_id AND l.place = 1
                JOIN vectors b ON b.vector_id = l.vector_id)
            {SCORED} FROM ({ranked("SELECT * FROM scores")})""",
        "delete_vectors": f"""SELECT vec_id AS vector_id, label FROM embeddings
            WHERE vec_id NOT IN ({toxic})""",
        "plan_changes": f"WITH {PLAN} SELECT * FROM plan",
        "run_stats": f"""WITH {PLAN} SELECT count(*) FILTER (action = 'new') AS new_files,
            count(*) FILTER (action = 'updated') AS updated_files,
            count(*) FILTER (action = 'skip') AS skipped_files,
            count(*) FILTER (action = 'delete') AS deleted_files,
            (sum(n_chunks) FILTER (action IN ('new', 'updated')))::BIGINT AS total_chunks FROM plan""",
        "upsert_files": f"""WITH {STORED}, {CURRENT} SELECT path, coalesce(c.mtime, s.mtime) AS mtime,
            CASE WHEN c.path IS NULL THEN 'python' ELSE 'changed' END AS language,
            CASE WHEN s.path IS NULL THEN NULL ELSE 1 END::BIGINT AS file_version
            FROM stored s FULL JOIN current c USING (path)""",
        "delete_missing": f"""WITH {STORED}, {CURRENT} SELECT path, mtime FROM stored
            WHERE path IN (SELECT path FROM current)""",
        "missing_files": f"""WITH {STORED}, {CURRENT} SELECT path, mtime FROM stored
            WHERE path NOT IN (SELECT path FROM current)""",
        "live_chunks": f"""WITH {VERSIONED} SELECT path, file_version, chunk_no, start_line, end_line
            FROM versioned JOIN files USING (path, file_version)""",
        "replaced_chunks": f"""WITH {VERSIONED} SELECT path, file_version, chunk_no FROM versioned
            ANTI JOIN files USING (path, file_version)""",
        "vector_ids": f"""WITH f AS (SELECT (['a/b/', 'a-b/', 'a/'])[doc_id % 3 + 1] || source || '/f' || doc_id AS path,
                {ENDED} AS text FROM documents),
            counted AS (SELECT path, ceil(len({LINES}) / 6)::INT AS n_chunks FROM f)
            SELECT *, (1000 + coalesce(sum(n_chunks) OVER (ORDER BY string_split(path, '/')
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS first_vector_id FROM counted""",
        "orphan_vectors": f"""WITH {STORED}, {identified("stored", "ch")}, {FILES}
            SELECT vector_id FROM ch ANTI JOIN (SELECT * FROM files WHERE file_version = 1) f USING (path)""",
        "broken_references": f"""WITH {VERSIONED} SELECT path, file_version, chunk_no FROM versioned
            WHERE path NOT IN (SELECT path FROM files)""",
        "duplicate_paths": """SELECT source || '/' || lang AS path, count(*) AS n FROM documents
            GROUP BY ALL HAVING n > 1""",
        "store_stats": f"""SELECT (SELECT count(*) FROM documents) AS file_count,
            (SELECT count(*) FROM ({doc_chunks(8, 2)})) AS chunk_count,
            (SELECT count(*) FROM embeddings) AS vector_count""",
        "hydrate_hits": f"""WITH {VECTOR_HITS} SELECT query_id, rank, path, start_line, end_line, language
            FROM found""",
        "result_rows": f"""WITH {VECTOR_HITS} SELECT query_id, rank, path AS file_path, start_line, end_line,
            round(score, 4) + 0.0 AS score, language, text AS content FROM found""",
        "result_preview": f"""WITH {VECTOR_HITS}, split AS (SELECT *, string_split(text, {NL}) AS lines FROM found)
            SELECT query_id, rank, path || ':' || start_line || '-' || end_line || '  score='
                || printf('%.2f', score) || {NL} || array_to_string(list_transform(
                    CASE WHEN len(lines) > 5 THEN list_concat(lines[1:2], ['    ...'], lines[-2:]) ELSE lines END,
                    lambda l: '    ' || l), {NL}) || {NL} AS block FROM split""",
        "search_text": f"""WITH {STORED}, {identified("stored", "ch")}, {text_hits("ch", 256)}
            SELECT query_id, rank, path AS file_path, start_line, end_line, round(score, 4) + 0.0 AS score,
            'python' AS language, text AS content FROM hits JOIN ch USING (vector_id)""",
        "index_two_runs": f"""WITH {TWO_RUNS} SELECT path, file_version, chunk_no, start_line, end_line, text,
            vector_id FROM live""",
        "compact_index": f"""WITH {TWO_RUNS} SELECT path, chunk_no, start_line, end_line, text, vector_id
            FROM live""",
        "index_stats": f"""WITH {TWO_RUNS}
            SELECT 'hashed words, 128 buckets' AS model_name, 128 AS embedding_dim,
            (SELECT count(*) FROM documents WHERE NOT (lang = 'es' AND n_chars < 20)) AS file_count,
            (SELECT count(*) FROM live) AS chunk_count,
            (SELECT count(*) FROM run1) + (SELECT count(*) FROM run2) AS vector_count,
            8 AS chunk_size_lines, 2 AS chunk_overlap_lines""",
        "relative_paths": f"""SELECT doc_id, CASE WHEN lang = 'en' THEN {OLD_PATH} END AS path FROM documents""",
        "result_json": f"""WITH {VECTOR_HITS} SELECT query_id, rank, path AS file_path, start_line, end_line,
            round(score, 4) + 0.0 AS score, language, text AS content FROM found""",
        "index_lists": f"""WITH {TWO_RUNS}, {text_hits("live", 128)}
            SELECT query_id, rank, path AS file_path, start_line, end_line, round(score, 4) + 0.0 AS score,
            'python' AS language, text AS content FROM hits JOIN live USING (vector_id)""",
        "index_search": f"""WITH {TWO_RUNS}, {text_hits("live", 128)}
            SELECT query_id, rank, path AS file_path, start_line, end_line, round(score, 4) + 0.0 AS score,
            'python' AS language, text AS content FROM hits JOIN live USING (vector_id)""",
    }
