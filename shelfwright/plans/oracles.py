"""The core queries in SQL, written from the definitions of their results rather than from the operators."""

from __future__ import annotations

NOW, RATE = 1722470400.0, 0.023
WS = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
CAT = "cat AS (SELECT * FROM files WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1)"
TXT = "txt AS (SELECT id, min(text) AS text FROM snippets WHERE text <> '' GROUP BY id)"


def bucket(c: str) -> str:
    return f"CASE lower(split_part({c}, '/', 1)) WHEN 'image' THEN 'Images' WHEN 'audio' THEN 'Audio' WHEN 'video' THEN 'Video' WHEN 'text' THEN 'Documents' WHEN 'application' THEN 'Documents' ELSE 'Other' END"


def name(c: str) -> str:
    return rf"regexp_extract({c}, '([^/\\]*)[/\\]*$', 1)"


def folder(c: str) -> str:
    return rf"regexp_extract({c}, '([^/\\]+)[/\\]+[^/\\]*[/\\]*$', 1)"


def ext(c: str) -> str:
    return rf"lower(regexp_extract({name(c)}, '^\.*[^.].*\.([^.]+)$', 1))"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def age(c: str, now: float = NOW) -> str:
    return f"CASE WHEN ({now} - {c}) / 86400 < 30 THEN 'new(<30d)' WHEN ({now} - {c}) / 86400 < 180 THEN 'stale(30-180d)' WHEN {c} IS NOT NULL THEN 'old(>180d)' END"


BANDS = "(VALUES ('new(<30d)'), ('stale(30-180d)'), ('old(>180d)')) v(age)"
TEMP = f"regexp_matches(lower({name('path')}), '(\\.(tmp|log|bak|old)|~)$')"
DUP = "dup AS (SELECT *, count(*) OVER (PARTITION BY hash) AS n, min(seq) OVER (PARTITION BY hash) AS first_seq FROM cat WHERE hash IS NOT NULL QUALIFY count(*) OVER (PARTITION BY hash) > 1)"
FNV = "list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(string_split({0}, ''), lambda ch: ascii(ch)::HUGEINT)), lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616)"
SIGNED = "CASE WHEN {0} >= 9223372036854775808 THEN {0} - 18446744073709551616 ELSE {0} END"
SHINGLES = "CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) ELSE [array_to_string(w, ' ')] END"
SIM = f"""
    tok AS (SELECT id, list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda x: lower(x)) AS w FROM txt),
    sh AS (SELECT id, unnest({SHINGLES}) AS s FROM tok),
    fnv AS (SELECT s, CASE WHEN s = '' THEN 14695981039346656037::HUGEINT ELSE {FNV.format("s")} END AS h FROM (SELECT DISTINCT s FROM sh)),
    votes AS (SELECT id, b, sum(CASE WHEN (h // power(2, b)::HUGEINT) % 2 = 1 THEN 1 ELSE -1 END) AS v FROM sh JOIN fnv USING (s), range(64) r(b) GROUP BY id, b),
    raw AS (SELECT id, sum(CASE WHEN v >= 0 THEN power(2, b)::HUGEINT ELSE 0 END)::HUGEINT AS u FROM votes GROUP BY id),
    sim AS (SELECT id, ({SIGNED.format("u")})::BIGINT AS fp FROM raw)"""


def leaders(items: str, t: int, p: str = "") -> str:
    """CTEs ending in lead (cluster_idx, id, seq, leader_seq, n), by walking the words in order; all names begin with p."""
    return f"""
    {p}items AS ({items}),
    {p}word AS (SELECT fp, min(seq) AS rank, row_number() OVER (ORDER BY min(seq)) AS i FROM {p}items GROUP BY fp),
    {p}walk(i, led) AS (
        SELECT 0::BIGINT, []::STRUCT(fp BIGINT, rank BIGINT)[]
        UNION ALL
        SELECT w.i, CASE WHEN len(list_filter(led, lambda l: bit_count(xor(l.fp, w.fp)) <= {t})) = 0 THEN list_append(led, {{'fp': w.fp, 'rank': w.rank}}) ELSE led END
        FROM {p}walk x JOIN {p}word w ON w.i = x.i + 1),
    {p}led AS (SELECT led FROM {p}walk ORDER BY i DESC LIMIT 1),
    {p}own AS (SELECT w.fp, list_filter(led, lambda l: bit_count(xor(l.fp, w.fp)) <= {t} AND l.rank <= w.rank)[1].rank AS leader_seq FROM {p}word w, {p}led),
    {p}placed AS (SELECT i.id, i.seq, o.leader_seq, count(*) OVER (PARTITION BY o.leader_seq) AS n FROM {p}items i JOIN {p}own o USING (fp)),
    {p}lead AS (SELECT dense_rank() OVER (ORDER BY leader_seq) - 1 AS cluster_idx, id, seq, leader_seq, n FROM {p}placed WHERE n > 1)"""


NEAR = f"{CAT}, {TXT}, {SIM}, {leaders('SELECT cat.seq, cat.id, sim.fp FROM cat JOIN sim USING (id)', 8)}"
R = "WITH RECURSIVE "
IMAGES = leaders(f"SELECT seq, id, ('0x' || left(md5(coalesce({folder('path')}, '')), 14))::BIGINT * 16 + seq % 16 AS fp FROM cat WHERE {ext('path')} IN ('jpg', 'jpeg', 'png', 'gif', 'webp', 'bmp', 'tif', 'tiff', 'heic', 'heif')", 12, "image_")
DELETES = f"""
    SELECT id, path, 'exact_duplicate' AS reason, 0.99 AS confidence FROM dup WHERE seq <> first_seq
    UNION ALL SELECT lead.id, cat.path, 'near_duplicate_text:' || cluster_idx, 0.7 FROM lead JOIN cat USING (id) WHERE lead.seq <> leader_seq
    UNION ALL SELECT l.id, cat.path, 'near_duplicate_image:' || cluster_idx, 0.7 FROM image_lead l JOIN cat USING (id) WHERE l.seq <> leader_seq
    UNION ALL SELECT id, path, 'temp_suffix', 0.6 FROM cat WHERE {TEMP}"""
MOVES = f"SELECT id, path AS from_path, {bucket('type')} || '/all-' || lower({bucket('type')}) || '/' AS to_dir, {bucket('type')} || ':All ' || {bucket('type')} AS reason FROM cat"
MEMBERS = f"""
    mem AS (
        SELECT 'subcategory' AS kind, 'sub:' || {bucket('type')} || ':All ' || {bucket('type')} AS node_id, seq, id FROM cat
        UNION ALL SELECT 'duplicate_cluster', 'dup:' || left(hash, 8), seq, id FROM dup
        UNION ALL SELECT 'type_cluster', 'type:' || {bucket('type')}, seq, id FROM cat
        UNION ALL SELECT 'age_bucket', 'age:' || {age('mtime')}, seq, id FROM cat WHERE mtime IS NOT NULL
        UNION ALL SELECT 'near_duplicate_text', 'neardup:' || cluster_idx, seq, id FROM lead)"""
LINES = f"""
    line AS (SELECT id, regexp_replace({strip('text')}, '\\n', ' ', 'g') AS line FROM txt),
    top AS (SELECT node_id, string_agg('Snippet[' || left(id, 6) || ']: ' || left(line, 160), ' | ' ORDER BY seq) AS s
            FROM (SELECT node_id, m.id, seq, line FROM mem m JOIN line USING (id) WHERE line <> '' QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY seq) <= 2) GROUP BY node_id),
    tot AS (SELECT node_id, count(*) AS n, sum(coalesce(size, 0)) AS bytes FROM mem LEFT JOIN (SELECT id, size FROM cat) USING (id) GROUP BY node_id),
    summ AS (SELECT node_id, left('Files: ' || n || ', Total bytes: ' || bytes || coalesce(' | ' || s, ''), 800) AS summary FROM tot LEFT JOIN top USING (node_id))"""
EDGES = f"""
    edge AS (
        SELECT source, target, kind FROM (
            SELECT DISTINCT 'root' AS source, node_id AS target, 'contains' AS kind FROM mem WHERE kind <> 'subcategory'
            UNION SELECT 'root', 'age:' || age, 'contains' FROM {BANDS}
            UNION SELECT 'root', 'cat:' || {bucket('type')}, 'contains' FROM cat
            UNION SELECT 'cat:' || {bucket('type')}, 'sub:' || {bucket('type')} || ':All ' || {bucket('type')}, 'contains' FROM cat)
        UNION ALL SELECT node_id, id, 'contains' FROM mem WHERE kind = 'duplicate_cluster'
        UNION ALL SELECT node_id, id, 'contains_sample' FROM (SELECT * FROM mem WHERE kind <> 'duplicate_cluster' QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY seq) <= 50)),
    edges AS (SELECT 'e-' || source || '-' || target AS id, source, target, kind FROM edge)"""
COSTS = f"costs AS (SELECT {bucket('type')} || ':All ' || {bucket('type')} AS cluster_key, sum(coalesce(size, 0))::BIGINT AS bytes, round_even(sum(coalesce(size, 0)) / 1073741824.0, 4) AS gb, round_even(sum(coalesce(size, 0)) / 1073741824.0 * {RATE}, 4) AS monthly_cost FROM cat GROUP BY 1)"
ANSWERS = """
    ans AS (SELECT CASE WHEN ext IN ('jpg', 'jpeg', 'png', 'gif', 'webp', 'bmp', 'tif', 'tiff', 'heic', 'heif') THEN 'Images' WHEN ext IN ('mp3', 'wav', 'flac', 'ogg', 'm4a') THEN 'Audio' WHEN ext IN ('mp4', 'mov', 'avi', 'mkv', 'webm') THEN 'Video' ELSE 'Documents' END AS bucket,
                   (result_id - 1) // 100 AS batch, (result_id - 1) % 100 AS ord, label, lower(label) AS key, coalesce(file_ids, []) AS file_ids,
                   coalesce(array_to_string(top_terms, ' '), '') AS rationale, coalesce(CASE WHEN NOT isnan(score) AND score BETWEEN 0 AND 1 THEN score ELSE 0.5 END, 0.5) AS confidence FROM (SELECT *, lower(split_part(label, ' ', 1)) AS ext FROM cluster_results)),
    merged AS (SELECT bucket, key, row_number() OVER (PARTITION BY bucket ORDER BY min((batch, ord))) - 1 AS idx, arg_min(label, (batch, ord)) AS label, arg_max(rationale, (confidence, -batch, -ord)) AS rationale, arg_min(confidence, (batch, ord)) AS confidence FROM ans GROUP BY bucket, key)"""
WON = f"""
    offered AS (SELECT {bucket('type')} AS bucket, id FROM cat),
    won AS (SELECT x.bucket, x.id, m.idx, m.label, m.confidence FROM (SELECT DISTINCT bucket, key, unnest(file_ids) AS id FROM ans) x JOIN merged m USING (bucket, key) JOIN offered USING (bucket, id)
            QUALIFY row_number() OVER (PARTITION BY x.bucket, x.id ORDER BY m.confidence DESC, m.idx) = 1)"""
DESC = f"""
    descr AS (SELECT id, array_to_string(regexp_extract_all(lower(concat_ws(' ', nullif({name('path')}, ''), nullif({folder('path')}, ''), nullif(split_part(type, '/', 1), ''), nullif({ext('path')}, ''), nullif(left(text, 2000), ''))), '[a-z0-9_]+'), ' ') AS descriptor
              FROM cat LEFT JOIN txt USING (id))"""

NODES = f"""
        note AS (SELECT node_id, max(summary) AS summary FROM (SELECT * FROM summ WHERE node_id NOT LIKE 'sub:%' UNION ALL SELECT 'sub:' || {bucket('type')} || ':All ' || {bucket('type')}, count(*) || ' files (fallback).' FROM cat GROUP BY 1) GROUP BY 1),
        n AS (
            SELECT 'root' AS id, 'root' AS kind, 'Scan Root' AS label, NULL::VARCHAR AS hash, NULL::VARCHAR AS bucket, NULL::BIGINT AS n_files, NULL::BIGINT AS subcount, NULL::BIGINT AS size, NULL::DOUBLE AS mtime, NULL::VARCHAR AS type, 'Where the scan begins.' AS rationale, 1.0 AS confidence
            UNION ALL SELECT DISTINCT 'cat:' || {bucket('type')}, 'category', {bucket('type')}, NULL, NULL, NULL, 1, NULL, NULL, NULL, 'All files of one bucket.', 0.8 FROM cat
            UNION ALL SELECT 'sub:' || b || ':All ' || b, 'subcategory', b || ' → All ' || b, NULL, b, n, NULL, NULL, NULL, NULL, 'Files of ' || b || ' under All ' || b, 0.75 FROM (SELECT {bucket('type')} AS b, count(*) AS n FROM cat GROUP BY 1)
            UNION ALL SELECT 'dup:' || left(hash, 8), 'duplicate_cluster', 'Duplicates ' || left(hash, 8), hash, NULL, count(*), NULL, NULL, NULL, NULL, count(*) || ' files with the same sha256 digest.', 0.95 FROM dup GROUP BY hash
            UNION ALL SELECT 'type:' || b, 'type_cluster', 'Type: ' || b, NULL, b, n, NULL, NULL, NULL, NULL, n || ' files of one MIME family.', 0.7 FROM (SELECT {bucket('type')} AS b, count(*) AS n FROM cat GROUP BY 1)
            UNION ALL SELECT 'age:' || v.age, 'age_bucket', 'Age: ' || v.age, NULL, NULL, coalesce(n, 0), NULL, NULL, NULL, NULL, coalesce(n, 0) || ' files of one age band.', 0.6 FROM {BANDS} LEFT JOIN (SELECT {age('mtime')} AS age, count(*) AS n FROM cat GROUP BY 1) x USING (age)
            UNION ALL SELECT 'neardup:' || cluster_idx, 'near_duplicate_text', 'Near-duplicates #' || cluster_idx, NULL, NULL, count(*), NULL, NULL, NULL, NULL, count(*) || ' files with the same sha256 digest.', 0.95 FROM lead GROUP BY cluster_idx
            UNION ALL SELECT id, 'file', path, hash, NULL, NULL, NULL, size, mtime, type, 'A scanned file.', 1.0 FROM (SELECT * FROM cat ORDER BY seq LIMIT 200))"""
LINKED = f"""
        leaf AS (SELECT id, path AS label FROM cat ORDER BY seq LIMIT 200),
        link AS (SELECT node_id AS source, id, seq FROM mem WHERE kind = 'duplicate_cluster'
                 UNION ALL (SELECT node_id, id, seq FROM mem WHERE kind <> 'duplicate_cluster' QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY seq) <= 50)),
        linked AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY seq) AS pos, id, label FROM link JOIN leaf USING (id) QUALIFY pos <= 40)"""

ORACLE: dict[str, str] = {
    "file_identity": f"SELECT seq, id, md5(path) = id AS id_ok, {name('path')} AS name, {folder('path')} AS folder, {ext('path')} AS ext, {bucket('type')} AS bucket FROM files",
    "content_gate": f"SELECT seq, size <= 5000000 AS hashed, size <= 3000000 AS readable, CASE WHEN size <= 5000000 THEN lower(hash) END AS hash, {ext('path')} IN ('jpg', 'jpeg', 'png', 'gif', 'webp', 'bmp', 'tif', 'tiff', 'heic', 'heif') AS is_image, {ext('path')} IN ('txt', 'md', 'csv', 'log', 'json', 'yaml', 'yml', 'xml', 'html', 'htm') AS is_text FROM files",
    "human_sizes": "WITH u AS (SELECT seq, size, CASE WHEN size < 1024 THEN 0 WHEN size < 1048576 THEN 1 WHEN size < 1073741824 THEN 2 WHEN size < 1099511627776 THEN 3 WHEN size < 1125899906842624 THEN 4 ELSE 5 END AS k FROM files) SELECT seq, CASE WHEN k = 0 THEN size || ' B' ELSE printf('%.1f', round_even(size / pow(1024.0, k), 1)) || ' ' || ['KB', 'MB', 'GB', 'TB', 'PB'][k] END AS shown FROM u",
    "html_tag_strip": f"""WITH w AS (SELECT doc_id, source, text FROM documents WHERE text IS NOT NULL AND source IS NOT NULL),
        m AS (SELECT doc_id, '<p class=''a''>' || text || '</p>' || chr(10) || '<br/>  <i>' || source || '</i>' AS t FROM w)
        SELECT doc_id, left({strip("regexp_replace(regexp_replace(t, '<[^>]+>', ' ', 'g'), '" + WS + "+', ' ', 'g')")}, 20000) AS plain FROM m""",
    "exact_duplicate_clusters": f"WITH {CAT}, {DUP} SELECT hash, count(*) AS n, min(seq) AS first_seq, sum(size)::BIGINT AS bytes FROM dup GROUP BY hash",
    "exact_duplicate_members": f"WITH {CAT}, {DUP} SELECT hash, id, seq, n, seq = first_seq AS is_first FROM dup",
    "exact_duplicate_deletes": f"WITH {CAT}, {DUP} SELECT id, path, 'exact_duplicate' AS reason, 0.99::DOUBLE AS confidence FROM dup WHERE seq <> first_seq",
    "type_clusters": f"WITH {CAT} SELECT {bucket('type')} AS bucket, count(*) AS n, sum(size)::BIGINT AS bytes, min(seq) AS first_seq FROM cat GROUP BY 1",
    "age_clusters": f"WITH {CAT} SELECT v.age, coalesce(n, 0) AS n, coalesce(bytes, 0)::BIGINT AS bytes FROM {BANDS} LEFT JOIN (SELECT {age('mtime')} AS age, count(*) AS n, sum(size) AS bytes FROM cat GROUP BY 1) x USING (age)",
    "order_age_clusters": f"SELECT v.age, coalesce(n, 0) AS n FROM {BANDS} LEFT JOIN (SELECT {age('epoch(o_orderdate)', 902000000.0)} AS age, count(*) AS n FROM orders GROUP BY 1) x USING (age)",
    "temp_suffix_deletes": f"WITH {CAT} SELECT id, path, 'temp_suffix' AS reason, 0.6::DOUBLE AS confidence FROM cat WHERE {TEMP}",
    "dominant_extension": f"WITH {CAT}, e AS (SELECT {bucket('type')} AS bucket, {ext('path')} AS ext, count(*) AS n, min(seq) AS first FROM cat GROUP BY 1, 2) SELECT bucket, ext, n FROM e QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY n DESC, first) = 1",
    "tokens_shingles": f"WITH tok AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda x: lower(x)) AS w FROM documents WHERE text IS NOT NULL) SELECT doc_id, len(w)::INT AS n_words, len({SHINGLES})::INT AS n_shingles, md5(array_to_string({SHINGLES}, '|')) AS shingles_md5 FROM tok",
    "fnv1a_hash": f"WITH t AS (SELECT DISTINCT array_to_string(list_transform(regexp_extract_all(x, '[A-Za-z0-9_]+'), lambda y: lower(y)), ' ') AS term FROM (SELECT unnest(top_terms) AS x FROM cluster_results) WHERE x IS NOT NULL), h AS (SELECT term, CASE WHEN term = '' THEN 14695981039346656037::HUGEINT ELSE {FNV.format('term')} END AS u FROM t) SELECT term, ({SIGNED.format('u')})::BIGINT AS fnv FROM h",
    "simhash64": f"WITH {TXT}, {SIM} SELECT id, fp FROM sim",
    "hamming_pairs": f"WITH {TXT}, {SIM}, d AS (SELECT DISTINCT fp FROM sim) SELECT a.fp AS fp_a, b.fp AS fp_b, bit_count(xor(a.fp, b.fp))::INT AS distance FROM d a JOIN d b ON a.fp < b.fp WHERE bit_count(xor(a.fp, b.fp)) <= 8",
    "near_duplicate_clusters": f"{R}{NEAR} SELECT cluster_idx, id, seq, leader_seq, n FROM lead",
    "near_duplicate_deletes": f"{R}{NEAR} SELECT lead.id, cat.path, 'near_duplicate_text:' || cluster_idx AS reason, 0.7::DOUBLE AS confidence FROM lead JOIN cat USING (id) WHERE lead.seq <> leader_seq",
    "sign_bit_similarity": R
    + leaders(
        f"SELECT vec_id * 4 + j AS seq, vec_id || '-' || j AS id, xor(({SIGNED.format('u')})::BIGINT, [0, 7 * 32, 63 * 32, 511 * 32][j + 1]::BIGINT) AS fp FROM (SELECT vec_id, list_sum(list_transform(range(64), lambda i: CASE WHEN embedding[i + 1] > 0 THEN power(2, 63 - i)::HUGEINT ELSE 0::HUGEINT END))::HUGEINT AS u FROM embeddings WHERE len(embedding) = 64), range(4) r(j)",
        12,
    )
    + " SELECT cluster_idx, id, seq, leader_seq, n FROM lead",
    "dct_phash": """WITH px AS (SELECT vec_id, i // 32 AS y, i % 32 AS x, 128.0 + 100.0 * embedding[((i // 32) * 7 + (i % 32) * 3) % 64 + 1]::DOUBLE AS v FROM embeddings, range(1024) r(i) WHERE len(embedding) = 64),
        wave AS (SELECT k, x, cos(pi() * (2 * x + 1) * k / 64) * CASE WHEN k = 0 THEN sqrt(1 / 32.0) ELSE sqrt(2 / 32.0) END AS c FROM range(8) a(k), range(32) b(x)),
        one AS (SELECT vec_id, y, k AS kx, sum(v * c) AS v FROM px JOIN wave USING (x) GROUP BY 1, 2, 3),
        two AS (SELECT vec_id, wave.k * 8 + kx AS p, sum(v * c) AS v FROM one JOIN wave ON wave.x = one.y GROUP BY 1, 2),
        low AS (SELECT vec_id, p, v, avg(v) OVER (PARTITION BY vec_id) AS mean FROM two WHERE p > 0),
        u AS (SELECT vec_id, sum(CASE WHEN v > mean THEN power(2, 64 - p)::HUGEINT ELSE 0 END)::HUGEINT AS u FROM low GROUP BY 1)
        SELECT vec_id, (CASE WHEN u >= 9223372036854775808 THEN u - 18446744073709551616 ELSE u END)::BIGINT AS fp FROM u""",
    "json_recovery": """SELECT doc_id, '[{"label": ' || to_json(coalesce(folder, ''))::VARCHAR || ', "file_ids": ["' || doc_id || '"]}]' AS recovered FROM documents WHERE text IS NOT NULL""",
    "cluster_summaries": f"WITH {CAT}, {TXT}, {DUP}, mem AS (SELECT 'dup:' || left(hash, 8) AS node_id, seq, id FROM dup UNION ALL SELECT 'type:' || {bucket('type')}, seq, id FROM cat), {LINES} SELECT node_id, summary FROM summ",
    "fallback_categories": f"WITH {CAT} SELECT 'sub:' || {bucket('type')} || ':All ' || {bucket('type')} AS node_id, count(*) || ' files (fallback).' AS summary FROM cat GROUP BY 1",
    "cluster_costs": f"WITH {CAT}, {COSTS} SELECT * FROM costs",
    "total_cost": f"WITH {CAT}, {COSTS} SELECT round(sum(gb), 4) AS total_gb, round(sum(gb) * {RATE}, 4) AS total_cost FROM costs",
    "inventory_batches": f"WITH {CAT}, {TXT}, i AS (SELECT *, {bucket('type')} AS bucket, row_number() OVER (PARTITION BY {bucket('type')} ORDER BY seq) AS pos FROM cat) SELECT bucket, ((pos - 1) // 400)::INT AS batch, pos::INT AS pos, i.id, {name('path')} AS name, {ext('path')} AS ext, type AS mime, size, md5(coalesce(left(text, 1000), '')) AS snippet_md5 FROM i LEFT JOIN txt USING (id) WHERE pos <= 500",
    "category_merge": f"WITH {ANSWERS} SELECT bucket, key, idx::INT AS idx, label, rationale, confidence FROM merged",
    "category_unique": f"WITH {CAT}, {ANSWERS}, {WON} SELECT bucket, id, idx::INT AS idx, label, confidence FROM won",
    "uncategorized": f"WITH {CAT}, {ANSWERS}, {WON} SELECT bucket, id FROM offered WHERE id NOT IN (SELECT id FROM won)",
    "descriptor": f"WITH {CAT}, {TXT}, {DESC} SELECT id, descriptor FROM descr",
    "tfidf_weights": f"""WITH {CAT}, {TXT}, {DESC},
        w AS (SELECT id, list_filter(string_split(descriptor, ' '), lambda x: length(x) > 1) AS w FROM descr),
        g AS (SELECT id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w),
        tf AS (SELECT id, term, count(*) AS tf FROM g GROUP BY 1, 2),
        vocab AS (SELECT term, count(*) AS df FROM tf GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 6000),
        raw AS (SELECT id, term, tf * (ln((1.0 + (SELECT count(*) FROM descr)) / (1.0 + df)) + 1) AS x FROM tf JOIN vocab USING (term))
        SELECT id, term, round(x / sqrt(sum(x * x) OVER (PARTITION BY id)), 6) AS weight FROM raw""",
    "graph_nodes": f"""{R}{NEAR}, {DUP}, {MEMBERS}, {LINES}, {NODES}
        SELECT n.* REPLACE (confidence::DOUBLE AS confidence), md5(CASE WHEN kind IN ('subcategory', 'duplicate_cluster', 'type_cluster', 'age_bucket', 'near_duplicate_text') THEN coalesce(summary, '') END) AS summary_md5 FROM n LEFT JOIN note ON n.id = note.node_id""",
    "node_record": f"""{R}{NEAR}, {DUP}, {MEMBERS}, {LINES}, {NODES}, {LINKED},
        hit AS (SELECT node_id, count(*) FILTER (id IN (SELECT id FROM plan_deletes)) AS d, count(*) FILTER (id IN (SELECT id FROM plan_moves)) AS m FROM mem GROUP BY 1),
        seen AS (SELECT source, string_agg(label, chr(10) ORDER BY pos) AS s FROM linked GROUP BY 1)
        SELECT n.id, kind, label, confidence::DOUBLE AS confidence, md5(nullif(CASE WHEN kind NOT IN ('root', 'category', 'file') THEN summary END, '')) AS summary_md5, nullif(rationale, '') AS rationale, nullif(hash, '') AS hash, n_files,
               CASE WHEN n_files IS NOT NULL THEN coalesce(d, 0) END AS in_deletes, CASE WHEN n_files IS NOT NULL THEN coalesce(m, 0) END AS in_moves, md5(coalesce(s, '')) AS files_md5
        FROM n LEFT JOIN note ON n.id = note.node_id LEFT JOIN hit ON n.id = hit.node_id LEFT JOIN seen ON n.id = seen.source""",
    "graph_edges": f"{R}{NEAR}, {DUP}, {MEMBERS}, {EDGES} SELECT id, source, target, kind FROM edges",
    "planned_deletes": f"{R}{NEAR}, {DUP}, {IMAGES} SELECT id, path, reason, confidence::DOUBLE AS confidence FROM ({DELETES})",
    "planned_moves": f"WITH {CAT} {MOVES}",
    "plan_summary": f"{R}{NEAR}, {DUP}, {IMAGES} SELECT (SELECT count(*) FROM cat) AS files_scanned, (SELECT count(DISTINCT cluster_idx) FROM image_lead) AS image_similarity_clusters, (SELECT count(DISTINCT hash) FROM dup) AS duplicate_clusters, (SELECT count(DISTINCT cluster_idx) FROM lead) AS near_duplicate_clusters, (SELECT count(*) FROM ({DELETES})) AS suggested_deletions, (SELECT count(*) FROM cat) AS suggested_moves, {RATE}::DOUBLE AS storage_rate_per_gb",
    "audit_dry_run": f"""WITH {CAT}, here AS (SELECT DISTINCT path FROM cat WHERE path IS NOT NULL),
        e AS (SELECT 1 AS step, 'move' AS op, from_path AS src, '/corpus/' || regexp_replace(to_dir, '^[/\\\\]+|[/\\\\]+$', '', 'g') || '/' || {name('from_path')} AS dst, reason FROM plan_moves
              UNION ALL SELECT 2, 'delete', path, '/corpus/.quarantine/run/' || {name('path')}, reason FROM plan_deletes)
        SELECT step, op, CASE WHEN here.path IS NULL THEN 'skip_not_found' ELSE 'dry_run' END AS status, coalesce(src, '') AS src, CASE WHEN here.path IS NOT NULL THEN dst END AS dst, reason FROM e LEFT JOIN here ON e.src = here.path""",
    "viewer_filter": "SELECT node_seq, id, label FROM graph_nodes WHERE coalesce(reasoning.confidence, 1.0) >= 0.6 AND kind = 'type_cluster' AND contains(lower(label), 'do')",
    "viewer_layout": """WITH r AS (SELECT *, CASE kind WHEN 'root' THEN 0 WHEN 'category' THEN 1 WHEN 'subcategory' THEN 2 WHEN 'type_cluster' THEN 3 WHEN 'duplicate_cluster' THEN 4 WHEN 'near_duplicate_text' THEN 5 WHEN 'age_bucket' THEN 6 ELSE 7 END AS row FROM graph_nodes)
        SELECT node_seq, graph_id, kind, (40 + (row_number() OVER (PARTITION BY graph_id, row ORDER BY node_seq) - 1) * 284)::INT AS x, (40 + row * 160)::INT AS y, CASE WHEN length(label) > 40 THEN left(label, 37) || '…' ELSE label END AS shown FROM r""",
    "viewer_edges": f"{R}{NEAR}, {DUP}, {MEMBERS}, {EDGES}, shown AS (SELECT id FROM (SELECT id FROM cat ORDER BY seq LIMIT 200) UNION SELECT source FROM edges) SELECT id, source, target, kind FROM edges WHERE source IN (SELECT id FROM shown) AND target IN (SELECT id FROM shown)",
    "label_split": f"SELECT node_seq, CASE WHEN contains(label, '→') THEN {strip('split_part(label, chr(8594), 1)')} ELSE coalesce(meta.bucket, 'Category') END AS top, CASE WHEN contains(label, '→') THEN {strip('substr(label, strpos(label, chr(8594)) + 1)')} ELSE label END AS sub FROM graph_nodes",
    "node_hits": "WITH m AS (SELECT node_seq AS node_id, unnest(meta.file_ids) AS id FROM graph_nodes) SELECT node_id, count(*) AS members, count(*) FILTER (id IN (SELECT id FROM plan_moves)) AS in_moves, count(*) FILTER (id IN (SELECT id FROM plan_deletes)) AS in_deletes FROM m GROUP BY node_id",
    "node_inspector": f"{R}{NEAR}, {DUP}, {MEMBERS}, {LINKED} SELECT source, pos::INT AS pos, id, label FROM linked",
    "moves_by_destination": f"""WITH k AS (SELECT *, coalesce(to_dir, '') AS key, count(*) OVER (PARTITION BY coalesce(to_dir, '')) AS n, row_number() OVER (PARTITION BY coalesce(to_dir, '') ORDER BY plan_seq) AS pos, dense_rank() OVER (ORDER BY coalesce(to_dir, '')) - 1 AS group_pos FROM plan_moves)
        SELECT key AS to_dir, group_pos, n, pos::INT AS pos, coalesce({name('from_path')}, '') || '  →  ' || key AS shown, coalesce(reason, '') AS reason FROM k WHERE pos <= 500""",
    "deletes_by_reason": f"""WITH k AS (SELECT *, coalesce(reason, 'unknown') AS key, count(*) OVER (PARTITION BY coalesce(reason, 'unknown')) AS n, row_number() OVER (PARTITION BY coalesce(reason, 'unknown') ORDER BY plan_seq) AS pos, dense_rank() OVER (ORDER BY coalesce(reason, 'unknown')) - 1 AS group_pos FROM plan_deletes)
        SELECT key AS reason, group_pos, n, pos::INT AS pos, coalesce({name('path')}, '') AS shown, printf('%.2f', round_even(coalesce(confidence, 0), 2)) AS confidence FROM k WHERE pos <= 500""",
    "cluster_overview": f"""WITH {CAT}, node AS (SELECT CASE WHEN contains(label, '→') THEN {strip('split_part(label, chr(8594), 1)')} ELSE coalesce(meta.bucket, 'Category') END || ':' || CASE WHEN contains(label, '→') THEN {strip('substr(label, strpos(label, chr(8594)) + 1)')} ELSE label END AS key, meta.file_ids AS ids, node_seq FROM graph_nodes WHERE kind = 'subcategory'),
        last AS (SELECT key, ids FROM node QUALIFY row_number() OVER (PARTITION BY key ORDER BY node_seq DESC) = 1),
        m AS (SELECT DISTINCT key, unnest(CASE WHEN ids IS NULL OR len(ids) = 0 THEN [NULL] ELSE ids END) AS id FROM last),
        c AS (SELECT key, count(id) AS size, count(*) FILTER (id IN (SELECT id FROM plan_deletes)) AS hits FROM m GROUP BY 1),
        cost AS (SELECT reason AS key, round_even(sum(coalesce(size, 0)) / 1073741824.0, 4) AS gb, round_even(sum(coalesce(size, 0)) / 1073741824.0 * {RATE}, 4) AS monthly FROM (SELECT DISTINCT id, reason FROM plan_moves WHERE reason IS NOT NULL) JOIN cat USING (id) GROUP BY 1)
        SELECT key AS cluster_key, size, hits, round(CASE WHEN size = 0 THEN 0.0 ELSE hits / size END, 6) AS ratio, CASE WHEN size > 0 AND hits / size >= 0.5 THEN 'JUNK' WHEN size > 0 AND hits / size >= 0.2 THEN 'REVIEW' ELSE 'NOT JUNK' END AS status, coalesce(gb, 0) AS gb, coalesce(monthly, 0) AS monthly_cost FROM c LEFT JOIN cost USING (key)""",
    "junk_status": """WITH m AS (SELECT result_id AS node_id, unnest(CASE WHEN file_ids IS NULL OR len(file_ids) = 0 THEN [NULL] ELSE file_ids END) AS id FROM cluster_results), d AS (SELECT DISTINCT node_id, id FROM m),
        c AS (SELECT node_id, count(id) AS size, count(*) FILTER (id IN (SELECT id FROM plan_deletes)) AS hits FROM d GROUP BY 1)
        SELECT node_id, size, hits, round(CASE WHEN size = 0 THEN 0.0 ELSE hits / size END, 6) AS ratio, CASE WHEN size > 0 AND hits / size >= 0.5 THEN 'JUNK' WHEN size > 0 AND hits / size >= 0.2 THEN 'REVIEW' ELSE 'NOT JUNK' END AS status FROM c""",
}
