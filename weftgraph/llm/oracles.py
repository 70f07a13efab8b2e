"""SQL of the queries that can be said in SQL, over whole tables. It spells out the definitions and takes no other way
than comparing; NFKC is missing in SQL, which shows only where a text without normalized form holds full-width letters."""

from __future__ import annotations

_TOKENS = "regexp_extract_all(lower({0}), '[a-z0-9]+|[㐀-䶿一-鿿]')"
_SHINGLES = """t AS (SELECT id, {tokens} AS w FROM ({rows}) r), n AS (SELECT id, len(w) AS n, w FROM t),
    g AS (SELECT DISTINCT id, concat_ws(' ', w[i], w[i + 1], w[i + 2]) AS g FROM (SELECT id, w, unnest(range(1, n - 1)) AS i FROM n WHERE n >= {least}) x),
    c AS (SELECT id, count(*) AS c FROM g GROUP BY id), b AS (SELECT x.id AS a, y.id AS b, count(*) AS k FROM g x JOIN g y ON x.g = y.g AND x.id < y.id GROUP BY 1, 2),
    alike AS (SELECT b.a, b.b FROM b JOIN c p ON p.id = b.a JOIN c q ON q.id = b.b WHERE b.k >= 0.6 * (p.c + q.c - b.k))"""


def _alike(rows: str, least: int) -> str:
    return _SHINGLES.replace("{tokens}", _TOKENS.replace("{0}", "text")).replace("{rows}", rows).replace("{least}", str(least))


_DIGEST = "nullif(regexp_extract(lower({0}), '([0-9a-f]{64})', 1), '')"
_content, _normalized = (_DIGEST.replace("{0}", c) for c in ("content_hash", "normalized_hash"))
_LINES = "SELECT DISTINCT segment_id, source_doc_id, site_key, unnest(string_split(raw_text, chr(10))) AS line, generate_subscripts(string_split(raw_text, chr(10)), 1) - 1 AS line_no FROM (SELECT DISTINCT segment_id, source_doc_id, site_key, raw_text FROM segments) s"
_CJK = "[㐀-䶿一-鿿]"

ORACLES: dict[str, str] = {
    "p1_found": f"WITH {_alike('SELECT DISTINCT segment_id AS id, coalesce(normalized_text, raw_text) AS text FROM segments', 40)} SELECT a AS segment_id_a, b AS segment_id_b FROM alike",
    "p2_found": f"""WITH {_alike("SELECT doc_id AS id, text FROM documents WHERE text IS NOT NULL", 3)},
        d AS (SELECT doc_id, ingest_batch, {_content} AS x, {_normalized} AS y FROM documents),
        p AS (SELECT a, b FROM alike UNION SELECT a.doc_id, b.doc_id FROM d a JOIN d b ON a.x = b.x UNION SELECT a.doc_id, b.doc_id FROM d a JOIN d b ON a.y = b.y)
        SELECT 'document' AS new_kind, o.doc_id AS accepted_doc_id, n.doc_id AS new_id FROM p JOIN d o ON o.doc_id = p.a JOIN d n ON n.doc_id = p.b WHERE o.ingest_batch < n.ingest_batch AND o.doc_id < n.doc_id
        UNION SELECT 'task', d.doc_id, t.task_id FROM d JOIN (SELECT DISTINCT task_id, {_content} AS x FROM crawl_tasks WHERE status = 'fetched') t ON t.x = d.x""",
    "p3_found": f"""WITH l AS (SELECT segment_id, source_doc_id, site_key, line_no, regexp_replace(lower(line), '[^\\p{{L}}]', '', 'g') AS k FROM ({_LINES}) x), h AS (SELECT site_key, k FROM l WHERE length(k) >= 20 GROUP BY 1, 2 HAVING count(DISTINCT source_doc_id) >= 6)
        SELECT DISTINCT l.segment_id, cast(l.line_no AS int) AS line_no FROM l JOIN h ON h.site_key = l.site_key AND h.k = l.k""",
    "p5_found": f"SELECT DISTINCT segment_id FROM segments WHERE len(regexp_extract_all(raw_text, '{_CJK}')) + len(list_filter(regexp_split_to_array(regexp_replace(raw_text, '{_CJK}', ' ', 'g'), '\\s+'), lambda w: w <> '')) > 1024",
    "p9_found": """WITH i AS (SELECT item_id, regexp_extract_all(lower(item_text), '[\\p{L}\\p{N}]+') AS w FROM eval_items), d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
        iw AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 12], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS k FROM i) x), dw AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM d) x)
        SELECT DISTINCT doc_id, item_id FROM dw JOIN iw ON iw.g = dw.g""",
    "p10_found": """WITH g AS (SELECT DISTINCT doc_id, hash(substr(text, k, 300)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 298)) AS k FROM documents WHERE length(text) >= 300) x), r AS (SELECT h FROM g GROUP BY h HAVING count(*) > 1), s AS (SELECT g.* FROM g JOIN r ON r.h = g.h)
        SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id""",
}
