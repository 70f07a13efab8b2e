"""The document pipeline's operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph import model
from weftgraph.functions import hashing, scoring, text
from weftgraph.operators import semantic
from weftgraph.pipeline import align, dedup, evolve, extract, index, ingest, segment
from weftgraph.queries.registry import Registry

R = Registry()
add = R.add

CJK = "[㐀-䶿一-鿿]"
TOKENS = "(len(regexp_extract_all({0}, '" + CJK + "')) + len(list_filter(regexp_split_to_array(regexp_replace({0}, '" + CJK + "', ' ', 'g'), '\\s+'), lambda w: w <> '')))"
tokens = lambda c: "cast(" + TOKENS.replace("{0}", c) + " AS int)"
RELATIONS = ("depends_on", "requires", "impacts", "causes", "constrained_by", "uses_protocol", "part_of", "implements", "advertises", "forwards_via")
AS_OF = "2024-06-30"

# ---- ingest
add("ingest_sha256", lambda k: k.document.where("text is not null").select("source_doc_id", hashing.sha256(F.col("text")).alias("digest")), "SELECT source_doc_id, sha256(text) AS digest FROM {v_document} WHERE text IS NOT NULL")
add(
    "dedup_exact_docs",
    lambda k: ingest.exact_duplicates(k.document).select("source_doc_id", "is_duplicate"),
    "SELECT source_doc_id, row_number() OVER (PARTITION BY coalesce(content_hash, concat('#', source_doc_id)) ORDER BY crawl_time ASC NULLS LAST, source_doc_id) > 1 AS is_duplicate FROM {v_document}",
)
add("ingest_dedup_group", lambda k: ingest.dedup_groups(k.document), "SELECT source_doc_id, CASE WHEN normalized_hash IS NULL THEN source_doc_id ELSE min(source_doc_id) OVER (PARTITION BY normalized_hash) END AS dedup_group_id FROM {v_document}")
add("ingest_plaintext", lambda k: k.page.select("page_id", ingest.is_plaintext(F.col("html"), F.col("url")).alias("plain")), "SELECT page_id, ends_with(url, '.txt') OR NOT regexp_matches(substr(html, 1, 500), '<\\w+[\\s>]') AS plain FROM {v_page}")
add("ingest_preprocess_html", lambda k: k.page.select("page_id", F.md5(ingest.preprocess_html(F.col("html")).cast("binary")).alias("digest")), "SELECT page_id, md5(regexp_replace(regexp_replace(html, '<style[^>]*>[\\s\\S]*?</style>', '', 'gi'), '<script[^>]*>[\\s\\S]*?</script>', '', 'gi')) AS digest FROM {v_page}")
_TEXT = "html"
for _pattern, _new in (("<h1[^>]*>\\s*(.*?)\\s*</h1>", "' || chr(10) || '# \\1' || chr(10) || '"), ("</?(p|div|li|tr|blockquote)(\\s[^>]*)?>", "' || chr(10) || '"), ("<br\\s*/?>", "' || chr(10) || '"), ("<[^>]+>", ""), ("[ \\t]+", " "), ("\\n{3,}", "' || chr(10) || chr(10) || '"), ("^\\s+|\\s+$", "")):
    _TEXT = f"regexp_replace({_TEXT}, '{_pattern}', '{_new}', 'gis')"
add("ingest_html_to_text", lambda k: k.page.select("page_id", F.md5(ingest.html_to_text(ingest.preprocess_html(F.col("html"))).cast("binary")).alias("digest")), "SELECT page_id, md5(" + _TEXT.replace("(html,", "(regexp_replace(regexp_replace(html, '<style[^>]*>[\\s\\S]*?</style>', '', 'gi'), '<script[^>]*>[\\s\\S]*?</script>', '', 'gi'),", 1) + ") AS digest FROM {v_page}")
add("ingest_title_html", lambda k: k.page.select("page_id", ingest.html_title(F.col("html")).alias("title")), "SELECT page_id, trim(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is')) AS title FROM {v_page}")
add(
    "ingest_title_text",
    lambda k: k.document.where("text is not null").select("source_doc_id", ingest.text_title(F.col("text")).alias("title")),
    "WITH l AS (SELECT source_doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\\s*#*\\s*|\\s+$', '', 'g')), lambda x: length(x) > 3 AND length(x) <= 150 AND NOT regexp_matches(x, '\\S.*\\s{4,}.*\\S')) AS c FROM {v_document} WHERE text IS NOT NULL) SELECT source_doc_id, coalesce(c[1], '') AS title FROM l",
)
add("ingest_language", lambda k: k.document.where("text is not null").select("source_doc_id", ingest.language(F.col("text")).alias("language")), "SELECT source_doc_id, CASE WHEN len(regexp_extract_all(substr(text, 1, 500), '[一-鿿]')) > 20 THEN 'zh' ELSE 'en' END AS language FROM {v_document} WHERE text IS NOT NULL")
_SIGNALS = """WITH t AS (SELECT source_doc_id, coalesce(text, '') AS t FROM {v_document}), l AS (SELECT *, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS ls FROM t),
    s AS (SELECT source_doc_id, """ + tokens("t") + """ AS token_count, CASE WHEN t = '' THEN 0 ELSE greatest(len(ls), 1) END AS line_count, length(t) AS char_count,
      CASE WHEN t = '' THEN 0.0 ELSE round(len(regexp_extract_all(t, '[.!?。！？]+(?:\\s|["'')\\]]|\\z)')) / (length(t) / 1000), 2) END AS sentence_density,
      CASE WHEN t = '' THEN 0.0 ELSE round(len(list_filter(ls, lambda x: length(x) - length(replace(x, '|', '')) >= 2 OR regexp_matches(x, '^\\s*[-*•◦·▪▫]\\s') OR regexp_matches(x, '\\.\\s*\\.\\s*\\.'))) / greatest(len(ls), 1), 2) END AS listy_ratio FROM l)"""
add("quality_signals", lambda k: ingest.quality_report(k.document).select("source_doc_id", "token_count", "line_count", "char_count", "sentence_density", "listy_ratio"), _SIGNALS + " SELECT source_doc_id, token_count, cast(line_count AS int) AS line_count, cast(char_count AS int) AS char_count, sentence_density, listy_ratio FROM s")
add("quality_gate", lambda k: ingest.quality_report(k.document).select("source_doc_id", "reason"), _SIGNALS + " SELECT source_doc_id, CASE WHEN token_count < 200 THEN 'too_short' WHEN sentence_density < 1 THEN 'no_sentences' WHEN sentence_density < 2 AND listy_ratio > 0.4 THEN 'listy_dump' END AS reason FROM s")
_U, _T = "lower(coalesce(source_url, ''))", "lower(coalesce(title, ''))"
add(
    "ingest_doc_type",
    lambda k: k.document.select("source_doc_id", ingest.document_type(F.col("source_url"), F.col("title"), F.coalesce("text", F.lit(""))).alias("doc_type")),
    f"""SELECT source_doc_id, CASE WHEN regexp_matches({_U}, '/rfc/|/rfcs/') OR regexp_matches({_T}, '\\brfc\\s*\\d+') THEN 'spec'
        WHEN regexp_matches({_U}, '/config-guide/|/configuration/|/cli-reference/') OR regexp_matches({_T}, 'configuration guide|command reference|cli guide') OR contains({_U}, '/troubleshoot') OR contains({_T}, 'troubleshoot') THEN 'vendor_doc'
        WHEN ends_with({_U}, '.pdf') THEN 'pdf'
        WHEN len(list_filter(regexp_split_to_array(t, '\\s+'), lambda w: w <> '')) > 0 AND len(regexp_extract_all(substr(t, 1, 3000), '\\bQ\\s*[:：]|\\bA\\s*[:：]|frequently asked|常见问题', 0, 'i')) / greatest(len(list_filter(regexp_split_to_array(t, '\\s+'), lambda w: w <> '')) / 100, 1.0) > 0.3 THEN 'faq'
        WHEN len(regexp_extract_all(t, '```[\\s\\S]*?```|^\\s{{4,}}\\S', 0, 'm')) > 3 THEN 'tutorial' ELSE 'tech_article' END AS doc_type FROM (SELECT *, coalesce(text, '') AS t FROM {{v_document}}) x""".replace("{{4,}}", "{4,}"),
)
_B = "text"
for _p in ("(cookie|privacy) (policy|notice|consent).*?(\\n|$)", "(accept|agree) (cookies|terms).*?(\\n|$)", "(share|like|tweet|follow us).*?(\\n|$)", "©\\s*\\d{4}.*?all rights reserved.*?(\\n|$)", "\\b(navigation|breadcrumb|skip to content)\\b.*?(\\n|$)"):
    _B = f"regexp_replace({_B}, '{_p}', ' ', 'gis')"
add("ingest_boilerplate", lambda k: k.document.where("text is not null").select("source_doc_id", F.md5(ingest.strip_boilerplate(F.col("text")).cast("binary")).alias("digest")), f"SELECT source_doc_id, md5({_B}) AS digest FROM {{v_document}} WHERE text IS NOT NULL")
_TRIPLED = "SELECT source_doc_id, concat(text, chr(10), substr(text, 1, 400), chr(10), substr(text, 1, 400)) AS text FROM {v_document} WHERE text IS NOT NULL"
add(
    "ingest_repeated_lines",
    lambda k: k.sql(_TRIPLED).select("source_doc_id", F.md5(ingest.remove_repeated_lines(F.col("text")).cast("binary")).alias("digest")),
    f"""WITH l AS (SELECT source_doc_id, string_split(text, chr(10)) AS ls FROM ({_TRIPLED}) x), c AS (SELECT source_doc_id, ls, list_filter(list_transform(ls, lambda y: trim(y, ' ')), lambda y: length(y) >= 40) AS t FROM l)
        SELECT source_doc_id, md5(array_to_string(list_filter(ls, lambda y: len(list_filter(t, lambda z: z = trim(y, ' '))) < 3), chr(10))) AS digest FROM c""",
)
add("ingest_links", lambda k: ingest.links(k.page.where("url like 'https://%'")), "SELECT DISTINCT page_id, concat('https://', regexp_extract(url, '^https?://([^/]+)', 1), h) AS link FROM (SELECT page_id, url, unnest(regexp_extract_all(html, 'href=[\"'']([^\"''#]+)', 1)) AS h FROM {v_page}) x WHERE url LIKE 'https://%' AND starts_with(h, '/') AND NOT ends_with(h, '.png')")
_URLS = "SELECT doc_id, concat('https://datatracker.ietf.org/doc/html/rfc', cast(doc_id AS string), CASE WHEN doc_id % 2 = 0 THEN '#section-2' ELSE '' END) AS url FROM {documents}"
add("ingest_normalize_url", lambda k: k.sql(_URLS).select("doc_id", ingest.normalize_url(F.col("url")).alias("url")), "SELECT doc_id, concat('https://www.rfc-editor.org/rfc/rfc', doc_id) AS url FROM {documents}")
add("ingest_task_queue", lambda k: ingest.task_queue(k.task, 100).select("task_id", "priority"), "SELECT task_id, priority FROM {v_task} WHERE status = 'pending' ORDER BY priority DESC NULLS LAST, task_id LIMIT 100")
add("ingest_retry", lambda k: k.task.where("status = 'failed'").select("task_id", ingest.retry_after(F.coalesce("retry_count", F.lit(0))).alias("minutes")), "SELECT task_id, CASE WHEN coalesce(retry_count, 0) <= 0 THEN 5 WHEN retry_count = 1 THEN 30 ELSE 120 END AS minutes FROM {v_task} WHERE status = 'failed'")
# ---- text
add("token_count", lambda k: k.segment.select("segment_id", text.token_count(F.col("raw_text")).alias("n")), f"SELECT segment_id, CASE WHEN raw_text IS NULL THEN 0 ELSE {tokens('raw_text')} END AS n FROM {{v_segment}}")
add("text_normalize", lambda k: k.segment.select("segment_id", text.normalize(F.col("raw_text")).alias("t")))
add(
    "text_truncate",
    lambda k: k.segment.select("segment_id", text.truncate(F.col("raw_text"), 40).alias("t")),
    f"""WITH s AS (SELECT segment_id, raw_text, {tokens("raw_text")} AS n, list_filter(regexp_split_to_array(raw_text, '\\s+'), lambda x: x <> '') AS w FROM {{v_segment}}), u AS (SELECT segment_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM s WHERE n > 40),
        c AS (SELECT *, sum(greatest(1, len(regexp_extract_all(x, '{CJK}')))) OVER (PARTITION BY segment_id ORDER BY i) AS c FROM u), j AS (SELECT segment_id, string_agg(x, ' ' ORDER BY i) AS t FROM c WHERE c <= 40 GROUP BY 1)
        SELECT s.segment_id, CASE WHEN s.n <= 40 THEN s.raw_text ELSE coalesce(j.t, '') END AS t FROM s LEFT JOIN j ON j.segment_id = s.segment_id""",
)
add(
    "text_sliding_window",
    lambda k: k.segment.select("segment_id", F.posexplode(text.sliding_windows(F.col("raw_text"), 50, 10)).alias("i", "t")),
    """WITH w AS (SELECT segment_id, raw_text, list_filter(regexp_split_to_array(raw_text, '\\s+'), lambda x: x <> '') AS w FROM {v_segment}), n AS (SELECT *, len(w) AS n FROM w), i AS (SELECT segment_id, raw_text, w, n, unnest(range(0, greatest(0, cast(ceil((n - 50) / 40) AS bigint)) + 1)) AS i FROM n)
       SELECT segment_id, cast(i AS int) AS i, CASE WHEN n <= 50 THEN raw_text ELSE array_to_string(w[i * 40 + 1:i * 40 + 50], ' ') END AS t FROM i""",
)
add("term_normalize", lambda k: k.candidate.where("normalized_form is not null").select("candidate_id", text.normalize_term(F.col("normalized_form")).alias("term")))
add("term_abbreviation", lambda k: k.candidate.select("candidate_id", text.abbreviation(F.col("normalized_form")).alias("a")).where("a is not null"), "SELECT candidate_id, regexp_extract(normalized_form, '\\(([A-Za-z][A-Za-z0-9\\-]{0,10})\\)\\s*$', 1) AS a FROM {v_candidate} WHERE regexp_extract(normalized_form, '\\(([A-Za-z][A-Za-z0-9\\-]{0,10})\\)\\s*$', 1) <> ''")
# ---- segment
add("segment_structural", lambda k: segment.segment_documents(k.document).select("source_doc_id", "segment_index", F.array_join("section_path", ">").alias("path"), "section_title", "segment_type", F.length("raw_text").alias("n")))
add(
    "segment_merge_same_type",
    lambda k: segment.segment_documents(k.document, lambda texts: ["fault" if len(t) % 3 else "procedure" for t in texts]).select("source_doc_id", "segment_index", "segment_type", F.length("raw_text").alias("n")),
)
add(
    "segment_paragraphs",
    lambda k: segment.paragraph_rows(k.document).where(text.token_count(F.col("paragraph")) >= 15),
    f"WITH p AS (SELECT source_doc_id, unnest(regexp_split_to_array(text, '\\n\\s*\\n')) AS p, generate_subscripts(regexp_split_to_array(text, '\\n\\s*\\n'), 1) - 1 AS i FROM {{v_document}}), s AS (SELECT source_doc_id, cast(i AS int) AS position, regexp_replace(p, '^\\s+|\\s+$', '', 'g') AS paragraph FROM p) SELECT source_doc_id, position, paragraph FROM s WHERE paragraph <> '' AND {tokens('paragraph')} >= 15",
)
add(
    "segment_confidence",
    lambda k: k.segment.select("segment_id", segment.confidence(F.col("raw_text"), text.token_count(F.col("raw_text")), F.col("segment_type")).alias("c")),
    f"""SELECT segment_id, round(least(1.0, cast(0.7 AS double) + CASE WHEN n BETWEEN 50 AND 512 THEN cast(0.1 AS double) WHEN n > 512 THEN 0.05 ELSE 0.0 END + CASE WHEN segment_type <> 'unknown' THEN cast(0.1 AS double) ELSE 0.0 END + CASE WHEN u > 0.02 AND u < 0.3 THEN cast(0.05 AS double) ELSE 0.0 END), 2) AS c
        FROM (SELECT segment_id, segment_type, {tokens('raw_text')} AS n, len(regexp_extract_all(raw_text, '\\p{{Lu}}')) / greatest(length(raw_text), 1) AS u FROM {{v_segment}}) x""".replace("{{Lu}}", "{Lu}"),
)
add("segment_title", lambda k: k.segment.select("segment_id", segment.title(F.col("section_title"), F.col("raw_text")).alias("title")), "WITH s AS (SELECT segment_id, section_title, raw_text, trim(split_part(trim(raw_text, ' '), '.', 1), ' ') AS f FROM {v_segment}) SELECT segment_id, substr(CASE WHEN coalesce(section_title, '') <> '' THEN section_title WHEN length(f) > 10 THEN f WHEN f <> '' THEN f ELSE substr(raw_text, 1, 80) END, 1, 255) AS title FROM s")
add("segment_rst_pairs", lambda k: segment.adjacent_pairs(k.segment), "SELECT src_edu_id, dst_edu_id, 'Elaboration' AS relation_type, 'NN' AS nuclearity FROM {v_rst}")
# ---- align
_DICT = "SELECT folded AS form, canonical_node_id AS node_id, max(CASE WHEN alias_type = 'full_name' THEN 1.0 ELSE 0.9 END) AS confidence FROM {v_alias} WHERE length(folded) > 3 GROUP BY 1, 2"
add(
    "align_find_terms",
    lambda k: align.find_terms(k.segment.select("segment_id", F.col("raw_text").alias("text")), k.sql(_DICT)),
    f"SELECT s.segment_id, d.node_id, max(d.confidence) AS confidence FROM {{v_segment}} s JOIN ({_DICT}) d ON contains(lower(s.raw_text), d.form) GROUP BY 1, 2".replace("1.0 ELSE 0.9", "cast(1.0 AS double) ELSE cast(0.9 AS double)"),
)
add("align_best_per_node", lambda k: align.best_per_node(k.segment_tag.withColumnRenamed("ontology_node_id", "node_id")), "SELECT segment_id, ontology_node_id AS node_id, max(confidence) AS confidence FROM {v_segment_tag} GROUP BY 1, 2")
_NODEVEC = "SELECT ontology_node_id AS node_id, content_vec AS vec FROM (SELECT g.ontology_node_id, v.content_vec, row_number() OVER (PARTITION BY g.ontology_node_id ORDER BY v.segment_id) AS n FROM {v_segment_tag} g JOIN {v_segment_vec} v ON v.segment_id = g.segment_id WHERE v.content_vec IS NOT NULL) x WHERE n = 1"
# segments without a canonical tag, against the layers below concepts as the pipeline does
_LAYERED = f"SELECT v.node_id, v.vec, n.layer FROM ({_NODEVEC}) v JOIN {{v_node}} n ON n.node_id = v.node_id"
_BELOW = ("mechanism", "method", "condition", "scenario")
_ENTRIES = "list_sum(list_transform({0}, lambda x: abs(x))) > 0"
_TOP15 = f"""WITH n AS ({_LAYERED}), s AS (SELECT v.segment_id, n.node_id, n.layer, list_cosine_similarity(v.content_vec::DOUBLE[], n.vec::DOUBLE[]) AS s FROM {{v_segment_vec}} v, n WHERE v.content_vec IS NOT NULL AND {_ENTRIES.replace("{0}", "v.content_vec")} AND {_ENTRIES.replace("{0}", "n.vec")}),
        r AS (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY s DESC, node_id) AS k FROM s)"""
add(
    "align_embedding_match",
    lambda k: align.embedding_match(k.segment_vec.select("segment_id", F.col("content_vec").alias("vec")), k.sql(_LAYERED), layers=_BELOW).select("segment_id", "node_id", "confidence"),
    _TOP15 + f", m AS (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY k) AS m FROM r WHERE k <= 15 AND s >= 0.6 AND layer IN {_BELOW}) SELECT segment_id, node_id, least(0.8, round(cast(0.55 AS double) + (s - 0.6) * 1.8, 2)) AS confidence FROM m WHERE m <= 5",
)
_MATCHES = "SELECT tag_id, segment_id, ontology_node_id AS node_id, CASE WHEN tag_id % 2 = 0 THEN 'kisg' ELSE 'session guard' END AS form FROM {v_segment_tag}"
add(
    "align_verify_short",
    lambda k: align.verify_short(k.sql(_MATCHES), k.segment_vec.select("segment_id", F.col("content_vec").alias("vec")), k.sql(_NODEVEC)).select("tag_id", "form"),
    f"""WITH m AS ({_MATCHES}), n AS ({_NODEVEC}), j AS (SELECT m.tag_id, m.form, CASE WHEN s.content_vec IS NULL OR n.vec IS NULL OR list_sum(list_transform(s.content_vec, lambda x: abs(x))) = 0 OR list_sum(list_transform(n.vec, lambda x: abs(x))) = 0 THEN NULL ELSE list_cosine_similarity(s.content_vec::DOUBLE[], n.vec::DOUBLE[]) END AS c
        FROM m LEFT JOIN {{v_segment_vec}} s ON s.segment_id = m.segment_id LEFT JOIN n ON n.node_id = m.node_id) SELECT tag_id, form FROM j WHERE length(form) > 5 OR c IS NULL OR c >= 0.3""",
)
add("align_layer_tag", lambda k: k.segment_tag.join(k.node.select(F.col("node_id").alias("ontology_node_id"), "layer"), "ontology_node_id").select("tag_id", F.create_map(*[F.lit(x) for kv in align.LAYER_TAG.items() for x in kv])[F.col("layer")].alias("layer_tag")), "SELECT g.tag_id, CASE n.layer WHEN 'concept' THEN 'canonical' WHEN 'mechanism' THEN 'mechanism_tag' WHEN 'method' THEN 'method_tag' WHEN 'condition' THEN 'condition_tag' ELSE 'scenario_tag' END AS layer_tag FROM {v_segment_tag} g JOIN {v_node} n ON n.node_id = g.ontology_node_id")
add("align_role_tag", lambda k: k.segment.select("segment_id", align.role_tag(F.col("segment_type")).alias("role")).where("role is not null"), "SELECT segment_id, CASE segment_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in align.ROLES.items()) + " END AS role FROM {v_segment} WHERE segment_type IN (" + ", ".join(f"'{a}'" for a in align.ROLES) + ")")
add("align_context_tags", lambda k: k.segment.select("segment_id", F.array_join(align.context_tags(F.col("raw_text")), ",").alias("tags")), "SELECT segment_id, concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(lower(substr(raw_text, 1, 1000)), '{p}') THEN '{label}' END" for label, p in align.CONTEXTS.items()) + ") AS tags FROM {v_segment}")
add("align_pending", lambda k: align.pending(k.segment, k.segment_tag).select("segment_id"), "SELECT segment_id FROM {v_segment} WHERE segment_id NOT IN (SELECT segment_id FROM {v_segment_tag} WHERE tag_type = 'canonical')")
_WEIGHT = "CASE relation_type " + " ".join(f"WHEN '{t}' THEN cast({w} AS double)" for t, w in model.RST_PROPAGATION.items()) + " ELSE cast(0.4 AS double) END"
_CANON = "(SELECT DISTINCT segment_id, ontology_node_id, confidence FROM {v_segment_tag} WHERE tag_type = 'canonical' AND confidence IS NOT NULL)"
add(
    "align_rst_propagate",
    lambda k: align.propagate(align.pending(k.segment, k.segment_tag).select("segment_id"), k.segment_tag.where("tag_type = 'canonical' and confidence is not null").select("segment_id", "ontology_node_id", "confidence").distinct(), k.rst),
    f"""WITH w AS (SELECT segment_id FROM {{v_segment}} WHERE segment_id NOT IN (SELECT segment_id FROM {{v_segment_tag}} WHERE tag_type = 'canonical')), e AS (SELECT src_edu_id AS s, dst_edu_id AS o, relation_type, nuclearity = 'SN' AS nuc FROM {{v_rst}} UNION ALL SELECT dst_edu_id, src_edu_id, relation_type, nuclearity = 'NS' FROM {{v_rst}}),
        n AS (SELECT s, o, round(least(1.0, {_WEIGHT} + CASE WHEN nuc THEN cast(0.05 AS double) ELSE 0 END), 4) AS weight FROM e WHERE s IN (SELECT segment_id FROM w) AND o NOT IN (SELECT segment_id FROM w))
        SELECT n.s AS segment_id, t.ontology_node_id, max(round(t.confidence * n.weight + 1e-9, 3)) AS confidence FROM n JOIN {_CANON} t ON t.segment_id = n.o WHERE n.weight >= 0.5 AND round(t.confidence * n.weight + 1e-9, 3) >= 0.5 GROUP BY 1, 2""",
)
# the pool as it was at a time, and what was first seen after it
_POOL = "SELECT normalized_form, surface_forms, seen_source_doc_ids AS doc_ids, first_seen_at, last_seen_at FROM {v_candidate} WHERE coalesce(first_seen_at, timestamp '2024-01-01 00:00:00') "
_OLD, _NEW = _POOL + "< timestamp '2024-03-01 00:00:00'", _POOL + ">= timestamp '2024-03-01 00:00:00'"
add(
    "align_candidates",
    lambda k: align.pool_candidates(k.sql(_OLD), k.sql(_NEW)).select("normalized_form", F.array_join("surface_forms", "|").alias("forms"), "source_count", "first_seen_at", "last_seen_at"),
    """WITH r AS (SELECT normalized_form, surface_forms, seen_source_doc_ids AS d, first_seen_at, last_seen_at FROM {v_candidate} WHERE trim(normalized_form, ' ') <> '')
       SELECT normalized_form, array_to_string(list_sort(list_distinct(flatten(list(coalesce(surface_forms, []))))), '|') AS forms, cast(len(list_distinct(flatten(list(coalesce(d, []))))) AS int) AS source_count, min(first_seen_at) AS first_seen_at, max(last_seen_at) AS last_seen_at FROM r GROUP BY normalized_form""",
)
# a classifier's answers stand in for a model: relations are noise, those with a parent variants
_TERMED = "SELECT candidate_id AS doc_id, candidate_id AS segment_id, normalized_form AS term, CASE WHEN candidate_type = 'relation' THEN 'noise' WHEN candidate_parent_id IS NOT NULL THEN 'variant' ELSE 'new_concept' END AS classification, cast(NULL AS string) AS layer FROM {v_candidate}"
_STOP = "SELECT lower(name) AS word FROM (SELECT DISTINCT canonical_name AS name FROM {ontology_nodes}) x"
add(
    "align_new_concepts",
    lambda k: align.new_concepts(k.sql(_TERMED), k.alias, k.sql(_STOP)).select("term", "layer", "doc_id"),
    f"SELECT trim(term, ' ') AS term, 'concept' AS layer, doc_id FROM ({_TERMED}) x WHERE classification = 'new_concept' AND trim(term, ' ') <> '' AND lower(trim(term, ' ')) NOT IN (SELECT folded FROM {{v_alias}}) AND lower(trim(term, ' ')) NOT IN ({_STOP})",
)
# ---- evolve
add("evolve_source_diversity", lambda k: evolve.source_scores(k.candidate, k.document).distinct(), "WITH c AS (SELECT candidate_id, unnest(seen_source_doc_ids) AS d FROM {v_candidate}), r AS (SELECT c.candidate_id, least(1.0, count(DISTINCT x.site_key) / 3) AS v, max(CASE x.source_rank WHEN 'S' THEN cast(1.0 AS double) WHEN 'A' THEN 0.8 WHEN 'B' THEN 0.6 ELSE 0.4 END) AS a FROM c JOIN {v_document} x ON x.source_doc_id = c.d GROUP BY 1) SELECT DISTINCT k.candidate_id, round(coalesce(r.v, 0), 4) AS source_diversity, coalesce(r.a, 0.4) AS authority FROM {v_candidate} k LEFT JOIN r ON r.candidate_id = k.candidate_id")
add("evolve_temporal_stability", lambda k: k.candidate.select("candidate_id", evolve.temporal_stability(F.col("first_seen_at"), F.lit(AS_OF).cast("date")).alias("s")), f"SELECT candidate_id, round(greatest(0.0, least(1.0, coalesce(date_diff('day', cast(first_seen_at AS date), date '{AS_OF}'), 0) / 14)), 4) AS s FROM {{v_candidate}}")
_NAMES = "SELECT node_id, canonical_name AS name FROM {ontology_nodes}"
add(
    "evolve_structural_fit",
    lambda k: evolve.structural_fit(k.candidate.where("surface_forms is not null").dropDuplicates(["candidate_id"]), k.sql(_NAMES)),
    """WITH c AS (SELECT DISTINCT candidate_id, unnest(regexp_split_to_array(lower(f), '\\s+')) AS token FROM (SELECT candidate_id, unnest(surface_forms) AS f FROM {v_candidate}) x), cc AS (SELECT * FROM c WHERE token <> ''), cn AS (SELECT candidate_id, count(*) AS n FROM cc GROUP BY 1),
       p AS (SELECT DISTINCT node_id, unnest(regexp_split_to_array(lower(canonical_name), '\\s+')) AS token FROM {ontology_nodes}), pn AS (SELECT node_id, count(*) AS m FROM p GROUP BY 1), b AS (SELECT cc.candidate_id, p.node_id, count(*) AS c FROM cc JOIN p ON p.token = cc.token GROUP BY 1, 2),
       s AS (SELECT b.candidate_id, b.node_id, round(c / (n + m - c), 4) AS score FROM b JOIN cn ON cn.candidate_id = b.candidate_id JOIN pn ON pn.node_id = b.node_id), r AS (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY score DESC, node_id) AS n FROM s)
       SELECT DISTINCT k.candidate_id, coalesce(r.score, 0.0) AS structural_fit, r.node_id AS parent_id FROM {v_candidate} k LEFT JOIN r ON r.candidate_id = k.candidate_id AND r.n = 1 WHERE k.surface_forms IS NOT NULL""",
)
add(
    "evolve_synonym_risk",
    lambda k: evolve.synonym_risk(k.candidate.where("surface_forms is not null"), k.alias),
    """WITH f AS (SELECT DISTINCT candidate_id, lower(form) AS form FROM (SELECT candidate_id, unnest(surface_forms) AS form FROM {v_candidate}) x WHERE form <> ''), a AS (SELECT DISTINCT folded AS alias FROM {v_alias} WHERE folded <> ''),
       m AS (SELECT f.candidate_id, round(max(least(length(f.form), length(a.alias)) / greatest(length(f.form), length(a.alias))), 4) AS r FROM f JOIN a ON contains(f.form, a.alias) OR contains(a.alias, f.form) GROUP BY 1)
       SELECT DISTINCT k.candidate_id, coalesce(m.r, 0.0) AS synonym_risk FROM {v_candidate} k LEFT JOIN m ON m.candidate_id = k.candidate_id WHERE k.surface_forms IS NOT NULL""",
)
_IN = lambda: [F.lit(0.8), F.lit(0.6666), F.lit(0.5), F.col("composite_score"), F.lit(0.3)]
add("evolve_composite", lambda k: k.candidate.where("composite_score is not null").select("candidate_id", evolve.composite(*_IN()).alias("c")), "SELECT candidate_id, round(greatest(0.0, least(1.0, cast(0.25 AS double) * 0.8 + cast(0.2 AS double) * 0.6666 + cast(0.2 AS double) * 0.5 + cast(0.2 AS double) * composite_score + cast(0.1 AS double) * 0.5 - cast(0.05 AS double) * 0.3)) + 1e-9, 4) AS c FROM {v_candidate} WHERE composite_score IS NOT NULL")
_ONE = "SELECT DISTINCT candidate_id, surface_forms, source_count, first_seen_at, review_status, seen_source_doc_ids FROM {v_candidate} WHERE surface_forms IS NOT NULL"
_GATED = f"""WITH k AS ({_ONE}), sc AS (SELECT c.candidate_id, round(least(1.0, count(DISTINCT x.site_key) / 3), 4) AS d, max(CASE x.source_rank WHEN 'S' THEN cast(1.0 AS double) WHEN 'A' THEN 0.8 WHEN 'B' THEN 0.6 ELSE 0.4 END) AS a FROM (SELECT candidate_id, unnest(seen_source_doc_ids) AS doc FROM k) c JOIN {{v_document}} x ON x.source_doc_id = c.doc GROUP BY 1),
    w AS (SELECT DISTINCT candidate_id, unnest(regexp_split_to_array(lower(f), '\\s+')) AS token FROM (SELECT candidate_id, unnest(surface_forms) AS f FROM k) x), ww AS (SELECT * FROM w WHERE token <> ''), wn AS (SELECT candidate_id, count(*) AS n FROM ww GROUP BY 1),
    p AS (SELECT DISTINCT node_id, unnest(regexp_split_to_array(lower(canonical_name), '\\s+')) AS token FROM {{ontology_nodes}}), pn AS (SELECT node_id, count(*) AS m FROM p GROUP BY 1), b AS (SELECT ww.candidate_id, p.node_id, count(*) AS c FROM ww JOIN p ON p.token = ww.token GROUP BY 1, 2),
    fit AS (SELECT * FROM (SELECT b.candidate_id, b.node_id, round(c / (n + m - c), 4) AS score, row_number() OVER (PARTITION BY b.candidate_id ORDER BY round(c / (n + m - c), 4) DESC, b.node_id) AS r FROM b JOIN wn ON wn.candidate_id = b.candidate_id JOIN pn ON pn.node_id = b.node_id) x WHERE r = 1),
    f AS (SELECT DISTINCT candidate_id, lower(form) AS form FROM (SELECT candidate_id, unnest(surface_forms) AS form FROM k) x WHERE form <> ''), al AS (SELECT DISTINCT folded AS alias FROM {{v_alias}} WHERE folded <> ''),
    risk AS (SELECT f.candidate_id, round(max(least(length(f.form), length(al.alias)) / greatest(length(f.form), length(al.alias))), 4) AS r FROM f JOIN al ON contains(f.form, al.alias) OR contains(al.alias, f.form) GROUP BY 1),
    j AS (SELECT k.candidate_id, k.source_count, k.review_status, coalesce(sc.d, 0.0) AS d, coalesce(sc.a, 0.4) AS a, round(greatest(0.0, least(1.0, coalesce(date_diff('day', cast(k.first_seen_at AS date), date '{AS_OF}'), 0) / 14)), 4) AS t, coalesce(date_diff('day', cast(k.first_seen_at AS date), date '{AS_OF}'), 0) AS days, coalesce(fit.score, 0.0) AS fit, fit.node_id AS parent_id, coalesce(risk.r, 0.0) AS syn
        FROM k LEFT JOIN sc ON sc.candidate_id = k.candidate_id LEFT JOIN fit ON fit.candidate_id = k.candidate_id LEFT JOIN risk ON risk.candidate_id = k.candidate_id),
    c AS (SELECT *, round(greatest(0.0, least(1.0, cast(0.25 AS double) * a + cast(0.2 AS double) * d + cast(0.2 AS double) * t + cast(0.2 AS double) * fit + cast(0.1 AS double) * 0.5 - cast(0.05 AS double) * syn)) + 1e-9, 4) AS composite FROM j),
    g AS (SELECT *, concat_ws(',', CASE WHEN coalesce(source_count, 0) < 3 THEN 'source_count' END, CASE WHEN d < 0.6 THEN 'source_diversity' END, CASE WHEN t < 0.7 THEN 'temporal_stability' END, CASE WHEN fit < 0.65 THEN 'structural_fit' END, CASE WHEN composite < 0.65 THEN 'composite' END, CASE WHEN syn > 0.4 THEN 'synonym_risk' END) AS reasons FROM c)
    SELECT candidate_id, composite, reasons, CASE WHEN reasons <> '' OR days < 7 THEN review_status WHEN composite >= 0.85 AND parent_id IS NOT NULL THEN 'auto_accepted' ELSE 'pending_review' END AS decision FROM g"""
add("evolve_gate_promote", lambda k: evolve.scored(k.candidate.where("surface_forms is not null"), k.document, k.sql(_NAMES), k.alias, F.lit(AS_OF).cast("date")).select("candidate_id", "composite", "reasons", "decision"), _GATED)
# ---- extract
add(
    "extract_rst_derived",
    lambda k: extract.rst_facts(k.rst, k.segment_tag, RELATIONS),
    """WITH b AS (SELECT segment_id, ontology_node_id, max(confidence) AS c FROM {v_segment_tag} GROUP BY 1, 2), t AS (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY c DESC NULLS LAST, ontology_node_id) AS n FROM b), k AS (SELECT segment_id, ontology_node_id FROM t WHERE n <= 3),
       e AS (SELECT CASE WHEN nuclearity = 'SN' THEN dst_edu_id ELSE src_edu_id END AS s, CASE WHEN nuclearity = 'SN' THEN src_edu_id ELSE dst_edu_id END AS o, CASE relation_type WHEN 'Constraint' THEN 'constrained_by' ELSE 'requires' END AS predicate FROM {v_rst} WHERE relation_type IN ('Constraint', 'Prerequisite'))
       SELECT DISTINCT x.ontology_node_id AS subject, e.predicate, y.ontology_node_id AS object, e.s AS segment_id FROM e JOIN k x ON x.segment_id = e.s JOIN k y ON y.segment_id = e.o WHERE x.ontology_node_id <> y.ontology_node_id""",
)
add(
    "extract_chains",
    lambda k: extract.segment_chains(k.segment, k.rst).select("head", F.array_join("chain", ">").alias("chain"), "tokens"),
    """WITH RECURSIVE z AS (SELECT segment_id AS id, cast(floor(length(coalesce(raw_text, '')) / 4) AS int) AS t FROM {v_segment}), n AS (SELECT src_edu_id AS a, min(dst_edu_id) AS b FROM {v_rst} WHERE relation_type IN ('Elaboration', 'Sequence', 'Causation', 'Background', 'Exemplification') GROUP BY 1),
       c AS (SELECT id AS head, id AS pos, cast(id AS string) AS chain, t AS tokens, 1 AS len FROM z UNION ALL SELECT c.head, n.b, concat(c.chain, '>', n.b), c.tokens + z.t, c.len + 1 FROM c JOIN n ON n.a = c.pos JOIN z ON z.id = n.b WHERE c.len < 4 AND c.tokens + z.t <= 1500)
       SELECT head, chain, tokens FROM (SELECT *, row_number() OVER (PARTITION BY head ORDER BY len DESC) AS r FROM c) x WHERE r = 1 AND len >= 3""",
)
add(
    "quote_grounding",
    lambda k: k.segment.where("raw_text is not null").select("segment_id", extract.quote_supported(F.substring(F.concat(F.lit("  "), F.upper("raw_text")), 1, 60), F.col("raw_text")).alias("exact"), extract.quote_supported(F.lit("the policy of a cookie and the timer"), F.col("raw_text")).alias("fuzzy")),
    """WITH s AS (SELECT segment_id, substr(concat('  ', upper(raw_text)), 1, 60) AS q, regexp_replace(lower(raw_text), '\\s+', ' ', 'g') AS t FROM {v_segment} WHERE raw_text IS NOT NULL), w AS (SELECT *, trim(regexp_replace(lower(q), '\\s+', ' ', 'g'), ' ') AS n, list_distinct(list_filter(string_split(t, ' '), lambda x: x <> '')) AS tw FROM s)
       SELECT segment_id, length(q) >= 8 AND (contains(t, n) OR len(list_intersect(list_distinct(list_filter(string_split(n, ' '), lambda x: x <> '')), tw)) / greatest(len(list_distinct(list_filter(string_split(n, ' '), lambda x: x <> ''))), 1) >= 0.8) AS exact, contains(t, 'the policy of a cookie and the timer') OR len(list_intersect(['the', 'policy', 'of', 'a', 'cookie', 'and', 'timer'], tw)) / 7 >= 0.8 AS fuzzy FROM w""",
)
_CONTINUE = str(model.CONTINUATIVE)
_HINTS = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in extract.NUCLEARITY.items())
add(
    "extract_contexts",
    lambda k: extract.merged_contexts(k.segment, k.rst, k.segment_tag).select("segment_id", F.md5(F.col("text").cast("binary")).alias("digest"), F.array_join("nodes", ",").alias("nodes")),
    f"""WITH n AS (SELECT segment_id, list_sort(list(DISTINCT ontology_node_id)) AS nodes FROM {{v_segment_tag}} GROUP BY 1), s AS (SELECT s.segment_id, coalesce(s.raw_text, '') AS t, coalesce(n.nodes, []) AS nodes FROM {{v_segment}} s LEFT JOIN n ON n.segment_id = s.segment_id),
        c AS (SELECT segment_id, t, nodes FROM s UNION ALL SELECT r.dst_edu_id, concat('[These two paragraphs have a ', r.relation_type, ' relation: ', CASE r.nuclearity {_HINTS} END, '.]', chr(10), chr(10), a.t, chr(10), b.t), list_sort(list_distinct(list_concat(a.nodes, b.nodes))) FROM {{v_rst}} r JOIN s a ON a.segment_id = r.src_edu_id JOIN s b ON b.segment_id = r.dst_edu_id WHERE r.relation_type IN {_CONTINUE})
        SELECT segment_id, md5(t) AS digest, array_to_string(nodes, ',') AS nodes FROM c WHERE len(nodes) >= 3""",
)
_TRIPLES = "SELECT a.segment_id, a.ontology_node_id AS subject, CASE a.tag_id % 4 WHEN 0 THEN ' Depends-On ' WHEN 1 THEN 'requires' WHEN 2 THEN 'is next to' ELSE '' END AS predicate, b.ontology_node_id AS object FROM {v_segment_tag} a JOIN {v_segment_tag} b ON b.segment_id = a.segment_id"
_ALLOWED = "SELECT segment_id, ontology_node_id AS node_id FROM {v_segment_tag} WHERE tag_type = 'canonical'"
_CLEAN = f"t AS (SELECT segment_id, subject, regexp_replace(regexp_replace(lower(trim(predicate, ' ')), '[\\s\\-]+', '_', 'g'), '[^a-z0-9_]', '', 'g') AS predicate, object FROM ({_TRIPLES}) x WHERE subject <> object), a AS ({_ALLOWED}), k AS (SELECT * FROM t WHERE predicate <> '' AND (segment_id, subject) IN (SELECT segment_id, node_id FROM a) AND (segment_id, object) IN (SELECT segment_id, node_id FROM a))"
add("extract_triple_filter", lambda k: extract.filter_triples(k.sql(_TRIPLES), k.sql(_ALLOWED), RELATIONS)[0].distinct(), f"WITH {_CLEAN} SELECT DISTINCT segment_id, subject, predicate, object FROM k WHERE predicate IN {RELATIONS}")
add("extract_relation_candidates", lambda k: extract.filter_triples(k.sql(_TRIPLES).distinct(), k.sql(_ALLOWED), RELATIONS)[1], f"WITH {_CLEAN.replace('FROM (SELECT a.segment_id', 'FROM (SELECT DISTINCT a.segment_id')} SELECT predicate, count(*) AS n FROM k WHERE predicate NOT IN {RELATIONS} GROUP BY 1")
_SIGNAL = "CASE " + " ".join(f"WHEN regexp_matches(lower(substr(text, 1, 3000)), '{p}') THEN '{n}'" for n, p in extract.PREDICATE_SIGNALS) + " END"
add("extract_cooccurrence", lambda k: extract.cooccurrence(k.segment, k.segment_tag), f"WITH two AS (SELECT segment_id, min(ontology_node_id) AS subject, max(ontology_node_id) AS object FROM {{v_segment_tag}} GROUP BY 1 HAVING count(DISTINCT ontology_node_id) = 2), s AS (SELECT two.segment_id, subject, {_SIGNAL} AS predicate, object FROM two JOIN {{v_segment}} x ON x.segment_id = two.segment_id) SELECT * FROM s WHERE predicate IS NOT NULL")
_SCORE = "round(greatest(0.0, least(1.0, cast(0.0 AS double) + cast(0.3 AS double) * CASE e.source_rank WHEN 'S' THEN 1.0 WHEN 'A' THEN 0.85 WHEN 'B' THEN 0.65 ELSE 0.4 END + cast(0.2 AS double) * CASE e.extraction_method WHEN 'manual' THEN 1.0 WHEN 'rule' THEN 0.85 ELSE 0.7 END + cast(0.2 AS double) * e.evidence_score + cast(0.2 AS double) * 0.5 + cast(0.1 AS double) * CASE WHEN d <= 365 THEN 1.0 WHEN d <= 1095 THEN 0.85 WHEN d <= 1825 THEN 0.7 ELSE 0.5 END)) + 1e-9, 4)"
_AGE = "(SELECT *, date_diff('day', cast(created_at AS date), date '2001-08-01') AS d FROM {v_evidence})"
add("confidence_score", lambda k: k.evidence.select("evidence_id", (scoring.score_fact(F.col("source_rank"), F.col("extraction_method"), F.col("evidence_score"), F.lit(0.5), scoring.temporal_validity(F.datediff(F.lit("2001-08-01").cast("date"), "created_at")))).alias("score")), f"SELECT evidence_id, {_SCORE} AS score FROM {_AGE} e")
add("score_segment", lambda k: k.document.select("source_doc_id", scoring.score_segment(F.col("source_rank"), F.lit(0.8)).alias("score")), "SELECT source_doc_id, round(greatest(0.0, least(1.0, cast(0.6 AS double) * CASE source_rank WHEN 'S' THEN 1.0 WHEN 'A' THEN 0.85 WHEN 'B' THEN 0.65 ELSE 0.4 END + cast(0.4 AS double) * 0.8)) + 1e-9, 4) AS score FROM {v_document}")
# ---- dedup
_SIM = """WITH t AS (SELECT segment_id, unnest(list_concat(regexp_extract_all(x, '""" + CJK + """'), list_transform(list_filter(regexp_extract_all(x, '[a-zA-Z0-9]+'), lambda w: length(w) > 1), lambda w: lower(w)))) AS w FROM (SELECT segment_id, coalesce(raw_text, '') AS x FROM {v_segment}) y),
    h AS (SELECT segment_id, cast(concat('0x', substr(md5(w), 17, 16)) AS ubigint) AS h FROM t), b AS (SELECT segment_id, i, sum(CASE WHEN (h >> i) & 1 = 1 THEN 1 ELSE -1 END) AS v FROM h, range(0, 64) r(i) GROUP BY 1, 2),
    s AS (SELECT segment_id, sum(CASE WHEN v > 0 THEN cast(power(2, i) AS hugeint) ELSE 0 END) AS u FROM b GROUP BY 1)"""
add("dedup_simhash", lambda k: hashing.simhash(k.segment, "segment_id", "raw_text"), _SIM + " SELECT z.segment_id, cast(coalesce(CASE WHEN u >= 9223372036854775808 THEN u - 18446744073709551616 ELSE u END, 0) AS bigint) AS simhash FROM {v_segment} z LEFT JOIN s ON s.segment_id = z.segment_id")
_PRINTS = "(SELECT segment_id, simhash_value FROM {v_segment} WHERE simhash_value IS NOT NULL AND simhash_value <> 0)"
add("simhash_hamming_pairs", lambda k: hashing.hamming_pairs(k.segment.where("simhash_value <> 0"), "segment_id", "simhash_value", 3).select("a", "b", F.col("distance").cast("int").alias("distance")), f"SELECT x.segment_id AS a, y.segment_id AS b, cast(bit_count(xor(x.simhash_value, y.simhash_value)) AS int) AS distance FROM {_PRINTS} x JOIN {_PRINTS} y ON x.segment_id < y.segment_id WHERE bit_count(xor(x.simhash_value, y.simhash_value)) <= 3")
add("dedup_jaccard", lambda k: k.rst.join(k.segment.select(F.col("segment_id").alias("src_edu_id"), text.token_set(F.col("raw_text")).alias("a")), "src_edu_id").join(k.segment.select(F.col("segment_id").alias("dst_edu_id"), text.token_set(F.col("raw_text")).alias("b")), "dst_edu_id").select("src_edu_id", F.round(text.jaccard(F.col("a"), F.col("b")), 6).alias("j")),
    "WITH t AS (SELECT segment_id, list_distinct(list_concat(regexp_extract_all(raw_text, '" + CJK + "'), list_transform(list_filter(regexp_extract_all(raw_text, '[a-zA-Z0-9]+'), lambda w: length(w) > 1), lambda w: lower(w)))) AS w FROM {v_segment}) SELECT r.src_edu_id, round(CASE WHEN len(a.w) = 0 AND len(b.w) = 0 THEN 1.0 ELSE len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) END, 6) AS j FROM {v_rst} r JOIN t a ON a.segment_id = r.src_edu_id JOIN t b ON b.segment_id = r.dst_edu_id")
# a document here is a site, so that there is something to find
_SITES = "SELECT segment_id, site_key AS source_doc_id, segment_index, simhash_value AS simhash, raw_text AS text FROM {v_segment} WHERE simhash_value <> 0"
add("dedup_d2", lambda k: dedup.superseded_segments(k.sql(_SITES)),
    "WITH s AS (SELECT *, list_distinct(list_concat(regexp_extract_all(text, '" + CJK + "'), list_transform(list_filter(regexp_extract_all(text, '[a-zA-Z0-9]+'), lambda w: length(w) > 1), lambda w: lower(w)))) AS w FROM (" + _SITES + ") x) SELECT DISTINCT b.segment_id FROM s a JOIN s b ON a.source_doc_id = b.source_doc_id AND (a.segment_index, a.segment_id) < (b.segment_index, b.segment_id) WHERE bit_count(xor(a.simhash, b.simhash)) <= 3 AND CASE WHEN len(a.w) = 0 AND len(b.w) = 0 THEN 1.0 ELSE len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) END >= 0.85")
add("dedup_spo_merge", lambda k: dedup.merge_same_triples(k.fact).select("fact_id", "merge_cluster_id", "lifecycle_state"), "SELECT fact_id, first_value(fact_id) OVER w AS merge_cluster_id, CASE WHEN row_number() OVER w > 1 THEN 'superseded' ELSE lifecycle_state END AS lifecycle_state FROM {v_fact} WINDOW w AS (PARTITION BY subject, predicate, object ORDER BY confidence DESC NULLS LAST, fact_id)")
# a fact has the vectors of the segments its evidence names
EVIDENCE_VECTORS = "SELECT DISTINCT e.fact_id, e.segment_id, v.content_vec AS vec FROM {v_evidence} e JOIN {v_segment_vec} v ON v.segment_id = e.segment_id WHERE v.content_vec IS NOT NULL"
add("dedup_d3b", lambda k: dedup.semantic_duplicates(k.fact, k.sql(EVIDENCE_VECTORS)),
    f"WITH v AS ({EVIDENCE_VECTORS}), r AS (SELECT f.fact_id, f.subject, f.object, f.confidence, v.vec FROM {{v_fact}} f JOIN v ON v.fact_id = f.fact_id WHERE list_sum(list_transform(v.vec, lambda x: abs(x))) > 0) SELECT DISTINCT b.fact_id FROM r a JOIN r b ON a.subject = b.subject AND a.object = b.object WHERE (a.confidence > b.confidence OR (a.confidence = b.confidence AND a.fact_id < b.fact_id)) AND list_cosine_similarity(a.vec::DOUBLE[], b.vec::DOUBLE[]) >= {model.DEDUP_SEMANTIC}")
add("conflicts_functional", lambda k: dedup.functional_conflicts(k.fact, ["depends_on"]), "SELECT a.fact_id AS fact_id_a, b.fact_id AS fact_id_b, CASE WHEN contains(lower(a.object), lower(b.object)) OR contains(lower(b.object), lower(a.object)) THEN 'merge' ELSE 'conflict' END AS outcome FROM {v_fact} a JOIN {v_fact} b ON a.subject = b.subject AND a.predicate = b.predicate AND a.fact_id < b.fact_id AND a.object <> b.object WHERE a.predicate = 'depends_on' AND a.lifecycle_state = 'active' AND b.lifecycle_state = 'active'")
add("conflicted_facts", lambda k: dedup.conflicted_facts(k.fact, ["depends_on", "impacts"]), "WITH f AS (SELECT * FROM {v_fact} WHERE lifecycle_state = 'active' AND predicate IN ('depends_on', 'impacts')) SELECT fact_id FROM f WHERE (subject, predicate) IN (SELECT subject, predicate FROM f GROUP BY 1, 2 HAVING count(DISTINCT object) > 1)")
# ---- index
add("index_gates", lambda k: index.gated(k.segment).select("segment_id"), "SELECT segment_id FROM {v_segment} WHERE lifecycle_state = 'active' AND confidence >= 0.5")
add("edge_aggregate", lambda k: index.edges(k.fact), "SELECT subject AS src, upper(predicate) AS rel_type, object AS dst, predicate, max(confidence) AS confidence, count(*) AS fact_count FROM {v_fact} WHERE lifecycle_state = 'active' AND confidence >= 0.5 GROUP BY subject, predicate, object")
add("index_provenance", lambda k: index.provenance(k.fact, k.evidence, k.segment), "SELECT f.fact_id, e.evidence_id, e.segment_id, s.source_doc_id FROM {v_fact} f JOIN {v_evidence} e ON e.fact_id = f.fact_id JOIN {v_segment} s ON s.segment_id = e.segment_id WHERE f.lifecycle_state = 'active' AND f.confidence >= 0.5")
add("index_tags", lambda k: k.segment_tag.select("tag_id", index.layer_of(F.col("ontology_node_id")).alias("layer")), "SELECT tag_id, CASE split_part(ontology_node_id, '.', 1) WHEN 'IP' THEN 'concept' WHEN 'MECH' THEN 'mechanism' WHEN 'METHOD' THEN 'method' WHEN 'COND' THEN 'condition' WHEN 'SCENE' THEN 'scenario' END AS layer FROM {v_segment_tag}")
add(
    "routing",
    lambda k: index.run([("count", lambda d: d.groupBy("doc_type", "route").agg(F.count("*").alias("n")))], k.document.select("source_doc_id", "doc_type"), route=("doc_type", {"faq": lambda d: d.withColumn("route", F.lit("short")), "spec": lambda d: d.withColumn("route", F.lit("long"))})),
    "SELECT doc_type, CASE doc_type WHEN 'faq' THEN 'short' WHEN 'spec' THEN 'long' END AS route, count(*) AS n FROM {v_document} GROUP BY 1, 2",
)
add(
    "evolution_gate",
    lambda k: k.candidate.select("candidate_id", F.array_join(semantic.gate_reasons(source_count="source_count", source_diversity=F.lit(0.7), temporal_stability=F.lit(None).cast("double"), structural_fit="composite_score", composite="composite_score", synonym_risk=F.lit(None).cast("double")), ",").alias("reasons")),
    "SELECT candidate_id, concat_ws(',', CASE WHEN coalesce(source_count, 0) < 3 THEN 'source_count' END, 'temporal_stability', CASE WHEN coalesce(composite_score, 0) < 0.65 THEN 'structural_fit' END, CASE WHEN coalesce(composite_score, 0) < 0.65 THEN 'composite' END) AS reasons FROM {v_candidate}",
)
