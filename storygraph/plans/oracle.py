"""DuckDB SQL with the same results as the registered queries, built from shared CTEs."""

from __future__ import annotations

from storygraph.params import DAY_S
from storygraph.plans.adapters import AS_OF, CUT, HISTORY_AT, SHIFT_DAYS, START

LEAD = (
    "nullif(regexp_replace(array_to_string(regexp_extract_all(body, '[^.!?]+[.!?]*')[1:3], ''), '^\\s+|\\s+$', '', 'g'), '')"
)

ART = f"""
art0 AS (
  SELECT doc_id, source, lang AS category, text, md5(text) AS copy_id, sha256(doc_id::VARCHAR) AS article_id,
         'https://site.example/' || lang || '/' || doc_id AS url,
         {START} + (doc_id * 1000003) % 2592000 AS published,
         string_split(text, chr(10))[1] AS title, string_split(text, chr(10))[2:] AS lines
  FROM documents),
art1 AS (
  SELECT *, len(lines) AS n_blocks,
         array_to_string(list_filter(lines, lambda x: length(x) >= 12), ' ') AS body FROM art0),
art AS (
  SELECT *, len(regexp_extract_all(body, '\\S+')) AS words, {LEAD} AS lead,
         CASE WHEN len(regexp_extract_all(body, '\\S+')) > 300 THEN {LEAD} END AS summary FROM art1),
members AS (
  SELECT copy_id AS cluster_id, a.* FROM art a
  WHERE copy_id IN (SELECT copy_id FROM art GROUP BY copy_id HAVING count(*) >= 2))
"""

FEED = """
feed AS (
  SELECT event_id, 's' || (user_id % 3) AS source, event_type AS category, props AS url, event_id AS position,
         floor(epoch(ts))::BIGINT AS ts_s, ts, value,
         's' || (user_id % 3) || '/' || event_type || '/' || strftime(ts, '%Y-%m-%d') AS listing_url FROM events),
ledger AS (SELECT DISTINCT source, ts_s - ts_s % 86400 AS day, category, url FROM feed)
"""


def strip(text: str) -> str:
    return f"regexp_replace({text}, '^\\s+|\\s+$', '', 'g')"


FULL_TEXT = "title || ' ' || body"
SHORT_TEXT = strip("title || ' ' || coalesce(summary, body)")
REFRESH_TEXT = strip("title || ' ' || coalesce(summary, '')")


def counts(name: str, rows: str, dim: int = 512, words: int | None = None) -> str:
    """CTEs: signed 3-gram counts of the first ``words`` of ``rows`` (k, t) as ``name`` (k, bucket, n), scaled as ``name``_v."""
    cut = f"[1:{words}]" if words else ""
    return f"""
{name}_w AS (
  SELECT k, d, w, p, count(*) OVER (PARTITION BY d) AS m,
         lead(w, 1) OVER (PARTITION BY d ORDER BY p) AS w1, lead(w, 2) OVER (PARTITION BY d ORDER BY p) AS w2
  FROM (SELECT k, d, unnest(ws) AS w, generate_subscripts(ws, 1) AS p
        FROM (SELECT k, row_number() OVER () AS d, regexp_extract_all(lower(t), '\\S+'){cut} AS ws FROM ({rows})))),
{name}_g AS (
  SELECT k, CASE WHEN m < 3 THEN w ELSE w || ' ' || w1 || ' ' || w2 END AS g FROM {name}_w WHERE m < 3 OR w2 IS NOT NULL),
{name}_h AS (SELECT k, ('0x' || substr(md5(g), 1, 8))::BIGINT AS h FROM {name}_g),
{name} AS (
  SELECT k, h % {dim} AS bucket, sum(CASE WHEN (h // {dim}) % 2 = 0 THEN 1 ELSE -1 END)::BIGINT AS n
  FROM {name}_h GROUP BY 1, 2 HAVING n <> 0),
{name}_v AS (
  SELECT k, bucket, (n / sqrt(sum(n * n) OVER (PARTITION BY k)::DOUBLE))::FLOAT::DOUBLE AS value FROM {name})"""


def dense(name: str, dim: int = 512) -> str:
    """CTE: vectors of ``counts(name)`` as ``name``_d (k, v)."""
    return f"""
{name}_k AS (SELECT DISTINCT k FROM {name}_v),
{name}_d AS (
  SELECT a.k, list(coalesce(s.value, 0) ORDER BY a.b) AS v
  FROM (SELECT k, unnest(range({dim})) AS b FROM {name}_k) a
  LEFT JOIN {name}_v s ON s.k = a.k AND s.bucket = a.b GROUP BY a.k)"""


# The title of the member with most words, and the five sentences of all members with most different words less repeated ones.
LEAD_MEMBER = """
SELECT l.*, string_agg(s, ' ' ORDER BY place, s) AS cluster_content
FROM (SELECT cluster_id, count(*) AS n_members, arg_min(words, rnk) AS lead_words, arg_min(article_id, rnk) AS lead_id, arg_min(title, rnk) AS cluster_title
      FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY words DESC, article_id) AS rnk FROM {rows}) GROUP BY cluster_id) l
LEFT JOIN (
  SELECT cluster_id, s, len(ws) - 2 * len(list_distinct(ws)) AS place
  FROM (SELECT cluster_id, s, regexp_extract_all(s, '\\S+') AS ws
        FROM (SELECT DISTINCT cluster_id, regexp_replace(unnest(regexp_extract_all(body, '[^.!?]+[.!?]*')), '^\\s+|\\s+$', '', 'g') AS s FROM {rows}) WHERE s <> '')
  QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY place, s) <= 5) USING (cluster_id)
GROUP BY ALL"""

EMB = "e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings)"

CENTRES = f"""
{EMB},
c AS (SELECT e.label AS cluster_id, e.vec_id, e.v FROM e JOIN (SELECT min(vec_id) AS vec_id FROM e GROUP BY label) USING (vec_id)),
s AS (SELECT e.vec_id, c.cluster_id, list_cosine_similarity(e.v, c.v) AS sim
      FROM e CROSS JOIN c WHERE e.vec_id NOT IN (SELECT vec_id FROM c)),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, cluster_id) = 1)
"""

PAIRS = f"""
{EMB},
d AS (SELECT v, min(vec_id) AS id, count(*) AS copies FROM e GROUP BY v),
pairs AS (SELECT a.id AS left_id, b.id AS right_id, a.copies AS left_copies, b.copies AS right_copies,
                 list_cosine_similarity(a.v, b.v) AS similarity
          FROM d a JOIN d b ON a.id < b.id WHERE list_cosine_similarity(a.v, b.v) >= 0.4),
edges AS (SELECT left_id AS a, right_id AS b FROM pairs UNION ALL SELECT right_id, left_id FROM pairs)
"""

LABELS = f"""
{PAIRS},
reach AS (SELECT id, id AS root FROM d UNION SELECT edges.b, reach.root FROM reach JOIN edges ON edges.a = reach.id),
roots AS (SELECT id, min(root) AS root FROM reach GROUP BY id),
sized AS (SELECT id, root, sum(copies) OVER (PARTITION BY root) AS n FROM roots JOIN d USING (id)),
labels0 AS (SELECT e.vec_id, CASE WHEN n >= 2 THEN root ELSE -1 END AS label
            FROM e JOIN d ON d.v = e.v JOIN sized ON sized.id = d.id)
"""

RUN = f"""
{ART},
old_members AS (
  SELECT copy_id AS cluster_id, a.* FROM art a WHERE published < {CUT}
  AND copy_id IN (SELECT copy_id FROM art WHERE published < {CUT} GROUP BY copy_id HAVING count(*) >= 2)),
fresh AS (SELECT * FROM art WHERE published >= {CUT}),
{counts("av", f"SELECT article_id AS k, {FULL_TEXT} AS t FROM fresh")},
{dense("av")},
{counts("cv", f"SELECT cluster_id AS k, {SHORT_TEXT} AS t FROM old_members")},
{dense("cv")},
near AS (SELECT a.k AS article_id, c.k AS cluster_id, list_cosine_similarity(a.v, c.v) AS sim FROM av_d a CROSS JOIN cv_d c
         QUALIFY row_number() OVER (PARTITION BY a.k ORDER BY sim DESC, c.k) = 1),
rest AS (SELECT k AS id, v FROM av_d WHERE k NOT IN (SELECT article_id FROM near WHERE sim >= 0.7)),
links AS (SELECT a.id AS a, b.id AS b FROM rest a JOIN rest b ON a.id <> b.id AND list_cosine_similarity(a.v, b.v) >= 0.8 - 1e-12),
walk AS (SELECT id, id AS root FROM rest UNION SELECT links.b, walk.root FROM walk JOIN links ON links.a = walk.id),
grouped AS (SELECT id, min(root) AS root FROM walk WHERE id IN (SELECT a FROM links) GROUP BY id),
decided AS (
  SELECT f.article_id,
         CASE WHEN n.sim >= 0.7 THEN 'assigned' WHEN g.root IS NOT NULL THEN 'grouped' ELSE 'noise' END AS stage,
         CASE WHEN n.sim >= 0.7 THEN n.cluster_id WHEN g.root IS NOT NULL THEN sha256(g.root || '#{AS_OF}') END AS cluster_id,
         round(n.sim, 6) AS similarity
  FROM fresh f LEFT JOIN near n USING (article_id) LEFT JOIN grouped g ON g.id = f.article_id)
"""

UPDATED = f"""
{ART},
old_members AS (
  SELECT copy_id AS cluster_id, a.* FROM art a WHERE published < {CUT}
  AND copy_id IN (SELECT copy_id FROM art WHERE published < {CUT} GROUP BY copy_id HAVING count(*) >= 2)),
touched AS (SELECT DISTINCT copy_id FROM art WHERE published >= {CUT} AND copy_id IN (SELECT cluster_id FROM old_members)),
everyone AS (SELECT copy_id AS cluster_id, a.* FROM art a WHERE copy_id IN (SELECT copy_id FROM touched))
"""

UNESCAPED = "replace(replace(replace(replace({}, '&quot;', '\"'), '&middot;', '·'), '&copy;', '©'), '&amp;', '&')"

BLOCK_LINES = (
    "array_to_string(list_transform(list_filter(list_transform({paragraphs}, lambda x: "
    + UNESCAPED.format("regexp_replace(x, '<[^>]*>', '', 'g')")
    + "), lambda x: x <> ''), lambda x: 'paragraph ' || x), chr(10))"
)

PIECES = """
pieces AS (SELECT url, page_id, string_split(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '<p>')[2:] AS ps FROM pages),
piece AS (SELECT url, generate_subscripts(ps, 1) AS i, unnest(ps) AS p FROM pieces)
"""

NAV = """
nav AS (SELECT page_id, url, generate_subscripts(hs, 1) AS i, unnest(hs) AS href, unnest(ts) AS label
        FROM (SELECT page_id, url, regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 1) AS hs,
                     regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 2) AS ts FROM pages))
"""


def blocks(text: str) -> str:
    return f"""
WITH {PIECES},
texts AS (SELECT url, i, {UNESCAPED.format(text)} AS content FROM piece)
SELECT url, row_number() OVER (PARTITION BY url ORDER BY i) - 1 AS position, 'paragraph' AS type, content
FROM texts WHERE content <> ''"""


WALL = f"ts + INTERVAL {SHIFT_DAYS} DAY"
SPOT = "('0x' || substr(md5({}), 1, 8))::BIGINT"

ORACLE: dict[str, str] = {
    "new_articles": f"""
WITH {ART}
SELECT article_id, source, published AS article_published_date FROM art
WHERE published >= {AS_OF - DAY_S} AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""",
    "recent_clusters": f"""
WITH {ART}
SELECT copy_id AS cluster_id, max(published) AS last_updated FROM art GROUP BY 1 HAVING max(published) >= {AS_OF - 7 * DAY_S}""",
    "valid_articles": f"""
WITH {ART} SELECT article_id, CASE WHEN n_blocks = 0 THEN 'empty_content' ELSE 'ok' END AS reason FROM art""",
    "store_articles": f"""
WITH {ART}
SELECT source, sha256(source || '#' || category || '#' || url || '#{AS_OF}') AS article_id, title AS article_title, url AS article_url,
       n_blocks, published AS article_published_date, category AS article_category, summary AS article_summary,
       NULL::VARCHAR AS cluster_id
FROM art WHERE n_blocks > 0""",
    "ledger_today": f"WITH {FEED} SELECT * FROM ledger WHERE day = {START + 14 * DAY_S} AND source = 's1'",
    "ledger_sets": f"""
WITH {FEED},
sized AS (SELECT *, ceil(count(*) OVER (PARTITION BY source, day, category) / 20)::BIGINT AS chunks FROM ledger)
SELECT source, day, category, {SPOT.format("url")} % chunks AS chunk, string_agg(url, ' ' ORDER BY url) AS urls
FROM sized GROUP BY ALL""",
    "ledger_upsert": f"""
WITH {FEED}
SELECT * FROM ledger EXCEPT SELECT source, ts_s - ts_s % 86400 AS day, category, url FROM feed WHERE value > 20""",
    "unseen_urls": f"""
WITH {FEED}
SELECT event_id, source, category FROM feed f WHERE NOT EXISTS (
  SELECT 1 FROM feed l WHERE l.value > 20 AND l.ts_s - l.ts_s % 86400 = {START + 29 * DAY_S}
  AND l.source = f.source AND l.category = f.category AND l.url = f.url)""",
    "listing_quota": f"""
WITH {FEED}
SELECT listing_url, event_id FROM feed QUALIFY row_number() OVER (PARTITION BY listing_url ORDER BY position) <= 5""",
    "daily_url_dedup": f"WITH {FEED} SELECT * FROM ledger",
    "article_stats": """
SELECT source, CASE WHEN grouping(lang) = 1 THEN 'total_articles' ELSE 'category_' || lang END AS metric, count(*) AS value
FROM documents GROUP BY GROUPING SETS ((source), (source, lang))""",
    "feed_stats": f"""
WITH {FEED}
SELECT source, CASE WHEN grouping(category) = 1 THEN 'total_articles' ELSE 'category_' || category END AS metric, count(*) AS value
FROM feed GROUP BY GROUPING SETS ((source), (source, category))""",
    "url_category": """
SELECT page_id, split_part(url, '/', -2) AS next_to_last, split_part(url, '/', -1) AS last FROM pages""",
    "absolute_url": """
WITH p AS (SELECT page_id, regexp_replace(url, '^https:', '') AS u FROM pages)
SELECT page_id, CASE WHEN starts_with(u, 'http') THEN u ELSE 'https://syri.net' || u END AS if_relative,
       'https://pamfleti.net' || u AS always FROM p""",
    "style_image_url": "SELECT page_id, CASE WHEN starts_with(url, 'https') THEN url END AS image FROM pages",
    "source_name": "SELECT doc_id, lower(split_part(upper(source) || '_' || lang, '_', 1)) AS source FROM documents",
    "parse_date_iso": f"SELECT event_id, floor(epoch({WALL}))::BIGINT - 7200 AS epoch_s FROM events",
    "parse_date_named_month": f"""
SELECT event_id, epoch(timezone('Europe/Tirane', date_trunc('minute', {WALL})))::BIGINT AS epoch_s FROM events""",
    "local_to_epoch": f"""
WITH t AS (SELECT event_id, epoch(timezone('Europe/Tirane', date_trunc('second', {WALL})))::BIGINT AS epoch_s FROM events)
SELECT event_id, epoch_s, epoch_s - epoch_s % 86400 AS day FROM t""",
    "article_text": f"WITH {ART} SELECT article_id, {FULL_TEXT} AS full_text, body AS paragraphs FROM art",
    "article_text_short": f"WITH {ART} SELECT article_id, {SHORT_TEXT} AS short_text FROM art",
    "token_count": "SELECT doc_id, len(regexp_extract_all(text, '\\S+')) AS n_tokens FROM documents",
    "truncate_tokens": """
WITH w AS (SELECT doc_id, text, regexp_extract_all(text, '\\S+') AS ws FROM documents)
SELECT doc_id, CASE WHEN len(ws) > 50 THEN array_to_string(ws[1:50], ' ') ELSE text END AS text FROM w""",
    "summary_gate": f"WITH {ART} SELECT article_id, words AS n_tokens, words > 300 AS summarised FROM art",
    "parse_summary_json": f"""
WITH {ART} SELECT article_id, CASE WHEN n_blocks > 0 THEN title END AS cluster_title,
       CASE WHEN n_blocks > 0 THEN category END AS cluster_content FROM art""",
    "embed_documents": f"""
WITH {ART}, {counts("x", f"SELECT article_id AS k, {FULL_TEXT} AS t FROM art")}
SELECT k AS article_id, bucket, value FROM x_v""",
    "embedding_fill": f"""
WITH {ART},
{counts("x", f"SELECT article_id AS k, {SHORT_TEXT} AS t FROM art WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)", 64)}
SELECT k AS article_id, bucket, value FROM x_v
UNION ALL
SELECT article_id, i - 1, v FROM (
  SELECT article_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i
  FROM art JOIN embeddings ON vec_id = doc_id) WHERE v <> 0""",
    "summarize_documents": f"WITH {ART} SELECT article_id, summary AS article_summary FROM art",
    "enrich_articles": f"""
WITH {ART}, {counts("x", f"SELECT article_id AS k, {FULL_TEXT} AS t FROM art WHERE n_blocks > 0")}
SELECT article_id, any_value(summary) AS article_summary, count(*) AS n_buckets FROM art JOIN x ON k = article_id GROUP BY 1""",
    "cosine_pairs": f"""
WITH {EMB}, c AS (SELECT label, arg_min(v, vec_id) AS cv FROM e GROUP BY label)
SELECT vec_id, round(list_cosine_similarity(v, cv), 6) AS similarity FROM e JOIN c USING (label)""",
    "assign_nearest": f"WITH {CENTRES} SELECT vec_id, cluster_id, round(sim, 6) AS similarity FROM best WHERE sim >= 0.2",
    "unassigned_articles": f"WITH {CENTRES} SELECT vec_id, round(sim, 6) AS similarity FROM best WHERE sim < 0.2",
    "similar_pairs": f"""
WITH {PAIRS} SELECT left_id, right_id, left_copies, right_copies, round(similarity, 6) AS similarity FROM pairs""",
    "dbscan_labels": f"WITH RECURSIVE {LABELS} SELECT vec_id, label FROM labels0",
    "cluster_labels": f"""
WITH RECURSIVE {LABELS} SELECT e.vec_id, e.label AS topic, l.label FROM e JOIN labels0 l USING (vec_id) WHERE l.label <> -1""",
    "dbscan_core_border": f"""
WITH RECURSIVE {PAIRS},
weight AS (SELECT a.id, a.copies + coalesce(sum(b.copies), 0) AS n FROM d a LEFT JOIN edges ON edges.a = a.id
           LEFT JOIN d b ON b.id = edges.b GROUP BY a.id, a.copies),
core AS (SELECT id FROM weight WHERE n >= 3),
inner_edges AS (SELECT * FROM edges WHERE a IN (FROM core) AND b IN (FROM core)),
reach AS (SELECT id, id AS root FROM core
          UNION SELECT inner_edges.b, reach.root FROM reach JOIN inner_edges ON inner_edges.a = reach.id),
named AS (SELECT id, min(root) AS root FROM reach GROUP BY id),
border AS (SELECT edges.a AS id, min(root) AS root FROM edges JOIN named ON named.id = edges.b
           WHERE edges.a NOT IN (FROM core) GROUP BY 1),
found AS (SELECT * FROM named UNION ALL SELECT * FROM border)
SELECT e.vec_id, coalesce(root, -1) AS label FROM e JOIN d ON d.v = e.v LEFT JOIN found ON found.id = d.id""",
    "cluster_text": f"""
WITH {ART},
p AS (SELECT cluster_id, article_id, 'Title: ' || title || chr(10) || 'Content: ' || body AS passage FROM members),
z AS (SELECT cluster_id, greatest(ceil(sum(length(passage)) / 2000)::BIGINT, 1) AS parts FROM p GROUP BY 1)
SELECT cluster_id, (('0x' || substr(article_id, 1, 8))::BIGINT * parts) // 4294967296 AS part,
       string_agg(passage, chr(10) || chr(10) ORDER BY article_id) AS text
FROM p JOIN z USING (cluster_id) GROUP BY 1, 2""",
    "cluster_embedding_text": f"""
WITH {ART}
SELECT cluster_id, 0::BIGINT AS part, string_agg({SHORT_TEXT}, chr(10) || chr(10) ORDER BY article_id) AS text FROM members GROUP BY 1""",
    "cluster_embedding": f"""
WITH {ART}, {counts("x", f"SELECT cluster_id AS k, {SHORT_TEXT} AS t FROM members")}
SELECT k AS cluster_id, bucket, value FROM x_v""",
    "cluster_summary": f"WITH {ART} {LEAD_MEMBER.format(rows='members')}",
    "cluster_members": f"""
WITH {ART},
m AS (SELECT cluster_id, source || '/' || article_id AS ref, ceil(count(*) OVER (PARTITION BY cluster_id) / 2)::BIGINT AS chunks FROM members)
SELECT cluster_id, {AS_OF}::BIGINT AS added_at, {SPOT.format("ref")} % chunks AS chunk, string_agg(ref, ' ' ORDER BY ref) AS articles
FROM m GROUP BY 1, 2, 3""",
    "member_additions": f"""
WITH {ART} SELECT cluster_id, source, article_id, published AS added_at FROM members WHERE published >= {CUT}""",
    "cluster_member_articles": f"""
WITH {ART}
SELECT cluster_id, source, article_id, published AS added_at, title AS article_title,
       coalesce(summary, '') AS article_summary, n_blocks FROM members WHERE n_blocks > 0""",
    "new_clusters": f"WITH {ART}, l AS ({LEAD_MEMBER.format(rows='members')}) SELECT *, {AS_OF}::BIGINT AS last_updated FROM l",
    "updated_clusters": f"WITH {UPDATED}, l AS ({LEAD_MEMBER.format(rows='everyone')}) SELECT *, {AS_OF}::BIGINT AS last_updated FROM l",
    "updated_cluster_embedding": f"""
WITH {UPDATED}, {counts("x", f"SELECT cluster_id AS k, {REFRESH_TEXT} AS t FROM everyone")}
SELECT k AS cluster_id, bucket, value FROM x_v""",
    "upserted_clusters": f"""
WITH {UPDATED}
SELECT cluster_id, {AS_OF}::BIGINT AS last_updated, count(*) AS n_members FROM everyone GROUP BY 1
UNION ALL
SELECT cluster_id, {HISTORY_AT}::BIGINT, count(*) FROM old_members WHERE cluster_id NOT IN (SELECT copy_id FROM touched) GROUP BY 1""",
    "articles_with_cluster": f"""
WITH {ART} SELECT a.source, a.article_id, m.cluster_id FROM art a LEFT JOIN members m USING (article_id)""",
    "cluster_run": f"WITH RECURSIVE {RUN} SELECT * FROM decided",
    "cluster_run_changes": f"""
WITH RECURSIVE {RUN},
everyone AS (
  SELECT d.cluster_id, a.article_id, a.title, a.body, a.words FROM decided d JOIN art a USING (article_id) WHERE d.cluster_id IS NOT NULL
  UNION ALL
  SELECT cluster_id, article_id, title, body, words FROM old_members
  WHERE cluster_id IN (SELECT cluster_id FROM decided WHERE cluster_id IS NOT NULL)),
l AS ({LEAD_MEMBER.format(rows='everyone')})
SELECT *, {AS_OF}::BIGINT AS last_updated FROM l""",
    "run_metrics": f"""
WITH RECURSIVE {RUN}
SELECT count(*) AS found_new, (SELECT count(DISTINCT cluster_id) FROM old_members) AS found_clusters,
       count(*) FILTER (stage = 'assigned') AS assigned, count(*) FILTER (stage <> 'assigned') AS unassigned,
       count(DISTINCT cluster_id) FILTER (stage = 'grouped') AS new_clusters FROM decided""",
    "extract_listing": f"""
WITH {NAV}
SELECT url AS listing_url, split_part(url, '/', -2) AS category, i - 1 AS position, {UNESCAPED.format("href")} AS article_url,
       nullif({UNESCAPED.format("label")}, '') AS title,
       'https://site.example' || trim({UNESCAPED.format("href")}, '''') AS thumbnail FROM nav""",
    "extract_blocks": blocks("regexp_replace(p, '<[^>]*>', '', 'g')"),
    "first_text_blocks": blocks("regexp_extract(p, '^(?:<[^>]*>)*([^<]+)', 1)"),
    "joined_text_blocks": blocks(
        "array_to_string(list_filter(list_transform(regexp_extract_all('>' || p, '>([^<]+)', 1), "
        f"lambda x: {strip('x')}), lambda x: x <> ''), ' ')"
    ),
    "classify_blocks": f"""
WITH {PIECES}, {NAV},
parts AS (
  SELECT url, 0 AS g, i, 'iframe' AS type, {UNESCAPED.format("href")} AS content, NULL::VARCHAR AS src FROM nav
  UNION ALL
  SELECT url, 1, 1, 'video', NULL, {UNESCAPED.format("regexp_extract(html, '<div class=.ad.>([^<]+)</div>', 1)")} FROM pages
  UNION ALL
  SELECT url, 2, 1, 'image', NULL, NULL FROM pages
  UNION ALL
  SELECT url, 3, i, 'paragraph', {UNESCAPED.format("regexp_replace(p, '<[^>]*>', '', 'g')")}, NULL FROM piece)
SELECT url, row_number() OVER (PARTITION BY url ORDER BY g, i) - 1 AS position, type, content, src FROM parts
WHERE coalesce(content, src, type) <> '' AND (g = 2 OR coalesce(content, src) <> '')""",
    "gallery_blocks": f"""
WITH {PIECES}, {NAV},
texts AS (SELECT url, 0 AS g, i, 'paragraph' AS type, {UNESCAPED.format("regexp_replace(p, '<[^>]*>', '', 'g')")} AS content FROM piece),
both_kinds AS (SELECT * FROM texts WHERE content <> ''
               UNION ALL SELECT url, 1, i, 'image', regexp_extract(url, '^https?://[^/?#]*') || {UNESCAPED.format("href")} FROM nav)
SELECT url, row_number() OVER (PARTITION BY url ORDER BY g, i) - 1 AS position, type, content FROM both_kinds""",
    "article_image": f"""
WITH {NAV}
SELECT p.url, 'https://site.example' || {UNESCAPED.format("n.href")} AS article_image
FROM pages p LEFT JOIN nav n ON n.page_id = p.page_id AND n.i = 1""",
    "article_records": f"""
WITH {PIECES}
SELECT url AS article_url, 'Page ' || page_id AS article_title, split_part(url, '/', 4) AS article_category,
       {BLOCK_LINES.format(paragraphs="ps")} AS content, NULL::VARCHAR AS cluster_id FROM pieces""",
    "ingest_run": f"""
WITH {PIECES},
asked AS (SELECT url, ps, split_part(url, '/', 4) AS category FROM pieces WHERE starts_with(url, 'https')
          QUALIFY row_number() OVER (PARTITION BY split_part(url, '/', 3) ORDER BY page_id) <= 5),
b AS (SELECT *, list_filter(list_transform(ps, lambda x: regexp_replace(x, '<[^>]*>', '', 'g')), lambda x: x <> '') AS bs FROM asked),
t AS (SELECT url, category, {BLOCK_LINES.format(paragraphs="ps")} AS content, {UNESCAPED.format("array_to_string(bs, ' ')")} AS body FROM b)
SELECT 'web' AS source, sha256('web#' || category || '#' || url || '#{AS_OF}') AS article_id, url AS article_url, category AS article_category,
       content, CASE WHEN len(regexp_extract_all(body, '\\S+')) > 300 THEN {LEAD} END AS article_summary
FROM t WHERE content <> ''""",
}
ORACLE["stats_increment"] = ORACLE["article_stats"]
ORACLE["parse_date_dmy"] = ORACLE["parse_date_named_month"]
ORACLE["assign_nearest_blocks"] = ORACLE["assign_nearest"]
ORACLE["stream_url_dedup"] = ORACLE["daily_url_dedup"]
ORACLE["stream_stats"] = ORACLE["feed_stats"]
ORACLE["ingest_two_batches"] = ORACLE["ingest_run"]
ORACLE["article_records_recrawled"] = ORACLE["article_records"]
ORACLE["cluster_run_repeated_keys"] = ORACLE["cluster_run"]
# Six forms of links on each page, resolved by taking its URL apart.
ORACLE["resolve_url"] = """
WITH cut AS (SELECT page_id, url, regexp_extract(url, '^https?://[^/?#]*') AS site, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path FROM pages)
SELECT page_id, url AS absolute, regexp_extract(url, '^https?:') || '//cdn.example/x.jpg' AS host, site || '/lajm/9?a=b' AS rooted,
       site || regexp_replace(path, '[^/]*$', '') || 'lajm/9' AS beside, site || path || '?page=2' AS query,
       site || regexp_replace(regexp_replace(path, '[^/]*$', ''), '[^/]+/$', '') || 'other' AS above
FROM cut
"""
ORACLE["cluster_embedding_by_model"] = ORACLE["cluster_embedding"]


def _site(url: str, thumbnail: str, image: str, epoch: str, category: str, keep: str = "x", more: str = "") -> str:
    """Documents as articles of a site: lines after the first as paragraphs, without the empty ones."""
    return f"""
SELECT {url} AS article_url, nullif(string_split(text, chr(10))[1], '') AS article_title, {thumbnail} AS article_thumbnail, {image} AS article_image,
       array_to_string(list_concat(['paragraph ' || {keep} FOR x IN string_split(text, chr(10))[2:] IF {keep} <> ''], [{more}]::VARCHAR[]), chr(10)) AS content,
       {epoch} AS article_published_date, '{category}' AS article_category
FROM (SELECT *, {START} + (doc_id * 1000003) % 2592000 AS published FROM documents)"""


# The two local forms have minutes only; all dates are in January, one hour before UTC.
MINUTES = "published - published % 60 - 3600"
ORACLE["site_lapsi"] = _site("'https://lapsi.al/d' || doc_id", "'/t' || doc_id || '.jpg'", "'https://lapsi.al/i' || doc_id || '.jpg'", "published", "te-fundit")
ORACLE["site_pamfleti"] = _site("'https://pamfleti.net/d' || doc_id", "'t' || doc_id || '.jpg'", "'i' || doc_id || '.jpg'", MINUTES, "aktualitet")
ORACLE["site_syri"] = _site(
    "'/lajm/' || doc_id",
    "CASE WHEN doc_id % 2 = 0 THEN 'https://syri.net' ELSE 'https://cdn.example' END || '/t' || doc_id || '.jpg'",
    "'https://syri.net/i' || doc_id || '.jpg'",
    MINUTES,
    "politike",
    strip("x"),
    "'image https://www.syri.net/lajm/g' || doc_id || '.jpg'",
)

ORACLE["stored_clusters"] = ORACLE["upserted_clusters"]
ORACLE["stored_articles"] = ORACLE["articles_with_cluster"]
ORACLE["stored_members"] = f"WITH {ART} SELECT cluster_id, source, article_id, published AS added_at FROM members"
ORACLE["stored_counters"] = ORACLE["article_stats"]
ORACLE["stored_ledger"] = ORACLE["daily_url_dedup"]
ORACLE["dbscan_batches"] = ORACLE["dbscan_labels"]
ORACLE["dbscan_batches_core_border"] = ORACLE["dbscan_core_border"]


def _grouped(tag: str, rows: str, at: int) -> str:
    """Clusters of two and more among some of the vectors, named by the first member (as text) and the time."""
    return f"""
d{tag} AS (SELECT v, min(vec_id::VARCHAR) AS id, count(*) AS copies FROM ({rows}) GROUP BY v),
x{tag} AS (SELECT a.id AS a, b.id AS b FROM d{tag} a JOIN d{tag} b ON a.id <> b.id WHERE list_cosine_similarity(a.v, b.v) >= 0.4),
r{tag} AS (SELECT id, id AS root FROM d{tag} UNION SELECT x{tag}.b, r{tag}.root FROM r{tag} JOIN x{tag} ON x{tag}.a = r{tag}.id),
n{tag} AS (SELECT id, root, sum(copies) OVER (PARTITION BY root) AS n FROM (SELECT id, min(root) AS root FROM r{tag} GROUP BY id) JOIN d{tag} USING (id)),
g{tag} AS (SELECT q.vec_id, sha256(root || '#{at}') AS cluster_id, {at}::BIGINT AS added_at
           FROM ({rows}) q JOIN d{tag} ON d{tag}.v = q.v JOIN n{tag} ON n{tag}.id = d{tag}.id WHERE n >= 2)"""


ORACLE["cluster_stream_ticks"] = f"""
WITH RECURSIVE {EMB}, {_grouped("0", "SELECT * FROM e WHERE vec_id % 2 = 0", AS_OF)},
{_grouped("1", "SELECT * FROM e WHERE vec_id NOT IN (SELECT vec_id FROM g0)", AS_OF + 10)}
SELECT * FROM g0 UNION ALL SELECT * FROM g1"""
