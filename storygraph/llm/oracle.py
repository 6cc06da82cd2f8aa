"""DuckDB SQL for the queries of this folder that SQL can express."""

ORACLE: dict[str, str] = {}


def _unit(text: str) -> str:
    return f"((('0x' || substr(md5({text}), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE)"


def _shard(n: int) -> str:
    u = _unit("'shard:' || s || ':' || coalesce(doc_id::VARCHAR, '')")
    return f"-list_max([{{'score': 1::DOUBLE / -ln({u}), 's': -s}} FOR s IN range({n})]).s"


# CRC-32 (reflected polynomial 0xEDB88320): its table by the rule, then one step per byte.
ORACLE["op3_sharding"] = f"""
WITH crc_table AS (
  SELECT list(c ORDER BY n) AS t FROM (
    SELECT n, list_reduce([n] || [0::BIGINT FOR i IN range(8)],
      lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END) AS c FROM range(256) r(n))),
raw AS (
  SELECT doc_id, [('0x' || h)::BIGINT FOR h IN regexp_extract_all(hex(encode(coalesce(text, ''))), '..')] AS b FROM documents),
sized AS (
  SELECT doc_id, len(b)::BIGINT + 8 AS size,
         xor(list_reduce([4294967295::BIGINT] || b, lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295::BIGINT) AS text_crc32
  FROM raw, crc_table),
dealt AS (
  SELECT *, ({_shard(24)})::INTEGER AS shard, ({_shard(25)})::INTEGER AS grown_shard,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || size || ':' || text_crc32), 1, 3))::BIGINT AS bucket
  FROM sized)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard
FROM dealt
"""

ORACLE["op9_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

SIZED = r"SELECT *, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM {}"

# The water level: sources in the order of limit to weight, capped while the level of the rest reaches their limit.
TARGETS = """
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, source_size * 2::DOUBLE AS cap, [5::DOUBLE, 2::DOUBLE, 1::DOUBLE][(place % 3) + 1] AS weight
  FROM (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM totals)),
ranked AS (
  SELECT *, sum(source_size) OVER () * 1.5::DOUBLE AS pool, sum(weight) OVER () AS weights,
         coalesce(sum(cap) OVER b, 0) AS cap_before, coalesce(sum(weight) OVER b, 0) AS weight_before
  FROM weighed WINDOW b AS (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
marked AS (SELECT *, (pool - cap_before) / (weights - weight_before) * weight >= cap AS capped FROM ranked),
levels AS (
  SELECT *, (pool - coalesce(sum(CASE WHEN capped THEN cap END) OVER (), 0))
            / nullif(coalesce(sum(CASE WHEN capped THEN 0 ELSE weight END) OVER (), 0), 0) AS level FROM marked),
rates AS (
  SELECT source, source_size, CASE WHEN capped THEN cap ELSE least(cap, level * weight) END AS target FROM levels)
"""

ORACLE["op10_mixing"] = f"""
WITH sized AS ({SIZED.format("documents")}), {TARGETS},
rated AS (
  SELECT d.*, r.source_size, r.target, CASE WHEN r.source_size > 0 THEN r.target / r.source_size ELSE 0 END AS rate
  FROM sized d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target,
       size * (floor(rate)::BIGINT
         + ({_unit("'mix:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))")} < rate - floor(rate))::BIGINT) AS taken
FROM rated
"""

ORACLE["op12_hard_negatives"] = """
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS alike, list_dot_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM pairs WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
negatives AS (
  SELECT p.*, n.other_id AS negative_id, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY n.score DESC, n.other_id)::INTEGER AS rank
  FROM positives p JOIN pairs n ON p.anchor_id = n.anchor_id AND NOT n.alike
    AND 80 * positive_score <= 100 * n.score AND n.score <= positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 5
"""

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _terms(table: str) -> str:
    lowered = f"translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}')"
    return rf"SELECT *, regexp_extract_all({lowered}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM {table}"


ORACLE["op11_lexical_search"] = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, terms, len(terms) AS n FROM ({_terms("documents")})),
totals AS (SELECT count_if(n > 0)::BIGINT AS nd, sum(n)::BIGINT AS l FROM docs),
asked AS (SELECT DISTINCT item_id, text, unnest(terms) AS term FROM ({_terms("benchmark")})),
tfs AS (
  SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(terms) AS term FROM docs)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(nd) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tfs, totals GROUP BY term),
impacts AS (
  SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * nd) // l))) AS impact
  FROM tfs JOIN docs USING (r) JOIN weights USING (term), totals),
scored AS (
  SELECT item_id, text, doc_id, r, sum(impact)::BIGINT AS score FROM asked JOIN impacts USING (term) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0
QUALIFY rank <= 50
"""
