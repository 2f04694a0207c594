"""DuckDB SQL for the queries that SQL can express."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP4 = """
WITH n AS (
  SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + 1 AS size, sha256(coalesce(text, '')) AS content, encode(coalesce(text, '')) AS raw FROM documents
), bytes AS (
  -- CRC-32 of each text: a table of the 256 bytes, then a fold over the bytes.
  SELECT list(c ORDER BY b) AS crc FROM (
    SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256))::BIGINT AS b)
  )
), hexed AS (
  SELECT t, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda h: ('0x' || h)::BIGINT)),
                     lambda c, x: xor(c >> 8, crc[1 + (xor(c, x) & 255)])) AS c
  FROM (SELECT DISTINCT coalesce(text, '') AS t FROM documents), bytes
), crcs AS (
  SELECT sha256(t) AS content, xor(c, 4294967295)::BIGINT AS text_crc32 FROM hexed
), placed AS (
  SELECT doc_id, size, content, row_number() OVER w - 1 AS place, sum(size) OVER (w ROWS UNBOUNDED PRECEDING)::BIGINT AS upto, sum(size) OVER ()::BIGINT AS total
  FROM n WINDOW w AS (ORDER BY content, doc_id NULLS FIRST, size)
), cuts AS (
  SELECT k, max(place + CASE WHEN k * total - 8 * (upto - size) < 8 * upto - k * total THEN 0 ELSE 1 END) AS first_place
  FROM placed, (SELECT unnest(range(1, 8)) AS k) WHERE 8 * (upto - size) < k * total AND k * total <= 8 * upto GROUP BY k
), sharded AS (
  SELECT doc_id, size, content, place, (SELECT count(*) FROM cuts WHERE first_place <= place)::INT AS shard FROM placed
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, (row_number() OVER (PARTITION BY shard ORDER BY place) - 1)::BIGINT AS slot, NULL::INT AS grown_shard
FROM sharded JOIN crcs USING (content)
"""

OP6 = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents
), h AS (
  SELECT *, ('0x' || substr(sha256('17:' || coalesce(doc_id::VARCHAR, 'null') || ':' || size::VARCHAR), 1, 15))::BIGINT AS pos FROM d
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM h GROUP BY source
), c AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / weight AS clamp_at, sum(source_size) OVER () * 1.5::DOUBLE AS budget FROM s
), l AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY clamp_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0::DOUBLE))
            / sum(weight) OVER (ORDER BY clamp_at, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM c
), g AS (SELECT arg_min(level, clamp_at) AS level FROM l WHERE level <= clamp_at
), t AS (
  SELECT c.source, c.source_size, CASE WHEN g.level IS NULL THEN cap ELSE least(cap, weight * g.level) END AS target FROM c CROSS JOIN g
), p AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t
), r AS (
  SELECT h.doc_id, h.size, p.source_size, p.target, p.whole,
         sum(h.size) OVER (PARTITION BY h.source ORDER BY h.pos, h.doc_id, h.size ROWS UNBOUNDED PRECEDING) - h.size / 2 AS middle,
         least(p.source_size, greatest(0, p.target - p.whole * p.source_size)) AS wanted
  FROM h JOIN p ON h.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN middle < wanted THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
"""

OP7 = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), g AS (
  SELECT h, max(page_id) AS last FROM p GROUP BY h
)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + ((('0x' || substr(p.h, (5 * (k // 4) + 1)::INT, 5))::BIGINT >> (15 - 5 * (k % 4))) & 31)::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to
FROM p JOIN g USING (h)
"""

OP8 = f"""
WITH b AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item, array_to_string(w[i + 1 : i + 13], ' ') AS gram, least(len(w), 13) AS width
  FROM (SELECT item, w, unnest(range(greatest(len(w) - 12, 1))) AS i FROM b WHERE len(w) > 0)
), d AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents
), places AS (
  SELECT r, w, width, unnest(range(len(w) - width + 1)) AS i FROM d, (SELECT DISTINCT width FROM windows) WHERE len(w) >= width
), met AS (
  SELECT p.r, p.i, p.width, x.item FROM places p JOIN windows x ON x.width = p.width AND x.gram = array_to_string(p.w[p.i + 1 : p.i + p.width], ' ')
), words AS (
  SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + width)) AS k FROM met) GROUP BY r
), items AS (
  SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM met GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""

OP10 = f"""
WITH p AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages
), r AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM p
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""

def _op13_round(k: int) -> str:
    """Each part's nearest entry of codebook ``k``, and the next codebook."""
    return f"""a{k} AS MATERIALIZED (
  SELECT r, p, arg_min(e, d * 1000 + e) AS e, min(d) AS d FROM (
    SELECT x.r, x.p, b.e, list_sum(list_transform(list_zip(x.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM parts x JOIN b{k} b ON b.p = x.p
  ) GROUP BY r, p
), m{k} AS (
  SELECT p, e, list(m ORDER BY i) AS x FROM (
    SELECT a.p, a.e, i, floor(sum(x.x[i])::DOUBLE / count(*))::BIGINT AS m FROM a{k} a JOIN parts x ON x.r = a.r AND x.p = a.p, (SELECT unnest(range(1, 5)) AS i) GROUP BY a.p, a.e, i
  ) GROUP BY p, e
), b{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN m{k} m ON m.p = b.p AND m.e = b.e)"""


#: For vectors of 64 components.
OP13 = f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label,
         list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), parts AS MATERIALIZED (SELECT r, p, v[4 * p + 1 : 4 * p + 4] AS x FROM kept, (SELECT unnest(range(16)) AS p)
), b0 AS MATERIALIZED (SELECT p, r - 1 AS e, x FROM parts WHERE r <= 64
), {_op13_round(0)}, {_op13_round(1)}, {_op13_round(2)}, coded AS (
  SELECT r, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY r
), books AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS s FROM b2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, s AS codebooks_sha256 FROM kept JOIN coded USING (r), books
"""

ORACLE_SQL = {"op4_sharding": OP4, "op6_mixing": OP6, "op7_zip_warc": OP7, "op8_decontaminate": OP8, "op10_url_cascade": OP10, "op13_vector_codes": OP13}
