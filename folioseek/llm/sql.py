"""SQL, for DuckDB, of operators that run Python."""

from __future__ import annotations

import zlib

from folioseek.llm import urls

#: The register that each byte leaves behind in CRC-32, by rule: from the library's CRC begun at 0.
CRC_TABLE = [zlib.crc32(bytes([i]), 0xFFFFFFFF) ^ 0xFFFFFFFF for i in range(256)]

OP12_SQL = rf"""
WITH texts AS (
    SELECT 0 AS side, row_number() OVER () AS row, doc_id, text FROM documents
    UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark
), cut AS (
    SELECT side, row, doc_id, list_filter(string_split_regex(
        translate(coalesce(text, ''), '{urls.UPPER}', '{urls.LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
    FROM texts
), runs AS (
    SELECT side, row, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS feature FROM cut
), counted AS (SELECT side, row, feature, count(*) AS n FROM runs GROUP BY ALL
), crc AS (
    SELECT feature, xor(list_reduce(list_transform(range(1, octet_length(encode(feature)) + 1),
        lambda i: CAST('0x' || substr(hex(encode(feature)), CAST(2 * i - 1 AS INT), 2) AS BIGINT)),
        lambda r, b: xor(r >> 8, {CRC_TABLE}[CAST(xor(r, b) & 255 AS INT) + 1]), 4294967295), 4294967295) % 10000 AS bucket
    FROM (SELECT DISTINCT feature FROM runs)
), totals AS (
    SELECT bucket, sum(CASE WHEN side = 0 THEN n ELSE 0 END) AS s, sum(CASE WHEN side = 1 THEN n ELSE 0 END) AS t
    FROM counted JOIN crc USING (feature) GROUP BY bucket
), gains AS (
    SELECT bucket, CAST(floor(1000 * ln((CAST(t AS DOUBLE) + 1) * (CAST((SELECT sum(s) FROM totals) AS DOUBLE) + 10000)
        / ((CAST(s AS DOUBLE) + 1) * (CAST((SELECT sum(t) FROM totals) AS DOUBLE) + 10000)))) AS BIGINT) AS gain
    FROM totals
), weighed AS (
    SELECT row, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS total
    FROM counted JOIN crc USING (feature) JOIN gains USING (bucket) WHERE side = 0 GROUP BY row
), scored AS (
    SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features,
        coalesce((total - ((total % n_features) + n_features) % n_features) // n_features, 0) AS weight,
        CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS noise
    FROM cut LEFT JOIN weighed USING (row) WHERE side = 0
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY weight + noise DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_words >= 20) AS fit
    FROM scored
)
SELECT doc_id, n_features, weight, weight + noise AS score, CASE WHEN n_words >= 20 AND place <= 25 * fit // 100 THEN place END AS rank
FROM ranked
"""

#: All pairs of equal labels; a component is the least id within reach.
OP13_SQL = """
WITH RECURSIVE v AS (
    SELECT row_number() OVER () AS row, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), fit AS (
    SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS size FROM v
    WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(e) > 0
        AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.row AS x, b.row AS y FROM fit a JOIN fit b ON a.label = b.label AND a.row <> b.row AND len(a.e) = len(b.e)
    WHERE list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.98
), reach AS (
    SELECT row AS x, row AS y FROM v UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x
), least AS (
    SELECT x, min(vec_id) AS component_id FROM reach JOIN v ON reach.y = v.row GROUP BY x
), degree AS (SELECT x, count(*) AS n_links FROM links GROUP BY x)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN least ON v.row = least.x LEFT JOIN degree ON v.row = degree.x
"""
