"""SQL that gives the rows of those queries of this subpackage that SQL can express."""

from __future__ import annotations


def _field(column: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE CONCAT(strlen(CAST({column} AS VARCHAR)), ':', {column}) END"


def _crc32(text: str) -> str:
    """Unsigned CRC-32 of an ASCII string, bit by bit."""
    codes = f"list_transform(range(CAST(strlen({text}) AS BIGINT)), lambda i: CAST(ord(substr({text}, i + 1, 1)) AS BIGINT))"
    byte = "list_reduce(list_prepend(xor(c, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))"
    return f"xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda c, b: {byte}))"


def _tree(nodes: str, start: str) -> str:
    """Level by level, pairs of neighbours become their hash until a part has one node."""
    return f"""{nodes} AS (
    SELECT 0 AS lvl, part, idx, n, digest FROM {start}
    UNION ALL
    SELECT lvl + 1, part, idx // 2, (n + 1) // 2, pair FROM (
        SELECT *, sha256(CONCAT(digest, LEAD(digest) OVER (PARTITION BY part ORDER BY idx))) AS pair FROM {nodes}) AS x
    WHERE n > 1 AND idx % 2 = 0)"""


_LEAF = "sha256(CONCAT({}))"
_PARTS = ", ".join(map(_field, ("doc_id", "source", "lang")))

MERKLE = f"""
WITH RECURSIVE
leaf AS (
    SELECT doc_id, COALESCE('1' || lang, '0') AS part, {_LEAF.format(f"{_PARTS}, {_field('n_chars')}, {_field('text')}")} AS digest,
        {_LEAF.format(f"{_PARTS}, {_field('n_other')}, {_field('text')}")} AS other
    FROM (SELECT *, n_chars + CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 7 = 0 THEN 1 ELSE 0 END AS n_other FROM documents) AS d),
numbered AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY part ORDER BY doc_id NULLS FIRST, digest) - 1 AS idx, COUNT(*) OVER (PARTITION BY part) AS n FROM leaf),
{_tree("node", "numbered")},
top AS (SELECT part, digest, ROW_NUMBER() OVER (ORDER BY part) - 1 AS idx, COUNT(*) OVER () AS n FROM node WHERE n = 1),
start AS (SELECT 'all' AS part, idx, n, digest FROM top),
{_tree("upper", "start")},
placed AS (SELECT x.doc_id, x.part, x.idx, x.digest AS leaf, x.other, t.idx AS top_idx, t.digest AS subroot, (SELECT digest FROM upper WHERE n = 1) AS root, ROW_NUMBER() OVER () AS r
    FROM numbered AS x JOIN top AS t ON t.part = x.part),
beside AS (
    SELECT p.r, 0 AS tree, s.lvl, p.idx >> s.lvl AS at, CASE WHEN s.digest IS NULL THEN '' ELSE s.digest END AS sibling
    FROM placed AS p JOIN node AS o ON o.part = p.part AND o.idx = p.idx >> o.lvl AND o.n > 1 JOIN (
        SELECT a.part, a.lvl, a.idx, b.digest FROM node AS a LEFT JOIN node AS b ON b.part = a.part AND b.lvl = a.lvl AND b.idx = xor(a.idx, 1)) AS s
        ON s.part = o.part AND s.lvl = o.lvl AND s.idx = o.idx
    UNION ALL
    SELECT p.r, 1, s.lvl, p.top_idx >> s.lvl, COALESCE(s.digest, '')
    FROM placed AS p JOIN upper AS o ON o.idx = p.top_idx >> o.lvl AND o.n > 1 JOIN (
        SELECT a.lvl, a.idx, b.digest FROM upper AS a LEFT JOIN upper AS b ON b.lvl = a.lvl AND b.idx = xor(a.idx, 1)) AS s
        ON s.lvl = o.lvl AND s.idx = o.idx),
steps AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY r ORDER BY tree, lvl) AS step FROM beside),
proofs AS (SELECT r, STRING_AGG(sibling, '' ORDER BY step) AS proof, MAX(step) AS last FROM steps GROUP BY r),
fold AS (
    SELECT r, CAST(0 AS BIGINT) AS step, other AS digest FROM placed
    UNION ALL
    SELECT f.r, s.step, sha256(CASE WHEN s.at % 2 = 0 THEN CONCAT(f.digest, s.sibling) ELSE CONCAT(s.sibling, f.digest) END)
    FROM fold AS f JOIN steps AS s ON s.r = f.r AND s.step = f.step + 1)
SELECT p.doc_id, p.leaf, p.subroot, p.root, sha256(COALESCE(q.proof, '')) AS proof_sha256, f.digest AS folded_root, f.digest = p.root AS verified
FROM placed AS p LEFT JOIN proofs AS q ON q.r = p.r JOIN fold AS f ON f.r = p.r AND f.step = COALESCE(q.last, 0)
"""

MIXING = rf"""
WITH sized AS (
    SELECT doc_id, source, CAST(COALESCE(LEN(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
        CAST('0x' || substr(md5(CONCAT('mix', {_field("doc_id")}, text)), 1, 15) AS BIGINT) AS hash
    FROM documents),
named AS (SELECT source, CAST(SUM(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, ([3, 1, 2])[1 + (ROW_NUMBER() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM named),
-- In order of the level at which a source is full, the first one that the level of those before it does not fill ends the search.
filled AS (
    SELECT *, (1.5 * SUM(source_size) OVER () - 2 * (SUM(source_size) OVER up - source_size)) / CAST(SUM(weight) OVER () - SUM(weight) OVER up + weight AS DOUBLE) AS level, ROW_NUMBER() OVER up AS place
    FROM weighed WINDOW up AS (ORDER BY source_size / CAST(weight AS DOUBLE), source ROWS UNBOUNDED PRECEDING)),
target AS (SELECT source, source_size, LEAST(2.0 * source_size, (SELECT COALESCE(ARG_MIN(level, place) FILTER (WHERE 2 * source_size >= level * weight), 0) FROM filled) * weight) AS target FROM weighed),
plan AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(ROUND(target) AS BIGINT) // source_size ELSE 0 END AS turns FROM target),
placed AS (
    SELECT s.*, p.source_size, p.target, p.turns, CAST(ROUND(p.target) AS BIGINT) - p.turns * p.source_size AS extra,
        CAST(SUM(size) OVER (PARTITION BY s.source, hash) AS BIGINT) AS inside, CAST(SUM(size) OVER (PARTITION BY s.source ORDER BY hash) AS BIGINT) AS through
    FROM sized AS s JOIN plan AS p ON p.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target,
    CAST(turns * size + CASE WHEN inside > 0 THEN size * GREATEST(0, LEAST(extra - (through - inside), inside)) // inside ELSE 0 END AS BIGINT) AS taken
FROM placed
"""

ORACLE_SQL: dict[str, str] = {"op12_merkle_manifest": MERKLE, "op13_source_mixing": MIXING}
