"""The same results in plain SQL, for the operators of blobs, negatives and the manifest."""

from __future__ import annotations

# Formats in the pattern language of the SQL engine: kind, pattern, group, least length of the group.
SECRETS = [
    ("assign", r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
    ("pem", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY-----", 0, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
    ("hosted", r"gh[oprsu]_[A-Za-z0-9]{36,}", 0, 0),
]


def _ledger_sql() -> str:
    kinds = "\n    UNION ALL ".join(
        f"""SELECT r, '{kind}' AS kind, {place} AS place, regexp_extract_all(t, '{pattern}') AS v, string_split_regex(t, '{pattern}') AS g,
        regexp_extract_all(t, '{pattern}', {group}) AS own, {least} AS least FROM d"""
        for place, (kind, pattern, group, least) in enumerate(SECRETS)
    )
    return f"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), m AS (
    {kinds}
), s AS (
    SELECT r, kind, place, v, g, own, least, unnest(range(1, len(v) + 1)) AS k FROM m
), p AS (
    SELECT r, kind, place, length(array_to_string(g[1:k], '')) + length(array_to_string(v[1:k - 1], '')) AS b, length(v[k]) AS n
    FROM s WHERE length(own[k]) >= least
), x AS (
    SELECT r, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
        string_agg(kind || ':' || b || ':' || (b + n), ',' ORDER BY b, place) FILTER (WHERE place < 3) AS base,
        string_agg(kind || ':' || b || ':' || (b + n), ',' ORDER BY b, place) AS spans
    FROM p GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
    sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN x USING (r)
"""


NEGATIVES = """
WITH e AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY 2, 3) = 1
), s AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
        list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::BIGINT AS score
    FROM e AS a JOIN e AS b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), p AS (
    SELECT anchor_id, id, score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.id AS positive_id, (row_number() OVER w)::INTEGER AS rank, n.id AS negative_id,
    p.score AS positive_score, n.score AS negative_score
FROM p JOIN s AS n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id)
QUALIFY row_number() OVER w <= 3
"""

MANIFEST = """
WITH RECURSIVE tab AS (
    SELECT list(list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384)) ORDER BY b) AS codes
    FROM (SELECT unnest(range(256)) AS b)
), f AS (
    SELECT row_number() OVER () AS r, doc_id, lang, text,
        coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
            || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
        xor(4294967295, list_reduce(
            list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
            lambda c, b: xor(c >> 8, tab.codes[1 + (xor(c, b) & 255)]))) % 3 = 0 AS hit
    FROM documents, tab
), l AS (
    SELECT r, doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
        CASE WHEN hit THEN sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS lowered
    FROM f
), o AS (
    SELECT *, coalesce('=' || lang, '') AS key, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM l
), g AS (
    SELECT key, 0 AS level, i, leaf AS d, count(*) OVER (PARTITION BY key) AS n FROM o
    UNION ALL
    SELECT key, level + 1, i // 8, sha256(string_agg(d, '' ORDER BY i)), (any_value(n) + 7) // 8 FROM g WHERE n > 1 GROUP BY key, level, i // 8
), sub AS (
    SELECT key, level AS m, d AS subroot, row_number() OVER (ORDER BY encode(key)) - 1 AS j FROM g WHERE n = 1
), u AS (
    SELECT 0 AS level, j AS i, subroot AS d, count(*) OVER () AS n FROM sub
    UNION ALL
    SELECT level + 1, i // 8, sha256(string_agg(d, '' ORDER BY i)), (any_value(n) + 7) // 8 FROM u WHERE n > 1 GROUP BY level, i // 8
), steps AS (
    SELECT key, level, i // 8 AS run, list(d ORDER BY i) AS ds FROM g WHERE n > 1 GROUP BY ALL
    UNION ALL
    SELECT key, m + level, i // 8, list(d ORDER BY i) FROM u, sub WHERE n > 1 GROUP BY ALL
), path AS (
    SELECT r, o.key, 0 AS level, CASE WHEN m = 0 THEN j ELSE i END AS i, '' AS proof, coalesce(lowered, leaf) AS t
    FROM o JOIN sub ON sub.key = o.key
    UNION ALL
    SELECT p.r, p.key, p.level + 1, CASE WHEN p.level + 1 = sub.m THEN sub.j ELSE p.i // 8 END,
        p.proof || array_to_string(ds[1:p.i % 8], '') || array_to_string(ds[p.i % 8 + 2:], ''),
        sha256(array_to_string(ds[1:p.i % 8], '') || p.t || array_to_string(ds[p.i % 8 + 2:], ''))
    FROM path AS p JOIN steps AS s ON s.key = p.key AND s.level = p.level AND s.run = p.i // 8 JOIN sub ON sub.key = p.key
), last AS (
    SELECT r, proof, t FROM path QUALIFY row_number() OVER (PARTITION BY r ORDER BY level DESC) = 1
), top AS (
    SELECT d AS root FROM u WHERE n = 1
)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, t AS folded_root, t = root AS verified
FROM o JOIN sub ON sub.key = o.key JOIN last ON last.r = o.r, top
"""

ORACLE_SQL = {"op11_blob_ledger": _ledger_sql(), "op12_hard_negatives": NEGATIVES, "op13_merkle_manifest": MANIFEST}
