"""DuckDB statements of the training-data queries that SQL can express."""

from __future__ import annotations

FILL_IN_MIDDLE = r"""
WITH drawn AS (
    SELECT doc_id, coalesce(text, '') AS text,
        sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest,
        regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units
    FROM documents
),
numbered AS (
    SELECT doc_id, text, units, len(units) AS n,
        CAST('0x' || substr(digest, 1, 8) AS BIGINT) % (len(units) + 1) AS c1,
        CAST('0x' || substr(digest, 9, 8) AS BIGINT) % (len(units) + 1) AS c2,
        CAST('0x' || substr(digest, 17, 8) AS BIGINT) % 100 AS p3,
        CAST('0x' || substr(digest, 25, 8) AS BIGINT) % 100 AS p4
    FROM drawn
),
cut AS (
    SELECT doc_id, text, n,
        CASE
            WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR p3 >= 50
                THEN 'plain'
            WHEN p4 < 80 THEN 'spm'
            ELSE 'psm'
        END AS form,
        array_to_string(units[1:least(c1, c2)], '') AS a,
        array_to_string(units[least(c1, c2) + 1:greatest(c1, c2)], '') AS b,
        array_to_string(units[greatest(c1, c2) + 1:], '') AS c
    FROM numbered
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
    CASE WHEN form <> 'plain' THEN CAST(length(a) AS BIGINT) END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN CAST(length(b) AS BIGINT) END AS middle_chars,
    sha256(CASE form
        WHEN 'plain' THEN text
        WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b
        ELSE '<S>' || c || '<P>' || a || '<M>' || b
    END) AS output_sha256,
    sha256(text) AS restored_sha256
FROM cut
"""

HARD_NEGATIVES = """
WITH usable AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
anchors AS (SELECT DISTINCT vec_id, label, v FROM usable WHERE vec_id % 100 = 0),
scored AS (
    SELECT a.vec_id AS anchor_id, a.v AS av, a.label AS al, c.vec_id, a.label = c.label AS same,
        CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score
    FROM anchors a JOIN usable c ON c.vec_id <> a.vec_id AND len(c.v) = len(a.v)
),
positives AS (
    SELECT *, row_number() OVER () AS positive_row
    FROM (
        SELECT *, row_number() OVER (PARTITION BY anchor_id, av, al ORDER BY score DESC, vec_id) AS place
        FROM scored WHERE same
    )
    WHERE place <= 5
),
negatives AS (
    SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id,
        p.score AS positive_score, n.score AS negative_score,
        row_number() OVER (PARTITION BY p.positive_row ORDER BY n.score DESC, n.vec_id) AS rank
    FROM positives p
    JOIN scored n ON n.anchor_id = p.anchor_id AND n.av = p.av AND n.al = p.al AND NOT n.same
        AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
)
SELECT n.anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM negatives n
WHERE rank <= 10
"""


def _attribute(name: str) -> str:
    pattern = rf"""\s{name}\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))"""
    found = " || ".join(f"regexp_extract(tag, '{pattern}', {i}, 'is')" for i in (1, 2, 3))
    return f"trim(regexp_replace({found}, '&amp;', '&', 'gi'))"


def _host(url: str) -> str:
    lowered = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return lowered.format(f"regexp_extract(coalesce({url}, ''), '://([^/?#]*)', 1)")


def _path(url: str) -> str:
    return f"regexp_extract(coalesce({url}, ''), '://[^/?#]*([^?#]*)', 1)"


def _alias(url: str) -> str:
    path, query = _path(url), rf"regexp_extract(coalesce({url}, ''), '://[^?#]*(\?[^#]*)', 1)"
    return (
        f"CASE WHEN {_host(url)} <> '' THEN {_host(url)} || "
        f"CASE WHEN {path} = '' THEN '/' ELSE {path} END || {query} END"
    )


def _without_dots(path: str) -> str:
    parts = f"string_split({path}, '/')"
    kept = (
        f"list_reduce(list_prepend([''], list_transform(({parts})[2:], lambda x: [x])), lambda seen, part: CASE "
        "WHEN part[1] = '..' THEN seen[1:greatest(len(seen) - 1, 1)] "
        "WHEN part[1] = '.' THEN seen ELSE seen || part END)"
    )
    return f"array_to_string(CASE WHEN ({parts})[-1] IN ('.', '..') THEN {kept} || [''] ELSE {kept} END, '/')"


#: Host, path, verdict.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]

_RULE_ROWS = ", ".join(f"('{host}', '{path}', '{verdict}')" for host, path, verdict in RULES)
_SKIPPED = r"<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
_REFRESH = r"^[\d.\s]*[;,]\s*url\s*=\s*[''\"]?([^''\"]*)"

URL_FILTER = rf"""
WITH RECURSIVE rules(rule_host, rule_path, verdict) AS (VALUES {_RULE_ROWS}),
placed AS (
    SELECT page_id, {_host("url")} AS host, {_path("url")} AS path, {_alias("url")} AS alias FROM pages
),
tags AS (
    SELECT url, unnest(regexp_extract_all(
        regexp_replace(html, '{_SKIPPED}', '', 'gis'), '<(?:link|meta)\b[^>]*>', 0, 'is')) AS tag
    FROM pages
    WHERE regexp_matches(html, 'canonical|refresh', 'i') AND contains(url, '://')
),
targets AS (
    SELECT url, CASE
        WHEN regexp_matches(tag, '^<link', 'i')
            AND list_contains(regexp_split_to_array(lower({_attribute("rel")}), '\s+'), 'canonical')
            THEN {_attribute("href")}
        WHEN regexp_matches(tag, '^<meta', 'i') AND lower({_attribute("http-equiv")}) = 'refresh'
            THEN trim(regexp_extract({_attribute("content")}, '{_REFRESH}', 1, 'is'))
        END AS target
    FROM tags
),
parts AS (
    SELECT url, target, regexp_extract(url, '^([^:/?#]*)://', 1) AS scheme, {_host("url")} AS host,
        {_path("url")} AS path, regexp_extract(target, '^([^?#]*)', 1) AS bare,
        regexp_extract(target, '^[^?#]*(.*)$', 1) AS rest
    FROM targets WHERE target <> ''
),
joined AS (
    SELECT url, CASE
        WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.\-]*:') THEN target
        WHEN starts_with(target, '//') THEN scheme || ':' || target
        WHEN starts_with(target, '/') THEN scheme || '://' || host || {_without_dots("bare")} || rest
        WHEN bare = '' THEN scheme || '://' || host || path || rest
        ELSE scheme || '://' || host || {_without_dots(
            "(regexp_extract(CASE WHEN path = '' THEN '/' ELSE path END, '^(.*/)', 1) || bare)")} || rest
        END AS target
    FROM parts
),
links AS (
    SELECT {_alias("url")} AS a, {_alias("target")} AS b FROM joined
),
edges AS (
    SELECT a, b FROM links WHERE a IS NOT NULL AND b IS NOT NULL
    UNION SELECT b, a FROM links WHERE a IS NOT NULL AND b IS NOT NULL
),
reached AS (
    SELECT a AS node, a AS other FROM edges
    UNION SELECT r.node, e.b FROM reached r JOIN edges e ON e.a = r.other
),
places AS (
    SELECT host, path FROM placed
    UNION SELECT regexp_extract(a, '^([^/]*)', 1), regexp_extract(a, '^[^/]*([^?]*)', 1) FROM edges
),
ruled AS (
    SELECT host, path, rule_host || rule_path AS rule, verdict
    FROM places JOIN rules
        ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
    QUALIFY row_number() OVER (
        PARTITION BY host, path ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) = 1
),
classes AS (
    SELECT r.node AS alias, min(u.verdict) AS alias_verdict
    FROM reached r JOIN ruled u
        ON u.host = regexp_extract(r.other, '^([^/]*)', 1) AND u.path = regexp_extract(r.other, '^[^/]*([^?]*)', 1)
    GROUP BY r.node
)
SELECT p.page_id, p.host, p.path, u.rule, coalesce(u.verdict, c.alias_verdict, 'allow') AS verdict,
    u.rule IS NULL AND c.alias_verdict IS NOT NULL AS via_alias
FROM placed p
LEFT JOIN ruled u ON u.host = p.host AND u.path = p.path
LEFT JOIN classes c ON c.alias = p.alias
"""
