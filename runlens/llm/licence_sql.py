"""SQL of the licence query for DuckDB, made from the same templates and thresholds."""

from __future__ import annotations

from .licenses import NAMES, SETS, TAG, TAG_TERMS, THRESHOLD, tag_ids, template_terms


def licence_sql() -> str:
    """op3 in SQL: whole texts are split into lines, lines into terms; frequencies come from all documents."""
    values = ", ".join(f"('{n}', {k}, '{t}', {c}, {int(t in NAMES)})" for n, k, t, c in template_terms())
    ids = "MAP {" + ", ".join(f"'{x}': '{name}'" for x, name in tag_ids().items()) + "}"
    sets = ", ".join(f"('{name}', '{part}', {len(parts)})" for name, parts in SETS.items() for part in parts)
    words = lambda c: f"list_filter(regexp_split_to_array(lower({c}), '[^a-z0-9]+'), lambda x: x <> '')"
    # a unit that is like enough to a template holds one of its rarer terms; all units that hold one of these are scored
    rare = "licen|apache|gnu|creative|redistribution|mozilla|nc|by|mit|released|version|cc|form|bsd|clause|attribution|permission|software|copyright|public|universal|warrant|conditions|notice|zlib|isc|boost|eclipse|artistic|names|spdx|free|basis"
    blank = r"\n[ \t\r\n]*\n"
    return f"""WITH tt(licence, variant, term, c, name) AS (VALUES {values}), st(licence, part, size) AS (VALUES {sets}),
    d AS (SELECT doc_id, COALESCE(text, '') AS text, '/' || COALESCE(source, 'none') || '/' || COALESCE(lang, 'none') AS root, COALESCE(doc_id, -1) AS i FROM documents),
    files AS (SELECT row_number() OVER () AS rid, doc_id, text, CASE WHEN i % 32 = 0 THEN root ELSE root || '/' || CAST(CAST(floor(i / 4000.0) AS BIGINT) AS VARCHAR) || CASE WHEN i % 8 = 0 THEN '' ELSE '/' || CAST(CAST(floor(i / 500.0) AS BIGINT) AS VARCHAR) END END AS folder, i % 8 = 0 AS is_file, CASE WHEN i % 8 = 0 THEN '/LICENSE-' ELSE '/doc-' END || CAST(i AS VARCHAR) || '.txt' AS name FROM d),
    seen AS (SELECT term, COUNT(*) AS n FROM (SELECT DISTINCT rid, unnest({words('text')}) AS term FROM files) WHERE term IN (SELECT term FROM tt) GROUP BY 1),
    size AS (SELECT COUNT(*) AS n FROM files),
    idf AS (SELECT t.term, ln((1 + size.n) / (1.0 + COALESCE(seen.n, 0))) + 1 AS idf FROM (SELECT DISTINCT term FROM tt) t LEFT JOIN seen USING (term), size),
    tv AS (SELECT licence, variant, term, name, SUM(name) OVER (PARTITION BY licence, variant) AS needed, COUNT(*) OVER (PARTITION BY licence, variant) AS terms, c * idf / sqrt(SUM(c * idf * c * idf) OVER (PARTITION BY licence, variant)) AS tw FROM tt JOIN idf USING (term)),
    units AS (SELECT rid, unnest(range(len(u))) AS line, unnest(u) AS t FROM (SELECT rid, CASE WHEN is_file THEN list_concat(string_split(text, chr(10)), list_filter(regexp_split_to_array(text, '{blank}'), lambda b: contains(b, chr(10))), [text]) ELSE list_concat(string_split(text, chr(10)), list_filter(regexp_split_to_array(text, '{blank}'), lambda b: contains(b, chr(10)))) END AS u FROM files WHERE regexp_matches(lower(text), '(^|[^a-z0-9])({rare})'))),
    toks AS (SELECT rid, line, term, COUNT(*) AS k FROM (SELECT rid, line, unnest({words('t')}) AS term FROM units WHERE regexp_matches(lower(t), '(^|[^a-z0-9])({rare})')) GROUP BY ALL),
    w AS (SELECT rid, line, term, k * COALESCE(idf, (SELECT ln(1.0 + n) + 1 FROM size)) AS w FROM toks LEFT JOIN idf USING (term)),
    nr AS (SELECT rid, line, sqrt(SUM(w * w)) AS norm FROM w GROUP BY ALL),
    sc AS (SELECT rid, licence, terms, ROUND(SUM(w * tw) / norm, 6) AS score FROM w JOIN tv USING (term) JOIN nr USING (rid, line) GROUP BY rid, line, licence, variant, norm, needed, terms HAVING SUM(name) = needed),
    tags AS (SELECT rid, trim(regexp_replace(tag, '[ \\t]+', ' ', 'g')) AS tag, list_filter(string_split(lower(trim(regexp_replace(tag, '[() \\t]+', ' ', 'g'))), ' '), lambda x: x NOT IN ('or', 'and', 'with')) AS parts FROM (SELECT rid, unnest(regexp_extract_all(text, '{TAG}', 1)) AS tag FROM files)),
    told AS (SELECT rid, CASE WHEN len(parts) = 1 THEN {ids}[parts[1]] WHEN list_has_any(parts, map_keys({ids})) THEN tag END AS licence FROM tags),
    parts AS (SELECT rid, licence AS part, MAX(score) AS score, MAX(terms) AS terms FROM sc WHERE score >= {THRESHOLD} AND licence[1] = '+' GROUP BY ALL),
    all_of AS (SELECT rid, licence, terms, score, 1 AS own FROM sc WHERE score >= {THRESHOLD} AND licence[1] <> '+'
      UNION ALL SELECT rid, licence, SUM(terms), MIN(score), 0 FROM parts JOIN st USING (part) GROUP BY rid, licence, size HAVING COUNT(*) = size
      UNION ALL SELECT rid, licence, {TAG_TERMS}, 1.0, 1 FROM told WHERE licence IS NOT NULL),
    best AS (SELECT rid, licence, score FROM all_of QUALIFY row_number() OVER (PARTITION BY rid ORDER BY own DESC, score DESC, terms DESC, licence) = 1),
    own AS (SELECT f.rid, doc_id, folder || name AS path, folder, is_file, licence, score FROM files f LEFT JOIN best USING (rid)),
    given AS (SELECT folder AS above, licence AS given FROM own WHERE is_file AND licence IS NOT NULL QUALIFY row_number() OVER (PARTITION BY folder ORDER BY score DESC, path) = 1),
    near AS (SELECT f.folder, above, given FROM (SELECT DISTINCT folder FROM own) f JOIN given ON f.folder = above OR starts_with(f.folder, above || '/') QUALIFY row_number() OVER (PARTITION BY f.folder ORDER BY length(above) DESC) = 1)
    SELECT doc_id, path, COALESCE(licence, given) AS licence, score, CASE WHEN licence IS NOT NULL THEN 'notice' WHEN given IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin, CASE WHEN licence IS NULL THEN above END AS inherited_from FROM own LEFT JOIN near ON near.folder = own.folder"""
