"""DuckDB forms of the operators that SQL can express: the URL filter, the secret scan, decontamination."""

from __future__ import annotations

from .decontaminate import LOWER, UPPER, WINDOW, WORD
from .secret_scan import CANDIDATE, KINDS, MAX_OWNERS
from .url_graph import DAMPING, LEAST, LINK, RULES


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _walks(name: str, src: str, dst: str, seeds: str) -> str:
    """Rounds of walks of a personalised PageRank over ``links``, while one brings some host ``LEAST``."""
    return f"""{name}_share AS (
  SELECT {src} AS src, {dst} AS dst, n::DOUBLE / sum(n) OVER (PARTITION BY {src}) AS share FROM links
), {name}_walk AS (
  SELECT host, {1 - DAMPING!r}::DOUBLE AS x FROM hosts WHERE {seeds}
  UNION ALL
  SELECT dst, x FROM (
    SELECT s.dst, sum(s.share * w.x) * {DAMPING!r} AS x, max(sum(s.share * w.x)) OVER () * {DAMPING!r} AS top
    FROM {name}_walk w JOIN {name}_share s ON s.src = w.host GROUP BY s.dst
  ) WHERE top >= {LEAST!r}
), {name} AS (SELECT host, sum(x) AS score FROM {name}_walk GROUP BY host),
"""


def url_sql() -> str:
    fits = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    when = lambda value: "CASE " + " ".join(
        f"WHEN (host = {quoted(h)} OR ends_with(host, {quoted('.' + h)})) AND starts_with(path, {quoted(p)}) THEN {quoted(value(a, h, p))}" for a, h, p in fits
    ) + " END"
    url = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return f"""
WITH RECURSIVE parts AS (
  SELECT page_id, html, translate(regexp_extract(coalesce(url, ''), {quoted(url)}, 1), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(coalesce(url, ''), {quoted(url)}, 2) AS path
  FROM pages
), ruled AS (
  SELECT *, {when(lambda a, h, p: h + p)} AS rule, {when(lambda a, h, p: a)} AS action FROM parts
), hosts AS (
  SELECT host, count(*) AS n, count(*) FILTER (action = 'allow') AS good, count(*) FILTER (action = 'block') AS bad
  FROM ruled WHERE host <> '' GROUP BY host
), targets AS (
  SELECT host AS src, translate(unnest(regexp_extract_all(html, {quoted(LINK)}, 1)), '{UPPER}', '{LOWER}') AS dst FROM parts
), links AS (
  SELECT src, dst, count(*) AS n FROM targets WHERE src <> '' AND src <> dst GROUP BY src, dst
),
{_walks("trust", "src", "dst", "2 * good > n")}{_walks("distrust", "dst", "src", "2 * bad > n")}scores AS (
  SELECT host, round(coalesce(t.score, 0), 10) AS trust, round(coalesce(d.score, 0), 10) AS distrust
  FROM trust t FULL JOIN distrust d USING (host)
)
SELECT page_id, host, path, rule,
  coalesce(action, CASE WHEN coalesce(distrust, 0) > coalesce(trust, 0) THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled LEFT JOIN scores USING (host)
"""


def _kind_rows(kind: str, rank: int, pattern: str, least: int, group: int) -> str:
    p = quoted(pattern)
    return f"""
  SELECT rid, doc_id, source, {rank} AS rank, '{kind}' AS kind, v[i] AS value,
    list_sum(list_transform(gaps[:i], lambda g: length(g))) + coalesce(list_sum(list_transform(m[:i - 1], lambda g: length(g))), 0) AS s, length(m[i]) AS l
  FROM (
    SELECT rid, doc_id, source, string_split_regex(text, {p}) AS gaps, regexp_extract_all(text, {p}) AS m,
      regexp_extract_all(text, {p}, {group}) AS v
    FROM docs
  ) CROSS JOIN unnest(range(1, len(m) + 1)) AS t(i)
  WHERE length(v[i]) >= {least}"""


def secret_sql() -> str:
    base = " UNION ALL ".join(_kind_rows(k, i, p, n, g) for i, (k, p, n, g) in enumerate(KINDS))
    place = "kind || ':' || s::BIGINT || ':' || (s + l)::BIGINT"
    shown = f"string_agg({place}, ',' ORDER BY s, rank)"
    judged = f"string_agg({place} || CASE WHEN owners <= {MAX_OWNERS} THEN ':live:' ELSE ':copied:' END || owners || ':' || repositories, ',' ORDER BY s, rank)"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
base AS ({base}),
candidates AS ({_kind_rows("owned", len(KINDS), CANDIDATE, 20, 0)}),
mixed AS (
  SELECT * FROM candidates c
  WHERE length(regexp_replace(value, '[^0-9]', '', 'g')) >= 4 AND length(regexp_replace(value, '[^A-Za-z]', '', 'g')) >= 4
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = c.rid AND b.s < c.s + c.l AND c.s < b.s + b.l)
),
held AS (
  SELECT value, count(DISTINCT coalesce('=' || source, '')) AS owners, count(DISTINCT coalesce('=' || doc_id, '')) AS repositories
  FROM (SELECT * FROM base UNION ALL SELECT * FROM mixed) GROUP BY value
),
every AS (
  SELECT * FROM (SELECT * FROM base UNION ALL SELECT * FROM mixed) JOIN held USING (value) WHERE kind <> 'owned' OR owners <= {MAX_OWNERS}
),
counted AS (
  SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
    count(*) FILTER (kind = 'hex') AS n_hex, {shown} FILTER (kind <> 'owned') AS base, {shown} AS spans, {judged} AS verdicts
  FROM every GROUP BY rid
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(verdicts, '') AS verdicts
FROM docs LEFT JOIN counted USING (rid)
"""


def benchmark_sql() -> str:
    words = lambda c: f"regexp_extract_all(translate(coalesce({c}, ''), '{UPPER}', '{LOWER}'), {quoted(WORD)})"
    return f"""
WITH items AS (SELECT item_id::VARCHAR AS item_id, {words("text")} AS w FROM benchmark),
sized AS (SELECT item_id, w, least(len(w), {WINDOW}) AS l FROM items WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT item_id, l, array_to_string(w[i:i + l - 1], ' ') AS win
  FROM sized CROSS JOIN unnest(range(1, len(w) - l + 2)) AS t(i)
),
docs AS (SELECT row_number() OVER () AS rid, doc_id, {words("text")} AS w FROM documents),
spans AS (
  SELECT rid, i, l, array_to_string(w[i:i + l - 1], ' ') AS win
  FROM docs CROSS JOIN (SELECT DISTINCT l FROM windows) CROSS JOIN unnest(range(1, greatest(len(w) - l + 2, 1))) AS t(i)
),
hits AS (SELECT rid, i, l, item_id FROM spans JOIN windows USING (win, l)),
words_hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM hits CROSS JOIN unnest(range(i, i + l)) AS t(p) GROUP BY rid),
items_hit AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT rid, item_id FROM hits) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words_hit USING (rid) LEFT JOIN items_hit USING (rid)
"""


ORACLE = {"op5_url_link_graph": url_sql(), "op8_secret_ownership": secret_sql(), "op9_benchmark_winnowing": benchmark_sql()}
