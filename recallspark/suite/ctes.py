"""Plain-SQL restatement of the table mappings, for the comparison engine.

``sql(body, *names)`` prefixes ``body`` with the named common table expressions
and whatever they need, in order.
"""

from __future__ import annotations

WORD = r"[\p{L}\p{N}]+"


def stamp(base: str, hours: str) -> str:
    return (f"strftime(TIMESTAMP '{base} 00:00:00' + to_hours(CAST({hours} AS INTEGER)), "
            f"'%Y-%m-%dT%H:%M:%SZ')")


def tokens(text: str) -> str:
    """Lower-cased words plus identifier parts (no unspaced scripts in the data)."""
    cut = (
        "regexp_replace(regexp_replace(regexp_replace(w, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), "
        "'([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '([A-Z])([0-9])', '\\1 \\2', 'g')"
    )
    return (
        f"flatten(list_transform(regexp_extract_all({text}, '{WORD}'), lambda w: "
        f"list_concat([lower(w)], CASE WHEN regexp_full_match(w, '[A-Za-z0-9]+') AND "
        f"regexp_matches(w, '[a-z0-9][A-Z]|[A-Z][A-Z][a-z]|[A-Z][0-9]') "
        f"THEN list_filter(string_split(lower({cut}), ' '), lambda p: length(p) > 1) ELSE [] END)))"
    )


CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "memories": ((), f"""
SELECT d.lang AS project_id, md5('doc-' || d.doc_id) AS memory_id, 'doc-' || d.doc_id AS slug, d.doc_id,
  CASE WHEN l.toxic = 1 THEN 'wrong' WHEN l.quality = 0 THEN 'stale'
       WHEN d.doc_id % 11 = 0 THEN 'superseded' ELSE 'active' END AS status,
  d.text AS description, [d.lang] AS tags,
  list_filter(['source:' || d.source,
    CASE WHEN n_chars < 500 THEN 'size:small' WHEN n_chars < 2000 THEN 'size:medium'
         WHEN n_chars < 8000 THEN 'size:large' ELSE 'size:huge' END,
    CASE WHEN l.quality IS NOT NULL THEN 'kind:rated' END,
    CASE WHEN l.toxic = 1 THEN 'kind:toxic' END], lambda x: x IS NOT NULL) AS labels,
  ['record ' || d.doc_id] AS triggers,
  ['data/' || d.source || '.txt', 'bucket/' || (d.doc_id % 7) || '.txt'] AS files,
  d.source AS area,
  CASE WHEN d.doc_id % 97 <> 0 THEN {stamp('2020-01-01', 'd.doc_id')} END AS created,
  1 + d.doc_id % 4 AS tier,
  CASE WHEN d.doc_id % 5 <> 0 THEN {stamp('2020-02-01', 'd.doc_id')} END AS tier_since,
  d.doc_id % 500 AS tier_since_query,
  CASE WHEN d.doc_id % 13 = 0 THEN '2024-01-15T00:00:00Z' END AS archived_at,
  CASE WHEN d.doc_id % 3 = 0 THEN 'public' ELSE 'private' END AS visibility
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"""),
    "cached": ((), f"""
SELECT regexp_extract(html, '<html lang="([a-z]+)"', 1) AS project_id, md5('page-' || page_id) AS memory_id,
  'page-' || page_id AS slug, 'active' AS status, html AS description, ['source:web'] AS labels,
  regexp_extract(url, '//[^/]*\\.([a-z]+)/', 1) AS origin,
  {stamp('2024-01-01', 'page_id * 5')} AS cached_at
FROM pages"""),
    "questions": ((), """
SELECT item_id AS query_id, CASE WHEN regexp_matches(text, '[ñó]') THEN 'es'
  WHEN regexp_matches(text, '[çèê]') THEN 'fr' WHEN regexp_matches(text, '[äöüß]') THEN 'de'
  ELSE 'en' END AS project_id, text AS query FROM benchmark"""),
    "authored": ((), """
SELECT DISTINCT a.lang AS project_id, md5('doc-' || l_partkey) AS src, md5('doc-' || l_suppkey) AS dst,
  CASE WHEN l_returnflag = 'R' AND l_quantity > 45 THEN 'supersedes' ELSE 'related' END AS kind
FROM lineitem JOIN documents a ON a.doc_id = l_partkey JOIN documents b ON b.doc_id = l_suppkey
WHERE l_partkey <> l_suppkey AND a.lang = b.lang"""),
    "usage_events": ((), """
SELECT d.lang AS project_id, md5('doc-' || user_id) AS memory_id, 'r' || (event_id % 3) AS replica_id,
  date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) + event_id % 100 + 719163 AS day,
  CAST(event_type IN ('view', 'click') AS BIGINT) AS surfaced, CAST(event_type = 'click' AS BIGINT) AS direct,
  CAST(event_type = 'purchase' AS BIGINT) AS applied,
  strftime(CAST(ts AS DATE) + CAST(event_id % 100 AS INTEGER), '%Y-%m-%d') || 'T00:00:00Z' AS ts
FROM events JOIN documents d ON d.doc_id = user_id"""),
    "projects": (("usage_events",), "SELECT project_id, count(*) AS queries FROM usage_events GROUP BY 1"),
    "remotes": ((), """
SELECT 'remote-' || item_id AS name, text AS description, item_id % 5 <> 0 AS enabled FROM benchmark"""),
    "outbox": ((), """
SELECT o_orderkey AS id, md5('doc-' || o_custkey) AS memory_id, 'remote-' || (o_orderkey % 50) AS remote,
  strftime(o_orderdate, '%Y-%m-%d') || 'T00:00:00Z' AS queued_at, o_orderkey % 4 AS attempts FROM orders"""),
    "messages": ((), f"""
SELECT conv_id || '-' || turn AS id, 'client-' || (conv_id % 7) AS to_client, role AS from_client, text AS body,
  {stamp('2024-01-01', 'conv_id * 24 + turn')} AS sent_at,
  CASE WHEN turn % 3 = 0 THEN '2024-06-01T00:00:00Z' END AS read_at FROM conversations"""),
    "listing": ((), """
SELECT DISTINCT 'data/' || source || '.txt' AS path FROM documents WHERE NOT regexp_matches(source, '[048]$')
UNION SELECT DISTINCT 'bucket/' || (doc_id % 7) || '.txt' FROM documents WHERE doc_id % 7 < 3"""),
    "links": (("memories",), """
SELECT project_id, slug AS src, 'doc-' || (doc_id + 1) AS dst, 'related' AS kind,
  CASE WHEN doc_id % 29 = 0 THEN 'Near.' ELSE 'Next to it in the source.' END AS reason FROM memories WHERE doc_id % 3 <> 0
UNION ALL SELECT project_id, slug, 'doc-' || (doc_id - 1), 'related',
  CASE WHEN doc_id % 29 = 0 THEN 'Near.' ELSE 'Next to it in the source.' END FROM memories WHERE doc_id % 4 = 0
UNION ALL SELECT project_id, slug, 'doc-' || (doc_id - 2), 'supersedes', NULL FROM memories WHERE doc_id % 10 = 0"""),
    # Indexed rows: owned records and borrowed copies, one text per field.
    "corpus": (("memories", "cached"), """
SELECT project_id, memory_id, slug, archived_at IS NULL AS live, status, labels, CAST(NULL AS VARCHAR) AS origin,
  slug AS id_text, description, array_to_string(triggers, ' ') AS triggers, array_to_string(tags, ' ') AS tags,
  array_to_string(labels, ' ') AS labels_text, area || ' ' || array_to_string(files, ' ') AS scope_text FROM memories
UNION ALL
SELECT project_id, memory_id, slug, true, status, labels, origin, slug, description, '', '',
  array_to_string(labels, ' '), '' FROM cached"""),
    # One row per (record, token occurrence) with its field weight.
    "entries": (("corpus",), " UNION ALL ".join(
        f"SELECT memory_id, {w} AS w, strip_accents(unnest({t})) AS term FROM corpus"
        for w, t in [
            ("3.0::DOUBLE", f"list_distinct({tokens('id_text')})"),
            ("3.0::DOUBLE", f"list_distinct({tokens('description')})"),
            ("2.0::DOUBLE", f"list_distinct({tokens('triggers')})"),
            ("2.0::DOUBLE", f"list_distinct({tokens('tags')})"),
            ("1.0::DOUBLE", f"list_transform(regexp_extract_all(labels_text, '{WORD}'), lambda w: lower(w))"),
            ("1.0::DOUBLE", f"list_distinct({tokens('scope_text')})"),
        ])),
    "lengths": (("entries",), "SELECT memory_id, count(*)::DOUBLE AS dl FROM entries GROUP BY 1"),
    "corpus_stats": (("lengths", "corpus"), """
SELECT (SELECT count(*) FROM corpus)::DOUBLE AS n, (SELECT sum(dl) FROM lengths) / (SELECT count(*) FROM corpus) AS avgdl"""),
    "postings": (("entries",), "SELECT memory_id, term, sum(w) AS f FROM entries GROUP BY 1, 2"),
    "term_df": (("postings",), "SELECT term, count(*)::DOUBLE AS df FROM postings GROUP BY 1"),
    "query_terms": (("questions",), f"""
SELECT query_id, project_id, strip_accents(t) AS term, count(*)::DOUBLE AS times FROM (
  SELECT query_id, project_id, unnest(list_filter(list_distinct({tokens('query')}), lambda t: length(t) > 1)) AS t
  FROM questions) GROUP BY 1, 2, 3"""),
    "scored": (("query_terms", "term_df", "postings", "corpus", "lengths", "corpus_stats"), """
SELECT q.query_id, c.project_id, p.memory_id, c.slug,
  round(sum(q.times * (CASE WHEN ln((s.n - t.df + 0.5) / (t.df + 0.5)) <= 0 THEN 1e-6
     ELSE ln((s.n - t.df + 0.5) / (t.df + 0.5)) END)
    * p.f * 2.2 / (p.f + 1.2 * (0.25 + 0.75 * l.dl / s.avgdl))), 9) AS raw
FROM query_terms q JOIN term_df t USING (term) JOIN postings p USING (term)
JOIN corpus c ON c.memory_id = p.memory_id AND c.project_id = q.project_id AND c.live
JOIN lengths l ON l.memory_id = p.memory_id CROSS JOIN corpus_stats s GROUP BY 1, 2, 3, 4"""),
    "text_top": (("scored",), """
SELECT *, raw / max(raw) OVER (PARTITION BY query_id) AS text FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, memory_id) AS rn FROM scored) WHERE rn <= 50"""),
}


def sql(body: str, *names: str, extra: dict[str, tuple[tuple[str, ...], str]] | None = None,
        recursive: bool = False) -> str:
    known = {**CTES, **(extra or {})}
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for need in known[name][0]:
            visit(need)
        order.append(name)

    for name in names:
        visit(name)
    # Reused heavy steps are computed once.
    parts = [f"{n} AS MATERIALIZED ({known[n][1]})" for n in order]
    head = "WITH RECURSIVE " if recursive else "WITH "
    return (head + ",\n".join(parts) + "\n" + body) if parts else body
