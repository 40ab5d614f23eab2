"""Parts of SQL twins that several modules use."""

from __future__ import annotations

from sheetmill.functions import values
from sheetmill.operators.retrieval import STOP_WORDS


def texts(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def keywords(source: str, name: str) -> str:
    """CTEs that end with ``name(query_id, query, words)``: the keywords of each query of ``source``."""
    near = "list_concat(" * (len(values.FIGURE_SYNONYMS) - 1)
    looked = [f"CASE WHEN len(list_filter(base, lambda w: contains(w, '{k}') OR contains('{k}', w))) > 0 THEN {texts(v)} ELSE [] END" for k, v in values.FIGURE_SYNONYMS.items()]
    near += looked[0] + "".join(f", {x})" for x in looked[1:])
    return rf"""{name}_q AS (SELECT query_id, query, lower(trim(query)) AS q FROM {source}),
{name}_b AS (SELECT query_id, query, list_filter(list_distinct(list_concat(
  list_concat(list_filter(regexp_extract_all(q, '\b[a-z]*[0-9]{{2,}}[a-z0-9]*\b'), lambda w: length(w) >= 3), list_filter(regexp_split_to_array(q, '[\s,，、;；:：]+'), lambda w: w <> '')),
  list_concat(flatten(list_transform(regexp_extract_all(q, '[一-鿿]{{2,}}'), lambda r: flatten(list_transform(range(1, length(r)), lambda i: list_transform(range(i + 1, length(r) + 1), lambda j: substring(r, i, j - i + 1)))))), regexp_extract_all(q, '[a-z]{{2,}}')))),
  lambda w: NOT list_contains({texts(values.FIGURE_STOP_WORDS)}, w)) AS base FROM {name}_q),
{name} AS (SELECT query_id, query, list_distinct(list_concat(base, {near})) AS words FROM {name}_b)"""


_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def tokens(text: str) -> str:
    """The words of a text as ``retrieval.tokens`` gives them."""
    pairs = "CASE WHEN regexp_matches(v, '^[一-龥][一-龥]') THEN list_transform(range(1, length(v)), lambda k: substring(v, k, 2)) ELSE [v] END"
    words = f"regexp_split_to_array(regexp_replace(lower(coalesce({text}, '')), '([一-龥]+)', ' \\1 ', 'g'), '[^\\p{{L}}\\p{{N}}_]+')"
    return f"list_filter(flatten(list_transform({words}, lambda v: {pairs})), lambda t: length(t) > 1 AND t NOT IN ({_STOP}))"


COLLAPSED = r"trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))"
SENTENCES = r"regexp_extract_all(t, '([^。！？!?.]*(?:\.[^\s.。！？!?][^。！？!?.]*)*(?:[。！？!?]|\.+(?:\s|$)|\.+|$))', 1)"


def chunks(source: str, size: int = 800, overlap: int = 200) -> str:
    """CTEs (of a WITH RECURSIVE) that end with ``ck(document_id, page, pos, chunk)``: packed chunks of ``source(document_id, page, text)``.

    Chunks follow from each other: where one ends, and which of its last pieces the next repeats.
    """
    width = lambda a, b: f"(c[{b}] - coalesce(c[{a} - 1], 0) + {b} - ({a}))"
    return f"""ck_s AS (SELECT document_id, page, list_filter(list_transform({SENTENCES}, lambda x: trim(x)), lambda x: length(x) > 0) AS s FROM (SELECT document_id, page, {COLLAPSED} AS t FROM {source})),
ck_p AS MATERIALIZED (SELECT document_id, page, flatten(list_transform(s, lambda x: CASE WHEN length(x) > {size} THEN list_transform(range(0, length(x), {size - overlap}), lambda k: substring(x, k + 1, {size})) ELSE [x] END)) AS p FROM ck_s WHERE len(s) > 0),
ck_l AS (SELECT document_id, page, generate_subscripts(p, 1) AS i, length(unnest(p)) AS l FROM ck_p),
ck_w AS MATERIALIZED (SELECT document_id, page, list(c ORDER BY i) AS c, count(*) AS n FROM (SELECT document_id, page, i, CAST(sum(l) OVER (PARTITION BY document_id, page ORDER BY i) AS BIGINT) AS c FROM ck_l) GROUP BY document_id, page),
ck_r(document_id, page, pos, a, b) AS (
  SELECT document_id, page, CAST(0 AS BIGINT), CAST(1 AS BIGINT), list_max(list_filter(range(1, least(n, {size + 1}) + 1), lambda j: j = 1 OR {width('1', 'j')} <= {size})) FROM ck_w
  UNION ALL
  SELECT document_id, page, pos + 1, s, list_max(list_filter(range(b + 1, least(n, b + {size + 1}) + 1), lambda j: j = b + 1 OR {width('s', 'j')} <= {size})) FROM (
    SELECT *, CASE WHEN t IS NOT NULL AND {width('t', '(b + 1)')} <= {size} THEN t ELSE b + 1 END AS s FROM (
      SELECT r.*, w.c, w.n, list_min(list_filter(range(a, b + 1), lambda q: {width('q', 'b')} <= {overlap})) AS t FROM ck_r r JOIN ck_w w ON w.document_id = r.document_id AND w.page = r.page WHERE b < n))),
ck AS MATERIALIZED (SELECT r.document_id, r.page, r.pos, array_to_string(p[a:b], ' ') AS chunk FROM ck_r r JOIN ck_p p ON p.document_id = r.document_id AND p.page = r.page)"""
