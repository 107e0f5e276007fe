"""DuckDB SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

from .licenses import COPYRIGHT, KNOWN, NOTICES, SPELLINGS

_TOPK = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id AS vec_id, CAST(list_dot_product(q.e, v.e) AS BIGINT) AS score
  FROM v AS q JOIN v ON q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id AND len(v.e) = len(q.e)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

_WORDS = r"regexp_extract_all(coalesce({text}, ''), '[^\x20\x09-\x0D]+')"

_SUBSTRING = f"""
WITH d AS (
  SELECT doc_id, {_WORDS.format(text='text')} AS w FROM documents
), p AS (
  SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d
), win AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS k FROM p WHERE i + 19 <= len(w)
), dup AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1 AS again FROM win
), words AS (
  SELECT p.doc_id, p.i, p.w[p.i] AS word,
         coalesce(bool_or(again) OVER (PARTITION BY p.doc_id ORDER BY p.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), false) AS gone
  FROM p LEFT JOIN dup ON dup.doc_id = p.doc_id AND dup.i = p.i
)
SELECT d.doc_id, CAST(len(any_value(d.w)) AS BIGINT) AS n_words, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_removed,
       sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM d LEFT JOIN words ON words.doc_id = d.doc_id GROUP BY d.doc_id
"""

_BYTES = """
WITH d AS (
  SELECT doc_id, encode(coalesce(text, '')) AS t FROM documents
), p AS (
  SELECT doc_id, t, unnest(range(0, octet_length(t))) AS i FROM d
), w AS (
  SELECT doc_id, i, CASE WHEN i + 100 <= octet_length(t) THEN md5(t[i + 1:i + 100]) END AS k, hex(t[i + 1:i + 1]) AS b FROM p
), s AS (
  SELECT doc_id, i, b, k IS NOT NULL AND row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1 AS again FROM w
), c AS (
  SELECT doc_id, i, b, coalesce(i - max(CASE WHEN again THEN i END) OVER (PARTITION BY doc_id ORDER BY i) < 100, false) AS gone FROM s
), r AS (
  SELECT doc_id, i, b, gone, gone AND NOT lag(gone, 1, false) OVER (PARTITION BY doc_id ORDER BY i) AS opens FROM c
)
SELECT d.doc_id, CAST(count(i) AS BIGINT) AS n_bytes, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_removed, CAST(count(*) FILTER (WHERE opens) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(string_agg(b, '' ORDER BY i) FILTER (WHERE NOT gone), ''))) AS kept_sha256
FROM d LEFT JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id
"""

_JOIN = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, {_WORDS.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), classes AS (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY ks) AS rep FROM (SELECT doc_id, list(k ORDER BY k) AS ks FROM s GROUP BY doc_id)
), r AS (
  SELECT s.doc_id, s.k, n.n FROM s JOIN n USING (doc_id) JOIN classes ON classes.doc_id = s.doc_id AND classes.rep = s.doc_id
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM r AS a JOIN r AS b ON a.k = b.k AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), e AS (
  SELECT x, y FROM pairs UNION SELECT y, x FROM pairs
), reach(node, root) AS (
  SELECT rep, rep FROM classes
  UNION
  SELECT e.y, reach.root FROM reach JOIN e ON e.x = reach.node WHERE reach.root < e.y
), least AS (
  SELECT node, min(root) AS root FROM reach GROUP BY node
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(least.root, d.doc_id) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN classes ON classes.doc_id = d.doc_id LEFT JOIN least ON least.node = classes.rep
"""


def _canonical(text: str) -> str:
    form = f"lower(coalesce({text}, ''))"
    form = f"regexp_replace({form}, '{COPYRIGHT}', ' ', 'g')"
    form = rf"trim(regexp_replace({form}, '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
    for old, new in SPELLINGS:
        form = f"replace({form}, '{old}', '{new}')"
    return form


def _values(texts: dict[str, list[str]]) -> str:
    return ", ".join("('{}', '{}')".format(name, t.replace("'", "''")) for name, all_ in texts.items() for t in all_)


_LICENSE = rf"""
WITH known AS (
  SELECT min(id) AS license_id, digest FROM (SELECT id, sha256({_canonical('t')}) AS digest FROM (VALUES {_values(KNOWN | {'notice:' + k: v for k, v in NOTICES.items()})}) AS k(id, t)) GROUP BY digest
), notice AS (
  SELECT min(id) AS id, digest FROM (SELECT id, sha256({_canonical('t')}) AS digest FROM (VALUES {_values(NOTICES)}) AS k(id, t)) GROUP BY digest
), d AS (
  SELECT doc_id, text, sha256({_canonical('text')}) AS digest FROM documents
), l AS (
  SELECT doc_id, sha256({_canonical('line')}) AS digest FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d WHERE text IS NOT NULL)
  WHERE regexp_matches(line, '(?i)licen[cs]e|creative ?commons|public domain|cc0|released under')
), h AS (
  SELECT doc_id, string_agg(DISTINCT id, ',' ORDER BY id) AS notices FROM l JOIN notice USING (digest) GROUP BY doc_id
)
SELECT d.doc_id, d.digest, regexp_replace(known.license_id, '^notice:', '') AS license_id, coalesce(h.notices, '') AS notices
FROM d LEFT JOIN known USING (digest) LEFT JOIN h ON h.doc_id = d.doc_id
"""

SQL = {"op1_topk_search": _TOPK, "op2_substring_dedup": _SUBSTRING, "op3_license_scan": _LICENSE, "op4_ngram_join": _JOIN, "op9_suffix_dedup": _BYTES}
