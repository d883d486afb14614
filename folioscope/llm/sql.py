"""SQL of the queries that SQL can express, for DuckDB over the plain tables."""

from __future__ import annotations

import math
import re

from .license_scan import BLOCK_WORDS, PHRASES, TEMPLATES, THRESHOLD

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SOLID = rf"regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+')"


def _templates() -> str:
    rows = []
    for k, (label, text) in enumerate(TEMPLATES):
        words = sorted(set(re.findall("[a-z0-9]+", text.lower())))
        rows += [f"({k}, '{label}', '{w}', {len(words)}, {max(1, math.ceil(THRESHOLD * len(words) - 1e-9))})" for w in words]
    return ", ".join(rows)


_PHRASES = ", ".join(f"('{k}', {len(k.split())}, '{v}')" for k, v in PHRASES.items())
OP3 = rf"""WITH d AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
 p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
 base AS (SELECT doc_id, i - 1 AS pos, label FROM p JOIN (VALUES {_PHRASES}) AS f(phrase, n, label) ON array_to_string(w[i:i + n - 1], ' ') = phrase),
 tem(t, label, word, size, need) AS (VALUES {_templates()}),
 hit AS (SELECT doc_id, t, label, size, need, word, i FROM p JOIN tem ON w[i] = word),
 met AS (SELECT a.doc_id, a.label, count(DISTINCT b.word) / any_value(a.size)::DOUBLE AS share
  FROM hit a JOIN hit b ON b.doc_id = a.doc_id AND b.t = a.t AND b.i BETWEEN a.i - {BLOCK_WORDS - 1} AND a.i
  GROUP BY a.doc_id, a.t, a.i, a.label HAVING count(DISTINCT b.word) >= any_value(a.need)),
 lab AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM met UNION SELECT doc_id, label FROM base) GROUP BY 1),
 bl AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY 1),
 sc AS (SELECT doc_id, max(share) AS share FROM met GROUP BY 1)
 SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0::DOUBLE) END AS score FROM d LEFT JOIN bl USING (doc_id) LEFT JOIN lab USING (doc_id) LEFT JOIN sc USING (doc_id)"""

OP4 = rf"""WITH d AS (SELECT doc_id, {_ALNUM} AS w FROM documents), b AS (SELECT item_id::VARCHAR AS item, {_ALNUM} AS w FROM benchmark),
 win AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[k:k + 9], ' ') AS g FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS k FROM b WHERE len(w) > 0)),
 p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
 occ AS (SELECT doc_id, i, n, item FROM (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM p, (SELECT DISTINCT n FROM win) WHERE i + n - 1 <= len(w)) JOIN win USING (n, g)),
 hit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM occ) GROUP BY 1),
 it AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM occ GROUP BY 1)
 SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
 FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)"""

OP7 = rf"""WITH RECURSIVE d AS (SELECT doc_id, {_SOLID} AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS k FROM d WHERE len(w) > 0)),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 both_ AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
 link AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
 e AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
 reach(node, label) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, reach.label FROM reach JOIN e ON e.a = reach.node),
 least_ AS (SELECT node AS doc_id, min(label) AS component_id FROM reach GROUP BY 1)
 SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM d LEFT JOIN n USING (doc_id) JOIN least_ USING (doc_id)"""

ORACLE_SQL = {"op3_license_scan": OP3, "op4_decontaminate": OP4, "op7_shingle_join": OP7}
