"""The same as SQL, for the corpus queries that SQL can say on whole tables."""

from __future__ import annotations

from palimpsest.llm.jaccard import PERCENT, WORDS
from palimpsest.llm.licenses import CONTINUED, COPYRIGHT, DIGESTS, KNOWN, SPELLINGS
from palimpsest.llm.line_dedup import SITES

_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

JACCARD = f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= {WORDS} THEN list_distinct(list_transform(range(1, len(w) - {WORDS - 2}), lambda i: array_to_string(list_slice(w, i, i + {WORDS - 1}), ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
e AS (SELECT doc_id, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * n >= {PERCENT} * (len(x.s) + len(y.s) - n)),
g AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS d, doc_id AS c FROM documents UNION SELECT g.b, r.c FROM r JOIN g ON g.a = r.d)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, (SELECT min(c) FROM r WHERE r.d = s.doc_id) AS component_id FROM s"""


def _quoted(text: str) -> str:
    return text.replace("'", "''")


def _normalised(column: str) -> str:
    own = f"regexp_replace(lower({column}), '{CONTINUED}', '. \\1', 'g')"
    out = f"trim(regexp_replace(regexp_replace({own}, '{COPYRIGHT}', chr(10), 'g'), '[^a-z0-9]+', ' ', 'g'))"
    for pattern, word in SPELLINGS:
        out = f"regexp_replace({out}, '\\b{pattern}\\b', '{word}', 'g')"
    return out


_KNOWN = " UNION ALL ".join(f"SELECT '{name}' AS license, '{_quoted(text)}' AS text" for name, text in KNOWN)
_DIGESTS = ", ".join(f"('{name}', '{d}')" for name, all_of in DIGESTS.items() for d in all_of.split())

LICENSES = f"""WITH k AS (SELECT DISTINCT license, md5({_normalised("text")}) AS digest FROM ({_KNOWN}) q UNION SELECT * FROM (VALUES {_DIGESTS}) v(license, digest)),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
h AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS notices, count(DISTINCT license) AS n FROM l JOIN k ON k.digest = md5({_normalised("line")}) GROUP BY 1),
d AS (SELECT doc_id, md5({_normalised("text")}) AS digest FROM documents)
SELECT d.doc_id, d.digest, k.license, coalesce(h.notices, '') AS notices, coalesce(h.n, 0) AS n_notices FROM d LEFT JOIN k ON k.digest = d.digest LEFT JOIN h ON h.doc_id = d.doc_id"""

LINES = f"""WITH l AS (SELECT doc_id, source, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS line FROM documents),
b AS (SELECT trim(line, ' ') AS line, min(doc_id) AS first FROM l WHERE trim(line, ' ') <> '' GROUP BY 1 HAVING count(DISTINCT coalesce('s' || source, 'null')) >= {SITES}),
k AS (SELECT l.*, b.line IS NULL OR b.first = l.doc_id AS kept FROM l LEFT JOIN b ON b.line = trim(l.line, ' ')),
g AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE kept) AS text, CAST(count(*) AS INTEGER) AS n, CAST(count(*) FILTER (WHERE NOT kept) AS INTEGER) AS gone FROM k GROUP BY 1)
SELECT d.doc_id, d.source, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(g.text, '') END AS text, coalesce(g.n, 0) AS n_lines, coalesce(g.gone, 0) AS n_removed FROM documents d LEFT JOIN g ON g.doc_id = d.doc_id"""
