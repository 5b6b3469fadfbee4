"""The registered queries of this subpackage, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from .bpe import op5_bpe
from .collocations import op11_collocations
from .editcounts import op2_token_counts
from .fingerprint import op6_fingerprint
from .linededup import op13_lines
from .mixing import op8_mixing
from .neardup import op3_neardup
from .quality import op1_quality
from .runs import op12_runs
from .secrets import op7_secrets
from .substrings import op4_substrings
from .telephony import op10_telephony
from .urls import op9_urls

QUERIES = {
    "op1_quality": op1_quality,
    "op2_token_counts": op2_token_counts,
    "op3_neardup": op3_neardup,
    "op4_substrings": op4_substrings,
    "op5_bpe": op5_bpe,
    "op6_fingerprint": op6_fingerprint,
    "op7_secrets": op7_secrets,
    "op8_mixing": op8_mixing,
    "op9_urls": op9_urls,
    "op10_telephony": op10_telephony,
    "op11_collocations": op11_collocations,
    "op12_runs": op12_runs,
    "op13_lines": op13_lines,
}

#: Words, windows of 50 words by their hash, the least document of each, and the words that repeats cover.
SUBSTRINGS_SQL = r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
 win AS (SELECT doc_id, p, sha256(array_to_string(words[p:p+49], ' ')) AS h FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS p FROM w)),
 first AS (SELECT h, min(doc_id) AS m FROM win GROUP BY 1),
 gone AS (SELECT DISTINCT doc_id, p + k AS i FROM (SELECT win.doc_id, p FROM win JOIN first USING (h) WHERE m < win.doc_id) r, range(0, 50) t(k)),
 tok AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
 kept AS (SELECT t.doc_id, count(g.i) AS n_removed, string_agg(word, ' ' ORDER BY t.i) FILTER (WHERE g.i IS NULL) AS kept FROM tok t LEFT JOIN gone g ON g.doc_id = t.doc_id AND g.i = t.i GROUP BY 1)
 SELECT w.doc_id, len(words) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""

#: Lines and their keys, keys of 40 characters in 5 documents, and all lines but those that go.
LINES_SQL = r"""WITH l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)),
 k AS (SELECT doc_id, i, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
 rep AS (SELECT key, max(doc_id) AS largest FROM k WHERE length(key) >= 40 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 5),
 m AS (SELECT doc_id, i, line, largest IS NOT NULL AND doc_id <> largest AS gone FROM k LEFT JOIN rep USING (key))
 SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM m GROUP BY 1"""

#: Words by piece, counts of phrases up to three words, scores of both cuts in 128-bit integers.
PHRASES_SQL = r"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
 w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS words FROM p),
 t AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM w),
 g AS (SELECT lang, words[i] AS w1, words[i + 1] AS w2, words[i + 2] AS w3 FROM t),
 f1 AS (SELECT lang, w1, count(*) AS n FROM g GROUP BY 1, 2),
 f2 AS (SELECT lang, w1, w2, count(*) AS n FROM g WHERE w2 IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 10),
 f3 AS (SELECT lang, w1, w2, w3, count(*) AS n FROM g WHERE w3 IS NOT NULL GROUP BY 1, 2, 3, 4 HAVING count(*) >= 10),
 longer AS (SELECT lang, w1, w2, max(n) AS longer FROM (SELECT lang, w1, w2, n FROM f3 UNION ALL SELECT lang, w2, w3, n FROM f3) GROUP BY 1, 2, 3),
 two AS (SELECT f2.lang, f2.w1 || ' ' || f2.w2 AS phrase, f2.n AS a, x.n AS l, y.n AS r, 1000000::HUGEINT * f2.n * f2.n // (x.n::HUGEINT * y.n) AS score FROM f2 JOIN f1 x ON x.lang = f2.lang AND x.w1 = f2.w1 JOIN f1 y ON y.lang = f2.lang AND y.w1 = f2.w2 LEFT JOIN longer z ON z.lang = f2.lang AND z.w1 = f2.w1 AND z.w2 = f2.w2 WHERE coalesce(100 * longer < 50 * f2.n, true)),
 cuts AS (SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3 AS phrase, f3.n AS a, x.n AS l1, b.n AS r1, c.n AS l2, y.n AS r2, 1000000::HUGEINT * f3.n * f3.n // (x.n::HUGEINT * b.n) AS s1, 1000000::HUGEINT * f3.n * f3.n // (c.n::HUGEINT * y.n) AS s2 FROM f3 JOIN f1 x ON x.lang = f3.lang AND x.w1 = f3.w1 JOIN f1 y ON y.lang = f3.lang AND y.w1 = f3.w3 JOIN f2 b ON b.lang = f3.lang AND b.w1 = f3.w2 AND b.w2 = f3.w3 JOIN f2 c ON c.lang = f3.lang AND c.w1 = f3.w1 AND c.w2 = f3.w2),
 every AS (SELECT * FROM two UNION ALL SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2) FROM cuts),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM every)
 SELECT lang, rank, phrase, a, l, r, t.n, score::BIGINT AS score FROM ranked JOIN (SELECT lang, sum(n)::BIGINT AS n FROM f1 GROUP BY 1) t USING (lang) WHERE rank <= 2000"""

ORACLE_SQL: dict[str, str] = {"op4_substrings": SUBSTRINGS_SQL, "op11_collocations": PHRASES_SQL, "op13_lines": LINES_SQL}
