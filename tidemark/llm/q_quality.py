"""Query: quality rules over all documents."""

from __future__ import annotations

from tidemark.llm import quality
from tidemark.llm.registry import query, table

_QUALITY = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, w[i:i+2] AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)),
r AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM (SELECT doc_id, i, unnest([0, 1, 2]) AS o FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1) GROUP BY 1),
l AS (SELECT doc_id, count(*) AS lines, count(*) - count(DISTINCT line) AS dups FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
f AS (SELECT d.doc_id, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
        coalesce(dups, 0) AS n_dup_lines, coalesce(lines, 0) AS lines, coalesce(r.n, 0) AS n_repeat_words, len(list_distinct(w)) AS vocabulary,
        length(regexp_replace(text, '[^A-Z]', '', 'g')) AS capitals, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS letters
      FROM d LEFT JOIN r USING (doc_id) LEFT JOIN l USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR n_symbols > 0.3 * n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words
            OR n_dup_lines > 0.5 * lines OR capitals > 0.6 * letters OR vocabulary < 0.05 * n_words) AS kept
FROM f
"""


@query("op10_quality", _QUALITY)
def op10_quality(spark, sf):
    """Figures and verdict of every whole text."""
    return quality.judge(table(spark, sf, "documents"))
