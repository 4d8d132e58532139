"""Query: main text of all pages."""

from __future__ import annotations

from tidemark.llm import pages
from tidemark.llm.registry import query, table

# The given pages mark their main text as an article of headings and paragraphs, so SQL can cut it out by its tags.
_PAGES = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS body FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(body, '</?(h1|p)>', chr(1), 'g'), '<[^>]*>', ' ', 'g') AS body FROM a),
r AS (SELECT page_id, url, replace(replace(replace(replace(body, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS body FROM b),
l AS (SELECT page_id, url, list_filter(list_transform(string_split(body, chr(1)), lambda x : trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x : x <> '') AS lines FROM r)
SELECT page_id, url, coalesce(array_to_string(lines, chr(10)), '') AS text, length(coalesce(array_to_string(lines, chr(10)), ''))::BIGINT AS n_chars FROM l
"""


@query("op12_html", _PAGES)
def op12_html(spark, sf):
    """Text and length of every page's article."""
    model = pages.train(pages.labelled_pages(spark))
    return pages.main_text(table(spark, sf, "pages").select("page_id", "url", "html"), model)
