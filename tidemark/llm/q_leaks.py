"""Queries: benchmark items in documents, and license lines."""

from __future__ import annotations

from tidemark.llm import decontaminate, licenses
from tidemark.llm.registry import query, table

_SETS = r"""(SELECT DISTINCT {id}, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT {id}, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i
  FROM (SELECT {id}, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM {table}) WHERE len(w) > 0))"""
_LEAKS = f"""
WITH d AS {_SETS.format(id='doc_id', table='documents')}, b AS {_SETS.format(id='item_id', table='benchmark')}, n AS (SELECT item_id, count(*) AS item_shingles FROM b GROUP BY 1)
SELECT doc_id, item_id, count(*) AS shared, item_shingles, count(*) / item_shingles AS containment FROM d JOIN b USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id, item_shingles HAVING count(*) >= 0.75 * item_shingles
"""


@query("op4_decontamination", _LEAKS)
def op4_decontamination(spark, sf):
    """Every document that holds three quarters or more of a benchmark item's five-word shingles."""
    return decontaminate.contained(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op7_licenses")
def op7_licenses(spark, sf):
    """License phrases and notices in every whole text."""
    return licenses.scan(table(spark, sf, "documents"))
