"""Query: what five filters remove from all documents, in every order."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.llm import audit
from tidemark.llm.registry import query, table
from tidemark.llm.words import byte_set

LETTERS = "ABCDE"
CAPITALS = byte_set((65, 90))
SYMBOLS = byte_set(*((c, c) for c in b"#$%&*|"))
#: Bytes that begin a code point.
LEAD = ~byte_set((0x80, 0xBF))

_AUDIT = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS bad FROM labels GROUP BY 1),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(bad, false) AS bad,
        CASE WHEN len(w) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
        + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
        + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS bits
      FROM d LEFT JOIN l USING (doc_id)),
c AS (SELECT part, bits, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (bad) AS bad FROM f GROUP BY 1, 2),
x AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(letter, bit)),
o AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM x a, x b, x c, x d, x e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, step, bits[step] AS bit, list_sum(bits[1:step - 1])::INT AS before FROM (SELECT *, unnest([1, 2, 3, 4, 5])::INT AS step FROM o)),
t AS (SELECT part, filter_order, step, n, good, bad, c.bits, bit, coalesce(before, 0) AS before FROM c, s)
SELECT part, filter_order, step, coalesce(sum(n) FILTER (bits & (before | bit) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (bits & bit > 0 AND bits & before = 0), 0)::BIGINT AS removed,
       coalesce(sum(n) FILTER (bits & bit > 0 AND bits & before > 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (bits = bit), 0)::BIGINT AS unique_fails,
       coalesce(sum(good) FILTER (bits & bit > 0 AND bits & before = 0), 0)::BIGINT AS good_lost, coalesce(sum(bad) FILTER (bits & bit > 0 AND bits & before = 0), 0)::BIGINT AS toxic_lost,
       coalesce(sum(n * 120 // greatest(bit_count(bits), 1)) FILTER (bits & bit > 0), 0)::BIGINT AS shapley
FROM t GROUP BY part, filter_order, step
"""


@query("op11_filter_audit", _AUDIT)
def op11_filter_audit(spark, sf):
    """Five filters over every whole text, in all 120 orders, per language."""
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf, "documents").select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))
    matrix, _ = audit.document_term_matrix(docs, "text", ["doc_id", "part", "digest"], {"capitals": CAPITALS, "symbols": SYMBOLS, "code_points": LEAD})
    rows = audit.row_figures(matrix)
    bits = audit.failed_bits([F.col("row_sum") < 100, 100 * F.col("nonzeros") < 80 * F.col("row_sum"), 100 * F.col("capitals") > 10 * F.col("code_points"), F.col("symbols") > 0])
    labels = table(spark, sf, "labels").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("bad"))
    marked = rows.select("doc_id", "part", "digest", bits.alias("bits")).join(labels, "doc_id", "left")
    marked = marked.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "bad")})
    counts = audit.first_copies(marked, "digest", "doc_id", ["part", "bits", "good", "bad"]).withColumn("bits", F.col("bits") + F.when(F.col("copy"), 16).otherwise(0))
    totals = {"good_lost": F.when(F.col("good"), F.col("n")).otherwise(0), "toxic_lost": F.when(F.col("bad"), F.col("n")).otherwise(0)}
    return audit.interactions(counts, "part", "bits", LETTERS, totals)
