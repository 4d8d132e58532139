"""Queries: sharding and mixing of all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.llm import mixing, sharding
from tidemark.llm.registry import query, table
from tidemark.llm.words import word_count
from tidemark.session import stage


@query("op2_sharding")
def op2_sharding(spark, sf):
    """All documents in 40 shards whose counts differ by one at most."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = table(spark, sf, "documents").select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = sharding.shard(rows, ["doc_id", "text_crc32", "size"], 40, seed=2)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


_MIX = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
c AS (SELECT *, CASE WHEN size > 0 THEN length(bin(size)) * 8 + (size * 8) // (1::BIGINT << (length(bin(size))::BIGINT - 1)) - 8 ELSE 0 END AS cls,
        ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT AS h FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY cls, h % ((SELECT count(*) FROM documents) // 100000 + 1), size, h, doc_id) AS k FROM c),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
w AS (SELECT *, 1.0::DOUBLE + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight, 3.0::DOUBLE * source_size AS cap FROM s),
v AS (SELECT *, ((SELECT sum(size)::BIGINT FROM d) - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
        / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(cap, weight * (SELECT arg_min(level, cap / weight) FROM v WHERE level * weight <= cap)) AS target,
        ('0x' || substr(md5('7:' || coalesce(source, 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM v),
r AS (SELECT p.*, source_size, target, u, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, ((floor(rate * k + u) - floor(rate * (k - 1) + u))::BIGINT * size)::BIGINT AS taken FROM r
"""


@query("op3_mixing", _MIX)
def op3_mixing(spark, sf):
    """All documents mixed: sources weigh 1, 2, 3 in turn, none above three times its size. Texts are read once, to count words."""
    rows = stage(table(spark, sf, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size")))
    return mixing.mix(rows).select("doc_id", "size", "source_size", "target", "taken")
