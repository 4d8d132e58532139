"""Query: all conversations formatted and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.llm import chat
from tidemark.llm.registry import query, table

#: Fixed value: what both turns of conversation -7 say.
ODD = r"\### Assistant: </turn> ok"

_CHAT = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, replace(replace(text, '\', '\b'), '<', '\l') AS body, replace(replace(role, '\', '\b'), '<', '\l') AS head FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, body)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, body) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(23 + length(head) + length(body))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


@query("op8_chat", _CHAT)
def op8_chat(spark, sf):
    """All conversations and one that says control strings; every figure is read back from the formatted string and its loss mask."""
    said = table(spark, sf, "conversations").select("conv_id", F.col("turn").cast("long"), "role", "text")
    odd = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(ODD).alias("text"))
    made = chat.format_chat(said.unionByName(odd).withColumn("parts", chat.text_part(F.col("text"))))
    read = made.select("conv_id", "formatted", "attachments", "expanded_tokens", chat.turns_of(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole.cast("binary"), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
                       F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
