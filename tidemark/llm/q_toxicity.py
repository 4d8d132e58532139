"""Query: toxicity of all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.llm import toxicity
from tidemark.llm.registry import query, table

CUT = 0.3


def held_out(key):
    """The fold that no label is learnt from."""
    return F.crc32(key.cast("string").cast("binary")) % 4 == 2


@query("op9_toxicity")
def op9_toxicity(spark, sf):
    """Score of every whole text; labels of the held-out fold are not learnt from."""
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = toxicity.train(docs, labels.filter(~held_out(F.col("doc_id"))))
    scored = toxicity.tag(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), F.size("spans").cast("long").alias("n_spans"))
