"""Query: all embeddings whitened."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.llm import whitening
from tidemark.llm.registry import query, table

COMPONENTS = 8


@query("op13_whitening")
def op13_whitening(spark, sf):
    """Every usable vector on the first eight axes of all of them."""
    rows = table(spark, sf, "embeddings").filter(whitening.usable(F.col("embedding"))).select("vec_id", whitening.grid(F.col("embedding")).alias("x"))
    model = whitening.fit(rows, "x")
    error = whitening.identity_error(rows, "x", model, COMPONENTS)
    share = [float(v / model.trace) if model.trace > 0 else None for v in model.variances[:COMPONENTS]]
    out = whitening.whiten(rows, "x", model, COMPONENTS).select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    shares = F.lit(share).cast("array<double>") if share else F.array().cast("array<double>")
    return out.select("vec_id", (F.col("place") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
                      F.get(shares, F.col("place")).alias("explained"), F.lit(error).alias("identity_error"))
