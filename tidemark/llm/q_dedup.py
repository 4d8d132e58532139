"""Queries: duplicates among all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.llm import linededup, neardup, substrings
from tidemark.llm.registry import query, table


@query("op6_minhash")
def op6_minhash(spark, sf):
    """Groups of documents that share three quarters of their five-word shingles."""
    return neardup.near_duplicates(table(spark, sf, "documents"))


@query("op1_lines")
def op1_lines(spark, sf):
    """Every document without the blocks of lines that it shares with an earlier one."""
    found = linededup.dedup_lines(table(spark, sf, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", "partners", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@query("op5_substrings")
def op5_substrings(spark, sf):
    """Every document without the bytes that a 100-byte string starting earlier covers."""
    return substrings.remove_repeats(table(spark, sf, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
