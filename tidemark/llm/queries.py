"""All queries of this subpackage and their SQL twins."""

from tidemark.llm import q_audit, q_chat, q_dedup, q_embeddings, q_leaks, q_pages, q_quality, q_sampling, q_toxicity  # noqa: F401
from tidemark.llm.registry import ORACLES, QUERIES  # noqa: F401
