"""All queries of this package."""

from tablelens.llm import queries_chat, queries_dedup, queries_mixing, queries_privacy, queries_scores, queries_search, queries_tokens, queries_trie, queries_vectors  # noqa: F401
from tablelens.llm.registry import QUERIES, SQL  # noqa: F401
