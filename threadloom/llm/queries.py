"""Imports each operator module, which registers its query."""

from threadloom.llm import byte_bpe, exact_dedup, hamming_search, jaccard_join, language_id, line_rules, merkle_manifest, mixing, pii, sharding, token_counts, token_files, whitening  # noqa: F401
from threadloom.llm.registry import ORACLES, QUERIES  # noqa: F401
