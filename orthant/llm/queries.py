"""The training-data operators' queries and the SQL that checks them."""

from __future__ import annotations

from . import byte_bpe, decontaminate, license_scan, mil_quality, ngram_join, quality_rules, suffix_dedup, token_counts, tool_calls, toxicity

_MODULES = (quality_rules, decontaminate, ngram_join, toxicity, license_scan, suffix_dedup, byte_bpe, token_counts, mil_quality, tool_calls)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
