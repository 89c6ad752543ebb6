"""Collects the queries of the subpackage for ``__spark_entry__``."""

from fieldlab.llm import bpe, chat_tree, divergence, exact_dedup, fingerprint, language_id, line_dedup, mixing, ngram_join, periodic, quality_rules, token_store, toxicity

_MODULES = [bpe, language_id, ngram_join, line_dedup, chat_tree, toxicity, mixing, fingerprint, quality_rules, token_store, periodic, divergence, exact_dedup]
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in getattr(m, "ORACLE", {}).items()}
