"""Queries of the training-data operators and the SQL that they are checked against."""

from lodestead.llm import byte_bpe, chat_format, decontamination, html_extraction, importance_resampling, line_dedup, lm_scoring, ngram_join, quality_rules, source_audit, substring_dedup, toxicity, url_filters

_MODULES = (chat_format, decontamination, quality_rules, url_filters, substring_dedup, lm_scoring, line_dedup, toxicity, byte_bpe, ngram_join, importance_resampling, source_audit, html_extraction)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
