"""Operators for preparing training data.  Nothing else in the library imports this subpackage."""

from __future__ import annotations

import importlib
import importlib.util

#: Modules with one numbered operator each; every one has NAME, query(spark, sf_dir) and SQL (None where SQL can't say it).
MODULES = (
    "near_embeddings",
    "repeated_substrings",
    "html_text",
    "shingle_join",
    "fuzzy_lines",
    "source_mix",
    "toxicity",
    "language_id",
    "decontaminate",
    "token_counts",
    "conversation_trie",
    "url_filter",
    "spelling_variants",
)


def _modules():
    return [importlib.import_module(f"{__name__}.{name}") for name in MODULES if importlib.util.find_spec(f"{__name__}.{name}")]


def queries():
    """The registered queries: name -> f(spark, sf_dir)."""
    return {m.NAME: m.query for m in _modules()}


def oracle_sql():
    """DuckDB SQL of the queries that SQL can express."""
    return {m.NAME: m.SQL for m in _modules() if m.SQL}
