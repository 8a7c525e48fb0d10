"""Queries and SQL of the text operators, by name."""

from __future__ import annotations

from importlib import import_module

MODULES = ["chat_format", "url_filter", "topk", "pii", "line_dedup", "ngram_join", "mixing", "suffix_dedup", "language_id", "decontaminate", "license_scan", "fill_in_middle", "filter_audit"]


def _all(what: str) -> dict:
    found: dict = {}
    for name in MODULES:
        found |= getattr(import_module(f"{__package__}.{name}"), what)
    return found


def queries() -> dict:
    return _all("QUERIES") | {"pipeline": import_module("corpus_pipeline").run}


def oracle_sql() -> dict:
    sql = import_module("corpus_pipeline").ORACLE_SQL
    return _all("ORACLES") | ({"pipeline": sql} if sql else {})
