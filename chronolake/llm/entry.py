"""Queries of the operators, and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib

MODULES = (
    "embedding_dedup",
    "language_id",
    "mixing",
    "simhash",
    "substring_dedup",
    "warc",
    "suffix_dedup",
    "piecewise_hash",
    "sentencepiece_viterbi",
    "sharding",
    "quality",
    "whitening",
    "phrases",
)


def _modules():
    return [importlib.import_module(f"{__package__}.{m}") for m in MODULES]


def queries() -> dict:
    return {k: f for m in _modules() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _modules() for k, s in m.SQL.items()}
