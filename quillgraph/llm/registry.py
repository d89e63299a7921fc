"""The queries of this subpackage and the SQL of those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

MODULES = ("op1_audio_features", "op2_toxicity", "op3_language_id", "op4_ngram_jaccard", "op5_url_filters", "op6_html_extraction", "op7_mixing", "op8_voronoi_knn", "op9_bpe", "op10_pitman_yor")


def queries() -> dict[str, Callable]:
    found: dict[str, Callable] = {}
    for name in MODULES:
        found |= import_module(f"quillgraph.llm.{name}").QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for name in MODULES:
        found |= import_module(f"quillgraph.llm.{name}").ORACLE
    return found
