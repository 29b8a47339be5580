"""Operators for training-data corpora: one module each, with its query and SQL."""

from __future__ import annotations

import importlib

_MODULES = ("substring_dedup", "token_files", "minhash_dedup", "pii", "html_extract", "piece_sampling",
            "quality_rules", "decontamination", "warc_bundles", "line_dedup", "best_fit_packing",
            "importance_resampling", "hard_negatives")


def _gather(what: str) -> dict:
    out: dict = {}
    for name in _MODULES:
        out.update(getattr(importlib.import_module(f"kgloom.llm.{name}"), what))
    return out


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _gather("SQL")
