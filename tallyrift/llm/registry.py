"""The queries of this subpackage and their oracles."""

from __future__ import annotations

import importlib

MODULES = ("mixing", "pii", "quality", "fingerprints", "ngram_join", "exact_dedup", "packing", "repeats", "sharding", "toxicity", "divergence", "negatives", "decontamination")


def collected() -> tuple[dict, dict]:
    queries, oracles = {}, {}
    for name in MODULES:
        module = importlib.import_module(f"tallyrift.llm.{name}")
        queries |= module.QUERIES
        oracles |= module.ORACLES
    return queries, oracles
