"""Operators for training-data pipelines: language, quality, overlap, licenses, secrets, mixing, audits, token counts, manifests."""

import importlib

from cuewise.llm.registry import CHECKS, QUERIES

MODULES = ["quality_rules", "mixing", "decontamination", "language", "licenses", "lmscore", "cotraining", "secrets", "jaccard", "passages", "audit", "tokens", "merkle"]


def load_all() -> tuple[dict, dict]:
    """All queries of this subpackage and their SQL checks."""
    for name in MODULES:
        importlib.import_module(f"cuewise.llm.{name}")
    return QUERIES, CHECKS
