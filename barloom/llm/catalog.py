"""All queries of this package."""

from __future__ import annotations

import importlib

from . import registry

MODULES = ["q_toxicity", "q_exact_dedup", "q_licenses", "q_ann", "q_suffix_dedup", "q_bpe", "q_token_files", "q_simhash", "q_quality", "q_mixing", "q_weighted_sampling", "q_spelling", "q_conversation_trie"]

for _m in MODULES:
    importlib.import_module(f"{__package__}.{_m}")


def queries():
    return dict(registry.QUERIES)


def checks():
    return dict(registry.CHECKS)
