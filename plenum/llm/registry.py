"""Queries of this subpackage and the DuckDB text of those that SQL can express."""

from __future__ import annotations

import importlib

MODULES = ("quality_neighbours", "piece_viterbi", "phrase_automata", "super_minhash", "temperature_mix", "mpeg_audio", "suffix_doubling", "contextual_pii", "language_ranks", "exact_blocks", "token_counts", "token_alignment", "collocations")


def load_all() -> tuple[dict, dict]:
    queries, oracles = {}, {}
    for name in MODULES:
        module = importlib.import_module(f"plenum.llm.{name}")
        queries[module.NAME] = module.query
        if module.ORACLE is not None:
            oracles[module.NAME] = module.ORACLE
    pipeline = importlib.import_module("corpus_pipeline")
    queries["pipeline"] = pipeline.run
    if pipeline.ORACLE_SQL is not None:
        oracles["pipeline"] = pipeline.ORACLE_SQL
    return queries, oracles
