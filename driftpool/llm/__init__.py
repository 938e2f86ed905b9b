"""Operators of a training-data pipeline: one module per operator, each with
the operator, the query that applies it to its whole table and, where SQL can
say it, the oracle SQL. ``QUERIES`` and ``ORACLES`` are filled on ``load``."""

from __future__ import annotations

import sys
from importlib import import_module

from pyspark import cloudpickle

MODULES = ("ann", "langid", "chat", "linededup", "tokencount", "simhash", "substrings", "toxicity",
           "decontam", "mixing", "merkle", "quality", "trie")


# task functions travel with their code, so that executors need no installed copy
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def load() -> tuple[dict, dict]:
    """(queries, oracle SQL) of all operators and the pipeline."""
    queries, oracles = {}, {}
    for name in MODULES:
        mod = import_module(f"driftpool.llm.{name}")
        queries[mod.QUERY_NAME] = mod.query
        if mod.ORACLE_SQL is not None:
            oracles[mod.QUERY_NAME] = mod.ORACLE_SQL
    return queries, oracles
