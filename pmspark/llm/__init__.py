"""Training-data operators: one module for each, and their registered queries."""

from __future__ import annotations

import sys
from importlib import import_module

from pyspark import cloudpickle

# What runs in tasks is sent along with them: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MODULES = ("secrets", "chat", "simhash", "merkle", "toxicity", "tiling", "urls", "mixing", "sharding", "lines", "whitening", "parity", "negatives")


def queries() -> dict:
    """Name to ``f(spark, sf_dir) -> DataFrame`` for every operator, and ``pipeline``."""
    found = {}
    for name in MODULES:
        found |= import_module(f"pmspark.llm.{name}").QUERIES
    return found | {"pipeline": import_module("corpus_pipeline").run}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express."""
    found = {}
    for name in MODULES:
        found |= getattr(import_module(f"pmspark.llm.{name}"), "ORACLES", {})
    return found
