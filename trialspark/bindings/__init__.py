"""Runnable queries: every operator bound to the sample tables, with its SQL.

``QUERIES[name](spark, folder)`` returns a DataFrame; ``ORACLES[name]`` is the
same result in DuckDB SQL over views of the same tables.
"""

from trialspark.bindings import catalog, clinical, evaluation, ingestion, relational, sequences, streams, training
from trialspark.bindings.registry import ORACLES, QUERIES

__all__ = [
    "ORACLES",
    "QUERIES",
    "catalog",
    "clinical",
    "evaluation",
    "ingestion",
    "relational",
    "sequences",
    "streams",
    "training",
]
