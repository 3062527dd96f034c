"""Queries of the core library and the DuckDB SQL each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillgraph.plans import graph, references, retrieval, text

_MODULES = (references, text, graph, retrieval)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for _module in _MODULES:
    QUERIES.update(_module.QUERIES)
    ORACLE_SQL.update(_module.ORACLE_SQL)

FLAGSHIP = "linked_documents"
