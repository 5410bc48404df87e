"""All queries of the core by name, and the SQL that each is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .operators.graph import CodeGraph
from .plans import edge_queries, graph_queries
from .plans.base_sql import BASE
from .streaming import upserts


def _edge(builder: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: getattr(CodeGraph(spark, folder, builder in edge_queries.EVENTS), builder)()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _edge(builder) for name, (builder, _) in edge_queries.EDGES.items()} | graph_queries.QUERIES | {"w04_stream_upsert": upserts.stream_query, "w04_stream_edges": upserts.stream_edges}


def oracle_sql() -> dict[str, str]:
    return {name: edge_queries.sql(name) for name in edge_queries.EDGES} | graph_queries.SQL | {"w04_stream_upsert": upserts.STREAM_SQL, "w04_stream_edges": BASE + upserts.EDGES_SQL}
