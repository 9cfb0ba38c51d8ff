"""All registered queries of the library itself and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.plans import code_queries, dependence_queries, graph_queries, interprocedural_queries, program_queries, table_queries, text_queries

FLAGSHIP = "impact_callers"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**graph_queries.QUERIES, **text_queries.QUERIES, **table_queries.QUERIES, **program_queries.QUERIES, **dependence_queries.QUERIES, **interprocedural_queries.QUERIES, **code_queries.QUERIES}
ORACLE_SQL: dict[str, str] = {**graph_queries.SQL, **text_queries.SQL, **table_queries.SQL, **program_queries.SQL, **dependence_queries.SQL, **interprocedural_queries.SQL, **code_queries.SQL}
