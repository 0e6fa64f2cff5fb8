"""Registry of the engine's own queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.plans import contract_queries, data_queries, decision_queries, eval_queries, evidence_queries, render_queries, rule_queries, structure_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**data_queries.QUERIES, **eval_queries.QUERIES, **rule_queries.QUERIES, **decision_queries.QUERIES, **contract_queries.QUERIES, **structure_queries.QUERIES, **render_queries.QUERIES, **evidence_queries.QUERIES}
ORACLE_SQL: dict[str, str] = {**data_queries.ORACLE_SQL, **eval_queries.ORACLE_SQL, **rule_queries.ORACLE_SQL, **decision_queries.ORACLE_SQL, **contract_queries.ORACLE_SQL, **structure_queries.ORACLE_SQL, **render_queries.ORACLE_SQL, **evidence_queries.ORACLE_SQL}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["dataset_manifest"](spark, sf_dir)
