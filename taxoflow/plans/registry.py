"""All queries of the core library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from taxoflow.plans import match_oracle, match_queries, table_queries

QUERIES = {**table_queries.QUERIES, **match_queries.QUERIES}
ORACLE = {**table_queries.ORACLE, **match_oracle.ORACLE}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed values matched to terms, whole and by components."""
    return match_queries.component_match(spark, sf_dir)
