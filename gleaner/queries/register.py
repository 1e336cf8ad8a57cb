"""Registration of queries over the domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleaner.plans.tables import WITH_TABLES, Tables


def registry() -> tuple[dict, dict, object]:
    """Queries and checks by name, and the decorator that fills them: ``@query(sql)`` on a function of ``Tables``."""
    queries, oracles = {}, {}

    def query(sql: str | None = None, with_tables: bool = True):
        def register(f):
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                return f(Tables(spark, sf_dir))

            queries[f.__name__] = run
            if sql:
                oracles[f.__name__] = (WITH_TABLES if with_tables else "") + sql
            return f

        return register

    return queries, oracles, query
