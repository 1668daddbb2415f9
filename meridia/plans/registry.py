"""A register of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import TABLES, view, with_views


class Register:
    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, name: str, *tables: str, sql: str | None = None):
        """Decorates a function of the tables' frames; ``sql`` is put after the views it uses."""

        def add(make):
            def query(spark: SparkSession, sf_dir: str) -> DataFrame:
                return make(*(view(spark, sf_dir, t) if t in TABLES else spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables))

            query.__name__, query.__doc__ = name, make.__doc__
            self.queries[name] = query
            if sql is not None:
                views = [t for t in tables if t in TABLES]
                self.oracles[name] = with_views(sql.strip(), *views) if views else sql.strip()
            return make

        return add
