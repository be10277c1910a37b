"""Registry of runnable queries: name -> plan over the input tables, and its SQL twin."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Inputs:
    """The given tables, and the views derived from them, as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._made = spark, folder, {}

    def _raw(self, name: str) -> DataFrame:
        df = getattr(self, name)
        return df.withColumnsRenamed({"ax": "x0", "ay": "y0", "bx": "x1", "by": "y1"}) if "ax" in df.columns else df

    def __getattr__(self, name: str) -> DataFrame:
        made = self.__dict__["_made"]
        if name not in made:
            if name in views.VIEWS:
                text = views.VIEWS[name]
                needs = sorted(set(re.findall(r"\{(\w+)\}", text)))
                view = self.spark.sql(text, **{n: self._raw(n) for n in needs})
                # Segment ends are ax, ay, bx, by in the library; BY is a keyword in SQL text.
                if {"x0", "y0", "x1", "y1"} <= set(view.columns):
                    view = view.withColumnsRenamed({"x0": "ax", "y0": "ay", "x1": "bx", "y1": "by"})
                made[name] = view
            elif name in views.TABLES:
                made[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            else:
                raise AttributeError(name)
        return made[name]


def query(name: str, sql: str | None = None):
    """Register ``plan(inputs) -> DataFrame`` under ``name``, with the SQL giving the same rows."""
    def register(plan):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, folder: plan(Inputs(spark, folder))
        if sql is not None:
            ORACLES[name] = views.with_views(sql)
        return plan
    return register
