"""Registration of queries: a job over the driver tables, and the DuckDB SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bindings import PLANNED, TABLES, VIEWS

_NAME = re.compile(r"\{(" + "|".join([*TABLES, *VIEWS]) + r")\}")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The driver tables of one folder and the views over them, as DataFrames by attribute."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        elif name in VIEWS:
            df = self.sql(PLANNED.get(name, VIEWS[name]))
            if name == "feed":  # made from one small file; a delivered feed comes in many parts
                df = df.repartition(self.spark.sparkContext.defaultParallelism, "row_idx")
        else:
            raise AttributeError(name)
        self.__dict__[name] = df
        return df

    def sql(self, text: str) -> DataFrame:
        """Spark SQL in which {name} stands for a table or view."""
        return self.spark.sql(text, **{n: getattr(self, n) for n in sorted(set(_NAME.findall(text)))})


def duckdb_sql(text: str) -> str:
    """The same for DuckDB: views become common table expressions in front of the query."""
    order: list[str] = []

    def need(body: str) -> None:
        for name in _NAME.findall(body):
            if name in VIEWS and name not in order:
                need(VIEWS[name])
                order.append(name)

    need(text)
    plain = lambda s: _NAME.sub(r"\1", s)
    views = ", ".join(f"{n} AS ({plain(VIEWS[n])})" for n in order)
    body = plain(text).strip()
    if not views:
        return body
    if m := re.match(r"with\s+(recursive\s+)?", body, re.I):
        return f"WITH {m[1] or ''}{views}, {body[m.end() :]}"
    return f"WITH {views} {body}"


def query(oracle: str | None = None) -> Callable:
    """Register a function of ``Tables`` under its name."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if oracle:
            ORACLES[f.__name__] = duckdb_sql(oracle)
        return f

    return add
