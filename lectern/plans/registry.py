"""Queries by name, with the SQL that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The tables of a folder, read when named."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text)

    def rows(self, schema: str, *rows: tuple) -> DataFrame:
        return self.spark.createDataFrame(list(rows), schema)


def query(name: str, sql: str | None = None):
    def add(f: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is there already")
        QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        if sql is not None:
            # A class label that some engines reserve as a word of joins.
            SQL[name] = re.sub(r"(?<!['\"\w])anti(?!['\"\w])", '"anti"', sql)
        return f

    return add


def r6(x: Column) -> Column:
    """Rounded, as sums of doubles depend on their order."""
    return F.round(x, 6)


def i64(x: Column) -> Column:
    return x.cast("long")
