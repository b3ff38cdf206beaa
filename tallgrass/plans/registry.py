"""Queries by name, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers (tables -> DataFrame) under a name; tables.documents is the table of that name, and so on."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


class Tables:
    """The driver's tables of one folder, read when asked for. Times without zone count as UTC."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return df.withColumns({c: df[c].cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"})


def stamp(c: Column) -> Column:
    """A time as text, alike in every engine; in SQL strftime(c, '%Y-%m-%d %H:%M:%S')."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
