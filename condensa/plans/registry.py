"""The register of queries and of their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Register a query under its name, with the SQL that gives the same rows."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark, d):
    return table(spark, d, "documents")


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt over the cores where an input of few row groups would keep most of them idle."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if len(rows.inputFiles()) < cores else rows


def values(rows: list[tuple], names: str) -> str:
    """SQL of a table of given rows."""
    def one(x):
        return "NULL" if x is None else ("TRUE" if x else "FALSE") if isinstance(x, bool) else str(x) if isinstance(x, int | float) else "'" + x.replace("'", "''") + "'"

    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + f") t({names})"
