"""Where queries and the SQL that checks them are put together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomledger.tables import latest, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql_text: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql_text is not None:
            SQL[f.__name__] = sql_text
        return f

    return add


def bar(c) -> F.Column:
    return F.array_join(c, "|")


def chunks_of(spark: SparkSession, root: str) -> DataFrame:
    return latest(table(spark, root, "chunks"), "chunk_id")


def turns_of(spark: SparkSession, root: str) -> DataFrame:
    return latest(table(spark, root, "script_turns"), "turn_id")


def pieces_of(spark: SparkSession, root: str) -> DataFrame:
    return latest(table(spark, root, "pieces"), "piece_id")
