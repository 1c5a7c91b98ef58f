"""Ranks and order statistics that hold for groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def upper_median(rows: DataFrame, key: str, value: str, into: str = "median") -> DataFrame:
    """The value at place n // 2 of each key's sorted values, nulls left out; no key is gathered: equal values are counted first."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(key)
    upto = F.sum("_n").over(w.orderBy(value))
    placed = counts.select(key, value, upto.alias("_upto"), F.sum("_n").over(w).alias("_all"))
    return placed.where(F.col("_upto") > F.floor(F.col("_all") / 2)).groupBy(key).agg(F.min(value).alias(into))


def best_take(takes: DataFrame, key: str, rate_of: DataFrame | None = None) -> DataFrame:
    """Per key the take that passed, then has the lower wer_pm, then the rate nearest to ``median``, then came first.

    ``takes``: key, take, passed, wer_pm, rate, median.
    """
    off = F.coalesce(F.abs(F.col("rate") - F.col("median")), F.lit(0.0))
    rest = [c for c in takes.columns if c != key]
    best = takes.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(~F.coalesce("passed", F.lit(False)), "wer_pm", off, "take")).alias("b"))
    return best.select(key, *[F.col(f"b.{c}").alias(c) for c in rest])


def top_per_key(rows: DataFrame, key: str, k: int, *order) -> DataFrame:
    """The first k rows of each key; ranks are cut before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= k)
