"""The ledger: what the evidence of a claim makes of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomledger.functions.text import fold_group


def groups_of(evidence: Column | str, stance: str, fold: bool = True) -> Column:
    """The different groups whose evidence takes a stance, sorted; evidence without a group counts for none. Row by row, no shuffle."""
    e = F.col(evidence) if isinstance(evidence, str) else evidence
    own = F.transform(F.filter(e, lambda x: x["stance"] == stance), lambda x: fold_group(x["independence_group"]) if fold else x["independence_group"])
    return F.array_sort(F.array_distinct(F.filter(own, lambda g: g.isNotNull() & (g != ""))))


def classify(claims: DataFrame, evidence: str = "evidence", fold: bool = True) -> DataFrame:
    """``claims`` with status, groups, grp, supporting and contradicting.

    Any contradicting group makes a claim contested, else two supporting groups corroborate it, one is a single source, none leaves it
    unsupported. Null evidence is none.
    """
    e = F.coalesce(F.col(evidence), F.array().cast(claims.schema[evidence].dataType))
    rows = claims.withColumn("_s", groups_of(e, "supports", fold)).withColumn("_c", groups_of(e, "contradicts", fold))
    status = F.when(F.size("_c") > 0, "contested").when(F.size("_s") > 1, "corroborated").when(F.size("_s") == 1, "single_source").otherwise("unsupported")
    rows = rows.withColumn("status", status)
    return rows.select(
        *claims.columns, "status", F.when(F.col("status") == "corroborated", F.col("_s")).alias("groups"), F.when(F.col("status") == "single_source", F.element_at("_s", 1)).alias("grp"),
        F.when(F.col("status") == "contested", F.col("_s")).alias("supporting"), F.when(F.col("status") == "contested", F.col("_c")).alias("contradicting"),
    )


def tampered(ledger: DataFrame) -> DataFrame:
    """Rows whose stored status is not what their evidence gives."""
    again = classify(ledger.select("claim_id", "evidence"))
    return ledger.select("claim_id", F.col("status").alias("stored")).join(again.select("claim_id", "status"), "claim_id").where(~F.col("stored").eqNullSafe(F.col("status")))


def first_appearance(claims: DataFrame, chunks: DataFrame, *order: str) -> DataFrame:
    """claim_id and the columns of ``order`` of the first of the chunks of its evidence, by all of them; null where no chunk is known, which comes after all others."""
    e = claims.select("claim_id", F.explode_outer("evidence.chunk").alias("chunk_id"))
    place = F.when(F.col("_known"), F.struct(*order))
    found = e.join(chunks.select("chunk_id", *order, F.lit(True).alias("_known")), "chunk_id", "left").groupBy("claim_id").agg(F.min(place).alias("_p"))
    return found.select("claim_id", *[F.col(f"_p.{c}").alias(c) for c in order])
