"""Grounding by entailment: a claim's evidence stays where a window of its own chunk entails it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomledger.config import DEFAULT, Settings
from loomledger.functions.ids import per_mille
from loomledger.operators.models import Models


def judge(evidence: DataFrame, windows: DataFrame, settings: Settings = DEFAULT, models: Models = Models()) -> DataFrame:
    """claim_id, chunk_id, text, entail_pm and premise of the best window of each piece of evidence.

    ``evidence``: claim_id, chunk_id, text; ``windows``: chunk_id, first, n_sents, slice, premise. The ``ground_k`` windows of the
    chunk with the highest cosine are judged; the highest entailment decides, ties go to the more similar. Without a window both are null.
    """
    ev = evidence.distinct()
    # vectors are taken once a text, before the pairs are made
    w, h = models.with_vector(windows, "premise", "_wv"), models.with_vector(ev, "text", "_cv")
    pairs = h.join(w, "chunk_id").withColumn("cos", models.similarity("_cv", "_wv")).drop("_cv", "_wv")
    rank = F.row_number().over(Window.partitionBy("claim_id", "chunk_id").orderBy(F.desc("cos"), "first", "n_sents", "slice"))
    top = pairs.withColumn("rank", rank).where(F.col("rank") <= settings.ground_k)
    scored = models.with_scores(top, "premise", "text", "_s").withColumn("entail_pm", per_mille(F.col("_s.entailment")))
    best = scored.groupBy("claim_id", "chunk_id").agg(F.max_by(F.struct("entail_pm", "premise"), F.struct(F.col("entail_pm"), -F.col("rank"))).alias("b"))
    return ev.join(best, ["claim_id", "chunk_id"], "left").select("claim_id", "chunk_id", "text", F.col("b.entail_pm").alias("entail_pm"), F.col("b.premise").alias("premise"))


def keep(judged: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    return judged.where(F.col("entail_pm") >= settings.ground_pm)


def reject(judged: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    return judged.where(F.coalesce(F.col("entail_pm") < settings.ground_pm, F.lit(True)))


def dropped_claims(judged: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """The claims of which no evidence is kept."""
    best = judged.groupBy("claim_id").agg(F.max("entail_pm").alias("best_pm"))
    return best.where(F.coalesce(F.col("best_pm") < settings.ground_pm, F.lit(True)))
