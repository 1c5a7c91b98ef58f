"""Stances: what a premise says about a claim."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomledger.config import DEFAULT, Settings
from loomledger.functions.ids import per_mille
from loomledger.functions.text import numbers, sentences
from loomledger.operators.models import Models
from loomledger.operators.nli import stand_in


def reverse_hypotheses(premise: Column | str) -> Column:
    """The sentences of a premise that hold a number, then the whole of it where another sentence holds none; empty where none does."""
    p = F.col(premise) if isinstance(premise, str) else premise
    all_ = sentences(p)
    numbered = F.filter(all_, lambda s: F.size(numbers(s)) > 0)
    return F.when((F.size(numbered) > 0) & (F.size(numbered) < F.size(all_)), F.concat(numbered, F.array(p))).otherwise(numbered)


def holds_both_ways(claim: Column | str, premise: Column | str, reverse_pm: Column, settings: Settings = DEFAULT) -> Column:
    """True unless both texts hold numbers; then the reverse contradiction must reach the bar, and a missing one does not."""
    free = (F.size(numbers(claim)) == 0) | (F.size(numbers(premise)) == 0)
    return free | (F.coalesce(reverse_pm, F.lit(0)) >= settings.contradict_pm)


def decide(claim, premise, sim_pm: Column, entail_pm: Column, contra_pm: Column, reverse_pm: Column, settings: Settings = DEFAULT) -> Column:
    """'supports', 'contradicts' or null."""
    against = (contra_pm >= settings.contradict_pm) & (sim_pm >= settings.contradict_similarity_pm) & holds_both_ways(claim, premise, reverse_pm, settings)
    return F.when(entail_pm >= settings.support_pm, F.lit("supports")).when(against, F.lit("contradicts"))


def score(pairs: DataFrame, settings: Settings = DEFAULT, models: Models = Models()) -> DataFrame:
    """``pairs`` (claim, premise) with sim_pm, entail_pm, contra_pm, reverse_pm and stance.

    The reverse scores are only taken of pairs that would contradict with the best of them.
    """
    rows = models.with_vector(models.with_vector(pairs, "premise", "_p"), "claim", "_h")
    rows = models.with_scores(rows.withColumn("sim_pm", per_mille(models.similarity("_h", "_p"))).drop("_p", "_h"), "premise", "claim", "_n")
    rows = rows.withColumn("entail_pm", per_mille(F.col("_n.entailment"))).withColumn("contra_pm", per_mille(F.col("_n.contradiction"))).drop("_n")
    would = (F.col("entail_pm") < settings.support_pm) & (F.col("contra_pm") >= settings.contradict_pm) & (F.col("sim_pm") >= settings.contradict_similarity_pm) & (F.size(numbers("claim")) > 0)
    if models.scorer is None:
        reverse = F.array_max(F.transform(reverse_hypotheses("premise"), lambda h: per_mille(stand_in(F.col("claim"), h)["contradiction"])))
        rows = rows.withColumn("reverse_pm", F.when(would, reverse))
    else:
        rows = rows.withColumn("_row", F.monotonically_increasing_id()).withColumn("_hyp", F.explode_outer(F.when(would, reverse_hypotheses("premise"))))
        keep = [c for c in rows.columns if c != "_hyp"]
        asked = models.with_scores(rows.where("_hyp is not null"), "claim", "_hyp", "_r").groupBy(*keep).agg(F.max(per_mille(F.col("_r.contradiction"))).alias("reverse_pm"))
        rows = asked.unionByName(rows.where("_hyp is null").drop("_hyp").withColumn("reverse_pm", F.lit(None).cast("int"))).drop("_row")
    return rows.withColumn("stance", decide("claim", "premise", F.col("sim_pm"), F.col("entail_pm"), F.col("contra_pm"), F.col("reverse_pm"), settings))


def deciding(judged: DataFrame) -> DataFrame:
    """Per claim_id and chunk_id the row that decides: support before contradiction, then the higher score, then the more similar (lower rank)."""
    own = F.struct((F.col("stance") == "supports").alias("s"), F.when(F.col("stance") == "supports", F.col("entail_pm")).otherwise(F.col("contra_pm")).alias("p"), (-F.col("rank")).alias("r"))
    rest = [c for c in judged.columns if c not in ("claim_id", "chunk_id")]
    best = judged.where("stance is not null").groupBy("claim_id", "chunk_id").agg(F.max_by(F.struct(*rest), own).alias("b"))
    return best.select("claim_id", "chunk_id", *[F.col(f"b.{c}").alias(c) for c in rest])


def report(rows: DataFrame, label: str = "label", stance: str = "stance") -> DataFrame:
    """stance, tp, fp, fn, precision_pm and recall_pm over labelled pairs; a rate of nothing is null."""
    kinds = rows.sparkSession.createDataFrame([("supports",), ("contradicts",)], "kind string")
    counts = rows.groupBy(label, stance).count()
    hit = lambda c: F.sum(F.when(c, F.col("count")).otherwise(0))
    x = F.broadcast(kinds).crossJoin(counts)  # two rows against at most twelve
    said, true = F.coalesce(F.col(stance), F.lit("")) == F.col("kind"), F.col(label) == F.col("kind")
    out = x.groupBy("kind").agg(hit(said & true).alias("tp"), hit(said & ~true).alias("fp"), hit(~said & true).alias("fn"))
    rate = lambda a, b: F.when(a + b > 0, F.round(1000 * a / (a + b)).cast("int"))
    return out.select(F.col("kind").alias("stance"), "tp", "fp", "fn", rate(F.col("tp"), F.col("fp")).alias("precision_pm"), rate(F.col("tp"), F.col("fn")).alias("recall_pm"))
