"""Claims of one meaning under two wordings: candidate pairs, mutual entailment, complete-linkage clusters."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomledger.config import DEFAULT, Settings
from loomledger.functions.ids import per_mille
from loomledger.functions.text import content_words, is_number, numbers
from loomledger.operators.models import Models
from loomledger.operators.nli import of_words
from loomledger.operators.vectors import similar, top_k
from loomledger.tables import settle


def nominated(claims: DataFrame, settings: Settings = DEFAULT, models: Models = Models()) -> DataFrame:
    """a < b: the pairs of claims of which one is among the ``merge_partners`` most similar of the other, in the order of claim_id.

    The cut comes before any veto, so vetoed partners use up places.
    """
    # ids are hex digests: their first 60 bits keep their order, without numbering all rows in one task
    place = F.conv(F.substring("claim_id", 1, 15), 16, 10).cast("bigint")
    rows = settle(models.with_vector(claims.select("claim_id", "text", F.xxhash64("claim_id").alias("id"), place.alias("ord")), "text"), "claims")
    if models.slots:
        best = similar(rows, settings.merge_partners, settings.merge_similarity_pm)
    else:
        best = top_k(rows.select("id", "vec", F.array().cast("array<string>").alias("grp")), rows.select("id", "ord", "vec", F.lit(None).cast("string").alias("grp")), settings.merge_partners, settings.merge_similarity_pm, slots=None)
    pairs = best.select(F.least("qid", "cid").alias("x"), F.greatest("qid", "cid").alias("y")).distinct()
    named = rows.select("id", "claim_id", "text")
    a = named.select(F.col("id").alias("x"), F.col("claim_id").alias("a"), F.col("text").alias("text_a"))
    b = named.select(F.col("id").alias("y"), F.col("claim_id").alias("b"), F.col("text").alias("text_b"))
    rows = pairs.join(a, "x").join(b, "y")
    swap = F.col("a") > F.col("b")
    pick = lambda u, v: F.when(swap, F.col(v)).otherwise(F.col(u))
    return rows.select(pick("a", "b").alias("a"), pick("b", "a").alias("b"), pick("text_a", "text_b").alias("text_a"), pick("text_b", "text_a").alias("text_b"))


def equivalent(pairs: DataFrame, veto: bool = True, settings: Settings = DEFAULT, models: Models = Models()) -> DataFrame:
    """a, b and mutual_pm of the pairs that entail each other both ways; with the veto, only where the numbers are the same."""
    if models.scorer is None:  # the stand-in reads words, which are taken once a text
        pairs = pairs.withColumn("_a", content_words("text_a")).withColumn("_b", content_words("text_b"))
        pairs = pairs.where(F.filter("_a", is_number) == F.filter("_b", is_number)) if veto else pairs
        pairs = pairs.withColumn("_f", of_words(F.col("_a"), F.col("_b"))).withColumn("_g", of_words(F.col("_b"), F.col("_a")))
    else:
        pairs = pairs.where(numbers("text_a") == numbers("text_b")) if veto else pairs
        pairs = models.with_scores(models.with_scores(pairs, "text_a", "text_b", "_f"), "text_b", "text_a", "_g")
    return pairs.select("a", "b", F.least(per_mille(F.col("_f.entailment")), per_mille(F.col("_g.entailment"))).alias("mutual_pm")).where(F.col("mutual_pm") >= settings.merge_entailment_pm)


def _stars(edges: DataFrame) -> DataFrame:
    """Edges of the same components, from each node to the least one that its partition's edges join it with; few edges lie in one partition, which then has whole components."""

    def run(batches):
        root: dict[str, str] = {}

        def find(x: str) -> str:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = find(root.setdefault(a, a)), find(root.setdefault(b, b))
                root[max(x, y)] = min(x, y)
        nodes = list(root)
        yield pa.RecordBatch.from_arrays([pa.array([find(n) for n in nodes], pa.string()), pa.array(nodes, pa.string())], names=["a", "b"])

    return edges.select(F.col("a").cast("string"), F.col("b").cast("string")).where("a is not null and b is not null").repartition("a").mapInArrow(run, "a string, b string")


def components(edges: DataFrame) -> DataFrame:
    """node and comp (its least node) of every node on an edge (a, b).

    Partitions contract their own edges to stars first; labels then go from node to node and jump to their label's label, until none moves.
    """
    stars = _stars(edges)
    both = settle(stars.union(stars.select(F.col("b"), F.col("a"))).distinct(), "edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("comp"))
    while True:  # a label at least doubles its reach in a round
        heard = both.join(labels.select(F.col("node").alias("b"), F.col("comp").alias("h")), "b").groupBy(F.col("a").alias("node")).agg(F.min("h").alias("h"))
        step = labels.join(heard, "node").select("node", F.least("comp", "h").alias("c"), F.col("comp").alias("old"))
        jump = step.select(F.col("node").alias("c"), F.col("c").alias("cc"))
        labels = settle(step.join(jump, "c").select("node", F.least("c", "cc").alias("comp"), (F.least("c", "cc") < F.col("old")).alias("moved")), "labels")
        if not labels.where("moved").limit(1).count():
            return labels.select("node", "comp")
        labels = labels.select("node", "comp")


def greedy(members: list[str], edges: set[tuple[str, str]]) -> dict[str, str]:
    """Each member's lead: in order, the first free one leads, and later ones join it that have an edge to all of its cluster."""
    lead: dict[str, str] = {}
    near: dict[str, set[str]] = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    order = sorted(members)
    for m in order:
        if m in lead:
            continue
        lead[m] = m
        open_to = set(near.get(m, ()))
        for other in sorted(open_to):
            if other > m and other not in lead and other in open_to:
                lead[other] = m
                open_to &= near[other] | {other}
    return lead


#: Edges of a component up to which one task takes it.
COMPONENT = 1_000_000


def clusters(edges: DataFrame, most: int = COMPONENT) -> DataFrame:
    """claim_id and lead of every claim on an edge: complete linkage, so A and C are apart where only B is near both.

    A connected component of up to ``most`` edges is one task's; larger ones are taken apart lead by lead (``in_rounds``), with the same result.
    """
    edges = settle(edges.select("a", "b"), "equivalent")
    comp = components(edges)
    with_comp = edges.join(comp.select(F.col("node").alias("a"), "comp"), "a").select("comp", "a", "b")
    large = settle(with_comp.groupBy("comp").agg(F.count("*").alias("n")).where(F.col("n") > most).select("comp"), "large")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pairs = set(zip(pdf.a, pdf.b, strict=True))
        lead = greedy(sorted({*pdf.a, *pdf.b}), pairs)
        return pd.DataFrame({"claim_id": list(lead), "lead": list(lead.values())})

    out = with_comp.join(large, "comp", "left_anti").groupBy("comp").applyInPandas(run, "claim_id string, lead string")
    return out.unionByName(in_rounds(with_comp.join(large, "comp", "left_semi").select("a", "b"))) if large.limit(1).count() else out


def in_rounds(edges: DataFrame) -> DataFrame:
    """The same for a component of any size. A claim that is the least of all within two steps leads now: no lesser one can take it or any of its neighbours.

    All such claims take their clusters in one round, a task for each claim and its neighbours; what they took goes, and claims left without a neighbour lead themselves.
    """
    both = settle(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "round")
    done = None

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf["lead"].iloc[0]
        among = pdf[pdf["m"].notna()]
        pairs = {(first, n) for n in pdf["n"]} | {(min(n, m), max(n, m)) for n, m in zip(among["n"], among["m"], strict=True)}
        own = [n for n, lead in greedy(sorted({first, *pdf["n"]}), pairs).items() if lead == first]
        return pd.DataFrame({"claim_id": own, "lead": first})

    while both.limit(1).count():
        near = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        far = both.join(near.select(F.col("a").alias("b"), "m"), "b").groupBy("a").agg(F.min("m").alias("far"))
        leads = near.join(far, "a").where(F.col("a") == F.least("m", "far")).select("a")
        star = settle(both.join(leads, "a").select(F.col("a").alias("lead"), F.col("b").alias("n")), "star")
        inner = star.join(both.select(F.col("a").alias("n"), F.col("b").alias("m")), "n").join(star.select("lead", F.col("n").alias("m")), ["lead", "m"])
        rows = star.select("lead", "n", F.lit(None).cast("string").alias("m")).unionByName(inner.select("lead", "n", "m"))
        got = settle(rows.groupBy("lead").applyInPandas(run, "claim_id string, lead string"), "got")
        taken = got.select("claim_id")
        left = settle(both.join(taken.withColumnRenamed("claim_id", "a"), "a", "left_anti").join(taken.withColumnRenamed("claim_id", "b"), "b", "left_anti").select("a", "b"), "round")
        alone = both.select("a").distinct().join(taken.withColumnRenamed("claim_id", "a"), "a", "left_anti").join(left.select("a").distinct(), "a", "left_anti").select(F.col("a").alias("claim_id"), F.col("a").alias("lead"))
        now = got.unionByName(alone)
        done, both = now if done is None else done.unionByName(now), left
    return done if done is not None else edges.select(F.col("a").alias("claim_id"), F.col("a").alias("lead")).limit(0)
