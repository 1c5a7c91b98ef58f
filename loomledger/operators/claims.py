"""Claims: drafts, lexical grounding, merging by identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomledger.config import DEFAULT
from loomledger.functions.ids import content_id
from loomledger.functions.text import content_words, is_number, normalise_claim, sentences, strip_marks, trim_ws


def is_grounded(claim: Column | str, passage: Column | str, names: Column | str, share: float = DEFAULT.grounded_share) -> Column:
    """Whether a passage states a claim, by words.

    Every number of the claim is in the passage or the names, and of its other words that are no names at least ``share`` are in the passage;
    a claim that is nothing but names is not grounded. A null passage or claim is not grounded.
    """
    wanted, stated = content_words(claim), content_words(passage)
    named = content_words(names)
    known = F.array_union(stated, named)
    figures = F.size(F.array_except(F.filter(wanted, is_number), known)) == 0
    said = F.array_except(wanted, named)
    found = F.size(F.array_intersect(said, stated))
    return F.coalesce(figures & (F.size(said) > 0) & (found >= share * F.size(said)), F.lit(False))


def claim_key(text: Column | str) -> Column:
    return content_id(normalise_claim(text))


def with_key(rows: DataFrame, text: str = "claim_text") -> DataFrame:
    """``rows`` with claim_id; the normal form is a column of its own, so that it is made once a row."""
    return rows.withColumn("_k", normalise_claim(text)).withColumn("claim_id", content_id(F.col("_k"))).drop("_k")


def drafts(chunks: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """Every sentence of a chunk as a claim, as the stand-in for a model gives them; blank ones left out."""
    rows = chunks.select(key, F.posexplode(sentences(text)).alias("draft_ix", "claim_text"))
    return rows.withColumn("claim_text", trim_ws(strip_marks("claim_text"))).where("claim_text <> ''")


def merge(rows: DataFrame, order: list[str], evidence: list[str]) -> DataFrame:
    """One row per claim: its id, the wording first seen (by ``order``), and the set of its evidence, sorted.

    ``rows``: claim_text and the columns named. A statement may stand in any share of all rows: the map side combines before the shuffle.
    """
    keyed = with_key(rows)
    return keyed.groupBy("claim_id").agg(F.min_by("claim_text", F.struct(*order)).alias("text"), F.array_sort(F.collect_set(F.struct(*evidence))).alias("evidence"))


def merge_counts(rows: DataFrame, group: str) -> DataFrame:
    """Per claim the number of statements and of different groups, without gathering evidence: two aggregations, none holds a group's rows."""
    keyed = with_key(rows).groupBy("claim_id", group).agg(F.count("*").alias("n"))
    return keyed.groupBy("claim_id").agg(F.sum("n").alias("n_statements"), F.count(group).alias("n_groups"))
