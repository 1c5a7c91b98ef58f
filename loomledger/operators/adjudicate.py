"""Contested claims: their passages, verdicts and the checks on them."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomledger.functions.text import byte_slice
from loomledger.operators.models import asked
from loomledger.sources.providers import Llm

FALLBACK = "No verdict could be reached on the evidence."


def passages(contested: DataFrame, chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """claim_id, ev_ix, stance, title and passage: the premise a model read, else the wording of a merged claim, else the chunk's text.

    ``contested``: claim_id, evidence (with chunk, stance and, where there is one, basis); evidence of an unknown chunk has null title and passage.
    """
    e = contested.select("claim_id", F.posexplode("evidence").alias("ev_ix", "e"))
    fields = {f.name for f in contested.schema["evidence"].dataType.elementType.fields}
    rows = e.withColumn("chunk_id", F.col("e.chunk")).join(chunks.select("chunk_id", "doc_id", F.col("text").alias("chunk_text")), "chunk_id", "left")
    rows = rows.join(docs.select("doc_id", "title", F.col("text").alias("doc_text")), "doc_id", "left")
    if "basis" in fields:
        b = F.col("e.basis")
        own = F.when(b["kind"] == "nli", byte_slice("doc_text", b["premise"]["start"], b["premise"]["stop"])).when(b["kind"] == "merged", b["wording"]).otherwise(F.col("chunk_text"))
    else:
        own = F.col("chunk_text")
    return rows.select("claim_id", "ev_ix", F.col("e.stance").alias("stance"), "title", own.alias("passage"))


def fallback(contested: DataFrame) -> DataFrame:
    """The verdict where no other is valid: unresolved, citing the first evidence on each side."""
    first = lambda s: F.get(F.filter("evidence", lambda e: e["stance"] == s), F.lit(0))["chunk"]
    return contested.select("claim_id", F.lit("unresolved").alias("favours"), F.lit(FALLBACK).alias("explanation"), F.array_compact(F.array(first("supports"), first("contradicts"))).alias("cites"))


def verdicts(contested: DataFrame, chunks: DataFrame, docs: DataFrame, llm: Llm | None = None) -> DataFrame:
    """A verdict on each contested claim: the model's where it has one that holds, else the fallback. ``cites`` are chunks."""
    if llm is None:
        return fallback(contested)
    seen = passages(contested, chunks, docs).groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct("ev_ix", "stance", "title", "passage"))).alias("p"))
    rows = contested.select("claim_id", "text", "evidence").join(seen, "claim_id")

    def parse(d: dict) -> tuple:
        if not isinstance(d, dict) or not isinstance(d.get("favours"), str) or not isinstance(d.get("explanation"), str) or not all(isinstance(i, int) and not isinstance(i, bool) for i in d.get("cites", [None])):
            raise ValueError("not a verdict")
        return d["favours"], d["explanation"], d["cites"]

    ask = asked(llm, "adjudicate", parse)

    @F.pandas_udf("struct<favours:string,explanation:string,cites:array<int>>")  # type: ignore[call-overload]
    def run(claim: pd.Series, about: pd.Series) -> pd.DataFrame:
        out = []
        for c, a in zip(claim, about, strict=True):
            try:
                out.append(ask({"claim": c, "evidence": json.loads(a)}))
            except ValueError:
                out.append((None, None, None))
        return pd.DataFrame(out, columns=["favours", "explanation", "cites"])

    said = rows.select("claim_id", "evidence", run(F.col("text"), F.to_json("p")).alias("v")).select("claim_id", "evidence", "v.*")
    given = said.where("favours is not null")
    good = given.join(invalid_verdicts(given.drop("evidence"), contested).select("claim_id"), "claim_id", "left_anti")
    own = good.select("claim_id", "favours", "explanation", F.transform("cites", lambda i: F.get("evidence", i)["chunk"]).alias("cites"))
    return own.unionByName(fallback(contested.join(own.select("claim_id"), "claim_id", "left_anti")))


def invalid_verdicts(verdicts: DataFrame, claims: DataFrame) -> DataFrame:
    """claim_id and the first problem of every verdict that does not hold.

    ``verdicts``: claim_id, favours, explanation, cites (places in the claim's evidence); ``claims``: claim_id, evidence.
    """
    j = verdicts.join(claims.select("claim_id", "evidence"), "claim_id", "left")
    n = F.coalesce(F.size("evidence"), F.lit(0))
    has = lambda s: F.exists("evidence", lambda e: e["stance"] == s)
    cited = lambda s: F.exists(F.transform("cites", lambda i: F.get(F.col("evidence"), i)), lambda e: F.coalesce(e["stance"] == s, F.lit(False)))
    problem = (
        F.when(F.col("evidence").isNull(), "unknown claim").when(F.exists("cites", lambda i: (i < 0) | (i >= n)), "cites out of range")
        .when(has("supports") & ~cited("supports"), "a supporting side is not cited").when(has("contradicts") & ~cited("contradicts"), "a contradicting side is not cited")
        .when((F.col("favours") == "supporting") & ~has("supports"), "favours a side without evidence").when((F.col("favours") == "contradicting") & ~has("contradicts"), "favours a side without evidence")
        .when(~F.col("favours").isin("supporting", "contradicting", "unresolved"), "unknown side").when(F.char_length("explanation") > 600, "explanation too long").when(F.col("explanation").rlike('["“”]'), "explanation quotes")
    )
    return j.select("claim_id", problem.alias("problem")).where("problem is not null")


def tallies(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("favours").agg(F.count("*").alias("n"))
