"""Models in plans: the stand-in as column expressions, or a provider in Arrow batches, behind one set of functions.

A provider is shipped to the tasks and used batch by batch; ``Models()`` is the stand-ins throughout.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from loomledger.functions.text import content_words, sentences, strip_marks, trim_ws
from loomledger.operators.nli import of_words
from loomledger.operators.vectors import cosine, pair_cosine, slots_of
from loomledger.sources.providers import Embedder, Llm, PairScorer, validated

#: What a model is asked for, by stage, and how often.
TASKS = {
    "extract": 'List the statements of fact in the passage, each a sentence that stands alone. Reply {"claims": [text, ...]}.',
    "adjudicate": 'Sources disagree on the claim. Reply {"favours": "supporting" | "contradicting" | "unresolved", "explanation": text, "cites": [place of an evidence, ...]}.',
    "script": 'Write the turns of an episode from the ledger. Quote sources only by {{quote:N}}. Reply {"turns": [{"speaker": "host" | "guest", "text": text, "citations": [claim id], "refs": [{"source": n, "sentence": n, "part": text | null}]}]}.',
}
ATTEMPTS = {"extract": 2, "adjudicate": 2, "script": 3}
SCORES = StructType([StructField(n, DoubleType()) for n in ("entailment", "neutral", "contradiction")])


@dataclass(frozen=True)
class Models:
    llm: Llm | None = None
    embedder: Embedder | None = None
    scorer: PairScorer | None = None

    @property
    def slots(self) -> int | None:
        """What ``vectors.top_k`` is told about vectors."""
        return None if self.embedder else 256

    def with_vector(self, df: DataFrame, text: str, into: str = "vec") -> DataFrame:
        """``df`` with the vector of a text: slots of the stand-in, or an embedding."""
        if self.embedder is None:
            return df.withColumn(into, slots_of(text))
        own = self.embedder

        @F.pandas_udf(ArrayType(DoubleType()))  # type: ignore[call-overload]
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in batches:
                yield pd.Series(own.embed(s.fillna("").tolist()))

        return df.withColumn(into, run(F.col(text)))

    def similarity(self, a: str, b: str) -> Column:
        """The cosine of two columns of ``with_vector``."""
        return pair_cosine(a, b) if self.embedder is None else cosine(a, b)

    def with_scores(self, df: DataFrame, premise: str, hypothesis: str, into: str) -> DataFrame:
        """``df`` with struct<entailment, neutral, contradiction> of two texts."""
        if self.scorer is None:
            words = df.withColumn("_p", content_words(premise)).withColumn("_h", content_words(hypothesis))
            return words.withColumn(into, of_words(F.col("_p"), F.col("_h"))).drop("_p", "_h")
        own = self.scorer

        @F.pandas_udf(SCORES)  # type: ignore[call-overload]
        def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
            for p, h in batches:
                yield pd.DataFrame(own.score(list(zip(p.fillna(""), h.fillna(""), strict=True))), columns=SCORES.names)

        return df.withColumn(into, run(F.col(premise), F.col(hypothesis)))

    def drafts(self, chunks: DataFrame) -> DataFrame:
        """chunk_id, draft_ix and claim_text: the statements of each chunk, blank ones left out. A reply that is none after all attempts is an error."""
        if self.llm is None:
            rows = chunks.select("chunk_id", F.posexplode(sentences("text")).alias("draft_ix", "claim_text"))
        else:
            said = asked(self.llm, "extract", lambda d: [_text(c) for c in _list(d, "claims")])

            @F.pandas_udf(ArrayType(StringType()))  # type: ignore[call-overload]
            def run(s: pd.Series) -> pd.Series:
                return s.map(lambda t: said({"passage": t or ""}))

            rows = chunks.select("chunk_id", F.posexplode(run(F.col("text"))).alias("draft_ix", "claim_text"))
        return rows.withColumn("claim_text", trim_ws(strip_marks("claim_text"))).where("claim_text <> ''")


def asked(llm: Llm, stage: str, parse: Callable[[dict], object]) -> Callable[[dict], object]:
    """Requests to a model whose replies must be JSON that ``parse`` takes; each attempt sees what was wrong with those before."""

    def one(request: dict) -> object:
        def ask(reasons: list[str]) -> str:
            return llm.complete(TASKS[stage], request | ({"rejected_because": reasons} if reasons else {}))

        return validated(ask, lambda reply: parse(json.loads(reply)), ATTEMPTS[stage])

    return one


def _list(d: object, key: str) -> list:
    if not isinstance(d, dict) or set(d) != {key} or not isinstance(d[key], list):
        raise ValueError(f"not an object of {key} alone")
    return d[key]


def _text(x: object) -> str:
    if not isinstance(x, str):
        raise ValueError("not a text")
    return x
