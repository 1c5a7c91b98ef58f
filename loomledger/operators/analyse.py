"""Checks of scripts against their sources, and measures of what they cite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomledger.config import DEFAULT
from loomledger.functions.text import byte_slice, quotations, word_count, words_of


def quote_findings(turns: DataFrame, docs: DataFrame) -> DataFrame:
    """turn_id, kind, check_ix, severity and message of the quotes that do not hold; kind is quote or quotation.

    A quote of an unknown document, else one that differs from the source at its place, else one its turn does not speak is an error, and so is
    every quotation in a turn that no quote covers. ``turns``: turn_id, text, quotes; ``docs``: doc_id, text.
    """
    q = turns.select("turn_id", F.col("text").alias("turn_text"), F.posexplode("quotes").alias("check_ix", "q"))
    d = docs.select(F.col("doc_id").alias("document"), F.col("text").alias("doc_text"), F.lit(True).alias("known"))
    j = q.withColumn("document", F.col("q.document")).join(d, "document", "left")
    sliced = byte_slice("doc_text", F.col("q.span.start"), F.col("q.span.stop"))
    message = (
        F.when(F.col("known").isNull(), F.concat(F.lit("quote cites unknown document "), F.coalesce(F.col("document").cast("string"), F.lit("null"))))
        .when(~F.coalesce(sliced == F.col("q.text"), F.lit(False)), F.concat(F.lit("quote does not match the source: "), F.coalesce("q.text", F.lit(""))))
        .when(~F.coalesce(F.contains("turn_text", F.col("q.text")), F.lit(False)), F.concat(F.lit("turn does not speak the quote: "), F.col("q.text")))
    )
    bad = j.select("turn_id", F.lit("quote").alias("kind"), "check_ix", message.alias("message")).where("message is not null")
    spans = turns.select("turn_id", F.coalesce("quotes", F.array().cast(turns.schema["quotes"].dataType)).alias("quotes"), F.posexplode(quotations("text")).alias("check_ix", "quoted"))
    loose = spans.where(~F.exists("quotes", lambda x: F.coalesce(F.contains(x["text"], F.col("quoted")), F.lit(False))))
    return bad.unionByName(loose.select("turn_id", F.lit("quotation").alias("kind"), "check_ix", F.concat(F.lit("turn quotes words no quote covers: "), F.col("quoted")).alias("message"))).select("turn_id", "kind", "check_ix", F.lit("error").alias("severity"), "message")


def outside_quotes(text: Column | str, quotes: Column | str) -> Column:
    """A turn's text with each of its quotes replaced by a space."""
    t, q = (F.col(x) if isinstance(x, str) else x for x in (text, quotes))
    return F.aggregate(F.coalesce(q, F.array().cast("array<struct<text:string>>")) if not isinstance(quotes, str) else F.transform(q, lambda x: x["text"]), t, lambda acc, x: F.when(F.coalesce(x, F.lit("")) == "", acc).otherwise(F.replace(acc, x, F.lit(" "))))


def uncited_figures(turns: DataFrame) -> DataFrame:
    """turn_id, figure and message of the turns that state a figure outside their quotes but cite nothing: their first such word, marks at its ends left out."""
    bare = turns.where(F.coalesce(F.size("citations"), F.lit(0)) <= 0).withColumn("_t", outside_quotes("text", "quotes"))
    word = F.get(F.filter(words_of("_t"), lambda w: w.rlike("[0-9]")), F.lit(0))
    figure = F.regexp_replace(word, r"\A[^\p{IsAlphabetic}\p{N}]+|[^\p{IsAlphabetic}\p{N}]+\z", "")
    return bare.select("turn_id", figure.alias("figure")).where("figure is not null").withColumn("message", F.concat(F.lit("turn states "), F.col("figure"), F.lit(" but cites no claim")))


def script_metrics(turns: DataFrame, ledger: DataFrame, verdicts: DataFrame | None = None, minutes: int = 10) -> DataFrame:
    """Per script: words, word_ratio, turns, quotes, citations, distinct_cited, cited_unsupported, coverage, judged_cited and unknown_citations.

    ``turns``: script_id, turn_id, text, quotes, citations, one row a turn; ``ledger``: claim_id, status. A rate of nothing is 0.
    """
    base = turns.groupBy("script_id").agg(F.sum(word_count(F.coalesce("text", F.lit("")))).alias("words"), F.count("*").alias("turns"), F.sum(F.greatest(F.lit(0), F.coalesce(F.size("quotes"), F.lit(0)))).alias("quotes"), F.sum(F.greatest(F.lit(0), F.coalesce(F.size("citations"), F.lit(0)))).alias("citations"))
    # repeated citations are counted before the join
    cites = turns.select("script_id", F.explode("citations").alias("claim_id")).groupBy("script_id", "claim_id").agg(F.count("*").alias("times"))
    judged = (verdicts if verdicts is not None else ledger.where("status = 'contested'")).select("claim_id").distinct().withColumn("judged", F.lit(1))
    j = cites.join(ledger.select("claim_id", "status"), "claim_id", "left").join(judged, "claim_id", "left")
    per = j.groupBy("script_id").agg(
        F.sum(F.when(F.col("status") != "unsupported", 1).otherwise(0)).alias("distinct_cited"), F.sum(F.when(F.col("status") == "unsupported", 1).otherwise(0)).alias("cited_unsupported"),
        F.sum(F.when(F.col("status").isNull(), F.col("times")).otherwise(0)).alias("unknown_citations"), F.sum(F.when(F.col("status").isNotNull(), F.coalesce("judged", F.lit(0))).otherwise(0)).alias("judged_cited"),
    )
    usable = ledger.where("status <> 'unsupported'").agg(F.count("*").alias("usable_claims"))
    out = base.join(per, "script_id", "left").crossJoin(F.broadcast(usable))  # one row against all
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return out.select(
        "script_id", "words", (F.col("words") / (DEFAULT.words_per_minute * minutes)).alias("word_ratio"), "turns", "quotes", "citations", zero("distinct_cited"), zero("cited_unsupported"), "usable_claims",
        F.when(F.col("usable_claims") > 0, F.coalesce("distinct_cited", F.lit(0)) / F.col("usable_claims")).otherwise(0.0).alias("coverage"), zero("judged_cited"), zero("unknown_citations"),
    )


def citation_overlap(cites: DataFrame, key: str) -> DataFrame:
    """a < b: how far the cited claims of each two keys agree: shared, only_a, only_b and jaccard.

    ``cites``: key and claim_id. The number of keys is the caller's bound; claims that two keys share meet over the claim.
    """
    own = cites.select(key, "claim_id").where("claim_id is not null").distinct()
    sizes = own.groupBy(key).agg(F.count("*").alias("n"))
    shared = own.select(F.col(key).alias("a"), "claim_id").join(own.select(F.col(key).alias("b"), "claim_id"), "claim_id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    pairs = sizes.select(F.col(key).alias("a"), F.col("n").alias("na")).join(sizes.select(F.col(key).alias("b"), F.col("n").alias("nb")), F.col("a") < F.col("b"))
    j = pairs.join(shared, ["a", "b"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    union = F.col("na") + F.col("nb") - F.col("shared")
    return j.select("a", "b", "shared", (F.col("na") - F.col("shared")).alias("only_a"), (F.col("nb") - F.col("shared")).alias("only_b"), F.when(union > 0, F.col("shared") / union).otherwise(1.0).alias("jaccard"))


def by_severity(findings: DataFrame) -> DataFrame:
    """How many findings there are of each severity; a run with errors has failed."""
    return findings.groupBy("severity").agg(F.count("*").alias("n"))
