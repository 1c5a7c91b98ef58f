"""Scripts built from drafts: sources numbered for a writer, its references resolved, placeholders filled, and the first error named."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomledger.functions.text import quotations
from loomledger.operators.script import fill_quotes
from loomledger.operators.windows import sentence_spans


def numbered(chunks: DataFrame) -> DataFrame:
    """source_no, sent_no, doc_id, sentence, its byte place in the document and the quotations in it.

    ``chunks``: source_no (the place of the chunk in the request), doc_id, start (its byte in the document), text.
    """
    # what a sentence needs of its chunk travels with it, so nothing is joined
    spans = sentence_spans(chunks.select(F.struct("source_no", "doc_id", F.col("start").alias("at")).alias("_k"), "text"), "_k")
    place = F.struct((F.col("_k.at") + F.col("start")).alias("start"), (F.col("_k.at") + F.col("stop")).alias("stop"))
    return spans.select("_k.source_no", F.col("sent_ix").alias("sent_no"), "_k.doc_id", "sentence", place.alias("span"), quotations("sentence").alias("quoted"))


def resolve(refs: DataFrame, sources: DataFrame) -> DataFrame:
    """``refs`` (script_id, turn, ref_ix, source_no, sent_no, part) with document, span, text and error.

    A null ``part`` is the whole sentence, else the first place of the part in it. Errors: 'no such source', 'no such sentence', 'not in that sentence'.
    """
    known = sources.select("source_no", F.lit(True).alias("_known")).distinct()
    j = refs.join(known, "source_no", "left").join(sources.select("source_no", "sent_no", "doc_id", "sentence", "span"), ["source_no", "sent_no"], "left")
    at = F.expr("locate(part, sentence)")
    before = F.octet_length(F.expr("substring(sentence, 1, greatest(locate(part, sentence) - 1, 0))"))
    error = F.when(F.col("_known").isNull(), "no such source").when(F.col("sentence").isNull(), "no such sentence").when(F.col("part").isNotNull() & ((at == 0) | (F.col("part") == "")), "not in that sentence")
    start = F.col("span.start") + F.when(F.col("part").isNull(), 0).otherwise(before)
    own = F.coalesce("part", "sentence")
    span = F.struct(start.alias("start"), (start + F.octet_length(own)).alias("stop"))
    rows = j.withColumn("error", error)
    fine = F.col("error").isNull()
    return rows.select("script_id", "turn", "ref_ix", F.when(fine, F.col("doc_id")).alias("document"), F.when(fine, span).alias("span"), F.when(fine, own).alias("text"), "error")


def hints(typed: DataFrame, sources: DataFrame) -> DataFrame:
    """``typed`` (key, typed) with the first source and sentence that hold the quotation; one cut with an ellipsis matches by its beginning."""
    q = sources.select("source_no", "sent_no", F.explode("quoted").alias("q"))
    whole = F.col("typed") == F.col("q")
    cut = F.col("typed").endswith("…") & F.expr("startswith(q, substring(typed, 1, char_length(typed) - 1))")
    j = typed.join(q, F.expr("substring(typed, 1, 8) = substring(q, 1, 8)") & (whole | cut))
    return j.groupBy("key").agg(F.min(F.struct("source_no", "sent_no")).alias("m")).select("key", "m.source_no", "m.sent_no")


def build(drafts: DataFrame, sources: DataFrame, ledger: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, errors) from drafts (script_id, turn, speaker, text, citations, refs).

    errors has the first problem of each script, by turn, then by check: references, placeholders, citations. turns has only scripts without one.
    """
    refs = drafts.select("script_id", "turn", F.posexplode("refs").alias("ref_ix", "r")).select("script_id", "turn", "ref_ix", "r.source_no", "r.sent_no", "r.part")
    found = resolve(refs, sources)
    quote = F.struct("ref_ix", F.struct("document", "span", "text").alias("q"))
    per = found.groupBy("script_id", "turn").agg(F.transform(F.array_sort(F.collect_list(quote)), lambda x: x["q"]).alias("quotes"), F.min_by("error", F.when(F.col("error").isNotNull(), F.col("ref_ix"))).alias("_ref"))
    j = drafts.drop("refs").join(per, ["script_id", "turn"], "left")
    j = j.withColumn("quotes", F.coalesce("quotes", F.array().cast(per.schema["quotes"].dataType))).withColumn("_f", fill_quotes(F.col("text"), F.transform("quotes", lambda q: q["text"])))
    unknown = drafts.select("script_id", "turn", F.explode("citations").alias("claim_id")).join(ledger.select("claim_id"), "claim_id", "left_anti").groupBy("script_id", "turn").agg(F.min("claim_id").alias("_c"))
    j = j.join(unknown, ["script_id", "turn"], "left")
    checks = F.array(F.struct(F.lit(0).alias("c"), F.col("_ref").alias("m")), F.struct(F.lit(1).alias("c"), F.concat(F.lit("placeholder: "), F.col("_f.error")).alias("m")), F.struct(F.lit(2).alias("c"), F.concat(F.lit("unknown claim "), F.col("_c")).alias("m")))
    problem = j.select("script_id", "turn", F.explode(checks).alias("x")).where("x.m is not null")
    errors = problem.groupBy("script_id").agg(F.min_by("x.m", F.struct("turn", F.col("x.c"))).alias("error"), F.min("turn").alias("turn"))
    turns = j.join(errors.select("script_id"), "script_id", "left_anti").select("script_id", "turn", "speaker", F.col("_f.ok").alias("text"), "citations", "quotes")
    return turns, errors


def summary(runs: DataFrame) -> DataFrame:
    """Of evaluation runs (passed, attempts, word_ratio, coverage): rates of passing and of passing at once, and means over the passing ones."""
    good = F.col("passed")
    mean = lambda c: F.avg(F.when(good, F.col(c))).alias(c)
    return runs.agg(F.count("*").alias("runs"), F.avg(good.cast("double")).alias("pass_rate"), F.avg((good & (F.col("attempts") == 1)).cast("double")).alias("first_try_rate"), mean("word_ratio"), mean("coverage"))


def in_order(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """``rows`` with source_no from 0 within each request."""
    return rows.withColumn("source_no", F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)
