"""Takes of planned chunks: said, heard, judged, and tried again while none is good enough."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomledger.functions.ids import content_id
from loomledger.functions.speech import spoken_words
from loomledger.operators.audio.verify import missed_quotes, wer_pm
from loomledger.operators.ranking import best_take


def seed(chunk_id: Column, take: Column) -> Column:
    """The first 64 bits of the id of chunk and take, as an unsigned number."""
    return F.conv(F.substring(content_id(chunk_id, take), 1, 16), 16, 10).cast("decimal(20,0)")


def said(text: Column, before: Column, after: Column) -> Column:
    """What a listener hears: the speaker's own words before and after around the text; empty and null ones left out."""
    words = F.filter(F.concat(F.coalesce(before, F.array().cast("array<string>")), F.array(text), F.coalesce(after, F.array().cast("array<string>"))), lambda w: w.isNotNull() & (w != ""))
    return F.array_join(words, " ")


def takes_of(chunks: DataFrame, first: Column) -> DataFrame:
    """``chunks`` once for each of its first takes, with take and seed."""
    return chunks.withColumn("take", F.explode(F.sequence(F.lit(0), first - 1))).withColumn("seed", seed(F.col("chunk_id"), F.col("take")))


def judge(takes: DataFrame, limit_pm: int = 150) -> DataFrame:
    """``takes`` (text, heard, quotes) with wer_pm, quote_misses and passed."""
    ref, hyp = spoken_words("text"), spoken_words("heard")
    rows = takes.withColumn("_r", ref).withColumn("_h", hyp).withColumn("_q", F.transform(F.coalesce("quotes", F.array().cast("array<string>")), lambda q: F.filter(F.split(F.lower(q), r"[^\p{IsAlphabetic}\p{N}]+"), lambda w: w != "")))
    rows = rows.withColumn("wer_pm", wer_pm(F.col("_r"), F.col("_h"))).withColumn("quote_misses", missed_quotes(F.col("_h"), F.col("_q")))
    return rows.withColumn("passed", (F.col("wer_pm") <= limit_pm) & (F.col("quote_misses") == 0)).drop("_r", "_h", "_q")


def take_loop(chunks: DataFrame, speak, first: Column, retries: int = 3, limit_pm: int = 150) -> DataFrame:
    """The best take of each chunk. ``speak`` maps takes (chunk_id, text, take, seed, ...) to the same with heard and rate; failed chunks get one more take at a time.

    The loop is over takes, not rows: at most ``retries`` + 1 passes, each over the chunks that have not passed.
    """
    from loomledger.tables import settle

    done = settle(judge(speak(takes_of(chunks, first)), limit_pm), "takes")
    for k in range(retries):
        failed = done.groupBy("chunk_id").agg(F.max("passed").alias("ok"), (F.max("take") + 1).alias("take")).where("not ok").select("chunk_id", "take")
        if not failed.limit(1).count():
            break
        again = chunks.join(failed, "chunk_id").withColumn("seed", seed(F.col("chunk_id"), F.col("take")))
        done = settle(done.unionByName(judge(speak(again), limit_pm)), f"takes-{k}")
    medians = done.where("passed")
    from loomledger.operators.ranking import upper_median

    m = upper_median(medians, "speaker", "rate")
    return best_take(done.join(m, "speaker", "left"), "chunk_id")


def speakers_needed(chunks: DataFrame, context: DataFrame) -> DataFrame:
    """chunk_id and the speakers whose voices it needs: its own and those of its context."""
    rows = chunks.select("chunk_id", F.explode("speakers").alias("speaker")).union(context.select("chunk_id", F.explode("speakers").alias("speaker")))
    return rows.groupBy("chunk_id").agg(F.array_sort(F.collect_set("speaker")).alias("speakers"))


def spoken_quotes(text: Column, quotes: Column) -> Column:
    """The different quotes that a chunk's text holds, in order."""
    return F.array_distinct(F.filter(quotes, lambda q: F.contains(text, q)))


def overlays(sounds: DataFrame) -> DataFrame:
    """The sounds for the second track - over a turn or by another speaker, with words - each (speaker, text) made once.

    ``sounds``: turn_id, turn_speaker, by, at, kind, text. Sounds without words are left out.
    """
    wanted = sounds.where(((F.col("at") == "over") | (F.col("by") != F.col("turn_speaker"))) & (F.col("kind") == "backchannel") & (F.trim("text") != ""))
    return wanted.groupBy(F.col("by").alias("speaker"), "text").agg(F.array_sort(F.collect_set(F.struct("turn_id", "at"))).alias("places"))
