"""Scripts: quotes put in their places, beats, contexts, and the ledger as a script writer sees it."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType
from pyspark.sql.window import Window

from loomledger.config import DEFAULT

_PLACE = re.compile(r"\{\{quote:(?:([0-9]+)\}\})?")
_QUOTED = re.compile(r'"([^"]*)"|“([^”]*)”')
FILLED = StructType([StructField("ok", StringType()), StructField("error", StringType()), StructField("argument", StringType()), StructField("index", IntegerType())])


def _short(s: str, n: int = 80) -> str:
    return s if len(s) <= n else s[:n] + "…"


def fill(text: str | None, quotes: list[str] | None) -> tuple[str | None, str | None, str | None, int | None]:
    """(filled text, error, its argument, its index): each ``{{quote:N}}`` becomes the N-th quote in curly marks.

    Errors in this order: 'malformed' placeholder, 'typed' quotation of three words or more, 'unclosed' mark, 'unknown' number, 'unused' quote.
    Marks that stand on both sides of a placeholder are not doubled. Null text gives an empty one.
    """
    text, quotes = text or "", list(quotes or [])
    cuts: list[tuple[int, int, int]] = []
    at = 0
    while m := _PLACE.search(text, at):
        if m[1] is None:
            return None, "malformed", _short(text[m.start() :].split()[0][:40]), None
        a, z = m.start(), m.end()
        if a > at and text[a - 1] in '"“' and text[z : z + 1] in ('"', "”"):
            a, z = a - 1, z + 1
        cuts.append((a, z, int(m[1])))
        at = z
    bounds = [0, *[z for _, z, _ in cuts]]
    plain = [text[b:a] for b, (a, _, _) in zip(bounds, cuts, strict=False)] + [text[bounds[-1] :]]
    typed = "".join(p + (f"{{{{quote:{n}}}}}" if n is not None else "") for p, n in zip(plain, [*[n for *_, n in cuts], None], strict=True))
    for m in _QUOTED.finditer(typed):
        span = m[1] if m[1] is not None else m[2]
        if len(span.split()) >= DEFAULT.quoted_words:
            return None, "typed", _short(span), None
    left = _QUOTED.sub(lambda m: "\0" * len(m[0]), typed)
    if stray := re.search('["“”]', left):
        return None, "unclosed", _short(typed[stray.start() :][:41]), None
    for *_, n in cuts:
        if n >= len(quotes):
            return None, "unknown", str(len(quotes)), n
    for n in range(len(quotes)):
        if n not in {c[2] for c in cuts}:
            return None, "unused", None, n
    return "".join(p + (f"“{quotes[n]}”" if n is not None else "") for p, n in zip(plain, [*[n for *_, n in cuts], None], strict=True)), None, None, None


def fill_quotes(text, quotes):
    """``fill`` as a column: struct<ok, error, argument, index>."""
    @F.pandas_udf(FILLED)  # type: ignore[call-overload]
    def run(t: pd.Series, q: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([fill(a, None if b is None else list(b)) for a, b in zip(t, q, strict=True)], columns=["ok", "error", "argument", "index"]).astype({"index": "Int32"})

    return run(text, quotes)


def beats(turns: DataFrame, key: str = "script_id", ix: str = "turn", mark: str = "mark") -> DataFrame:
    """key, beat, kind, start, stop: every mark begins a beat up to the next; an unmarked first turn is narration; without any mark there are no beats.

    ``ix`` counts the turns of a script from 0.
    """
    w = Window.partitionBy(key).orderBy(ix)
    start = F.col(mark).isNotNull() | (F.col(ix) == F.min(ix).over(Window.partitionBy(key)))
    rows = turns.select(key, ix, mark, F.count(mark).over(Window.partitionBy(key)).alias("_n"), F.max(ix).over(Window.partitionBy(key)).alias("_last"), start.alias("_start")).where("_start and _n > 0")
    return rows.select(key, (F.row_number().over(w) - 1).alias("beat"), F.coalesce(mark, F.lit("narration")).alias("kind"), F.col(ix).alias("start"), F.coalesce(F.lead(ix).over(w), F.col("_last") + 1).alias("stop"))


#: Fixed value: what the host says over the second turn.
ASSENT = "Mm-hm."


def directed(turns: DataFrame, key: str = "script_id", ix: str = "turn", host: str = "host") -> DataFrame:
    """key, ix, mark, pace, sounds and callback_to: the directions that the stand-in writer gives the turns of a script (key, ix, quotes).

    The first turn opens, as a reading where it quotes; with turns between the first and the last, the second is banter, quick, with the host's assent over it; the last is a transition after
    a long pause that calls back to the first. All others have no mark and a normal pace.
    """
    every = Window.partitionBy(key)
    rows = turns.withColumn("_r", F.row_number().over(every.orderBy(ix))).withColumn("_n", F.count("*").over(every)).withColumn("_first", F.min(ix).over(every))
    last, second = F.col("_r") == F.col("_n"), (F.col("_r") == 2) & (F.col("_n") > 2)
    opening = F.when(F.coalesce(F.size("quotes"), F.lit(0)) > 0, "quote_reading").otherwise("narration")
    sound = F.array(F.struct(F.lit("backchannel").alias("kind"), F.lit(ASSENT).alias("text"), F.lit(host).alias("by"), F.lit("over").alias("at")))
    return rows.select(
        key, ix, F.when(last, "transition").when(F.col("_r") == 1, opening).when(second, "banter").alias("mark"), F.when(last, "long_pause").when(second, "quick").otherwise("normal").alias("pace"),
        F.when(second, sound).otherwise(F.array().cast("array<struct<kind:string,text:string,by:string,at:string>>")).alias("sounds"), F.when(last, F.col("_first")).alias("callback_to"),
    )


def implied_beats(turns: DataFrame, stored: DataFrame, key: str = "script_id", ix: str = "turn") -> DataFrame:
    """The stored beats, and one narration beat a turn for scripts that have none."""
    none = turns.join(stored.select(key).distinct(), key, "left_anti")
    each = none.select(key, (F.row_number().over(Window.partitionBy(key).orderBy(ix)) - 1).alias("beat"), F.lit("narration").alias("kind"), F.col(ix).alias("start"), (F.col(ix) + 1).alias("stop"))
    return stored.unionByName(each)


def broken_beats(stored: DataFrame, key: str = "script_id") -> DataFrame:
    """Beats that leave a gap, overlap the one before, or end before they begin."""
    w = Window.partitionBy(key).orderBy("start", "stop")
    before = F.lag("stop").over(w)
    kind = F.when(F.col("stop") <= F.col("start"), "empty").when(before > F.col("start"), "overlap").when(before < F.col("start"), "gap").when(before.isNull() & (F.col("start") > 0), "gap")
    return stored.withColumn("problem", kind).where("problem is not null").select(key, "beat", "problem")


def undeclared_speakers(turns: DataFrame, cast: DataFrame) -> DataFrame:
    """The turns whose speaker is not in the cast of their script."""
    return turns.join(cast.select("script_id", "speaker").distinct(), ["script_id", "speaker"], "left_anti")


def context(chunks: DataFrame, turns: DataFrame) -> DataFrame:
    """script_id, chunk_no and what a chunk's speech follows: the last turn of the chunk before, and the turns it calls back to that are not in it.

    ``chunks``: script_id, chunk_no, turns (array); ``turns``: script_id, turn, callback_to.
    """
    w = Window.partitionBy("script_id").orderBy("chunk_no")
    own = chunks.select("script_id", "chunk_no", "turns", F.lag(F.array_max("turns")).over(w).alias("previous"))
    called = own.select("script_id", "chunk_no", F.explode("turns").alias("turn")).join(turns.select("script_id", "turn", "callback_to").where("callback_to is not null"), ["script_id", "turn"])
    back = called.groupBy("script_id", "chunk_no").agg(F.array_sort(F.collect_set("callback_to")).alias("called"))
    j = own.join(back, ["script_id", "chunk_no"], "left")
    heard = F.array_except(F.coalesce("called", F.array().cast("array<int>")), F.concat(F.col("turns"), F.array("previous")))
    return j.select("script_id", "chunk_no", "previous", heard.alias("called"))


def ledger_view(ledger: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The ledger as a script writer sees it: claim_id, text, status and, where there is one, the side its verdict favours."""
    return ledger.select("claim_id", "text", "status").join(verdicts.select("claim_id", "favours"), "claim_id", "left")


def oversized_requests(rows: DataFrame, key: str, *columns: str, limit: int = DEFAULT.request_bytes) -> DataFrame:
    """key and bytes of the rows whose JSON is longer than a request should be."""
    return rows.select(key, F.octet_length(F.to_json(F.struct(*columns))).alias("bytes")).where(F.col("bytes") > limit)


def output_cap(episode, stage):
    """The lower of two caps; a missing one does not bind."""
    return F.least(episode, stage)
