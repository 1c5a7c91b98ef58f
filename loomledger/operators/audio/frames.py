"""The speech and sound operators over DataFrames: what columns can say stays in the JVM, what needs samples runs clip by clip in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.window import Window

from loomledger.config import DEFAULT
from loomledger.operators.audio import bench, signal, verify
from loomledger.operators.ranking import upper_median


def trim_bounds(samples: Column, silence: float = signal.SILENCE) -> Column:
    """struct<start, stop> of the samples between the first and the last that are above ``silence``; null where none is."""
    loud = F.filter(F.transform(samples, lambda x, i: F.when(F.abs(x) > silence, i)), lambda i: i.isNotNull())
    return F.when(F.size(loud) > 0, F.struct(F.array_min(loud).alias("start"), (F.array_max(loud) + 1).alias("stop")))


def laid_out(blocks: DataFrame, key: str = "script_id", ix: str = "turn", rate: int = signal.RATE) -> DataFrame:
    """key, ix, start and stop in samples of blocks (pace, length) end to end: a gap by its pace before each but the first, an interruption over the end of the one before.

    The places are a running sum, as each block adds its gap and its length, or its length less what it lies over.
    """
    w = Window.partitionBy(key).orderBy(ix)
    gap = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in signal.GAPS.items() for x in p]), F.col("pace")), F.lit(signal.GAPS["normal"])) * rate / 1000
    gap = F.floor(gap).cast("bigint")
    before = F.lag("length").over(w)
    adds = F.when(before.isNull(), 0).when(F.col("pace") == "interrupt", -F.least(gap, before, F.col("length"))).otherwise(gap)
    rows = blocks.withColumn("_adds", adds + F.col("length"))
    stop = F.sum("_adds").over(w)
    return rows.select(key, ix, (stop - F.col("length")).alias("start"), stop.alias("stop"))


def crossfaded(tail: Column, head: Column) -> Column:
    """Two arrays of one length as one: ``tail`` fades out while ``head`` fades in, at equal power."""
    n = F.greatest(F.size(head), F.lit(1))
    angle = lambda i: (i + 0.5) / n * (np.pi / 2)
    pairs = F.arrays_zip(tail.alias("t"), head.alias("h"))
    return F.transform(pairs, lambda p, i: p["t"] * F.cos(angle(i)) + p["h"] * F.sin(angle(i)))


def overlay_start(start: Column, stop: Column, at: Column, length: Column) -> Column:
    """Where a clip begins that lies over the middle of a turn, before it or after it."""
    zero = F.lit(0).cast("bigint")
    over = start + F.floor(F.greatest(zero, stop - start - length) / 2)
    return F.when(at == "over", over).when(at == "before", F.greatest(zero, start - length)).otherwise(stop).cast("bigint")


def level_gains(clips: DataFrame, key: str, level: str = "level") -> DataFrame:
    """``clips`` with the gain in dB that brings each to the upper median level of its key; a clip without a level keeps 0."""
    m = upper_median(clips, key, level, "_aim")
    return clips.join(m, key, "left").withColumn("gain_db", F.coalesce(F.col("_aim") - F.col(level), F.lit(0.0))).drop("_aim")


def per_clip(clips: DataFrame, key: str, run: Callable[[np.ndarray], dict], schema: str, samples: str = "samples") -> DataFrame:
    """key and what ``run`` says of each clip's samples; null samples are an empty clip."""
    kind = clips.schema[key].dataType.simpleString()

    def batches_(batches):
        for b in batches:
            out = [run(np.array(x if x is not None else [], float)) for x in b.column(1).to_pylist()]
            if out:
                yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([o[c] for o in out]) for c in out[0]]], names=[key, *out[0]])

    return clips.select(key, samples).mapInArrow(batches_, f"`{key}` {kind}, {schema}")


def normalised(clips: DataFrame, key: str, rate: int) -> DataFrame:
    """key, level and peak of clips brought to the target loudness; silent ones have neither."""

    def run(x: np.ndarray) -> dict:
        try:
            _, level, peak = signal.normalise(x, rate)
        except ValueError:
            return {"level": float("nan"), "peak": float("nan")}
        return {"level": level, "peak": peak}

    return per_clip(clips, key, run, "level double, peak double")


def limited(clips: DataFrame, key: str, ceiling: float, half: int) -> DataFrame:
    """key, how many samples are over the ceiling after the limiter, and whether it changed any."""

    def run(x: np.ndarray) -> dict:
        y = signal.limit(x, ceiling, half)
        return {"n_over": int((np.abs(y) > ceiling + 1e-9).sum()), "touched": bool((np.abs(y - x) > 1e-12).any())}

    return per_clip(clips, key, run, "n_over bigint, touched boolean")


def resampled(clips: DataFrame, key: str, rate: int, to: int) -> DataFrame:
    return per_clip(clips, key, lambda x: {"resampled": signal.resample(x, rate, to).tolist()}, "resampled array<double>")


def said_tones(lines: DataFrame, key: str, rate: int) -> DataFrame:
    """``lines`` (key, speaker, words, seed) as the stand-in voice says them: key and samples."""
    kind = lines.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            rows = list(zip(*(b.column(c).to_pylist() for c in (1, 2, 3)), strict=True))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([signal.tone(s or "", w, int(d), rate) for s, w, d in rows], pa.list_(pa.float32()))], names=[key, "samples"])

    return lines.select(key, "speaker", "words", "seed").mapInArrow(run, f"`{key}` {kind}, samples array<float>")


@F.pandas_udf(StructType([StructField(n, IntegerType()) for n in ("same", "other", "missing", "added")]))  # type: ignore[call-overload]
def alignment(reference: pd.Series, heard: pd.Series) -> pd.DataFrame:
    """Of two arrays of words: how many stand for the same, for another, for none, and how many are heard beside."""
    out = []
    for a, b in zip(reference, heard, strict=True):
        a, b = list(a) if a is not None else [], list(b) if b is not None else []
        pairs = verify.align(a, b)
        same = sum(1 for r, h in pairs if r is not None and h is not None and a[r] == b[h])
        out.append((same, sum(1 for r, h in pairs if r is not None and h is not None) - same, sum(1 for _, h in pairs if h is None), sum(1 for r, _ in pairs if r is None)))
    return pd.DataFrame(out, columns=["same", "other", "missing", "added"])


def turn_spans(chunks: DataFrame, key: str) -> DataFrame:
    """key, ix, start and stop in seconds of each turn of a chunk. ``chunks``: key, turns (array of arrays of words), heard (array of struct<word, start, stop>), secs.

    A chunk is as long as a backend's limit lets it be, so its alignment fits in a task.
    """
    kind = chunks.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            at, rows = [], []
            for k, (turns, heard, secs) in enumerate(zip(*(b.column(c).to_pylist() for c in (1, 2, 3)), strict=True)):
                spans = verify.turn_spans(turns or [], [(h["word"], h["start"], h["stop"]) for h in heard or []], secs) if turns else []
                at += [k] * len(spans)
                rows += [(i, a, z) for i, (a, z) in enumerate(spans)]
            cols = list(zip(*rows, strict=True)) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.float64())], names=[key, "ix", "start", "stop"])

    return chunks.select(key, "turns", "heard", "secs").mapInArrow(run, f"`{key}` {kind}, ix int, start double, stop double")


def cast_clips(cast: DataFrame, clips: DataFrame) -> DataFrame:
    """Each speaker of a cast with the path of its clip, or what is wrong: no clip, one that is no sound, or one that is not what was generated.

    ``cast``: script_id, speaker; ``clips``: speaker, path, readable, digest, made_as (null where the clip was not generated).
    """
    j = cast.select("script_id", "speaker").distinct().join(clips, "speaker", "left")
    problem = F.when(F.col("path").isNull(), "no clip").when(~F.coalesce("readable", F.lit(False)), "no sound").when(F.col("made_as").isNotNull() & ~F.col("made_as").eqNullSafe(F.col("digest")), "not the generated clip")
    return j.select("script_id", "speaker", "path", problem.alias("problem"))


def cut_out(recordings: DataFrame, spans: DataFrame, key: str, rate: int) -> DataFrame:
    """key, ix and samples of each span (key, ix, start, stop in seconds) of a recording; spans beyond its ends are cut short."""
    first, last = (F.greatest(F.lit(0), F.floor(F.col(c) * rate)).cast("int") for c in ("start", "stop"))
    j = spans.join(recordings.select(key, "samples"), key)
    return j.select(key, "ix", F.slice("samples", first + 1, F.greatest(F.lit(0), last - first)).alias("samples"))


def spoken(pieces: DataFrame, sounds: DataFrame) -> DataFrame:
    """``pieces`` (script_id, turn, piece, speaker, starts, ends) with ``sounds``: what the speaker does before the piece that starts a turn and after the one that ends it.

    ``sounds``: script_id, turn, by, at, kind. Sounds over a turn or by others are for ``takes.overlays``.
    """
    s = sounds.where(F.col("at").isin("before", "after")).select("script_id", "turn", "by", F.struct("at", "kind").alias("s"))
    j = pieces.join(s, ["script_id", "turn"], "left")
    own = (F.col("by") == F.col("speaker")) & F.when(F.col("s.at") == "before", F.col("starts")).otherwise(F.col("ends"))
    return j.groupBy("script_id", "turn", "piece", "speaker").agg(F.array_sort(F.collect_list(F.when(own, F.col("s")))).alias("sounds"))


def turn_packs(turns: DataFrame, limit: float, gap: float) -> DataFrame:
    """script_id, turn and pack: whole turns (secs) in order up to ``limit`` seconds a pack. One task takes one script."""

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("turn")
        packs = bench.pack_turns(t.secs.tolist(), limit, gap)
        number = [k for k, p in enumerate(packs) for _ in p]
        return pd.DataFrame({"script_id": t.script_id, "turn": t.turn, "pack": number})

    return turns.groupBy("script_id").applyInPandas(run, "script_id bigint, turn int, pack int")


def voice_similarity(segments: DataFrame, voices: DataFrame, least: float = bench.LEAST_SECS) -> DataFrame:
    """speaker, n and similarity: the mean cosine of its segments (speaker, secs, vec) to its voice (speaker, vec); segments under ``least`` seconds say nothing."""
    from loomledger.operators.vectors import cosine

    j = segments.where(F.col("secs") >= least).select("speaker", F.col("vec").alias("_s")).join(voices.select("speaker", F.col("vec").alias("_v")), "speaker")
    return j.groupBy("speaker").agg(F.count("*").alias("n"), F.avg(cosine("_s", "_v")).alias("similarity"))


def bake_off(runs: DataFrame) -> DataFrame:
    """Per backend of runs (backend, secs, took, wer, quotes, quotes_heard, similarity): seconds of work a second of speech (mean, worst), mean word errors, share of quotes heard, mean similarity."""
    rtf = F.col("took") / F.col("secs")
    return runs.where("secs > 0").groupBy("backend").agg(
        F.avg(rtf).alias("rtf_mean"), F.max(rtf).alias("rtf_max"), F.avg("wer").alias("wer_mean"), F.max("wer").alias("wer_max"), F.when(F.sum("quotes") > 0, F.sum("quotes_heard") / F.sum("quotes")).alias("quotes_heard"), F.avg("similarity").alias("similarity")
    )


def seconds(words: Column | str) -> Column:
    return (F.col(words) if isinstance(words, str) else words) * F.lit(60.0) / DEFAULT.words_per_minute


