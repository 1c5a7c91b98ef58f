"""Is what was heard what was written? Word errors, quotes, and where each turn lies in the recording."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType


def edit_distance(a: Sequence[str], b: Sequence[str]) -> int:
    """Insertions, deletions and substitutions of words from ``a`` to ``b``; only one row of the table is held."""
    codes: dict[str, int] = {}
    x = np.array([codes.setdefault(w, len(codes)) for w in a])
    y = np.array([codes.setdefault(w, len(codes)) for w in b])
    row = np.arange(len(y) + 1)
    steps = np.arange(len(y) + 1)
    for i, w in enumerate(x, 1):
        best = np.minimum(row[:-1] + (y != w), row[1:] + 1)
        nxt = np.concatenate([[i], best])
        row = np.minimum.accumulate(nxt - steps) + steps  # insertions run along the row
    return int(row[-1])


@F.pandas_udf(IntegerType())
def word_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([edit_distance(list(x) if x is not None else [], list(y) if y is not None else []) for x, y in zip(a, b, strict=True)])


def wer_pm(reference: Column, heard: Column) -> Column:
    """Word errors in per mille of the reference, rounded up, at most 1000; without a reference 0 or, where something is heard, 1000."""
    n = F.coalesce(F.size(reference), F.lit(0))
    m = F.coalesce(F.size(heard), F.lit(0))
    return F.when(n <= 0, F.when(m <= 0, 0).otherwise(1000)).otherwise(F.least(F.lit(1000), F.ceil(word_distance(reference, heard) * 1000 / n))).cast("int")


def contains_words(heard: Column, quote: Column) -> Column:
    """Whether the words of a quote are heard in a row; an empty quote is."""
    n, m = F.size(heard), F.size(quote)
    at = F.sequence(F.lit(0), F.greatest(F.lit(0), n - m))
    return F.when(m <= 0, True).when(n < m, False).otherwise(F.exists(at, lambda i: F.slice(heard, i + 1, m) == quote))


def missed_quotes(heard: Column, quotes: Column) -> Column:
    """How many of the quotes' word arrays are not heard."""
    return F.size(F.filter(quotes, lambda q: ~contains_words(heard, q)))


def _steps(reference: Sequence[str], heard: Sequence[str]) -> np.ndarray:
    """All edit distances of the beginnings of both, a row at a time as vectors."""
    codes: dict[str, int] = {}
    x = np.array([codes.setdefault(w, len(codes)) for w in reference], np.int64)
    y = np.array([codes.setdefault(w, len(codes)) for w in heard], np.int64)
    places = np.arange(len(y) + 1)
    d = np.empty((len(x) + 1, len(y) + 1), np.int32)
    d[0] = places
    for i, w in enumerate(x, 1):
        d[i, 0] = i
        np.minimum(d[i - 1, :-1] + (y != w), d[i - 1, 1:] + 1, out=d[i, 1:])
        d[i] = np.minimum.accumulate(d[i] - places) + places  # insertions run along the row
    return d


def align(reference: Sequence[str], heard: Sequence[str]) -> list[tuple[int | None, int | None]]:
    """Places of the words that stand for each other; one side is None where a word is missing or added. Substitutions are preferred going back."""
    d = _steps(reference, heard)
    n, m = len(reference), len(heard)
    out: list[tuple[int | None, int | None]] = []
    while n or m:
        if n and m and d[n, m] == d[n - 1, m - 1] + (reference[n - 1] != heard[m - 1]):
            n, m = n - 1, m - 1
            out.append((n, m))
        elif n and d[n, m] == d[n - 1, m] + 1:
            n -= 1
            out.append((n, None))
        else:
            m -= 1
            out.append((None, m))
    return out[::-1]


def word_times(segments: Sequence[tuple[str, float, float]]) -> list[tuple[str, float, float]]:
    """Words with times: each has its share of its segment's time by its length."""
    out = []
    for text, start, stop in segments:
        words = text.split()
        total = sum(map(len, words)) or 1
        at = start
        for w in words:
            span = (stop - start) * len(w) / total
            out.append((w, at, at + span))
            at += span
    return out


def quietest(samples: np.ndarray, rate: int, at: float, reach: float = 0.3, frame: float = 0.02) -> float:
    """A cut near ``at`` seconds moved to the quietest 20 ms within 300 ms, if those are under half the median energy; else ``at``."""
    n = max(1, int(rate * frame))
    lo, hi = max(0, int((at - reach) * rate)), min(len(samples), int((at + reach) * rate))
    frames = [(float(np.mean(samples[i : i + n] ** 2)), i) for i in range(lo, max(lo, hi - n + 1), n)]
    if not frames:
        return at
    energy = sorted(e for e, _ in frames)
    least, i = min(frames)
    return (i + n / 2) / rate if least < 0.5 * energy[len(energy) // 2] else at


def turn_spans(turns: Sequence[Sequence[str]], heard: Sequence[tuple[str, float, float]], length: float, samples: np.ndarray | None = None, rate: int = 1) -> list[tuple[float, float]]:
    """(start, stop) in seconds of each turn's words, from an alignment with the timed words heard; a boundary lies midway between two turns."""
    flat = [w for t in turns for w in t]
    pairs = {r: h for r, h in align(flat, [w for w, _, _ in heard]) if r is not None and h is not None}
    cuts, at = [0.0], 0
    for t in turns[:-1]:
        at += len(t)
        before = max((pairs[r] for r in pairs if r < at), default=None)
        after = min((pairs[r] for r in pairs if r >= at), default=None)
        stop = heard[before][2] if before is not None else cuts[-1]
        start = heard[after][1] if after is not None else length
        cut = (stop + start) / 2
        cuts.append(max(cuts[-1], quietest(samples, rate, cut) if samples is not None else cut))
    cuts.append(length)
    return list(zip(cuts, cuts[1:], strict=False))


def findings(chunks: DataFrame) -> DataFrame:
    """One error for each chunk (chunk_id, take, wer_pm, verified) that no take of passed."""
    return chunks.where("not verified").select("chunk_id", F.lit("error").alias("severity"), F.format_string("chunk %s: best take %d has a word error rate of %d per mille", F.col("chunk_id").cast("string"), "take", "wer_pm").alias("message"))


def bad_segments(segments: DataFrame, key: str = "clip_id", slack: float = 0.02) -> DataFrame:
    """Transcript segments that are not finite, out of order, overlap the one before, or lie outside their clip (start, stop, length, ix)."""
    from pyspark.sql.window import Window

    before = F.lag("stop").over(Window.partitionBy(key).orderBy("ix"))
    sound = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    bad = ~(sound("start") & sound("stop")) | (F.col("stop") < F.col("start")) | (F.col("start") < 0) | (F.col("stop") > F.col("length") + slack) | F.coalesce(before > F.col("start") + slack, F.lit(False))
    return segments.withColumn("bad", F.coalesce(bad, F.lit(True))).where("bad").drop("bad")
