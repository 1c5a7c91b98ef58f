import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomledger.operators.audio import plan, signal, takes, verify
from loomledger.sources import wav


def slow_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_edit_distance_against_the_table():
    r = random.Random(2)
    for _ in range(300):
        a, b = (r.choices("abcd", k=r.randint(0, 9)) for _ in range(2))
        assert verify.edit_distance(a, b) == slow_distance(a, b)


def test_wer_and_containment(spark):
    rows = [(["a", "b", "c"], ["a", "x", "c"], 334), (["a"], [], 1000), ([], [], 0), ([], ["a"], 1000), (["a"], ["b", "c", "d"], 1000), (None, None, 0)]
    df = spark.createDataFrame(rows, "r array<string>, h array<string>, want int")
    assert [x[0] for x in df.select(verify.wer_pm(F.col("r"), F.col("h"))).collect()] == [w for *_, w in rows]
    c = spark.createDataFrame([(["a", "b", "c"], ["b", "c"], True), (["a", "b"], ["b", "a"], False), (["a"], [], True), ([], ["a"], False)], "h array<string>, q array<string>, want boolean")
    assert c.where(verify.contains_words(F.col("h"), F.col("q")) != F.col("want")).count() == 0


def test_alignment_and_turn_spans():
    assert verify.align("a b c".split(), "a x c d".split()) == [(0, 0), (1, 1), (2, 2), (None, 3)]
    heard = verify.word_times([("one two", 0.0, 1.0), ("three four", 1.5, 2.5)])
    spans = verify.turn_spans([["one", "two"], ["three", "four"]], heard, 3.0)
    assert spans[0] == (0.0, 1.25) and spans[1] == (1.25, 3.0)
    x = np.ones(3000)
    x[1400:1500] = 0
    assert 1.4 <= verify.quietest(x, 1000, 1.3) <= 1.5 and verify.quietest(np.ones(3000), 1000, 1.3) == 1.3


def test_bad_segments(spark):
    rows = [("a", 0, 0.0, 1.0, 2.0), ("a", 1, 0.9, 1.5, 2.0), ("a", 2, 1.6, 2.5, 2.0), ("b", 0, float("nan"), 1.0, 2.0), ("c", 0, 0.0, 2.01, 2.0)]
    df = spark.createDataFrame(rows, "clip_id string, ix int, start double, stop double, length double")
    assert {(r.clip_id, r.ix) for r in verify.bad_segments(df).collect()} == {("a", 1), ("a", 2), ("b", 0)}


def test_plan():
    say = lambda n: " ".join(["w"] * n) + "."
    beats = [[(0, "a", say(50), [])], [(1, "b", say(60), [])], [(2, "a", say(200), [])], [(3, "c", say(10), []), (4, "a", say(10), [])]]
    out = plan.plan(beats, 60.0, 2)
    assert [[p[0] for p in c] for c in out] == [[0, 1], [2], [3, 4]]
    assert [[p[0] for p in c] for c in plan.plan(beats, 60.0, 2, together=False)] == [[0], [1], [2], [3], [4]]
    long = " ".join(say(40) for _ in range(6))
    cut = plan.split_turn(long, [], 48.0)
    assert len(cut) == 2 and "".join(long[a:z] for a, z in cut).replace(" ", "") == long.replace(" ", "")
    q = long[:500]
    assert all(not (0 < z < 500) for _, z in plan.split_turn(long, [q], 30.0)[:-1])


def test_signal():
    rate = 48_000
    t = np.arange(rate * 3) / rate
    sine = np.sin(2 * np.pi * 997 * t)
    assert abs(signal.loudness(sine, rate) - (-3.01)) < 0.1 and abs(signal.loudness(sine * 0.1, rate) - (-23.01)) < 0.1
    assert signal.loudness(np.zeros(rate), rate) == float("-inf") and signal.loudness(sine[:1000], rate) == float("-inf")
    assert abs(signal.true_peak(sine[:rate], rate)) < 0.1
    limited = signal.limit(sine * 2, 0.5, 240)
    assert np.abs(limited).max() <= 0.5 + 1e-9
    quiet = np.zeros(10_000)
    quiet[5000] = 1.0
    out = signal.limit(quiet + 0.1, 0.5, 100)
    assert out[0] == 0.1 and out[-1] == 0.1 and np.abs(out).max() <= 0.5 + 1e-9
    y, level, peak = signal.normalise(sine * 0.05, rate)
    assert abs(level + 16) <= 0.2 and peak <= -1.0
    with pytest.raises(ValueError):
        signal.normalise(np.zeros(rate), rate)
    r = signal.resample(sine[:24_000], 48_000, 24_000)
    assert len(r) == 12_000 and np.abs(r[1000:11_000] - np.sin(2 * np.pi * 997 * np.arange(12_000) / 24_000)[1000:11_000]).max() < 0.02
    assert len(signal.resample(np.zeros(3), 2, 3)) == 5
    assert list(signal.trim(np.array([0, 0.001, 0.5, 0, 0.4, 0]))) == [0.5, 0, 0.4] and len(signal.trim(np.zeros(4))) == 0
    tail, head = np.ones(100), np.ones(100)
    assert np.allclose(signal.crossfade(tail, 0 * head) ** 2 + signal.crossfade(0 * tail, head) ** 2, 1)
    track, places = signal.lay_out([("normal", np.ones(4800)), ("quick", np.ones(4800)), ("interrupt", np.ones(4800))])
    assert places[0] == (0, 4800) and places[1][0] == 4800 + 3840 and places[2] == (places[1][1] - 4800, places[1][1])
    mixed = signal.overlay(np.zeros(100), (40, 60), "after", np.ones(50))
    assert len(mixed) == 110 and abs(mixed[60] - 10 ** (-0.3)) < 1e-9
    levels = [signal.loudness(c, rate) for c in signal.match_levels([sine, sine * 0.5, sine * 0.1], rate)]
    assert max(levels) - min(levels) < 0.01
    assert len(signal.tone("a", 4)) == 24_000 and not np.array_equal(signal.tone("a", 1, 1), signal.tone("a", 1, 2))


def test_wav(spark, tmp_path):
    x = np.array([0.0, 0.5, -0.5, 1.5], np.float32)
    assert np.array_equal(wav.decode(wav.encode(8000, x))[1], x)
    rate, y = wav.decode(wav.encode(8000, x, float32=False))
    assert rate == 8000 and np.abs(y - np.clip(x, -1, 1)).max() < 1e-3
    for bad in (b"", b"RIFF0000WAVE", wav.encode(8000, x)[:-3]):
        with pytest.raises(ValueError):
            wav.decode(bad)
    (tmp_path / "a.wav").write_bytes(wav.encode(8000, x))
    (tmp_path / "b.wav").write_bytes(b"no")
    got = {r.path.rsplit("/", 1)[1]: r for r in wav.read(spark, str(tmp_path)).collect()}
    assert got["a.wav"].rate == 8000 and got["a.wav"].samples == [0.0, 0.5, -0.5, 1.5] and got["b.wav"].error and got["b.wav"].samples is None


def test_take_loop(spark):
    chunks = spark.createDataFrame([("c1", "the mill burned down", "a"), ("c2", "it rained all day", "b")], "chunk_id string, text string, speaker string").withColumn("quotes", F.array(F.lit("mill burned"))).withColumn("quotes", F.when(F.col("chunk_id") == "c1", F.col("quotes")))

    def speak(df):
        good = (F.col("chunk_id") == "c2") | (F.col("take") == 2)
        return df.withColumn("heard", F.when(good, F.col("text")).otherwise("noise")).withColumn("rate", F.lit(2.0))

    best = takes.take_loop(chunks, speak, F.lit(1))
    assert {(r.chunk_id, r["take"], r.passed, r.wer_pm) for r in best.collect()} == {("c1", 2, True, 0), ("c2", 0, True, 0)}
    said = spark.createDataFrame([("yes", ["mm"], None), ("no", None, ["", "ha"])], "t string, b array<string>, a array<string>")
    assert [r[0] for r in said.select(takes.said(F.col("t"), F.col("b"), F.col("a"))).collect()] == ["mm yes", "no ha"]
