import hashlib

import numpy as np
import pytest

from loomledger.operators import references as ref
from loomledger.operators.audio import bench
from loomledger.sources.wav import encode

REFS = "script_id long, turn int, speaker string, text string, citations array<string>, refs array<struct<source_no:int,sent_no:int,part:string>>"


def test_build(spark):
    chunks = spark.createDataFrame([(0, "d1", 10, 'Öl fell. He said "it was the end" twice.'), (1, "d2", 0, "Other.")], "source_no int, doc_id string, start long, text string")
    src = ref.numbered(chunks)
    rows = {(r.source_no, r.sent_no): r for r in src.collect()}
    assert rows[0, 0].span == (10, 19) and rows[0, 1].quoted == ["it was the end"]
    drafts = [
        (1, 0, "a", "So {{quote:0}} and “{{quote:1}}”", ["c"], [(0, 0, None), (0, 1, "the end")]), (2, 0, "a", "x", ["zz"], []), (2, 1, "a", "{{quote:0}}", [], [(7, 0, None)]), (3, 0, "a", "{{quote:0}}", [], [(1, 4, None)]),
        (4, 0, "a", "{{quote:0}}", None, [(1, 0, "nope")]), (5, 0, "a", "{{quote:1}}", None, [(1, 0, None)]), (6, 0, "b", "plain", None, None),
    ]
    turns, errors = ref.build(spark.createDataFrame(drafts, REFS), src, spark.createDataFrame([("c",)], "claim_id string"))
    ok = {r.script_id: r for r in turns.collect()}
    assert set(ok) == {1, 6} and ok[1].text == "So “Öl fell.” and “the end”"
    q = ok[1].quotes[1]
    raw = b"\0" * 10 + 'Öl fell. He said "it was the end" twice.'.encode()
    assert raw[q.span.start : q.span.stop].decode() == q.text == "the end"
    assert {r.script_id: (r.turn, r.error) for r in errors.collect()} == {2: (0, "unknown claim zz"), 3: (0, "no such sentence"), 4: (0, "not in that sentence"), 5: (0, "placeholder: unknown")}
    typed = spark.createDataFrame([(1, "it was the end"), (2, "it was th…"), (3, "it was nothing")], "key int, typed string")
    assert {tuple(r) for r in ref.hints(typed, src).collect()} == {(1, 0, 1), (2, 0, 1)}


def test_summary(spark):
    runs = spark.createDataFrame([(True, 1, 0.4, 0.5), (True, 2, 0.2, 0.7), (False, 3, 9.0, 9.0)], "passed boolean, attempts int, word_ratio double, coverage double")
    r = ref.summary(runs).first()
    assert (r.runs, round(r.pass_rate, 3), round(r.first_try_rate, 3), round(r.word_ratio, 3), round(r.coverage, 3)) == (3, 0.667, 0.333, 0.3, 0.6)


def test_bench_measures():
    assert bench.pack_turns([5, 5, 12, 1], 11, 1) == [[0, 1], [2], [3]] and bench.pack_turns([], 5, 1) == []
    assert bench.word_error_rate("a b".split(), ["a"]) == 0.5 and bench.word_error_rate([], []) == 0 and bench.word_error_rate([], ["a"]) == 1
    assert bench.contains("a b c".split(), "b c".split()) and not bench.contains(["a"], [])
    heard = [("one", 0.0, 0.5), ("zz", 0.5, 0.8), ("two", 0.8, 1.0), ("three", 1.2, 2.0)]
    assert bench.turn_times([["one", "two"], ["three"], ["none"]], heard) == [(0.0, 1.0), (1.2, 2.0), None]
    assert [len(x) for x in bench.cut(np.zeros(10), 10, [(0.0, 0.5), (0.9, 3.0)])] == [5, 1]
    assert bench.similarity(np.array([1.0, 0]), np.array([0.6, 0.8])) == pytest.approx(0.6) and bench.similarity(np.zeros(2), np.ones(2)) == 0


def test_voices_and_requests():
    clip = encode(8000, np.zeros(4))
    files = {"a.wav": clip, "b.wav": b"no"}
    bench.check_voices({"host": "a.wav"}, files.__getitem__, {"a.wav": hashlib.sha256(clip).hexdigest()})
    for cast, known in (({"x": "b.wav"}, None), ({"x": "a.wav"}, {"a.wav": "0"})):
        with pytest.raises(ValueError, match="voice of x"):
            bench.check_voices(cast, files.__getitem__, known)
    good = {"chunk_id": "c", "seed": 1, "turns": [{"speaker": "h", "text": "t"}], "voices": {"h": "a"}, "out": "x/y.wav"}
    assert bench.check_request(good) == good
    for change in ({"more": 1}, {"seed": "1"}, {"turns": []}, {"out": "../x"}, {"seed": True}, {"turns": [{"speaker": "q", "text": "t"}]}):
        with pytest.raises(ValueError):
            bench.check_request(good | change)
    with pytest.raises(ValueError, match="missing"):
        bench.check_request({})
