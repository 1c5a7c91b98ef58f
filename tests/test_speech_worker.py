import numpy as np
import pytest

from loomledger.operators.audio import frames
from loomledger.sources import providers, speech
from loomledger.sources.wav import decode

REQUEST = {"chunk_id": "c", "seed": 7, "turns": [{"speaker": "host", "text": "one two"}, {"speaker": "guest", "text": "three"}], "voices": {"host": "h.wav", "guest": "g.wav"}, "out": "a/b.wav"}


def test_worker_and_client(tmp_path):
    server = speech.serve(speech.ToneSpeaker(), str(tmp_path))
    try:
        client = speech.WorkerClient(f"http://127.0.0.1:{server.server_port}", str(tmp_path))
        assert client.health() == {"ok": True, "model": "tone"}
        samples, rate, spans = client.synthesize(REQUEST)
        assert rate == 24_000 and len(samples) == 18_000 and spans == [(0.0, 0.5), (0.5, 0.75)]
        assert np.array_equal(decode((tmp_path / "a" / "b.wav").read_bytes())[1], samples)
        client.unload()
        with pytest.raises(RuntimeError, match="400"):
            providers.post_json(f"{client.url}/synthesize", REQUEST | {"out": "x/../../y.wav"})
        (tmp_path / "out").symlink_to(tmp_path.parent)
        with pytest.raises(RuntimeError, match="run's folder"):
            providers.post_json(f"{client.url}/synthesize", REQUEST | {"out": "out/y.wav"})
        with pytest.raises(RuntimeError, match="404"):
            providers.post_json(f"{client.url}/other", {})
    finally:
        server.shutdown()
    with pytest.raises(ValueError, match="this machine"):
        speech.WorkerClient("http://10.0.0.1:9", str(tmp_path))


def test_replies_are_checked():
    providers.check_spans([1, 2], [(0.0, 0.5), (0.5, 1.0)], 1.0)
    for spans in ([(0.0, 1.0)], [(0.0, 0.6), (0.5, 1.0)], [(0.0, 0.5), (0.5, 1.1)], [(0.0, float("nan")), (0.5, 1.0)], [(0.4, 0.2), (0.5, 1.0)]):
        with pytest.raises(ValueError):
            providers.check_spans([1, 2], spans, 1.0)
    assert speech.ScriptedRecogniser(["ab", "abcd"]).transcribe(np.zeros(600), 100) == [("ab", 0.0, 2.0), ("abcd", 2.0, 6.0)]
    providers.check_scores([("p", "h")], [(0.2, 0.3, 0.5)])
    for bad in ([], [(1.0, 0.0)], [(float("nan"), 0.0, 0.0)]):
        with pytest.raises(ValueError):
            providers.check_scores([("p", "h")], bad)


def test_frames_of_nothing(spark):
    clips = spark.createDataFrame([(1, None), (2, []), (3, [0.0, 0.0])], "k long, samples array<double>")
    assert [r.n_over for r in frames.limited(clips, "k", 0.5, 2).orderBy("k").collect()] == [0, 0, 0]
    assert all(np.isnan(r.level) for r in frames.normalised(clips, "k", 100).collect())
    assert [r.b for r in clips.orderBy("k").select(frames.trim_bounds(clips.samples).alias("b")).collect()] == [None, None, None]
    assert frames.limited(clips.limit(0), "k", 0.5, 2).count() == 0
    blocks = spark.createDataFrame([(1, 0, "quick", 10_000), (1, 1, "interrupt", 4_000), (1, 2, None, 100)], "script_id long, turn int, pace string, length long")
    assert [(r.start, r.stop) for r in frames.laid_out(blocks).orderBy("turn").collect()] == [(0, 10_000), (6_000, 10_000), (22_000, 22_100)]
