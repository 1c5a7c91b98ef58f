import json
import sys

import pytest
from pyspark import cloudpickle

from loomledger.operators import adjudicate
from loomledger.operators.models import _list, asked
from loomledger.plans import pipeline
from loomledger.streaming.ledger import LedgerTable, arrivals, batch_status, flatten, follow

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the models below travel to the tasks

RUN = """title = "T"
topic = "the flood"
[[sources]]
kind = "local_files"
root = "a"
independence_group = "north"
[[sources]]
kind = "local_files"
root = "b"
independence_group = "south"
[[analysers]]
kind = "quote_verifier"
"""


def episode(tmp_path, a, b, more=""):
    for name, t in (("a", a), ("b", b)):
        (tmp_path / name).mkdir(exist_ok=True)
        (tmp_path / name / "x.md").write_text(t)
    (tmp_path / "run.toml").write_text(RUN + more)
    return pipeline.read_spec(str(tmp_path / "run.toml"))


def test_run_and_cache(spark, tmp_path):
    spec = episode(tmp_path, "# N\n\nThe river rose. The mill burned.\n", "# S\n\nThe river rose. The bridge held.\n")
    r = pipeline.run(spark, spec, str(tmp_path / "cache"))
    assert {x.text: x.status for x in r.frames["ledger"].collect()} == {"The river rose.": "corroborated", "The mill burned.": "single_source", "The bridge held.": "single_source"}
    assert not r.failed and [f.severity for f in r.frames["analysis"].collect()] == ["info"]
    assert r.frames["script"].count() == 5
    again = pipeline.run(spark, spec, str(tmp_path / "cache"))
    assert all(hit for _, _, hit, _ in again.cache.records)
    pipeline.write(r, str(tmp_path / "out"))
    assert (tmp_path / "out" / "ledger.json").exists()


def test_contradiction(spark, tmp_path):
    both = '[embedding]\nkind = "fake"\n[nli]\nkind = "fake"\n'
    spec = episode(tmp_path, "The great explosion happened in June 1908.\n", "The great explosion happened in June 1907.\n", both)
    r = pipeline.run(spark, spec, str(tmp_path / "cache"))
    assert {x.status for x in r.frames["ledger"].collect()} == {"contested"} and r.frames["verdicts"].count() == 2


class Writer:
    """A model that answers every stage; the first script it writes has a reference to no source."""

    def __init__(self):
        self.tries = 0

    def complete(self, task, request):
        if "passage" in request:
            return json.dumps({"claims": [s.strip() + "." for s in request["passage"].split(".") if s.strip()]})
        if "evidence" in request:
            return json.dumps({"favours": "unresolved", "explanation": "Both stand.", "cites": [0, 1] if "1908" in json.dumps(request) else []})
        source = 0 if "rejected_because" in request else 99
        return json.dumps({"turns": [{"speaker": "host", "text": "A source says {{quote:0}}", "refs": [{"source": source, "sentence": 0}], "citations": [request["ledger"][0]["claim_id"]]}]})


    def unload(self):
        UNLOADED.append(self.tries)


UNLOADED: list[int] = []


class Vectors:
    def embed(self, texts):
        return [[1.0, len(t) % 7, t.count("explosion")] for t in texts]


class Scorer:
    def score(self, pairs):
        return [(0.0, 0.0, 1.0) if ("1907" in p) != ("1907" in h) else (1.0, 0.0, 0.0) for p, h in pairs]


def test_a_named_model_answers(spark, tmp_path, monkeypatch):
    spec = episode(tmp_path, "The great explosion happened in June 1908.\n", "The great explosion happened in June 1907.\n", '[llm]\nkind = "openai_compatible"\nurl = "http://localhost:1"\nmodel = "m"\n[embedding]\nkind = "openai_compatible"\nurl = "http://localhost:1"\nmodel = "e"\n[nli]\nkind = "cross_encoder"\nfolder = "/nowhere"\n')
    assert [p[:2] for p in spec.providers] == [("llm", "openai_compatible"), ("embedding", "openai_compatible"), ("nli", "cross_encoder")]
    m = spec.models()
    assert m.llm.model == "m" and m.embedder.model == "e" and m.scorer.folder == "/nowhere"
    monkeypatch.setattr(pipeline.Spec, "models", lambda self: pipeline.Models(Writer(), Vectors(), Scorer()))
    r = pipeline.run(spark, spec, str(tmp_path / "cache"))
    assert {x.status for x in r.frames["ledger"].collect()} == {"contested"}
    assert {x.explanation for x in r.frames["verdicts"].collect()} == {"Both stand."}
    (turn,) = r.frames["script"].collect()
    assert turn.text == "A source says “The great explosion happened in June 1908.”" and len(turn.quotes) == 1 and not r.failed and r.counts == {"errors": 0}
    assert UNLOADED
    assert all(x.basis.kind == "nli" for c in r.frames["claims"].collect() for x in c.evidence if x.stance == "contradicts")


def test_a_reply_that_never_holds(spark):
    class Bad:
        def complete(self, task, request):
            return "{}"

    with pytest.raises(ValueError, match="claims"):
        asked(Bad(), "extract", lambda d: _list(d, "claims"))({})
    contested = spark.createDataFrame([("c", "t", [("k", "supports")])], "claim_id string, text string, evidence array<struct<chunk:string,stance:string>>")
    chunks = spark.createDataFrame([("k", 1, "text")], "chunk_id string, doc_id long, text string")
    docs = spark.createDataFrame([(1, "T", "text")], "doc_id long, title string, text string")
    assert [(v.favours, v.cites) for v in adjudicate.verdicts(contested, chunks, docs, Bad()).collect()] == [("unresolved", ["k"])]


def test_spec_errors(tmp_path):
    for bad in ("x = 1", '[nli]\nkind = "fake"', '[llm]\nkind = "openai_compatible"\nurls = "x"', '[[analysers]]\nkind = "odd"', '[llm]\nkind = "odd"'):
        (tmp_path / "run.toml").write_text((bad + "\n" + RUN) if bad == "x = 1" else RUN + bad)
        with pytest.raises(ValueError):
            pipeline.read_spec(str(tmp_path / "run.toml"))


def test_stream_equals_batch(spark, tmp_path):
    s = "claim_id string, evidence array<struct<chunk:string,independence_group:string,stance:string>>"
    claims = spark.createDataFrame([("a", [("k1", "g", "supports"), ("k2", "G", "supports"), ("k3", "h", "supports")]), ("b", [("k1", "g", "supports")]), ("c", [("k1", "g", "contradicts")])], s)
    rows = flatten(claims)
    src = str(tmp_path / "in")
    rows.union(rows.limit(2)).repartition(3).write.parquet(src)  # repeated deliveries
    book = LedgerTable(str(tmp_path / "book"), buckets=4)
    for _ in range(2):  # the second run finds nothing new
        q = follow(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(src), book, str(tmp_path / "cp"))
        q.awaitTermination()
    assert {tuple(r) for r in book.ledger(spark).collect()} == {tuple(r) for r in batch_status(claims).collect()}
    book.merge(rows, 99)  # a batch delivered again changes nothing
    assert {tuple(r) for r in book.ledger(spark).collect()} == {tuple(r) for r in batch_status(claims).collect()}


def test_arrivals(spark):
    df = spark.createDataFrame([("2024-01-01 03:00:00", "supports"), ("2024-01-01 20:00:00", "supports"), ("2024-01-02 00:00:00", "contradicts")], "at string, stance string").selectExpr("cast(at as timestamp) at", "stance")
    assert sorted((str(r.day)[:10], r.stance, r.n) for r in arrivals(df).collect()) == [("2024-01-01", "supports", 2), ("2024-01-02", "contradicts", 1)]
