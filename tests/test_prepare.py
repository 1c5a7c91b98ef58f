from loomledger.operators import prepare, windows


def cut(text, n=800):
    raw = text.encode()
    return [(raw[a:b].decode(), path) for a, b, path in prepare.cut(raw, n)]


def test_headings_and_paths():
    got = cut("intro\n\n# A\ntext a\n## B\nß text b\n\n### C\n# D\nlast")
    assert got == [("intro", []), ("text a", ["A"]), ("ß text b", ["A", "B"]), ("last", ["D"])]
    assert cut("#no heading\n####### seven\n # indented") == [("#no heading\n####### seven\n # indented", [])]


def test_fences():
    t = "# A\n```\n# not\n~~~\n# still\n```\n# B\nx"
    assert cut(t) == [("```\n# not\n~~~\n# still\n```", ["A"]), ("x", ["B"])]


def test_long_chunks_end_at_blank_lines():
    assert cut("a b c\n\nd e f\n\ng", 3) == [("a b c", []), ("d e f", []), ("g", [])]
    assert cut("a b\n\nc d e f\n\ng", 3) == [("a b\n\nc d e f", []), ("g", [])]
    assert cut("") == [] and cut(" \n\t\n") == []


def test_chunk_frame(spark):
    docs = spark.createDataFrame([(1, "# T\r\n  ßa b  \n\nc", 7), (2, None, 8), (3, "", 9)], "doc_id long, text string, chunk_ix int")
    rows = prepare.chunk_documents(docs).collect()
    assert [(r.doc_id, r.chunk_ix, r.span.start, r.span.stop, r.heading_path, r.text) for r in rows] == [(1, 0, 7, 17, ["T"], "ßa b  \n\nc")]
    assert prepare.chunk_documents(docs.limit(0)).count() == 0


def test_dedup(spark):
    rows = [(3, "a\r\nb", "g"), (1, "a\nb", "g"), (2, "a\nb", "h"), (4, None, "g"), (5, "a\nb", None), (6, "﻿a\rb", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, grp string")
    got = prepare.dedup_within_group(docs, "grp").orderBy("doc_id").collect()
    assert [(r.doc_id, r.text) for r in got] == [(1, "a\nb"), (2, "a\nb"), (5, "a\nb")]


def test_shared_ids(spark):
    s = "doc_id long, source_ref struct<connector:string,locator:string,independence_group:string>"
    df = spark.createDataFrame([(1, ("c", "a", "g")), (1, ("c", "b", "g")), (2, ("c", "a", None)), (2, ("c", "a", None))], s)
    assert [tuple(r) for r in prepare.shared_ids(df).collect()] == [(1, 2)]


def test_windows(spark):
    long = " ".join(f"w{i}" for i in range(250)) + "."
    df = spark.createDataFrame([("a", "Öne two. Three!  Four"), ("b", long), ("c", None), ("d", "")], "chunk_id string, text string")
    rows = windows.windows(df).orderBy("chunk_id", "first", "n_sents", "slice").collect()
    a = [(r.first, r.n_sents, r.premise, r.start, r.stop) for r in rows if r.chunk_id == "a"]
    assert a == [(0, 1, "Öne two.", 0, 9), (0, 2, "Öne two. Three!", 0, 16), (1, 1, "Three!", 10, 16), (1, 2, "Three!  Four", 10, 22), (2, 1, "Four", 18, 22)]
    b = [r for r in rows if r.chunk_id == "b"]
    assert [r.premise.split()[0] for r in b] == ["w0", "w60", "w120", "w130"] and all(len(r.premise.split()) == 120 and not r.whole for r in b)
    raw = long.encode()
    assert all(raw[r.start : r.stop].decode() == r.premise for r in b)
    spans = windows.sentence_spans(df.where("text is not null"), "chunk_id").where("chunk_id = 'a'").orderBy("sent_ix").collect()
    assert [(r.sentence, r.start, r.stop) for r in spans] == [("Öne two.", 0, 9), ("Three!", 10, 16), ("Four", 18, 22)]


def test_latest_either_way(spark, monkeypatch):
    from loomledger import tables

    rows = [("a", 1, "x"), ("a", 2, "y"), ("a", None, "z"), ("b", 1, None), ("c", 5, "p"), ("c", 5, "q"), ("c", 5, "q"), (None, 1, "n"), (None, 3, "m")]
    df = spark.createDataFrame(rows, "k string, ingested_at int, t string").repartition(3)
    want = {("a", 2, "y"), ("b", 1, None), ("c", 5, "q"), (None, 3, "m")}
    for one_pass, again in ((1 << 40, 1 << 24), (0, 1 << 40), (0, 0)):
        monkeypatch.setattr(tables, "ONE_PASS", one_pass)
        monkeypatch.setattr(tables, "AGAIN", again)
        got = [(r.k, r.ingested_at, r.t) for r in tables.latest(df, "k").collect()]
        assert set(got) == want and len(got) == 4
