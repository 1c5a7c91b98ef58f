from loomledger.operators import adjudicate, analyse, ranking, script


def test_fill():
    q = ["one", "two {{quote:0}}"]
    assert script.fill("a {{quote:0}} b “{{quote:1}}”", q)[0] == "a “one” b “two {{quote:0}}”"
    assert script.fill('"{{quote:0}}"', ["x"])[0] == "“x”"
    assert script.fill("{{quote:x}} z", q)[1] == "malformed" and script.fill("{{quote:1", q)[1] == "malformed"
    assert script.fill('he said "a b c" {{quote:0}} {{quote:1}}', q)[1:3] == ("typed", "a b c")
    assert script.fill('an "as {{quote:0}} says"', ["x"])[1] == "typed"
    assert script.fill('a " b {{quote:0}}', ["x"])[1] == "unclosed"
    assert script.fill("{{quote:2}}", q)[1:] == ("unknown", "2", 2) and script.fill("{{quote:0}}", q)[1:] == ("unused", None, 1)
    assert script.fill(None, None) == ("", None, None, None)


def test_fill_column(spark):
    df = spark.createDataFrame([("{{quote:0}}", ["x"]), ("{{quote:1}}", ["x"]), (None, None)], "t string, q array<string>")
    got = [tuple(r[0]) for r in df.select(script.fill_quotes("t", "q")).collect()]
    assert got == [("“x”", None, None, None), (None, "unknown", "1", 1), ("", None, None, None)]


def test_beats(spark):
    rows = [(1, 0, None), (1, 1, "hook"), (1, 2, None), (1, 3, "recap"), (2, 0, None), (2, 1, None), (3, 0, "hook")]
    t = spark.createDataFrame(rows, "script_id long, turn int, mark string")
    b = script.beats(t)
    assert sorted((r.script_id, r.beat, r.kind, r.start, r.stop) for r in b.collect()) == [(1, 0, "narration", 0, 1), (1, 1, "hook", 1, 3), (1, 2, "recap", 3, 4), (3, 0, "hook", 0, 1)]
    whole = script.implied_beats(t, b)
    assert sorted((r.script_id, r.start, r.stop) for r in whole.where("script_id = 2").collect()) == [(2, 0, 1), (2, 1, 2)]
    assert script.broken_beats(whole).count() == 0
    bad = spark.createDataFrame([(1, 0, 0, 2), (1, 1, 1, 3), (1, 2, 4, 4), (2, 0, 1, 2)], "script_id long, beat int, start int, stop int")
    assert {(r.script_id, r.beat, r.problem) for r in script.broken_beats(bad).collect()} == {(1, 1, "overlap"), (1, 2, "empty"), (2, 0, "gap")}


def test_context_and_cast(spark):
    c = spark.createDataFrame([(1, 0, [0, 1]), (1, 1, [2, 3])], "script_id long, chunk_no int, turns array<int>")
    t = spark.createDataFrame([(1, 2, 0), (1, 3, 1), (1, 1, None)], "script_id long, turn int, callback_to int")
    assert {(r.chunk_no, r.previous, tuple(r.called)) for r in script.context(c, t).collect()} == {(0, None, ()), (1, 1, (0,))}
    turns = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "turn_id long, script_id long, speaker string")
    cast = spark.createDataFrame([(1, "a"), (1, "a")], "script_id long, speaker string")
    assert [r.turn_id for r in script.undeclared_speakers(turns, cast).collect()] == [2]
    big = spark.createDataFrame([(1, "x" * 30_000), (2, "y")], "k long, t string")
    assert [r.k for r in script.oversized_requests(big, "k", "t").collect()] == [1]


def test_quotes(spark):
    q = "quotes array<struct<document:bigint,span:struct<start:bigint,stop:bigint>,text:string>>"
    rows = [
        (1, "so “the ß fell down” he wrote", [(1, (0, 15), "the ß fell down")]), (2, "x", [(9, (0, 1), "t")]), (3, "x", [(1, (0, 3), "thE")]), (4, "x", [(1, (0, 3), "the")]), (5, 'he typed "one two three" here', []), (6, "plain", None),
    ]
    turns = spark.createDataFrame(rows, f"turn_id long, text string, {q}")
    docs = spark.createDataFrame([(1, "the ß fell down"), (2, None)], "doc_id long, text string")
    docs = docs.selectExpr("doc_id", "text")
    got = {r.turn_id: r.message.split(":")[0] for r in analyse.quote_findings(turns, docs).collect()}
    assert got[2].startswith("quote cites unknown") and got[3] == "quote does not match the source" and got[4] == "turn does not speak the quote" and got[5] == "turn quotes words no quote covers" and set(got) <= {1, 2, 3, 4, 5}


def test_figures_and_metrics(spark):
    q = "quotes array<struct<document:bigint,span:struct<start:bigint,stop:bigint>,text:string>>"
    rows = [(1, 1, "It was (1908), they say", [], []), (2, 1, "said in 1908", [(1, (0, 1), "in 1908")], []), (3, 1, "in 1908", [], ["a", "a", "zz"]), (4, 2, "none", None, None)]
    t = spark.createDataFrame(rows, f"turn_id long, script_id long, text string, {q}, citations array<string>")
    assert [(r.turn_id, r.figure) for r in analyse.uncited_figures(t).collect()] == [(1, "1908")]
    book = spark.createDataFrame([("a", "contested"), ("b", "unsupported"), ("c", "corroborated")], "claim_id string, status string")
    m = {r.script_id: r for r in analyse.script_metrics(t, book).collect()}
    assert (m[1].words, m[1].turns, m[1].quotes, m[1].citations, m[1].distinct_cited, m[1].unknown_citations, m[1].judged_cited, m[1].coverage) == (10, 3, 1, 3, 1, 1, 1, 0.5)
    assert (m[2].citations, m[2].coverage) == (0, 0.0)
    c = spark.createDataFrame([("x", "a"), ("x", "b"), ("y", "b"), ("y", "b"), ("z", "q")], "k string, claim_id string")
    assert {(r.a, r.b, r.shared, r.only_a, r.only_b, round(r.jaccard, 3)) for r in analyse.citation_overlap(c, "k").collect()} == {("x", "y", 1, 1, 0, 0.5), ("x", "z", 0, 2, 1, 0.0), ("y", "z", 0, 1, 1, 0.0)}


def test_verdicts(spark):
    e = "claim_id string, evidence array<struct<chunk:string,independence_group:string,stance:string>>"
    c = spark.createDataFrame([("a", [("k1", "g", "supports"), ("k2", "h", "contradicts"), ("k3", "h", "contradicts")]), ("b", [("k9", "g", "contradicts")])], e)
    assert {(r.claim_id, tuple(r.cites)) for r in adjudicate.fallback(c).collect()} == {("a", ("k1", "k2")), ("b", ("k9",))}
    v = spark.createDataFrame(
        [("a", "unresolved", "ok", [0, 1]), ("a", "supporting", "ok", [1]), ("a", "unresolved", "ok", [7]), ("b", "supporting", "ok", [0]), ("zz", "unresolved", "ok", [0]), ("b", "unresolved", 'a "b', [0]), ("b", "unresolved", "x" * 601, [0])],
        "claim_id string, favours string, explanation string, cites array<int>",
    )
    got = sorted(r.problem for r in adjudicate.invalid_verdicts(v, c).collect())
    assert got == sorted(["a supporting side is not cited", "cites out of range", "favours a side without evidence", "unknown claim", "explanation quotes", "explanation too long"])


def test_ranking(spark):
    rows = [("a", 1.0), ("a", 3.0), ("a", 2.0), ("a", 4.0), ("b", 5.0), ("b", None), ("c", None)] + [("d", 7.0)] * 9
    df = spark.createDataFrame(rows, "k string, v double")
    assert {r.k: r["median"] for r in ranking.upper_median(df, "k", "v").collect()} == {"a": 3.0, "b": 5.0, "d": 7.0}
    takes = spark.createDataFrame([(1, 0, False, 0, 1.0, 1.0), (1, 1, True, 90, 9.0, 1.0), (1, 2, True, 90, 2.0, 1.0), (1, 3, True, 90, 2.0, 1.0), (2, 0, None, 5, None, None)], "k long, take int, passed boolean, wer_pm int, rate double, median double")
    assert {(r.k, r["take"]) for r in ranking.best_take(takes, "k").collect()} == {(1, 2), (2, 0)}


def test_any_number_of_quotes(spark):
    from loomledger.operators import analyse

    quote = "struct<document:long,span:struct<start:long,stop:long>,text:string>"
    many = [(99, (0, 1), f"q{i}") for i in range(1200)]
    turns = spark.createDataFrame([(1, 'He said "one two three" twice.', many)], f"turn_id long, text string, quotes array<{quote}>")
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    got = {(r.kind, r.check_ix) for r in analyse.quote_findings(turns, docs).collect()}
    assert got == {("quote", i) for i in range(1200)} | {("quotation", 0)}
    assert {(r.severity, r.n) for r in analyse.by_severity(analyse.quote_findings(turns, docs)).collect()} == {("error", 1201)}


def test_directions(spark):
    from loomledger.operators import script

    t = spark.createDataFrame([(1, 0, ["q"]), (1, 1, []), (1, 2, None), (2, 0, None), (3, 4, []), (3, 5, [])], "script_id long, turn int, quotes array<string>")
    got = {(r.script_id, r.turn): (r.mark, r.pace, len(r.sounds), r.callback_to) for r in script.directed(t).collect()}
    assert got == {(1, 0): ("quote_reading", "normal", 0, None), (1, 1): ("banter", "quick", 1, None), (1, 2): ("transition", "long_pause", 0, 0), (2, 0): ("transition", "long_pause", 0, 0), (3, 4): ("narration", "normal", 0, None), (3, 5): ("transition", "long_pause", 0, 4)}
