import random

from pyspark.sql import functions as F

from loomledger.operators import claims, ledger

SCHEMA = "claim_id string, text string, evidence array<struct<chunk:string,independence_group:string,stance:string>>"


def test_classify(spark):
    e = lambda g, s: ("c", g, s)
    rows = [
        ("a", "", [e("g1", "supports"), e("g2", "supports"), e("G1", "supports")]), ("b", "", [e("g_1", "supports"), e("g-1", "supports")]), ("c", "", [e("g", "supports"), e("h", "contradicts")]),
        ("d", "", [e("h", "contradicts")]), ("e", "", []), ("f", "", None), ("g", "", [e(None, "supports"), e("x", "supports")]),
    ]
    got = {r.claim_id: r for r in ledger.classify(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {k: v.status for k, v in got.items()} == {"a": "corroborated", "b": "single_source", "c": "contested", "d": "contested", "e": "unsupported", "f": "unsupported", "g": "single_source"}
    assert got["a"].groups == ["g1", "g2"] and got["b"].grp == "g-1" and got["c"].supporting == ["g"] and got["c"].contradicting == ["h"] and got["g"].grp == "x"
    stored = ledger.classify(spark.createDataFrame(rows, SCHEMA))
    assert ledger.tampered(stored).count() == 0
    wrong = stored.withColumn("status", F.when(F.col("claim_id") == "e", "corroborated").otherwise(F.col("status")))
    assert [r.claim_id for r in ledger.tampered(wrong).collect()] == ["e"]
    assert ledger.classify(spark.createDataFrame([], SCHEMA)).count() == 0


def test_first_appearance(spark):
    c = spark.createDataFrame([("a", "", [("k2", "g", "supports"), ("k1", "g", "supports")]), ("b", "", [("zz", "g", "supports")]), ("c", "", None)], SCHEMA)
    k = spark.createDataFrame([("k1", 5, 200_000), ("k2", 6, 0)], "chunk_id string, doc_id long, chunk_ix int")
    assert {r.claim_id: (r.doc_id, r.chunk_ix) for r in ledger.first_appearance(c, k, "doc_id", "chunk_ix").collect()} == {"a": (5, 200_000), "b": (None, None), "c": (None, None)}


def test_merge_is_order_independent(spark):
    rows = [("The  River rose.", 2, "k2", "g"), ("the river ROSE.", 1, "k1", "h"), ("the river ROSE.", 1, "k1", "h"), ("Other", 3, "k1", "g")]
    want = None
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "claim_text string, ix int, chunk string, grp string").repartition(3)
        got = sorted((r.text, [tuple(e) for e in r.evidence]) for r in claims.merge(df, ["ix"], ["chunk", "grp"]).collect())
        want = want or got
        assert got == want == [("Other", [("k1", "g")]), ("the river ROSE.", [("k1", "h"), ("k2", "g")])]


def test_grounding(spark):
    rows = [
        ("The mill burned in 1871", "In 1871 the old mill burned down", "", True), ("The mill burned in 1872", "In 1871 the old mill burned down", "", False), ("The mill burned in 1872", "the old mill burned down", "Report 1872", True),
        ("Report mill", "nothing", "Report mill", False), ("", "x", "", False), (None, "x", "", False), ("mill fell apart slowly", "the mill fell", "", False),
    ]
    df = spark.createDataFrame(rows, "c string, p string, n string, want boolean")
    assert df.where(claims.is_grounded("c", "p", "n") != F.col("want")).count() == 0
