import itertools
import random

from pyspark.sql import functions as F

from loomledger.operators import cluster, ground, stances
from loomledger.operators.nli import stand_in


def test_stand_in(spark):
    rows = [
        ("It happened in June 1908 near the river", "It happened in June 1907", (0.0, 0.0, 1.0)), ("trees fell in the forest", "trees fell", (1.0, 0.0, 0.0)), ("trees fell", "trees fell forest", (2 / 3, 1 / 3, 0.0)),
        ("x", "", (0.0, 1.0, 0.0)), ("about 12", "13", (0.0, 0.0, 1.0)), ("no figures here", "figures 13", (0.5, 0.5, 0.0)),
    ]
    df = spark.createDataFrame([(a, b) for a, b, _ in rows], "p string, h string")
    for r, (_, _, want) in zip(df.select(stand_in("p", "h").alias("s")).collect(), rows, strict=True):
        assert all(abs(x - y) < 1e-12 for x, y in zip(r.s, want, strict=True))


def test_decide(spark):
    n, t = "in 1908", "in June"
    cases = [
        (n, n, 900, 800, 1000, None, "supports"), (n, n, 600, 799, 950, 950, "contradicts"), (n, n, 600, 799, 950, 949, None), (n, n, 600, 0, 950, None, None), (t, n, 600, 0, 950, None, "contradicts"), (n, t, 600, 0, 950, None, "contradicts"),
        (t, t, 599, 0, 1000, None, None), (t, t, 600, 0, 949, None, None),
    ]
    df = spark.createDataFrame(cases, "c string, p string, s int, e int, k int, r int, want string")
    got = stances.decide("c", "p", F.col("s"), F.col("e"), F.col("k"), F.col("r"))
    assert df.where(~got.eqNullSafe(F.col("want"))).count() == 0


def test_reverse_hypotheses(spark):
    df = spark.createDataFrame([("In 1927 he left. He never came.",), ("In 1927. In 1928.",), ("No figure.",), ("",)], "p string")
    assert [r[0] for r in df.select(stances.reverse_hypotheses("p")).collect()] == [["In 1927 he left.", "In 1927 he left. He never came."], ["In 1927.", "In 1928."], [], []]


def test_deciding_and_report(spark):
    rows = [("a", "k", "contradicts", 0, 990, 1), ("a", "k", "supports", 810, 0, 3), ("a", "k", "supports", 810, 0, 2), ("b", "k", "contradicts", 0, 960, 1), ("b", "k", "contradicts", 0, 970, 2), ("c", "k", None, 0, 0, 1)]
    df = spark.createDataFrame(rows, "claim_id string, chunk_id string, stance string, entail_pm int, contra_pm int, rank int")
    assert {(r.claim_id, r.stance, r["rank"]) for r in stances.deciding(df).collect()} == {("a", "supports", 2), ("b", "contradicts", 2)}
    lab = spark.createDataFrame([("supports", "supports"), ("supports", None), ("neither", "contradicts"), ("contradicts", "contradicts")], "label string, stance string")
    got = {r.stance: tuple(r)[1:] for r in stances.report(lab).collect()}
    assert got == {"supports": (1, 0, 1, 1000, 500), "contradicts": (1, 1, 0, 500, 1000)}


def test_greedy_needs_every_edge():
    assert cluster.greedy(["A", "B", "C"], {("A", "B"), ("B", "C")}) == {"A": "A", "B": "A", "C": "C"}
    r = random.Random(1)
    for _ in range(60):
        nodes = [f"n{i}" for i in range(8)]
        edges = {p for p in itertools.combinations(nodes, 2) if r.random() < 0.5}
        free, want = set(), {}
        for m in nodes:
            if m in want:
                continue
            group = [m]
            want[m] = m
            for o in nodes:
                if o > m and o not in want and all((min(x, o), max(x, o)) in edges for x in group):
                    group.append(o)
                    want[o] = m
        assert cluster.greedy(nodes, edges) == want and not free


def test_clusters(spark):
    claims = [("a1", "the mill burned in june 1871"), ("b2", "in june 1871 the mill burned"), ("c3", "the mill burned in june 1872"), ("d4", "a bridge stood")]
    df = spark.createDataFrame(claims, "claim_id string, text string")
    pairs = cluster.nominated(df)
    assert {(r.a, r.b) for r in pairs.collect()} >= {("a1", "b2")}
    edges = cluster.equivalent(pairs)
    assert [(r.a, r.b, r.mutual_pm) for r in edges.collect()] == [("a1", "b2", 1000)]
    assert {(r.claim_id, r.lead) for r in cluster.clusters(edges).collect()} == {("a1", "a1"), ("b2", "a1")}
    r = random.Random(8)
    for n, share in ((14, 0.3), (20, 0.15)):
        pairs = {(f"m{i:02}", f"m{j:02}") for i in range(n) for j in range(i + 1, n) if r.random() < share}
        tangle = spark.createDataFrame(sorted(pairs), "a string, b string")
        want = set(cluster.greedy(sorted({x for p in pairs for x in p}), pairs).items())
        assert {(x.claim_id, x.lead) for x in cluster.clusters(tangle).collect()} == want == {(x.claim_id, x.lead) for x in cluster.clusters(tangle, most=0).collect()}
    assert cluster.in_rounds(tangle.limit(0)).count() == 0
    chain = spark.createDataFrame([(f"n{i:02}", f"n{i + 1:02}") for i in range(20)], "a string, b string")
    assert {r.comp for r in cluster.components(chain).collect()} == {"n00"}


def test_ground(spark):
    ev = spark.createDataFrame([("a", "k", "the mill burned in 1871"), ("b", "k", "the mill led the town"), ("c", "none", "x y z")], "claim_id string, chunk_id string, text string")
    w = spark.createDataFrame([("k", 0, 1, 0, "The mill burned in 1871."), ("k", 1, 1, 0, "It joined the town.")], "chunk_id string, first int, n_sents int, slice int, premise string")
    j = ground.judge(ev, w)
    assert {(r.claim_id, r.entail_pm) for r in j.collect()} == {("a", 1000), ("b", 333), ("c", None)}
    assert {r.claim_id for r in ground.keep(j).collect()} == {"a"} and {r.claim_id for r in ground.reject(j).collect()} == {"b", "c"} == {r.claim_id for r in ground.dropped_claims(j).collect()}
